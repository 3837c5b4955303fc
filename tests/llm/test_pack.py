"""Packing against the tokenizer itself, and plans against all partitions of small cases."""

import math
import random
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from wattloom.llm.op9_pack import BinCompletion, best_fit, default_tokenizer, least_bins, op9_best_fit_packing, pack, plan_patterns, word_ids

SF = "/root/testdata/sf0.01"


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def ids_of(t, text):
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_ids_are_those_of_the_tokenizer():
    t, rng = tokenizer(), random.Random(1)
    letters = "aBé'’._-|%12 \n\tßİs't²ªΣ\u0085 \u001c日é"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(2500)]
    texts += ["", "<|endoftext|> A<|startoftext|>b", "I'LL don't 'tis rock'n'roll", "x\x1cy", "word%%% the*** U.S.A. 3rd x²", "É É ÅÅ", "_a_b__ {x}[y]~", "The THE the, The. thE;"]
    for text, own in zip(texts, word_ids(default_tokenizer())(texts), strict=True):
        assert own == ids_of(t, text)[:-1].tobytes(), text


def check(rows, docs):
    t = tokenizer()
    want = Counter()
    for i, text in docs:
        ids = ids_of(t, text)
        for n, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[i, n, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return len(filled), math.ceil(sum(r["length"] for r in rows) / 2048)


def test_documents_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    used, least = check(op9_best_fit_packing(spark, SF).collect(), docs)
    assert used <= least + 1


def test_odd_rows(spark, odd_documents):
    docs = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    check(pack(odd_documents).collect(), docs)
    assert pack(odd_documents.limit(0)).count() == 0


def fewest(items, capacity):
    """The fewest bins, by trying every bin for each item."""
    best = len(items)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for r in set(rooms):
            if r >= items[k]:
                left = list(rooms)
                left[left.index(r)] -= items[k]
                place(k + 1, left)
        place(k + 1, [*rooms, capacity - items[k]])

    place(0, [])
    return best


def test_plans_are_valid_and_of_the_fewest_bins():
    rng = random.Random(7)
    over = 0
    for _ in range(120):
        capacity = 20
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        plan = plan_patterns(dict(Counter(items)), capacity)
        used = Counter()
        for held, n in plan:
            assert sum(held) <= capacity and n > 0
            for s in held:
                used[s] += n
        assert used == Counter(items)
        bins, least = sum(n for _, n in plan), fewest(items, capacity)
        assert bins >= least
        over += bins > least
    assert over == 0


def test_search_beats_best_fit_where_it_wastes():
    counts = {11: 100, 9: 100, 7: 100, 6: 200, 3: 100, 1: 0}
    counts = {k: v for k, v in counts.items() if v}
    plan = best_fit(counts, 20)
    better = BinCompletion(counts, 20).search(plan)
    assert sum(n for _, n in better) <= sum(n for _, n in plan)
    assert Counter({s: sum(n * held.count(s) for held, n in better) for s in counts}) == Counter(counts)


HARD = {
    "5 and 2": {5: 1_000_000, 2: 3_000_000}, "700, 5 and 2": {700: 5000, 5: 100_000, 2: 50_000}, "60 to 380 by 20": {k: 1 for k in range(60, 381, 20)},
    "600 to 1097 by 7": {k: 3 for k in range(600, 1098, 7)}, "thirds": {683: 999, 684: 1000, 1365: 100}, "all": {k: k % 97 + 1 for k in range(1, 2049)}, "one length": {3: 10**7},
}


@pytest.mark.parametrize("counts", HARD.values(), ids=HARD)
def test_the_search_ends_for_any_histogram(counts):
    began = time.time()
    plan = plan_patterns(counts)
    assert time.time() - began < 60
    used = Counter()
    for held, n in plan:
        assert sum(held) <= 2048
        for s, k in Counter(held).items():
            used[s] += n * k
    assert used == Counter(counts)
    assert least_bins(counts, 2048) <= sum(n for _, n in plan) <= sum(n for _, n in best_fit(counts, 2048))


def test_bounds_that_are_met():
    assert sum(n for _, n in plan_patterns(HARD["5 and 2"])) == math.ceil(11_000_000 / 2048) < sum(n for _, n in best_fit(HARD["5 and 2"], 2048))
    assert least_bins(HARD["thirds"], 2048) == 1050 == sum(n for _, n in plan_patterns(HARD["thirds"]))
    rng = random.Random(3)
    for _ in range(200):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 8))]
        assert least_bins(dict(Counter(items)), 20) <= fewest(sorted(items, reverse=True), 20)


def test_a_missed_bound_is_told(caplog):
    plan_patterns({k: k % 9 + 1 for k in range(500, 1100)}, nodes=500)
    assert "the bound is" in caplog.text


def test_fillings_are_all_undominated_ones():
    """Against all multisets: every filling has one that is listed and holds it, and none is listed twice."""
    rng = random.Random(11)
    for _ in range(60):
        counts = dict(Counter(rng.randint(1, 12) for _ in range(rng.randint(2, 9))))
        search = BinCompletion(counts, 20)
        search.sizes = sorted(counts, reverse=True)
        own = search.sizes[0]
        listed = list(search.fillings(20 - own, own))
        assert len(set(listed)) == len(listed)
        left = Counter(counts)
        left[own] -= 1
        items = sorted(left.elements(), reverse=True)
        every = {c for k in range(len(items) + 1) for c in combinations(items, k) if sum(c) <= 20 - own}
        for filling in every:
            assert any(covers(best, filling) for best in listed), (counts, filling, listed)


def covers(best, filling):
    """Whether the lengths of ``filling`` fit into those of ``best``, by trying all ways."""
    if not filling:
        return True
    return any(best[i] >= filling[0] and covers((*best[:i], best[i] - filling[0], *best[i + 1 :]), filling[1:]) for i in range(len(best)))


@pytest.mark.parametrize("counts", [{2048: 5}, {1: 10_000}, {2047: 3, 1: 3}, {1025: 7}, {}])
def test_plain_cases(counts):
    total = sum(k * n for k, n in counts.items())
    bins = sum(n for _, n in plan_patterns(counts))
    assert bins == (7 if 1025 in counts else math.ceil(total / 2048))
