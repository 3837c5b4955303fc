"""Quality, toxicity and language-model scores: held-out accuracy and brute force."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wattloom.llm import op3_quality as quality
from wattloom.llm import op6_pitman_yor as lm
from wattloom.llm import op7_toxicity as toxic
from wattloom.llm.common import hash_word

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def held_out(i, m, r):
    return zlib.crc32(str(i).encode()) % m == r


def accuracy(spark, rows, label, threshold):
    known = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    own = [(r["predicted"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    assert all(r["predicted"] == int(r["score"] >= threshold) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == held_out(r["doc_id"], 3, 1) for r in rows)
    return sum(a == b for a, b in own) / len(own)


def test_quality_held_out(spark):
    rows = quality.op3_quality_rules(spark, LARGER).collect()
    assert len(rows) == 10_000 and accuracy(spark, rows, "quality", 0.5) > 0.98


def test_toxicity_held_out(spark):
    rows = toxic.op7_toxicity(spark, LARGER).collect()
    assert len(rows) == 10_000 and accuracy(spark, rows, "toxic", 0.7) > 0.96


# --- quality -------------------------------------------------------------------------------------------------------


def test_statistics_are_those_of_the_text(spark, odd_documents):
    texts = [r["text"] or "" for r in odd_documents.collect()]
    got = quality.with_statistics(odd_documents).collect()
    for text, row in zip(texts, got, strict=True):
        data, words = text.encode(), [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        low = [w.translate(LOWER) for w in words]
        b, w = max(len(data), 1), max(len(words), 1)
        assert row["n_bytes"] == len(data) and row["n_words"] == len(words)
        assert row["digits"] == pytest.approx(sum(48 <= x < 58 for x in data) / b)
        assert row["distinct_words"] == pytest.approx(len(set(low)) / w)
        assert row["top_word"] == pytest.approx(max(Counter(low).values(), default=0) / w)
        assert row["doubled_words"] == pytest.approx(sum(x == y for x, y in zip(low, low[1:], strict=False)) / w)
        assert row["short_words"] == pytest.approx(sum(len(x.encode()) <= 3 for x in words) / w)


def test_rules_come_from_paths():
    text = "Tree 0\n  If (feature 1 <= 2.5)\n   If (feature 0 > 7.0)\n    Predict: 0.0\n   Else (feature 0 <= 7.0)\n    Predict: 1.0\n  Else (feature 1 > 2.5)\n   Predict: 1.0\n"
    got = [r.conditions for r in quality.tree_rules(text)]
    assert got == [(("n_words", "<=", 2.5),), (("n_words", "<=", 2.5), ("n_bytes", ">", 7.0)), (("n_words", "<=", 2.5), ("n_bytes", "<=", 7.0))]


def test_compiled_rules_score_as_rules_by_hand(spark):
    """The ensemble's column expression against its rules, applied one by one to each row's statistics."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").where("doc_id % 3 = 0")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", F.col("quality").cast("double").alias("label"))
    measured = quality.with_statistics(docs).cache()
    ensemble = quality.fit(measured.join(labels, "doc_id").where("label is not null").drop("doc_id"))
    assert 3 < len(ensemble.rules) and any(len(r.conditions) > 1 for r, _ in ensemble.rules)
    for row in measured.withColumn("got", ensemble.score()).limit(400).collect():
        total = ensemble.base
        for rule, weight in ensemble.rules:
            total += weight * all((row[name] <= value) if sign == "<=" else (row[name] > value) for name, sign, value in rule.conditions)
        assert row["got"] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-9)


def test_queries_of_empty_tables(spark, tmp_path):
    from wattloom.llm.queries import QUERIES

    for name in ("documents", "labels", "embeddings", "pages"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_quality_without_labels_and_rows(spark, odd_documents):
    for labels, want in (([], 0.5), ([1.0, 1.0], 0.999)):
        rows = spark.createDataFrame([(*[0.0] * len(quality.STATISTICS), y) for y in labels], ", ".join(f"{s} double" for s in quality.STATISTICS) + ", label double")
        scored = quality.with_statistics(odd_documents).select(quality.fit(rows).score().alias("s")).collect()
        assert all(r["s"] == pytest.approx(want) for r in scored)
    assert quality.with_statistics(odd_documents.limit(0)).count() == 0


# --- toxicity ------------------------------------------------------------------------------------------------------


def index_of(rng, n_examples, n_terms):
    rows, places = np.nonzero(rng.random((n_examples, n_terms)) < 0.08)
    keep = np.unique(rows, return_inverse=True)[1]
    n = keep.max() + 1
    return toxic.BlockMaxIndex(np.arange(n_terms), rng.random(n_terms) + 0.5, np.arange(n) * 3, rng.integers(0, 2, n), keep, places, rng.integers(1, 5, len(keep)).astype(float), (1, 20)), keep, places


def test_nearest_are_exact(monkeypatch):
    monkeypatch.setattr(toxic, "BLOCK", 16)
    rng = np.random.default_rng(3)
    index, rows, places = index_of(rng, 500, 40)
    dense = np.zeros((len(index.ids), 40))
    for p in range(40):
        lo, hi = index.edges[p * index.n_blocks], index.edges[(p + 1) * index.n_blocks]
        dense[index.example[lo:hi], p] = index.weight[lo:hi]
    assert (dense**2).sum(axis=1) == pytest.approx(np.ones(len(dense)))
    for _ in range(60):
        own = np.flatnonzero(rng.random(40) < 0.1)
        if not len(own):
            continue
        q = rng.random(len(own)) + 0.1
        q /= np.sqrt((q * q).sum())
        best, score = index.nearest(own, q)
        all_ = dense[:, own] @ q
        want = sorted(np.flatnonzero(all_ > 0), key=lambda e: (-round(all_[e], 12), e))[: toxic.K]
        assert best.tolist() == want and score == pytest.approx(all_[want])


def test_neighbours_of_documents_are_exact(spark):
    """The evidence of whole documents against TF-IDF cosines to every example, term by term."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    index = toxic.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    terms = lambda t: Counter(hash_word(w.lower() if w.isascii() else w.translate(LOWER)) for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t or ""))
    idf = dict(zip(index.vocabulary.tolist(), index.idf.tolist(), strict=True))

    def vector(text):
        v = {k: (1 + math.log(n)) * idf[k] for k, n in terms(text).items() if k in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {k: x / size for k, x in v.items()} if size else {}

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    examples = {int(i): vector(texts[int(i)]) for i in index.ids}
    got = {r["doc_id"]: r["evidence"] for r in toxic.score_toxicity(docs.where("doc_id % 29 = 0"), index).collect()}
    assert len(got) > 20
    for i, evidence in got.items():
        own = vector(texts[i])
        cosines = {e: sum(x * v.get(k, 0.0) for k, x in own.items()) for e, v in examples.items()}
        best = sorted((c for c in cosines.values() if c > 0), reverse=True)[:3]
        assert [cosines[e] for e in evidence] == pytest.approx(best, abs=1e-5)


def test_best_split_of_votes():
    rng = np.random.default_rng(5)
    for _ in range(50):
        votes, labels = rng.integers(0, 5, 12) / 4, rng.integers(0, 2, 12)
        votes[rng.random(12) < 0.2] = np.nan
        known = np.nan_to_num(votes, nan=-1)
        assert toxic.best_split(votes, labels) == max(int(((known >= t) == labels).sum()) for t in [*known, 9])


def test_the_factor_is_chosen_on_examples(spark):
    """Topics rule the plain cosine; a few words tell toxic texts, whichever the topic."""
    rng = np.random.default_rng(1)
    rows, labels, tf = [], rng.integers(0, 2, 600), []
    for i in range(600):
        topic = int(rng.integers(0, 20))
        own = {10 + topic * 5 + k: 1 for k in range(5)} | ({int(rng.integers(0, 4)): 1} if labels[i] else {})
        rows += [(i, t) for t in sorted(own)]
        tf += [1.0] * len(own)
    entries = np.array(rows)
    examples = toxic.Examples(np.arange(600), labels, np.arange(110), entries[:, 0].astype(np.int32), entries[:, 1].astype(np.int32), np.array(tf, np.float32))
    some = examples.take(np.array([599, 3, 100]))
    assert some.ids.tolist() == [599, 3, 100] and all(set(some.places[some.rows == k]) == set(examples.places[examples.rows == some.ids[k]]) for k in range(3))
    few = some.of_terms(np.unique(some.places))
    assert (few.vocabulary[few.places] == some.vocabulary[some.places]).all()
    assert toxic.chosen_factor(spark, examples) in toxic.FACTORS
    assert toxic.chosen_factor(spark, toxic.Examples(examples.ids, np.zeros(600, np.int64), examples.vocabulary, examples.rows, examples.places, examples.tf)) == 1.0


def test_entries_bound_the_index_by_whole_rows(spark, monkeypatch):
    counted = spark.createDataFrame([(i, 0, list(range(i % 5 + 1)), [1] * (i % 5 + 1)) for i in range(50)], "doc_id long, label int, term array<bigint>, tf array<int>")
    assert toxic.bounded(counted).count() == 50
    monkeypatch.setattr(toxic, "MAX_ENTRIES", 40)
    kept = toxic.bounded(counted).collect()
    assert 30 <= sum(len(r["term"]) for r in kept) <= 40 and all(len(r["term"]) == r["doc_id"] % 5 + 1 for r in kept)


def test_calibrated_scores_rise_with_votes():
    index, *_ = index_of(np.random.default_rng(5), 300, 30)
    at, share = index.steps
    assert (np.diff(at) > 0).all() and (np.diff(share) >= 0).all() and share.min() >= 0 and share.max() <= 1


def test_toxicity_of_texts_without_any_term(spark):
    docs = spark.createDataFrame([(i, f"plain text {i} {'awful' if i % 3 == 0 else ''}") for i in range(1, 90)] + [(100, "nothing known here"), (101, "awful")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1, 90)], "doc_id long, toxic int")
    index = toxic.fit(docs, labels, F.lit(True))
    assert len(index.terms) == 1
    got = {r["doc_id"]: r["score"] for r in toxic.score_toxicity(docs.where("doc_id >= 100").repartition(2, "doc_id"), index).collect()}
    assert got[100] < 0.1 and got[101] > 0.9
    assert toxic.score_toxicity(docs.where("doc_id = 100"), index).first()["evidence"] == []


def test_toxicity_of_odd_rows(spark, odd_documents):
    labels = spark.createDataFrame([(1, 1), (6, 0), (999, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    index = toxic.fit(odd_documents, labels, F.lit(True))
    scored = toxic.score_toxicity(odd_documents, index).collect()
    assert len(scored) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert toxic.fit(odd_documents, labels.limit(0), F.lit(True)) is None
    assert {r["score"] for r in toxic.score_toxicity(odd_documents, None).collect()} == {0.0}
    assert toxic.score_toxicity(odd_documents.limit(0), index).count() == 0


def test_texts_without_telling_terms_have_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 400, 30)) + (" awful" if i % 3 == 0 else "")) for i in range(1, 120)]
    docs = spark.createDataFrame([*rows, (200, rows[9][1] + " unheard"), (201, "w7 w7")], "doc_id long, text string")
    index = toxic.fit(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int"), F.lit(True))
    assert set(index.vocabulary) == {hash_word(w) for _, t in rows for w in t.split()} and hash_word("awful") in index.terms
    got = {r["doc_id"]: r["evidence"] for r in toxic.score_toxicity(docs.where("doc_id >= 200"), index).collect()}
    assert got[200][0] == rows[9][0] and len(got[201]) == toxic.EVIDENCE
    assert all("w7" in rows[i - 1][1].split() for i in got[201])


# --- language model ------------------------------------------------------------------------------------------------


def tokens_of(text):
    return [*[w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w], None]


def lm_query(spark, hot, hot_pairs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", (lm.crc_mod("doc_id", 10) != 0).alias("trained"))
    model = lm.fit(docs.where("trained"), hot)
    return lm.score_texts(docs, model, hot_pairs, "trained"), model


def test_scores_do_not_depend_on_what_is_known_of_the_texts(spark):
    """A text that was trained on has the same score when that is not told, and with filters that hold everything."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").select("doc_id", "text", (F.col("doc_id") < 50).alias("trained"))
    model = lm.fit(docs.where("trained"), 100)
    told = {r["doc_id"]: (r["score"], r["base_score"]) for r in lm.score_texts(docs, model, 50, "trained").collect()}
    plain = {r["doc_id"]: (r["score"], r["base_score"]) for r in lm.score_texts(docs, model, 10).collect()}
    assert len(told) == docs.count() and all(plain[i] == pytest.approx(told[i], rel=1e-9) for i in told)
    assert lm.may_hold(np.full(8, 2**64 - 1, np.uint64), np.arange(5, dtype=np.uint64)).all()


def test_base_scores(spark):
    docs = {r["doc_id"]: tokens_of(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    counts = Counter(t for i, own in docs.items() if not held_out(i, 10, 0) for t in own)
    n, v = counts.total(), len(counts)
    rows = lm.op6_lm_score(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = docs[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(own), sum(t in counts for t in own), n, held_out(r["doc_id"], 10, 0))
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own), abs=1e-6)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


@pytest.mark.parametrize(("hot", "hot_pairs"), [(lm.HOT, lm.HOT_PAIRS), (50, 20)])
def test_scores_are_those_of_the_tables(spark, hot, hot_pairs):
    """Counts are exact, whatever is broadcast; each score is the sum over a text's pairs, worked out pair by pair."""
    scored, model = lm_query(spark, hot, hot_pairs)
    docs = {r["doc_id"]: tokens_of(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    code_of = lambda t: int(model.codes(np.array([lm.END if t is None else hash_word(t)]))[0])
    codes = {t: code_of(t) for t in {t for own in docs.values() for t in own}}
    pairs = Counter((codes[u], codes[w]) for i, own in docs.items() if not held_out(i, 10, 0) for u, w in zip([None, *own[:-1]], own, strict=True))
    got = {(r["u"], r["w"]): (r["n"], r["kept"]) for r in model.multi.collect()} | {(r["u"], r["w"]): (1, [1] * model.samples) for r in model.single.collect()}
    assert {k: n for k, (n, _) in got.items()} == pairs and all(1 <= t <= n for n, kept in got.values() for t in kept)
    table = {r["k"]: r for r in model.table.collect()}
    for side in (0, 1):  # a token is as often a context as it is a token
        assert {k: r["c"] for k, r in table.items()} == Counter(own[side] for own in pairs.elements())

    def chance(u, w):
        total = 0.0
        for k in range(model.samples):
            p = table[w][f"p{k}"] if w in table else model.spare[k]
            total += (table[u][f"b{k}"] if u in table else 1.0) * p
            if (u, w) in got:
                n, kept = got[u, w]
                total += (n - model.discount * kept[k]) * table[u][f"inv{k}"]
        return total / model.samples

    for r in scored.where("doc_id % 7 = 0").collect():
        own = [codes[t] for t in docs[r["doc_id"]]]
        want = sum(math.log10(chance(u, w)) for u, w in zip([codes[None], *own[:-1]], own, strict=True))
        assert r["score"] == pytest.approx(want, rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("hot", [lm.HOT, 2])
def test_predictive_probabilities_sum_to_one(spark, hot):
    """Over all known tokens and one unknown, after every context and after a token that was never seen."""
    train = spark.createDataFrame([("a b a c a b d",), ("b a b a e",), (None,), ("A b",)], "text string")
    model = lm.fit(train, hot)
    assert model.n_tokens == 18 and model.n_known == 6
    words, firsts = ["a", "b", "c", "d", "e", "never"], ("a", "b", "c", "never")
    texts = [f"{first} {w}" for first in firsts for w in words] + [*words, ""]
    pairs = spark.createDataFrame([(t, t) for t in texts], "text string, t string")
    got = {r["t"]: r["score"] for r in lm.score_texts(pairs, model).collect()}
    table = {r["k"]: r for r in model.table.collect()}
    end = int(model.codes(np.array([lm.END]))[0])
    ends = {(r["u"], end): [1] * model.samples for r in model.single.where(F.col("w") == end).collect()} | {(r["u"], end): (r["n"], r["kept"]) for r in model.multi.where(F.col("w") == end).collect()}

    def after(word):
        """P(end | word), from the tables."""
        u, total = int(model.codes(np.array([hash_word(word)]))[0]), 0.0
        for k in range(model.samples):
            total += (table[u][f"b{k}"] if u in table else 1.0) * table[end][f"p{k}"]
            if (u, end) in ends:
                n, kept = ends[u, end] if isinstance(ends[u, end], tuple) else (1, ends[u, end])
                total += (n - model.discount * kept[k]) * table[u][f"inv{k}"]
        return total / model.samples

    for first in firsts:
        start = 10 ** got[first] / after(first)  # P(first | start)
        assert sum(10 ** got[f"{first} {w}"] / start / after(w) for w in words) + after(first) == pytest.approx(1.0, abs=1e-6)


def test_held_out_perplexity(spark):
    """Far below the unigram's, and below that of the model without any context but the parent."""
    scored, model = lm_query(spark, lm.HOT, lm.HOT_PAIRS)
    n, base, own = scored.where(lm.crc_mod("doc_id", 10) == 0).agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
    assert 10 ** (-own / n) < 0.2 * 10 ** (-base / n)


def test_strengths_follow_the_seating():
    """Many tables ask for a larger strength than few, and the auxiliaries' sums are those of plain draws."""
    level = lm.Level(0.5, 2.0)
    customers, tables = np.array([1, 10, 100, 7]), np.array([1, 4, 30, 7])
    rng, log_x, y = np.random.default_rng(1), [], []
    for _ in range(4000):
        log_x.append(np.log(rng.beta(3.0, customers[1:] - 1)).sum())
        y.append(sum((rng.random(t - 1) < 2.0 / (2.0 + 0.5 * np.arange(1, t))).sum() for t in tables[1:]))
    got = np.array([lm.auxiliaries(customers, tables, level, s) for s in range(4000)]).mean(axis=0)
    assert got[0] == pytest.approx(np.mean(log_x), rel=0.03) and got[1] == pytest.approx(np.mean(y), rel=0.02) and got[2] == pytest.approx(np.var(y), rel=0.1)
    few, many = (np.mean([lm.drawn_strength(level, *lm.auxiliaries(np.full(300, 20), np.full(300, t), level, s), s) for s in range(20)]) for t in (2, 15))
    assert few < many and lm.auxiliaries(np.array([1]), np.array([1]), level, 0) == (0.0, 0.0, 0.0)


def test_seats_follow_the_process():
    n, fresh, discount = 4000, 2.0, 0.6
    tables = lm.seat(np.arange(n), np.full(n, 30), np.full(n, fresh), discount, 1)
    rng, want = np.random.default_rng(0), []
    for _ in range(4000):
        t = 1
        for seated in range(1, 30):
            t += rng.random() < fresh / (fresh + seated - discount * t)
        want.append(t)
    assert tables.mean() == pytest.approx(np.mean(want), rel=0.03) and tables.std() == pytest.approx(np.std(want), rel=0.08)
    big = lm.seat(np.arange(5), np.array([0, 1, 10**6, 65, 64]), np.full(5, 3.0), 0.5, 2)
    assert big[0] == 0 and big[1] == 1 and (big <= [0, 1, 10**6, 65, 64]).all()


def test_lm_of_odd_rows(spark, odd_documents):
    model = lm.fit(odd_documents.where("doc_id is not null"))
    rows = lm.score_texts(odd_documents.select("doc_id", "text"), model).collect()
    assert len(rows) == odd_documents.count()
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1} and all(math.isfinite(r["score"]) for r in rows)
    twice = [r["score"] for r in rows if r["doc_id"] == 2]
    assert len(twice) == 2 and twice[0] == pytest.approx(twice[1])
    empty = lm.fit(odd_documents.limit(0))
    rows = lm.score_texts(odd_documents.select("doc_id", "text"), empty).collect()
    assert len(rows) == odd_documents.count() and all(r["n_known"] == 0 for r in rows)
    assert lm.score_texts(odd_documents.limit(0).select("doc_id", "text"), model).count() == 0


def test_pairs_are_told_by_key_and_other():
    """Every pair of frequent and rare tokens is of one kind, comes back whole, and packed runs add up."""
    codes = lm.Codes(np.array([-7, 10**12, 3 * 10**15]), np.array([9, 8, 7]))
    u, w = (x.ravel() for x in np.meshgrid([0, 1, 2, -10**17, 10**18], [0, 1, 2, -10**17, 10**18]))
    seen = []
    for kind, place, key, other in codes.kinds(u, w):
        assert len(place) == {lm.FREQUENT: 9, lm.HALF: 12, lm.RARE: 4}[kind]
        x, y = lm.pair_of(kind, key, np.zeros(len(key), np.int64) if other is None else other, len(codes))
        assert (x == u[place]).all() and (y == w[place]).all()
        seen += place.tolist()
        got = lm.summed(np.tile(key, 3), None if other is None else np.tile(other, 3), None)
        assert len(got[0]) == len(key) and (got[2] == 3).all()
        assert (lm.unpacked_keys(lm.packed_keys(got[0]), len(key)) == got[0]).all()
    assert sorted(seen) == list(range(25))


def test_pairs_are_packed_by_bucket(spark, monkeypatch):
    """A row a bucket and kind, not one a pair; the number of buckets changes no score."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").select("doc_id", "text", (F.col("doc_id") < 50).alias("trained"))
    got = []
    for size in (lm.BUCKET, 1 << 13):
        monkeypatch.setattr(lm, "BUCKET", size)
        model = lm.fit(docs.where("trained"))
        rows, pairs = model.counts.agg(F.count("*"), F.sum("n")).first()
        assert rows <= 6 * model.n_buckets < pairs / 10
        got.append((model.n_buckets, {r["doc_id"]: r["score"] for r in lm.score_texts(docs, model, 50, "trained").collect()}))
    (few, one), (many, other) = got
    assert few < many and len(one) == docs.count() and all(other[i] == pytest.approx(x, rel=1e-9) for i, x in one.items())


def test_counting_holds_little_beyond_its_places(monkeypatch):
    """A task that counts pairs holds a few times the places that it has gathered, and lets go of what it has sorted."""

    class Frame:
        def __getattr__(self, name):
            return lambda *a, **k: tasks.append(a[0]) or self if name.endswith("InArrow") else self

    tasks, rng = [], np.random.default_rng(3)
    monkeypatch.setattr(lm, "RUN", 1_000_000)
    words = np.array([f"w{i}" for i in range(2000)])
    texts = [" ".join(words[rng.integers(0, 2000, 400)]) for _ in range(6000)]
    codes = lm.Codes(np.array([lm.END, *map(hash_word, words)]), np.ones(2001, np.int64))
    lm.counted(Frame(), lambda raw, bounds: codes.kinds(*codes.pairs(raw, bounds)[1:]), 50)
    lm.tokens(*next(lm.slices_of(pa.array(texts[:1])))[2:])  # makes tables that stay
    batches = [pa.record_batch([pa.array(texts[i : i + 500])], names=["text"]) for i in range(0, 6000, 500)]
    tracemalloc.start()
    total = 0
    try:
        for out in tasks[0](iter(batches)):
            for r in out.to_pylist():
                total += int(lm.unpacked(r["counts"], r["n"], np.uint32).sum())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert total == 6000 * 401
    assert peak < 40 * lm.RUN  # 8 are the places themselves


def test_blocks_below_the_floor_are_skipped(monkeypatch):
    """Copies of a few texts, with terms that all share: the K nearest are exact, and most of the frequent lists is not looked at."""
    monkeypatch.setattr(toxic, "LEAD", 20)
    rng = np.random.default_rng(5)
    kinds = [np.unique(np.concatenate([np.arange(70), 70 + rng.integers(0, 400, 30)])) for _ in range(40)]
    own = [kinds[i % 40] for i in range(1200)]
    rows, places = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own)
    tf = rng.integers(1, 9, len(rows)).astype(float)
    index = toxic.BlockMaxIndex(np.arange(470), np.concatenate([np.full(70, 0.3), np.full(400, 3.0)]), np.arange(1200) * 2, rng.integers(0, 2, 1200), rows, places, tf, (1, 20))
    vectors = np.zeros((1200, 470))
    vectors[rows, places] = index.own_weight
    for k in range(0, 1200, 37):
        span = slice(index.own[k], index.own[k + 1])
        best, score = index.nearest(places[span], index.own_weight[span].astype(float))
        every = vectors @ vectors[k]
        want = sorted(np.flatnonzero(every > 0), key=lambda e: (-round(every[e], 12), e))[: toxic.K]
        assert best.tolist() == want and score == pytest.approx(every[want])
    assert 0 < index.looked[0] < index.looked[1] / 2
    assert sorted(toxic.alike(vectors, np.arange(1195))) == list(range(1195))
