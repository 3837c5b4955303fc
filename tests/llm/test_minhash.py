"""BagMinHash near-dedup against all pairs by exact weighted Jaccard."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from wattloom.llm.components import connected_components
from wattloom.llm.op1_minhash import bag_minhash, deduplicate, linked_in_tile, near_duplicates

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def bag(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or Counter([tuple(words)] if words else [])


def jaccard(a, b):
    both = (a & b).total()
    return both / (a.total() + b.total() - both) if a or b else 0.0


def brute(docs, least=0.8):
    bags = {i: bag(t) for i, t in docs}
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in bags if bags[i])
    holders = {}
    for i in ids:
        for s in bags[i]:
            holders.setdefault(s, []).append(i)
    pairs = {(a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1 :]}
    for a, b in pairs:
        if jaccard(bags[a], bags[b]) >= least:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in bags}


def test_documents_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()}
    assert got == want


def test_large_bucket_of_near_copies_around_the_threshold(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(len(words))] = f"x{i}_{rng.random()}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(df).collect()}
    assert got == brute(docs)


def test_signature_agreement_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    row = np.repeat([0, 1], 300)
    sig = bag_minhash(row, np.concatenate([keys, keys]), np.concatenate([a, b]), 2, 4000)
    assert np.mean(sig[0] == sig[1]) == pytest.approx(true, abs=0.035)


def test_signature_is_that_of_each_row_alone():
    keys = np.arange(1, 41, dtype=np.uint64) * np.uint64(977)
    counts = np.arange(40) % 5 + 1
    both = bag_minhash(np.repeat([0, 1], 20), keys, counts, 2, 50)
    assert (both[1] == bag_minhash(np.zeros(20, int), keys[20:], counts[20:], 1, 50)[0]).all()


def test_tile_links():
    ids, classes, sizes = np.array([5, 3, 9]), np.array([0, 1, 2]), np.array([4, 4, 4])
    a, b = linked_in_tile(ids, classes, sizes, np.array([1, 2, 3, 4, 1, 2, 3, 4, 7, 8, 9, 1]), 0.8)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(5, 3)}
    rng = np.random.default_rng(2)
    bags = [np.unique(np.where(rng.random(60) < 0.12, rng.integers(0, 5000, 60), np.arange(60) + 100 * (i % 2))) for i in range(90)]
    a, b = linked_in_tile(np.arange(90), np.arange(90), np.array([len(x) for x in bags]), np.concatenate(bags), 0.8)
    label = np.arange(90)
    label[b] = a
    parent = np.arange(90)
    for i in range(90):
        for j in range(i):
            both = len(np.intersect1d(bags[i], bags[j]))
            if both >= 0.8 * (len(bags[i]) + len(bags[j]) - both):
                parent[parent == max(parent[i], parent[j])] = min(parent[i], parent[j])
    assert (label == parent).all() and 2 < len(set(parent.tolist())) < 90
    assert len(linked_in_tile(ids, np.zeros(3, int), sizes, np.arange(12) % 4, 0.8)[0]) == 0


def test_odd_rows(spark, odd_documents):
    got = sorted(map(tuple, near_duplicates(odd_documents).collect()), key=str)
    assert len(got) == odd_documents.count() and [(c, k) for i, c, k in got if i is None] == [(None, True)] * 2
    ids = {i: c for i, c, _ in got if i is not None}
    assert {i for i, _, k in got if not k} == {2, 7}
    assert ids == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9, 10: 10}
    kept = deduplicate(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "10", "3", "4", "5", "6", "8", "9", "None", "None"]
    assert near_duplicates(odd_documents.limit(0)).count() == 0


def test_no_text_is_lost_to_a_shared_id(spark):
    """Rows of one id and different texts are different documents; helper names may be taken by columns."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (5, a), (5, b), (5, b), (7, a + " end"), (7, None), (7, None), (7, b.upper())]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, t long, h long, row string")
    assert sorted((r["doc_id"], r["text"]) for r in deduplicate(docs).where("text is not null").collect()) == [(1, a), (5, b)]
    assert deduplicate(docs).where("text is null").count() == 2 and deduplicate(docs).columns == docs.columns
    got = Counter(map(tuple, near_duplicates(docs).collect()))
    assert got == Counter({(1, 1, True): 1, (5, 1, False): 1, (5, 5, True): 2, (7, 1, False): 1, (7, 7, True): 2, (7, 5, False): 1})


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), 90: 90, 95: 90, 100: 90}
