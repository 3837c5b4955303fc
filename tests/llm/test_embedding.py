"""Embedding near-dedup and neighbour search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.llm import op2_embedding as dedup
from wattloom.llm import op4_ann as ann

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_links(rows):
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: 0 for i, *_ in rows if i is not None}
    parent = {i: i for i in links}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, v, a) in enumerate(good):
        for j, w, b in good[k + 1 :]:
            if a == b and len(v) == len(w) and v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w)) >= 0.98:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return links, {i: find(i) for i in parent}


def clusters(n, seed, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 5, dim))
    return [(i, [float(np.float32(x)) for x in centres[i % len(centres)] + rng.standard_normal(dim) * 0.08 * (i % 3)], int(i % len(centres)) % 3) for i in range(n)]


@pytest.mark.parametrize("cell", [4096, 40])
def test_links(spark, monkeypatch, cell):
    monkeypatch.setattr(dedup, "CELL", cell)
    monkeypatch.setattr(dedup, "BLOCK", 32)
    rows = [*clusters(300, 1), (900, None, 1), (901, [0.0] * 16, 1), (902, [None, *[1.0] * 15], 1), (903, [float("nan")] * 16, 1), (904, [1.0] * 16, None), (905, [1.0] * 8, 1), (906, [2.0] * 8, 1), (907, [], 1)]
    links, parts = brute_links(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (links[i], parts[i]) for i in links}


def test_many_labels_share_few_pivots(spark, monkeypatch):
    monkeypatch.setattr(dedup, "CELL", 4)
    monkeypatch.setattr(dedup, "MAX_PIVOTS", 6)
    rng = np.random.default_rng(8)
    rows = []
    for label in range(30):
        centre = rng.standard_normal(8)
        rows += [(label * 100 + k, (centre + 0.05 * rng.standard_normal(8)).tolist() if k < 6 else rng.standard_normal(8).tolist(), label) for k in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    points = df.select(F.col("vec_id").alias("point"), "label", F.lit(8).alias("dim"), F.col("embedding").alias("v"))
    cells, _ = dedup.to_cells(points)
    assert cells.count() == len(rows) and cells.select("cell").distinct().count() <= 30 + 2 * 6
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in dedup.near_duplicates(df).collect()}
    v = {i: np.array(x) / np.linalg.norm(x) for i, x, _ in rows}
    for i, _, label in rows:
        near = [j for j, _, other in rows if other == label and j != i and v[i] @ v[j] >= 0.98]
        assert got[i][0] == len(near)


def test_cosines_of_very_large_and_small_vectors():
    a, b = np.array([[1e200, 1e198], [3e-200, 0.0], [1.0, 2.0]]), np.array([[1e200, 0.0], [4e-200, 1e-210], [2.0, 4.0]])
    assert dedup.cosine(a, b) == pytest.approx([1 / math.sqrt(1.0001), 1.0, 1.0], rel=1e-12)


def test_embeddings_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    links, parts = brute_links([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in dedup.near_duplicates(df).collect()}
    assert got == {i: (links[i], parts[i]) for i in links}


def test_repeated_rows_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1)], SCHEMA)
    assert sorted(map(tuple, dedup.near_duplicates(df).collect())) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [3, 24, 64, 130])
def test_codes_decide_as_the_exact_product_does(dim):
    """No pair at 0.98 or above is dropped by bits or estimates, which are unbiased, and few others are computed."""
    rng = np.random.default_rng(dim)
    a = rng.standard_normal((300, dim))
    b = np.concatenate([a[:150] + rng.standard_normal((150, dim)) * 0.2 * np.abs(a[:150]).mean(), rng.standard_normal((200, dim))])
    left, right = ((v, *dedup.encode(v)) for v in (a, b))
    true = dedup.unit_rows(a) @ dedup.unit_rows(b).T
    i, j, n = dedup.links_between(left, right, False, 0.98)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*np.nonzero(true >= 0.98), strict=True)) and len(i) > 20
    assert n <= (true >= 0.98).sum() + true.size * (0.3 if dim < 10 else 0.01)
    bits = np.unpackbits(left[1], axis=1, count=dim)[:, None, :] != np.unpackbits(right[1], axis=1, count=dim)[None, :, :]
    assert (dedup.differing_bits(left[1], right[1]) == bits.sum(axis=2)).all()
    x, y = (k.ravel() for k in np.indices(true.shape))
    turned = dedup.unit_rows(b) @ dedup.rotation(dim).T
    off = dedup.estimates(dedup.signs_of(left[1], dim)[x], left[2][x], turned[y]).reshape(true.shape) - true
    assert abs(off.mean()) < 0.02
    above = true >= 0.98
    assert ((off + true)[above] >= np.broadcast_to(dedup.least_estimate(left[2], dim, 0.98)[:, None], true.shape)[above]).all()


def exact(rows, k=10):
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        order = [o for o in np.lexsort((ids, d)) if ids[o] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[o]), d[o]) for o in order]
    return out


def search(df):
    out = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("block", [512, 40])
def test_recall(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    monkeypatch.setattr(ann, "CHUNK", 4)
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(32).astype("float32").tolist(), 0) for i in range(3000)]
    want, got = exact(rows), search(spark.createDataFrame(rows, SCHEMA))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    true = {(q, i): d for q, own in exact(rows, 3000).items() for i, d in own}
    assert all(s == pytest.approx(true[q, i], abs=1e-12) for q, own in got.items() for i, s in own)


def test_recall_of_queries_that_lie_elsewhere_than_most_rows(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((150, 32))
    rows = [(i, (centres[i % 150] + 0.02 * rng.standard_normal(32) if i % 100 else rng.standard_normal(32)).astype("float32").tolist(), 0) for i in range(1, 3001)]
    want, got = exact(rows), search(spark.createDataFrame(rows, SCHEMA))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_repeated_query_rows_are_one_query(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(8).astype("float32").tolist(), 0) for i in range(1, 60)] + [(100, [1.0] * 8, 0)] * 2 + [(100, [-1.0] * 8, 0)] + [(7, [1.0] * 8, 0)] * 2
    got = search(spark.createDataFrame(rows, SCHEMA))[100]
    others = [(i, min(np.linalg.norm(np.array(v) - q) for q in (np.ones(8), -np.ones(8)))) for i, v, _ in rows if i != 100]
    want = sorted(others, key=lambda x: (x[1], x[0]))[:10]
    assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want])


def test_ties_few_candidates_and_odd_vectors(spark):
    rows = [(100 * i, [1.0, 2.0, 3.0], None) for i in range(1, 4)] + [(7, [1.0, 2.0, 4.0], 1), (8, None, 1), (9, [0.0] * 3, 1), (10, [1.0, None, 2.0], 1), (11, [float("inf")] * 3, 1), (12, [1.0], 1)]
    got = search(spark.createDataFrame(rows, SCHEMA))
    assert got == {100: [(200, 0.0), (300, 0.0), (7, 1.0)], 200: [(100, 0.0), (300, 0.0), (7, 1.0)], 300: [(100, 0.0), (200, 0.0), (7, 1.0)]}
    assert search(spark.createDataFrame(rows[4:6], SCHEMA)) == {} and search(spark.createDataFrame([(100, [1.0], 1)], SCHEMA)) == {}
