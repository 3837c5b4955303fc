"""Hard negatives against brute force in Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.llm import op11_negatives as op

SCHEMA = "vec_id long, embedding array<double>, label int, score double, anchor_id long"


def label():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def brute_force(rows, positives=5, negatives=3):
    use = []
    for id_, v, lab in rows:
        if id_ is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        lab = int(math.fmod(lab + 1, 10)) if id_ % 7 == 0 else lab
        use.append((id_, lab, tuple(int(x) * 256 if abs(x) > 2.0**60 else math.floor(256 * x) for x in v)))
    out = []
    for id_, lab, v in {u for u in use if u[0] % 50 == 0}:
        met = [(-sum(a * b for a, b in zip(v, w, strict=True)), other, own == lab) for other, own, w in use if other != id_ and len(w) == len(v)]
        for p, pid, _ in sorted(m for m in met if m[2])[:positives]:
            window = sorted(m[:2] for m in met if not m[2] and 50 * -p <= 100 * -m[0] <= 95 * -p)
            out += [(id_, pid, rank, nid, -p, -n) for rank, (n, nid) in enumerate(window[:negatives], 1)]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], SCHEMA)
    return sorted(map(tuple, op.hard_negatives(df, F.col("vec_id") % 50 == 0, label(), **options).collect()))


def some_rows(n=400, dim=8, seed=3, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((3, dim))
    return [(int(i), (spread * (centres[i % 3] + 0.4 * rng.standard_normal(dim))).tolist(), int(rng.integers(0, 4))) for i in range(n)]


def test_equals_brute_force(spark):
    rows = some_rows()
    expected = brute_force(rows)
    assert len(expected) > 60
    assert found(spark, rows) == expected


def test_rounds_of_few_anchors_give_the_same(spark):
    rows = some_rows()
    assert found(spark, rows, round_bytes=300) == brute_force(rows)


def test_ties_repeats_and_odd_rows(spark):
    same = [1.0, 0.5, -0.25]
    rows = [(i, same, i % 2) for i in range(0, 240)]  # all scores tie
    rows += [(i, [0.6, 0.3, -0.1], 1) for i in range(240, 260)] + [(100, same, 0), (100, same, 0), (150, [0.9, 0.4, 0.0], 1)]
    rows += [(None, same, 1), (300, None, 1), (350, same, None), (400, [1.0, None, 0.0], 1), (450, [float("nan"), 1.0, 0.0], 0), (500, [float("inf"), 1.0, 0.0], 0)]
    rows += [(550, [], 1), (551, [], 1), (552, [], 2), (600, [1.0, 2.0], 3), (601, [2.0, 1.0], 3), (602, [1.0, 1.0], 4), (650, [0.0, 0.0, 0.0], 7)]
    assert found(spark, rows) == brute_force(rows)
    assert any(r[0] == 550 and r[3] == 552 for r in found(spark, rows))  # empty vectors score 0, and 0 is in the window of 0


def test_scores_beyond_float64_are_exact(spark):
    rows = some_rows(120, dim=4, spread=3e5)
    assert max(abs(r[4]) for r in brute_force(rows)) > 2**53
    assert found(spark, rows) == brute_force(rows)


def test_a_score_beyond_a_long_is_an_error(spark):
    with pytest.raises(Exception, match="does not fit a long"):
        found(spark, [(50, [1e300, 1.0], 1), (51, [1e300, 1.0], 1), (52, [1e299, 1.0], 3)])


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1)]) == []


def test_tops_merge_as_one():
    rng = np.random.default_rng(0)
    key, ids, score = rng.integers(0, 5, 500), rng.permutation(500), rng.integers(0, 9, 500)
    whole, parts = op.Tops(3), op.Tops(3)
    whole.add(key, ids, score)
    for k in range(0, 500, 70):
        part = op.Tops(3)
        part.add(key[k : k + 70], ids[k : k + 70], score[k : k + 70])
        parts.add(*part.merged())
    assert all((a == b).all() for a, b in zip(whole.merged(), parts.merged(), strict=True))


@pytest.mark.parametrize("score", [0, 1, 2, 7, 101, -3, 2**62])
def test_window_bounds(score):
    lo, hi = (int(x[0]) for x in op.window_bounds(np.array([score])))
    assert 50 * score <= 100 * lo and 100 * (lo - 1) < 50 * score
    assert 100 * hi <= 95 * score and 100 * (hi + 1) > 95 * score
