"""Source mixing: targets, conservation, expectation and repeatability."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from wattloom.llm import op10_mix as op

SF = "/root/testdata/sf0.01"


def targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    """Hands the excess over, again and again, as the words say."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    open_, left, out = set(order), share * sum(sizes.values()), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total >= most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 5, None: 300}, {"a": 7}, {"a": 0, "b": 4}, {"é": 50, "z": 60, "Z": 70, "": 80}])
def test_targets(spark, sizes):
    rows = [(s, n) for s, total in sizes.items() for n in ([total] if total < 2 else [total - 1, 1])]
    got = {r["source"]: r["target"] for r in op.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert got == pytest.approx(targets(sizes))


def test_documents_table(spark):
    got = op.op10_source_mix(spark, SF).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    by = collections.defaultdict(list)
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]]["text"] or ""))
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        by[docs[r["doc_id"]]["source"]].append(r)
    want = targets({s: sum(r["size"] for r in rows) for s, rows in by.items()})
    for s, rows in by.items():
        assert rows[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in rows) - want[s]) <= max(r["size"] for r in rows)
    assert sorted(map(tuple, got)) == sorted(map(tuple, op.op10_source_mix(spark, SF).collect()))


def test_rounding_keeps_expectations_and_sums(spark):
    """Over many seeds each document is taken about as often as its fraction says."""
    docs = spark.createDataFrame([("s", " ".join(["w"] * (3 + i % 5)), i) for i in range(90)] + [("t", "w " * 400, 1000)], "source string, text string, doc_id long")
    taken = collections.Counter()
    rate = None
    for seed in range(24):
        rows = op.mix_sources(docs, weights=(1.0, 3.0), share=0.9, seed=seed).where("source = 's'").collect()
        rate = rows[0]["target"] / rows[0]["source_size"]
        assert abs(sum(r["copies"] * r["size"] for r in rows) - rows[0]["target"]) <= 7
        taken.update({r["doc_id"]: r["copies"] for r in rows})
    mean = [taken[i] / 24 for i in range(90)]
    assert sum(mean) / 90 == pytest.approx(rate, abs=0.03)
    assert max(abs(m - rate) for m in mean) < 0.45


def test_apply_repeats_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = {(r["doc_id"]): r["copies"] for r in op.mix_sources(docs).collect()}
    out = op.apply_mix(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in copies.items() if n}


def test_repeated_ids_and_clashing_names(spark):
    """Rows of one id with different texts are not mixed up, equal rows share their copies, and no helper name is taken."""
    names = ["rows", "key", "__row", "k", "n", "total", "part", "row", "hash", "size", "copies", "doc", "times", "copy"]
    rows = [(1, "s", f"a {i} " * 3, *[i] * len(names)) for i in range(40)] + [(1, "s", "same text here", *[0] * len(names))] * 30 + [(None, "s", "no id", *[0] * len(names))] * 30
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, " + ", ".join(f"`{n}` long" for n in names)).repartition(3)
    mixed = op.mix_sources(docs.select("doc_id", "source", "text"))
    assert mixed.groupBy("doc_id", "hash", "row").count().where("count > 1").count() == 0 and mixed.count() == 100
    out = op.apply_mix(docs)
    assert out.columns == docs.columns
    got = collections.Counter(r["text"] for r in out.collect())
    assert got["same text here"] in range(30, 61) and got["no id"] in range(30, 61)  # 1.5 times 30, each row once or twice
    assert all(got[f"a {i} " * 3] in (1, 2) for i in range(40))
    size = {t: len(t.split()) for t in got}
    assert abs(sum(size[t] * n for t, n in got.items()) - 1.5 * sum(len(r[2].split()) for r in rows)) <= 6


def test_odd_rows(spark, odd_documents):
    rows = op.mix_sources(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert {r["size"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    out = op.apply_mix(odd_documents)
    assert out.columns == odd_documents.columns and out.count() == sum(r["copies"] for r in rows)
    assert op.mix_sources(odd_documents.limit(0)).count() == 0 and op.apply_mix(odd_documents.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = op.mix_sources(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert op.count_words(F.lit("a \t b c\n")) is not None
