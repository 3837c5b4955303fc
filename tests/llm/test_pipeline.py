"""The corpus pipeline: every stage against a brute-force version of its own on the same input."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402
from test_minhash import brute as classes_of  # noqa: E402
from test_mix import targets  # noqa: E402
from test_pack import check as check_pieces  # noqa: E402
from test_secrets import brute as spans_of  # noqa: E402

from wattloom.llm.common import materialise  # noqa: E402
from wattloom.llm.op10_mix import count_words  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs, before = materialise(stage(spark, docs, SF)), docs
        out.append((name, before, docs))
    return out


def rows_of(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_names_and_columns(stages):
    assert [s[0] for s in stages] == ["language_id", "near_dedup", "secret_scan", "source_mix", "best_fit_packing"]
    assert all(after.columns == before.columns for _, before, after in stages[:-1])


def test_language_stage_drops_what_has_no_language(stages):
    before, after = rows_of(stages[0][1]), rows_of(stages[0][2])
    assert all(before[i] == r for i, r in after.items())
    gone = [before[i]["text"] or "" for i in before.keys() - after.keys()]
    assert len(gone) < 0.01 * len(before) and all(len(t) < 40 or not any(c.isalpha() for c in t) for t in gone)


def test_short_texts_of_any_language_stay(spark):
    """A text that is as likely in six languages scores a sixth; only what has no letters goes."""
    own = "the old mill by the river turns slowly all day long"
    rows = [(i, own, f"l{i % 6}") for i in range(60)] + [(100, "This.", "l1"), (101, "A.", None), (102, "12 34", "l1"), (103, None, "l1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()} == {*range(60), 100, 101}


def test_columns_named_as_results_stay(spark):
    rows = [(i, "the quick brown fox jumps over the lazy dog and runs along the river", "en", "KEEP", 7.5) for i in range(4)] + [(9, "!!", "en", "GONE", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, Lang_pred string, lang_score double")
    out = corpus_pipeline.language_id(spark, docs, SF)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(rows[:4])


def test_one_of_each_class_stays(stages):
    before, after = rows_of(stages[1][1]), rows_of(stages[1][2])
    classes = classes_of([(i, r["text"]) for i, r in before.items()])
    assert set(after) == {i for i, c in classes.items() if i == c} and stages[1][2].count() == len(after)
    assert all(after[i] == before[i] for i in after)


def test_secrets_are_replaced(stages):
    before, after = rows_of(stages[2][1]), rows_of(stages[2][2])
    assert set(before) == set(after)
    hits = 0
    for i, r in before.items():
        text, done, out = r["text"], 0, ""
        for kind, start, end in spans_of(text.encode()):
            if end > done:
                out += text[done:start] + f"[{kind}]" if start >= done else ""
                done = end
                hits += 1
        assert after[i] == r | {"text": out + text[done:], "n_chars": len(out + text[done:])}
    assert hits > 10


def test_mix_comes_near_its_targets(stages):
    _, before, after = stages[3]
    words = lambda df: {r["source"]: r["w"] for r in df.withColumn("w", count_words(df["text"])).groupBy("source").agg(F.sum("w").alias("w")).collect()}
    total, got = words(before), words(after)
    want = targets(total)
    longest = before.selectExpr("max(n_chars)").first()[0]
    assert all(abs(got.get(s, 0) - t) <= longest for s, t in want.items())
    assert max(r["count"] for r in after.groupBy("doc_id").count().collect()) <= 2


def test_pieces_fill_sequences(stages):
    _, before, after = stages[4]
    used, least = check_pieces(after.collect(), [(r["doc_id"], r["text"]) for r in before.collect()])
    assert used <= least + 1


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[4][2].count() and corpus_pipeline.ORACLE_SQL is None


def test_empty_table_and_odd_rows(spark, odd_documents):
    for docs in (odd_documents.limit(0), odd_documents):
        docs = docs.drop("score")
        for _, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, SF))
        assert docs.columns[0] == "doc_id"
