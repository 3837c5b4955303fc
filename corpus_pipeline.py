"""A training-corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

1. language ID: documents whose language can't be told (``und``: no text, no letters) go;
2. MinHash near-dedup: of each class of near-duplicates the document with the least id stays;
3. secret scans: secrets are replaced by their kind in brackets, and ``n_chars`` follows; no document goes;
4. mixing sources to target weights: documents are repeated or left out so that sources come near their targets;
5. best-fit packing: pieces of at most 2048 tokens are placed in sequences.

All stages but the last return the columns of ``documents``. Rows without an id: the language stage keeps them if their
language can be told, near-dedup keeps each of them, and the later stages treat them as documents of their own. Rows that
share an id are told apart by their text, so none is lost to another's id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import crc_mod, free_name, materialise, read
from wattloom.llm.op1_minhash import deduplicate
from wattloom.llm.op5_secrets import redact
from wattloom.llm.op8_language import UNKNOWN, identify, training_sample
from wattloom.llm.op9_pack import pack
from wattloom.llm.op10_mix import apply_mix

#: Rows that go to a Python task at once. Texts are long, and two tasks of an executor hold such batches.
BATCH_ROWS = 2_000
#: Words that the packing stage remembers; its tasks' processes also hold what the other stages needed.
REMEMBERED = 200_000


def _bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bound_batches(spark)
    sample = training_sample(docs, F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(False)))
    pred, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    return identify(docs, sample, names=(pred, score)).where(F.col(pred) != UNKNOWN).drop(pred, score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bound_batches(spark)
    return deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bound_batches(spark)
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply_mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bound_batches(spark)
    return pack(docs, remembered=REMEMBERED)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: Language identification, near-dedup and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the session's batch size is what it was afterwards."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        docs = read(spark, sf_dir, "documents")
        for _, stage in STAGES[:-1]:
            docs = materialise(stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
