"""What has landed: files that cannot be read are told and left out, and rows are counted as jobs read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wattloom.functions.names import col


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").parquet(path)


def landed_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, n_rows and good of each Parquet file; a file is good if all rows that its footer declares can be read.

    Files without a footer have null rows. All columns are read, so a broken page is found wherever it is.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    rows, at = _rows(spark, path), F.col("_metadata.file_path").alias("file")
    declared = rows.select(at).groupBy("file").agg(F.count("*").alias("declared"))
    read = rows.select(at, F.xxhash64(*[F.to_json(F.struct(*[col(c) for c in rows.columns]))]).alias("h")).groupBy("file").agg(F.count("*").alias("n_rows"), F.bit_xor("h").alias("hash"))
    plain = F.regexp_replace  # file:/x and file:///x are one path
    same = plain(F.col("path"), "^file:/+", "/") == plain(F.col("file"), "^file:/+", "/")
    counts = declared.join(read, "file", "left")
    good = F.coalesce((F.col("n_rows") == F.col("declared")) & F.col("hash").isNotNull(), F.lit(False))  # the hash makes Spark read the columns
    return files.join(counts, same, "left").select("path", "length", "n_rows", good.alias("good"))


def good_rows(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """The rows of the good files."""
    files = landed_files(spark, path) if files is None else files
    rows = _rows(spark, path)
    key = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    kept = files.where("good").select(F.regexp_replace("path", "^file:/+", "/").alias("__file"))
    return rows.withColumn("__file", key).join(kept, "__file", "left_semi").drop("__file")


def counted(rows: DataFrame, id_column: str = "bldg_id") -> tuple[DataFrame, Observation]:
    """``rows``, and counts of them that the first job to read all of them leaves: n_read, n_without_id and n_buildings (about)."""
    seen = Observation()
    counts = [F.count("*").alias("n_read"), F.count_if(col(id_column).isNull()).alias("n_without_id"), F.approx_count_distinct(col(id_column)).alias("n_buildings")]
    return rows.observe(seen, *counts), seen
