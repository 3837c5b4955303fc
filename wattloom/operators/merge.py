"""Merges, duplicates and replacing tables that are being read."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.functions.names import col, quoted
from wattloom.sources.table import Files, Table, merged_rows, write_partitioned

__all__ = ["exists", "keep_first", "least_per_group", "merge_distinct", "merge_partitions", "replace_path", "union_relaxed", "upsert_old_wins", "write_partitioned"]


def union_relaxed(*frames: DataFrame) -> DataFrame:
    """Rows of all, by column name; types widen to one that holds both. The same columns are required."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def merge_distinct(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both, equal ones once."""
    return old.unionByName(new).distinct()


def keep_first(df: DataFrame, keys: tuple[str, ...], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which should be total."""
    w = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert_old_wins(old: DataFrame, new: DataFrame, keys: tuple[str, ...], order: list[Column]) -> DataFrame:
    """Rows of ``old`` and those of ``new`` with other keys; among several, the first in order."""
    both = old.withColumn("__p", F.lit(0)).unionByName(new.withColumn("__p", F.lit(1)))
    return keep_first(both, keys, [F.col("__p"), *order]).drop("__p")


def least_per_group(df: DataFrame, group: tuple[str, ...], value: str) -> DataFrame:
    return df.groupBy(*[quoted(g) for g in group]).agg(F.min(col(value)).alias(value))


def exists(spark: SparkSession, path: str) -> bool:
    return Files(spark, path).exists()


def replace_path(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Overwrites a table that ``df`` may be reading, in one step: readers of its log see the old rows or the new ones."""
    Table(df.sparkSession, path, partition_by).replace(df)


def merge_partitions(new: DataFrame, path: str, partition_by: tuple[str, ...], pads: Mapping[str, int] | None = None, order: tuple[str, ...] = (), mark: tuple[str, int] | None = None) -> bool:
    """Adds rows to a partitioned table, equal ones once. Only the partitions that ``new`` has rows of are read and
    rewritten; columns may differ between partitions. ``Table`` says how partition values are compared, and what a mark is."""
    return Table(new.sparkSession, path, partition_by, pads, order).merge(new, merged_rows, mark)
