"""Data-quality checks as aggregates of one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.errors import InvalidIds, NullInputs
from wattloom.functions.names import col


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: the nulls of each column, and of all."""
    columns = columns or df.columns
    each = [F.coalesce(F.sum(col(c).isNull().cast("long")), F.lit(0)).alias(c) for c in columns]
    total = sum((F.coalesce(F.sum(col(c).isNull().cast("long")), F.lit(0)) for c in columns), F.lit(0))
    return df.agg(*each, total.alias("all_nulls"))


def require_no_nulls(df: DataFrame, columns: list[str], id_column: str = "bldg_id", show: int = 10) -> DataFrame:
    bad = df.where(F.greatest(*[col(c).isNull() for c in columns], F.lit(False))).select(id_column).limit(show).collect()
    if bad:
        raise NullInputs(columns=columns, ids=[r[0] for r in bad])
    return df


def drop_nulls(df: DataFrame, columns: list[str]) -> tuple[DataFrame, Column]:
    """Rows without nulls in the columns, and an aggregate over ``df`` that counts the others."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & col(c).isNotNull()
    return df.where(whole), F.sum((~whole).cast("long"))


def valid_ids(df: DataFrame, column: str = "bldg_id", most_null: float = 0.5) -> DataFrame:
    """Rows with a whole-number id; too many others are an error."""
    number = F.expr(f"try_cast(`{column}` as bigint)")
    rows, nulls = df.agg(F.count("*"), F.count_if(number.isNull())).first()
    if rows and (nulls == rows or nulls > most_null * rows):
        raise InvalidIds(column=column, nulls=nulls, rows=rows)
    return df.withColumn(column, number).where(col(column).isNotNull())


def id_validity(df: DataFrame, column: str, most_null: float = 0.5) -> DataFrame:
    """One row: rows, nulls, and whether the column may serve as an id."""
    nulls = F.count_if(col(column).isNull())
    return df.agg(F.count("*").alias("n_rows"), nulls.alias("n_null"), ((nulls <= most_null * F.count("*")) & (nulls < F.count("*"))).alias("valid"))


def is_unique(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(col(column)).alias("n_distinct"), (F.countDistinct(col(column)) == F.count("*")).alias("is_unique"))


def in_every_group(df: DataFrame, value: str, group: str) -> DataFrame:
    """Values that occur in each of the groups there are."""
    pairs = df.select(value, group).distinct()
    n = pairs.select(group).distinct().agg(F.count("*").alias("n"))
    by = pairs.groupBy(value).agg(F.count("*").alias("k"))
    return by.join(F.broadcast(n), F.col("k") == F.col("n")).select(value)  # n is one row


def profile(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Count, sum, mean, least and greatest of a measure by group, and the group's share of the whole sum."""
    c = col(column)
    out = df.groupBy(*by).agg(F.count(c).alias("n"), F.sum(c).alias("total"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("greatest"))
    whole = df.agg(F.sum(c).alias("__whole"))
    return out.join(F.broadcast(whole)).withColumn("share", F.col("total") / F.col("__whole")).drop("__whole")  # one row


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows by actual and predicted value, with the share of each actual value."""
    by = df.groupBy(col(actual).alias("actual"), col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    totals = df.groupBy(col(actual).alias("actual")).agg(F.count("*").alias("__n"))
    return by.join(totals, "actual").select("actual", "predicted", "n", (F.col("n") / F.col("__n")).alias("recall"))


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((col(actual) == col(predicted)).cast("double")).alias("accuracy"))
