"""Roll-ups of interval-ending time series by a rule a column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.errors import UnknownAggregation, UnruledColumns
from wattloom.functions.energy import UNITS, bucket, bucket_text, calendar_parts, interval_start
from wattloom.functions.names import col, quoted

RULES = ("sum", "mean", "first")


def load_rules(spark: SparkSession, path: str) -> dict[str, str]:
    """name to rule from a CSV of a few hundred rows; the time stamp needs none."""
    rows = spark.read.option("header", "true").csv(path).collect()
    return check_rules({r[0]: r[1] for r in rows if r[0] != "timestamp"})


def check_rules(rules: Mapping[str, str]) -> dict[str, str]:
    if bad := sorted({r for r in rules.values() if r not in RULES}):
        raise UnknownAggregation(names=bad)
    return dict(rules)


def rule_column(name: str, rule: str, order: Column) -> Column:
    """sum: nulls count as 0, also where all are null; mean: without nulls; first: of the earliest row, null or not."""
    c = col(name)
    if rule == "sum":
        out = F.coalesce(F.sum(c), F.lit(0).cast("double"))
    elif rule == "mean":
        out = F.avg(c)
    else:
        out = F.min_by(c, order)
    return out.alias(name)


def aggregate(df: DataFrame, rules: Mapping[str, str], step: str, keys: tuple[str, ...] = ("bldg_id",), ts: str = "timestamp", tie: tuple[str, ...] = (), parts: bool = True) -> DataFrame:
    """One row a key and bucket, stamped with the bucket's start, and calendar parts as fine as the step.

    One hash aggregation with map-side partials; ``tie`` orders rows of the same stamp for ``first``.
    Columns without a rule are an error, as a roll-up would lose them unseen.
    """
    if missing := [c for c in df.columns if c not in rules and c not in (ts, *keys, *tie, "state", "upgrade")]:
        raise UnruledColumns(columns=missing)
    order = F.struct(col(ts), *[col(c) for c in tie])
    grouped = df.withColumn("__bucket", bucket(col(ts), step)).groupBy(*[quoted(k) for k in keys], "__bucket")
    out = grouped.agg(*[rule_column(n, r, order) for n, r in check_rules(rules).items() if n in df.columns and n not in keys])
    out = out.withColumnRenamed("__bucket", ts)
    return out.withColumns(calendar_parts(col(ts), step)) if parts else out


def aggregate_by_text(df: DataFrame, rules: Mapping[str, str], step: str, keys: tuple[str, ...] = ("bldg_id",), ts: str = "timestamp", tie: tuple[str, ...] = ()) -> DataFrame:
    """The older labelling: buckets by text, stamped with the first shifted reading in them."""
    order = F.struct(col(ts), *[col(c) for c in tie])
    grouped = df.withColumn("__bucket", bucket_text(col(ts), step)).groupBy(*[quoted(k) for k in keys], "__bucket")
    rolled = [rule_column(n, r, order) for n, r in check_rules(rules).items() if n in df.columns and n not in keys]
    return grouped.agg(F.min(interval_start(col(ts))).alias(ts), *rolled).drop("__bucket")


def hourly_parts(df: DataFrame, rules: Mapping[str, str], keys: tuple[str, ...] = ("bldg_id",), ts: str = "timestamp", tie: tuple[str, ...] = ()) -> DataFrame:
    """What coarser steps need of each hour: sums and counts of numbers, and the earliest row's values with its stamp."""
    order = F.struct(col(ts), *[col(c) for c in tie])
    grouped = df.withColumn("__bucket", bucket(col(ts), "hourly")).groupBy(*[quoted(k) for k in keys], "__bucket")
    parts = []
    for name, rule in check_rules(rules).items():
        if name in df.columns and name not in keys:
            c = col(name)
            if rule == "first":
                parts.append(F.min_by(F.struct(order.alias("order"), c.alias("value")), order).alias(name))
            else:
                parts.append(F.struct(F.sum(c).alias("sum"), F.count(c).alias("n")).alias(name))
    return grouped.agg(*parts).withColumnRenamed("__bucket", ts)


def from_parts(parts: DataFrame, rules: Mapping[str, str], step: str, keys: tuple[str, ...] = ("bldg_id",), ts: str = "timestamp") -> DataFrame:
    """The roll-up of ``aggregate`` from ``hourly_parts``: sums of sums, means by sums and counts, the earliest of each."""
    grouped = parts.withColumn("__bucket", F.date_trunc(UNITS[step], col(ts)).cast("timestamp_ntz")).groupBy(*[quoted(k) for k in keys], "__bucket")
    out = []
    for name, rule in rules.items():
        if name in parts.columns and name not in keys:
            c = col(name)
            if rule == "first":
                out.append(F.min_by(c["value"], c["order"]).alias(name))
            elif rule == "sum":
                out.append(F.coalesce(F.sum(c["sum"]), F.lit(0).cast("double")).alias(name))
            else:
                out.append((F.sum(c["sum"]) / F.nullif(F.sum(c["n"]), F.lit(0))).alias(name))
    rolled = grouped.agg(*out).withColumnRenamed("__bucket", ts)
    return rolled.withColumns(calendar_parts(col(ts), step))


def all_steps(df: DataFrame, rules: Mapping[str, str], steps: tuple[str, ...], keys: tuple[str, ...] = ("bldg_id",), ts: str = "timestamp", tie: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Several steps from the same readings by way of their hourly parts, which a caller may write once."""
    parts = hourly_parts(df, rules, keys, ts, tie)
    return {step: from_parts(parts, rules, step, keys, ts) for step in steps}
