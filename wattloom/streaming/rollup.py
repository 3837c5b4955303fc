"""Roll-ups of a stream of interval-ending readings; late readings count while the watermark allows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions.energy import interval_start
from wattloom.functions.names import col, quoted
from wattloom.operators.timeagg import check_rules, rule_column
from wattloom.sources.shared import shared_dir

#: Sliding windows of a stream have one length; a month, which has not, is the key of its days' first instant.
WINDOWS = {"hourly": "1 hour", "daily": "1 day"}


def rollup_stream(readings: DataFrame, rules: Mapping[str, str], step: str, keys: tuple[str, ...] = ("bldg_id",), ts: str = "timestamp", late: str | None = "1 hour") -> DataFrame:
    """As the batch roll-up, for append mode: a bucket is final when the watermark passes its end.

    late: how far the watermark stays behind; None for none, so that rows count however late they come and no bucket is ever final.
    Months have no window of one length, so monthly buckets never become final and need update mode (``run_to_end``).
    """
    started = readings.withColumn("__start", interval_start(col(ts)).cast("timestamp"))
    if late is not None:
        started = started.withWatermark("__start", late)
    if step == "monthly":
        month = F.date_trunc("month", "__start")
        window = F.struct(month.alias("start"), F.add_months(month, 1).cast("timestamp").alias("end")).alias("__w")
    else:
        window = F.window("__start", WINDOWS[step]).alias("__w")
    grouped = started.groupBy(window, *[quoted(k) for k in keys])
    out = grouped.agg(*[rule_column(n, r, F.struct(col(ts))) for n, r in check_rules(rules).items() if n in readings.columns and n not in keys])
    return out.select(*[quoted(k) for k in keys], F.col("__w.start").cast("timestamp_ntz").alias(ts), *[quoted(n) for n in out.columns if n not in ("__w", *keys)])


def run_to_end(rolled: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The roll-up of what the source holds: all of it, in whatever order files come, if ``rolled`` has no watermark
    (``late=None``; its state then grows with the buckets); with one, rows that it has passed are left out. Tasks write each batch's changed rows, the last of each key counts.

    The table and the stream's state are in a fresh folder below ``spark.checkpoint.dir``; where that is unset, a
    ``local[...]`` session uses a local one. A bucket that is still open when the source ends is written too.
    """
    spark = rolled.sparkSession
    where = shared_dir(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/table/__batch={number}")  # a batch that runs again replaces its rows

    spark.createDataFrame([], rolled.schema).write.parquet(f"{where}/table/__batch=-1")  # a source without rows runs no batch
    writer = rolled.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{where}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    kept = [c for c in rolled.columns if c not in keys]
    written = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rolled.schema)}, __batch bigint").parquet(f"{where}/table")
    last = written.groupBy(*[quoted(k) for k in keys]).agg(F.max_by(F.struct(*[quoted(c) for c in kept]), "__batch").alias("__last"))
    return last.select(*[quoted(k) for k in keys], *[F.col("__last").getField(c).alias(c) for c in kept])
