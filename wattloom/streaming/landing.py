"""A landing folder as a stream: each file goes into the lake once."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from wattloom.sources.table import Files


def land(spark: SparkSession, landing: str, schema: StructType | str, job: Callable[..., object], checkpoint: str, files_per_batch: int = 1000) -> None:
    """Takes in all files that have come since the last call; ``job(rows, mark=(name, number))`` puts a batch into a table.

    Spark's checkpoint says which files a batch has, and the table's marks which batches it has: a batch that runs again,
    as after a crash between the table's change and the checkpoint's, adds nothing. Marks go by the checkpoint's own id, so
    a new checkpoint takes in all files again.
    """

    def take(rows: DataFrame, number: int) -> None:
        name = json.loads(Files(spark, checkpoint).text("metadata"))["id"]
        job(rows, mark=(f"stream:{name}", number))

    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
