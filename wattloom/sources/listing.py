"""Listings of source trees by tasks.

A level of a tree is a table of its folders, and tasks list them, some folders each, into the table of the next level. So
a tree of any size passes through the driver nowhere; a folder is listed by one task, in parts. Tasks list local
paths, object stores (``s3a://`` and ``gs://``) and HDFS through Arrow's file systems.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.sources.shared import materialise

ENTRY = "path string, length long, modified timestamp, is_folder boolean, depth int"
#: Entries that a task hands on at once.
PART = 10_000


def entries(folder: str) -> Iterator[tuple[str, int, datetime, bool]]:
    """Path, length (0 for folders), time and kind of what a folder holds, hidden files left out; nothing if it is not there."""
    scheme, _, rest = folder.partition(":") if ":" in folder.split("/")[0] else ("file", ":", folder)
    if scheme == "file":
        top = "/" + rest.lstrip("/")
        try:
            with os.scandir(top) as found:
                for e in found:
                    if not e.name.startswith("."):
                        at = e.stat()
                        yield f"file:{e.path}", 0 if e.is_dir() else at.st_size, datetime.fromtimestamp(at.st_mtime, UTC), e.is_dir()
        except (FileNotFoundError, NotADirectoryError):
            return
        return
    fs, top = pafs.FileSystem.from_uri("s3:" + rest if scheme == "s3a" else folder)
    prefix = folder[: len(folder) - len(top)] if folder.endswith(top) else f"{scheme}://"
    for e in fs.get_file_info(pafs.FileSelector(top, allow_not_found=True)):
        if not e.base_name.startswith("."):
            yield prefix + e.path, e.size or 0, e.mtime, e.type == pafs.FileType.Directory


def list_level(folders: DataFrame, depth: int) -> DataFrame:
    """What the folders of a column ``path`` hold: ENTRY."""

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for e in entries(folder):
                    rows.append(e)
                    if len(rows) == PART:
                        yield _batch(rows, depth)
                        rows = []
                if rows:
                    yield _batch(rows, depth)

    return folders.select("path").mapInArrow(children, ENTRY)


def _batch(rows: list[tuple], depth: int) -> pa.RecordBatch:
    path, length, modified, is_folder = zip(*rows, strict=True)
    columns = [pa.array(path), pa.array(length, pa.int64()), pa.array(modified, pa.timestamp("us", "UTC")), pa.array(is_folder), pa.array([depth] * len(rows), pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["path", "length", "modified", "is_folder", "depth"])


def crawl(spark: SparkSession, root: str, depth: int = 3) -> DataFrame:
    """ENTRY of a tree down to a depth, folders and files, as a written table for each level: a listing is made once."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    top = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    level, out = spark.createDataFrame([(top,)], "path string"), None
    for d in range(1, depth + 1):
        found = materialise(list_level(level, d))
        out = found if out is None else out.unionByName(found)
        if d < depth:  # a listing waits for the store more than it works, so folders go to more tasks than there are cores
            level = found.where("is_folder").select("path").repartition(4 * spark.sparkContext.defaultParallelism, "path")
    return out if out is not None else spark.createDataFrame([], ENTRY)


def refreshed(spark: SparkSession, root: str, known: DataFrame | None, depth: int) -> DataFrame:
    """The files of the folders at ``depth`` below ``root`` (``folder``, ``folder_modified``, ``path``, ``length``), of which ``known`` may hold an
    earlier state: only folders that are new, or whose time has changed, are listed again."""
    folders = crawl(spark, root, depth).where((F.col("depth") == depth) & F.col("is_folder")).select(F.col("path").alias("folder"), F.col("modified").alias("folder_modified"))
    if known is None:
        open_, kept = folders, None
    else:
        seen = known.select("folder", "folder_modified").distinct()
        open_ = materialise(folders.join(seen, ["folder", "folder_modified"], "left_anti"))
        kept = known.join(folders, ["folder", "folder_modified"], "left_semi")
    spread = open_.repartition(4 * spark.sparkContext.defaultParallelism, "folder")
    listed = list_level(spread.select(F.col("folder").alias("path")), depth + 1).where(~F.col("is_folder"))
    files = listed.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), "path", "length")
    fresh = open_.join(files, "folder", "left").select("folder", "folder_modified", "path", "length")  # an empty folder has a row, too
    return materialise(fresh if kept is None else kept.select(fresh.columns).unionByName(fresh))
