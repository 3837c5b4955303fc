"""Parquet tables that change in one step: a log of small manifests, one a version, names the files that are live.

A table is a folder of hive partitions that any Parquet reader knows. Its hidden folder ``_versions`` holds a JSON
manifest for each version: the live files, the table's columns, and marks of what has gone in. A change writes its files
beside the table, moves them to their folders under names that no reader of the log knows yet, and then puts the next
manifest by a rename that fails if another job has put it. That rename is the change: before it readers see the old rows,
after it the new ones, whatever a crash left behind. A job that loses the race starts over from the version that won.
Files that the new version no longer names are deleted last; what a crash left is deleted by the next change or by
``sweep``. A job that has begun to read an old version may find its files gone and has to be run again.

A folder without the log is a table too, of all its Parquet files; the first change writes its log before anything else.

Partition values are compared as the table's folders say them: as whole numbers if all of a column's are, else as text, so ``0``,
``'0'`` and ``'00'`` are one partition. Rows go to the folder that is there, ``upgrade=00`` stays ``upgrade=00``; a new value
gets a folder padded to ``pads``. An empty text is null, as in every hive layout. Names and values are escaped by Spark.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Collection, Mapping
from dataclasses import dataclass, field
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from wattloom.functions.names import col, quoted

LOG, STAGED = "_versions", "_staged"
#: So many manifests are kept.
KEPT = 10
#: A job that loses the race this often gives up.
TRIES = 20
NULL = "__HIVE_DEFAULT_PARTITION__"


class LostRace(RuntimeError):
    """Other jobs have changed the table each time that this one tried to."""


@dataclass(frozen=True)
class Version:
    """number: -1 for a table that has no log. files: paths below the table. marks: the last number of each name."""

    number: int
    files: tuple[str, ...] = ()
    columns: StructType | None = None
    marks: Mapping[str, int] = field(default_factory=dict)
    removed: tuple[str, ...] = ()

    def text(self) -> str:
        return json.dumps({"files": self.files, "columns": self.columns and self.columns.jsonValue(), "marks": dict(self.marks), "removed": self.removed})

    @classmethod
    def of(cls, number: int, text: str) -> Version:
        x = json.loads(text)
        return cls(number, tuple(x["files"]), x["columns"] and StructType.fromJson(x["columns"]), x["marks"], tuple(x["removed"]))


def merged_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both, equal ones once; a column that one lacks is null there."""
    return old.unionByName(new, allowMissingColumns=True).distinct()


def all_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def new_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new rows; of the old ones only the columns stay."""
    return new.unionByName(old.limit(0), allowMissingColumns=True)


def replacing(*keys: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The new rows, and the old ones whose keys the new ones do not have."""

    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        same = new.select(*[quoted(k) for k in keys]).distinct()
        return all_rows(old.join(same, list(keys), "left_anti"), new)

    return combine


def write_partitioned(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), order: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Hive partitions, rows sorted within files. Rows are brought together by partition and rebalanced: a partition
    with many rows is split over as many tasks as the advisory size asks for, and small ones share a task."""
    out = df.hint("rebalance", *[col(c) for c in partition_by]) if partition_by else df
    if partition_by or order:
        out = out.sortWithinPartitions(*[quoted(c) for c in (*partition_by, *order)])
    out.write.mode(mode).partitionBy(*partition_by).parquet(path)


def _text(name: str) -> Column:
    """A partition column as text; an empty one is null, as its folder is."""
    return F.nullif(col(name).cast("string"), F.lit(""))


class Files:
    """A folder through Hadoop's file systems: any path that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf, self.root = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root.rstrip("/")
        self.fs = self.at().getFileSystem(self.conf)
        self.gateway = spark.sparkContext._gateway

    def at(self, name: str = ""):
        path = self.jvm.org.apache.hadoop.fs.Path
        return path(path(self.root), name) if name else path(self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.at(name))

    def below(self, name: str = "") -> list[str]:
        """Data files at any depth, as paths below the folder; what is hidden is left out."""
        if not self.exists(name):
            return []
        top = self.fs.makeQualified(self.at(name)).toUri().getPath().rstrip("/")
        found, out = self.fs.listFiles(self.at(name), True), []
        while found.hasNext():
            path = found.next().getPath().toUri().getPath()[len(top) + 1 :]
            if not any(p.startswith(("_", ".")) for p in path.split("/")):
                out.append(path)
        return sorted(out)

    def names(self, name: str) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self.at(name))] if self.exists(name) else []

    def move(self, old: str, new: str) -> None:
        self.fs.mkdirs(self.at(new).getParent())
        if not self.fs.rename(self.at(old), self.at(new)):
            raise OSError(f"could not move {old} to {new} in {self.root}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def delete_if_empty(self, name: str) -> None:
        """Deletes a folder that holds nothing, or only a writer's mark of success."""
        if self.exists(name) and all(n == "_SUCCESS" or n.startswith(".") for n in self.names(name)):
            self.delete(name)

    def text(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Writes a file in one step; False if there is one of this name."""
        draft = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        stream = self.fs.create(self.at(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        none = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        options = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = none
        try:
            context.rename(self.fs.makeQualified(self.at(draft)), self.fs.makeQualified(self.at(name)), options)
        except Exception:  # a rename without overwriting: there is one, or the store failed
            self.fs.delete(self.at(draft), False)
            if self.exists(name):
                return False
            raise
        return True


def folder_values(file: str, names: Collection[str]) -> tuple[str | None, ...]:
    """The texts that a file's folders give to the partition columns."""
    parts = dict(p.split("=", 1) for p in file.split("/")[:-1] if "=" in p)
    values = [re.sub(r"%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), parts.get(n, NULL)) for n in names]
    return tuple(None if v == NULL else v for v in values)


class Table:
    """A table at a path; ``partition_by`` and ``pads`` (digits of whole-number folders) are those of its layout."""

    def __init__(self, spark: SparkSession, path: str, partition_by: tuple[str, ...] = (), pads: Mapping[str, int] | None = None, order: tuple[str, ...] = ()) -> None:
        self.spark, self.path, self.partition_by, self.pads, self.order = spark, path.rstrip("/"), tuple(partition_by), dict(pads or {}), tuple(order)
        self.files = Files(spark, path)

    # --- reading -----------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self.files.names(LOG) if re.fullmatch(r"\d+\.json", n))

    def version(self) -> Version:
        """The newest version; number -1 and the files that are there for a folder without a log."""
        numbers = self.versions()
        if numbers:
            return Version.of(numbers[-1], self.files.text(f"{LOG}/{numbers[-1]:012d}.json"))
        return Version(-1, tuple(f for f in self.files.below() if f.endswith(".parquet")))

    def read(self, version: Version | None = None, names: Collection[str] | None = None) -> DataFrame:
        """The rows of a version, of the files whose names match one of the patterns ``names``."""
        version = version or self.version()
        own = [f for f in version.files if names is None or any(fnmatch(f.rpartition("/")[2], n) for n in names)]
        return self._rows(own, version)

    def _rows(self, files: Collection[str], version: Version) -> DataFrame:
        columns = version.columns or self._columns(version.files)
        if not files:
            return self.spark.createDataFrame([], columns)
        parts = {f.name for f in columns.fields} & set(self._partition_names(version))
        texts = StructType([StructField(f.name, StringType() if f.name in parts else f.dataType) for f in columns.fields])
        df = self.spark.read.schema(texts).option("basePath", self.path).parquet(*[self.uri(f) for f in files])
        return df.select(*[col(f.name).cast(f.dataType).alias(f.name) if f.name in parts else col(f.name) for f in columns.fields])

    def uri(self, file: str) -> str:
        return re.sub(r"([{}\[\]*?\\])", r"\\\1", f"{self.path}/{file}")  # paths are patterns to Spark

    def _partition_names(self, version: Version) -> tuple[str, ...]:
        return self.partition_by or tuple(dict.fromkeys(p.split("=", 1)[0] for f in version.files for p in f.split("/")[:-1] if "=" in p))

    def _columns(self, files: Collection[str]) -> StructType:
        """The columns of a folder without a log: those of any file, partition columns as whole numbers or text."""
        if not files:
            return StructType()
        found = self.spark.read.option("mergeSchema", "true").option("basePath", self.path).parquet(*[self.uri(f) for f in files]).schema
        names = self._partition_names(Version(-1, tuple(files)))
        whole = self._whole([folder_values(f, names) for f in files], names)
        return StructType([StructField(f.name, (LongType() if f.name in whole else StringType()) if f.name in names else f.dataType) for f in found.fields])

    @staticmethod
    def _whole(values: Collection[tuple], names: Collection[str]) -> set[str]:
        return {n for i, n in enumerate(names) if all(v[i] is None or re.fullmatch(r"-?\d{1,18}", v[i]) for v in values)}

    # --- changing ----------------------------------------------------------------------------------------------------

    def merge(self, new: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame] = merged_rows, mark: tuple[str, int] | None = None, partitions: DataFrame | None = None) -> bool:
        """Puts ``combine(old, new)`` in place of the partitions that ``new`` has rows of; others are neither read nor written.

        mark: a name and a number; False, and nothing is done, if the table has that number of the name or a later one.
        partitions: rows with the partition columns of ``new``, where they are had for less than ``new`` itself.
        """
        return self._change(new, mark, combine=combine, partitions=partitions)

    def append(self, new: DataFrame, mark: tuple[str, int] | None = None, partitions: DataFrame | None = None) -> bool:
        """Adds the rows as files of their own."""
        return self._change(new, mark, partitions=partitions)

    def replace(self, df: DataFrame, mark: tuple[str, int] | None = None) -> bool:
        """The rows of ``df`` in place of all; ``df`` may read the table."""
        return self._change(df, mark, whole_table=True)

    def done(self, name: str) -> int:
        """The last number that the table has of a name, -1 for none."""
        return self.version().marks.get(name, -1)

    def _change(self, new: DataFrame, mark: tuple[str, int] | None, **how) -> bool:
        for _ in range(TRIES):
            version = self._begun()
            if mark and version.marks.get(mark[0], -1) >= mark[1]:
                return False
            if self._try(new, mark, version, **how):
                return True
        raise LostRace(self.path)

    def _begun(self) -> Version:
        """The newest version of a table that has a log; the log of one that has none begins with what is there."""
        version = self.version()
        if version.number < 0:
            if version.files:
                version = Version(-1, version.files, self._columns(version.files))
            self.files.put(f"{LOG}/{0:012d}.json", version.text())
            return self.version()
        return version

    def _try(self, new: DataFrame, mark: tuple[str, int] | None, version: Version, combine=None, whole_table: bool = False, partitions: DataFrame | None = None) -> bool:
        names = self.partition_by
        # a row a partition
        touched = [tuple(r) for r in (new if partitions is None else partitions).select(*[_text(n).alias(n) for n in names]).distinct().collect()] if names else [()]
        held: dict[tuple, list[str]] = {}
        for f in version.files:
            held.setdefault(folder_values(f, names), []).append(f)
        whole = self._whole([*held, *touched], names)
        kinds = {n: LongType() if n in whole else StringType() for n in names}

        if not touched and not mark and not whole_table:
            return True

        def key(values: tuple) -> tuple:
            return tuple(int(v) if v is not None and n in whole else v for n, v in zip(names, values, strict=True))

        def folder(k: tuple) -> tuple:
            return tuple(f"{v:0{self.pads.get(n, 1)}d}" if isinstance(v, int) else v for n, v in zip(names, k, strict=True))

        here = {key(v) for v in touched}
        there = {key(v): v for v in sorted(held, key=str, reverse=True)}  # of several folders of one value one stays
        folders = {k: there.get(k) or folder(k) for k in here}
        typed = new.select(*[_text(c).cast(kinds[c]).alias(c) if c in kinds else col(c) for c in new.columns])
        known = version.columns and StructType([StructField(f.name, kinds.get(f.name, f.dataType)) for f in version.columns.fields])
        old, rows = [], typed
        if whole_table:
            old, known = list(version.files), None
        elif combine:
            old = [f for v, files in held.items() if key(v) in here for f in files]
            rows = combine(self._rows(old, Version(version.number, version.files, known)) if old else typed.limit(0), typed)
        own = StructType([StructField(f.name, kinds.get(f.name, f.dataType)) for f in rows.schema.fields])
        columns = own if known is None or not known.fields else self.spark.createDataFrame([], known).unionByName(self.spark.createDataFrame([], own), allowMissingColumns=True).schema
        added = self._write(rows, folders, whole) if here else []
        gone = set(old)
        marks = dict(version.marks) | ({mark[0]: mark[1]} if mark else {})
        files = (*(f for f in version.files if f not in gone), *added)
        if not self._commit(Version(version.number + 1, files, columns, marks, tuple(old))):
            for f in added:
                self.files.delete(f)
            return False
        self._drop([*version.removed, *old])  # those of the version before, too, should its job have crashed here
        return True

    def _write(self, rows: DataFrame, folders: Mapping[tuple, tuple], whole: set[str]) -> list[str]:
        """Files of the rows in their folders, which no version names yet."""
        names, staged = self.partition_by, f"{STAGED}/{uuid.uuid4().hex}"
        if names:
            keys = ", ".join(f"__k{i} {'bigint' if n in whole else 'string'}, __v{i} string" for i, n in enumerate(names))
            table = self.spark.createDataFrame([tuple(x for pair in zip(k, v, strict=True) for x in pair) for k, v in folders.items()], keys)
            same = [col(n).eqNullSafe(F.col(f"__k{i}")) for i, n in enumerate(names)]
            on = same[0]
            for s in same[1:]:
                on = on & s
            joined = rows.join(F.broadcast(table), on)  # a row a partition that the change touches
            rows = joined.select(*[F.col(f"__v{names.index(c)}").alias(c) if c in names else col(c) for c in rows.columns])
        write_partitioned(rows, f"{self.path}/{staged}", names, self.order)
        added = [f for f in self.files.below(staged) if f.endswith(".parquet")]
        for f in added:
            self.files.move(f"{staged}/{f}", f)
        self.files.delete(staged)
        return added

    def _commit(self, version: Version) -> bool:
        return self.files.put(f"{LOG}/{version.number:012d}.json", version.text())

    def _drop(self, files: Collection[str]) -> None:
        live = set(self.version().files)
        files = [f for f in files if f not in live]
        for f in files:
            self.files.delete(f)
        for folder in {f.rpartition("/")[0] for f in files} - {""}:
            self.files.delete_if_empty(folder)
        for n in self.versions()[:-KEPT]:
            self.files.delete(f"{LOG}/{n:012d}.json")

    def sweep(self) -> list[str]:
        """Deletes the files that the newest version does not name, and what jobs have staged: for when no job is running."""
        version = self._begun()
        left = sorted(set(self.files.below()) - set(version.files))
        self._drop(left)
        self.files.delete(STAGED)
        return left
