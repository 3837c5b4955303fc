"""The lake: ``<root>/<release>/<file_type>/state=XX/upgrade=NN/<file>`` of Parquet files.

Filters are plain predicates on the partition columns ``state`` and ``upgrade``, so files of other partitions are never
listed into a scan; building ids are a semi-join. An empty set of upgrades or of ids gives no rows, not all of them.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from wattloom.errors import BaselineNotFound, DataNotFound, InvalidPath, NoBuildings, UpgradesNotFound, UpgradesNotInRelease
from wattloom.functions.energy import md5_uniform
from wattloom.functions.names import LAKE_PATH, building_of_file, path_part
from wattloom.sources.catalog import Release, check_states
from wattloom.sources.table import Table

#: Metadata files of each variant, as a path pattern; the jobs here write the standard one as part files.
METADATA_FILES = {"standard": ("metadata.parquet", "part-*.parquet"), "sb": ("metadata-sb.parquet",)}
#: The partitions of all tables of the lake, and the digits of their folders.
PARTITIONS, PADS = ("state", "upgrade"), {"upgrade": 2}
#: Up to so many ids are sent to all tasks; more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Up to so many are a filter of the scan.
MAX_FILTER_IDS = 200


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row a data file: path, length and the parts of the path. File contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    return with_path_parts(files.select("path", "length"))


def with_path_parts(paths: DataFrame) -> DataFrame:
    """Adds release, file_type, state, upgrade and file; rows whose path is no lake path are left out."""
    parts = {p: path_part(F.col("path"), p) for p in ("release", "file_type", "state", "upgrade", "file")}
    return paths.withColumns(parts).where(F.col("release").isNotNull())


def parse_path(path: str) -> dict:
    if not (m := re.search(LAKE_PATH, path)):
        raise InvalidPath(path=path)
    return dict(zip(("release", "file_type", "state", "upgrade", "file"), (m[1], m[2], m[3], int(m[4]), m[5]), strict=True))


def matching(files: DataFrame, **wanted) -> DataFrame:
    """Rows whose release, file_type, state or upgrade is the given value or among the given ones; None does not filter."""
    for name, value in wanted.items():
        if value is not None:
            files = files.where(F.col(name).isin(*([value] if isinstance(value, str | int) else list(value))))
    return files


def union_of_schemas(frames: Iterable[DataFrame]) -> DataFrame:
    """All columns of any frame; what a frame lacks is null."""
    out = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out


def with_ids(df: DataFrame, ids: DataFrame | Collection[int] | None, column: str = "bldg_id") -> DataFrame:
    """Rows of the given buildings. ids: None for all, a collection, or a table with the column.

    A collection also bounds the scan: a few ids are a filter that Parquet's statistics answer, more are one on their least and
    greatest, and the jobs here sort files by building, so most row groups without a wanted one are skipped.
    """
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select(column).distinct(), column, "left_semi")
    wanted = sorted({int(i) for i in ids})
    if not wanted:
        return df.where(F.lit(False))
    if len(wanted) <= MAX_FILTER_IDS:
        return df.where(F.col(column).isin(*wanted))
    table = df.sparkSession.createDataFrame([(i,) for i in wanted], f"{column} bigint")
    table = F.broadcast(table) if len(wanted) <= MAX_BROADCAST_IDS else table
    return df.where(F.col(column).between(wanted[0], wanted[-1])).join(table, column, "left_semi")


def seeded_order(seed: int, column: str = "bldg_id"):
    """An order that depends on the seed and the id only: the md5 of both, then the id."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string"))), F.col(column)]


def seeded_sample(ids: DataFrame, n: int, seed: int, column: str = "bldg_id") -> DataFrame:
    """n distinct ids without replacement, all if there are fewer; top-n by hash, so nothing is sorted whole."""
    return ids.select(column).distinct().orderBy(*seeded_order(seed, column)).limit(n)


class Lake:
    """Reads of one release for some states, optionally of a seeded sample of its buildings."""

    def __init__(self, spark: SparkSession, root: str, release: Release | str, states: Collection[str] | None = None, sample_n: int | None = None, seed: int = 42, metadata_variant: str = "standard") -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.release = release.key if isinstance(release, Release) else release
        self.in_release = set(release.upgrades) if isinstance(release, Release) else None
        self.states = None if states is None else check_states(states)
        self.sample_n, self.seed = sample_n, seed
        self.metadata_file = METADATA_FILES[metadata_variant]

    def _scan(self, file_type: str) -> DataFrame:
        df = self._rows(file_type)
        df = df.withColumn("upgrade", F.col("upgrade").cast("long"))
        return df if self.states is None else df.where(F.col("state").isin(*self.states))

    def _table(self, file_type: str) -> Table:
        return Table(self.spark, f"{self.root}/{self.release}/{file_type}", PARTITIONS, PADS)

    def _rows(self, file_type: str) -> DataFrame:
        """The live rows: of the files that the table's log names, or of all files where it has none."""
        table, metadata = self._table(file_type), file_type == "metadata"  # variants of metadata share folders
        if table.versions():
            version = table.version()
            if not self._own_files(version.files, file_type):
                raise DataNotFound(file_type=file_type, path=table.path)
            return table.read(version, self.metadata_file if metadata else None)
        reader = self.spark.read.option("basePath", table.path)
        if metadata:  # columns differ by upgrade
            reader = reader.option("mergeSchema", "true").option("pathGlobFilter", "{" + ",".join(self.metadata_file) + "}")
        try:
            return reader.parquet(table.path)
        except AnalysisException as e:
            raise DataNotFound(file_type=file_type, path=table.path) from e

    def _own_files(self, files: Iterable[str], file_type: str) -> list[str]:
        return [f for f in files if file_type != "metadata" or any(fnmatch(f.rpartition("/")[2], n) for n in self.metadata_file)]

    def partitions(self, file_type: str) -> list[tuple[str, int]]:
        """(state, upgrade) of the chosen states on disk, from the table's log or folder names alone: no file is opened."""
        table = self._table(file_type)
        if table.versions():
            found = ["/" + f for f in self._own_files(table.version().files, file_type)]
        else:
            hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
            pattern = f"{table.path}/state=*/upgrade=*" + ("/{" + ",".join(self.metadata_file) + "}" if file_type == "metadata" else "")
            fs = hadoop(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            found = [str(f.getPath().toString()) for f in fs.globStatus(hadoop(pattern)) or []]
        parts = {(m[1], int(m[2])) for p in found if (m := re.search(r"/state=([^/]+)/upgrade=(\d+)(?:/|$)", p))}
        return sorted(p for p in parts if self.states is None or p[0] in self.states)

    def upgrades(self, file_type: str, every_state: bool | None = None) -> list[int]:
        """Upgrades on disk: in any state for metadata, in every chosen state for the rest (or as asked)."""
        every_state = file_type != "metadata" if every_state is None else every_state
        parts = self.partitions(file_type)
        if not parts:
            raise DataNotFound(file_type=file_type, path=f"{self.root}/{self.release}/{file_type}")
        n = len({state for state, _ in parts}) if every_state else 1
        return sorted({u for _, u in parts if sum(x == u for _, x in parts) >= n})

    def check_upgrades(self, file_type: str, upgrades: Collection[int] | None) -> list[int] | None:
        if upgrades is None:
            return None
        wanted = sorted({int(u) for u in upgrades})
        if self.in_release is not None and (bad := [u for u in wanted if u not in self.in_release]):
            raise UpgradesNotInRelease(upgrades=bad, release=self.release)
        there = self.upgrades(file_type)
        if wanted and not there:
            raise DataNotFound(file_type=file_type, path=f"{self.root}/{self.release}")
        if missing := [u for u in wanted if u not in there]:
            raise UpgradesNotFound(file_type=file_type, upgrades=missing, path=self.root)
        return wanted

    def read(self, file_type: str, upgrades: Collection[int] | None = None, building_ids: DataFrame | Collection[int] | None = None) -> DataFrame:
        wanted = self.check_upgrades(file_type, upgrades)
        df = self._scan(file_type)
        if wanted is not None:
            df = df.where(F.col("upgrade").isin(*wanted)) if wanted else df.where(F.lit(False))
        if self.sample_n is not None:
            df = with_ids(df, self.sampled_buildings())
        return with_ids(df, building_ids)

    def metadata(self, upgrades=None, building_ids=None) -> DataFrame:
        return self.read("metadata", upgrades, building_ids)

    def load_curve(self, step: str, upgrades=None, building_ids=None) -> DataFrame:
        """step: 15min, hourly, daily, monthly or annual."""
        return self.read(f"load_curve_{step}", upgrades, building_ids)

    def buildings(self) -> DataFrame:
        """Distinct ids of each state's least upgrade."""
        meta = self._scan("metadata").select("bldg_id", "state", "upgrade")
        least = meta.groupBy("state").agg(F.min("upgrade").alias("upgrade"))
        return meta.join(F.broadcast(least), ["state", "upgrade"], "left_semi").select("bldg_id").distinct()

    def sampled_buildings(self) -> DataFrame:
        """The pooled sample over the chosen states."""
        ids = self.buildings()
        if ids.isEmpty():
            raise NoBuildings()
        return ids if self.sample_n is None else seeded_sample(ids, self.sample_n, self.seed)

    def baseline_buildings(self) -> DataFrame:
        ids = self._scan("metadata").where("upgrade = 0").select("bldg_id").distinct()
        if ids.isEmpty():
            raise BaselineNotFound(file_type="metadata", path=self.root)
        return ids

    def buildings_on_disk(self, file_type: str) -> DataFrame:
        """upgrade, state and bldg_id that there is data of.

        A file named after its building says so by its name and is not opened; of the others, such as those that the jobs
        here write, the column bldg_id is read and no other.
        """
        rows, name = self._rows(file_type), F.col("_metadata.file_name")
        if self.states is not None:
            rows = rows.where(F.col("state").isin(*self.states))
        place = (F.col("upgrade").cast("long").alias("upgrade"), "state")
        read = rows.where(building_of_file(name).isNull())
        read = read.select(*place, F.col("bldg_id").cast("long").alias("bldg_id")) if "bldg_id" in rows.columns else read.select(*place, F.lit(None).cast("long").alias("bldg_id"))
        named = rows.where(building_of_file(name).isNotNull()).select(*place, building_of_file(name).cast("long").alias("bldg_id"))
        return read.unionByName(named).where("bldg_id is not null").distinct()

    def row_counts(self, file_type: str) -> DataFrame:
        """Rows by state and upgrade (a row a partition), from the footers of the Parquet files; no column is read."""
        counts = [tuple(r) for r in self._footer_counts(file_type).collect()]
        kept = [r for r in counts if self.states is None or r[0] in self.states]
        return self.spark.createDataFrame(kept, "state string, upgrade long, n_rows long")

    def _footer_counts(self, file_type: str) -> DataFrame:
        """Spark pushes counts into its second-generation source only, so this plan has a session of its own."""
        table = self._table(file_type)
        own = self._own_files(table.version().files, file_type)
        if not own:
            raise DataNotFound(file_type=file_type, path=table.path)
        session = self.spark.newSession()
        session.conf.set("spark.sql.sources.useV1SourceList", "")
        session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        df = session.read.option("basePath", table.path).parquet(*[table.uri(f) for f in own])
        counts = df.groupBy("state", "upgrade").agg(F.count("*").alias("n_rows"))
        return counts.select("state", F.col("upgrade").cast("long").alias("upgrade"), "n_rows")


def facets(files: DataFrame) -> DataFrame:
    """One row: the distinct releases, file types, states and upgrades of a manifest, each in order."""
    return files.agg(*[F.sort_array(F.collect_set(c)).alias(c + "s") for c in ("release", "file_type", "state", "upgrade")])


def list_buildings(index: DataFrame, release: Release, state: str, limit: int | None = None) -> DataFrame:
    """Ids (and counties) of the building index for a release and state; a limit takes the least ids."""
    own = index.where((F.col("product") == release.product) & (F.col("release_year") == release.year) & (F.col("weather_file") == release.weather) & (F.col("release_version") == release.version) & (F.col("state") == state))
    rows = own.select(*[c for c in ("bldg_id", "county") if c in index.columns])
    return rows if limit is None else rows.orderBy("bldg_id").limit(limit)


def missing_ids(wanted: DataFrame, there: DataFrame, column: str = "bldg_id") -> DataFrame:
    return wanted.select(column).distinct().join(there.select(column), column, "left_anti")


def building_groups(index: DataFrame, release: Release, states: Collection[str], upgrades: Collection[int], limit: int | None = None) -> DataFrame:
    """Buildings of each wanted state with each wanted upgrade; a limit takes each state's least ids."""
    spark = index.sparkSession
    own = union_of_schemas([list_buildings(index, release, s, limit).withColumn("state", F.lit(s)) for s in check_states(states)]).distinct()
    wanted = spark.createDataFrame([(int(u),) for u in upgrades], "upgrade int")
    return own.join(F.broadcast(wanted))  # a few upgrades


def split_by_hash(df: DataFrame, share: float, seed: int, column: str = "bldg_id") -> tuple[DataFrame, DataFrame]:
    """Two parts by the md5 of seed and id: about ``share`` of the ids first. Alike in every run and for every partitioning."""
    u = md5_uniform(F.lit(str(seed)), F.col(column).cast("string"))
    return df.where(u < share), df.where(u >= share)


def estimated_bytes(files: DataFrame, n: int, seed: int = 42, most: int = 100) -> DataFrame:
    """Files, and the bytes of all by the mean length of a seeded sample of at most ``most`` of them; n files in all."""
    some = files.orderBy(*seeded_order(seed, "path")).limit(most)
    return some.agg(F.count("*").alias("n_sampled"), (F.avg("length") * n).alias("estimated_bytes"))
