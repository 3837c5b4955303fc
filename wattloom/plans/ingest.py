"""Jobs from a landing folder to the lake, and the tables that describe it.

Files arrive in the landing folder by other means; a job reads all of them at once and Spark spreads the work. Retries
are Spark's own, a lost task is run again, and files that cannot be read are skipped where ``ignoreCorruptFiles`` is set.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.functions.names import col, quoted, state_code
from wattloom.operators.checks import valid_ids
from wattloom.operators.merge import keep_first, merge_partitions, upsert_old_wins
from wattloom.operators.project import canonical_columns, compact_annual, compact_metadata, with_constants
from wattloom.operators.timeagg import from_parts, hourly_parts
from wattloom.sources.archives import archives, station_of_archives
from wattloom.plans.paths import source_glob
from wattloom.sources.catalog import Catalogue
from wattloom.sources.lake import PADS, PARTITIONS, with_ids
from wattloom.sources.table import Files, Table, new_rows, replacing

INDEX_KEYS = ("product", "release_year", "weather_file", "release_version", "state")


def metadata_job(landed: DataFrame, target: str, ids: DataFrame | Collection[int] | None = None, mark: tuple[str, int] | None = None) -> bool:
    """landed: raw metadata with ``state`` and ``upgrade``. Rows are added to a table that may have other columns.

    mark: a name and number of the input; False, and nothing is added, if the table has had it.
    """
    return merge_partitions(_with_partitions(compact_metadata, landed, ids), target, PARTITIONS, PADS, ("bldg_id",), mark)


def _with_partitions(compact, landed: DataFrame, ids) -> DataFrame:
    own = with_ids(landed, ids)
    kept = compact(own).columns
    return own.select(*[col(c) for c in dict.fromkeys([*kept, *PARTITIONS])])


def annual_job(landed: DataFrame, target: str, ids: DataFrame | Collection[int] | None = None, mark: tuple[str, int] | None = None) -> bool:
    return merge_partitions(_with_partitions(compact_annual, landed, ids), target, PARTITIONS, PADS, ("bldg_id",), mark)


def load_curve_job(readings: DataFrame, rules: Mapping[str, str], root: str, steps: tuple[str, ...] = ("hourly", "daily", "monthly"), mark: tuple[str, int] | None = None) -> None:
    """Roll-ups of 15-minute readings, below ``<root>/load_curve_<step>``.

    The readings are scanned once, to hourly parts that are written; each step rolls those up. A building's rows replace
    those that its partition had of it, so readings that come again change nothing; other buildings stay.
    """
    spark, keys = readings.sparkSession, ("bldg_id", *PARTITIONS)
    staged = f"{root.rstrip('/')}/_parts-{uuid.uuid4().hex}"
    parts = hourly_parts(readings, rules, keys)
    parts.write.parquet(staged)
    written = spark.read.schema(parts.schema).parquet(staged)
    for step in steps:
        table = Table(spark, f"{root}/load_curve_{step}", PARTITIONS, PADS, ("bldg_id", "timestamp"))
        table.merge(from_parts(written, rules, step, keys), replacing(*keys), mark, written)
    Files(spark, staged).delete("")


def trips_job(landed: DataFrame, target: str, ids: DataFrame | Collection[int] | None = None, mark: tuple[str, int] | None = None) -> bool:
    """Trip schedules by release and state; ids are text there. A second run adds trips and keeps all of a building's."""
    own = landed.withColumn("bldg_id", F.col("bldg_id").cast("string"))
    if ids is not None:
        spark = landed.sparkSession
        wanted = ids if isinstance(ids, DataFrame) else spark.createDataFrame([(str(i),) for i in ids], "bldg_id string")
        own = own.join(wanted.select(F.col("bldg_id").cast("string").alias("bldg_id")).distinct(), "bldg_id", "left_semi")
    return merge_partitions(own, target, ("release", "state"), mark=mark)


def building_index(raw: DataFrame, product: str, year: str, weather: str, version: str) -> DataFrame:
    """bldg_id, county, puma and the five keys of raw metadata, one row a building and state."""
    df = valid_ids(canonical_columns(raw))
    if "state" in df.columns:
        df = df.withColumn("state", state_code(F.col("state")))
    df = with_constants(df, product=product, release_year=year, weather_file=weather, release_version=version)
    order = [F.col(c) for c in ("county", "puma") if c in df.columns]
    return keep_first(df, ("bldg_id", *[k for k in INDEX_KEYS if k in df.columns]), order or [F.col("bldg_id")])


def index_job(spark: SparkSession, landing: str, catalogue: Catalogue, target: str) -> DataFrame:
    """The building index of all releases of the catalogue whose metadata files have landed, written by its five keys.

    Each release's layout says where its baseline files are; a release without any is left out. A release goes in by a
    change of its own that marks its files as done, so a job that is run again, after a crash or as more has landed,
    does the releases that are open and those whose files have changed.
    """
    table = Table(spark, target, INDEX_KEYS, order=("county", "bldg_id"))
    for r in catalogue:
        pattern = source_glob("metadata", r.key, r.parts, min(r.upgrades, default=0))
        if not pattern or not (found := listed(spark, f"{landing.rstrip('/')}/{pattern}")):
            continue
        mark = f"{r.key}:{hashlib.sha256(repr(found).encode()).hexdigest()}"
        if table.done(mark) < 0:
            raw = spark.read.option("mergeSchema", "true").parquet(f"{landing.rstrip('/')}/{pattern}")
            table.merge(building_index(raw, r.product, r.year, r.weather, r.version), new_rows, (mark, 0))
    if table.version().files:
        return table.read()
    return spark.createDataFrame([], "bldg_id bigint, " + ", ".join(f"{k} string" for k in INDEX_KEYS))


def listed(spark: SparkSession, pattern: str) -> list[tuple[str, int, int]]:
    """Path, length and time of what a pattern matches."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.globStatus(where) or [])


def new_releases(found: DataFrame, known: DataFrame) -> DataFrame:
    """Releases of ``available_files`` that the catalogue table does not have."""
    return found.join(known.select(F.col("key").alias("release")), "release", "left_anti")


def write_weather_map(found: DataFrame, path: str) -> None:
    """Adds to the weather map; a building that has a row keeps it. Only the releases and states of ``found`` are rewritten."""
    order = [F.col("weather_station_name")]

    def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
        return upsert_old_wins(old.select(new.columns), new, ("bldg_id", *INDEX_KEYS), order)

    Table(found.sparkSession, path, INDEX_KEYS).merge(found, upsert)


def write_building_index(index: DataFrame, path: str) -> None:
    """The index in place of what was there."""
    Table(index.sparkSession, path, INDEX_KEYS, order=("county", "bldg_id")).replace(index)


def weather_map(spark: SparkSession, landing: str, keys: Mapping[str, str]) -> DataFrame:
    """Buildings with their weather station, from the model archives of a release; '' where none can be read."""
    found = station_of_archives(archives(spark, landing))
    id_ = F.regexp_extract("path", r"bldg(\d+)-up(\d+)\.zip$", 1)
    out = found.where(id_ != "").select(id_.cast("long").alias("bldg_id"), F.regexp_extract("path", r"bldg(\d+)-up(\d+)\.zip$", 2).cast("int").alias("upgrade_id"), F.regexp_extract("path", r"state=([A-Z]{2})/", 1).alias("state"), "weather_station_name")
    return keep_first(with_constants(out, **keys), ("bldg_id",), [F.col("upgrade_id"), F.col("weather_station_name")])


def available_files(paths: DataFrame) -> DataFrame:
    """Release folders and the file types that their sub-folders stand for; paths: a column ``path``."""
    key = F.regexp_extract("path", r"/(\d{4})/(?:resstock|comstock)_[^/]+", 0)
    release = F.concat_ws("_", F.when(F.col("path").contains("/comstock_"), "com").otherwise("res"), F.regexp_extract("path", r"/(\d{4})/", 1), F.regexp_extract("path", r"stock_([a-z0-9]+)_release", 1), F.regexp_extract("path", r"_release_([\d.]+)", 1))
    kinds = F.when(F.col("path").contains("/timeseries_individual_buildings/"), F.array(*[F.lit(f"load_curve_{s}") for s in ("15min", "hourly", "daily", "monthly")]))
    kinds = kinds.when(F.col("path").contains("/metadata_and_annual_results/"), F.array(F.lit("metadata"), F.lit("load_curve_annual")))
    kinds = kinds.when(F.col("path").contains("/metadata/"), F.array(F.lit("metadata"))).when(F.col("path").contains("/weather/"), F.array(F.lit("weather")))
    kinds = kinds.when(F.col("path").contains("building_energy_models/"), F.array(F.lit("hpxml"), F.lit("schedule")))
    upgrade = F.regexp_extract("path", r"upgrade=?(?:up)?(\d+)", 1)
    rows = paths.where(key != "").select(release.alias("release"), F.explode(kinds).alias("file_type"), F.when(upgrade != "", upgrade.cast("int")).otherwise(0).alias("upgrade"))
    return rows.groupBy("release").agg(F.sort_array(F.collect_set("file_type")).alias("file_types"), F.sort_array(F.collect_set("upgrade")).alias("upgrades"))


def files_by_upgrade(paths: DataFrame) -> DataFrame:
    """(upgrade, path) of the paths that name an upgrade; 'baseline' is 0. A row a path, so no row grows with a tree."""
    n = F.regexp_extract("path", r"upgrade_?=?0*(\d+)", 1)
    upgrade = F.when(F.col("path").contains("baseline"), 0).when(n != "", n.cast("int"))
    return paths.select(upgrade.alias("upgrade"), "path").where("upgrade is not null")


def work_by_source(buildings: DataFrame, source: str = "source_path", target: str = "target_path", most: int = 10_000) -> DataFrame:
    """Units of work: a source file, a file that it feeds, and buildings of that, in order and at most ``most`` a row.

    Units of a source share its key, so a job joins them to the source, which is read once for all of them.
    """
    keys = [quoted(source), quoted(target)]
    numbered = buildings.select(*keys, "bldg_id").distinct().withColumn("__part", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy("bldg_id")) - 1) / most))
    return numbered.groupBy(*keys, "__part").agg(F.sort_array(F.collect_list("bldg_id")).alias("bldg_ids")).drop("__part")  # at most ``most`` a row


def append_batch(trips: DataFrame, path: str, release: str, batch: int | None = None) -> bool:
    """Adds a batch of trip schedules as files of its own below release and state.

    batch: a number that grows from batch to batch of a release; one that has gone in does not go in again.
    """
    table = Table(trips.sparkSession, path, ("release", "state"), order=("bldg_id", "vehicle_id", "date"))
    return table.append(with_constants(trips, release=release), None if batch is None else (release, batch))
