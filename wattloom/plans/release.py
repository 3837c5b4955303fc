"""All file types of a release from the landing folder to the lake in one call."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions.names import FILE_TYPES
from wattloom.plans.ingest import annual_job, listed, load_curve_job, metadata_job, trips_job
from wattloom.plans.paths import source_glob
from wattloom.sources.catalog import Release, check_file_types
from wattloom.sources.lake import PADS, PARTITIONS
from wattloom.sources.models import models, schedules, with_building
from wattloom.sources.table import Table, replacing

#: So many buildings are named in the filter of a scan, which then opens no other files; more are joined.
NAMED = 1000


def release_job(spark: SparkSession, landing: str, release: Release, root: str, buildings: DataFrame, file_types: Collection[str], rules: Mapping[str, str] | None = None,
                fields: Mapping[str, tuple[str, str]] | None = None, columns: Mapping[str, str] | None = None) -> list[str]:
    """Puts the wanted buildings' data of each file type into ``<root>/<release>/<file type>``; the types that had files.

    buildings: bldg_id, state and upgrade. rules: of roll-ups, by column; fields and columns: of ``models`` and ``schedules``.
    Files lie below ``landing`` as at the source (trip schedules in ``trip_schedules``). Types without a landed file are left
    out. A second run replaces a building's curves, models, schedules and stations, and adds no equal row of the others.
    """
    file_types = check_file_types(file_types)
    wanted = buildings.select(F.col("bldg_id").cast("bigint").alias("bldg_id"), F.col("state").cast("string").alias("state"), F.col("upgrade").cast("int").alias("upgrade")).distinct()
    upgrades = sorted(r[0] for r in wanted.select("upgrade").distinct().collect())  # a release has tens
    few = [tuple(r) for r in wanted.select("bldg_id", "upgrade").limit(NAMED + 1).collect()]
    base, target, done = landing.rstrip("/"), f"{root.rstrip('/')}/{release.key}", []

    def found(file_type: str, folders: bool = False) -> list[str]:
        """Patterns that match something. Of types with a file a building, the folders: Spark lists those by tasks."""
        patterns = dict.fromkeys(filter(None, (source_glob(file_type, release.key, release.parts, u) for u in upgrades)))
        if folders:
            patterns = dict.fromkeys(p.rpartition("/")[0] for p in patterns)
        return [f"{base}/{p}" for p in patterns if listed(spark, f"{base}/{p}")]

    def own(rows: DataFrame) -> DataFrame:
        """The wanted buildings' rows, with their states."""
        return rows.drop("state").join(wanted, ["bldg_id", "upgrade"])

    def named(rows: DataFrame, name) -> DataFrame:
        if len(few) <= NAMED:
            return rows.where(F.col("_metadata.file_name").isin([name(*b) for b in few]))
        return rows

    for file_type, job in (("metadata", metadata_job), ("load_curve_annual", annual_job)):
        if file_type in file_types and (at := found(file_type)):
            raw = spark.read.option("mergeSchema", "true").parquet(*at)
            if "upgrade" not in raw.columns:
                n = F.regexp_extract(F.col("_metadata.file_name"), r"upgrade_?0*(\d+)", 1)
                raw = raw.withColumn("upgrade", F.when(n != "", n.cast("int")).otherwise(0))
            job(own(raw.withColumns({"upgrade": F.col("upgrade").cast("int"), "bldg_id": F.col("bldg_id").cast("bigint")})), f"{target}/{file_type}")
            done.append(file_type)

    curves = [t for t in FILE_TYPES if t in file_types and t.startswith("load_curve_") and t != "load_curve_annual"]
    if curves and (at := found("load_curve_15min", True)):
        rows = named(spark.read.option("mergeSchema", "true").option("pathGlobFilter", "*.parquet").parquet(*at), lambda b, u: f"{b}-{u}.parquet")
        name = F.col("_metadata.file_name")
        ids = {"bldg_id": F.regexp_extract(name, r"^(\d+)-\d+\.parquet$", 1).cast("bigint"), "upgrade": F.regexp_extract(name, r"^\d+-(\d+)\.parquet$", 1).cast("int")}
        readings = own(rows.withColumns(ids))
        if "load_curve_15min" in curves:
            Table(spark, f"{target}/load_curve_15min", PARTITIONS, PADS, ("bldg_id", "timestamp")).merge(readings, replacing("bldg_id", *PARTITIONS), partitions=wanted)
        if steps := tuple(t.removeprefix("load_curve_") for t in curves if t != "load_curve_15min"):
            load_curve_job(readings, rules or {}, target, steps)
        done += curves

    for file_type, rows_of in (("hpxml", lambda z: models(z, fields or {})), ("schedule", lambda z: schedules(z, columns or {}))):
        if file_type in file_types and (at := found(file_type, True)):
            zips = named(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(at), lambda b, u: f"bldg{b:07d}-up{u:02d}.zip").select("path", "content")
            rows = own(with_building(rows_of(zips))).drop("path")
            Table(spark, f"{target}/{file_type}", PARTITIONS, PADS, ("bldg_id",)).merge(rows, replacing("bldg_id", *PARTITIONS), partitions=wanted)
            done.append(file_type)

    if "trip_schedules" in file_types and listed(spark, f"{base}/trip_schedules"):
        trips = spark.read.parquet(f"{base}/trip_schedules").where(F.col("release") == release.key)
        trips_job(trips, f"{target}/trip_schedules", wanted.select("bldg_id"))
        done.append("trip_schedules")

    if "weather" in file_types and (at := found("weather")):
        rows = spark.read.option("header", "true").csv(at).withColumn("station", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_[^_]+\.csv$", 1))
        Table(spark, f"{target}/weather", ("station",)).merge(rows, replacing("station"))
        done.append("weather")
    return done
