"""``python -m wattloom.cli JOB ...``: the jobs of ``wattloom.plans`` from a shell."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wattloom.operators.timeagg import load_rules
from wattloom.operators.vehicles import VehicleConfig, trip_schedules
from wattloom.plans.ingest import annual_job, append_batch, index_job, load_curve_job, metadata_job, trips_job, weather_map, write_weather_map
from wattloom.plans.release import release_job
from wattloom.plans.scenario import ScenarioReader
from wattloom.sources.lake import Lake, list_buildings
from wattloom.sources.catalog import Catalogue, Release, parse_key
from wattloom.sources.surveys import load_inputs


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description=__doc__)
    jobs = out.add_subparsers(dest="job", required=True)
    for name in ("metadata", "annual", "load-curves"):
        job = jobs.add_parser(name)
        job.add_argument("landed")
        job.add_argument("target")
        if name == "load-curves":
            job.add_argument("--rules", required=True)
            job.add_argument("--steps", nargs="+", default=["hourly", "daily", "monthly"])
    trips = jobs.add_parser("trips", help="trip schedules from a landing table into the lake")
    trips.add_argument("landed")
    trips.add_argument("target")
    index = jobs.add_parser("index", help="the building index of all releases of a catalogue")
    for name in ("landing", "catalogue", "target"):
        index.add_argument(name)
    weather = jobs.add_parser("weather-map", help="stations of a release's buildings from its model archives")
    for name in ("landing", "release", "target"):
        weather.add_argument(name)
    vehicles = jobs.add_parser("vehicles", help="trip schedules of a state's vehicles from surveys")
    for name in ("metadata", "households", "trips", "state", "release", "target"):
        vehicles.add_argument(name)
    vehicles.add_argument("--start", default="2022-01-01")
    vehicles.add_argument("--end", default="2022-12-31")
    vehicles.add_argument("--max-vehicles", type=int, default=2)
    vehicles.add_argument("--seed", type=int, default=42)
    scenario = jobs.add_parser("scenario")
    scenario.add_argument("root")
    scenario.add_argument("release")
    scenario.add_argument("scenario", help='JSON, as {"4": [0.1, 0.2]}')
    scenario.add_argument("--states", nargs="+")
    scenario.add_argument("--sample", type=int)
    scenario.add_argument("--seed", type=int, default=42)
    scenario.add_argument("--save", nargs="*", default=[], metavar="FILE_TYPE")
    scenario.add_argument("--export")
    release = jobs.add_parser("release", help="file types of a release from the landing folder to the lake")
    for name in ("landing", "release", "root", "buildings"):
        release.add_argument(name)
    release.add_argument("file_types", nargs="+")
    release.add_argument("--rules", help="CSV of roll-ups")
    release.add_argument("--fields", type=json.loads, help='JSON, as {"area": ["Building/Size/Area", "double"]}')
    release.add_argument("--columns", type=json.loads, help='JSON, as {"heating": "double"}')
    buildings = jobs.add_parser("buildings")
    buildings.add_argument("index")
    buildings.add_argument("release")
    buildings.add_argument("state")
    buildings.add_argument("--limit", type=int)
    return out


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    own = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("wattloom").getOrCreate()
    if own.job == "buildings":
        list_buildings(spark.read.parquet(own.index), parse_key(own.release), own.state, own.limit).show(own.limit or 20, truncate=False)
    elif own.job == "scenario":
        shares = {int(u): f for u, f in json.loads(own.scenario).items()}
        reader = ScenarioReader(Lake(spark, own.root, own.release, own.states, own.sample, own.seed), shares, seed=own.seed)
        for file_type in own.save:
            reader.save(file_type)
        if own.export:
            reader.export_wide(own.export)
    elif own.job == "release":
        rules = load_rules(spark, own.rules) if own.rules else None
        print(*release_job(spark, own.landing, Release(own.release, {}), own.root, spark.read.parquet(own.buildings), own.file_types, rules, own.fields, own.columns))
    elif own.job == "index":
        index_job(spark, own.landing, Catalogue.load(_text(spark, own.catalogue)), own.target)
    elif own.job == "weather-map":
        r = parse_key(own.release)
        keys = {"product": r.product, "release_year": r.year, "weather_file": r.weather, "release_version": r.version}
        write_weather_map(weather_map(spark, own.landing, keys), own.target)
    elif own.job == "vehicles":
        config = VehicleConfig(own.state, own.start, own.end, own.max_vehicles, own.seed)
        inputs = load_inputs(spark, own.metadata, own.households, own.trips, own.state)
        append_batch(trip_schedules(*inputs, config).withColumn("state", F.lit(own.state)), own.target, own.release)
    else:
        landed = spark.read.option("mergeSchema", "true").parquet(own.landed)
        if own.job == "metadata":
            metadata_job(landed, own.target)
        elif own.job == "annual":
            annual_job(landed, own.target)
        elif own.job == "trips":
            trips_job(landed, own.target)
        else:
            load_curve_job(landed, load_rules(spark, own.rules), own.target, tuple(own.steps))


if __name__ == "__main__":
    main()
