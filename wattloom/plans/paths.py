"""Where the files of a building are at the source, as Column expressions over release attributes.

Each rule table is read from the top: the first row whose named attributes fit gives the template. Fields in braces
are columns of ``KEYS`` or the derived ones of ``_fields``. Paths that a release does not have are null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.functions.names import pad_left, upgrade_word

KEYS = ("release", "product", "year", "weather", "version", "bldg_id", "upgrade", "state", "county", "station")

# The layouts of the public data sets by release.
_STATE = "{base}/metadata_and_annual_results/by_state/state={state}/parquet/{state}_{word}_metadata_and_annual_results.parquet"
_COUNTY = "{base}/metadata_and_annual_results/by_state_and_county/full/parquet/state={state}/county={county}/{state}_{county}_"
_FULL_STATE = "{base}/metadata_and_annual_results/by_state/full/parquet/state={state}/{state}_upgrade{upgrade}.parquet"
METADATA = (
    ({"year": "2021"}, "{base}/metadata/metadata.parquet"),
    ({"year": ("2022", "2023")}, _STATE),
    ({"year": "2024", "product": "comstock", "weather": "amy2018", "version": "2"}, _COUNTY + "{word}.parquet"),
    ({"release": "res_2024_tmy3_1"}, "{base}/metadata/{word}.parquet"),
    ({"year": "2024"}, _STATE),
    ({"year": "2025", "product": "comstock"}, _COUNTY + "upgrade{upgrade}.parquet"),
    ({"year": "2025"}, _FULL_STATE),
)
ANNUAL = (
    ({"year": "2024", "product": "comstock", "weather": "amy2018", "version": "2"}, _COUNTY + "{word}.parquet"),
    ({"year": ("2022", "2023", "2024")}, _STATE),
    ({"year": "2025", "product": "comstock"}, _COUNTY + "upgrade{upgrade}.parquet"),
    ({"year": "2025", "product": "resstock"}, _FULL_STATE),
)
MODELS = (
    ({"year": "2022"}, "{base}/building_energy_models/upgrade={upgrade}/{model}.zip"),
    ({"year": "2024"}, "{base}/model_and_schedule_files/building_energy_models/upgrade={upgrade}/{model}.zip"),
    ({"release": "res_2025_amy2018_1"}, "{base}/building_energy_models/upgrade={upgrade}/{model}.zip"),
    ({"year": "2025", "product": "resstock"}, "{base}/building_energy_models/upgrade=up{upgrade2}/{model}.zip"),
    ({"year": "2025"}, "{base}/building_energy_models/upgrade=up{upgrade2}/{model}.osm.gz"),
)
CURVE = (({}, "{base}/timeseries_individual_buildings/by_state/upgrade={upgrade}/state={state}/{bldg_id}-{upgrade}.parquet"),)
_BY_WEATHER, _BY_STATE = "{base}/weather/{weather}/{station}_{suffix}.csv", "{base}/weather/state={state}/{station}_{suffix}.csv"
WEATHER = (
    ({"year": "2021"}, "{base}/weather/{weather}/{station}_{suffix_lower}.csv"),
    ({"year": "2022"}, _BY_STATE),
    ({"year": "2023"}, _BY_WEATHER),
    ({"year": "2024", "product": "comstock", "weather": "amy2018"}, _BY_WEATHER),
    ({"year": "2024"}, _BY_STATE),
    ({"year": "2025"}, _BY_WEATHER),
)
BASE = (({"release": "res_2024_tmy3_1"}, "2024/resstock_dataset_2024.1/resstock_tmy3"), ({}, "{year}/{product}_{weather}_release_{version}"))
RULES = {"metadata": METADATA, "load_curve_annual": ANNUAL, "hpxml": MODELS, "schedule": MODELS, "load_curve_15min": CURVE, "weather": WEATHER}


def _fields() -> dict[str, Column]:
    suffix = F.when(F.col("weather") == "tmy3", "TMY3").otherwise(F.substring("weather", 4, 4))
    return {
        "word": upgrade_word(F.col("upgrade")), "upgrade2": pad_left(F.col("upgrade"), 2), "suffix": suffix, "suffix_lower": F.lower(suffix),
        "model": F.concat(F.lit("bldg"), pad_left(F.col("bldg_id"), 7), F.lit("-up"), pad_left(F.col("upgrade"), 2)),
    }


def _filled(template: str, fields: dict[str, Column]) -> Column:
    """Null if any field is."""
    parts = [fields[p[1:-1]] if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(*[p.cast("string") for p in parts])


def by_rules(rules: tuple, fields: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for wanted, template in reversed(rules):
        fits = F.lit(True)
        for name, value in wanted.items():
            fits = fits & fields[name].isin(*([value] if isinstance(value, str) else value))
        out = F.when(fits, _filled(template, fields)).otherwise(out)
    return out


def with_source_path(buildings: DataFrame, file_type: str, column: str = "source_path") -> DataFrame:
    """``buildings`` (with KEYS, and ``file_types`` if the release's offer is to be minded) with the file's path."""
    fields = {k: F.col(k) for k in KEYS if k in buildings.columns} | _fields()
    for k in KEYS:
        fields.setdefault(k, F.lit(None).cast("string"))
    fields["base"] = by_rules(BASE, fields)
    path = by_rules(RULES[file_type], fields)
    if "file_types" in buildings.columns:
        needed = MODEL_TYPES if file_type in MODEL_TYPES else (file_type,)
        path = F.when(F.size(F.array_except(F.array(*[F.lit(t) for t in needed]), "file_types")) == 0, path)
    return buildings.withColumn(column, path)


def lake_file(file_type: str) -> Column:
    """The file's name in the lake; columns as in KEYS."""
    id7 = F.concat(pad_left(F.col("bldg_id"), 7), F.lit("-up"), pad_left(F.col("upgrade"), 2))
    if file_type == "metadata":
        return F.lit("metadata.parquet")
    if file_type == "hpxml":
        return F.concat(id7, F.lit(".xml"))
    if file_type == "schedule":
        return F.concat(id7, F.lit("_schedule.csv"))
    if file_type == "trip_schedules":
        return F.lit("trip_schedules.parquet")
    if file_type == "weather":
        return F.concat(F.col("station"), F.lit(".csv"))
    if file_type == "load_curve_annual":  # the source's name, with upgrade00 for the baseline
        return F.regexp_replace(F.element_at(F.split("source_path", "/"), -1), "_baseline_", "_upgrade00_")
    return F.concat(F.col("bldg_id").cast("string"), F.lit("-"), F.col("upgrade").cast("string"), F.lit(".parquet"))


def lake_place(file_type: str) -> Column:
    """The file's path below the lake's root: release, file type, state and upgrade folders, then ``lake_file``."""
    folders = [F.col("release"), F.lit(file_type), F.concat(F.lit("state="), F.col("state"))]
    if file_type != "trip_schedules":
        folders.append(F.concat(F.lit("upgrade="), pad_left(F.col("upgrade"), 2)))
    return F.concat(*[part for f in folders for part in (f, F.lit("/"))], lake_file(file_type))


#: A building's model files need the release to offer all of these.
MODEL_TYPES = ("hpxml", "schedule")


def with_county(buildings: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``county`` from the building index, by release and id; '' if the building is not in it."""
    on = {"product": "product", "year": "release_year", "weather": "weather_file", "version": "release_version", "state": "state", "bldg_id": "bldg_id"}
    own = index.select(*[F.col(v).alias(f"__{k}") for k, v in on.items()], F.col("county").alias("__county")).dropDuplicates([f"__{k}" for k in on])
    cond = F.lit(True)
    for k in on:
        cond = cond & (F.col(k) == F.col(f"__{k}"))
    joined = buildings.join(own, cond, "left")
    return joined.withColumn("county", F.coalesce("__county", F.lit(""))).drop("__county", *[f"__{k}" for k in on])


def source_glob(file_type: str, key: str, parts: tuple[str, str, str, str], upgrade: int = 0) -> str | None:
    """A release's files of a type for all states and counties, as a path pattern; None if there are none."""
    product, year, weather, version = parts
    row = {"release": key, "product": product, "year": year, "weather": weather, "version": version}
    fits = lambda wanted: all(row[k] in ((v,) if isinstance(v, str) else v) for k, v in wanted.items())
    base = next(t for wanted, t in BASE if fits(wanted)).format(**row)
    found = next((t for wanted, t in RULES[file_type] if fits(wanted)), None)
    word = "baseline" if upgrade == 0 else f"upgrade{upgrade:02d}"
    return found and found.format(base=base, word=word, upgrade=upgrade, upgrade2=f"{upgrade:02d}", state="*", county="*", bldg_id="*", model="*", station="*", suffix="*", suffix_lower="*", weather=weather)


def with_station(buildings: DataFrame, stations: DataFrame) -> DataFrame:
    """Adds ``station`` from the weather map; null if the building is not in it."""
    on = {"product": "product", "year": "release_year", "weather": "weather_file", "version": "release_version", "bldg_id": "bldg_id"}
    own = stations.select(*[F.col(v).alias(f"__{k}") for k, v in on.items()], F.col("weather_station_name").alias("station")).distinct()
    cond = F.lit(True)
    for k in on:
        cond = cond & (F.col(k) == F.col(f"__{k}"))
    return buildings.join(own, cond, "left").drop(*[f"__{k}" for k in on])
