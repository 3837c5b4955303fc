"""Scalar functions on the values that are known for them."""

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wattloom.functions import energy, names
from wattloom.plans.paths import with_source_path


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("state", "division"), [("NY", 2), ("CA", 9), ("TX", 7), ("FL", 5), ("IL", 3), ("OH", 3)])
def test_census_division(spark, state, division):
    assert one(spark, names.census_division(F.lit(state))) == division


@pytest.mark.parametrize(("income", "bucket"), [(5_000, 1), (9_999, 1), (10_000, 2), (50_000, 6), (150_000, 10), (200_000, 11), (250_000, 11), (None, None)])
def test_income_bucket(spark, income, bucket):
    assert one(spark, energy.income_bucket(F.lit(income).cast("long"))) == bucket


@pytest.mark.parametrize(("text", "middle"), [("60000-69999", 64_999), ("0-10000", 5_000), ("200000", 200_000), (None, None)])
def test_income_midpoint(spark, text, middle):
    assert one(spark, energy.income_midpoint(F.lit(text).cast("string"))) == middle


def test_open_income_labels(spark):
    assert [one(spark, energy.clean_income(F.lit(x))) for x in ("<10000", "200000+", "Not Available", "1-3")] == ["0-10000", "200000", None, "1-3"]


@pytest.mark.parametrize(("stamp", "step", "start"), [("2025-01-01 01:00:00", "hourly", "2025-01-01 00:00:00"), ("2025-01-01 00:00:00", "daily", "2024-12-31 00:00:00"), ("2025-01-01 00:14:00", "monthly", "2024-12-01 00:00:00"), ("2025-01-01 00:15:00", "monthly", "2025-01-01 00:00:00")])
def test_bucket_is_that_of_the_interval_start(spark, stamp, step, start):
    assert one(spark, energy.bucket(F.lit(stamp).cast("timestamp_ntz"), step)) == datetime.fromisoformat(start)


def test_battery(spark):
    assert [one(spark, energy.battery_for(F.lit(float(k)))) for k in (1, 10, 10.1, 33.4, 75, 99, 500)] == [12, 12, 40, 60, 90, 120, 120]


def test_miles_to_kwh_clips_temperature(spark):
    cold, colder = (one(spark, energy.miles_to_kwh(F.lit(10.0), F.lit(t))) for t in (-15.0, -80.0))
    assert cold == colder
    t = 70.0
    assert one(spark, energy.miles_to_kwh(F.lit(10.0), F.lit(t))) == pytest.approx(10 * sum(a * t**n for n, a in enumerate(energy.KWH_PER_MILE)))


def test_whole_target_truncates_doubles():
    assert energy.whole_target(0.29, 100) == 28


def test_names(spark):
    assert one(spark, names.pad_left(F.lit("12345678"), 7)) == "12345678"
    assert one(spark, names.pad_left(F.lit(4), 2)) == "04"
    assert [one(spark, names.state_code(F.lit(x))) for x in ("New%20York", "ny", " texas ", "Atlantis")] == ["NY", "NY", "TX", None]
    assert one(spark, names.upgrade_word(F.lit(0))) == "baseline" and one(spark, names.upgrade_word(F.lit(4))) == "upgrade04"
    assert [one(spark, names.upgrade_number(F.lit(x))) for x in ("04", "4", "x")] == [4, 4, None]
    assert [one(spark, names.is_canonical_upgrade(F.lit(x))) for x in ("0", "10", "04")] == [True, True, False]
    assert one(spark, names.s3_path(F.lit("https://data.s3.amazonaws.com/a/b.parquet"))) == "s3a://data/a/b.parquet"
    assert one(spark, names.puma_suffix(F.lit("G36012345"))) == "12345" and one(spark, names.puma_suffix(F.lit("123"))) == "123"
    assert len(names.STATES) == 49


def test_paths_by_release(spark):
    schema = "release string, product string, year string, weather string, version string, bldg_id bigint, upgrade int, state string, county string, station string"
    rows = [
        ("res_2024_tmy3_1", "resstock", "2024", "tmy3", "1", 7, 0, "NY", "G1", "S"),
        ("com_2024_amy2018_2", "comstock", "2024", "amy2018", "2", 7, 4, "NY", "G1", "S"),
        ("res_2022_tmy3_1", "resstock", "2022", "tmy3", "1", 7, 4, "NY", None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {ft: [r["source_path"] for r in with_source_path(df, ft).collect()] for ft in ("metadata", "hpxml", "weather", "load_curve_15min")}
    assert got["metadata"] == [
        "2024/resstock_dataset_2024.1/resstock_tmy3/metadata/baseline.parquet",
        "2024/comstock_amy2018_release_2/metadata_and_annual_results/by_state_and_county/full/parquet/state=NY/county=G1/NY_G1_upgrade04.parquet",
        "2022/resstock_tmy3_release_1/metadata_and_annual_results/by_state/state=NY/parquet/NY_upgrade04_metadata_and_annual_results.parquet",
    ]
    assert got["hpxml"][0] == "2024/resstock_dataset_2024.1/resstock_tmy3/model_and_schedule_files/building_energy_models/upgrade=0/bldg0000007-up00.zip"
    assert got["weather"][1:] == ["2024/comstock_amy2018_release_2/weather/amy2018/S_2018.csv", None]
    assert got["load_curve_15min"][2] == "2022/resstock_tmy3_release_1/timeseries_individual_buildings/by_state/upgrade=4/state=NY/7-4.parquet"


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 99), st.integers(1, 10**9), st.sampled_from(names.STATES))
def test_paths_parse_back(spark, upgrade, building, state):
    path = names.lake_path(F.lit("res_2022_tmy3_1"), F.lit("metadata"), F.lit(state), F.lit(upgrade), F.lit(f"{building}-{upgrade}.parquet"))
    parts = [names.path_part(path, p) for p in ("release", "file_type", "state", "upgrade", "file")]
    row = spark.range(1).select(*[p.alias(f"c{i}") for i, p in enumerate(parts)], names.building_of_file(parts[4]).alias("b")).first()
    assert tuple(row) == ("res_2022_tmy3_1", "metadata", state, upgrade, f"{building}-{upgrade}.parquet", building)
