"""Scenario rules, allocation and reads over a small lake."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wattloom import errors
from wattloom.plans import scenario
from wattloom.plans.scenario import ScenarioReader, slices, uniform_adoption, validate
from wattloom.sources.catalog import Release
from wattloom.sources.lake import Lake, manifest, matching

KEY = "res_2024_tmy3_2"


@pytest.mark.parametrize("good", [{4: [0.1, 0.2, 0.3], 8: [0.05, 0.10, 0.15]}, {0: [0, 0.5, 1]}, {4: [0.3, 0.4, 0.5], 8: [0.2, 0.3, 0.4]}, {4: [0.5, 0.6 + 1e-7], 8: [0.3, 0.4]}])
def test_valid(good):
    validate(good)


@pytest.mark.parametrize(
    ("bad", "said"),
    [
        ({}, "cannot be empty"), ({4: [0.1, -0.1, 0.3]}, r"must be in \[0, 1\]"), ({4: [0.1, 1.2, 0.3]}, r"must be in \[0, 1\]"),
        ({4: [0.3, 0.2, 0.4]}, "must be non-decreasing"), ({4: [0.6, 0.7, 0.8], 8: [0.5, 0.6, 0.7]}, "exceeds 1.0"),
        ({4: [0.1], 8: [0.1, 0.2]}, "same length"), ({4: [], 8: []}, "at least one year"), ({-1: [0.1]}, "non-negative integer"),
    ],
)
def test_invalid(bad, said):
    with pytest.raises(errors.InvalidScenario, match=said):
        validate(bad)


def test_uniform_adoption():
    got = uniform_adoption([4, 8], {4: 0.6, 8: 0.4}, [0.1, 0.3, 0.5])
    assert got == {4: pytest.approx([0.06, 0.18, 0.30]), 8: pytest.approx([0.04, 0.12, 0.20])}


@pytest.mark.parametrize(
    ("upgrades", "weights", "path", "said"),
    [
        ([4, 8], {4: 0.7, 8: 0.4}, [0.1, 0.3], "must sum to 1.0"), ([4, 8], {4: -0.2, 8: 1.2}, [0.1, 0.3], r"must be in \[0, 1\]"),
        ([4, 8], {4: 0.6, 8: 0.4}, [0.3, 0.2, 0.5], "must be non-decreasing"), ([4, 8], {4: 0.6, 9: 0.4}, [0.1, 0.3], "must match upgrade_ids"),
        ([], {}, [0.1, 0.3], "cannot be empty"), ([4, 8], {4: 0.6, 8: 0.4}, [], "cannot be empty"), ([-1, 8], {-1: 0.6, 8: 0.4}, [0.1, 0.3], "non-negative integer"),
    ],
)
def test_invalid_uniform_adoption(upgrades, weights, path, said):
    with pytest.raises(errors.InvalidScenario, match=said):
        uniform_adoption(upgrades, weights, path)


def test_reader_needs_a_scenario():
    with pytest.raises(ValueError, match="scenario parameter is required"):
        ScenarioReader(None, None)
    with pytest.raises(errors.InvalidScenario, match="must be non-decreasing"):
        ScenarioReader(None, {4: [0.3, 0.2]})
    with pytest.raises(ValueError, match="out of range"):
        scenario.check_years([3], 3)


@st.composite
def scenarios(draw):
    years, upgrades = draw(st.integers(1, 4)), draw(st.integers(1, 3))
    return {u + 1: sorted(draw(st.lists(st.floats(0, 1 / upgrades), min_size=years, max_size=years))) for u in range(upgrades)}


@settings(max_examples=200, deadline=None)
@given(scenarios(), st.integers(0, 300))
def test_slices_fill_targets_without_gaps(shares, total):
    table = slices(shares, total)
    at = 0
    for _, _, lo, hi in table:
        assert lo == at and hi > lo
        at = hi
    assert at <= total
    for upgrade, f in shares.items():
        for year, share in enumerate(f):
            assert sum(hi - lo for y, u, lo, hi in table if u == upgrade and y <= year) == math.trunc(share * total)


@pytest.fixture(scope="module")
def lake_root(spark, tmp_path_factory):
    """Five buildings in each of two states, upgrades 0, 4 and 8; upgrade 0 lacks the measure columns."""
    root = str(tmp_path_factory.mktemp("lake"))
    for upgrade in (0, 4, 8):
        for s, state in enumerate(("NY", "AL")):
            ids = spark.range(100 * s + 1, 100 * s + 6).select(F.col("id").alias("bldg_id"))
            meta = ids.withColumns({"weight": F.lit(2.0), "in.sqft": F.col("bldg_id") * 10.0})
            if upgrade:
                meta = meta.withColumn("upgrade.name", F.lit(f"measure {upgrade}"))
            where = f"state={state}/upgrade={upgrade:02d}"
            for kind, df, name in (("metadata", meta, "metadata.parquet"), ("load_curve_hourly", ids.withColumns({"timestamp": F.lit("2018-01-01 00:00:00").cast("timestamp_ntz"), "out.kwh": F.lit(float(upgrade)), "year": F.lit(2018)}), None)):
                if name:
                    df.coalesce(1).toPandas().to_parquet(_file(root, kind, where, name))
                else:
                    for row in df.collect():
                        one = spark.createDataFrame([row], df.schema).toPandas()
                        one.to_parquet(_file(root, kind, where, f"{row['bldg_id']}-{upgrade}.parquet"), coerce_timestamps="us")
    return root


def _file(root, kind, where, name):
    from pathlib import Path

    folder = Path(root, KEY, kind, where)
    folder.mkdir(parents=True, exist_ok=True)
    return folder / name


def lake(spark, root, **options):
    return Lake(spark, root, Release(KEY, dict.fromkeys((0, 4, 8))), **options)


def test_metadata_keeps_columns_that_some_files_lack(spark, lake_root):
    df = lake(spark, lake_root).metadata()
    assert df.count() == 30 and df.where("`upgrade.name` is null").count() == 10
    assert dict(df.dtypes)["upgrade"] == "bigint"


def test_filters_prune_partitions(spark, lake_root):
    df = lake(spark, lake_root, states=["ny"]).load_curve("hourly", upgrades=[4])
    assert df.count() == 5
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "state#" in plan.split("PartitionFilters")[1]


def test_empty_sets_give_no_rows(spark, lake_root):
    own = lake(spark, lake_root)
    assert own.metadata(upgrades=[]).count() == 0 and own.metadata(building_ids=[]).count() == 0
    assert own.metadata(upgrades=[4], building_ids=[1, 101, 999]).count() == 2


def test_errors_of_upgrades(spark, lake_root):
    with pytest.raises(errors.UpgradesNotInRelease):
        lake(spark, lake_root).metadata(upgrades=[5])
    own = Lake(spark, lake_root, KEY)
    with pytest.raises(errors.UpgradesNotFound, match="5"):
        own.metadata(upgrades=[5])
    with pytest.raises(errors.DataNotFound):
        own.load_curve("annual")


def test_sample_depends_on_the_seed_only(spark, lake_root):
    ids = lambda seed, n=4: sorted(r[0] for r in lake(spark, lake_root, sample_n=n, seed=seed).sampled_buildings().collect())
    assert ids(1) == ids(1) and len(ids(1)) == 4 and len(ids(1, 99)) == 10 and ids(1) != ids(2)
    assert lake(spark, lake_root, sample_n=4, seed=1).metadata().count() == 12


def test_manifest(spark, lake_root):
    files = manifest(spark, lake_root)
    assert files.count() == 36
    assert matching(files, file_type="metadata", state=["NY"], upgrade=4, release=KEY).count() == 1
    assert lake(spark, lake_root).buildings_on_disk("load_curve_hourly").count() == 30
    assert lake(spark, lake_root).upgrades("load_curve_hourly") == [0, 4, 8]


def test_scenario_reads_and_saves(spark, lake_root, tmp_path):
    reader = ScenarioReader(lake(spark, lake_root), {4: [0.2, 0.4], 8: [0.1, 0.3]}, seed=3)
    got = reader.read("load_curve_hourly")
    by = {(r["year"], r["upgrade_id"]): r["n"] for r in scenario.adoption_counts(got).collect()}
    assert by == {(0, 0): 7, (0, 4): 2, (0, 8): 1, (1, 0): 3, (1, 4): 4, (1, 8): 3}
    assert got.where("`out.kwh` <> upgrade_id").count() == 0 and "calendar_year" in got.columns
    first = {r["bldg_id"] for r in got.where("year = 0 and upgrade_id > 0").collect()}
    assert first <= {r["bldg_id"] for r in got.where("year = 1 and upgrade_id > 0").collect()}
    assert reader.missing("load_curve_hourly").count() == 0
    saved = reader.save("metadata", str(tmp_path / "out"), years=[1])
    assert spark.read.parquet(saved).groupBy("year").count().collect() == [(1, 10)]
    reader.export_wide(str(tmp_path / "wide"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "wide")).columns == ["bldg_id", "year_0", "year_1"]
    with pytest.raises(errors.YearOutOfRange):
        reader.read("metadata", years=[2])
    with pytest.raises(errors.UpgradesNotFound):
        ScenarioReader(Lake(spark, lake_root, KEY), {9: [0.5]}).read("metadata")


def test_lake_reads_what_the_jobs_write(spark, tmp_path):
    from wattloom.plans.ingest import load_curve_job, metadata_job

    root = f"{tmp_path}/lake"
    landed = spark.createDataFrame([(1, "NY", 0, 2.0), (2, "NY", 4, 2.0)], "bldg_id long, state string, upgrade int, weight double")
    metadata_job(landed, f"{root}/{KEY}/metadata")
    readings = landed.select("bldg_id", "state", "upgrade", F.lit("2018-01-01 00:15:00").cast("timestamp_ntz").alias("timestamp"), F.lit(1.0).alias("out.kwh"))
    load_curve_job(readings, {"out.kwh": "sum"}, f"{root}/{KEY}")
    own = Lake(spark, root, KEY)
    assert own.partitions("metadata") == [("NY", 0), ("NY", 4)] and own.metadata(upgrades=[4]).first()["bldg_id"] == 2
    assert own.load_curve("daily").count() == 2 and own.upgrades("load_curve_monthly") == [0, 4]
