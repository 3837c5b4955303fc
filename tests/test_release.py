"""Model archives as tables, all types of a release in one job, and every case of the source's layouts."""

import io
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattloom import errors
from wattloom.plans import paths, scenario
from wattloom.plans.release import release_job
from wattloom.sources import models
from wattloom.sources.catalog import Release
from wattloom.sources.lake import Lake

FIELDS = {"area": ("Building/Size/Area", "double"), "fuel": ("Building/System/Fuel", "string")}


def packed(**files) -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name.replace("_dot_", "."), text)
    return data.getvalue()


def model(area: str, fuels: tuple[str, ...] = (), station: str = "JFK") -> str:
    systems = "".join(f"<System><Fuel unit='x'>{f}</Fuel></System>" for f in fuels)
    return f"<HPXML xmlns='http://h'><h:Building xmlns:h='http://h'><!-- <Size/> --><Size><Area>{area}</Area></Size>{systems}</h:Building><WeatherStation><Name>{station} &amp; co</Name></WeatherStation></HPXML>"


def zips(spark, *contents):
    return spark.createDataFrame([(f"/m/bldg{i:07d}-up04.zip", c) for i, c in enumerate(contents)], "path string, content binary")


def test_models_are_typed_rows(spark):
    cut = packed(in_dot_xml=model("9"))[:60]
    own = models.models(zips(spark, packed(in_dot_xml=model("12.5", ("", " gas ", "oil"))), packed(in_dot_xml=model("large")), packed(in_dot_xml="<a><b></a>"), packed(other_dot_txt="x"), b"broken", cut, packed(in_dot_xml="")), FIELDS)
    rows = [tuple(r)[1:] for r in own.orderBy("path").collect()]
    assert rows == [(True, "JFK & co", 12.5, "gas"), (True, "JFK & co", None, None), *[(False, "", None, None)] * 5]
    assert [t for _, t in own.dtypes] == ["string", "boolean", "string", "double", "string"]


def test_the_fields_of_a_model_may_be_any(spark):
    own = models.models(zips(spark, packed(in_dot_xml="<a><x.y><z>3</z></x.y><x.y><z>4</z></x.y></a>")), {"path count": ("x.y/z", "int"), "none": ("q/r/s", "int")})
    assert tuple(own.collect()[0])[1:] == (True, "", 3, None)
    assert models.models(zips(spark, b"").limit(0), FIELDS).count() == 0
    assert tuple(models.models(zips(spark, None), {}).collect()[0])[1:] == (False, "")


def test_schedules_are_rows(spark, monkeypatch):
    monkeypatch.setattr(models, "LINES", 3)
    text = "heat,note,n\n" + "".join(f'{i / 2},"a, b",{i}\n' for i in range(7)) + "x\n"
    good = packed(my_schedules_dot_csv=text, in_dot_xml="<a/>")
    damaged = bytearray(packed(schedule_dot_csv="heat\n" + "1.5\n" * 5000))
    damaged[45] ^= 255
    own = models.schedules(zips(spark, good, bytes(damaged), b"broken", packed(in_dot_xml="<a/>"), packed(schedule_dot_csv=""), None), {"heat": "double", "n": "long", "lacking": "string"})
    rows = [tuple(r) for r in own.orderBy("path", "line").collect()]
    assert rows == [("/m/bldg0000000-up04.zip", i, i / 2, i, None) for i in range(7)] + [("/m/bldg0000000-up04.zip", 7, None, None, None)]


def landing(spark, tmp_path) -> str:
    base = tmp_path / "landing" / "2022" / "resstock_tmy3_release_1"
    for upgrade, word in ((0, "baseline"), (4, "upgrade04")):
        meta = base / "metadata_and_annual_results" / "by_state" / "state=NY" / "parquet"
        meta.mkdir(parents=True, exist_ok=True)
        rows = spark.createDataFrame([(b, upgrade, b * 1.0, "c", b * 2.0) for b in (1, 2, 3)], "bldg_id long, upgrade int, weight double, `in.county` string, `out.kwh` double")
        rows.toPandas().to_parquet(meta / f"NY_{word}_metadata_and_annual_results.parquet")
        curve, zipped = base / "timeseries_individual_buildings" / "by_state" / f"upgrade={upgrade}" / "state=NY", base / "building_energy_models" / f"upgrade={upgrade}"
        curve.mkdir(parents=True)
        zipped.mkdir(parents=True)
        for b in (1, 2, 3):
            times = [datetime(2018, 1, 1) + timedelta(minutes=15 * (i + 1)) for i in range(8)]
            spark.createDataFrame([(t, float(b + upgrade)) for t in times], "timestamp timestamp, kwh double").toPandas().to_parquet(curve / f"{b}-{upgrade}.parquet", coerce_timestamps="us")
            (zipped / f"bldg{b:07d}-up{upgrade:02d}.zip").write_bytes(packed(in_dot_xml=model(str(b)), schedule_dot_csv="heat\n1\n2\n"))
    weather = base / "weather" / "state=NY"
    weather.mkdir(parents=True)
    (weather / "G36_TMY3.csv").write_text("hour,temp\n0,1.5\n1,2.5\n")
    spark.createDataFrame([("res_2022_tmy3_1", "NY", str(b), "t") for b in (1, 9)], "release string, state string, bldg_id string, trip string").write.parquet(f"{tmp_path}/landing/trip_schedules")
    return f"{tmp_path}/landing"


def test_all_types_of_a_release(spark, tmp_path, monkeypatch):
    source, release, root = landing(spark, tmp_path), Release("res_2022_tmy3_1", {0: None, 4: None}), f"{tmp_path}/lake"
    wanted = spark.createDataFrame([(1, "NY", 0), (1, "NY", 4), (2, "NY", 0)], "bldg_id long, state string, upgrade int")
    types = ["metadata", "load_curve_annual", "load_curve_15min", "load_curve_hourly", "load_curve_daily", "hpxml", "schedule", "trip_schedules", "weather"]

    def run(file_types, buildings=wanted):
        return release_job(spark, source, release, root, buildings, file_types, {"kwh": "sum"}, FIELDS, {"heat": "double"})

    assert sorted(run(types)) == sorted(types)
    lake = Lake(spark, root, release)

    def whole():
        keys = {t: sorted({(r["bldg_id"], r["upgrade"]) for r in lake.read(t).collect()}) for t in types[:7]}
        assert all(k == [(1, 0), (1, 4), (2, 0)] for k in keys.values()), keys
        assert [lake.read(t).count() for t in types[:7]] == [3, 3, 24, 6, 3, 3, 6]

    whole()
    assert sorted(r["kwh"] for r in lake.load_curve("hourly").collect()) == [4.0, 4.0, 8.0, 8.0, 20.0, 20.0]
    assert sorted((r["bldg_id"], r["upgrade"], r["area"]) for r in lake.read("hpxml").collect()) == [(1, 0, 1.0), (1, 4, 1.0), (2, 0, 2.0)]
    assert [tuple(r) for r in spark.read.parquet(f"{root}/{release.key}/trip_schedules").select("bldg_id", "trip").collect()] == [("1", "t")]
    assert sorted(map(tuple, spark.read.parquet(f"{root}/{release.key}/weather").select("station", "hour", "temp").collect())) == [("G36", "0", "1.5"), ("G36", "1", "2.5")]
    monkeypatch.setattr("wattloom.plans.release.NAMED", 1)  # more buildings than a filter names
    run(["metadata", "load_curve_15min", "hpxml", "schedule"])
    whole()  # a second run changes nothing
    assert run(["hpxml"], spark.createDataFrame([(3, "NY", 4)], wanted.schema)) == ["hpxml"]
    assert Lake(spark, root, release).read("hpxml").count() == 4
    with pytest.raises(errors.UnknownName):
        run(["maps"])


def test_types_that_have_not_landed_are_left_out(spark, tmp_path):
    wanted = spark.createDataFrame([(1, "NY", 0)], "bldg_id long, state string, upgrade int")
    assert release_job(spark, str(tmp_path), Release("res_2022_tmy3_1", {0: None}), f"{tmp_path}/lake", wanted, ["metadata", "load_curve_15min", "hpxml", "weather", "trip_schedules"]) == []


PRODUCTS = {"res": "resstock", "com": "comstock"}


def source(spark, key: str, file_type: str, upgrade: int = 4, station: str | None = "G36") -> str | None:
    short, year, weather, version = key.split("_")
    row = spark.createDataFrame([(key, PRODUCTS[short], year, weather, version, 7, upgrade, "NY", "G360", station)], ", ".join(f"{k} {'int' if k in ('bldg_id', 'upgrade') else 'string'}" for k in paths.KEYS))
    return paths.with_source_path(row, file_type).first()["source_path"]


# Where the data sets have their weather files.
WEATHER = [
    ("res_2021_tmy3_1", "2021/resstock_tmy3_release_1/weather/tmy3/G36_tmy3.csv"),
    ("res_2021_amy2018_1", "2021/resstock_amy2018_release_1/weather/amy2018/G36_2018.csv"),
    ("com_2021_amy2012_1", "2021/comstock_amy2012_release_1/weather/amy2012/G36_2012.csv"),
    ("res_2022_tmy3_1", "2022/resstock_tmy3_release_1/weather/state=NY/G36_TMY3.csv"),
    ("res_2022_amy2018_1", "2022/resstock_amy2018_release_1/weather/state=NY/G36_2018.csv"),
    ("res_2022_amy2012_1", "2022/resstock_amy2012_release_1/weather/state=NY/G36_2012.csv"),
    ("com_2023_tmy3_1", "2023/comstock_tmy3_release_1/weather/tmy3/G36_TMY3.csv"),
    ("com_2023_amy2018_1", "2023/comstock_amy2018_release_1/weather/amy2018/G36_2018.csv"),
    ("com_2023_amy2012_1", "2023/comstock_amy2012_release_1/weather/amy2012/G36_2012.csv"),
    ("com_2024_amy2018_2", "2024/comstock_amy2018_release_2/weather/amy2018/G36_2018.csv"),
    ("res_2024_amy2018_2", "2024/resstock_amy2018_release_2/weather/state=NY/G36_2018.csv"),
    ("com_2024_tmy3_1", "2024/comstock_tmy3_release_1/weather/state=NY/G36_TMY3.csv"),
    ("res_2024_amy2012_2", "2024/resstock_amy2012_release_2/weather/state=NY/G36_2012.csv"),
    ("res_2025_tmy3_1", "2025/resstock_tmy3_release_1/weather/tmy3/G36_TMY3.csv"),
    ("com_2025_amy2018_1", "2025/comstock_amy2018_release_1/weather/amy2018/G36_2018.csv"),
    ("com_2025_amy2012_2", "2025/comstock_amy2012_release_2/weather/amy2012/G36_2012.csv"),
]


def test_every_case_of_weather_paths(spark):
    rows = [(k, PRODUCTS[k[:3]], *k.split("_")[1:], 7, 4, "NY", "G360", "G36", path) for k, path in WEATHER]
    kinds = ", ".join(f"{k} {'int' if k in ('bldg_id', 'upgrade') else 'string'}" for k in paths.KEYS)
    own = paths.with_source_path(spark.createDataFrame(rows, f"{kinds}, expected string"), "weather")
    assert own.where(~F.col("source_path").eqNullSafe(F.col("expected"))).count() == 0
    assert source(spark, "res_2022_tmy3_1", "weather", station=None) is None and source(spark, "res_2020_tmy3_1", "weather") is None


def test_the_models_of_a_release_without_upgrades_and_one_that_is_not_there(spark):
    assert source(spark, "res_2021_tmy3_1", "hpxml") is None and source(spark, "com_2023_amy2018_1", "hpxml") is None
    assert source(spark, "res_2021_tmy3_1", "load_curve_annual") is None
    assert source(spark, "res_2021_tmy3_1", "metadata") == "2021/resstock_tmy3_release_1/metadata/metadata.parquet"


def test_an_allocation_of_no_buildings_has_its_columns(spark):
    none = scenario.empty_allocation(spark)
    assert none.count() == 0 and set(none.columns) == {"bldg_id", "upgrade_id", "year"}
    assert scenario.adoption_counts(none).count() == 0
