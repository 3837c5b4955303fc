"""Roll-ups, merges, checks, jobs, streams and archives on small tables."""

import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wattloom import errors
from wattloom.operators import checks, merge, project, timeagg
from wattloom.plans import ingest
from wattloom.sources.catalog import Catalogue, parse_key, upgrade_table
from wattloom.streaming.rollup import rollup_stream


def readings(spark):
    rows = [(1, f"2025-01-01 0{h}:{m}:00", 1.0, 1.0, 5.0 if m == "15" else None) for h, m in ((0, "15"), (0, "30"), (0, "45"), (1, "00"))]
    return spark.createDataFrame(rows, "bldg_id long, t string, `out.a.energy..kwh` double, `out.temp` double, `in.x` double").select("bldg_id", F.col("t").cast("timestamp_ntz").alias("timestamp"), "`out.a.energy..kwh`", "`out.temp`", "`in.x`")


RULES = {"out.a.energy..kwh": "sum", "out.temp": "mean", "in.x": "first"}


def test_hour_ends_with_its_last_reading(spark):
    (row,) = timeagg.aggregate(readings(spark), RULES, "hourly").collect()
    assert str(row["timestamp"]) == "2025-01-01 00:00:00"
    assert (row["out.a.energy..kwh"], row["out.temp"], row["in.x"], row["hour"], row["day"]) == (4.0, 1.0, 5.0, 0, 1)


def test_sum_of_nulls_is_zero_mean_is_null_first_keeps_null(spark):
    nulls = readings(spark).withColumns({c: F.lit(None).cast("double") for c in ()}).select("bldg_id", "timestamp", *[F.lit(None).cast("double").alias(c) for c in RULES])
    (row,) = timeagg.aggregate(nulls, RULES, "monthly").collect()
    assert (row["out.a.energy..kwh"], row["out.temp"], row["in.x"], row["year"], row["month"]) == (0.0, None, None, 2025, 1)


def test_rules_are_checked(spark, tmp_path):
    with pytest.raises(errors.UnknownAggregation):
        timeagg.check_rules({"a": "median"})
    with pytest.raises(errors.UnruledColumns, match="out.temp"):
        timeagg.aggregate(readings(spark), {"out.a.energy..kwh": "sum", "in.x": "first"}, "daily")
    (tmp_path / "r.csv").write_text("name,Aggregate_function\ntimestamp,first\nout.temp,mean\n")
    assert timeagg.load_rules(spark, str(tmp_path / "r.csv")) == {"out.temp": "mean"}


def test_stream_agrees_with_batch(spark, tmp_path):
    late = spark.createDataFrame([(1, "2025-01-03 00:15:00", 0.0, 0.0, 0.0)], "bldg_id long, t string, `out.a.energy..kwh` double, `out.temp` double, `in.x` double").select("bldg_id", F.col("t").cast("timestamp_ntz").alias("timestamp"), "`out.a.energy..kwh`", "`out.temp`", "`in.x`")
    source = str(tmp_path / "in")
    for part in (readings(spark), late, late):  # the second late reading lets the watermark pass
        part.write.mode("append").parquet(source)
    stream = spark.readStream.schema(readings(spark).schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = rollup_stream(stream, RULES, "hourly").writeStream.outputMode("append").format("memory").queryName("rolled").start()
    q.processAllAvailable()
    q.stop()
    (row,) = spark.table("rolled").where("timestamp < '2025-01-02'").collect()
    assert str(row["timestamp"]) == "2025-01-01 00:00:00" and row["out.a.energy..kwh"] == 4.0


def test_a_run_to_the_end_counts_rows_that_come_out_of_order(spark, tmp_path):
    from wattloom.streaming.rollup import run_to_end

    for k, day in enumerate((20, 3, 11)):  # a file a batch, the later days first
        spark.sql(f"select bigint(1) bldg_id, timestamp_ntz '2022-01-{day:02d} 00:15:00' timestamp, double({day}) kwh").coalesce(1).write.parquet(f"{tmp_path}/{k}")
    stream = spark.readStream.schema("bldg_id long, timestamp timestamp_ntz, kwh double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path))
    out = run_to_end(rollup_stream(stream, {"kwh": "sum"}, "daily", late=None), ("bldg_id", "timestamp"))
    assert sorted((r["timestamp"].day, r["kwh"]) for r in out.collect()) == [(3, 3.0), (11, 11.0), (20, 20.0)]


def test_ids_bound_the_scan(spark, tmp_path):
    from wattloom.sources import lake

    spark.range(5000).select(F.col("id").alias("bldg_id"), F.lit(1).alias("x")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))

    def pushed(out):
        return out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")

    few = lake.with_ids(df, [7, 3, 4990])
    assert sorted(r["bldg_id"] for r in few.collect()) == [3, 7, 4990] and "In(bldg_id" in pushed(few)
    many = lake.with_ids(df, range(100, 1100, 2))
    assert many.count() == 500 and "GreaterThanOrEqual(bldg_id,100)" in pushed(many) and "LessThanOrEqual(bldg_id,1098)" in pushed(many)
    assert lake.with_ids(df, []).count() == 0 and lake.with_ids(df, None).count() == 5000
    assert lake.with_ids(df, spark.range(3).select(F.col("id").alias("bldg_id"))).count() == 3


def test_projections(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 2.0, 3.0, "m", "c", "s")], "bldg_id long, upgrade int, weight double, `in.sqft` double, `out.kwh` double, `upgrade.name` string, `in.county` string, other string")
    assert project.compact_metadata(df).columns == ["bldg_id", "upgrade", "weight", "in.sqft", "upgrade.name", "in.county"]
    assert project.compact_annual(df).columns == ["bldg_id", "upgrade", "weight", "out.kwh"]
    assert project.first_available(df.columns) == {"county": "in.county", "bldg_id": "bldg_id"}
    assert project.with_constants(df, a=1, b=None).columns[-1] == "a"


def test_merge_replaces_the_path_it_reads(spark, tmp_path):
    path = str(tmp_path / "lake")
    first = spark.createDataFrame([(1, "NY", 0, 1.0), (2, "NY", 0, 2.0)], "bldg_id long, state string, upgrade int, weight double")
    second = spark.createDataFrame([(2, "NY", 0, 2.0), (3, "AL", 4, 3.0)], first.schema)
    ingest.metadata_job(first, path)
    ingest.metadata_job(second.withColumn("out.x", F.lit(1)), path)
    assert sorted(r["bldg_id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    ingest.annual_job(second.withColumns({"out.x": F.lit(1.0), "in.y": F.lit(2.0)}), str(tmp_path / "annual"), ids=[3])
    assert spark.read.parquet(str(tmp_path / "annual")).columns == ["bldg_id", "weight", "out.x", "state", "upgrade"]


def test_merge_rewrites_touched_partitions_only(spark, tmp_path):
    path = tmp_path / "lake"
    first = spark.createDataFrame([(1, "NY", 0), (2, "AL", 0)], "bldg_id long, state string, upgrade int")
    merge.merge_partitions(first, str(path), ("state", "upgrade"))
    before = {p.name: p.stat().st_mtime_ns for p in (path / "state=NY" / "upgrade=0").iterdir()}
    merge.merge_partitions(spark.createDataFrame([(2, "AL", 0), (3, "AL", 0), (4, "TX", 4)], first.schema), str(path), ("state", "upgrade"))
    assert {p.name: p.stat().st_mtime_ns for p in (path / "state=NY" / "upgrade=0").iterdir()} == before
    assert sorted((r["bldg_id"], r["state"]) for r in spark.read.parquet(str(path)).collect()) == [(1, "NY"), (2, "AL"), (3, "AL"), (4, "TX")]
    merge.merge_partitions(first.limit(0), str(path), ("state", "upgrade"))
    assert spark.read.parquet(str(path)).count() == 4 and sorted(p.name for p in tmp_path.iterdir()) == ["lake"]


def test_a_path_that_is_read_is_replaced(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    merge.replace_path(spark.read.parquet(f"{tmp_path}/t").where("id > 0"), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_a_large_partition_is_written_by_several_tasks(spark, tmp_path):
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        rows = spark.range(0, 200_000, 1, 8).select("id", F.md5(F.col("id").cast("string")).alias("x"), F.when(F.col("id") % 100 > 0, "NY").otherwise("AL").alias("state"))
        merge.write_partitioned(rows, str(tmp_path / "t"), ("state",), ("id",))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    files = {s: len(list((tmp_path / "t" / f"state={s}").glob("*.parquet"))) for s in ("NY", "AL")}
    assert files["NY"] > 1 and files["AL"] <= files["NY"]
    assert spark.read.parquet(str(tmp_path / "t")).distinct().count() == 200_000


def test_steps_from_parts_are_those_from_readings(spark):
    rows = [(b, f"2022-01-{d:02d} {h:02d}:{m:02d}:00", v, v, e) for b, d, h, m, v, e in [(1, 1, 0, 15, 1.0, "a"), (1, 1, 0, 30, None, None), (1, 1, 23, 45, 3.0, "b"), (1, 2, 0, 0, 5.0, "c"), (2, 31, 5, 0, None, "d"), (2, 31, 5, 15, None, "e")]]
    df = spark.createDataFrame(rows, "bldg_id long, t string, s double, m double, f string").select("bldg_id", F.to_timestamp_ntz("t").alias("timestamp"), "s", "m", "f")
    rules = {"s": "sum", "m": "mean", "f": "first"}
    for step, out in timeagg.all_steps(df, rules, ("hourly", "daily", "monthly")).items():
        want = timeagg.aggregate(df, rules, step)
        assert sorted(map(tuple, out.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_the_load_curve_job_scans_its_readings_once(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = spark.range(100).select(F.lit(1).alias("bldg_id"), F.expr("timestamp_ntz '2022-01-01 00:15:00' + make_dt_interval(0, 0, 15 * cast(id as int))").alias("timestamp"), F.lit(1.0).alias("x"), F.lit("NY").alias("state"), F.lit(0).alias("upgrade"))
    rows.write.parquet(path)
    reads = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: (reads.add(1), x)[1], "double")
    counted = spark.read.parquet(path).withColumn("x", seen("x"))
    ingest.load_curve_job(counted, {"x": "sum"}, str(tmp_path / "out"))
    assert reads.value == 100
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["load_curve_daily", "load_curve_hourly", "load_curve_monthly"]
    assert {r["x"] for r in spark.read.parquet(str(tmp_path / "out" / "load_curve_daily")).collect()} == {96.0, 4.0}


def test_stations_are_parsed(spark):
    from wattloom.sources.archives import first_station

    assert first_station("<a><!-- <WeatherStation><Name>OLD</Name></WeatherStation> --><b:WeatherStation><b:Name> A &amp; B </b:Name></b:WeatherStation></a>") == "A & B"
    assert first_station("<a><WeatherStation><x/></WeatherStation><WeatherStation><Name>N</Name></WeatherStation></a>") == "N"
    assert [first_station(x) for x in (None, "", "<a>", "<a/>", "<WeatherStation><y><Name>deep</Name></y></WeatherStation>")] == [""] * 5


def test_jobs_from_a_shell(spark, tmp_path):
    from wattloom.cli import main

    raw = spark.createDataFrame([(1, "New York", "c1", "p1"), (2, "TX", "c2", "p2")], "bldg_id long, `in.state` string, `in.county` string, `in.puma` string")
    raw.write.parquet(f"{tmp_path}/land/2021/resstock_tmy3_release_1/metadata/metadata.parquet")
    (tmp_path / "catalogue.json").write_text('{"res_2021_tmy3_1": {"upgrade_ids": ["0"], "available_data": ["metadata"]}, "res_2022_tmy3_1": {"upgrade_ids": ["0"], "available_data": []}}')
    main(["index", f"{tmp_path}/land", f"{tmp_path}/catalogue.json", f"{tmp_path}/index"], spark)
    assert sorted((r["bldg_id"], r["state"], r["product"]) for r in spark.read.parquet(f"{tmp_path}/index").collect()) == [(1, "NY", "resstock"), (2, "TX", "resstock")]
    main(["buildings", f"{tmp_path}/index", "res_2021_tmy3_1", "NY"], spark)
    trips = spark.createDataFrame([(1, 1, "res_2021_tmy3_1", "NY")], "bldg_id long, vehicle_id int, release string, state string")
    trips.write.parquet(f"{tmp_path}/trips")
    main(["trips", f"{tmp_path}/trips", f"{tmp_path}/out/trips"], spark)
    assert spark.read.parquet(f"{tmp_path}/out/trips").count() == 1
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("in.xml", "<a><WeatherStation><Name>JFK</Name></WeatherStation></a>")
    (tmp_path / "zips").mkdir()
    (tmp_path / "zips" / "bldg0000001-up00.zip").write_bytes(data.getvalue())
    main(["weather-map", f"{tmp_path}/zips", "res_2021_tmy3_1", f"{tmp_path}/map"], spark)
    assert [r["weather_station_name"] for r in spark.read.parquet(f"{tmp_path}/map").collect()] == ["JFK"]
    landed = spark.createDataFrame([(1, "NY", 0, 1.0)], "bldg_id long, state string, upgrade int, `out.kwh` double")
    landed.write.parquet(f"{tmp_path}/landed")
    for job in ("metadata", "annual"):
        main([job, f"{tmp_path}/landed", f"{tmp_path}/lake/{job}"], spark)
        assert spark.read.parquet(f"{tmp_path}/lake/{job}").count() == 1


def test_vehicles_from_a_shell(spark, tmp_path):
    from wattloom.cli import main

    meta = [(i, 1.0, "urban" if i % 2 else "rural", "G3600001" if i % 2 else "G3600002", f"{i % 9}0000-{i % 9}9999", str(i % 4 + 1), "NY") for i in range(1, 30)]
    spark.createDataFrame(meta, "bldg_id long, weight double, `in.puma_metro_status` string, `in.puma` string, `in.income` string, `in.occupants` string, `in.state` string").write.parquet(f"{tmp_path}/meta")
    (tmp_path / "households.csv").write_text("PUMA,HINCP,NP,VEH,WGTP\n" + "".join(f"0000{i % 2 + 1},{i * 3000},{i % 4 + 1},{'b' if i % 9 == 0 else i % 3},1\n" for i in range(1, 40)))
    (tmp_path / "trips.csv").write_text("VEHCASEID,CENSUS_D,HHFAMINC,HHSIZE,HHVEHCNT,TDWKND,STRTTIME,ENDTIME,TRPMILES,WTTRDFIN,URBRUR,VEHID\n" + "".join(f"v{i % 9},2,{i % 9 + 1},{i % 4 + 1},{i % 2 + 1},{i % 2 + 1},800,1700,{i}.5,1.0,1,1\n" for i in range(40)))
    main(["vehicles", f"{tmp_path}/meta", f"{tmp_path}/households.csv", f"{tmp_path}/trips.csv", "NY", "res_2022_tmy3_1", f"{tmp_path}/out", "--start", "2022-01-01", "--end", "2022-01-07"], spark)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() > 20 and out.where("departure_hour not between 0 and 23").count() == 0


@pytest.mark.parametrize("order", ["l_quantity", "-l_quantity"])
def test_the_first_item_is_the_same_however_rows_come_in(spark, tmp_path, order):
    from wattloom.queries import dedup_keep_first

    rows = [(k, n, 7, float(q)) for k in range(20) for n in (1, 2) for q in (5, 10)]
    items = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double")
    items.coalesce(1).sortWithinPartitions(F.expr(order)).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(map(tuple, dedup_keep_first(spark, str(tmp_path)).collect())) == [(k, 1, 7, 10.0) for k in range(20)]


def test_old_rows_win(spark):
    old, new = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "old")], [(1, "new"), (2, "b"), (2, "a")]))
    assert sorted(map(tuple, merge.upsert_old_wins(old, new, ("k",), [F.col("v")]).collect())) == [(1, "old"), (2, "a")]


def test_checks(spark):
    df = spark.createDataFrame([("1", 1.0), (None, None), ("3", None)], "bldg_id string, x double")
    assert tuple(checks.null_counts(df).first()) == (1, 2, 3)
    with pytest.raises(errors.NullInputs):
        checks.require_no_nulls(df, ["x"])
    assert [r[0] for r in checks.valid_ids(df).collect()] == [1, 3]
    with pytest.raises(errors.InvalidIds):
        checks.valid_ids(df.withColumn("bldg_id", F.lit("x")))
    whole, dropped = checks.drop_nulls(df, ["x"])
    assert whole.count() == 1 and df.agg(dropped).first()[0] == 2
    assert checks.is_unique(df, "x").first()["is_unique"] is False


def test_building_index(spark, tmp_path):
    raw = spark.createDataFrame([(1, "New%20York", "c1", "p1"), (1, "New York", "c1", "p1"), (2, "TX", "c2", "p2")], "bldg_id long, `in.state` string, `in.county` string, `in.puma` string")
    index = ingest.building_index(raw, "resstock", "2022", "tmy3", "1")
    assert sorted((r["bldg_id"], r["state"]) for r in index.collect()) == [(1, "NY"), (2, "TX")]
    ingest.write_building_index(index, str(tmp_path / "index"))
    from wattloom.sources.lake import list_buildings

    back = spark.read.option("basePath", str(tmp_path / "index")).parquet(str(tmp_path / "index"))
    back = back.withColumns({c: F.col(c).cast("string") for c in ("release_year", "release_version")})
    assert [r["bldg_id"] for r in list_buildings(back, parse_key("res_2022_tmy3_1"), "NY").collect()] == [1]
    assert list_buildings(back, parse_key("res_2022_tmy3_1"), "CA").count() == 0


def test_trip_jobs_keep_all_trips(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 8, "r", "NY"), (1, 1, 9, "r", "NY")], "bldg_id long, vehicle_id int, departure_hour int, release string, state string")
    path = str(tmp_path / "trips")
    ingest.trips_job(rows.limit(1), path)
    ingest.trips_job(rows, path, ids=[1])
    assert spark.read.parquet(path).count() == 2


def test_stations_from_archives(spark, tmp_path):
    for n, xml in ((1, "<a><b:WeatherStation><Name>JFK</Name></b:WeatherStation></a>"), (2, "<a/>")):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("in.xml", xml)
        (tmp_path / f"state=NY_bldg000000{n}-up00.zip").write_bytes(data.getvalue())
    (tmp_path / "bldg0000003-up00.zip").write_bytes(b"broken")
    found = ingest.weather_map(spark, str(tmp_path), {"product": "resstock"})
    assert {r["bldg_id"]: r["weather_station_name"] for r in found.collect()} == {1: "JFK", 2: "", 3: ""}


RELEASES = '{"res_2022_tmy3_1": {"upgrade_ids": ["0", "4"], "available_data": ["metadata"]}, "com_2024_amy2018_1": {"upgrade_ids": ["0"], "available_data": ["metadata", "weather"], "trip_schedule_states": ["NY"]}}'


def test_catalogue(spark):
    c = Catalogue.load(RELEASES, '{"res_2022_tmy3_1": {"upgrade_descriptions": {"4": "walls"}}}')
    assert len(c) == 2 and c["res_2022_tmy3_1"].upgrades == {0: None, 4: "walls"}
    assert c.one(product="comstock").key == "com_2024_amy2018_1"
    assert c.filter(file_types=["weather"], states=["NY"]).facet("key") == ["com_2024_amy2018_1"]
    assert c.facet("weather") == ["tmy3", "amy2018"] and c.facet("upgrades") == [0, 4]
    with pytest.raises(errors.MoreThanOneRelease):
        c.one(file_types=["metadata"])
    with pytest.raises(errors.NoReleasesLeft):
        c.one(year="2025")
    with pytest.raises(errors.UnknownName):
        parse_key("res_1999_tmy3_1")
    assert c.as_table(spark).count() == 2 and upgrade_table(c, spark).where("description is null").count() == 2


def test_source_listing(spark):
    paths = spark.createDataFrame([("x/2024/resstock_tmy3_release_2/building_energy_models/upgrade=4/a.zip",), ("x/2024/resstock_tmy3_release_2/weather/state=NY/b.csv",), ("x/other/z",)], "path string")
    (row,) = ingest.available_files(paths).collect()
    assert tuple(row) == ("res_2024_tmy3_2", ["hpxml", "schedule", "weather"], [0, 4])
    by = ingest.files_by_upgrade(spark.createDataFrame([("a/baseline.parquet",), ("a/upgrade04.parquet",), ("b/upgrade_4/c",), ("q",)], "path string"))
    assert sorted(map(tuple, by.collect())) == [(0, "a/baseline.parquet"), (4, "a/upgrade04.parquet"), (4, "b/upgrade_4/c")]


def test_stream_goes_to_a_table_of_the_shared_folder(spark, tmp_path):
    from pathlib import Path

    from wattloom.streaming.rollup import rollup_stream, run_to_end

    schema = "bldg_id long, timestamp timestamp_ntz, kwh double"
    for k in (1, 2):
        rows = [(b, datetime(2022, 1, 1, 1, 15 * k), float(10 * k + b)) for b in (1, 2)] + [(9, datetime(2022, 1, 1, 5, 15 * k), 1.0)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    (tmp_path / "none").mkdir()
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(root.glob("*"))

    def rolled(path):
        own = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
        out = run_to_end(rollup_stream(own, {"kwh": "sum"}, "hourly", late="10 hours"), ("bldg_id", "timestamp"))
        return {(r["bldg_id"], r["timestamp"].hour): r["kwh"] for r in out.collect()}

    assert rolled(f"{tmp_path}/in") == {(1, 1): 32.0, (2, 1): 34.0, (9, 5): 2.0}
    (own,) = set(root.glob("*")) - before
    assert len(list(own.glob("table/__batch=[01]/*.parquet"))) >= 2 and (own / "state/offsets").is_dir()
    assert rolled(f"{tmp_path}/none") == {}
