"""Listings, landed files, resumed jobs, streams into the lake, and what a scenario lacks."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from wattloom import errors
from wattloom.operators import vehicles
from wattloom.plans import ingest, scenario
from wattloom.plans.scenario import ScenarioReader
from wattloom.sources import landed, listing
from wattloom.sources.catalog import Catalogue
from wattloom.sources.lake import Lake
from wattloom.sources.table import Table
from wattloom.streaming.landing import land

RELEASE = "res_2022_tmy3_1"
SCHEMA = "bldg_id long, state string, upgrade int, weight double"


def lake_of(spark, root, rows):
    ingest.metadata_job(spark.createDataFrame(rows, SCHEMA), f"{root}/{RELEASE}/metadata")
    return Lake(spark, str(root), RELEASE)


def test_nothing_is_missing_in_a_lake_that_the_jobs_wrote(spark, tmp_path):
    rows = [(b, "NY", u, 1.0) for b in range(10) for u in (0, 4)]
    lake = lake_of(spark, tmp_path, rows)
    reader = ScenarioReader(lake, {4: [0.3, 1.0]})
    assert reader.missing("metadata").count() == 0 and reader.read("metadata").count() == 20
    path = f"{tmp_path}/{RELEASE}/metadata"
    Table(spark, path, ("state", "upgrade")).replace(spark.createDataFrame([r for r in rows if r[:3] != (3, "NY", 4)], SCHEMA))
    assert [tuple(r) for r in reader.missing("metadata").collect()] == [(3, 4)]


def test_files_named_after_buildings_are_not_opened(spark, tmp_path):
    for b in (1, 2):
        folder = tmp_path / RELEASE / "load_curve_15min" / "state=NY" / "upgrade=00"
        folder.mkdir(parents=True, exist_ok=True)
        spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/w{b}")
        next((tmp_path / f"w{b}").glob("part-*.parquet")).rename(folder / f"{b}-0.parquet")
    lake = Lake(spark, str(tmp_path), RELEASE)
    assert sorted(map(tuple, lake.buildings_on_disk("load_curve_15min").collect())) == [(0, "NY", 1), (0, "NY", 2)]
    assert lake.buildings_on_disk("load_curve_15min").where("bldg_id = 1").count() == 1
    assert [tuple(r) for r in lake.row_counts("load_curve_15min").collect()] == [("NY", 0, 6)]
    assert "PushedAggregation: [COUNT(*)]" in lake._footer_counts("load_curve_15min")._sc._jvm.PythonSQLUtils.explainString(lake._footer_counts("load_curve_15min")._jdf.queryExecution(), "formatted")
    with pytest.raises(errors.DataNotFound):
        lake.row_counts("load_curve_daily")


def test_crawl_lists_level_by_level(spark, tmp_path):
    for name in ("a/x/1.txt", "a/x/2.txt", "a/y/z/deep.txt", "b/3.txt", ".hidden/4.txt", "top.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("12345")
    found = {r["path"].split(f"{tmp_path}/")[1]: (r["length"], r["is_folder"], r["depth"]) for r in listing.crawl(spark, str(tmp_path), 3).collect()}
    assert found == {"a": (0, True, 1), "b": (0, True, 1), "top.txt": (5, False, 1), "a/x": (0, True, 2), "a/y": (0, True, 2), "b/3.txt": (5, False, 2), "a/x/1.txt": (5, False, 3), "a/x/2.txt": (5, False, 3), "a/y/z": (0, True, 3)}
    assert listing.crawl(spark, f"{tmp_path}/none", 2).count() == 0


def test_a_wide_folder_is_listed_in_parts(tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "PART", 7)
    for i in range(100):
        (tmp_path / str(i)).write_text("")
    assert sorted(e[0] for e in listing.entries(f"file:{tmp_path}")) == sorted(f"file:{tmp_path}/{i}" for i in range(100))


def test_only_changed_folders_are_listed_again(spark, tmp_path, monkeypatch):
    for name in ("NY/0/a", "NY/4/b", "AL/0/c"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / "AL" / "8").mkdir()
    known = listing.refreshed(spark, str(tmp_path), None, 2)
    assert sorted(r["path"][-6:] for r in known.where("path is not null").collect()) == ["AL/0/c", "NY/0/a", "NY/4/b"]
    (tmp_path / "NY" / "4" / "d").write_text("y")
    (tmp_path / "NY" / "0" / "a").rename(tmp_path / "AL" / "8" / "e")
    asked, whole = [], listing.list_level
    monkeypatch.setattr(listing, "list_level", lambda folders, depth: (asked.append((depth, sorted(r["path"][-4:] for r in folders.collect()))), whole(folders, depth))[1])
    again = listing.refreshed(spark, str(tmp_path), known, 2)
    assert sorted(r["path"][-6:] for r in again.where("path is not null").collect()) == ["AL/0/c", "AL/8/e", "NY/4/b", "NY/4/d"]
    assert asked[-1] == (3, ["AL/8", "NY/0", "NY/4"])


def test_the_index_job_goes_on_where_it_was_killed(spark, tmp_path, monkeypatch):
    raw = spark.createDataFrame([(1, "NY", "c", "p")], "bldg_id long, `in.state` string, `in.county` string, `in.puma` string")
    keys = [("res_2021_tmy3_1", "2021"), ("res_2022_tmy3_1", "2022"), ("com_2021_tmy3_1", "2021")]
    for key, year in keys[:2]:
        raw.write.parquet(f"{tmp_path}/land/{year}/resstock_tmy3_release_1/metadata/metadata.parquet")
    catalogue = Catalogue.load("{" + ",".join(f'"{k}": {{"upgrade_ids": ["0"], "available_data": ["metadata"]}}' for k, _ in keys) + "}")
    monkeypatch.setattr(ingest, "source_glob", lambda t, key, parts, up: f"{key[4:8]}/{'resstock' if key.startswith('res') else 'comstock'}_tmy3_release_1/metadata/metadata.parquet")
    built, index = [], ingest.building_index

    def build(raw, *keys):
        built.append(keys[:2])
        if len(built) == 2:
            raise RuntimeError("killed")
        return index(raw, *keys)

    monkeypatch.setattr(ingest, "building_index", build)
    with pytest.raises(RuntimeError):
        ingest.index_job(spark, f"{tmp_path}/land", catalogue, f"{tmp_path}/index")
    assert Table(spark, f"{tmp_path}/index", ingest.INDEX_KEYS).read().count() == 1
    assert ingest.index_job(spark, f"{tmp_path}/land", catalogue, f"{tmp_path}/index").count() == 2
    assert built[2:] == [built[1]]  # the open one alone
    raw.write.parquet(f"{tmp_path}/land/2021/comstock_tmy3_release_1/metadata/metadata.parquet")
    assert ingest.index_job(spark, f"{tmp_path}/land", catalogue, f"{tmp_path}/index").count() == 3
    assert built[3:] == [("comstock", "2021")]


def test_a_stream_takes_each_file_once(spark, tmp_path, monkeypatch):
    landing, path, checkpoint = f"{tmp_path}/land", f"{tmp_path}/lake/trips", f"{tmp_path}/state"
    schema = "bldg_id long, vehicle_id int, date date, release string, state string"

    def put(n):
        spark.sql(f"select bigint({n}) bldg_id, 1 vehicle_id, date '2022-01-01' date, 'r' release, 'NY' state").write.mode("append").parquet(landing)

    table = Table(spark, path, ("release", "state"))
    put(1)
    put(2)
    land(spark, landing, schema, table.append, checkpoint, files_per_batch=1)
    assert sorted(r["bldg_id"] for r in table.read().collect()) == [1, 2]
    put(3)
    commit = Table.append

    def crash(self, rows, mark=None, partitions=None):
        commit(self, rows, mark, partitions)
        raise RuntimeError("after the change, before the checkpoint")

    monkeypatch.setattr(Table, "append", crash)
    with pytest.raises(Exception, match="before the checkpoint"):
        land(spark, landing, schema, lambda rows, mark: table.append(rows, mark), checkpoint)
    monkeypatch.setattr(Table, "append", commit)
    assert table.read().count() == 3
    land(spark, landing, schema, table.append, checkpoint)  # the batch runs again
    land(spark, landing, schema, table.append, checkpoint)
    assert sorted(r["bldg_id"] for r in table.read().collect()) == [1, 2, 3]


def test_broken_files_are_told_and_left_out(spark, tmp_path):
    for n in range(3):
        spark.range(n * 1000, n * 1000 + 1000).select(F.col("id").alias("bldg_id"), F.md5(F.col("id").cast("string")).alias("x")).coalesce(1).write.mode("append").parquet(str(tmp_path))
    files = sorted(tmp_path.glob("part-*.parquet"))
    data = bytearray(files[0].read_bytes())
    data[4:104] = b"\xff" * 100  # a broken page header
    for f, content in ((files[0], bytes(data)), (files[1], b"no parquet")):
        (tmp_path / f".{f.name}.crc").unlink(missing_ok=True)
        f.write_bytes(content)
    told = {r["path"].rsplit("/", 1)[1]: (r["good"], r["n_rows"]) for r in landed.landed_files(spark, str(tmp_path)).collect()}
    assert told[files[2].name] == (True, 1000) and not told[files[0].name][0] and told[files[1].name] == (False, None)
    rows, seen = landed.counted(landed.good_rows(spark, str(tmp_path)))
    assert rows.count() == 1000
    assert seen.get["n_read"] == 1000 and seen.get["n_without_id"] == 0 and abs(seen.get["n_buildings"] - 1000) < 100


def test_a_job_leaves_counts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "NY", 0, 1.0), (None, "NY", 0, 1.0), (2, "AL", 0, 1.0)], SCHEMA)
    own, seen = landed.counted(rows)
    ingest.metadata_job(own, f"{tmp_path}/t")
    assert (seen.get["n_read"], seen.get["n_without_id"], seen.get["n_buildings"]) == (3, 1, 2)


def test_a_second_batch_of_curves_keeps_the_first(spark, tmp_path):
    def readings(b, v):
        return spark.sql(f"select bigint({b}) bldg_id, timestamp_ntz '2022-01-01 00:15:00' timestamp, double({v}) x, 'NY' state, 0 upgrade")

    for b, v in ((1, 1.0), (2, 2.0), (2, 5.0)):
        ingest.load_curve_job(readings(b, v), {"x": "sum"}, str(tmp_path), ("hourly",))
    assert sorted((r["bldg_id"], r["x"]) for r in Table(spark, f"{tmp_path}/load_curve_hourly", ("state", "upgrade")).read().collect()) == [(1, 1.0), (2, 5.0)]


def test_saved_years_leave_the_others(spark, tmp_path):
    lake = lake_of(spark, tmp_path, [(b, "NY", u, 1.0) for b in range(8) for u in (0, 4)])
    reader = ScenarioReader(lake, {4: [0.25, 0.5, 1.0]})
    reader.save("metadata")
    target = reader.save("metadata", years=[1])
    assert sorted(r["year"] for r in spark.read.parquet(target).select("year").distinct().collect()) == [0, 1, 2]
    assert spark.read.parquet(target).count() == 24
    assert scenario.empty_allocation(spark).columns == ["year", "bldg_id", "upgrade_id"]


def test_metadata_of_the_sb_variant(spark, tmp_path):
    folder = tmp_path / RELEASE / "metadata" / "state=NY" / "upgrade=00"
    folder.mkdir(parents=True)
    for n, name in ((3, "metadata.parquet"), (2, "metadata-sb.parquet")):
        spark.range(n).select(F.col("id").alias("bldg_id")).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        next((tmp_path / name).glob("part-*.parquet")).rename(folder / name)
    assert Lake(spark, str(tmp_path), RELEASE).metadata().count() == 3
    assert Lake(spark, str(tmp_path), RELEASE, metadata_variant="sb").metadata().count() == 2
    assert Lake(spark, str(tmp_path), RELEASE, metadata_variant="sb").partitions("metadata") == [("NY", 0)]


def test_trips_are_drawn_by_weight(spark):
    rows = [(b, 1, k, True, 8, 9, 1.0, w) for b in range(600) for k, w in ((1, 1.0), (2, 3.0), (3, 6.0), (4, 0.0), (5, None))]
    trips = spark.createDataFrame(rows, "bldg_id long, vehicle_id int, trip int, is_weekday boolean, departure int, arrival int, miles_driven double, trip_weight double").withColumn("miles_driven", F.col("trip") * 1000.0)
    out = vehicles.schedules(trips, date(2022, 1, 3), date(2022, 1, 7)).select("bldg_id", "date", "place", F.round(F.col("miles_driven") / 1000).cast("int").alias("trip"))
    first = {r["trip"]: r["n"] for r in out.where("place = 1").groupBy("trip").agg(F.count("*").alias("n")).collect()}
    assert out.count() == 15_000 and sum(first.values()) == 3000
    assert first.get(2, 0) == pytest.approx(900, abs=100) and first.get(1, 0) < 420 and first[3] > 1500
    assert out.where("trip >= 5 and place < 4").count() < 30  # a weight of zero or none comes last (miles vary, so some round up)
    some = vehicles.schedules(trips, date(2022, 1, 3), date(2022, 1, 7), most=2)
    assert some.count() == 6000 and some.where("place > 2").count() == 0
    plan = some._sc._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "simple")
    assert plan.count("Exchange hashpartitioning") <= 1  # days multiply rows after the only shuffle
