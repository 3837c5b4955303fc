"""Queries that go through the lake, its jobs, the catalogue, the surveys and the archives, and the same in SQL.

Stand-ins: customers are buildings, their nations the first states, and orders are yearly facts of a building. All have the
baseline; upgrade 4 is for even ids, upgrade 8 for every third id of the first nations. The tables of a query are written
to a fresh folder below ``spark.checkpoint.dir`` by the library's own jobs and read back through ``Lake``.
"""

from __future__ import annotations

import io
import json
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions import energy, names
from wattloom.operators import checks, merge, timeagg, vehicles
from wattloom.plans import ingest, paths, release, scenario
from wattloom.sources import archives, catalog, lake, listing, models, surveys
from wattloom.sources.shared import shared_dir as fresh

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
RELEASE = "res_2022_tmy3_1"
SHARES = {4: [0.06, 0.18, 0.30], 8: [0.04, 0.12, 0.20]}
STATES = names.STATES[:25]
CHOSEN = (STATES[1], STATES[3], STATES[22])
#: States whose readings have all upgrades, as a scenario needs.
MIXED = ("AZ", "CO", "GA")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STATES_SQL = "(values " + ", ".join(f"({n}, '{s}')" for n, s in enumerate(STATES)) + ") st(k, state)"
_META = f"""
    with m as (select c_custkey as bldg_id, state, u as upgrade, c_acctbal, c_mktsegment, c_custkey * 0.5 as weight from customer join {_STATES_SQL} on k = c_nationkey cross join (values (0), (4), (8)) v(u)
        where u = 0 or (u = 4 and c_custkey % 2 = 0) or (u = 8 and c_custkey % 3 = 0 and c_nationkey < 20)),
    curve as (select o_custkey as bldg_id, m.state, m.upgrade, o_orderkey, o_totalprice from orders join m on m.bldg_id = o_custkey where o_orderkey % 3 * 4 = m.upgrade)"""
_CHOSEN_SQL = str(CHOSEN)


def raw_metadata(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_nationkey < 25")
    states = F.array(*[F.lit(s) for s in STATES])
    u, key = F.col("upgrade"), F.col("c_custkey")
    each = c.withColumn("upgrade", F.explode(F.array(F.lit(0), F.lit(4), F.lit(8))))
    own = each.where((u == 0) | ((u == 4) & (key % 2 == 0)) | ((u == 8) & (key % 3 == 0) & (F.col("c_nationkey") < 20)))
    return own.select(key.alias("bldg_id"), F.get(states, F.col("c_nationkey")).alias("state"), u.alias("upgrade"), (key * 0.5).alias("weight"), F.col("c_acctbal").alias("in.balance"), F.col("c_mktsegment").alias("in.segment"), F.col("c_name").alias("other"))


def curves(spark, sf_dir) -> DataFrame:
    """Orders as rows of a building's upgrade that the order's key picks."""
    meta = raw_metadata(spark, sf_dir).select("bldg_id", "state", "upgrade")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bldg_id"), (F.col("o_orderkey") % 3 * 4).cast("int").alias("upgrade"), "o_orderkey", "o_totalprice")
    return o.join(meta, ["bldg_id", "upgrade"])


def make_lake(spark, sf_dir, curve: bool = False) -> str:
    root = fresh(spark)
    ingest.metadata_job(raw_metadata(spark, sf_dir), f"{root}/{RELEASE}/metadata")
    if curve:
        merge.write_partitioned(curves(spark, sf_dir), f"{root}/{RELEASE}/load_curve_annual", ingest.PARTITIONS, ("bldg_id", "o_orderkey"))
    return root


@query(_META + f'select bldg_id, state, upgrade, weight, c_acctbal as balance, c_mktsegment as segment from m where state in {_CHOSEN_SQL} and upgrade in (0, 4)')
def lake_metadata(spark, sf_dir):
    own = lake.Lake(spark, make_lake(spark, sf_dir), RELEASE, CHOSEN).metadata([0, 4])
    return own.select("bldg_id", "state", F.col("upgrade").cast("int").alias("upgrade"), "weight", names.col("in.balance").alias("balance"), names.col("in.segment").alias("segment"))


@query(_META + f"select bldg_id, state, upgrade, o_orderkey, o_totalprice from curve where state in {_CHOSEN_SQL} and upgrade = 0 and bldg_id in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def lake_load_curve(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("bldg_id"))
    own = lake.Lake(spark, make_lake(spark, sf_dir, True), RELEASE, CHOSEN).load_curve("annual", [0], ids)
    return own.select("bldg_id", "state", F.col("upgrade").cast("int").alias("upgrade"), "o_orderkey", "o_totalprice")


@query(_META + """
    select 'metadata' as file_type, upgrade from m group by upgrade
    union all select 'load_curve_annual', upgrade from (select distinct upgrade, state from curve) t group by upgrade having count(*) = (select count(distinct state) from curve)""")
def lake_upgrades(spark, sf_dir):
    own = lake.Lake(spark, make_lake(spark, sf_dir, True), RELEASE)
    return spark.createDataFrame([(t, u) for t in ("metadata", "load_curve_annual") for u in own.upgrades(t)], "file_type string, upgrade int")


@query(_META + f"""
    select 'all' as kind, bldg_id from m where upgrade = 0 and state in {_CHOSEN_SQL}
    union all select 'baseline', bldg_id from m where upgrade = 0 and state in {_CHOSEN_SQL}
    union all select 'sampled', bldg_id from (select bldg_id from m where upgrade = 0 and state in {_CHOSEN_SQL} order by md5(concat('7:', bldg_id)), bldg_id limit 12) t
    union all select 'never', bldg_id from (select bldg_id from m where upgrade = 0 and state in {_CHOSEN_SQL} except select bldg_id from curve) e""")
def lake_buildings(spark, sf_dir):
    root = make_lake(spark, sf_dir, True)
    own, some = lake.Lake(spark, root, RELEASE, CHOSEN), lake.Lake(spark, root, RELEASE, CHOSEN, sample_n=12, seed=7)
    kinds = {"all": own.buildings(), "baseline": own.baseline_buildings(), "sampled": some.sampled_buildings(), "never": lake.missing_ids(own.buildings(), lake.Lake(spark, root, RELEASE).load_curve("annual"))}
    return lake.union_of_schemas([df.select(F.lit(k).alias("kind"), "bldg_id") for k, df in kinds.items()])


@query(_META + f"select state, upgrade, weight, bldg_id from m where bldg_id in (select bldg_id from m where upgrade = 0 and state in {_CHOSEN_SQL} order by md5(concat('7:', bldg_id)), bldg_id limit 12)")
def lake_sampled_metadata(spark, sf_dir):
    own = lake.Lake(spark, make_lake(spark, sf_dir), RELEASE, CHOSEN, sample_n=12, seed=7).metadata()
    return own.select("state", F.col("upgrade").cast("int").alias("upgrade"), "weight", "bldg_id")


@query(_META + "select state, upgrade, count(*) as n_rows from curve group by 1, 2")
def lake_row_counts(spark, sf_dir):
    return lake.Lake(spark, make_lake(spark, sf_dir, True), RELEASE).row_counts("load_curve_annual").select("state", F.col("upgrade").cast("int").alias("upgrade"), "n_rows")


@query(_META + f"""
    select '{RELEASE}' as release, file_type, state, upgrade from (select 'metadata' as file_type, state, upgrade from m union select 'load_curve_annual', state, upgrade from curve) t where state in {_CHOSEN_SQL} and upgrade <> 8""")
def lake_manifest(spark, sf_dir):
    files = lake.matching(lake.manifest(spark, make_lake(spark, sf_dir, True)), release=RELEASE, state=CHOSEN, upgrade=[0, 4])
    return files.select("release", "file_type", "state", "upgrade").distinct()


@query(_META + f"""
    select '{RELEASE}' as releases, 'load_curve_annual,metadata' as file_types, (select string_agg(state, ',' order by state) from (select distinct state from m) s) as states,
           (select string_agg(upgrade, ',' order by upgrade) from (select distinct upgrade from m) u) as upgrades""")
def lake_facets(spark, sf_dir):
    f = lake.facets(lake.manifest(spark, make_lake(spark, sf_dir, True)))
    return f.select(*[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in f.columns])


@query(_META + "select bldg_id, state, upgrade, weight from m where upgrade < 8 union select bldg_id, state, upgrade, weight + 1 from m where upgrade = 4")
def lake_merge_twice(spark, sf_dir):
    """A second batch into two of the upgrades: equal rows stay single, others are added, other partitions stay."""
    path, raw = f"{fresh(spark)}/metadata", raw_metadata(spark, sf_dir)
    ingest.metadata_job(raw.where("upgrade = 0"), path)
    ingest.metadata_job(raw.where("upgrade = 4"), path)
    again = raw.where("upgrade = 4")
    ingest.metadata_job(again.unionByName(again.withColumn("weight", F.col("weight") + 1)), path)
    return spark.read.parquet(path).select("bldg_id", "state", "upgrade", "weight")


@query(_META + "select cast(bldg_id as varchar) as bldg_id, state, count(*) as n from (select distinct bldg_id, state, o_orderkey from curve) t group by 1, 2")
def trips_merge_twice(spark, sf_dir):
    path = f"{fresh(spark)}/trips"
    rows = curves(spark, sf_dir).select("bldg_id", "state", F.col("o_orderkey").alias("trip"), F.lit(RELEASE).alias("release")).distinct()
    ingest.trips_job(rows.where("trip % 2 = 0"), path)
    ingest.trips_job(rows.where("trip % 4 < 3"), path)
    ingest.trips_job(rows.where("trip % 2 = 1"), path)
    return spark.read.parquet(path).groupBy("bldg_id", "state").agg(F.count("*").alias("n"))


@query("select cast(l_orderkey as varchar) as bldg_id, l_linenumber as vehicle_id, count(*) as n from lineitem group by 1, 2")
def trips_appended(spark, sf_dir):
    path = f"{fresh(spark)}/trips"
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("bldg_id"), F.col("l_linenumber").alias("vehicle_id"), F.col("l_shipdate").alias("date"), F.col("l_returnflag").alias("state"))
    for flag in ("A", "N", "R"):
        ingest.append_batch(li.where(F.col("state") == flag), path, RELEASE)
    return spark.read.parquet(path).groupBy("bldg_id", "vehicle_id").agg(F.count("*").alias("n"))


_ANNUAL = _META + "select bldg_id, state, upgrade, c_acctbal as kwh from m where state = '" + CHOSEN[0] + "' and bldg_id in (select o_custkey from orders)"


@query(_ANNUAL)
def annual_ingest(spark, sf_dir):
    path = f"{fresh(spark)}/annual"
    ids = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bldg_id"))
    raw = raw_metadata(spark, sf_dir).where(F.col("state") == CHOSEN[0]).withColumnRenamed("in.balance", "out.kwh")
    ingest.annual_job(raw, path, ids)
    return spark.read.parquet(path).select("bldg_id", "state", "upgrade", names.col("out.kwh").alias("kwh"))


def _steps_sql(step: str, unit: str) -> str:
    return f"""
    select '{step}' as step, user_id as bldg_id, date_trunc('{unit}', ts - interval 15 minute)::timestamp as timestamp, round(sum(value), 4) as value, round(avg(value), 4) as value_mean from events group by 2, 3"""


@query(" union all ".join(_steps_sql(s, u) for s, u in (("hourly", "hour"), ("daily", "day"), ("monthly", "month"))))
def load_curve_ingest(spark, sf_dir):
    """The three roll-ups as the job writes them, from one scan of the readings."""
    root = fresh(spark)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("bldg_id"), F.col("ts").alias("timestamp"), "value", F.col("value").alias("value_mean"), F.lit("NY").alias("state"), F.lit(0).alias("upgrade"))
    ingest.load_curve_job(e, {"value": "sum", "value_mean": "mean"}, root)
    read = lambda s: spark.read.parquet(f"{root}/load_curve_{s}").select(F.lit(s).alias("step"), "bldg_id", "timestamp", F.round("value", 4).alias("value"), F.round("value_mean", 4).alias("value_mean"))
    return lake.union_of_schemas([read(s) for s in ("hourly", "daily", "monthly")])


@query("""
    select user_id as bldg_id, date_trunc('day', ts - interval 15 minute)::timestamp as timestamp, round(sum(value), 4) as value, arg_min(event_type, row(ts, event_id)) as first_type from events group by 1, 2""")
def rules_from_csv(spark, sf_dir):
    path = fresh(spark)
    rows = [("timestamp", "first"), ("value", "sum"), ("event_type", "first")]
    spark.createDataFrame(rows, "name string, Aggregate_function string").coalesce(1).write.option("header", "true").csv(path)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("bldg_id"), F.col("ts").alias("timestamp"), "value", "event_type", "event_id")
    daily = timeagg.all_steps(e, timeagg.load_rules(spark, path), ("daily",), tie=("event_id",))["daily"]
    return daily.select("bldg_id", "timestamp", F.round("value", 4).alias("value"), F.col("event_type").alias("first_type"))


# --- scenarios over the lake ---------------------------------------------------------------------------------------

_ALLOCATION = _META + f""",
    b as (select distinct bldg_id, state from m where upgrade = 0 and state in {MIXED}),
    r as (select bldg_id, row_number() over (order by md5(concat('42:', bldg_id)), bldg_id) - 1 as rn from b),
    sc(y, u, f, o) as (values (0, 4, cast(0.06 as double), 0), (0, 8, cast(0.04 as double), 1), (1, 4, cast(0.18 as double), 2),
                              (1, 8, cast(0.12 as double), 3), (2, 4, cast(0.30 as double), 4), (2, 8, cast(0.20 as double), 5)),
    t as (select y, u, o, cast(floor(f * (select count(*) from b)) as bigint) as tg from sc),
    nw as (select *, greatest(0, tg - coalesce(lag(tg) over (partition by u order by y), 0)) as nw from t),
    sl as (select y, u, coalesce(sum(nw) over (order by o rows between unbounded preceding and 1 preceding), 0) as st, sum(nw) over (order by o) as en from nw),
    ad as (select r.bldg_id, sl.y as ay, sl.u from r left join sl on r.rn >= sl.st and r.rn < sl.en),
    al as (select yrs.y as year, ad.bldg_id, case when ay <= yrs.y then u else 0 end as upgrade_id from ad cross join (select distinct y from sc) yrs)
"""


def _reader(spark, sf_dir) -> scenario.ScenarioReader:
    return scenario.ScenarioReader(lake.Lake(spark, make_lake(spark, sf_dir, True), RELEASE, MIXED), SHARES)


@query(_ALLOCATION + "select year, al.bldg_id, upgrade_id, o_orderkey, o_totalprice from al join curve on curve.bldg_id = al.bldg_id and curve.upgrade = al.upgrade_id where year in (0, 2)")
def scenario_reader(spark, sf_dir):
    return _reader(spark, sf_dir).read("load_curve_annual", [2, 0]).select("year", "bldg_id", F.col("upgrade_id").cast("int").alias("upgrade_id"), "o_orderkey", "o_totalprice")


@query(_ALLOCATION + "select year, al.bldg_id, upgrade_id, weight from al join m on m.bldg_id = al.bldg_id and m.upgrade = al.upgrade_id")
def scenario_saved(spark, sf_dir):
    """Metadata of the mix, saved by year and read back."""
    where = _reader(spark, sf_dir).save("metadata")
    return spark.read.parquet(where).select("year", "bldg_id", F.col("upgrade_id").cast("int").alias("upgrade_id"), "weight")


@query(_ALLOCATION + "select bldg_id, max(case when year = 0 then upgrade_id end) as year_0, max(case when year = 1 then upgrade_id end) as year_1, max(case when year = 2 then upgrade_id end) as year_2 from al group by 1")
def scenario_csv(spark, sf_dir):
    path = fresh(spark)
    _reader(spark, sf_dir).export_wide(path)
    return spark.read.option("header", "true").schema("bldg_id bigint, year_0 int, year_1 int, year_2 int").csv(path)


@query(_ALLOCATION + "select state, year, upgrade_id, count(*) as n, round(count(*) / sum(count(*)) over (partition by state, year), 6) as fraction from al join b using (bldg_id) group by 1, 2, 3")
def scenario_counts_by_state(spark, sf_dir):
    reader = _reader(spark, sf_dir)
    states = reader.lake.metadata([0]).select("bldg_id", "state").distinct()
    return scenario.adoption_counts(reader.allocation().join(states, "bldg_id"), ("state",)).withColumn("fraction", F.round("fraction", 6))


_MISSING = "select distinct '{0}' as file_type, al.bldg_id, upgrade_id from al where not exists (select 1 from {1} x where x.bldg_id = al.bldg_id and x.upgrade = al.upgrade_id)"


@query(_ALLOCATION + _MISSING.format("metadata", "m") + " union all " + _MISSING.format("load_curve_annual", "curve"))
def scenario_missing(spark, sf_dir):
    """Pairs of the mix without data, in part files that the jobs wrote and that are named after no building."""
    reader = _reader(spark, sf_dir)
    return lake.union_of_schemas([reader.missing(t).select(F.lit(t).alias("file_type"), "bldg_id", F.col("upgrade_id").cast("int").alias("upgrade_id")) for t in ("metadata", "load_curve_annual")])


# --- the building index, work lists and paths ----------------------------------------------------------------------

_KEYS = {"product": "resstock", "release_year": "2022", "weather_file": "tmy3", "release_version": "1"}


def _index(spark, sf_dir) -> DataFrame:
    raw = raw_metadata(spark, sf_dir).select("bldg_id", F.col("state").alias("in.state"), F.col("other").alias("in.county"), names.col("in.segment").alias("in.puma"))
    return ingest.building_index(raw, "resstock", "2022", "tmy3", "1")


@query(f"""select c_custkey as bldg_id, c_name as county, c_mktsegment as puma, state, 'resstock' as product, '2022' as release_year, 'tmy3' as weather_file, '1' as release_version from customer join {_STATES_SQL} on k = c_nationkey""")
def building_index(spark, sf_dir):
    path = fresh(spark)
    ingest.write_building_index(_index(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return back.select("bldg_id", "county", "puma", "state", *[F.col(k).cast("string").alias(k) for k in _KEYS])


@query("""select concat('res_2022_tmy3_1') as release, c_custkey as bldg_id, case when c_custkey % 5 = 0 then '' else c_name end as county from customer""")
def county_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit(RELEASE).alias("release"), F.col("c_custkey").alias("bldg_id"), F.get(F.array(*[F.lit(s) for s in STATES]), F.col("c_nationkey")).alias("state"), F.lit("resstock").alias("product"), F.lit("2022").alias("year"), F.lit("tmy3").alias("weather"), F.lit("1").alias("version"))
    return paths.with_county(c, _index(spark, sf_dir).where("bldg_id % 5 <> 0")).select("release", "bldg_id", "county")


@query(f"""
    select state, bldg_id, u as upgrade from (select state, c_custkey as bldg_id, row_number() over (partition by c_nationkey order by c_custkey) as n from customer join {_STATES_SQL} on k = c_nationkey where state in ('{CHOSEN[0]}', '{CHOSEN[1]}')) t
    cross join (values (0), (4)) v(u) where n <= 3""")
def building_groups(spark, sf_dir):
    own = lake.building_groups(_index(spark, sf_dir), catalog.parse_key(RELEASE), CHOSEN[:2], [0, 4], limit=3)
    return own.select("state", "bldg_id", "upgrade")


@query(f"select c_custkey as bldg_id, c_name as county from customer join {_STATES_SQL} on k = c_nationkey where state = '{CHOSEN[0]}' order by c_custkey limit 7")
def list_buildings(spark, sf_dir):
    return lake.list_buildings(_index(spark, sf_dir), catalog.parse_key(RELEASE), CHOSEN[0], 7)


@query("""
    select c_custkey, concat(lpad(cast(c_custkey as varchar), 7, '0'), '-up', lpad(cast(u as varchar), 2, '0'), '.xml') as hpxml, concat(lpad(cast(c_custkey as varchar), 7, '0'), '-up', lpad(cast(u as varchar), 2, '0'), '_schedule.csv') as schedule,
           concat('NY_', case when u = 0 then 'upgrade00' else concat('upgrade', lpad(cast(u as varchar), 2, '0')) end, '_metadata_and_annual_results.parquet') as annual,
           concat(c_custkey, '-', u, '.parquet') as curve, 'metadata.parquet' as metadata, concat('res_2022_amy2018_1.1/weather/state=NY/upgrade=', lpad(cast(u as varchar), 2, '0'), '/', c_mktsegment, '.csv') as weather
    from (select *, c_custkey % 11 as u from customer) c""")
def lake_file_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("bldg_id"), (F.col("c_custkey") % 11).alias("upgrade"), F.col("c_mktsegment").alias("station"), F.lit("NY").alias("state"), F.lit("res_2022_amy2018_1.1").alias("release"), F.lit("resstock").alias("product"), F.lit("2022").alias("year"), F.lit("amy2018").alias("weather"), F.lit("1.1").alias("version"))
    c = paths.with_source_path(c, "load_curve_annual")
    files = {"hpxml": "hpxml", "schedule": "schedule", "annual": "load_curve_annual", "curve": "load_curve_15min", "metadata": "metadata"}
    return c.select("c_custkey", *[paths.lake_file(t).alias(n) for n, t in files.items()], paths.lake_place("weather").alias("weather"))


_PLACE = "concat('bldg', lpad(cast(c_custkey as varchar), 7, '0'), '-up', lpad(cast(c_nationkey as varchar), 2, '0'))"


@query(f"""
    select c_custkey, case c_custkey % 4 when 0 then concat('2022/resstock_tmy3_release_1/building_energy_models/upgrade=', c_nationkey, '/', {_PLACE}, '.zip')
             when 1 then concat('2024/resstock_dataset_2024.1/resstock_tmy3/model_and_schedule_files/building_energy_models/upgrade=', c_nationkey, '/', {_PLACE}, '.zip')
             when 2 then concat('2025/comstock_amy2018_release_2/building_energy_models/upgrade=up', lpad(cast(c_nationkey as varchar), 2, '0'), '/', {_PLACE}, '.osm.gz') end as model,
           case c_custkey % 4 when 0 then concat('2022/resstock_tmy3_release_1/weather/state=NY/', c_mktsegment, '_TMY3.csv') when 1 then concat('2024/resstock_dataset_2024.1/resstock_tmy3/weather/state=NY/', c_mktsegment, '_TMY3.csv')
             when 2 then concat('2025/comstock_amy2018_release_2/weather/amy2018/', c_mktsegment, '_2018.csv') else concat('2021/comstock_amy2018_release_1/weather/amy2018/', c_mktsegment, '_2018.csv') end as weather,
           concat(case c_custkey % 4 when 0 then '2022/resstock_tmy3_release_1' when 1 then '2024/resstock_dataset_2024.1/resstock_tmy3' when 2 then '2025/comstock_amy2018_release_2' else '2021/comstock_amy2018_release_1' end,
                  '/timeseries_individual_buildings/by_state/upgrade=', c_nationkey, '/state=NY/', c_custkey, '-', c_nationkey, '.parquet') as curve,
           case c_custkey % 4 when 0 then concat('2022/resstock_tmy3_release_1/metadata_and_annual_results/by_state/state=NY/parquet/NY_', case when c_nationkey = 0 then 'baseline' else concat('upgrade', lpad(cast(c_nationkey as varchar), 2, '0')) end, '_metadata_and_annual_results.parquet')
             when 1 then concat('2024/resstock_dataset_2024.1/resstock_tmy3/metadata_and_annual_results/by_state/state=NY/parquet/NY_', case when c_nationkey = 0 then 'baseline' else concat('upgrade', lpad(cast(c_nationkey as varchar), 2, '0')) end, '_metadata_and_annual_results.parquet')
             when 2 then concat('2025/comstock_amy2018_release_2/metadata_and_annual_results/by_state_and_county/full/parquet/state=NY/county=', c_name, '/NY_', c_name, '_upgrade', c_nationkey, '.parquet') end as annual
    from customer""")
def source_paths_by_type(spark, sf_dir):
    k = F.col("c_custkey") % 4
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k + 1).cast("int"))
    c = table(spark, sf_dir, "customer").select("c_custkey", pick("res_2022_tmy3_1", "res_2024_tmy3_1", "com_2025_amy2018_2", "com_2021_amy2018_1").alias("release"), pick("resstock", "resstock", "comstock", "comstock").alias("product"), pick("2022", "2024", "2025", "2021").alias("year"), pick("tmy3", "tmy3", "amy2018", "amy2018").alias("weather"), pick("1", "1", "2", "1").alias("version"), F.col("c_custkey").alias("bldg_id"), F.col("c_nationkey").alias("upgrade"), F.lit("NY").alias("state"), F.col("c_name").alias("county"), F.col("c_mktsegment").alias("station"))
    own = c
    for name, file_type in (("model_path", "hpxml"), ("weather_path", "weather"), ("curve_path", "load_curve_15min"), ("annual_path", "load_curve_annual")):
        own = paths.with_source_path(own, file_type, name)
    return own.select("c_custkey", F.col("model_path").alias("model"), F.col("weather_path").alias("weather"), F.col("curve_path").alias("curve"), F.col("annual_path").alias("annual"))


_WEATHERS = [(p, y, w) for y in ("2021", "2022", "2023", "2024", "2025") for p in ("resstock", "comstock") for w in ("tmy3", "amy2018", "amy2012")]


@query("""
    with c as (select c_custkey, c_mktsegment as station, c_custkey % 30 // 6 + 2021 as year, case when c_custkey % 6 < 3 then 'resstock' else 'comstock' end as product, c_custkey % 3 as w from customer),
    d as (select *, case w when 0 then 'tmy3' when 1 then 'amy2018' else 'amy2012' end as weather, case w when 0 then case when year = 2021 then 'tmy3' else 'TMY3' end when 1 then '2018' else '2012' end as suffix from c)
    select c_custkey, concat(year, '/', product, '_', weather, '_release_1/weather/', case when year = 2022 or (year = 2024 and not (product = 'comstock' and w = 1)) then 'state=NY' else weather end, '/', station, '_', suffix, '.csv') as weather_path from d""")
def weather_paths(spark, sf_dir):
    """All cases of the layouts: five years, two products, three weathers; the upgrade plays no part."""
    k = (F.col("c_custkey") % 30).cast("int")
    pick = lambda i: F.get(F.array(*[F.lit(v[i]) for v in _WEATHERS]), k)
    own = table(spark, sf_dir, "customer").select("c_custkey", F.lit("any").alias("release"), pick(0).alias("product"), pick(1).alias("year"), pick(2).alias("weather"), F.lit("1").alias("version"), F.lit("NY").alias("state"), F.lit(0).alias("upgrade"), F.col("c_custkey").alias("bldg_id"), F.col("c_mktsegment").alias("station"))
    return paths.with_source_path(own, "weather", "weather_path").select("c_custkey", "weather_path")


@query("""
    select release, string_agg(distinct file_type, ',' order by file_type) as file_types, string_agg(distinct upgrade, ',' order by upgrade) as upgrades from (
        select concat('res_2022_tmy3_', n_regionkey % 2 + 1) as release, case when n_nationkey % 2 = 0 then 'metadata' else 'weather' end as file_type, 0 as upgrade from nation
        union all select concat('res_2022_tmy3_', n_regionkey % 2 + 1), 'load_curve_annual', 0 from nation where n_nationkey % 3 = 0 union all select concat('res_2022_tmy3_', n_regionkey % 2 + 1), 'metadata', 0 from nation where n_nationkey % 3 = 0
        union all select concat('res_2022_tmy3_', n_regionkey % 2 + 1), 'hpxml', n_nationkey from nation where n_nationkey < 9 union all select concat('res_2022_tmy3_', n_regionkey % 2 + 1), 'schedule', n_nationkey from nation where n_nationkey < 9) t group by 1""")
def available_files(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    base = F.concat(F.lit("s3://lake/2022/resstock_tmy3_release_"), (F.col("n_regionkey") % 2 + 1).cast("string"))
    odd = n.select(F.concat(base, F.when(F.col("n_nationkey") % 2 == 0, "/metadata/x.parquet").otherwise("/weather/x.csv")).alias("path"))
    third = n.where("n_nationkey % 3 = 0").select(F.concat(base, F.lit("/metadata_and_annual_results/x.parquet")).alias("path"))
    models = n.where("n_nationkey < 9").select(F.concat(base, F.lit("/building_energy_models/upgrade="), F.col("n_nationkey").cast("string"), F.lit("/x.zip")).alias("path"))
    f = ingest.available_files(lake.union_of_schemas([odd, third, models]))
    return f.select("release", F.array_join("file_types", ",").alias("file_types"), F.array_join(F.array_sort(F.transform("upgrades", lambda u: u.cast("string"))), ",").alias("upgrades"))


@query("""
    select u as upgrade, count(*) as n, min(path) as first_path from (select c_custkey % 5 as u, case when c_custkey % 5 = 0 then concat('m/', c_custkey, '/baseline.parquet') else concat('m/', c_custkey, '/upgrade0', c_custkey % 5, '.parquet') end as path from customer) t group by 1""")
def files_by_upgrade(spark, sf_dir):
    u = F.col("c_custkey") % 5
    file = F.when(u == 0, "baseline.parquet").otherwise(F.concat(F.lit("upgrade0"), u.cast("string"), F.lit(".parquet")))
    p = table(spark, sf_dir, "customer").select(F.concat_ws("/", F.lit("m"), F.col("c_custkey").cast("string"), file).alias("path"))
    return ingest.files_by_upgrade(p).groupBy("upgrade").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


@query("select r_name as entry, 1 as depth from region union all select concat(r_name, '/part=', n_nationkey), 2 from region join nation on n_regionkey = r_regionkey")
def crawl_tree(spark, sf_dir):
    """The folders of a tree that the job wrote: regions, and their nations below them."""
    root = fresh(spark)
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("folder"))
    rows = table(spark, sf_dir, "nation").join(r, "n_regionkey").select("folder", F.col("n_nationkey").alias("part"), "n_name")
    merge.write_partitioned(rows, root, ("folder", "part"))
    found = listing.crawl(spark, root, 2).where("path like '%folder=%'")
    entry = F.regexp_replace(F.regexp_extract("path", r"folder=(.*)$", 1), "%20", " ")
    return found.select(entry.alias("entry"), (F.size(F.split(entry, "/"))).alias("depth"))


# --- the catalogue -------------------------------------------------------------------------------------------------


def _catalogue(spark, sf_dir) -> catalog.Catalogue:
    """Nations as releases: their number picks the parts of the key and what they offer; a row a release."""
    rows, told = {}, {}
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect():
        n = r["n_nationkey"]
        key = f"{('res', 'com')[n % 2]}_{2021 + n // 2 % 5}_{('tmy3', 'amy2018', 'amy2012')[n // 10]}_1"
        rows[key] = {"upgrade_ids": [str(u) for u in range(n % 4 + 1)], "available_data": ["metadata", "weather", "hpxml"][: r["n_regionkey"] % 3 + 1], "trip_schedule_states": ["NY"] if n % 7 == 0 else [], "weather_map_available_states": ["NY", "CA"] if n % 2 else ["TX"]}
        told[key] = {"upgrade_descriptions": {"1": "walls", "3": "roof"}}
    return catalog.Catalogue.load(json.dumps(rows), json.dumps(told))


_RELEASES = """
    with r as (select case n_nationkey % 2 when 0 then 'res' else 'com' end || '_' || (2021 + n_nationkey // 2 % 5) || '_' || case n_nationkey // 10 when 0 then 'tmy3' when 1 then 'amy2018' else 'amy2012' end || '_1' as key,
        case n_nationkey % 2 when 0 then 'resstock' else 'comstock' end as product, cast(2021 + n_nationkey // 2 % 5 as varchar) as year, case n_nationkey // 10 when 0 then 'tmy3' when 1 then 'amy2018' else 'amy2012' end as weather,
        n_nationkey as n, n_regionkey % 3 + 1 as n_types from nation)
"""


@query(_RELEASES + "select key, product, year, weather, n % 4 + 1 as n_upgrades from r where year in ('2021', '2022', '2024') and product = 'resstock' and n_types >= 2")
def release_filter(spark, sf_dir):
    found = _catalogue(spark, sf_dir).filter(product="resstock", year=["2021", "2022", "2024"], file_types=["metadata", "weather"])
    return found.as_table(spark).select("key", "product", "year", "weather", F.size("upgrades").cast("bigint").alias("n_upgrades"))


@query(_RELEASES + "select distinct 'file_types' as facet, x as value from r, (values (1, 'metadata'), (2, 'weather'), (3, 'hpxml')) v(k, x) where k <= n_types union all select distinct 'year', year from r union all select distinct 'weather', weather from r union all select distinct 'product', product from r")
def release_facets(spark, sf_dir):
    c = _catalogue(spark, sf_dir)
    return spark.createDataFrame([(f, v) for f in ("file_types", "year", "weather", "product") for v in c.facet(f)], "facet string, value string")


@query(_RELEASES + "select distinct x as file_type from r, (values (1, 'metadata'), (2, 'weather'), (3, 'hpxml')) v(k, x) where k <= n_types")
def release_file_types(spark, sf_dir):
    return spark.createDataFrame([(t,) for t in _catalogue(spark, sf_dir).facet("file_types")], "file_type string")


@query(_RELEASES + "select key, u as upgrade, case u when 1 then 'walls' when 3 then 'roof' end as description from r, (values (0), (1), (2), (3)) v(u) where u <= n % 4")
def upgrade_descriptions(spark, sf_dir):
    return catalog.upgrade_table(_catalogue(spark, sf_dir), spark)


@query(_RELEASES + "select key, 'CA,NY' as states from r where n % 3 = 0")
def releases_with_trips(spark, sf_dir):
    c = _catalogue(spark, sf_dir).as_table(spark)
    n = F.col("k") % 3 == 0
    keyed = spark.createDataFrame([(k, i) for i, k in _by_nation(spark, sf_dir)], "release string, k bigint").where(n)
    trips = keyed.withColumn("state", F.explode(F.array(F.lit("NY"), F.lit("CA"), F.lit("NY"))))
    return catalog.releases_with_trips(c, trips).select("key", F.array_join("found_states", ",").alias("states"))


def _by_nation(spark, sf_dir) -> list[tuple[int, str]]:
    ids = [r["n_nationkey"] for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()]
    return [(n, f"{('res', 'com')[n % 2]}_{2021 + n // 2 % 5}_{('tmy3', 'amy2018', 'amy2012')[n // 10]}_1") for n in ids]


@query(_RELEASES + "select key, c_custkey as bldg_id, (n % 2 = 1) as has_weather from customer join r on n = c_nationkey")
def weather_availability(spark, sf_dir):
    c = _catalogue(spark, sf_dir).as_table(spark)
    keys = F.array(*[F.lit(k) for _, k in sorted(_by_nation(spark, sf_dir))])
    b = table(spark, sf_dir, "customer").select(F.get(keys, F.col("c_nationkey")).alias("release"), F.lit("NY").alias("state"), F.col("c_custkey").alias("bldg_id"))
    there, without = catalog.with_weather(b, c)
    flag = lambda df, v: df.select(F.col("release").alias("key"), "bldg_id", F.lit(v).alias("has_weather"))
    return flag(there, True).unionByName(flag(without, False))


@query(_RELEASES + "select key as release, c_custkey as bldg_id, c_custkey % 5 as upgrade from customer join r on n = c_nationkey where c_custkey % 5 > n % 4")
def unknown_upgrades(spark, sf_dir):
    c = _catalogue(spark, sf_dir).as_table(spark)
    keys = F.array(*[F.lit(k) for _, k in sorted(_by_nation(spark, sf_dir))])
    b = table(spark, sf_dir, "customer").select(F.get(keys, F.col("c_nationkey")).alias("release"), F.col("c_custkey").alias("bldg_id"), (F.col("c_custkey") % 5).cast("int").alias("upgrade"))
    return catalog.unknown_upgrades(b, c).select("release", "bldg_id", F.col("upgrade").cast("bigint").alias("upgrade"))


@query(_RELEASES + "select key, case when n < 20 then n % 4 + 1 else 1 end as n_upgrades, case when n < 20 and n % 7 = 0 then 'CA,NY' when n % 7 = 0 or n < 20 then case when n % 7 = 0 then 'NY' else 'CA' end else '' end as trip_states from r")
def catalogue_upsert(spark, sf_dir):
    """Releases known and found: known ones keep their upgrades and gain states, new ones are added; written and read again."""
    every = _catalogue(spark, sf_dir)
    number = {k: n for n, k in _by_nation(spark, sf_dir)}
    known = catalog.Catalogue([r for r in every if number[r.key] < 20])
    found = [catalog.Release(r.key, {0: None}, r.file_types, r.trip_states if number[r.key] >= 20 else frozenset({"CA"}), r.weather_states) for r in every]
    path = fresh(spark)
    spark.createDataFrame([(catalog.as_json(catalog.upsert(known, found)),)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    back = catalog.Catalogue.load(spark.read.text(path, wholetext=True).first()[0])
    return back.as_table(spark).select("key", F.size("upgrades").cast("bigint").alias("n_upgrades"), F.array_join("trip_states", ",").alias("trip_states"))


@query("select p, y, w, u from (select distinct r_name as p from region) a cross join (select distinct c_mktsegment as y from customer) b cross join (select distinct o_orderpriority as w from orders) c cross join (select distinct l_linenumber::int as u from lineitem) d")
def key_grid(spark, sf_dir):
    """Every combination of the values of four columns, a few each."""
    values = {n: sorted(r[0] for r in table(spark, sf_dir, t).select(c).distinct().collect()) for n, t, c in (("p", "region", "r_name"), ("y", "customer", "c_mktsegment"), ("w", "orders", "o_orderpriority"), ("u", "lineitem", "l_linenumber"))}
    return catalog.key_grid(spark, **values).withColumn("u", F.col("u").cast("int"))


# --- names ---------------------------------------------------------------------------------------------------------

_CITY = "concat('  a  ', c_mktsegment, '   ', c_custkey % 7, ' ')"


@query(f"""
    select c_custkey, concat('a|', c_mktsegment, '|', c_custkey % 7) as words, concat('{{"c_custkey":', c_custkey, ',"c_mktsegment":"', c_mktsegment, '"}}') as json, case when c_custkey % 3 = 0 then null else c_custkey % 13 end as upgrade,
           (c_custkey % 2 = 0) as is_s3, concat('res_', 2020 + c_custkey % 4, '_tmy3_1') as release, case c_nationkey % 3 when 0 then 'NY' when 1 then 'NY' end as state, c_custkey % 4 > 0 as known_year,
           case when c_custkey % 3 = 0 then false else true end as canonical, lower(c_mktsegment) as low, case c_nationkey % 2 when 0 then 2 else 8 end as division
    from customer""")
def name_functions(spark, sf_dir):
    k = F.col("c_custkey")
    spaced = F.concat(F.lit("  a  "), F.col("c_mktsegment"), F.lit("   "), (k % 7).cast("string"), F.lit(" "))
    upgrade = F.when(k % 3 == 0, "up x").otherwise((k % 13).cast("string"))
    state = F.get(F.array(F.lit("new york"), F.lit(" New%20York"), F.lit("Nowhere")), (F.col("c_nationkey") % 3).cast("int"))
    year = (2020 + k % 4).cast("string")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.array_join(names.words(spaced), "|").alias("words"), names.as_json("c_custkey", "c_mktsegment").alias("json"),
        names.upgrade_number(upgrade).cast("bigint").alias("upgrade"), names.is_s3_path(F.when(k % 2 == 0, "s3a://b/x").otherwise("/s3/x")).alias("is_s3"),
        names.release_key(F.lit("resstock"), year, F.lit("tmy3"), F.lit("1")).alias("release"), names.state_code(state).alias("state"),
        names.is_known(year, names.YEARS).alias("known_year"), names.is_canonical_upgrade(upgrade).alias("canonical"),
        names.trimmed_lower(F.concat(F.lit(" "), F.col("c_mktsegment"))).alias("low"),
        names.census_division(F.when(F.col("c_nationkey") % 2 == 0, "NY").otherwise("AZ")).cast("bigint").alias("division"),
    )


# --- surveys -------------------------------------------------------------------------------------------------------


@query("""
    select concat('v', l_orderkey) as hh_vehicle_id, cast(l_partkey % 13 - 1 as int) as income_bucket, cast(l_linenumber as int) as occupants, cast(l_suppkey % 3 as int) as vehicles, cast(l_quantity as double) as miles_driven
    from lineitem where l_orderkey % 9 + 1 = 2 and l_suppkey % 3 > 0 and l_partkey % 13 - 1 > 0""")
def survey_trips(spark, sf_dir):
    """Line items as surveyed trips in a CSV file; New York is in census division 2."""
    path = fresh(spark)
    li = table(spark, sf_dir, "lineitem")
    row = {"VEHCASEID": F.concat(F.lit("v"), F.col("l_orderkey").cast("string")), "CENSUS_D": F.col("l_orderkey") % 9 + 1, "HHFAMINC": F.col("l_partkey") % 13 - 1, "HHSIZE": F.col("l_linenumber"), "HHVEHCNT": F.col("l_suppkey") % 3, "TDWKND": F.lit(2), "STRTTIME": F.lit(815), "ENDTIME": F.lit(930), "TRPMILES": F.col("l_quantity"), "WTTRDFIN": F.lit(1.5), "URBRUR": F.lit(1), "VEHID": F.lit(1), "UNUSED": F.lit("x")}
    li.select(*[c.alias(n) for n, c in row.items()]).write.option("header", "true").csv(path)
    return surveys.load_trips(spark, path, "NY").select("hh_vehicle_id", "income_bucket", "occupants", "vehicles", "miles_driven")


@query("""
    select lpad(cast(c_nationkey as varchar), 5, '0') as puma, c_custkey * 100 as income, c_custkey % 6 as occupants, case when c_custkey % 4 = 0 then null else c_custkey % 4 end as vehicles, case when c_nationkey % 2 = 0 then 'urban' end as metro
    from customer where c_custkey % 5 > 0""")
def survey_households(spark, sf_dir):
    """Customers as households: 'b' is a blank, and those without income go; areas get their metro status if it is known."""
    path, k = fresh(spark), F.col("c_custkey")
    puma = F.lpad(F.col("c_nationkey").cast("string"), 5, "0")
    row = {"PUMA": puma, "HINCP": F.when(k % 5 == 0, 0).otherwise(k * 100), "NP": k % 6, "VEH": F.when(k % 4 == 0, "b").otherwise((k % 4).cast("string")), "WGTP": F.lit(7), "OTHER": F.lit("y")}
    c = table(spark, sf_dir, "customer")
    c.select(*[v.alias(n) for n, v in row.items()]).write.option("header", "true").csv(path)
    meta = c.where("c_nationkey % 2 = 0").select(F.concat(F.lit("G36"), puma).alias("in.puma"), F.lit("urban").alias("in.puma_metro_status"))
    return surveys.load_households(spark, path, surveys.metro_puma_map(meta)).select("puma", "income", "occupants", "vehicles", "metro")


@query("""
    select c_custkey as bldg_id, right(c_name, 5) as puma, case c_custkey % 4 when 0 then 5000 when 1 then 64999 when 2 then 200000 end as income, cast(case c_custkey % 4 when 0 then 1 when 1 then 6 when 2 then 11 end as smallint) as income_bucket,
           cast(case when c_custkey % 7 = 6 then 10 else c_custkey % 7 end as smallint) as occupants
    from customer where c_nationkey < 5 and c_custkey % 7 > 0""")
def survey_buildings(spark, sf_dir):
    k = F.col("c_custkey")
    income = F.element_at(F.array(*[F.lit(x) for x in ("<10000", "60000-69999", "200000+", "Not Available")]), (k % 4 + 1).cast("int"))
    meta = table(spark, sf_dir, "customer").select(k.alias("bldg_id"), F.lit(1.0).alias("weight"), F.lit("urban").alias("in.puma_metro_status"), F.col("c_name").alias("in.puma"), income.alias("in.income"), F.when(k % 7 == 6, "10+").otherwise((k % 7).cast("string")).alias("in.occupants"), F.when(F.col("c_nationkey") < 5, "NY").otherwise("CA").alias("in.state"))
    return surveys.ev_buildings(meta, "NY").select("bldg_id", "puma", "income", "income_bucket", "occupants")


@query("select distinct right(c_name, 5) as puma, c_mktsegment as metro from customer")
def survey_metro_map(spark, sf_dir):
    return surveys.metro_puma_map(table(spark, sf_dir, "customer").select(F.col("c_name").alias("in.puma"), F.col("c_mktsegment").alias("in.puma_metro_status")))


# --- archives ------------------------------------------------------------------------------------------------------


def _zips(spark, sf_dir) -> DataFrame:
    """Pages as model archives: their address is the station, every third archive has a schedule, every fifth is broken."""

    def pack(frames):
        for frame in frames:
            out = []
            for page, url in zip(frame["page_id"], frame["url"], strict=True):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    xml = f"<HPXML xmlns='http://h'><!-- <WeatherStation><Name>OLD</Name></WeatherStation> --><WeatherStation><SystemIdentifier/><Name>{url.replace('&', '&amp;')} &amp; co</Name></WeatherStation></HPXML>"
                    z.writestr("in.xml", xml)
                    if page % 3 == 0:
                        z.writestr("schedule.csv", "a,b")
                out.append(b"broken" if page % 5 == 0 else data.getvalue())
            yield pd.DataFrame({"path": [f"/m/state=NY/bldg{p:07d}-up04.zip" for p in frame["page_id"]], "content": out})

    return table(spark, sf_dir, "pages").select("page_id", "url").where("url is not null").mapInPandas(pack, "path string, content binary")


@query("select concat('/m/state=NY/bldg', lpad(cast(page_id as varchar), 7, '0'), '-up04.zip') as path, case when page_id % 5 = 0 then '' else concat(url, ' & co') end as weather_station_name from pages where url is not null")
def stations_of_archives(spark, sf_dir):
    return archives.station_of_archives(_zips(spark, sf_dir))


@query("select concat('/m/state=NY/bldg', lpad(cast(page_id as varchar), 7, '0'), '-up04.zip') as path, case when page_id % 5 = 0 then '' when page_id % 3 = 0 then 'hpxml,schedule' else 'hpxml' end as file_types from pages where url is not null")
def archive_contents(spark, sf_dir):
    return archives.content_types(_zips(spark, sf_dir)).select("path", F.array_join("file_types", ",").alias("file_types"))


@query("select page_id as bldg_id, case when page_id % 2 = 0 then 'old' when page_id % 5 = 0 then '' else concat(url, ' & co') end as weather_station_name, 'NY' as state from pages where url is not null")
def weather_map_upsert(spark, sf_dir):
    """The weather map of the archives, merged into one that has the even buildings: those keep their rows."""
    path = fresh(spark)
    found = archives.station_of_archives(_zips(spark, sf_dir))
    id_ = F.regexp_extract("path", r"bldg(\d+)", 1).cast("long")
    rows = found.select(id_.alias("bldg_id"), "weather_station_name", F.lit("resstock").alias("product"), F.lit("2022").alias("release_year"), F.lit("tmy3").alias("weather_file"), F.lit("1").alias("release_version"), F.lit("NY").alias("state"))
    ingest.write_weather_map(rows.where("bldg_id % 2 = 0").withColumn("weather_station_name", F.lit("old")), path)
    ingest.write_weather_map(rows.where("bldg_id % 4 > 0"), path)
    return spark.read.parquet(path).select("bldg_id", "weather_station_name", "state")


def _model_zips(spark, sf_dir) -> DataFrame:
    """Pages as model archives: the size of the html is the area, the address a fuel after an empty one; lines are ids times hours.

    Of five archives one is broken, and one has XML that does not end.
    """

    def pack(frames):
        for frame in frames:
            out = []
            for page, html, url in zip(frame["page_id"], frame["html"], frame["url"], strict=True):
                data = io.BytesIO()
                fuel = "" if pd.isna(url) else f"<System><Fuel>{escape(url)}</Fuel></System>"
                xml = f"<h:HPXML xmlns:h='http://h'><h:Building><Size><Area unit='b'>{'none' if pd.isna(html) else len(html)}</Area></Size><System><Fuel/></System>{fuel}</h:Building></h:HPXML>"
                with zipfile.ZipFile(data, "w") as z:
                    z.writestr("in.xml", xml[:-9] if page % 5 == 1 else xml)
                    z.writestr("in.schedules.csv", "hour,heat,note\n" + "".join(f'{h},{page * h},"a, b"\n' for h in range(page % 4)))
                out.append(b"broken" if page % 5 == 0 else data.getvalue())
            yield pd.DataFrame({"path": [f"/m/bldg{p:07d}-up04.zip" for p in frame["page_id"]], "content": out})

    return table(spark, sf_dir, "pages").select("page_id", "html", "url").mapInPandas(pack, "path string, content binary")


@query("""
    select page_id as bldg_id, 4 as upgrade, page_id % 5 > 1 as parsed, case when page_id % 5 > 1 then length(html) end as area, case when page_id % 5 > 1 then nullif(trim(url), '') end as fuel from pages""")
def model_rows(spark, sf_dir):
    own = models.models(_model_zips(spark, sf_dir), {"area": ("Building/Size/Area", "long"), "fuel": ("Building/System/Fuel", "string")})
    return models.with_building(own).select("bldg_id", "upgrade", "parsed", "area", "fuel")


@query("""
    select page_id as bldg_id, h as line, cast(page_id * h as double) as heat from pages join (values (0), (1), (2)) v(h) on h < page_id % 4 where page_id % 5 > 0""")
def schedule_rows(spark, sf_dir):
    own = models.schedules(_model_zips(spark, sf_dir), {"heat": "double"})
    return models.with_building(own).select("bldg_id", "line", "heat")


@query(_META + "select bldg_id, state, upgrade, weight, c_acctbal as balance from m where upgrade <> 8 or bldg_id % 2 = 0")
def release_ingest(spark, sf_dir):
    """Metadata of a release that lies in the landing folder as at the source, a file an upgrade; of upgrade 8 the even ids are wanted."""
    base, raw = fresh(spark), raw_metadata(spark, sf_dir)
    for upgrade, word in ((0, "baseline"), (4, "upgrade04"), (8, "upgrade08")):
        raw.where(F.col("upgrade") == upgrade).write.parquet(f"{base}/2024/resstock_dataset_2024.1/resstock_tmy3/metadata/{word}.parquet")
    own = catalog.Release("res_2024_tmy3_1", {0: None, 4: None, 8: None})
    release.release_job(spark, base, own, f"{base}/lake", raw.where("upgrade <> 8 or bldg_id % 2 = 0"), ["metadata"])
    return lake.Lake(spark, f"{base}/lake", own).metadata().select("bldg_id", "state", F.col("upgrade").cast("int").alias("upgrade"), "weight", names.col("in.balance").alias("balance"))


# --- vehicles and checks -------------------------------------------------------------------------------------------


@query("select round(avg((quality = toxic)::int::double), 9) as accuracy from labels")
def accuracy(spark, sf_dir):
    return checks.accuracy(table(spark, sf_dir, "labels"), "quality", "toxic").select(F.round("accuracy", 9).alias("accuracy"))


@query("""
    select l_orderkey as bldg_id, l_linenumber as vehicle_id, (l_partkey % 2 = 0) as is_weekday, cast(l_suppkey % 24 as int) as departure, cast((l_suppkey % 24 + 1) % 24 as int) as arrival,
           cast(row_number() over (partition by l_orderkey, l_linenumber, l_partkey % 2 = 0 order by l_suppkey % 24, (l_suppkey % 24 + 1) % 24, cast(l_quantity as double)) as int) as trip from lineitem""")
def vehicle_trip_profiles(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    vehicle = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    hour = F.col("l_suppkey") % 24
    trips = li.select(vehicle.alias("hh_vehicle_id"), F.when(F.col("l_partkey") % 2 == 0, 2).otherwise(1).alias("weekday"), (hour * 100 + 30).alias("start_time"), ((hour + 1) % 24 * 100).alias("end_time"), F.col("l_quantity").cast("double").alias("miles_driven"), F.lit(1.0).alias("trip_weight"))
    picked = li.select(F.col("l_orderkey").alias("bldg_id"), F.col("l_linenumber").alias("vehicle_id"), vehicle.alias("hh_vehicle_id")).distinct()
    return vehicles.vehicle_trips(picked, trips).select("bldg_id", "vehicle_id", "is_weekday", "departure", "arrival", "trip")


@query("""
    select o_orderkey, d as n_days, cast(dayofweek(o_orderdate) between 1 and 5 as boolean) as weekday, cast(case when o_custkey % 40 - 10 > 23 then 23 when o_custkey % 40 - 10 < 0 then 0 else o_custkey % 40 - 10 end as bigint) as hour
    from (select *, date_diff('day', o_orderdate::date, date '2000-01-01') + 1 as d from orders) o""")
def calendar_functions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    days = energy.days_between(F.col("o_orderdate").cast("date"), F.lit("2000-01-01").cast("date"))
    return o.select("o_orderkey", days.cast("bigint").alias("n_days"), energy.is_weekday(F.col("o_orderdate")).alias("weekday"), energy.within_day(F.col("o_custkey") % 40 - 10).cast("bigint").alias("hour"))


@query("select o_orderkey, round(o_totalprice / sum(o_totalprice) over (partition by o_custkey), 9) as share from orders")
def share_of_total(spark, sf_dir):
    from pyspark.sql.window import Window

    share = energy.share_of_total(F.col("o_totalprice"), Window.partitionBy("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(share, 9).alias("share"))


@query("""
    select user_id as bldg_id, date_trunc('month', ts - interval 15 minute)::timestamp as timestamp, round(sum(value), 4) as value_sum, count(value) as n from events group by 1, 2""")
def monthly_load_stream(spark, sf_dir):
    """The monthly step of the streaming roll-up, run to the end."""
    from wattloom.streaming.rollup import rollup_stream, run_to_end

    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    own = stream.select(F.col("user_id").alias("bldg_id"), F.col("ts").alias("timestamp"), "value", F.col("value").isNotNull().cast("double").alias("n"))
    rolled = run_to_end(rollup_stream(own, {"value": "sum", "n": "sum"}, "monthly", late=None), ("bldg_id", "timestamp"))
    return rolled.select("bldg_id", "timestamp", F.round("value", 4).alias("value_sum"), F.col("n").cast("bigint").alias("n"))
