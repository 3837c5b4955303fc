"""The library's operators bound to the driver's tables, and the same in SQL.

Stand-ins: events are readings (user_id a building, ts a reading's end, value its energy), customers are buildings with
metadata, nations are states, orders are facts of a building whose priority stands for an upgrade.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions import energy, names
from wattloom.operators import checks, merge, project, timeagg, vehicles
from wattloom.plans import paths, scenario
from wattloom.sources import lake
from wattloom.sources.archives import station_name

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The scenario of the examples: upgrade to share of buildings by year.
SHARES = {4: [0.06, 0.18, 0.30], 8: [0.04, 0.12, 0.20]}
RULES = {"value": "sum", "value_mean": "mean", "event_type": "first"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("bldg_id"), F.col("ts").alias("timestamp"), "value", F.col("value").alias("value_mean"), "event_type", "event_id")


# --- roll-ups ------------------------------------------------------------------------------------------------------


def _load(step: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeagg.aggregate(readings(spark, sf_dir), RULES, step, tie=("event_id",))
    parts = [F.col(p).cast("bigint").alias(p) for p in energy.calendar_parts(F.lit(None), step)]
    return out.select("bldg_id", "timestamp", F.round("value", 4).alias("value_sum"), F.round("value_mean", 4).alias("value_mean"), F.col("event_type").alias("first_type"), *parts)


def _load_sql(unit: str, parts: str) -> str:
    cols = ", ".join(f"cast({p}(b) as bigint) as {p}" for p in parts.split())
    return f"""
        select bldg_id, b as timestamp, round(s, 4) as value_sum, round(m, 4) as value_mean, first_type, {cols}
        from (select user_id as bldg_id, date_trunc('{unit}', ts - interval 15 minute)::timestamp as b, sum(value) as s, avg(value) as m,
                     arg_min(event_type, row(ts, event_id)) as first_type from events group by 1, 2) t"""


for _step, _unit, _parts in (("hourly", "hour", "year month day hour"), ("daily", "day", "year month day"), ("monthly", "month", "year month")):
    QUERIES[f"{_step}_load"] = lambda spark, sf_dir, s=_step: _load(s, spark, sf_dir)
    ORACLE_SQL[f"{_step}_load"] = _load_sql(_unit, _parts)


@query("""
    select bldg_id, min(s) as timestamp, round(sum(value), 4) as value_sum, count(*) as n
    from (select user_id as bldg_id, ts - interval 15 minute as s, value from events) t group by bldg_id, strftime(s, '%Y-%m-%d-%H')""")
def legacy_text_bucket(spark, sf_dir):
    r = readings(spark, sf_dir).select("bldg_id", "timestamp", "value", F.lit(1.0).alias("n"))
    out = timeagg.aggregate_by_text(r, {"value": "sum", "n": "sum"}, "hourly")
    return out.select("bldg_id", "timestamp", F.round("value", 4).alias("value_sum"), F.col("n").cast("bigint").alias("n"))


@query("""
    select user_id as bldg_id, date_trunc('day', ts - interval 15 minute)::timestamp as timestamp,
           round(coalesce(sum(case when event_type = 'click' then value end), 0), 4) as click, round(avg(case when event_type = 'view' then value end), 4) as "view",
           arg_min(value, row(ts, event_id)) as earliest
    from events group by 1, 2""")
def rule_driven_wide(spark, sf_dir):
    r = table(spark, sf_dir, "events")
    wide = r.select(F.col("user_id").alias("bldg_id"), F.col("ts").alias("timestamp"), "event_id", *[F.when(F.col("event_type") == t, F.col("value")).alias(t) for t in ("click", "view")], F.col("value").alias("earliest"))
    out = timeagg.aggregate(wide, {"click": "sum", "view": "mean", "earliest": "first"}, "daily", tie=("event_id",), parts=False)
    return out.select("bldg_id", "timestamp", F.round("click", 4).alias("click"), F.round("view", 4).alias("view"), "earliest")


# --- filters, unions, distinct -------------------------------------------------------------------------------------


@query("""
    select c_custkey, c_nationkey, c_mktsegment from customer
    where c_nationkey in (3, 7, 11) and c_mktsegment in ('BUILDING', 'MACHINERY') and c_custkey in (select o_custkey from orders where o_orderstatus = 'O')""")
def partition_filter_scan(spark, sf_dir):
    files = lake.matching(table(spark, sf_dir, "customer").withColumnsRenamed({"c_nationkey": "state", "c_mktsegment": "file_type"}), state=[3, 7, 11], file_type=["BUILDING", "MACHINERY"])
    ids = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return lake.with_ids(files, ids, "c_custkey").select("c_custkey", F.col("state").alias("c_nationkey"), F.col("file_type").alias("c_mktsegment"))


@query("select c_custkey from customer where false")
def empty_filter_set(spark, sf_dir):
    return lake.with_ids(table(spark, sf_dir, "customer"), [], "c_custkey").select("c_custkey")


@query("""
    select s_name as name, s_acctbal as acctbal, s_suppkey as suppkey, cast(null as bigint) as custkey, cast(null as varchar) as segment from supplier
    union all select c_name, c_acctbal, null, c_custkey, c_mktsegment from customer""")
def diagonal_concat(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"), F.col("s_suppkey").alias("suppkey"))
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment"))
    return lake.union_of_schemas([s, c])


@query("select cast(n_nationkey as bigint) as k, n_name as name from nation union all select p_partkey, p_brand from part")
def relaxed_concat(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return merge.union_relaxed(a, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("name")))


@query('select l_orderkey as bldg_id, l_linenumber as upgrade, l_tax as weight, l_quantity as "in.quantity" from lineitem')
def compact_columns(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    raw = li.select(F.col("l_orderkey").alias("bldg_id"), F.col("l_linenumber").alias("upgrade"), F.col("l_tax").alias("weight"), F.col("l_quantity").alias("in.quantity"), F.col("l_discount").alias("out.discount"), F.col("l_returnflag").alias("flag"))
    return project.compact_metadata(raw)


@query("""select c_custkey as bldg_id, c_mktsegment as county, cast(c_nationkey as varchar) as state from customer""")
def priority_columns(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    raw = c.select(F.col("c_custkey").alias("bldg_id"), F.col("c_name").alias("in.county"), F.col("c_mktsegment").alias("in.county_name"), F.col("c_nationkey").cast("string").alias("in.state_name"))
    return project.canonical_columns(raw).select("bldg_id", "county", "state")


@query("select l_orderkey, l_linenumber, l_partkey, l_quantity from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as n from lineitem) t where n = 1")
def dedup_keep_first(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    # the SQL leaves open which of two items alike in number and part comes first; here the larger, in every run
    return merge.keep_first(li, ("l_orderkey",), [F.col("l_linenumber"), F.col("l_partkey"), F.desc("l_quantity")])


@query("""
    select s_suppkey as k, s_acctbal as v from supplier union all select c_custkey, c_acctbal from customer where c_custkey not in (select s_suppkey from supplier)""")
def upsert_old_wins(spark, sf_dir):
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return merge.upsert_old_wins(old, new, ("k",), [F.col("v")])


@query("select distinct l_returnflag, l_linestatus, l_linenumber from lineitem")
def distinct_merge(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    return merge.merge_distinct(li.where("l_linenumber <= 4"), li.where("l_linenumber >= 3"))


@query("select c_nationkey as state, min(c_acctbal) as upgrade from customer group by 1")
def min_upgrade_per_state(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("state"), F.col("c_acctbal").alias("upgrade"))
    return merge.least_per_group(c, ("state",), "upgrade")


@query("""
    select c_mktsegment as upgrade from (select distinct c_mktsegment, c_nationkey from customer) t
    group by 1 having count(*) = (select count(distinct c_nationkey) from customer)""")
def available_in_all_states(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("upgrade"), F.col("c_nationkey").alias("state"))
    return checks.in_every_group(c, "upgrade", "state")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def missing_ids(spark, sf_dir):
    return lake.missing_ids(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("select c.c_custkey, c.c_nationkey, n.n_name from customer c left join (select * from nation where n_regionkey < 3) n on c.c_nationkey = n.n_nationkey")
def left_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(n, "c_nationkey", "left").select("c_custkey", "c_nationkey", "n_name")


@query("select c_custkey from customer order by md5(concat('42:', c_custkey)), c_custkey limit 100")
def seeded_sample(spark, sf_dir):
    return lake.seeded_sample(table(spark, sf_dir, "customer"), 100, 42, "c_custkey")


@query("""
    select cast(sum(case when c_name is null then 1 else 0 end) as bigint) as c_name, cast(sum(case when c_acctbal is null then 1 else 0 end) as bigint) as c_acctbal,
           cast(sum(case when c_name is null then 1 else 0 end) + sum(case when c_acctbal is null then 1 else 0 end) as bigint) as all_nulls from customer""")
def null_audit(spark, sf_dir):
    return checks.null_counts(table(spark, sf_dir, "customer"), ["c_name", "c_acctbal"])


@query("select count(*) as n_rows, count(*) filter (where c_custkey is null) as n_null, true as valid from customer")
def id_validity(spark, sf_dir):
    return checks.id_validity(table(spark, sf_dir, "customer"), "c_custkey")


@query("select c_custkey as bldg_id, c_name from customer where c_custkey % 3 > 0")
def valid_ids(spark, sf_dir):
    """Ids as text, a third of them no numbers: those rows go."""
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_custkey").cast("string"))
    return checks.valid_ids(table(spark, sf_dir, "customer").select(text.alias("bldg_id"), "c_name"))


@query("select count(*) as n_rows, count(distinct l_orderkey) as n_distinct, count(distinct l_orderkey) = count(*) as is_unique from lineitem")
def uniqueness(spark, sf_dir):
    return checks.is_unique(table(spark, sf_dir, "lineitem"), "l_orderkey")


# --- scenarios -----------------------------------------------------------------------------------------------------

_ALLOCATION = """
    with r as (select c_custkey, row_number() over (order by md5(concat('42:', c_custkey)), c_custkey) - 1 as rn, count(*) over () as n from customer),
    sc(y, u, f, o) as (values (0, 4, cast(0.06 as double), 0), (0, 8, cast(0.04 as double), 1), (1, 4, cast(0.18 as double), 2),
                              (1, 8, cast(0.12 as double), 3), (2, 4, cast(0.30 as double), 4), (2, 8, cast(0.20 as double), 5)),
    t as (select y, u, o, cast(floor(f * (select count(*) from customer)) as bigint) as tg from sc),
    nw as (select *, greatest(0, tg - coalesce(lag(tg) over (partition by u order by y), 0)) as nw from t),
    sl as (select y, u, coalesce(sum(nw) over (order by o rows between unbounded preceding and 1 preceding), 0) as st, sum(nw) over (order by o) as en from nw),
    ad as (select r.c_custkey, sl.y as ay, sl.u from r left join sl on r.rn >= sl.st and r.rn < sl.en),
    al as (select yrs.y as year, ad.c_custkey, case when ay <= yrs.y then u else 0 end as upgrade_id from ad cross join (select distinct y from sc) yrs)
"""


def _allocation(spark, sf_dir) -> DataFrame:
    return scenario.materialised(table(spark, sf_dir, "customer"), SHARES, column="c_custkey")


@query(_ALLOCATION + "select c_custkey, ay as adopt_year, case when ay is null then null else u end as adopt_upgrade from ad")
def scenario_slices(spark, sf_dir):
    return scenario.adoption(table(spark, sf_dir, "customer"), SHARES, column="c_custkey")


@query(_ALLOCATION + "select year, c_custkey, upgrade_id from al")
def scenario_materialised(spark, sf_dir):
    return _allocation(spark, sf_dir)


@query(_ALLOCATION + "select year, upgrade_id, count(*) as n, round(count(*) / sum(count(*)) over (partition by year), 6) as fraction from al group by year, upgrade_id")
def scenario_counts(spark, sf_dir):
    return scenario.adoption_counts(_allocation(spark, sf_dir)).withColumn("fraction", F.round("fraction", 6))


_UPGRADE_SQL = "case when o_orderpriority like '1%' then 4 when o_orderpriority like '2%' then 8 else 0 end"


def _orders(spark, sf_dir) -> DataFrame:
    p = F.col("o_orderpriority")
    upgrade = F.when(p.startswith("1"), 4).when(p.startswith("2"), 8).otherwise(0)
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", upgrade.alias("upgrade"))


@query(_ALLOCATION + f"select al.year, al.c_custkey, al.upgrade_id, o.o_orderkey, o.o_totalprice from al join (select *, {_UPGRADE_SQL} as up from orders) o on o.o_custkey = al.c_custkey and o.up = al.upgrade_id")
def scenario_read_join(spark, sf_dir):
    out = scenario.join_data(_allocation(spark, sf_dir), _orders(spark, sf_dir), "c_custkey")
    return out.select("year", "c_custkey", "upgrade_id", "o_orderkey", "o_totalprice")


@query(_ALLOCATION + f"select al.year, al.upgrade_id, count(*) as n, round(sum(o.o_totalprice), 2) as energy from al join (select *, {_UPGRADE_SQL} as up from orders) o on o.o_custkey = al.c_custkey and o.up = al.upgrade_id group by 1, 2")
def scenario_energy(spark, sf_dir):
    out = scenario.join_data(_allocation(spark, sf_dir), _orders(spark, sf_dir), "c_custkey")
    return out.groupBy("year", "upgrade_id").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("energy"))


@query(_ALLOCATION + "select c_custkey, max(case when year = 0 then upgrade_id end) as year_0, max(case when year = 1 then upgrade_id end) as year_1, max(case when year = 2 then upgrade_id end) as year_2 from al group by 1")
def scenario_export_wide(spark, sf_dir):
    return scenario.wide_export(_allocation(spark, sf_dir), 3, "c_custkey")


@query("""
    with w as (select row_number() over (order by c_mktsegment) * 4 as u, count(*) / (select count(*) from customer) as w from customer group by c_mktsegment),
         t as (select y, sum(n) over (order by y) / (select count(*) from orders) as t from (select year(o_orderdate) - (select min(year(o_orderdate)) from orders) as y, count(*) as n from orders group by 1) o)
    select y::int as year, u::int as upgrade_id, round(w * t, 9) as fraction from w cross join t""")
def uniform_adoption(spark, sf_dir):
    """Upgrades weighed by the customers of each segment, adopted as orders came in over the years."""
    by = table(spark, sf_dir, "customer").groupBy("c_mktsegment").count().orderBy("c_mktsegment").collect()  # a row a segment
    years = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).count().orderBy("y").collect()  # a row a year
    n, total, sums = sum(r["count"] for r in by), sum(r["count"] for r in years), accumulate(r["count"] for r in years)
    shares = scenario.uniform_adoption([4 * k for k in range(1, len(by) + 1)], {4 * k: r["count"] / n for k, r in enumerate(by, 1)}, [s / total for s in sums])
    return spark.createDataFrame([(y, u, round(f, 9)) for u, fs in shares.items() for y, f in enumerate(fs)], "year int, upgrade_id int, fraction double")


# --- scalar functions ----------------------------------------------------------------------------------------------

_INCOME = "cast(floor(abs(c_acctbal) * 25) as bigint)"


def _income() -> F.Column:
    return F.floor(F.abs(F.col("c_acctbal")) * 25)


@query(f"""
    select c_custkey, ({_INCOME} + {_INCOME} + 9999) // 2 as midpoint,
           cast(1 + ({_INCOME} >= 10000)::int + ({_INCOME} >= 15000)::int + ({_INCOME} >= 25000)::int + ({_INCOME} >= 35000)::int + ({_INCOME} >= 50000)::int + ({_INCOME} >= 75000)::int
             + ({_INCOME} >= 100000)::int + ({_INCOME} >= 125000)::int + ({_INCOME} >= 150000)::int + ({_INCOME} >= 200000)::int as int) as bucket
    from customer""")
def income_buckets(spark, sf_dir):
    text = F.concat_ws("-", _income().cast("string"), (_income() + 9999).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", energy.income_midpoint(text).alias("midpoint"), energy.income_bucket(_income()).alias("bucket"))


@query("select c_custkey, right(c_name, 5) as puma from customer")
def puma_suffix(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", names.puma_suffix(F.col("c_name")).alias("puma"))


@query("select p_partkey, case when p_size > 20 then 20 else p_size end as vehicles from part where p_size is not null and p_brand is not null")
def cap_and_drop_nulls(spark, sf_dir):
    rows, _ = checks.drop_nulls(table(spark, sf_dir, "part"), ["p_size", "p_brand"])
    return rows.select("p_partkey", energy.at_most(F.col("p_size"), 20).alias("vehicles"))


@query("""
    select p_partkey, round(p_size * (0.3950 + t * (-0.0022 + t * (9.1978e-5 + t * (-3.9249e-6 + t * (5.2918e-8 + t * -2.0659e-10))))), 6) as kwh
    from (select *, greatest(-15.0::double, least(110.0::double, p_retailprice / 10 - 40)) as t from part) p""")
def miles_to_kwh(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(energy.miles_to_kwh(F.col("p_size").cast("double"), F.col("p_retailprice") / 10 - 40), 6).alias("kwh"))


@query("""
    select p_partkey, cast(case when p_size * 1.2::double * 2 <= 12 then 12 when p_size * 1.2::double * 2 <= 40 then 40 when p_size * 1.2::double * 2 <= 60 then 60 when p_size * 1.2::double * 2 <= 90 then 90 else 120 end as int) as capacity
    from part""")
def battery_capacity(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", energy.battery_for(F.col("p_size") * 2).alias("capacity"))


@query("""
    select c_custkey, concat('res_2022_tmy3_1/load_curve_15min/state=', lpad(cast(c_nationkey as varchar), 2, '0'), '/upgrade=', lpad(cast(c_custkey % 12 as varchar), 2, '0'), '/', c_custkey, '-', c_custkey % 12, '.parquet') as path,
           cast(c_custkey % 12 as int) as upgrade, c_custkey as bldg_id
    from customer""")
def path_build_and_parse(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", names.pad_left(F.col("c_nationkey"), 2).alias("state"), (F.col("c_custkey") % 12).alias("upgrade"))
    file = F.concat(F.col("c_custkey").cast("string"), F.lit("-"), F.col("upgrade").cast("string"), F.lit(".parquet"))
    built = c.select("c_custkey", names.lake_path(F.lit("res_2022_tmy3_1"), F.lit("load_curve_15min"), F.col("state"), F.col("upgrade"), file).alias("path"))
    return built.select("c_custkey", "path", names.path_part(F.col("path"), "upgrade").alias("upgrade"), names.building_of_file(names.path_part(F.col("path"), "file")).alias("bldg_id"))


@query("""
    select c_custkey, case c_custkey % 3
        when 0 then concat('2021/resstock_tmy3_release_1/metadata/metadata.parquet')
        when 1 then concat('2022/resstock_amy2018_release_1.1/metadata_and_annual_results/by_state/state=NY/parquet/NY_', case when c_nationkey = 0 then 'baseline' else concat('upgrade', lpad(cast(c_nationkey as varchar), 2, '0')) end, '_metadata_and_annual_results.parquet')
        else concat('2025/comstock_amy2018_release_2/metadata_and_annual_results/by_state_and_county/full/parquet/state=NY/county=', c_mktsegment, '/NY_', c_mktsegment, '_upgrade', c_nationkey, '.parquet') end as source_path
    from customer""")
def source_paths(spark, sf_dir):
    k = F.col("c_custkey") % 3
    pick = lambda *v: F.when(k == 0, v[0]).when(k == 1, v[1]).otherwise(v[2])
    c = table(spark, sf_dir, "customer").select("c_custkey", pick("res_2021_tmy3_1", "res_2022_amy2018_1.1", "com_2025_amy2018_2").alias("release"), pick("resstock", "resstock", "comstock").alias("product"), pick("2021", "2022", "2025").alias("year"), pick("tmy3", "amy2018", "amy2018").alias("weather"), pick("1", "1.1", "2").alias("version"), F.col("c_custkey").alias("bldg_id"), F.col("c_nationkey").alias("upgrade"), F.lit("NY").alias("state"), F.col("c_mktsegment").alias("county"))
    return paths.with_source_path(c, "metadata").select("c_custkey", "source_path")


@query("select p_partkey as page, s.s_name as station from part p left join supplier s on s.s_suppkey = p.p_partkey and s.s_nationkey = p.p_size % 25")
def weather_station_lookup(spark, sf_dir):
    keys = {"product": F.lit("resstock"), "year": F.lit("2022"), "weather": F.lit("tmy3")}
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("bldg_id"), (F.col("p_size") % 25).cast("string").alias("version"), *[v.alias(k) for k, v in keys.items()])
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("bldg_id"), F.col("s_nationkey").cast("string").alias("release_version"), F.lit("resstock").alias("product"), F.lit("2022").alias("release_year"), F.lit("tmy3").alias("weather_file"), F.col("s_name").alias("weather_station_name"))
    return paths.with_station(b, s).select(F.col("bldg_id").alias("page"), "station")


@query("select page_id, url as station from pages")
def xml_first_match(spark, sf_dir):
    xml = F.concat(F.lit("<HPXML><!-- <WeatherStation><Name>OLD</Name></WeatherStation> --><h:WeatherStation id='1'><h:SystemIdentifier/><h:Name> "), F.regexp_replace("url", "&", "&amp;"), F.lit(" </h:Name></h:WeatherStation><WeatherStation><Name>other</Name></WeatherStation></HPXML>"))
    return table(spark, sf_dir, "pages").select("page_id", station_name(xml).alias("station"))


# --- vehicles ------------------------------------------------------------------------------------------------------


def _trips(spark, sf_dir) -> DataFrame:
    """Parts as surveyed vehicles: size, brand digit and price stand for income bucket, occupants and vehicles."""
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("hh_vehicle_id"), (F.col("p_size") % 9 + 1).cast("int").alias("income_bucket"), (F.col("p_partkey") % 4 + 1).cast("int").alias("occupants"), (F.col("p_partkey") % 2 + 1).cast("int").alias("vehicles"))


_TRIPS = "(select concat('v', p_partkey) as hh_vehicle_id, cast(p_size % 9 + 1 as int) as income_bucket, cast(p_partkey % 4 + 1 as int) as occupants, cast(p_partkey % 2 + 1 as int) as vehicles from part)"


@query(f"""
    select income_bucket, occupants, vehicles, level, count(*) as n, min(hh_vehicle_id) as first_id, max(hh_vehicle_id) as last_id from (
        select income_bucket, occupants, vehicles, 'exact' as level, hh_vehicle_id from {_TRIPS} t
        union all select income_bucket, occupants, null, 'income_occupants', hh_vehicle_id from {_TRIPS} t
        union all select income_bucket, null, null, 'income_only', hh_vehicle_id from {_TRIPS} t) x group by 1, 2, 3, 4""")
def match_levels(spark, sf_dir):
    return vehicles.level_sizes(vehicles.match_levels(_trips(spark, sf_dir)))


def _buildings(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("bldg_id"), (F.col("c_nationkey") % 12 + 1).cast("int").alias("income_bucket"), (F.col("c_custkey") % 6 + 1).cast("int").alias("occupants"), (F.col("c_custkey") % 3).cast("int").alias("vehicles"))


@query(f"""
    with b as (select c_custkey as bldg_id, cast(c_nationkey % 12 + 1 as int) as income_bucket, cast(c_custkey % 6 + 1 as int) as occupants, cast(c_custkey % 3 as int) as vehicles from customer where c_custkey % 3 > 0),
    t as (select * from {_TRIPS} x),
    n1 as (select income_bucket, occupants, vehicles, count(distinct hh_vehicle_id) as n from t group by 1, 2, 3), n2 as (select income_bucket, occupants, count(distinct hh_vehicle_id) as n from t group by 1, 2), n3 as (select income_bucket, count(distinct hh_vehicle_id) as n from t group by 1),
    j as (select b.*, coalesce(n1.n, 0) as a1, coalesce(n2.n, 0) as a2, coalesce(n3.n, 0) as a3 from b left join n1 using (income_bucket, occupants, vehicles) left join n2 using (income_bucket, occupants) left join n3 using (income_bucket))
    select bldg_id, vehicles, case when a1 >= vehicles then 'exact' when a2 >= vehicles then 'income_occupants' when a3 >= vehicles then 'income_only' else 'closest_income' end as level,
           case when a1 >= vehicles then a1 when a2 >= vehicles then a2 when a3 >= vehicles then a3 else (select n from n3 order by abs(n3.income_bucket - j.income_bucket), n3.income_bucket limit 1) end as n_candidates
    from j""")
def match_cascade(spark, sf_dir):
    m = vehicles.matched(_buildings(spark, sf_dir), vehicles.match_levels(_trips(spark, sf_dir)))
    return m.select("bldg_id", "vehicles", "level", "n_candidates")


@query("""
    with w as (select distinct cast(c_nationkey % 12 + 1 as int) as income_bucket from customer), t as (select distinct cast(p_size % 3 * 4 + 1 as int) as near from part)
    select income_bucket, arg_min(near, row(abs(near - income_bucket), near)) as near from w cross join t group by 1""")
def closest_bucket(spark, sf_dir):
    there = table(spark, sf_dir, "part").select((F.col("p_size") % 3 * 4 + 1).cast("int").alias("income_bucket"))
    return vehicles.closest_bucket(_buildings(spark, sf_dir), there)


def _draw_sql(*parts: str) -> str:
    """[0, 1) from the first 48 bits of an md5."""
    return f"(concat('0x', substr(md5(concat_ws(':', {', '.join(parts)})), 1, 12))::bigint / 281474976710656.0::double)"


@query(f"""
    with b as (select c_custkey as bldg_id, cast(c_nationkey % 9 + 1 as int) as income_bucket, c_custkey % 3 as k from customer where c_custkey % 3 > 0),
    t as (select income_bucket, hh_vehicle_id, row_number() over (partition by income_bucket order by md5(hh_vehicle_id), hh_vehicle_id) as place, count(*) over (partition by income_bucket) as n from (select distinct income_bucket, hh_vehicle_id from {_TRIPS} x) y),
    s as (select distinct income_bucket, n from t),
    d as (select bldg_id, b.income_bucket, k, n, cast(floor({_draw_sql("'42'", "bldg_id", "0")} * n) as bigint) as p1, cast(floor({_draw_sql("'42'", "bldg_id", "1")} * (n - 1)) as bigint) as r2 from b join s on s.income_bucket = b.income_bucket),
    p as (select bldg_id, income_bucket, 1 as vehicle_id, p1 + 1 as place from d union all select bldg_id, income_bucket, 2, r2 + (r2 >= p1)::int + 1 from d where k > 1 and n > 1)
    select p.bldg_id, p.vehicle_id, t.hh_vehicle_id from p join t on t.income_bucket = p.income_bucket and t.place = p.place""")
def pick_k_vehicles(spark, sf_dir):
    """One or two vehicles of the building's income bucket, drawn without replacement."""
    trips = _trips(spark, sf_dir).withColumns({"occupants": F.lit(0), "vehicles": F.lit(0)})
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0")
    b = c.select(F.col("c_custkey").alias("bldg_id"), (F.col("c_nationkey") % 9 + 1).cast("int").alias("income_bucket"), F.lit(-1).alias("occupants"), (F.col("c_custkey") % 3).cast("int").alias("vehicles"))
    levels = vehicles.match_levels(trips)
    return vehicles.pick_vehicles(vehicles.matched(b, levels), levels, 42).select("bldg_id", "vehicle_id", "hh_vehicle_id")


@query("""
    select c_custkey as bldg_id, d::timestamp as date, isodow(d) < 6 as is_weekday from customer
    cross join (select unnest(generate_series(date '2022-01-01', date '2022-01-10', interval 1 day)) as d) days where (c_custkey % 2 = 0) = (isodow(d) < 6)""")
def trip_calendar(spark, sf_dir):
    trips = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("bldg_id"), (F.col("c_custkey") % 2 == 0).alias("is_weekday"))
    return vehicles.expand_calendar(trips, date(2022, 1, 1), date(2022, 1, 10)).select("bldg_id", "date", "is_weekday")


def _vehicle_trips(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").cast("string").alias("bldg_id"), F.col("l_linenumber").alias("vehicle_id"), F.lit(1).alias("trip"), (F.col("l_partkey") % 2 == 0).alias("is_weekday"), (F.col("l_suppkey") % 12 + 6).cast("int").alias("departure"), (F.col("l_suppkey") % 12 + 10).cast("int").alias("arrival"), F.col("l_quantity").cast("double").alias("miles_driven"), F.lit(1.0).alias("trip_weight"))


def _number_sql(number: int) -> str:
    """[0, 1) from 24 bits of the row's hash h."""
    return f"(concat('0x', substr(h, {1 + 6 * number}, 6))::bigint / 16777216.0::double)"


def _offset_sql(number: int) -> str:
    u = _number_sql(number)
    return f"(case when {u} < 0.05 then -2 when {u} < 0.15 then -1 when {u} < 0.85 then 0 when {u} < 0.95 then 1 else 2 end)"


_WEEK = "(select unnest(generate_series(date '2022-01-01', date '2022-01-07', interval 1 day)) as d) days"


@query(f"""
    with r as (select *, md5(concat_ws(':', '42', l_orderkey, l_linenumber, '1', strftime(d, '%Y-%m-%d'))) as h from lineitem cross join {_WEEK} where (l_partkey % 2 = 0) = (isodow(d) < 6))
    select cast(l_orderkey as varchar) as bldg_id, l_linenumber as vehicle_id, d::timestamp as date, greatest(0, least(23, l_suppkey % 12 + 6 + {_offset_sql(2)}))::int as departure_hour,
           greatest(0, least(23, l_suppkey % 12 + 10 + {_offset_sql(3)}))::int as arrival_hour,
           round(l_quantity::double + l_quantity::double * 0.1 * sqrt(-2 * ln(1 - {_number_sql(0)})) * cos(2 * pi() * {_number_sql(1)}), 6) as miles_driven
    from r""")
def trip_schedule_noise(spark, sf_dir):
    return vehicles.schedules(_vehicle_trips(spark, sf_dir), date(2022, 1, 1), date(2022, 1, 7)).drop("place").withColumn("miles_driven", F.round("miles_driven", 6))


@query(f"""
    with r as (select *, l_partkey % 4 * l_quantity::double as w, md5(concat_ws(':', '42', l_orderkey, '1', l_linenumber, strftime(d, '%Y-%m-%d'))) as h from lineitem cross join {_WEEK} where (l_orderkey % 2 = 0) = (isodow(d) < 6)),
    p as (select *, row_number() over (partition by l_orderkey, d order by case when w > 0 then -ln(1 - {_number_sql(4)}) / w end nulls last, l_linenumber) as place from r)
    select l_orderkey as bldg_id, d::timestamp as date, place::int as place, greatest(0, least(23, l_linenumber + {_offset_sql(2)}))::int as departure_hour from p where place <= 3""")
def weighted_trip_order(spark, sf_dir):
    """Orders as vehicles, their items as trips weighed by quantity (every fourth part has none): the first three drawn of each day."""
    li = table(spark, sf_dir, "lineitem")
    trips = li.select(F.col("l_orderkey").alias("bldg_id"), F.lit(1).alias("vehicle_id"), F.col("l_linenumber").alias("trip"), (F.col("l_orderkey") % 2 == 0).alias("is_weekday"), F.col("l_linenumber").alias("departure"), F.lit(12).alias("arrival"), F.lit(1.0).alias("miles_driven"), (F.col("l_partkey") % 4 * F.col("l_quantity").cast("double")).alias("trip_weight"))
    return vehicles.schedules(trips, date(2022, 1, 1), date(2022, 1, 7), most=3).select("bldg_id", "date", "place", "departure_hour")


@query()
def vehicle_model(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("bldg_id"), (F.abs("c_acctbal") * 20).alias("income"), (F.col("c_custkey") % 5 + 1).alias("occupants"), F.col("c_mktsegment").alias("metro"), F.lit(1.0).alias("hh_weight"))
    known = c.withColumn("vehicles", F.when(F.col("income") < 50_000, 0).when(F.col("occupants") < 3, 1).otherwise(2))
    return vehicles.OwnershipModel(known).predict(c).select("bldg_id", "vehicles")


# --- catalogue, work lists, profiles, streams ----------------------------------------------------------------------


@query("""
    select c_nationkey as source_path, count(distinct c_mktsegment) as n_targets, count(distinct c_custkey) as n_buildings from customer group by 1""")
def work_by_source(spark, sf_dir):
    from wattloom.plans.ingest import work_by_source as work

    b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("source_path"), F.col("c_mktsegment").alias("target_path"), F.col("c_custkey").alias("bldg_id"))
    return work(b, most=7).groupBy("source_path").agg(F.countDistinct("target_path").alias("n_targets"), F.sum(F.size("bldg_ids")).alias("n_buildings"))


@query("""
    select event_type, count(value) as n, round(sum(value), 4) as total, round(avg(value), 6) as mean, min(value) as least, max(value) as greatest,
           round(sum(value) / (select sum(value) from events), 6) as share from events group by 1""")
def profile_stats(spark, sf_dir):
    p = checks.profile(table(spark, sf_dir, "events"), "value", ("event_type",))
    return p.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6), "share": F.round("share", 6)})


@query("""
    select quality as actual, toxic as predicted, count(*) as n, round(count(*) / (select count(*) from labels x where x.quality = l.quality), 6) as recall from labels l group by 1, 2""")
def confusion_matrix(spark, sf_dir):
    return checks.confusion(table(spark, sf_dir, "labels"), "quality", "toxic").withColumn("recall", F.round("recall", 6))


@query("select count(*) as n_sampled, round(avg(length(p_name)) * 500, 4) as estimated_bytes from (select * from part order by md5(concat('42:', p_name)), p_name limit 100) t")
def size_estimate(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.col("p_name").alias("path"), F.length("p_name").alias("length"))
    return lake.estimated_bytes(files, 500).withColumn("estimated_bytes", F.round("estimated_bytes", 4))


@query("""
    select user_id as bldg_id, date_trunc('hour', ts - interval 15 minute)::timestamp as timestamp, round(sum(value), 4) as value_sum, round(avg(value), 4) as value_mean
    from events group by 1, 2""")
def hourly_load_stream(spark, sf_dir):
    """The streaming roll-up run to the end of what there is; each batch's changed buckets go to a table of the shared folder."""
    from wattloom.streaming.rollup import rollup_stream, run_to_end

    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    own = stream.select(F.col("user_id").alias("bldg_id"), F.col("ts").alias("timestamp"), "value", F.col("value").alias("value_mean"))
    rolled = run_to_end(rollup_stream(own, {"value": "sum", "value_mean": "mean"}, "hourly", late=None), ("bldg_id", "timestamp"))
    return rolled.select("bldg_id", "timestamp", F.round("value", 4).alias("value_sum"), F.round("value_mean", 4).alias("value_mean"))


@query(f"""select c_custkey, case when {_draw_sql("'42'", "c_custkey")} < 0.8 then 'train' else 'test' end as part from customer""")
def train_test_split(spark, sf_dir):
    train, test = lake.split_by_hash(table(spark, sf_dir, "customer"), 0.8, 42, "c_custkey")
    return train.select("c_custkey", F.lit("train").alias("part")).unionByName(test.select("c_custkey", F.lit("test").alias("part")))


def _add_lake_queries() -> None:
    from wattloom import queries_lake

    QUERIES.update(queries_lake.QUERIES)
    ORACLE_SQL.update(queries_lake.ORACLE_SQL)


_add_lake_queries()
