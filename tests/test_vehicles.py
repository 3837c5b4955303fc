"""Matching, schedules and the ownership model on the values that are known for them."""

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattloom import errors
from wattloom.operators import vehicles
from wattloom.operators.vehicles import OwnershipModel, VehicleConfig

TRIPS = list(zip(["v1", "v2", "v3", "v4", "v4", "v1", "v3"], [1, 2, 2, 3, 3, 1, 2], [2, 3, 3, 4, 4, 2, 3], [1, 2, 2, 1, 1, 1, 2], [2, 2, 2, 2, 2, 1, 1], [800, 900, 1000, 800, 1300, 1100, 1400], [1700, 1800, 1900, 1200, 1700, 1500, 1800], [20.0, 30.0, 40.0, 10.0, 15.0, 25.0, 35.0], [1.0] * 7, strict=True))
BUILDINGS = [("b1", 1, 2, 1, "urban"), ("b2", 2, 3, 2, "suburban"), ("b3", 3, 4, 1, "rural"), ("b4", 2, 1, 0, "urban")]


@pytest.fixture(scope="module")
def trips(spark):
    return spark.createDataFrame(TRIPS, "hh_vehicle_id string, income_bucket int, occupants int, vehicles int, weekday int, start_time int, end_time int, miles_driven double, trip_weight double")


@pytest.mark.parametrize(
    ("income", "occupants", "n", "level", "candidates"),
    [(1, 2, 1, "exact", {"v1"}), (2, 3, 2, "exact", {"v2", "v3"}), (2, 3, 1, "income_occupants", {"v2", "v3"}), (3, 2, 1, "income_only", {"v4"}), (4, 2, 1, "closest_income", {"v4"})],
)
def test_match_levels(spark, trips, income, occupants, n, level, candidates):
    b = spark.createDataFrame([("b", income, occupants, n)], "bldg_id string, income_bucket int, occupants int, vehicles int")
    levels = vehicles.match_levels(trips)
    (row,) = vehicles.matched(b, levels).collect()
    there = {r["hh_vehicle_id"] for r in levels.collect() if tuple(r)[:4] == tuple(row["match"])}
    assert row["level"] == level and there == candidates and row["n_candidates"] == len(candidates)


def test_profiles(spark, trips):
    b = spark.createDataFrame(BUILDINGS, "bldg_id string, income_bucket int, occupants int, vehicles int, metro string")
    levels = vehicles.match_levels(trips)
    picked = vehicles.pick_vehicles(vehicles.matched(b, levels), levels, 42)
    got = {(r["bldg_id"], r["vehicle_id"]): r["hh_vehicle_id"] for r in picked.collect()}
    assert set(got) == {("b1", 1), ("b2", 1), ("b2", 2), ("b3", 1)} and {got["b2", 1], got["b2", 2]} == {"v2", "v3"}
    own = vehicles.vehicle_trips(picked, trips)
    assert own.where("bldg_id = 'b3'").count() == 2 and own.where("bldg_id = 'b4'").count() == 0
    days = vehicles.schedules(own, date(2022, 1, 1), date(2022, 1, 7))
    assert days.count() == vehicles.expand_calendar(own, date(2022, 1, 1), date(2022, 1, 7)).count()
    assert days.where("departure_hour not between 0 and 23 or arrival_hour not between 0 and 23").count() == 0
    assert sorted(map(tuple, days.collect())) == sorted(map(tuple, vehicles.schedules(own.repartition(3), date(2022, 1, 1), date(2022, 1, 7)).collect()))
    assert vehicles.stream_schedules(own, date(2022, 1, 1), date(2022, 1, 7)).count() == days.count()


def test_tasks_grow_with_the_trips(spark, monkeypatch):
    monkeypatch.setattr(vehicles, "TASK_ROWS", 1000, raising=False)
    trips = spark.range(3000).selectExpr("id div 3 as bldg_id", "1 as vehicle_id", "int(id % 3) as trip", "true as is_weekday", "8 as departure", "9 as arrival", "1.0D as miles_driven", "1.0D as trip_weight")
    days = vehicles.schedules(trips, date(2022, 1, 3), date(2022, 1, 7), most=2)
    assert days.rdd.getNumPartitions() == 15 and days.count() == 10_000
    assert max(len(rows) for rows in days.select("bldg_id").rdd.glom().collect()) < 1200


def test_drawn_places_are_different_and_uniform(spark):
    rows = spark.range(3000).select(vehicles.drawn_places(F.lit(5), F.lit(3), F.lit("s"), F.col("id").cast("string")).alias("p")).collect()
    assert all(len(set(r["p"])) == 3 and set(r["p"]) <= {1, 2, 3, 4, 5} for r in rows)
    for j in range(3):
        counts = np.bincount([r["p"][j] for r in rows], minlength=6)[1:]
        assert counts.min() > 480 and counts.max() < 720
    few = spark.range(1).select(vehicles.drawn_places(F.lit(2), F.lit(3), F.lit("s")).alias("p"), vehicles.drawn_places(F.lit(0), F.lit(3), F.lit("s")).alias("q")).first()
    assert sorted(few["p"]) == [1, 2] and few["q"] is None


def test_schedule_of_a_seeded_stream():
    own = pd.DataFrame({"is_weekday": [True, False], "departure": [8, 10], "arrival": [17, 19], "miles_driven": [20.0, 25.0], "trip_weight": [1.0, 1.0]})
    got = vehicles.seeded_schedule(own, date(2022, 1, 1), date(2022, 1, 7), np.random.RandomState(42))
    assert got["departure_hour"].tolist() == [10, 10, 8, 8, 8, 8, 8] and got["arrival_hour"].tolist() == [18, 19, 17, 17, 17, 17, 16]
    assert got["miles_driven"].tolist() == pytest.approx([22.22029970, 25.79725546, 18.83824373, 18.94966038, 19.14390787, 18.51518632, 20.24443833], rel=1e-8)


HOUSEHOLDS = "occupants long, income long, metro string, vehicles long, hh_weight double"


def test_weighted_coefficients(spark):
    df = spark.createDataFrame([(1, 30_000, "urban", 0, 2.0), (2, 50_000, "urban", 1, 1.5), (3, 75_000, "suburban", 2, 1.0), (4, 100_000, "suburban", 2, 0.5)], HOUSEHOLDS)
    want = np.array([[-0.62737, -0.54794, 0.14318], [0.20245, 0.11507, 0.47692], [0.42492, 0.43287, -0.62010]])
    got = OwnershipModel(df).coefficients
    # columns are income, occupants, metro; the known table lists occupants and income the other way round or as here
    best = min(np.abs(got - want).max(), np.abs(got[:, [1, 0, 2]] - want).max())
    assert best < 1e-3


def test_model_caps_drops_nulls_and_refuses_unknowns(spark):
    df = spark.createDataFrame([(1, 30_000, "urban", 0, 1.0), (2, 50_000, "urban", 1, 1.0), (3, 75_000, "rural", 3, 1.0), (4, 99_000, "rural", 5, 1.0), (None, 1, "urban", 1, 1.0)], HOUSEHOLDS)
    model = OwnershipModel(df)
    assert model.classes == [0, 1, 2]
    b = spark.createDataFrame([("b", 1, 30_000, "urban")], "bldg_id string, occupants long, income long, metro string")
    assert tuple(model.predict(b).select("bldg_id", "income", "metro").first()) == ("b", 30_000, "urban")
    with pytest.raises(errors.NullInputs):
        model.predict(b.withColumn("income", F.lit(None).cast("long")))
    with pytest.raises(errors.UnseenLabels):
        model.predict(b.withColumn("metro", F.lit("moon")))


def test_config_dates():
    assert VehicleConfig("NY", "2022-01-01", "2022-01-02").end == date(2022, 1, 2)
    for start, end in (("2022-01-02", "2022-01-01"), ("x", "2022-01-01")):
        with pytest.raises(errors.InvalidDates):
            VehicleConfig("NY", start, end)


def test_trip_schedules_of_all_line_items(spark, tmp_path):
    from wattloom.queries import trip_schedule_noise

    items = [(order, line, 3 * order + line, 5 * order + line, 10.0 * line) for order in (1, 2, 3) for line in range(1, 8)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r["bldg_id"], r["vehicle_id"], r["date"].day): r for r in trip_schedule_noise(spark, str(tmp_path)).collect()}
    days = [date(2022, 1, d) for d in range(1, 8)]
    assert set(got) == {(str(o), line, d.day) for o, line, part, _, _ in items for d in days if (d.weekday() < 5) == (part % 2 == 0)}
    for order, line, part, supp, miles in items:
        for d in days:
            if (r := got.get((str(order), line, d.day))) is not None:
                assert abs(r["departure_hour"] - (supp % 12 + 6)) <= 2 and abs(r["arrival_hour"] - min(supp % 12 + 10, 23)) <= 2 and abs(r["miles_driven"] - miles) < miles
