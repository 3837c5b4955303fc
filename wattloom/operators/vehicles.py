"""Vehicles of buildings: how many, which surveyed vehicle each is like, and when it drives."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.errors import InvalidDates, UnseenLabels
from wattloom.functions.energy import at_most, draw, draw_key, draws_of, hour_of, hour_offset, is_weekday, md5_uniform, normal, within_day
from wattloom.operators.checks import drop_nulls, require_no_nulls
from wattloom.sources.shared import materialise

WEEKDAY_CODE, WEEKEND_CODE = 2, 1
FEATURES = ("income", "occupants", "metro")


@dataclass
class VehicleConfig:
    """start and end are dates, both of which count."""

    state: str
    start: date
    end: date
    max_vehicles: int = 2
    seed: int = 42
    feature_columns: tuple[str, ...] = field(default=FEATURES)

    def __post_init__(self) -> None:
        self.start, self.end = parse_dates(self.start, self.end)


def parse_dates(start: date | str, end: date | str) -> tuple[date, date]:
    try:
        a, b = (date.fromisoformat(x) if isinstance(x, str) else x for x in (start, end))
    except ValueError as e:
        raise InvalidDates(start=start, end=end) from e
    if a >= b:
        raise InvalidDates(start=start, end=end)
    return a, b


# --- how many: weighted multinomial logit -------------------------------------------------------------------------


class OwnershipModel:
    """Vehicles by income, occupants and metro status. Features are scaled by their population deviation; the penalty
    is half the squared weights against the summed weighted losses. Labels and classes keep alphabetical order."""

    def __init__(self, households: DataFrame, max_vehicles: int = 2) -> None:
        self.max_vehicles = max_vehicles
        whole, _ = drop_nulls(households, ["occupants", "income", "metro", "vehicles"])
        whole = whole.withColumn("vehicles", at_most(F.col("vehicles"), max_vehicles))
        self.metros = [r["metro"] for r in whole.select("metro").distinct().orderBy("metro").collect()]  # a few words
        self.classes = [r["vehicles"] for r in whole.select("vehicles").distinct().orderBy("vehicles").collect()]
        coded = self._coded(whole)
        stats = coded.agg(F.sum("hh_weight").alias("w"), *[f(c).alias(f"{n}_{c}") for c in FEATURES for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        self.scale = {c: (stats[f"m_{c}"], stats[f"s_{c}"] or 1.0) for c in FEATURES}
        labels = F.create_map(*[F.lit(x) for i, v in enumerate(self.classes) for x in (v, float(i))])
        fit = LogisticRegression(featuresCol="x", labelCol="y", weightCol="hh_weight", family="multinomial", standardization=False, regParam=1.0 / stats["w"], elasticNetParam=0.0, maxIter=2000, tol=1e-12)
        self.model = fit.fit(self._vectors(coded).withColumn("y", labels[F.col("vehicles")]))

    def _coded(self, df: DataFrame) -> DataFrame:
        codes = F.create_map(*[F.lit(x) for i, m in enumerate(self.metros) for x in (m, float(i))])
        return df.withColumns({"income": F.col("income").cast("double"), "occupants": F.col("occupants").cast("double"), "metro": codes[F.col("metro")]})

    def _vectors(self, coded: DataFrame) -> DataFrame:
        scaled = coded.withColumns({f"__{c}": (F.col(c) - m) / s for c, (m, s) in self.scale.items()})
        return VectorAssembler(inputCols=[f"__{c}" for c in FEATURES], outputCol="x").transform(scaled)

    @property
    def coefficients(self) -> np.ndarray:
        """(classes, income occupants metro), centred over classes."""
        c = self.model.coefficientMatrix.toArray()
        return c - c.mean(axis=0)

    def predict(self, buildings: DataFrame) -> DataFrame:
        """``buildings`` with their most likely number of vehicles. Nulls and unseen metro values are errors."""
        require_no_nulls(buildings, list(FEATURES))
        unseen = buildings.where(~F.col("metro").isin(*self.metros)).select("metro").distinct().limit(10).collect()
        if unseen:
            raise UnseenLabels(labels=[r["metro"] for r in unseen])
        kept = [c for c in buildings.columns if c != "vehicles"]
        own = buildings.select(*kept, *[F.col(c).alias(f"__own_{c}") for c in FEATURES])
        told = self.model.transform(self._vectors(self._coded(own)))
        classes = F.array(*[F.lit(c) for c in self.classes])
        restored = [F.col(f"__own_{c}").alias(c) if c in FEATURES else F.col(c) for c in kept]
        return told.select(*restored, F.get(classes, F.col("prediction").cast("int")).alias("vehicles"))


# --- which: hierarchical matching ----------------------------------------------------------------------------------


#: Match levels from the finest, with the columns that are compared.
LEVELS = {"exact": ("income_bucket", "occupants", "vehicles"), "income_occupants": ("income_bucket", "occupants"), "income_only": ("income_bucket",)}
KEY = ("level", "income_bucket", "occupants", "vehicles")


def match_levels(trips: DataFrame) -> DataFrame:
    """Surveyed vehicles as candidates of each level: level, its columns (the others null), hh_vehicle_id and its place.

    Places number a key's vehicles from 1 in the order of their md5. They are counted within the 256 ranges of the
    hash's first two digits and shifted by the ranges before, so that no key is numbered in one task.
    """
    names = LEVELS["exact"]
    each = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), *[(F.col(c) if c in used else F.lit(None).cast(trips.schema[c].dataType)).alias(c) for c in names]) for level, used in LEVELS.items()]))
    rows = trips.select(*names, "hh_vehicle_id").distinct().select("hh_vehicle_id", each.alias("x")).select("hh_vehicle_id", "x.*").distinct()
    rows = rows.withColumn("h", F.md5("hh_vehicle_id")).withColumn("range", F.substring("h", 1, 2))
    before = F.sum("n").over(Window.partitionBy(*KEY).orderBy("range")) - F.col("n")
    shifts = rows.groupBy(*KEY, "range").agg(F.count("*").alias("n")).select(F.struct(*KEY, "range").alias("k"), before.alias("before"))
    own = rows.withColumn("place", F.row_number().over(Window.partitionBy(*KEY, "range").orderBy("h", "hh_vehicle_id")))
    joined = own.join(shifts, F.struct(*KEY, "range").eqNullSafe(F.col("k")))
    return joined.select(*KEY, "hh_vehicle_id", (F.col("place") + F.col("before")).alias("place"))


def level_sizes(levels: DataFrame) -> DataFrame:
    """How many candidates each key of each level has, with the least and greatest id; a few rows, one a key."""
    return levels.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("hh_vehicle_id").alias("first_id"), F.max("hh_vehicle_id").alias("last_id"))


def closest_bucket(wanted: DataFrame, buckets: DataFrame) -> DataFrame:
    """income_bucket and the nearest bucket that has vehicles, ties to the lower. Both sides are a few codes."""
    own, there = wanted.select("income_bucket").distinct(), buckets.select(F.col("income_bucket").alias("near")).distinct()
    near = F.min_by("near", F.struct(F.abs(F.col("near") - F.col("income_bucket")), F.col("near")))
    return own.join(F.broadcast(there)).groupBy("income_bucket").agg(near.alias("near"))


def matched(buildings: DataFrame, levels: DataFrame) -> DataFrame:
    """Each building with vehicles, ``match`` (level and columns of its candidates' key) and how many there are.

    The finest level with at least as many candidates as vehicles wins; the closest income bucket is the last resort.
    Only sizes are joined, so a building never carries its candidates.
    """
    sizes = level_sizes(levels)
    own = buildings.where("vehicles > 0")
    for k, (level, used) in enumerate(LEVELS.items()):
        size = sizes.where(F.col("level") == level).select(*used, F.col("n").alias(f"__n{k}"))
        own = own.join(F.broadcast(size), list(used), "left")  # as many rows as there are codes
    widest = sizes.where("level = 'income_only'")
    near = closest_bucket(buildings, widest).join(F.broadcast(widest.select(F.col("income_bucket").alias("near"), F.col("n").alias("__n3"))), "near")
    own = own.join(F.broadcast(near), "income_bucket", "left")
    types = {c: levels.schema[c].dataType for c in LEVELS["exact"]}

    def key(level: str, income: str) -> F.Column:
        return F.struct(F.lit(level).alias("level"), *[(F.col(income if c == "income_bucket" else c) if c in LEVELS[level] else F.lit(None)).cast(t).alias(c) for c, t in types.items()])

    match, level, n = key("income_only", "near"), F.lit("closest_income"), F.coalesce("__n3", F.lit(0))
    for k, name in reversed(list(enumerate(LEVELS))):
        enough = F.coalesce(F.col(f"__n{k}") >= F.col("vehicles"), F.lit(False))
        match, level, n = F.when(enough, key(name, "income_bucket")).otherwise(match), F.when(enough, name).otherwise(level), F.when(enough, F.col(f"__n{k}")).otherwise(n)
    kept = [c for c in buildings.columns if c not in ("level", "match", "n_candidates")]
    return own.select(*kept, level.alias("level"), match.alias("match"), n.alias("n_candidates"))


def drawn_places(n: F.Column, k: F.Column, *seed: F.Column) -> F.Column:
    """k different places of 1 to n in the order drawn (all, if there are fewer): each is uniform over those left."""
    draw = lambda j: F.floor(md5_uniform(*seed, j.cast("string")) * (n - j)).cast("long")
    step = lambda acc, j: F.array_append(acc, F.aggregate(F.array_sort(acc), draw(j), lambda at, had: at + F.when(at >= had, 1).otherwise(0)))
    k = F.least(k.cast("long"), n.cast("long"))
    return F.when(k > 0, F.transform(F.aggregate(F.sequence(F.lit(0).cast("long"), k - 1), F.array().cast("array<bigint>"), step), lambda at: at + 1))


def pick_vehicles(matches: DataFrame, levels: DataFrame, seed: int, key: str = "bldg_id") -> DataFrame:
    """A row for each vehicle of each building, with the surveyed vehicle drawn for it: an equi-join on key and place."""
    places = drawn_places(F.col("n_candidates"), F.col("vehicles"), F.lit(str(seed)), F.col(key).cast("string"))
    wanted = matches.select("*", F.posexplode(places).alias("__n", "__place")).withColumn("vehicle_id", F.col("__n") + 1)
    there = levels.select(F.struct(*KEY).alias("__key"), F.col("place").alias("__at"), "hh_vehicle_id")
    both = wanted.join(there, F.col("match").eqNullSafe(F.col("__key")) & (F.col("__place") == F.col("__at")))
    return both.drop("match", "__n", "__place", "__key", "__at")


def vehicle_trips(picked: DataFrame, trips: DataFrame) -> DataFrame:
    """Trips of each building's vehicles: is_weekday, trip number within day type, hours, miles and weight."""
    own = trips.select("hh_vehicle_id", (F.col("weekday") == WEEKDAY_CODE).alias("is_weekday"), hour_of(F.col("start_time")).alias("departure"), hour_of(F.col("end_time")).alias("arrival"), "miles_driven", "trip_weight")
    number = F.row_number().over(Window.partitionBy("hh_vehicle_id", "is_weekday").orderBy("departure", "arrival", "miles_driven", "trip_weight"))
    return picked.select("bldg_id", "vehicle_id", "hh_vehicle_id").join(own.withColumn("trip", number), "hh_vehicle_id")


# --- when: the calendar --------------------------------------------------------------------------------------------


def calendar(spark, start: date, end: date) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day"))
    return days.select(F.col("day").cast("timestamp_ntz").alias("date"), is_weekday(F.col("day")).alias("is_weekday"))


def expand_calendar(trips: DataFrame, start: date, end: date) -> DataFrame:
    """Every trip on every day of its type: an equi-join with the calendar, which has a row a day."""
    return trips.join(F.broadcast(calendar(trips.sparkSession, start, end)), "is_weekday")


#: Trips times days that a task of ``schedules`` sorts.
TASK_ROWS = 1_000_000


def schedule_tasks(trips: DataFrame, start: date, end: date) -> int:
    """How many tasks the trips of all days are dealt to; counting is a job of its own, over Parquet one of its footers."""
    return max(trips.sparkSession.sparkContext.defaultParallelism, -(-trips.count() * ((end - start).days + 1) // TASK_ROWS))


def schedules(trips: DataFrame, start: date, end: date, seed: int = 42, most: int | None = None) -> DataFrame:
    """Trips with hourly offsets and varied miles, in the order drawn, all from hashes: no task order matters and no row needs Python.

    A vehicle's trips of a day are drawn without replacement by ``trip_weight``; ``place`` is a trip's place in that order, and
    ``most`` keeps the first so many. Trips without a positive weight come last, and equal ones go by their number.
    A hash is made once a row and gives all of its numbers. Rows are dealt by vehicle before days multiply them, to as many
    tasks as the count of trips asks for, and are sorted without their numbers, so a task's memory does not grow with the trips.
    """
    # dealt by a hash of its own: a constant id would drop out of the window's columns, which then asks for another shuffle
    dealt = trips.withColumn("__own", F.xxhash64("bldg_id", "vehicle_id")).repartition(schedule_tasks(trips, start, end), "__own")
    days = expand_calendar(dealt, start, end).withColumn("__h", draws_of(F.lit(seed), F.col("bldg_id"), F.col("vehicle_id"), F.col("trip"), F.date_format("date", "yyyy-MM-dd")))
    days = days.withColumn("__key", draw_key(F.col("trip_weight"), draw(F.col("__h"), 4)))
    order = Window.partitionBy("__own", "bldg_id", "vehicle_id", "date").orderBy(F.col("__key").asc_nulls_last(), "trip")
    placed = days.withColumn("place", F.row_number().over(order))
    if most is not None:
        placed = placed.where(F.col("place") <= most)
    drawn = placed.withColumns({f"__u{k}": draw(F.col("__h"), k) for k in range(4)})
    return drawn.select(
        "bldg_id", "vehicle_id", "date",
        within_day(F.col("departure") + hour_offset(F.col("__u2"))).cast("int").alias("departure_hour"),
        within_day(F.col("arrival") + hour_offset(F.col("__u3"))).cast("int").alias("arrival_hour"),
        normal(F.col("miles_driven"), F.col("miles_driven") * 0.1, F.col("__u0"), F.col("__u1")).alias("miles_driven"),
        "place",
    )


SCHEDULE = "bldg_id string, vehicle_id int, date timestamp_ntz, departure_hour int, arrival_hour int, miles_driven double"
_OFFSETS, _CHANCES = np.array([-2, -1, 0, 1, 2]), np.array([0.05, 0.10, 0.70, 0.10, 0.05])


def seeded_schedule(trips: pd.DataFrame, start: date, end: date, random: np.random.RandomState) -> pd.DataFrame:
    """One vehicle's schedule from one random stream: a day draws its order, miles, departures and arrivals, in that order."""
    by_type = {bool(k): g for k, g in trips.groupby("is_weekday")}
    out = []
    for n in range((end - start).days + 1):
        day = start + timedelta(days=n)
        own = by_type.get(day.weekday() < 5)
        if own is None:
            continue
        weight = own["trip_weight"].to_numpy(float)
        order = random.choice(len(own), size=len(own), replace=False, p=weight / weight.sum())
        own = own.iloc[order]
        miles = own["miles_driven"].to_numpy(float)
        varied = random.normal(miles, miles * 0.1)
        hours = [np.clip(own[c].to_numpy() + random.choice(_OFFSETS, size=len(own), p=_CHANCES), 0, 23) for c in ("departure", "arrival")]
        out.append(pd.DataFrame({"date": pd.Timestamp(day), "departure_hour": hours[0].astype("int32"), "arrival_hour": hours[1].astype("int32"), "miles_driven": varied}))
    columns = ["date", "departure_hour", "arrival_hour", "miles_driven"]
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=columns)


def stream_schedules(trips: DataFrame, start: date, end: date, seed: int = 42) -> DataFrame:
    """As ``schedules``, drawn from numpy's streams: one a vehicle, seeded by ``seed`` and the vehicle."""

    def draw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bldg, vehicle = key
        rows = rows.sort_values(["is_weekday", "trip"])
        stream = np.random.RandomState((seed + int(pd.util.hash_array(np.array([f"{bldg}:{vehicle}"], dtype=object))[0])) % 2**32)
        own = seeded_schedule(rows, start, end, stream)
        own.insert(0, "vehicle_id", vehicle)
        own.insert(0, "bldg_id", str(bldg))
        return own.astype({"vehicle_id": "int32"})

    return trips.groupBy("bldg_id", "vehicle_id").applyInPandas(draw, SCHEDULE)


def trip_schedules(buildings: DataFrame, households: DataFrame, trips: DataFrame, config: VehicleConfig) -> DataFrame:
    """The whole way: vehicles by the model, profiles by matching, schedules by the calendar."""
    counted = OwnershipModel(households, config.max_vehicles).predict(buildings)
    levels = match_levels(trips.withColumn("vehicles", at_most(F.col("vehicles"), config.max_vehicles)))
    picked = pick_vehicles(matched(counted, levels), levels, config.seed)
    return schedules(materialise(vehicle_trips(picked, trips)), config.start, config.end, config.seed)  # counted, then read
