"""Household surveys as tables: trips, households with vehicles, and the buildings that they are matched to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions.energy import at_most, clean_income, income_bucket, income_midpoint, occupants
from wattloom.functions.names import census_division, col, puma_suffix

# The survey files' column names and the names used here.
TRIP_COLUMNS = {
    "VEHCASEID": "hh_vehicle_id", "HHFAMINC": "income_bucket", "HHSIZE": "occupants", "HHVEHCNT": "vehicles", "TDWKND": "weekday",
    "STRTTIME": "start_time", "ENDTIME": "end_time", "TRPMILES": "miles_driven", "WTTRDFIN": "trip_weight", "URBRUR": "urban", "VEHID": "vehicle_id",
}
HOUSEHOLD_COLUMNS = {"PUMA": "puma", "HINCP": "income", "NP": "occupants", "VEH": "vehicles", "WGTP": "hh_weight"}
METADATA_COLUMNS = {"bldg_id": "bldg_id", "weight": "weight", "in.puma_metro_status": "metro", "in.puma": "puma", "in.income": "income", "in.occupants": "occupants"}


def read_csv(spark: SparkSession, path: str, text_columns: tuple[str, ...], columns: tuple[str, ...], null_value: str | None = None) -> DataFrame:
    """Some columns of a CSV file with a header: the named ones as text, the others as numbers."""
    header = spark.read.option("header", "true").csv(path).columns
    schema = ", ".join(f"`{c}` {'string' if c in text_columns or c not in columns else 'double'}" for c in header)
    reader = spark.read.option("header", "true").schema(schema)
    return (reader.option("nullValue", null_value) if null_value else reader).csv(path).select(*columns)


def clean_trips(raw: DataFrame, division: int) -> DataFrame:
    """Trips of a census division with a vehicle and an income, under the names used here."""
    use = (F.col("CENSUS_D") == division) & (F.col("HHVEHCNT") > 0) & (F.col("VEHCASEID") != "-1") & (F.col("HHFAMINC") > 0)
    whole = ("HHFAMINC", "HHSIZE", "HHVEHCNT", "TDWKND", "STRTTIME", "ENDTIME")
    return raw.where(use).select(*[F.col(a).cast("int" if a in whole else raw.schema[a].dataType).alias(b) for a, b in TRIP_COLUMNS.items()])


def load_trips(spark: SparkSession, path: str, state: str) -> DataFrame:
    division = spark.range(1).select(census_division(F.lit(state)).alias("d")).first()["d"]
    raw = read_csv(spark, path, ("VEHCASEID",), ("CENSUS_D", *TRIP_COLUMNS))
    return clean_trips(raw, division)


def clean_households(raw: DataFrame, metro_of_puma: DataFrame) -> DataFrame:
    """Households with an income, and the metro status of their area; an area with two gives two rows."""
    out = raw.select(*[F.col(a).cast("string" if a == "PUMA" else "long").alias(b) for a, b in HOUSEHOLD_COLUMNS.items()]).where("income > 0")
    return out.join(metro_of_puma, "puma", "left")


def load_households(spark: SparkSession, path: str, metro_of_puma: DataFrame) -> DataFrame:
    return clean_households(read_csv(spark, path, ("PUMA",), tuple(HOUSEHOLD_COLUMNS), null_value="b"), metro_of_puma)


def metro_puma_map(metadata: DataFrame) -> DataFrame:
    return metadata.select(puma_suffix(col("in.puma")).alias("puma"), col("in.puma_metro_status").alias("metro")).distinct()


def ev_buildings(metadata: DataFrame, state: str) -> DataFrame:
    """Occupied buildings of a state with income, its bucket, occupants and area code."""
    df = metadata.where(col("in.state") == state).select(*[col(a).alias(b) for a, b in METADATA_COLUMNS.items()])
    df = df.withColumn("occupants", occupants(F.col("occupants")).cast("short")).where("occupants > 0")
    df = df.withColumn("income", income_midpoint(clean_income(F.col("income"))))
    return df.withColumns({"income_bucket": income_bucket(F.col("income")).cast("short"), "puma": puma_suffix(F.col("puma"))})


def load_inputs(spark: SparkSession, metadata: str, households: str, trips: str, state: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Buildings, households and trips of a state from the three survey files."""
    raw = spark.read.option("mergeSchema", "true").parquet(metadata)
    own = load_households(spark, households, metro_puma_map(raw))
    return ev_buildings(raw, state), own, load_trips(spark, trips, state)


def capped_vehicles(df: DataFrame, most: int = 2) -> DataFrame:
    return df.withColumn("vehicles", at_most(F.col("vehicles"), most))
