"""Adoption scenarios: which building has which upgrade in which year, and the data of that mix.

A scenario maps upgrades to a share of buildings for each year. Buildings are ranked once by a seeded hash; each year's
new adopters of each upgrade take the next ranks, so adoption never falls back. The slices of ranks are a few numbers
that the driver computes; buildings get theirs by a range join with that small table, and a mix of any number of years and
upgrades is one scan joined to the allocation, not a scan for each year and upgrade.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.errors import (
    EmptyScenario, EmptyTrajectory, FallingAdoption, FractionOutOfRange, InvalidUpgradeId, MissingScenario, NoYears,
    TotalAboveOne, UnequalYears, UpgradesNotFound, WeightOutOfRange, WeightsOfOthers, WeightsSum, YearOutOfRange,
)
from wattloom.functions.energy import whole_target
from wattloom.sources.lake import Lake, seeded_order
from wattloom.sources.table import Table, new_rows

TOLERANCE = 1e-6
Scenario = Mapping[int, Sequence[float]]


def validate(scenario: Scenario) -> int:
    """The number of years; the first rule that is broken is the error."""
    if not scenario:
        raise EmptyScenario()
    for upgrade in scenario:
        if isinstance(upgrade, bool) or not isinstance(upgrade, int) or upgrade < 0:
            raise InvalidUpgradeId(upgrade=upgrade)
    lengths = {u: len(f) for u, f in scenario.items()}
    if len(set(lengths.values())) > 1:
        raise UnequalYears(lengths=lengths)
    (years,) = set(lengths.values())
    if not years:
        raise NoYears()
    for upgrade, shares in scenario.items():
        for year, (before, share) in enumerate(zip([0.0, *shares], shares, strict=False)):
            if not 0 <= share <= 1:
                raise FractionOutOfRange(upgrade=upgrade, year=year, fraction=share)
            if year and share < before:
                raise FallingAdoption(upgrade=upgrade, year=year, before=before, after=share)
    for year in range(years):
        parts = {u: f[year] for u, f in scenario.items()}
        if sum(parts.values()) > 1 + TOLERANCE:
            raise TotalAboveOne(year=year, total=sum(parts.values()), parts=parts)
    return years


def uniform_adoption(upgrades: Collection[int], weights: Mapping[int, float], trajectory: Sequence[float]) -> dict[int, list[float]]:
    """Each upgrade's share of the adoption of each year, by fixed weights."""
    if not upgrades:
        raise EmptyScenario()
    if set(weights) != set(upgrades):
        raise WeightsOfOthers(upgrades=sorted(upgrades), weights=dict(weights))
    if any(not 0 <= w <= 1 for w in weights.values()):
        raise WeightOutOfRange(weights=dict(weights))
    if abs(sum(weights.values()) - 1) > TOLERANCE:
        raise WeightsSum(weights=dict(weights))
    if not trajectory:
        raise EmptyTrajectory()
    validate({0: list(trajectory)})
    out = {u: [weights[u] * t for t in trajectory] for u in upgrades}
    validate(out)
    return out


def check_years(years: Collection[int] | None, n_years: int) -> list[int]:
    if years is None:
        return list(range(n_years))
    if bad := [y for y in years if not 0 <= y < n_years]:
        raise YearOutOfRange(year=bad[0], most=n_years - 1)
    return sorted(set(years))


def slices(scenario: Scenario, total: int) -> list[tuple[int, int, int, int]]:
    """(year, upgrade, first rank, end rank) of the new adopters, empty ones left out."""
    out, at, had = [], 0, dict.fromkeys(scenario, 0)
    for year in range(validate(scenario)):
        for upgrade, shares in scenario.items():
            target = whole_target(shares[year], total)
            if (new := target - had[upgrade]) > 0:
                out.append((year, upgrade, at, at + new))
                at, had[upgrade] = at + new, target
    return out


def ranked(buildings: DataFrame, seed: int, column: str = "bldg_id") -> DataFrame:
    """Buildings with their rank ``rn`` from 0 in the seeded order.

    Ranks come in two steps, so that no task holds all buildings: counts of hash ranges give each range its first rank,
    and rows are numbered within their range. A range is the first three hex digits of the hash, the order's own prefix.
    """
    hash_, id_ = seeded_order(seed, column)
    spread = buildings.withColumn("__h", hash_).withColumn("__r", F.substring("__h", 1, 3))
    counts = spread.groupBy("__r").agg(F.count("*").alias("__n"))  # at most 4096 rows
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("__r", before.alias("__first"))
    own = F.row_number().over(Window.partitionBy("__r").orderBy("__h", id_)) - 1
    return spread.join(F.broadcast(first), "__r").withColumn("rn", (own + F.col("__first")).cast("long")).drop("__h", "__r", "__first")


def _adopted(rn: Column, table: list[tuple[int, int, int, int]], value: int) -> Column:
    out = F.lit(None).cast("int")
    for row in reversed(table):
        out = F.when((rn >= row[2]) & (rn < row[3]), F.lit(row[value])).otherwise(out)
    return out


def adoption(buildings: DataFrame, scenario: Scenario, seed: int = 42, column: str = "bldg_id") -> DataFrame:
    """column, adopt_year and adopt_upgrade (null for those that never adopt)."""
    spark, ids = buildings.sparkSession, buildings.select(column).distinct()
    table = slices(scenario, ids.count())
    rows = ranked(ids, seed, column)
    if len(table) <= 64:  # a few ranges are one expression
        return rows.select(column, _adopted(F.col("rn"), table, 0).alias("adopt_year"), _adopted(F.col("rn"), table, 1).alias("adopt_upgrade"))
    small = F.broadcast(spark.createDataFrame(table, "adopt_year int, adopt_upgrade int, lo bigint, hi bigint"))  # years times upgrades
    return rows.join(small, (F.col("rn") >= F.col("lo")) & (F.col("rn") < F.col("hi")), "left").select(column, "adopt_year", "adopt_upgrade")


def materialised(buildings: DataFrame, scenario: Scenario, years: Collection[int] | None = None, seed: int = 42, column: str = "bldg_id") -> DataFrame:
    """year, column and upgrade_id of every building in every year; 0 before adoption."""
    wanted = check_years(years, validate(scenario))
    adopted = adoption(buildings, scenario, seed, column)
    each = adopted.select(column, "adopt_year", "adopt_upgrade", F.explode(F.array(*[F.lit(y) for y in wanted])).alias("year"))
    upgrade = F.when(F.col("adopt_year") <= F.col("year"), F.col("adopt_upgrade")).otherwise(F.lit(0))
    return each.select("year", column, upgrade.alias("upgrade_id"))


def join_data(allocation: DataFrame, data: DataFrame, column: str = "bldg_id") -> DataFrame:
    """Data rows of each year's upgrades: one scan, pruned to the allocation's upgrades by the caller.

    A calendar ``year`` in the data is kept as ``calendar_year``.
    """
    if "year" in data.columns:
        data = data.withColumnRenamed("year", "calendar_year")
    return data.withColumnRenamed("upgrade", "upgrade_id").join(allocation, [column, "upgrade_id"])


class ScenarioReader:
    """Reads and writes of a mix of upgrades over a lake."""

    def __init__(self, lake: Lake, scenario: Scenario | None, name: str = "scenario", seed: int = 42) -> None:
        if scenario is None:
            raise MissingScenario()
        self.n_years = validate(scenario)
        self.lake, self.scenario, self.name, self.seed = lake, scenario, name, seed

    @property
    def upgrades(self) -> list[int]:
        return sorted({0, *self.scenario})

    def buildings(self) -> DataFrame:
        """The sampled buildings, or all with baseline metadata in the lake's states."""
        return self.lake.baseline_buildings() if self.lake.sample_n is None else self.lake.sampled_buildings()

    def allocation(self, years: Collection[int] | None = None) -> DataFrame:
        return materialised(self.buildings(), self.scenario, years, self.seed)

    def check_available(self, file_type: str) -> None:
        there = set(self.lake.upgrades(file_type))
        if missing := [u for u in self.upgrades if u not in there]:
            raise UpgradesNotFound(file_type=file_type, upgrades=missing, path=self.lake.root)

    def read(self, file_type: str, years: Collection[int] | None = None) -> DataFrame:
        wanted = check_years(years, self.n_years)
        self.check_available(file_type)
        data = self.lake._scan(file_type).where(F.col("upgrade").isin(*self.upgrades))
        return join_data(self.allocation(wanted), data)

    def missing(self, file_type: str) -> DataFrame:
        """(bldg_id, upgrade_id) of the allocation that have no file."""
        wanted = self.allocation().select("bldg_id", "upgrade_id").distinct()
        there = self.lake.buildings_on_disk(file_type).select("bldg_id", F.col("upgrade").alias("upgrade_id"))
        return wanted.join(there, ["bldg_id", "upgrade_id"], "left_anti")

    def root(self, path: str | None = None) -> str:
        return path or f"{self.lake.root}/{self.lake.release}/mixed_upgrade/{self.name}"

    def save(self, file_type: str, path: str | None = None, years: Collection[int] | None = None) -> str:
        """The years in one job and one change, below ``<root>/<file_type>/year=Y``; other years stay. A folder of its own for
        each file type."""
        target = f"{self.root(path)}/{file_type}"
        wanted = self.lake.spark.createDataFrame([(y,) for y in check_years(years, self.n_years)], "year int")
        Table(self.lake.spark, target, ("year",), order=("bldg_id",)).merge(self.read(file_type, years), new_rows, partitions=wanted)
        return target

    def export_wide(self, path: str) -> None:
        """One CSV row a building: bldg_id, year_0, year_1, ..., by id. Part files are ranges of ids in the order of their names,
        so no task sorts all buildings; small exports are one file."""
        wide_export(self.allocation(), self.n_years).orderBy("bldg_id").write.mode("overwrite").option("header", "true").csv(path)


def wide_export(allocation: DataFrame, n_years: int, column: str = "bldg_id") -> DataFrame:
    years = [F.max(F.when(F.col("year") == y, F.col("upgrade_id"))).alias(f"year_{y}") for y in range(n_years)]
    return allocation.groupBy(column).agg(*years)


def adoption_counts(allocation: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Buildings and their share by year and upgrade, within the groups of further columns such as the state."""
    counts = allocation.groupBy(*by, "year", "upgrade_id").agg(F.count("*").alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "year")))


def empty_allocation(spark: SparkSession) -> DataFrame:
    """An allocation of no buildings."""
    return spark.createDataFrame([], "year int, bldg_id bigint, upgrade_id int")
