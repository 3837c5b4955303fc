"""The release catalogue: what each release offers, from two JSON files.

The catalogue has a row a release and lives on the driver; ``as_table`` gives the same to joins.
"""

from __future__ import annotations

import json
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.errors import MoreThanOneRelease, NoReleasesLeft, UnknownName, UpgradesOfNoRelease
from wattloom.functions.names import FILE_TYPES, PRODUCTS, STATES, VERSIONS, WEATHERS, YEARS

SCHEMA = "key string, product string, year string, weather string, version string, upgrades array<int>, file_types array<string>, trip_states array<string>, weather_states array<string>"


@dataclass(frozen=True)
class Release:
    key: str
    upgrades: dict[int, str | None] = field(hash=False)
    file_types: frozenset[str] = frozenset()
    trip_states: frozenset[str] = frozenset()
    weather_states: frozenset[str] = frozenset()

    @property
    def parts(self) -> tuple[str, str, str, str]:
        short, year, weather, version = self.key.split("_")
        return PRODUCTS[short], year, weather, version

    product = property(lambda self: self.parts[0])
    year = property(lambda self: self.parts[1])
    weather = property(lambda self: self.parts[2])
    version = property(lambda self: self.parts[3])

    def matches(self, **wanted) -> bool:
        """Equality on single values, any of several given, and all of the wanted upgrades and file types.

        ``states`` is accepted and not used: files, not the catalogue, tell which states there are.
        """
        for name, value in wanted.items():
            if value is None or name == "states":
                continue
            if name in ("upgrades", "file_types"):
                if not set(value) <= set(getattr(self, name)):
                    return False
            elif getattr(self, name) not in ({value} if isinstance(value, str) else set(value)):
                return False
        return True


def parse_key(key: str) -> Release:
    """A release with nothing known but its key."""
    parts = key.split("_")
    known = (PRODUCTS, YEARS, WEATHERS, VERSIONS)
    if len(parts) != 4 or any(p not in k for p, k in zip(parts, known, strict=True)):
        raise UnknownName(kind="release key", value=key)
    return Release(key, {})


class Catalogue:
    def __init__(self, releases: Collection[Release]) -> None:
        self._by_key = {r.key: r for r in sorted(releases, key=lambda r: r.key)}

    @classmethod
    def load(cls, releases_json: str, upgrades_json: str | None = None) -> Catalogue:
        """From the texts of the two files. Upgrades without a description stay, with none."""
        told = {k: v["upgrade_descriptions"] for k, v in json.loads(upgrades_json or "{}").items()}
        out = []
        for key, row in json.loads(releases_json).items():
            names = told.get(key, {})
            parse_key(key)
            out.append(Release(key, {int(u): names.get(u) for u in row["upgrade_ids"]}, frozenset(row["available_data"]), frozenset(row.get("trip_schedule_states", ())), frozenset(row.get("weather_map_available_states", ()))))
        return cls(out)

    def __iter__(self) -> Iterator[Release]:
        return iter(self._by_key.values())

    def __len__(self) -> int:
        return len(self._by_key)

    def __getitem__(self, key: str) -> Release:
        return self._by_key[key]

    def filter(self, **wanted) -> Catalogue:
        return Catalogue([r for r in self if r.matches(**wanted)])

    def at_least_one(self, **wanted) -> Catalogue:
        if not (found := self.filter(**wanted)):
            raise NoReleasesLeft(wanted=wanted)
        return found

    def one(self, **wanted) -> Release:
        found = list(self.at_least_one(**wanted))
        if len(found) > 1:
            raise MoreThanOneRelease(wanted=wanted, found=[r.key for r in found])
        return found[0]

    def facet(self, name: str) -> list:
        """Distinct values of key, product, year, weather or version, in their own order; unions of upgrades or file_types."""
        if name in ("upgrades", "file_types"):
            return sorted({x for r in self for x in getattr(r, name)})
        order = {"weather": WEATHERS, "version": VERSIONS}.get(name)
        return sorted({getattr(r, name) for r in self}, key=order.index if order else None)

    def as_table(self, spark: SparkSession) -> DataFrame:
        rows = [(r.key, *r.parts, sorted(r.upgrades), sorted(r.file_types), sorted(r.trip_states), sorted(r.weather_states)) for r in self]
        return spark.createDataFrame(rows, SCHEMA)


def upgrade_table(catalogue: Catalogue, spark: SparkSession) -> DataFrame:
    """key, upgrade, description (null if there is none)."""
    return spark.createDataFrame([(r.key, u, d) for r in catalogue for u, d in r.upgrades.items()], "key string, upgrade int, description string")


def as_json(catalogue: Catalogue) -> str:
    """The text of the releases file, as ``Catalogue.load`` reads it."""
    rows = {r.key: {"product": r.product, "release_year": r.year, "weather": r.weather, "release_number": r.version, "upgrade_ids": [str(u) for u in sorted(r.upgrades)], "available_data": sorted(r.file_types), "trip_schedule_states": sorted(r.trip_states), "weather_map_available_states": sorted(r.weather_states)} for r in catalogue}
    return json.dumps(rows, indent=2)


def upsert(old: Catalogue, found: Collection[Release]) -> Catalogue:
    """Releases of ``old`` and those found beside them. A known release keeps its upgrades; states are united."""
    rows = {r.key: r for r in old}
    for r in found:
        had = rows.get(r.key)
        if had is None:
            rows[r.key] = r
        else:
            rows[r.key] = Release(had.key, had.upgrades, had.file_types, had.trip_states | r.trip_states, had.weather_states | r.weather_states)
    return Catalogue(rows.values())


def from_table(rows: DataFrame) -> list[Release]:
    """Releases of a table as ``as_table`` gives, or of ``plans.ingest.available_files``: a row a release."""
    out = []
    for r in (row.asDict() for row in rows.collect()):
        parse_key(r.get("key") or r["release"])
        out.append(Release(r.get("key") or r["release"], dict.fromkeys(r["upgrades"] or ()), frozenset(r["file_types"] or ()), frozenset(r.get("trip_states") or ()), frozenset(r.get("weather_states") or ())))
    return out


def with_weather(buildings: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buildings (release, state) whose state has weather files in their release, and the others."""
    states = catalogue.select(F.col("key").alias("release"), F.explode("weather_states").alias("state"))
    return buildings.join(F.broadcast(states), ["release", "state"], "left_semi"), buildings.join(F.broadcast(states), ["release", "state"], "left_anti")


def unknown_upgrades(buildings: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Buildings (release, upgrade) with an upgrade that their release does not have."""
    there = catalogue.select(F.col("key").alias("release"), F.explode("upgrades").alias("upgrade"))
    return buildings.join(F.broadcast(there), ["release", "upgrade"], "left_anti")  # releases times upgrades


def require_upgrades(buildings: DataFrame, catalogue: DataFrame, show: int = 10) -> DataFrame:
    if bad := unknown_upgrades(buildings, catalogue).limit(show).collect():
        raise UpgradesOfNoRelease(found=[(r["release"], r["upgrade"]) for r in bad])
    return buildings


def key_grid(spark: SparkSession, **values: Collection) -> DataFrame:
    """All combinations of a few values of each name."""
    out = None
    for name, own in values.items():
        one = spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in own])).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def releases_with_trips(catalogue: DataFrame, trips: DataFrame) -> DataFrame:
    """Catalogue rows with the states that trip schedules exist for; trips: release and state."""
    states = trips.groupBy("release").agg(F.sort_array(F.collect_set("state")).alias("found_states"))
    return catalogue.join(states, catalogue["key"] == states["release"]).drop("release")


def check_file_types(wanted: Collection[str]) -> tuple[str, ...]:
    if bad := [w for w in wanted if w not in FILE_TYPES]:
        raise UnknownName(kind="file type", value=bad[0])
    return tuple(dict.fromkeys(wanted))


def check_states(wanted: Collection[str]) -> tuple[str, ...]:
    out = tuple(dict.fromkeys(w.strip().upper() for w in wanted))
    if bad := [w for w in out if w not in STATES]:
        raise UnknownName(kind="state", value=bad[0])
    return out
