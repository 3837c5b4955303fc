"""Model archives as tables: one typed row a model, one row a line of its schedule."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator, Mapping
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from wattloom.sources.archives import UNREADABLE, members, station_name

#: Lines of a schedule that a task holds at once.
LINES = 8192
_BROKEN = "__broken"


def _schema(tree: Mapping) -> StructType:
    """Every element may come more than once, so each is an array; leaves are text, cast afterwards."""

    def kind(below: Mapping) -> DataType:
        return ArrayType(_schema(below) if below else StringType())

    return StructType([StructField(name, kind(below)) for name, below in tree.items()])


def _getter(name: str):
    return lambda x: x[name]


def _values(at: Column, names: list[str]) -> Column:
    """All values below a place, in reading order."""
    found = F.array(at)
    for name in names:
        below = F.transform(found, _getter(name))
        found = F.filter(F.flatten(F.filter(below, lambda x: x.isNotNull())), lambda x: x.isNotNull())
    return found


def models(zips: DataFrame, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """path, parsed, weather_station_name and the fields of each archive's model, a row an archive.

    fields: a column's name to its place below the root (``Building/BuildingDetails/Area``, prefixes left aside) and type. A
    place that comes more than once gives its first value that is not empty; a value that is not of the type, and a place
    that is not there, are null. Archives without a model, and those that are broken, have parsed = false and nulls.
    """
    tree: dict = {}
    for place, _ in fields.values():
        at = tree
        for name in place.split("/"):
            at = at.setdefault(name, {})
    schema = _schema(tree).add(_BROKEN, StringType())
    own = members(zips, ".xml").select("path", "text", station_name(F.col("text")).alias("weather_station_name"))
    read = own.withColumn("__x", F.from_xml("text", schema, {"ignoreNamespace": "true", "columnNameOfCorruptRecord": _BROKEN, "mode": "PERMISSIVE"}))
    parsed = F.col("text").isNotNull() & F.col("__x").isNotNull() & F.col(f"__x.{_BROKEN}").isNull()
    first = lambda place: F.get(F.filter(_values(F.col("__x"), place.split("/")), lambda v: F.trim(v) != ""), F.lit(0))
    return read.select("path", parsed.alias("parsed"), "weather_station_name", *[F.when(parsed, F.trim(first(place)).try_cast(kind)).alias(name) for name, (place, kind) in fields.items()])


def _whole(z: zipfile.ZipFile, name: str) -> bool:
    """Whether a member can be read to its end, in pieces; its checksum is looked at there."""
    with z.open(name) as f:
        while f.read(1 << 20):
            pass
    return True


def schedules(zips: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """path, line (from 0) and the columns of each line of the archives' schedules.

    columns: a column's name to its type; a value that is not of the type, and a column that a schedule lacks, are null,
    other columns are left out. Archives that cannot be read whole, or have no schedule, have no rows.
    """
    names = list(columns)

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                    name = next((n for n in z.namelist() if n.lower().endswith(".csv") and "schedule" in n.lower()), None)
                    if name is None or not _whole(z, name):
                        continue
                except UNREADABLE:
                    continue
                with z, z.open(name) as f:
                    rows, at = csv.DictReader(io.TextIOWrapper(f, "utf-8", "replace", newline="")), 0
                    while part := list(islice(rows, LINES)):
                        yield pd.DataFrame({"path": path, "line": range(at, at + len(part)), **{f"c{i}": [r.get(c) for r in part] for i, c in enumerate(names)}})
                        at += len(part)

    text = zips.select("path", "content").mapInPandas(lines, ", ".join(["path string", "line bigint", *[f"c{i} string" for i in range(len(names))]]))
    return text.select("path", "line", *[F.trim(f"c{i}").try_cast(columns[c]).alias(c) for i, c in enumerate(names)])


def with_building(rows: DataFrame) -> DataFrame:
    """Adds bldg_id and upgrade from the archive's name in ``path``; rows of other names go."""
    name = r"bldg(\d+)-up(\d+)\.zip$"
    id_ = F.regexp_extract("path", name, 1)
    return rows.where(id_ != "").withColumns({"bldg_id": id_.cast("bigint"), "upgrade": F.regexp_extract("path", name, 2).cast("int")})
