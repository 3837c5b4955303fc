"""Choosing, renaming and adding columns by the families that their names tell."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions.names import col

# Name parts that mark a column's family.
KEY_WORDS = ("bldg_id", "upgrade", "metadata_index")
# The columns that hold each fact, best first.
PRIORITIES = {
    "puma": ("in.puma", "in.nhgis_puma_gisjoin", "in.resstock_puma_id"),
    "state": ("in.state", "in.state_name"),
    "county": ("in.resstock_county_id", "in.nhgis_county_gisjoin", "in.county_name", "in.county"),
    "bldg_id": ("bldg_id",),
}


def keep_columns(df: DataFrame, keep: Callable[[str], bool]) -> DataFrame:
    return df.select(*[col(c) for c in df.columns if keep(c)])


def compact_metadata(df: DataFrame) -> DataFrame:
    """Ids, upgrade, weight, characteristics (in.) and measures (upgrade.)."""
    return keep_columns(df, lambda c: any(k in c for k in KEY_WORDS) or c == "weight" or c.startswith(("in.", "upgrade.")))


def compact_annual(df: DataFrame) -> DataFrame:
    """Ids, upgrade, weight and outputs (out.), without characteristics and measures."""
    keep = lambda c: any(k in c for k in KEY_WORDS) or c == "weight" or c.startswith("out.")
    return keep_columns(df, lambda c: keep(c) and not c.startswith(("in.", "upgrade.")))


def first_available(columns: Iterable[str], priorities: Mapping[str, tuple[str, ...]] = PRIORITIES) -> dict[str, str]:
    """The best column that there is for each fact; facts without one are left out."""
    have = set(columns)
    found = {fact: next((c for c in names if c in have), None) for fact, names in priorities.items()}
    return {fact: c for fact, c in found.items() if c is not None}


def canonical_columns(df: DataFrame, priorities: Mapping[str, tuple[str, ...]] = PRIORITIES) -> DataFrame:
    return df.select(*[col(c).alias(fact) for fact, c in first_available(df.columns, priorities).items()])


def with_constants(df: DataFrame, **values) -> DataFrame:
    """Adds literal columns; None adds none."""
    return df.withColumns({k: F.lit(v) for k, v in values.items() if v is not None})
