"""Members of ZIP archives, and names in the XML files among them."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: What reading a damaged archive, or one that is null or encrypted, may raise.
UNREADABLE = (zipfile.BadZipFile, zlib.error, OSError, EOFError, RuntimeError, TypeError)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """path and content of each archive; a file is a row, and files are spread over tasks."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path).select("path", "content")


def members(zips: DataFrame, suffix: str, containing: str = "") -> DataFrame:
    """path, member and text of the first member of each archive that ends so; broken archives give a null member."""

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                name = text = None
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        name = next((n for n in z.namelist() if n.lower().endswith(suffix) and containing in n.lower()), None)
                        text = z.read(name).decode("utf-8", "replace") if name else None
                except UNREADABLE:
                    name = None
                rows.append((path, name, text))
            yield pd.DataFrame(rows, columns=["path", "member", "text"])

    return zips.select("path", "content").mapInPandas(first, "path string, member string, text string")


def first_station(xml: str | None) -> str:
    """The Name in the first WeatherStation element, in reading order, that has one; '' without one or for broken XML.

    Prefixes are left aside, whether they are declared or not.
    """
    path, text, found = [], [], []

    def start(tag: str, _: dict) -> None:
        path.append(tag.rpartition(":")[2])
        text.clear()

    def end(_: str) -> None:
        if path[-2:] == ["WeatherStation", "Name"]:
            found.append("".join(text).strip())
        path.pop()

    parser = expat.ParserCreate("utf-8")
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text.append
    try:
        parser.Parse((xml or "").encode(), True)
    except expat.ExpatError:
        return ""
    return next(filter(None, found), "")


def station_name(xml: Column) -> Column:
    """``first_station`` of a column of XML texts: a parse, so comments and entities are what they are in XML."""

    @F.pandas_udf("string")
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(first_station, na_action=None)

    return parse(xml)


def content_types(zips: DataFrame) -> DataFrame:
    """path and the file types that an archive's members stand for: a model (.xml) and a schedule (.csv)."""

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for content in frame["content"]:
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = [n.lower() for n in z.namelist()]
                except UNREADABLE:
                    names = []
                kinds = [("hpxml", any(n.endswith(".xml") for n in names)), ("schedule", any("schedule" in n and n.endswith(".csv") for n in names))]
                found.append([k for k, there in kinds if there])
            yield pd.DataFrame({"path": frame["path"], "file_types": found})

    return zips.select("path", "content").mapInPandas(probe, "path string, file_types array<string>")


def station_of_archives(zips: DataFrame) -> DataFrame:
    """path and weather_station_name, '' where an archive or its XML cannot be read."""
    return members(zips, ".xml").select("path", station_name(F.col("text")).alias("weather_station_name"))
