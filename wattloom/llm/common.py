"""Helpers shared by the corpus operators: table access, shared storage, text as bytes."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text is worked on in slices of about so many bytes, which bounds the temporary arrays of a task.
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; where that is unset (tests), a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/wattloom-checkpoints"
    return f"{root}/{uuid.uuid4().hex}"


def delete_dir(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have in any case: ``name``, or that with underscores before it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null stays null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def crc_mod_py(value, modulus: int) -> int:
    return zlib.crc32(str(value).encode()) % modulus


# --- text columns as one byte buffer -------------------------------------------------------------------------------


def byte_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the row offsets into them (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def row_slices(bounds: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``most`` bytes; a longer row is a range of its own."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def slices_of(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for each slice of a string column."""
    raw, bounds = byte_buffer(column)
    for i, j in row_slices(bounds, most):
        yield i, j, raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # A-Z to a-z, nothing else


def fold(raw: np.ndarray) -> np.ndarray:
    return _FOLD[raw]


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


#: Bytes of words of letters and digits only; all of a character beyond ASCII counts as such.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_spans(raw: np.ndarray, bounds: np.ndarray, inside: np.ndarray = ~_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of ``inside`` bytes (not 0x20 or 0x09-0x0D), and the first word of each row."""
    inside = inside[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(raw)]
    before[edges] = False
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    ends = bounds[1:][bounds[1:] > 0] - 1
    after[ends] = False
    starts = np.flatnonzero(inside & ~before)
    stops = np.flatnonzero(inside & ~after) + 1
    return starts, stops, np.searchsorted(starts, bounds)


_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        for name, base in (("p", _P), ("q", _P_INVERSE)):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["p"], _powers["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased: a polynomial over its bytes, mixed with its length."""
    p, q = _power_table(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_FOLD[raw].astype(np.uint64) + np.uint64(1)) * p[: len(raw)], out=sums[1:])
    poly = (sums[stops] - sums[starts]) * q[starts]
    return mix(poly ^ mix((stops - starts).astype(np.uint64)))


def hash_word(word: str) -> int:
    """word_hashes of one word, as the signed long that Spark holds."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(raw)])).view(np.int64)[0])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, most: int) -> DataFrame:
    """doc_id, text and label of at most ``most`` labelled rows, those of least hash among the rows of ``labels``.

    Null labels and ids are left out; an id that is labelled twice counts with its greatest label.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & may_learn)
    known = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = known.orderBy(F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string")), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # ``most`` rows bound the broadcast
