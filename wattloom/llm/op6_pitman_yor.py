"""Language-model scores by a hierarchical Pitman-Yor model.

Restaurants. Every token that was seen before another one is a context with a restaurant of its own, in which the tokens
that follow it sit; there are as many restaurants as the corpus asks for. All share one parent, whose customers are the
tables of its children; its base is uniform over the known tokens and one unknown.

Fit. Counts of (context, token) pairs are exact sums over all training texts. A Gibbs sweep seats each pair's customers
again, one after the other, by the Chinese restaurant process, given the parent's probabilities and the restaurants'
tables of the sweep before; a pair seen once has one table in any seating, so sweeps only read the others. Then the
parent's customers are seated again, and the strengths of both levels are drawn from their posterior by auxiliary variables
(discounts are the counts-of-counts estimates of each level). Pairs do not depend on each other within a sweep, and totals are summed after it. Customers past the 64th of a dish sit down in
doubling batches with the chance at the middle of the batch. After BURN_IN sweeps the predictive probabilities of SAMPLES
sweeps are averaged.

Rows. Pairs of two frequent tokens (of the HOT most frequent, which have short codes) and of one are counted by sorted, packed runs:
a task sends each bucket one run of the places it has gathered. A pair of a rare token and a frequent one is in the rare token's
bucket. Buckets are made for BUCKET bytes of text each. Sums of frequent tokens and their shares go to all tasks; pairs of
frequent tokens are seated where they lie, and only repeated pairs of rare tokens are joined in a sweep.

Scores. A score is the sum of log10 probabilities of the text's tokens, its end included, given the token before;
perplexity is 10 ** (-score / n_tokens). The HOT_PAIRS most frequent pairs and a filter of FILTER words of bits over all repeated
pairs of frequent tokens go to all tasks: tables of a fixed size, whatever the corpus. In a text that was trained on, a pair of
frequent tokens that is not repeated was seen once, here. (A full filter only means that more pairs are asked for.) All other pairs
of a text are asked for: packed by bucket they meet the bucket's pairs and rare tokens, and sums by text come back.
Pairs of two rare tokens are joined as rows.

Null texts are empty: one end token. Rows without an id count as held out. Repeated rows train once each and have scores
of their own. Texts of any length are read whole, a slice's pairs at a time. Ties in frequency only decide which tokens
are broadcast. Tokens are told by a 64-bit hash. An empty table gives an empty result; columns of other names are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import crc_mod, delete_dir, materialise, mix, read, shared_dir, slices_of, word_hashes, word_spans

HOT, HOT_PAIRS, FILTER = 200_000, 500_000, 1 << 21
BURN_IN, SAMPLES = 1, 2
#: Places of text that a task counts at once, pairs that it asks for at once, and bytes of text that a bucket is made for.
RUN, ASKED, BUCKET = 3_000_000, 1_000_000, 1 << 22
BUCKETS = 8
#: Texts that go to a task at once, bytes of them that are worked on at once, rows that a task packs at once, and bytes of packed
#: rows that a writer holds and a reader takes at once. Two tasks share an executor with the JVM, and their processes are reused.
TEXTS, SLICE, PACKED, GROUP = 1000, 1 << 18, 500_000, 1 << 22
#: Kinds of packed rows: pairs by how many of their tokens are frequent, and tokens.
FREQUENT, HALF, RARE, WORD = range(4)
#: Frequent tokens whose sums are a row.
PART = 4096

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
END = int(mix(np.array([0xE5D], _U)).view(np.int64)[0])


def tokens(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, token hash) of all words and, after those of each row, its end."""
    starts, stops, first = word_spans(raw, bounds)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n + 1)
    out = np.full(len(row), END, np.int64)
    at = np.arange(len(starts)) + np.repeat(np.arange(len(n)), n)
    out[at] = word_hashes(raw, starts, stops).view(np.int64)
    return row, out


def pair_keys(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair."""
    return mix(mix(context.view(_U) + _STEP) * _STEP + token.view(_U))


class Codes:
    """Frequent tokens by their rank, others by their hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        order = np.lexsort((hashes, -counts))
        self.counts = counts[order]
        by_hash = np.argsort(hashes[order])
        self.hashes, self.ranks = hashes[order][by_hash], by_hash

    def __len__(self) -> int:
        return len(self.hashes)

    def __call__(self, token: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return token
        place = np.minimum(np.searchsorted(self.hashes, token), len(self.hashes) - 1)
        return np.where(self.hashes[place] == token, self.ranks[place], token)

    def is_hot(self, code: np.ndarray) -> np.ndarray:
        return (code >= 0) & (code < len(self.hashes))

    def pairs(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, context, token) as codes; a text begins after an end."""
        row, token = tokens(raw, bounds)
        code = self(token)
        end = self(np.array([END]))
        return row, np.concatenate([end, code[:-1]]), code

    def kinds(self, u: np.ndarray, w: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
        """(kind, places, key, other) of some pairs: of two frequent tokens, of one rare token, and of two.

        A pair is told by its key and its other part; the key alone gives the bucket, so all pairs of a rare token with
        frequent ones are where the token itself is."""
        hot_u, hot_w = self.is_hot(u), self.is_hot(w)
        both, before, after, none = (np.flatnonzero(x) for x in (hot_u & hot_w, hot_u & ~hot_w, ~hot_u & hot_w, ~hot_u & ~hot_w))
        half = np.concatenate([before, after])
        return [
            (FREQUENT, both, u[both] * len(self) + w[both], None),
            (HALF, half, np.concatenate([w[before], u[after]]), np.concatenate([u[before], ~w[after]])),
            (RARE, none, u[none], w[none]),
        ]


def pair_of(kind: int, key: np.ndarray, other: np.ndarray, n_hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and token of pairs that ``Codes.kinds`` made."""
    if kind == FREQUENT:
        return np.divmod(key, max(n_hot, 1))
    if kind == HALF:
        return np.where(other >= 0, other, key), np.where(other >= 0, key, ~other)
    return key, other


# --- sorted runs ----------------------------------------------------------------------------------------------------


def packed(x: np.ndarray, kind=np.int64) -> bytes:
    return pa.Codec("zstd").compress(np.ascontiguousarray(x, dtype=kind).tobytes(), asbytes=True)


def unpacked(data: bytes | None, n: int, kind=np.int64) -> np.ndarray:
    if not data:
        return np.zeros(n, kind)
    return np.frombuffer(pa.Codec("zstd").decompress(data, decompressed_size=np.dtype(kind).itemsize * n), kind)


def packed_keys(key: np.ndarray) -> bytes:
    return packed(np.diff(key, prepend=0))


def unpacked_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(data, n))


def bucket_of(key: np.ndarray, n_buckets: int) -> np.ndarray:
    out = np.empty(len(key), np.int32)
    for i in range(0, len(key), SLICE):
        out[i : i + SLICE] = (mix(key[i : i + SLICE].view(_U) + _STEP) >> _U(40)) % _U(n_buckets)
    return out


def by_bucket(key: np.ndarray, n_buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the keys by bucket that keeps theirs within it, and (bucket, first, end) in that order."""
    bucket = bucket_of(key, n_buckets)
    ends = np.cumsum(np.bincount(bucket, minlength=n_buckets)).tolist()
    return np.argsort(bucket, kind="stable"), [(b, i, j) for b, (i, j) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if i < j]


def in_order(key: np.ndarray, other: np.ndarray | None) -> np.ndarray:
    return np.argsort(key, kind="stable") if other is None else np.lexsort((other, key))


def summed(key: np.ndarray, other: np.ndarray | None, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Distinct (key, other) in order, with the sums of n (how many, without it). A key alone is sorted where it lies."""
    if other is None and n is None:
        key.sort()
    else:
        order = in_order(key, other)
        key, other = key[order], None if other is None else other[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    if other is not None:
        new[1:] |= other[1:] != other[:-1]
    at = np.flatnonzero(new)
    sums = np.diff(np.append(at, len(key))) if n is None else np.add.reduceat(n[order], at) if len(at) else n
    return key[at], None if other is None else other[at], sums


def gathered(parts: list[np.ndarray]) -> np.ndarray | None:
    """The parts in one new array. The list is emptied, so that they go."""
    out = np.concatenate(parts) if parts else None
    parts.clear()
    return out


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


_RUN = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("others", pa.binary()), ("counts", pa.binary())])
RUN_COLUMNS = "bucket int, kind int, n int, keys binary, others binary, counts binary"
_SUMS = pa.schema([*_RUN, ("once", pa.bool_()), ("twice", pa.int64()), ("total", pa.int64())])
SUMS_COLUMNS = RUN_COLUMNS + ", once boolean, twice long, total long"


def counted(train: DataFrame, of, n_buckets: int) -> DataFrame:
    """Counts over all texts of what ``of`` (bytes, offsets to kind, places, key and other) lists, packed by bucket and kind,
    those of one apart.

    A task gathers RUN places, sorts and counts them, and sends each bucket one run, so that a pair adds an entry a run
    however often it occurs."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for kind in list(held):
                key, other, n = summed(*map(gathered, held.pop(kind)), None)
                order, ends = by_bucket(key, n_buckets)
                for b, i, j in ends:
                    own = order[i:j]
                    rows.append((b, kind, j - i, packed_keys(key[own]), None if other is None else packed(other[own]), packed(n[own], np.uint32)))
            return batch_of(rows, _RUN)

        for batch in batches:
            for _, _, raw, bounds in slices_of(batch.column(0), SLICE):
                for kind, _, key, other in of(raw, bounds):
                    if len(key):
                        keys, others = held.setdefault(kind, ([], []))
                        keys.append(key)
                        if other is not None:
                            others.append(other)
                        size += len(key)
                if size >= RUN:
                    yield flush()
                    size = 0
        if size:
            yield flush()
        let_go()

    def sums(table: pa.Table) -> pa.Table:
        held: dict[int, list[tuple]] = {}
        for r in table.to_pylist():
            held.setdefault(r["kind"], []).append((unpacked_keys(r["keys"], r["n"]), r["others"] and unpacked(r["others"], r["n"]), unpacked(r["counts"], r["n"], np.uint32)))
        rows, bucket = [], table.column("bucket")[0].as_py()
        for kind, parts in held.items():
            key, other, n = summed(np.concatenate([x[0] for x in parts]), None if parts[0][1] is None else np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts]).astype(np.int64))
            for once in (True, False):
                own = np.flatnonzero((n == 1) == once)
                if len(own):
                    rows.append((bucket, kind, len(own), packed_keys(key[own]), None if other is None else packed(other[own]), None if once else packed(n[own]), once, int((n[own] == 2).sum()), int(n[own].sum())))
        return pa.Table.from_batches([batch_of(rows, _SUMS)])

    listed = train.select("text").mapInArrow(runs, RUN_COLUMNS)
    return listed.repartition(-(-n_buckets // 4), "bucket").groupBy("bucket").applyInArrow(sums, SUMS_COLUMNS)


def _words(raw: np.ndarray, bounds: np.ndarray) -> list[tuple]:
    return [(WORD, None, tokens(raw, bounds)[1], None)]


def counts_of(row: dict) -> np.ndarray:
    return unpacked(row["counts"], row["n"]) if row["counts"] else np.ones(row["n"], np.int64)


@contextmanager
def few_texts(spark: SparkSession) -> Iterator[None]:
    """Jobs in it send a task at most TEXTS rows at once; the session's batch size is what it was afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(TEXTS, int(before)) if int(before) > 0 else TEXTS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def let_go() -> None:
    """Arrow gives back what it keeps of a task's batches: the process serves other tasks."""
    pa.default_memory_pool().release_unused()


def in_groups(df: DataFrame, path: str | None = None) -> DataFrame:
    """``materialise`` for packed rows: a writer holds about GROUP bytes of them, and a reader takes as many at once."""
    path = path or shared_dir(df.sparkSession)
    df.write.options(**{"parquet.block.size": GROUP, "parquet.page.size.row.check.min": 8}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_of(batches: Iterator[pa.RecordBatch], columns: list[str], of) -> Iterator[pa.RecordBatch]:
    """Packed rows one by one, as the columns that ``of`` makes of each."""
    for batch in batches:
        for k in range(batch.num_rows):
            (row,) = batch.slice(k, 1).to_pylist()
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in of(row)], names=columns)
    let_go()


def words_in(counts: DataFrame) -> DataFrame:
    return counts.select("n", "keys", "counts").mapInArrow(lambda b: rows_of(b, ["w", "c"], lambda r: (unpacked_keys(r["keys"], r["n"]), counts_of(r))), "w bigint, c bigint")


def pairs_in(counts: DataFrame, n_hot: int) -> DataFrame:
    """u, w and n of packed pairs."""

    def pair(r: dict):
        return *pair_of(r["kind"], unpacked_keys(r["keys"], r["n"]), unpacked(r["others"], r["n"]), n_hot), counts_of(r)

    return counts.select("kind", "n", "keys", "others", "counts").mapInArrow(lambda b: rows_of(b, ["u", "w", "n"], pair), "u bigint, w bigint, n bigint")


def uniform(*parts: np.ndarray | int) -> np.ndarray:
    """Numbers in [0, 1) drawn by hashing, so that a seat does not depend on the task that draws it."""
    x = np.full(1, 0x5EA7, _U)
    for p in parts:
        x = mix((p.view(_U) if isinstance(p, np.ndarray) else np.full(1, p, _U)) + x * _U(0x9E3779B97F4A7C15))
    return (x >> _U(11)).astype(float) / (1 << 53)


def seat(key: np.ndarray, customers: np.ndarray, fresh: np.ndarray, discount: float, sweep: int) -> np.ndarray:
    """Tables of each dish after its customers sat down; ``fresh``: the weight of a new table, with the parent's share."""
    tables = np.minimum(customers, 1).astype(np.int64)
    seated, live = 1, np.flatnonzero(customers > 1)
    while len(live):
        batch = 1 if seated < 64 else seated
        come = np.minimum(customers[live] - seated, batch)
        chance = fresh[live] / (fresh[live] + np.maximum(seated + (come - 1) / 2 - discount * tables[live], 1e-9))
        tables[live] += np.floor(come * chance + uniform(key[live], sweep, seated)).astype(np.int64)
        seated += batch
        live = live[customers[live] > seated]
    return np.minimum(tables, np.maximum(customers, 0))


def discount_of(once: int, twice: int) -> float:
    """The counts-of-counts estimate."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


@dataclass
class Level:
    """A level's discount and strength, its customers and tables."""

    discount: float
    strength: float = 1.0
    customers: float = 0.0
    tables: float = 0.0


def drawn_strength(level: Level, log_x: float, mean_y: float, var_y: float, seed: int) -> float:
    """A strength from its posterior under a Gamma(1, 1) prior, given the sums over restaurants of log x, x ~ Beta(strength + 1,
    customers - 1), and the mean and variance of the sum of y_i ~ Bernoulli(strength / (strength + discount i))."""
    rng = np.random.default_rng(seed)
    y = max(0.0, mean_y + np.sqrt(var_y) * rng.standard_normal())
    return float(np.clip(rng.gamma(1.0 + y) / (1.0 - log_x), 1e-3, 1e3))


def auxiliaries(customers: np.ndarray, tables: np.ndarray, level: Level, seed: int) -> tuple[float, float, float]:
    """Sums of log x, and of the mean and variance of y, over restaurants of two customers or more."""
    use = customers > 1
    c, t = customers[use].astype(float), tables[use].astype(np.int64)
    if not len(c):
        return 0.0, 0.0, 0.0
    rng = np.random.default_rng(seed)
    log_x = np.log(np.maximum(rng.beta(level.strength + 1, c - 1), 1e-300)).sum()
    known = np.arange(1, min(int(t.max()), 1 << 16) + 1)
    p = level.strength / (level.strength + level.discount * known)
    mean, var = (np.concatenate([[0.0], np.cumsum(x)]) for x in (p, p * (1 - p)))
    last = np.minimum(t - 1, len(known))
    beyond = np.where(t - 1 > last, np.log((level.strength + level.discount * (t - 1.0)) / (level.strength + level.discount * last)), 0.0) * level.strength / level.discount
    return float(log_x), float((mean[last] + beyond).sum()), float((var[last] + beyond).sum())


def less_tables(state: DataFrame) -> DataFrame:
    """k, du and dw: how many tables fewer than customers the repeated pairs of k have, as a context and as a token.

    Every occurrence of a token is one customer of a restaurant and a context once (a text begins after an end), and a
    pair seen once has as many tables as customers. So a token's count less these are its tables and parent's customers.
    """
    less, none = F.col("n") - F.col("t"), F.lit(0).cast("long")
    side = F.explode(F.array(F.struct(F.col("u").alias("k"), less.alias("du"), none.alias("dw")), F.struct(F.col("w").alias("k"), none.alias("du"), less.alias("dw"))))
    return state.select(side.alias("x")).select("x.*").groupBy("k").agg(F.sum("du").alias("du"), F.sum("dw").alias("dw"))


def seat_parent(table: DataFrame, root: Level, lower: Level, base: float, sweep: int) -> DataFrame:
    """``table`` (k, c, tu, rc) with rt, the tables of each token at the parent, and sums for the lower level's strength."""
    fresh = (root.strength + root.discount * root.tables) * base

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, c, tu, rc = (np.asarray(x) for x in batch.columns)
            rt = seat(k, rc, np.full(len(k), fresh), root.discount, sweep)
            sums = np.zeros((3, len(k)))
            if len(k):
                sums[:, 0] = auxiliaries(c, tu, lower, int(mix(k[:1].view(_U) + _U(sweep))[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rt), *map(pa.array, sums)], names=["k", "c", "tu", "rc", "rt", "log_x", "mean_y", "var_y"])

    return table.select("k", "c", "tu", "rc").mapInArrow(again, "k bigint, c bigint, tu bigint, rc bigint, rt bigint, log_x double, mean_y double, var_y double")


def seat_pairs(pairs: DataFrame, hot_tu: np.ndarray, hot_p: np.ndarray, lower: Level, sweep: int) -> DataFrame:
    """``pairs`` (u, w, n, kept, and tu, p of rare tokens) with t of a new sweep; kept: the tables of the samples so far."""
    shared = pairs.sparkSession.sparkContext.broadcast((hot_tu, hot_p))

    def filled(code: np.ndarray, hot: np.ndarray, own: pa.Array) -> np.ndarray:
        is_hot = (code >= 0) & (code < len(hot))
        return np.where(is_hot, hot[np.where(is_hot, code, 0)] if len(hot) else 0, np.asarray(pc.fill_null(own, 0)))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tu_of, p_of = shared.value
        for batch in batches:
            u, w, n = (np.asarray(c) for c in batch.columns[:3])
            tu, p = filled(u, tu_of, batch.column(4)), filled(w, p_of, batch.column(5))
            t = seat(pair_keys(u, w).view(np.int64), n, (lower.strength + lower.discount * tu) * p, lower.discount, sweep)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(t)], names=["u", "w", "n", "kept", "t"])

    return pairs.select("u", "w", "n", "kept", "tu", "p").mapInArrow(again, "u bigint, w bigint, n bigint, kept array<bigint>, t bigint")


_STATE = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("kept", pa.list_(pa.binary())), ("t", pa.binary())])


def seat_frequent(state: DataFrame, tu: np.ndarray, p: np.ndarray, lower: Level, sweep: int) -> DataFrame:
    """Packed pairs of frequent tokens with t of a new sweep."""
    shared = state.sparkSession.sparkContext.broadcast((tu, p))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tu, p = shared.value
        for batch in batches:
            for r in batch.to_pylist():
                u, w = pair_of(FREQUENT, unpacked_keys(r["keys"], r["n"]), None, len(tu))
                t = seat(pair_keys(u, w).view(np.int64), counts_of(r), (lower.strength + lower.discount * tu[u]) * p[w], lower.discount, sweep)
                yield batch_of([(r["bucket"], r["n"], r["keys"], r["counts"], r["kept"], packed(t))], _STATE)

    return state.select("bucket", "n", "keys", "counts", "kept").mapInArrow(again, "bucket int, n int, keys binary, counts binary, kept array<binary>, t binary")


def frequent_less(state: DataFrame, n_hot: int) -> np.ndarray:
    """``less_tables`` of the packed pairs: du and dw of each frequent token. Tasks add up their own, in parts of PART tokens."""
    schema = pa.schema([("part", pa.int32()), ("sums", pa.binary())])
    size = lambda part: 2 * min(PART, n_hot - part * PART)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, n_hot), np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                n = counts_of(r)
                less = n - (unpacked(r["t"], r["n"]) if r["t"] else 1)
                for k, code in enumerate(pair_of(FREQUENT, unpacked_keys(r["keys"], r["n"]), None, n_hot)):
                    total[k] += np.bincount(code, less, n_hot).astype(np.int64)
        if total.any():
            yield batch_of([(i // PART, packed(total[:, i : i + PART].ravel())) for i in range(0, n_hot, PART)], schema)

    def added(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        total = np.zeros(size(part), np.int64)
        for x in table.column("sums").to_pylist():
            total += unpacked(x, len(total))
        return pa.Table.from_batches([batch_of([(part, packed(total))], schema)])

    rows = state.select("n", "keys", "counts", "t").mapInArrow(own, "part int, sums binary").groupBy("part").applyInArrow(added, "part int, sums binary").toArrow().to_pylist()
    out = np.zeros((2, n_hot), np.int64)
    for r in rows:
        out[:, r["part"] * PART : (r["part"] + 1) * PART] = unpacked(r["sums"], size(r["part"])).reshape(2, -1)
    return out


def seat_unchanging(others: DataFrame, draws: list[tuple[float, float, int]]) -> DataFrame:
    """k, c and by sample tu, rc and rt of tokens without repeated pairs: all of their customers have tables. draws: the weight of
    a new table, the discount and the sweep."""
    names = ["k", "c", *[f"{x}{i}" for i in range(len(draws)) for x in ("tu", "rc", "rt")]]

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, c = (np.asarray(x) for x in batch.columns)
            columns = [k, c]
            for fresh, discount, sweep in draws:
                columns += [c, c, seat(k, c, np.full(len(k), fresh), discount, sweep)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    return others.select("k", "c").mapInArrow(again, ", ".join(f"{x} bigint" for x in names))


@dataclass
class Model:
    """Codes; the packed counts of all pairs; by sample the tables of repeated pairs, of two frequent tokens packed (``frequent``), of
    others as rows u, w, n, kept (``repeated``); and the tu, rc and rt of frequent tokens (``hot``) and rare ones (``rare``: k, c and those
    by sample) with the levels (parent's and restaurants') that make shares of them."""

    codes: Codes
    n_buckets: int
    counts: DataFrame
    frequent: DataFrame
    repeated: DataFrame
    hot: list[np.ndarray]
    rare: DataFrame
    levels: list[tuple[Level, Level]]
    n_tokens: int
    n_known: int
    discount: float

    @property
    def base(self) -> float:
        return 1.0 / (self.n_known + 1)

    @property
    def samples(self) -> int:
        return len(self.levels)

    @property
    def spare(self) -> np.ndarray:
        return np.array([parent_spare(root, self.base) for root, _ in self.levels])

    @property
    def single(self) -> DataFrame:
        """u and w of pairs seen once."""
        return pairs_in(self.counts.where("once"), len(self.codes)).select("u", "w")

    @property
    def multi(self) -> DataFrame:
        """u, w, n and kept (tables by sample) of pairs seen more often."""
        n_hot, samples = len(self.codes), self.samples

        def pairs(r: dict):
            t = np.stack([unpacked(x, r["n"]) for x in r["kept"]], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(r["n"] + 1) * samples, pa.int32()), pa.array(t.ravel()))
            return *pair_of(FREQUENT, unpacked_keys(r["keys"], r["n"]), None, n_hot), counts_of(r), lists

        own = self.frequent.mapInArrow(lambda b: rows_of(b, ["u", "w", "n", "kept"], pairs), "u bigint, w bigint, n bigint, kept array<bigint>")
        return own.unionByName(self.repeated)

    @property
    def table(self) -> DataFrame:
        """k, c and by sample each token's share of the parent ``p``, and as a context its weight of it ``b`` and one over its customers ``inv``."""
        hot = {"k": np.arange(len(self.codes)), "c": self.codes.counts}
        rare = self.rare.select("k", "c", *[x.alias(f"{name}{k}") for k, levels in enumerate(self.levels) for name, x in shares_by(*levels, self.base, f"{k}").items()])
        for k, of in enumerate(self.hot_shares()):
            hot |= {f"{name}{k}": x for name, x in zip(("p", "b", "inv"), of, strict=True)}
        return self.rare.sparkSession.createDataFrame(pa.table({x: pa.array(y) for x, y in hot.items()})).unionByName(rare)

    def hot_shares(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return [shares_of(self.codes.counts, *own, *levels, self.base) for own, levels in zip(self.hot, self.levels, strict=True)]


def with_rare(pairs: DataFrame, table: DataFrame, n_hot: int, at_u: list[str], at_w: list[str]) -> DataFrame:
    """``pairs`` of a rare token or two with some columns of the table of rare tokens for their context and their token, null where
    that is frequent. Each pair is shuffled by its rare tokens only, never by a frequent one."""
    of_u = table.select(F.col("k").alias("u"), *[F.col(c).alias(f"u_{c}") for c in at_u])
    of_w = table.select(F.col("k").alias("w"), *[F.col(c).alias(f"w_{c}") for c in at_w])
    hot_u, hot_w = hot_code("u", n_hot), hot_code("w", n_hot)
    both = pairs.where(~hot_u & ~hot_w).join(of_u, "u", "left").join(of_w, "w", "left")
    after = pairs.where(~hot_u & hot_w).join(of_u, "u", "left")
    before = pairs.where(hot_u & ~hot_w).join(of_w, "w", "left")
    return both.unionByName(after, allowMissingColumns=True).unionByName(before, allowMissingColumns=True)


def hot_code(column: str, n_hot: int):
    return F.col(column).between(0, n_hot - 1)


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now: its cleaner acts when the driver's JVM collects garbage,
    which it may not do for half an hour. What they led to is written, so no later stage reads them."""
    spark.sparkContext._jvm.System.gc()


class Tables:
    """Tables of the shared folder by name; one that takes another's name replaces it, and the other is deleted."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = shared_dir(self.spark)
        out = in_groups(df, path)
        self.drop(name)
        self.paths[name] = path
        forget_shuffles(self.spark)
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                delete_dir(self.spark, path)


def fit(train: DataFrame, hot: int = HOT, burn_in: int = BURN_IN, samples: int = SAMPLES) -> Model:
    """train: the training texts, in column ``text``."""
    spark = train.sparkSession
    tables = Tables(spark)
    size = train.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_buckets = max(BUCKETS, -(-size // BUCKET))
    with few_texts(spark):
        words = tables.put("words", counted(train, _words, n_buckets))
    n_tokens, n_known = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    known = words_in(words)
    least = hot_count(known, hot)
    hot_words = known.where(F.col("c") >= least).toArrow()
    codes = Codes(*_columns(hot_words, ["w", "c"], np.int64))
    n_hot, shared = len(codes), spark.sparkContext.broadcast(codes)

    def of(raw: np.ndarray, bounds: np.ndarray):
        _, u, w = shared.value.pairs(raw, bounds)
        return shared.value.kinds(u, w)

    with few_texts(spark):
        pairs = in_groups(counted(train, of, n_buckets))
    forget_shuffles(spark)
    once, twice = pairs.agg(F.coalesce(F.sum(F.when(F.col("once"), F.col("n"))), F.lit(0)), F.coalesce(F.sum("twice"), F.lit(0))).first()
    lower = Level(discount_of(once, twice))
    none, one = F.array().cast("array<bigint>"), F.lit(1).cast("long")
    frequent = pairs.where((F.col("kind") == FREQUENT) & ~F.col("once")).select("bucket", "n", "keys", "counts", F.array().cast("array<binary>").alias("kept"), F.lit(None).cast("binary").alias("t"))
    repeated = pairs_in(pairs.where((F.col("kind") != FREQUENT) & ~F.col("once")), n_hot)
    repeated = tables.put("repeated", repeated.select("u", "w", "n", none.alias("kept"), one.alias("t")))
    rare = known.where(F.col("c") < least).select(F.col("w").alias("k"), "c")
    met = less_tables(repeated).select("k")
    some = tables.put("some", rare.join(met, "k", "left_semi"))  # rare tokens of repeated pairs: those whose seats change by sweep
    others = tables.put("others", rare.join(met, "k", "left_anti").select("k", "c")).select("k", "c", F.col("c").alias("tu"), F.col("c").alias("rc"))
    tables.drop("words")
    base, root, drawn, tokens_of = 1.0 / (n_known + 1), None, [], np.arange(n_hot)
    for sweep in range(burn_in + samples + 1):
        less = tables.put("less", less_tables(repeated))
        hot_less = frequent_less(frequent, n_hot)
        k, *sides = _columns(less.where(hot_code("k", n_hot)).toArrow(), ["k", "du", "dw"], np.int64)
        for own, side in zip(hot_less, sides, strict=True):
            own[k] += side
        hot_tu, hot_rc = codes.counts - hot_less
        own = some.join(less, "k").select("k", "c", (F.col("c") - F.col("du")).alias("tu"), (F.col("c") - F.col("dw")).alias("rc"))
        if root is None:
            once, twice = own.unionByName(others).agg(F.count_if(F.col("rc") == 1), F.count_if(F.col("rc") == 2)).first()
            root = Level(discount_of(once + int((hot_rc == 1).sum()), twice + int((hot_rc == 2).sum())), 1.0, 0.0, float(n_known))
        used = Level(**vars(root))
        fresh = (used.strength + used.discount * used.tables) * base
        seated = tables.put(f"seated{max(sweep - burn_in, 0)}", seat_parent(own, root, lower, base, sweep))
        hot_rt = seat(tokens_of, hot_rc, np.full(n_hot, fresh), used.discount, sweep)
        sums = np.array(seated.unionByName(seat_parent(others, root, lower, base, sweep)).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("rc", "rt", "log_x", "mean_y", "var_y")]).first(), float)
        sums += [hot_rc.sum(), hot_rt.sum(), *auxiliaries(codes.counts, hot_tu, lower, 2 * sweep + 1_000_003)]
        root.customers, root.tables = float(sums[0]), float(sums[1])
        lower.strength = drawn_strength(lower, *map(float, sums[2:]), seed=2 * sweep)
        root.strength = drawn_strength(root, *auxiliaries(np.array([root.customers]), np.array([root.tables]), root, 2 * sweep + 1), seed=2 * sweep + 1)
        now = Level(**vars(root)), Level(**vars(lower))
        if sweep > burn_in:  # a sample: its pairs' tables are in ``repeated`` and ``frequent``
            drawn.append((seated, (fresh, used.discount, sweep), now, np.stack([hot_tu, hot_rc, hot_rt])))
            repeated, frequent = (x.withColumn("kept", F.array_append("kept", F.col("t"))) for x in (repeated, frequent))
        if sweep < burn_in + samples:
            hot_p = shares_of(codes.counts, hot_tu, hot_rc, hot_rt, *now, base)[0]
            shared_by = seated.select("k", "tu", shares_by(*now, base)["p"].alias("p"))
            joined = with_rare(repeated.drop("t"), shared_by, n_hot, ["tu"], ["p"]).withColumnsRenamed({"u_tu": "tu", "w_p": "p"})
            repeated = tables.put("repeated", seat_pairs(joined, hot_tu, hot_p, lower, sweep))
            frequent = tables.put("frequent", seat_frequent(frequent, hot_tu, hot_p, lower, sweep))
    table = None
    for k, (seated, *_) in enumerate(drawn):
        kept = seated.select("k", "c", *[F.col(x).alias(f"{x}{k}") for x in ("tu", "rc", "rt")])
        table = kept if table is None else table.join(kept.drop("c"), "k")
    rare = materialise(table.unionByName(seat_unchanging(others, [draw for _, draw, _, _ in drawn])))
    repeated, frequent = in_groups(repeated.drop("t")), in_groups(frequent.drop("t"))
    tables.drop(*list(tables.paths))
    forget_shuffles(spark)
    return Model(codes, n_buckets, pairs, frequent, repeated, [x for *_, x in drawn], rare, [now for _, _, now, _ in drawn], n_tokens, n_known, lower.discount)


def parent_spare(root: Level, base: float) -> float:
    """The parent's share of a token that was never seen."""
    return (root.strength + root.discount * root.tables) * base / (root.strength + root.customers)


def shares_of(c, tu, rc, rt, root: Level, lower: Level, base: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """p, b and inv of some tokens."""
    p = np.maximum(rc - root.discount * rt, 0.0) / (root.strength + root.customers) + parent_spare(root, base)
    inv = 1.0 / (lower.strength + c)
    return p, (lower.strength + lower.discount * tu) * inv, inv


def shares_by(root: Level, lower: Level, base: float, of: str = "", u: str = "", w: str = "") -> dict[str, Column]:
    """These as columns, of tu, rc and rt with ``of`` after their names, and ``u`` or ``w`` before them."""
    p = F.greatest(F.col(f"{w}rc{of}") - root.discount * F.col(f"{w}rt{of}"), F.lit(0.0)) / (root.strength + root.customers) + parent_spare(root, base)
    inv = 1.0 / (lower.strength + F.col(f"{u}c"))
    return {"p": p, "b": (lower.strength + lower.discount * F.col(f"{u}tu{of}")) * inv, "inv": inv}


# --- filters of pairs -----------------------------------------------------------------------------------------------


def filter_bits(key: np.ndarray, size: int, n_buckets: int = 1, bucket: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The word of each key, in its bucket's part of the words, and its three bits in it."""
    bits, part = np.zeros(len(key), _U), size // n_buckets
    for shift in (0, 6, 12):
        bits |= _U(1) << (key >> _U(shift) & _U(63))
    return (key >> _U(20)) % _U(part) + np.asarray(bucket).astype(_U) * _U(part), bits


def filter_size(n_buckets: int) -> int:
    """Words of a filter: as many for each bucket."""
    return max(FILTER // n_buckets, 1) * n_buckets


def filter_key(key: np.ndarray) -> np.ndarray:
    return mix(key.view(_U) * _STEP + _U(0xF117E4))


def filter_of(frequent: DataFrame, below: int, n_buckets: int) -> np.ndarray:
    """A filter that holds all packed pairs of a lower count than ``below``; each bucket fills its part."""
    size = filter_size(n_buckets)
    part = size // n_buckets

    def bits(r: dict):
        key = filter_key(unpacked_keys(r["keys"], r["n"])[counts_of(r) < below])
        at, own = filter_bits(key, part)
        words = np.zeros(part, _U)
        np.bitwise_or.at(words, at, own)
        return pa.array([r["bucket"]], pa.int32()), pa.array([packed(words, _U)], pa.binary())

    out = np.zeros(size, _U)
    for r in frequent.select("bucket", "n", "keys", "counts").mapInArrow(lambda b: rows_of(b, ["bucket", "words"], bits), "bucket int, words binary").toArrow().to_pylist():
        out[r["bucket"] * part : (r["bucket"] + 1) * part] |= unpacked(r["words"], part, _U)
    return out


def may_hold(words: np.ndarray, key: np.ndarray, n_buckets: int = 1, bucket: np.ndarray | int = 0) -> np.ndarray:
    word, bits = filter_bits(key, len(words), n_buckets, bucket)
    return words[word] & bits == bits


def hot_count(table: DataFrame, most: int = HOT) -> int:
    """The least count such that at most ``most`` rows have it or a larger one, from a histogram of counts.

    Counts of 64 or more share a bar with those of up to a 32nd more, so the histogram has some hundred bars at any size.
    A column ``times`` tells how many rows a row stands for.
    """
    c = F.col("c")
    bar = F.when(c < 64, c).otherwise(F.ceil(F.pow(F.lit(2.0), F.floor(F.log2(c) * 32) / 32)).cast("long"))
    seen, least = 0, 1 << 62
    rows = F.sum("times") if "times" in table.columns else F.count("*")
    for r in table.groupBy(bar.alias("least")).agg(rows.alias("n")).orderBy(F.desc("least")).collect():
        seen += r["n"]
        if seen > most:
            break
        least = r["least"]
    return least


def _columns(table: pa.Table, names: list[str], kind=float) -> list[np.ndarray]:
    return [np.asarray(table.column(c).combine_chunks(), dtype=kind) for c in names]


# --- scores ---------------------------------------------------------------------------------------------------------

_ASK = pa.schema([("__bucket", pa.int32()), ("__kind", pa.int32()), ("__n", pa.int32()), ("__keys", pa.binary()), ("__others", pa.binary()), ("__rows", pa.binary()), ("__times", pa.binary())])
ASK_COLUMNS = "__bucket int, __kind int, __n int, __keys binary, __others binary, __rows binary, __times binary"
_ANSWER = pa.schema([("__key", pa.int64()), ("n", pa.int32()), ("rows", pa.binary()), ("base", pa.binary()), ("total", pa.binary()), ("known", pa.binary())])
_KNOWN = pa.schema([*_RUN, ("kept", pa.list_(pa.binary()))])
KNOWN_COLUMNS = RUN_COLUMNS + ", kept array<binary>"


def packed_rows(rows: DataFrame, n_buckets: int, of) -> DataFrame:
    """Rows of pairs or tokens packed by bucket, PACKED of a task at a time; ``of`` (batch) gives kind, key, other, counts and a list of
    columns by sample, each a list of arrays that are packed one after the other."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            kind, key, other, counts, kept = of(pa.Table.from_batches(held).combine_chunks())
            order = in_order(key, other)
            by, ends = by_bucket(key[order], n_buckets)
            order = order[by]
            out = []
            for b, i, j in ends:
                own = order[i:j]
                out.append((b, kind, j - i, packed_keys(key[own]), None if other is None else packed(other[own]), packed(counts[own]), [packed(np.concatenate([x[own] for x in columns])) for columns in kept]))
            return batch_of(out, _KNOWN)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= PACKED:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()
        let_go()

    return rows.mapInArrow(pack, KNOWN_COLUMNS)


def known_rows(model: Model) -> DataFrame:
    """All that a bucket's questions need: its pairs but those of two rare tokens, and its rare tokens, as packed rows."""
    n_hot, samples = len(model.codes), range(model.samples)
    binary = lambda x: F.lit(x).cast("binary")
    once = model.counts.where(F.col("once") & (F.col("kind") != RARE)).select(*_RUN.names, F.array().cast("array<binary>").alias("kept"))
    frequent = model.frequent.select("bucket", F.lit(FREQUENT).alias("kind"), "n", "keys", binary(None).alias("others"), "counts", "kept")

    def halves(table: pa.Table):
        u, w, n = _columns(table, ["u", "w", "n"], np.int64)
        kept = np.asarray(table.column("kept").combine_chunks().flatten()).reshape(len(u), -1)
        hot_u = (u >= 0) & (u < n_hot)
        return HALF, np.where(hot_u, w, u), np.where(hot_u, u, ~w), n, [[kept[:, k]] for k in samples]

    def tokens(table: pa.Table):
        k, c = _columns(table, ["k", "c"], np.int64)
        return WORD, k, None, c, [_columns(table, [f"{x}{i}" for x in ("tu", "rc", "rt")], np.int64) for i in samples]

    half = model.repeated.where(hot_code("u", n_hot) | hot_code("w", n_hot)).select("u", "w", "n", "kept")
    return once.unionByName(frequent).unionByName(packed_rows(half, model.n_buckets, halves)).unionByName(packed_rows(model.rare, model.n_buckets, tokens))


def sums_by_row(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Distinct rows and the sums of their columns."""
    row, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    return row, *[np.bincount(at, x, len(row)) for x in np.concatenate([x for _, x in parts], axis=1)]


class Known:
    """The packed rows of a bucket: counts and tables of pairs, and rare tokens."""

    def __init__(self, rows: list[dict], samples: int) -> None:
        self.samples, held = samples, {}
        for r in rows:
            key, n, size = unpacked_keys(r["keys"], r["n"]), counts_of(r), r["n"]
            if r["kind"] == HALF:
                key = pair_keys(key, unpacked(r["others"], size)).view(np.int64)
            wide = 3 if r["kind"] == WORD else 1
            kept = np.stack([unpacked(x, wide * size).reshape(wide, size) for x in r["kept"]]) if r["kept"] else np.ones((samples, wide, size), np.int64)
            held.setdefault(r["kind"], []).append((key, n, kept))
        self.of = {}
        for kind, parts in held.items():
            key = np.concatenate([x[0] for x in parts])
            order = np.argsort(key)
            self.of[kind] = key[order], np.concatenate([x[1] for x in parts])[order], np.concatenate([x[2] for x in parts], axis=2)[:, :, order]

    def find(self, kind: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is there, its count (0 if not) and its numbers by sample (0 if not)."""
        wide = 3 if kind == WORD else 1
        if kind not in self.of:
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64), np.zeros((self.samples, wide, len(key)), np.int64)
        keys, n, kept = self.of[kind]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        there = keys[at] == key
        return there, np.where(there, n[at], 0), np.where(there, kept[:, :, at], 0)


def score_texts(docs: DataFrame, model: Model, hot_pairs: int = HOT_PAIRS, trained: str | None = None) -> DataFrame:
    """The columns of ``docs`` but text, n_tokens, n_known, base_score and score; docs: text and narrow columns.

    ``trained`` names a column that tells which texts the model was fitted on; without it none counts as such, which
    costs more and gives the same scores.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c != "text"]
    n_hot, samples, discount, n_buckets = len(model.codes), range(model.samples), model.discount, model.n_buckets

    def count(r: dict):
        return np.unique(counts_of(r), return_counts=True)

    counts = model.frequent.select("n", "counts").mapInArrow(lambda b: rows_of(b, ["c", "times"], count), "c bigint, times bigint")
    least = hot_count(counts, hot_pairs)

    def often(r: dict):
        own = np.flatnonzero(counts_of(r) >= least)
        return unpacked_keys(r["keys"], r["n"])[own], counts_of(r)[own], *[unpacked(x, r["n"])[own] for x in r["kept"]]

    names = ["key", "n", *[f"t{k}" for k in samples]]
    key, n, *kept = _columns(model.frequent.mapInArrow(lambda b: rows_of(b, names, often), ", ".join(f"{x} bigint" for x in names)).toArrow(), names, np.int64)
    p_of, b_of, inv_of = (np.array(x) for x in zip(*model.hot_shares(), strict=True))  # (samples, HOT)
    u, w = pair_of(FREQUENT, key, None, n_hot)
    chance = ((n - discount * np.array(kept)) * inv_of[:, u] + b_of[:, u] * p_of[:, w]).mean(axis=0)
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast((model.codes, (p_of, b_of, inv_of), key[order], np.log10(chance[order]), filter_of(model.frequent, least, n_buckets)))
    base_of, base_all = 0.1, model.n_tokens + 0.1 * (model.n_known + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, (p, b, inv), keys, chances, repeated = shared.value
        task, counter, size, first = TaskContext.get().partitionId() << 40, 0, 0, 0
        asked: dict[int, tuple[list[np.ndarray], ...]] = {}
        hot_base = np.log10((codes.counts + base_of) / base_all)
        out = ["__key", *columns, "n_tokens", "__known", "__base", "__total", *_ASK.names]

        def flush(types: list[pa.DataType]) -> pa.RecordBatch:
            rows = []
            for kind in list(asked):
                key, other, row = map(gathered, asked.pop(kind))
                order = np.lexsort((row, key) if other is None else (row, other, key))
                key, row, other = key[order], row[order], None if other is None else other[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                if other is not None:
                    new[1:] |= other[1:] != other[:-1]
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(key)))
                by, ends = by_bucket(key[at], n_buckets)
                at, times = at[by], times[by]
                rows += [(x, kind, j - i, packed_keys(key[at[i:j]]), None if other is None else packed(other[at[i:j]]), packed(row[at[i:j]], np.int32), packed(times[i:j], np.int32)) for x, i, j in ends]
            batch = batch_of(rows, _ASK)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), task + first)), *[pa.nulls(len(rows), t) for t in types], *batch.columns], names=out)

        for batch in batches:
            types = [*[c.type for c in batch.columns[: len(columns)]], pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            for i, j, raw, bounds in slices_of(batch.column(len(columns) + 1), SLICE):
                row, u, w = codes.pairs(raw, bounds)
                hot = codes.is_hot(w)
                n, n_known = np.bincount(row, minlength=j - i), np.bincount(row[hot], minlength=j - i)
                base = np.bincount(row[hot], hot_base[w[hot]], j - i).astype(float)  # of no rows it is whole
                total = np.zeros(j - i)
                own_row = np.asarray(batch.column(len(columns)).slice(i, j - i).to_numpy(zero_copy_only=False), dtype=bool)
                for kind, place, key, other in codes.kinds(u, w):
                    if kind == FREQUENT and len(place):
                        at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
                        there = keys[at] == key if len(keys) else np.zeros(len(key), bool)
                        total += np.bincount(row[place[there]], chances[at[there]], j - i)
                        # seen once, in this very text
                        alone = np.flatnonzero(~there & own_row[row[place]])
                        alone = alone[~may_hold(repeated, filter_key(key[alone]), n_buckets, bucket_of(key[alone], n_buckets))]
                        x, y = u[place[alone]], w[place[alone]]
                        once = ((1 - discount) * inv[:, x] + b[:, x] * p[:, y]).mean(axis=0)
                        total += np.bincount(row[place[alone]], np.log10(once), j - i)
                        there[alone] = True
                        place, key = place[~there], key[~there]
                    if len(place):
                        for parts, x in zip(asked.setdefault(kind, ([], [], [])), (key, other, (row[place] + (counter - first)).astype(np.int32)), strict=True):
                            if x is not None:
                                parts.append(x)
                        size += len(place)
                ids = pa.array(task + counter + np.arange(j - i))
                counter += j - i
                yield pa.RecordBatch.from_arrays([ids, *[c.slice(i, j - i) for c in batch.columns[: len(columns)]], *map(pa.array, (n, n_known, base, total)), *[pa.nulls(j - i, f.type) for f in _ASK]], names=out)
                if size >= ASKED:
                    yield flush(types)
                    size, first = 0, counter
        if size:
            yield flush(types)
        let_go()

    schema = "__key bigint, " + "".join(f"`{x}` {t}, " for x, t in docs.select(*columns).dtypes) + "n_tokens bigint, __known bigint, __base double, __total double, " + ASK_COLUMNS
    told = F.coalesce(F.col(trained), F.lit(False)) if trained else F.lit(False)
    with few_texts(spark):
        parts = in_groups(docs.select(*columns, told.alias("__trained"), "text").mapInArrow(score, schema))  # keys are fixed by writing them
    forget_shuffles(spark)
    asked = parts.where("__bucket is not null").select("__key", *_ASK.names)
    width = -(-n_buckets // 4)
    questions, known = asked.where(F.col("__kind") != RARE).repartition(width, "__bucket"), known_rows(model).repartition(width, "bucket")
    spare = model.spare

    def answer(asks: pa.Table, known: pa.Table) -> pa.Table:
        if not asks.num_rows:
            return pa.Table.from_batches([batch_of([], _ANSWER)])
        (p, b, inv), here = shared.value[1], Known(known.to_pylist(), len(samples))
        sums: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for r in asks.to_pylist():
            key, other = unpacked_keys(r["__keys"], r["__n"]), unpacked(r["__others"], r["__n"])
            row, times = (unpacked(r[x], r["__n"], np.int32) for x in ("__rows", "__times"))
            u, w = pair_of(r["__kind"], key, other, n_hot)
            there, n, kept = here.find(r["__kind"], key if r["__kind"] == FREQUENT else pair_keys(key, other).view(np.int64))
            base, c = np.zeros(len(key)), np.zeros(len(key), np.int64)
            if r["__kind"] == FREQUENT:
                of_b, of_inv, of_p = b[:, u], inv[:, u], p[:, w]
            else:
                after = other >= 0  # the rare token comes second
                is_known, c, seats = here.find(WORD, key)
                rare = [shares_of(c, *seats[k], *model_levels[k], model_base) for k in samples]
                of_p = np.where(after, np.where(is_known, [x[0] for x in rare], spare[:, None]), p[:, np.where(after, 0, w)])
                of_b = np.where(after, b[:, np.where(after, u, 0)], np.where(is_known, [x[1] for x in rare], 1.0))
                of_inv = np.where(after, inv[:, np.where(after, u, 0)], [x[2] for x in rare])
                base = np.where(after, np.log10((c + base_of) / base_all), 0.0)
                c = np.where(after, c, 0)
            chance = (np.where(there, (n - discount * kept[:, 0]) * of_inv, 0.0) + of_b * of_p).mean(axis=0)
            sums.setdefault(r["__key"], []).append((row, np.stack([times * base, times * np.log10(chance), times * (c > 0)])))
        rows = []
        for first, parts in sums.items():
            row, *own = sums_by_row(parts)
            rows.append((first, len(row), packed(row, np.int32), *[packed(x, float) for x in own]))
        return pa.Table.from_batches([batch_of(rows, _ANSWER)])

    def together(table: pa.Table) -> pa.Table:
        parts = [(unpacked(r["rows"], r["n"], np.int32), np.stack([unpacked(r[x], r["n"], float) for x in ("base", "total", "known")])) for r in table.to_pylist()]
        row, base, total, n = sums_by_row(parts)
        return pa.table({"__key": pa.array(table.column("__key")[0].as_py() + row.astype(np.int64)), "base": pa.array(base), "total": pa.array(total), "known": pa.array(n.astype(np.int64))})

    # a bucket answers the questions of a flush in one row, so that rows do not grow with texts times buckets
    model_levels, model_base = model.levels, model.base
    answers = questions.groupBy("__bucket").cogroup(known.groupBy("bucket")).applyInArrow(answer, "__key bigint, n int, rows binary, base binary, total binary, known binary")
    answers = answers.groupBy("__key").applyInArrow(together, "__key bigint, base double, total double, known bigint")

    def far_pairs(r: dict):
        row, times = (unpacked(r[x], r["__n"], np.int32).astype(np.int64) for x in ("__rows", "__times"))
        return r["__key"] + row, unpacked_keys(r["__keys"], r["__n"]), unpacked(r["__others"], r["__n"]), times

    # pairs of two rare tokens
    far = asked.where(F.col("__kind") == RARE).mapInArrow(lambda x: rows_of(x, ["__key", "u", "w", "m"], far_pairs), "__key bigint, u bigint, w bigint, m bigint")
    once = pairs_in(model.counts.where(F.col("once") & (F.col("kind") == RARE)), n_hot).select("u", "w", "n", F.lit(None).cast("array<bigint>").alias("kept"))
    seen = model.repeated.where(~hot_code("u", n_hot) & ~hot_code("w", n_hot)).select("u", "w", "n", "kept").unionByName(once)
    met = with_rare(far.join(seen, ["u", "w"], "left"), model.rare, n_hot, ["c", *[f"tu{k}" for k in samples]], ["c", *[f"{x}{k}" for k in samples for x in ("rc", "rt")]])
    chance = F.lit(0.0)
    for k, levels in zip(samples, model.levels, strict=True):
        tables = F.coalesce(F.get("kept", F.lit(k)), F.lit(1).cast("long"))
        of = shares_by(*levels, model.base, f"{k}", "u_", "w_")
        own = F.when(F.col("n") > 0, (F.col("n") - discount * tables) * of["inv"]).otherwise(0.0)
        p = F.when(F.col("w_c").isNull(), F.lit(float(spare[k]))).otherwise(of["p"])
        chance = chance + own + F.when(F.col("u_c").isNull(), 1.0).otherwise(of["b"]) * p
    c = F.coalesce("w_c", F.lit(0).cast("long"))
    far_sums = met.select("__key", (F.col("m") * F.log10((c + base_of) / base_all)).alias("base"), (F.col("m") * F.log10(chance / model.samples)).alias("total"), F.when(c > 0, F.col("m")).otherwise(0).alias("known"))
    sums = answers.unionByName(far_sums).groupBy("__key").agg(F.sum("base").alias("__asked_base"), F.sum("total").alias("__asked_total"), F.sum("known").alias("__asked_known"))
    both = parts.where("__bucket is null").drop(*_ASK.names).join(sums, "__key", "left")
    return both.select(
        *columns, "n_tokens", (F.col("__known") + F.coalesce("__asked_known", F.lit(0))).alias("n_known"),
        (F.col("__base") + F.coalesce("__asked_base", F.lit(0.0))).alias("base_score"), (F.col("__total") + F.coalesce("__asked_total", F.lit(0.0))).alias("score"),
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    held_out = F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(True))
    docs = read(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), (~held_out).alias("trained"), "text")
    model = fit(docs.where("trained"))
    scored = score_texts(docs, model, trained="trained")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
