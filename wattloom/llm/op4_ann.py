"""Approximate nearest neighbours: inverted lists of coarse centroids, product-quantised residuals, exact reranking.

Fit: coarse centroids and the codebooks of the residuals come from at most FIT_ROWS vectors of least hash, by Lloyd's
algorithm on the driver; list count and codebooks are bounded, so the model can be broadcast. Every vector is indexed.

How many lists a query probes is measured: TUNING_QUERIES of the queries themselves meet all rows in one scan, and as
many lists are probed as it takes for TUNED_RECALL of their true neighbours to be in them. (Sampled rows in place of queries
tell nothing about queries that lie elsewhere than most rows.) Vectors without clusters need more than half of the lists.

Search: a query probes so many nearest lists, and further ones until they hold enough candidates. Lists are cut in
blocks, queries of a list in chunks, so a list that holds a third of all vectors is spread over tasks. In a task, each
query's table of squared distances from its residual to the code words adds up to a distance per candidate. The true distance
differs from it by at most the candidate's own coding error, so whatever these bounds keep out of a block's k nearest is
dropped and no true one with it; the others are computed exactly, in double precision, and the k nearest go on to a
window over the query.

Null, zero or not finite vectors, rows without an id, and vectors of another length than the most common one take no
part. Ties go to the smaller id; repeated rows are candidates of their own, and a query meets all rows but those with
its id. Query rows that share an id are one query: a candidate counts once, with its least distance to any of them. Fewer
than k candidates are all returned, if need be from further lists. An empty table gives an empty result; columns other
than vec_id and embedding are never read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.llm.common import materialise, read

K, TUNED_RECALL, TUNING_QUERIES = 10, 0.99, 256
FIT_ROWS, MAX_LISTS, SUBSPACE, WORDS = 20_000, 4096, 4, 256
BLOCK, CHUNK = 512, 2048
SEED = 5


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, dim and v (array<double>) of the vectors that take part, but for their length."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    use = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    return vectors.where(use).select("vec_id", F.size("embedding").alias("dim"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def lloyd(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """At most k centroids of the rows of x; the first k distinct rows are the start."""
    _, first = np.unique(x, axis=0, return_index=True)
    centroids = x[np.sort(first)[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([squared(x[i : i + 4096], centroids).argmin(axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        own, at = np.unique(near[order], return_index=True)
        moved = centroids.copy()
        moved[own] = np.add.reduceat(x[order], at, axis=0) / np.diff(np.append(at, len(x)))[:, None]
        if np.allclose(moved, centroids, rtol=1e-6, atol=0):
            break
        centroids = moved
    return centroids


@dataclass
class Index:
    """The centre of all, coarse centroids (lists, dim) less it and code words (subspaces, WORDS, SUBSPACE); short dimensions
    are padded by 0."""

    centre: np.ndarray
    coarse: np.ndarray
    words: np.ndarray

    def parts(self, residual: np.ndarray) -> np.ndarray:
        width = self.words.shape[0] * self.words.shape[2]
        padded = np.pad(residual, ((0, 0), (0, width - residual.shape[1])))
        return padded.reshape(len(residual), self.words.shape[0], -1)

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """(rows, subspaces, WORDS): squared distances of residuals to the code words."""
        parts = self.parts(residual)
        return np.stack([squared(parts[:, s], self.words[s]) for s in range(len(self.words))], axis=1)

    def assign(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code of each vector."""
        v = v - self.centre
        near = squared(v, self.coarse).argmin(axis=1)
        return near, self.tables(v - self.coarse[near]).argmin(axis=2).astype(np.uint8)

    def nearest_lists(self, q: np.ndarray) -> np.ndarray:
        return squared(q - self.centre, self.coarse).argsort(axis=1, kind="stable")


def fit(sample: np.ndarray, n: int) -> Index:
    """An index for n vectors from a bounded sample of them."""
    centre = sample.mean(axis=0)
    sample = sample - centre
    coarse = lloyd(sample, int(np.clip(round(np.sqrt(n) / 2), 1, MAX_LISTS)))
    residual = sample - coarse[squared(sample, coarse).argmin(axis=1)]
    n_parts = -(-sample.shape[1] // SUBSPACE)
    padded = np.pad(residual, ((0, 0), (0, n_parts * SUBSPACE - sample.shape[1]))).reshape(len(sample), n_parts, SUBSPACE)
    words = np.full((n_parts, WORDS, SUBSPACE), np.inf)
    for s in range(n_parts):
        own = lloyd(padded[:, s], WORDS)
        words[s, : len(own)] = own
        words[s, len(own) :] = own[0]
    return Index(centre, coarse, words)


def true_lists(index: Index, indexed: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(query place, list) of the true k nearest others of a few queries, by one scan of all rows."""
    shared = indexed.sparkSession.sparkContext.broadcast((index.centre, ids, q - index.centre))

    def scan(batches):
        centre, own_ids, own = shared.value
        best, lists = np.full((len(own), 1), np.inf), np.zeros((len(own), 1), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                distance = squared(own, _matrix(part.column(1), part.num_rows) - centre)
                distance[own_ids[:, None] == np.asarray(part.column(0))[None, :]] = np.inf
                best = np.concatenate([best, distance], axis=1)
                lists = np.concatenate([lists, np.broadcast_to(np.asarray(part.column(2)), distance.shape)], axis=1)
                least = np.argpartition(best, k - 1, axis=1)[:, :k] if best.shape[1] > k else np.tile(np.arange(best.shape[1]), (len(own), 1))
                best, lists = np.take_along_axis(best, least, axis=1), np.take_along_axis(lists, least, axis=1)
        place, at = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(lists[place, at]), pa.array(best[place, at])], names=["place", "list", "distance"])

    near = indexed.select("vec_id", "v", "list").mapInArrow(scan, "place bigint, list bigint, distance double")
    first = F.row_number().over(Window.partitionBy("place").orderBy("distance"))
    return [(r["place"], r["list"]) for r in near.withColumn("n", first).where(F.col("n") <= k).collect()]  # k a query


def probes_needed(index: Index, q: np.ndarray, true: list[tuple[int, int]], recall: float = TUNED_RECALL) -> int:
    """The least number of nearest lists that hold ``recall`` of the queries' true neighbours."""
    if not true:
        return 1
    place, own = np.array(true).T
    needed = np.sort(index.nearest_lists(q).argsort(axis=1)[place, own])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def search_block(index: Index, own_list: int, ids: np.ndarray, v: np.ndarray, codes: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int):
    """(query place, candidate place, distance) of each query's k nearest of a block."""
    found, origin = [], index.centre + index.coarse[own_list]
    own = v - origin
    coded = index.words[np.arange(codes.shape[1]), codes].reshape(len(own), -1)
    error = np.sqrt(((index.parts(own).reshape(len(own), -1) - coded) ** 2).sum(axis=1))
    size = (own**2).sum(axis=1).max(initial=0.0)
    reach = np.sqrt(size) + error.max(initial=0.0)
    for i in range(0, len(q), 64):
        some = q[i : i + 64] - origin
        tables = index.tables(some)
        rough = np.zeros((len(tables), len(ids)))
        for s in range(codes.shape[1]):
            rough += tables[:, s, :][:, codes[:, s]]
        rough = np.sqrt(rough)
        same = query_ids[i : i + 64, None] == ids[None, :]
        rough[same] = np.inf
        far = np.sqrt((some**2).sum(axis=1))
        most = np.partition(rough + error, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(some), np.inf)
        keep = (rough - error <= (most + 1e-7 * (far + reach))[:, None]) & ~same  # sums of squares are rounded
        left = np.flatnonzero(keep.any(axis=0))
        plain = squared(some, own[left])
        plain[~keep[:, left]] = np.inf
        cutoff = np.partition(plain, k - 1, axis=1)[:, k - 1] if len(left) > k else np.full(len(some), np.inf)
        rounded = 1e-12 * (far**2 + size) + 1e-14 * np.abs(q[i : i + 64]).max(axis=1) * (far + reach)
        n, near = np.nonzero((plain <= (cutoff + rounded)[:, None]) & keep[:, left])
        near = left[near]
        exact = np.sqrt(((v[near] - q[i + n]) ** 2).sum(axis=1))
        order = np.lexsort((ids[near], exact, n))
        n, near, exact = n[order], near[order], exact[order]
        best = np.arange(len(n)) - np.searchsorted(n, n) < k
        found.append((i + n[best], near[best], exact[best]))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _matrix(column, n: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(lists.flatten(), float).reshape(n, -1)


def _codes(column, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, -1)


def nearest(vectors: DataFrame, is_query: Column, k: int = K, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score (the distance) of each query's k nearest others."""
    spark = vectors.sparkSession
    good = usable(vectors)
    lengths = {r["dim"]: r["n"] for r in good.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()}
    if not lengths:
        return good.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    (dim, n), = lengths.items()
    good = good.where(F.col("dim") == dim)
    sample = good.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id").limit(FIT_ROWS).select("v").toPandas()
    sample = np.stack(sample["v"].to_numpy())
    index = spark.sparkContext.broadcast(fit(sample, n))

    def encode(batches):
        model = index.value
        for batch in batches:
            near, code = model.assign(_matrix(batch.column(1), batch.num_rows)) if batch.num_rows else (np.zeros(0, np.int64), np.zeros((0, 1), np.uint8))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array([c.tobytes() for c in code], pa.binary())], names=[*batch.schema.names, "list", "code"])

    kind = dict(good.dtypes)["vec_id"]
    encoded = good.select("vec_id", "v").mapInArrow(encode, f"vec_id {kind}, v array<double>, list bigint, code binary")
    indexed = materialise(encoded.withColumn("row", F.monotonically_increasing_id()))  # numbers are fixed by writing them
    sizes = np.zeros(len(index.value.coarse), np.int64)
    for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect():  # at most MAX_LISTS rows
        sizes[r["list"]] = r["n"]
    shared_sizes = spark.sparkContext.broadcast(sizes)
    if not probes:
        some = indexed.where(is_query).orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id", "row").limit(TUNING_QUERIES).select("vec_id", "v").toArrow()
        some_ids, some_q = np.asarray(some.column("vec_id").combine_chunks()), _matrix(some.column("v"), some.num_rows) if some.num_rows else np.zeros((0, dim))
        probes = probes_needed(index.value, some_q, true_lists(index.value, indexed, some_ids, some_q, k) if some.num_rows else [])

    def probe(batches):
        model, own_sizes = index.value, shared_sizes.value
        for batch in batches:
            q = _matrix(batch.column(1), batch.num_rows) if batch.num_rows else np.zeros((0, dim))
            order = model.nearest_lists(q)
            enough = np.maximum(probes, (np.cumsum(own_sizes[order], axis=1) < 2 * k + 2).sum(axis=1) + 1)
            lists = [row[:m] for row, m in zip(order, enough, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int64()))], names=["query_id", "q", "lists"])

    queries = indexed.where(is_query).select("vec_id", "v").distinct().mapInArrow(probe, f"query_id {kind}, q array<double>, lists array<bigint>")
    probed = materialise(queries.select("query_id", "q", F.explode("lists").alias("list")))
    # blocks of a list's vectors meet chunks of its queries; both counts are per list, so they can be broadcast
    per_list = spark.createDataFrame([(i, int(-(-s // BLOCK)), int(s)) for i, s in enumerate(sizes) if s], "list bigint, blocks int, n bigint")
    asked = probed.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    plan = F.broadcast(per_list.join(asked, "list").select("list", "blocks", "chunks"))
    dealt = indexed.join(plan, "list").withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "row"), F.col("blocks")).cast("int"))
    dealt = dealt.select("list", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "row", "vec_id", "v", "code")
    asking = probed.join(plan, "list").withColumn("chunk", F.pmod(F.xxhash64(F.lit(SEED), "query_id", "q"), F.col("chunks")).cast("int"))
    asking = asking.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "chunk", "query_id", "q")

    def search(block: pa.Table, asked: pa.Table) -> pa.Table:
        if not block.num_rows or not asked.num_rows:
            empty = pa.array([], asked.schema.field("query_id").type)
            return pa.table({"query_id": empty, "row": pa.array([], pa.int64()), "vec_id": empty, "score": pa.array([], pa.float64())})
        ids, v = np.asarray(block.column("vec_id")), _matrix(block.column("v"), block.num_rows)
        q_ids, q = np.asarray(asked.column("query_id")), _matrix(asked.column("q"), asked.num_rows)
        place, near, exact = search_block(index.value, block.column("list")[0].as_py(), ids, v, _codes(block.column("code"), len(ids)), q_ids, q, k)
        return pa.table({"query_id": q_ids[place], "row": np.asarray(block.column("row"))[near], "vec_id": ids[near], "score": exact})

    keys = ("list", "block", "chunk")
    found = dealt.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(search, f"query_id {kind}, row bigint, vec_id {kind}, score double")
    # a candidate row counts once, however many rows share the query's id
    once = found.groupBy("query_id", "row", "vec_id").agg(F.min("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id", "row")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score of the 10 nearest of each vector whose id is divisible by 100."""
    return nearest(read(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)
