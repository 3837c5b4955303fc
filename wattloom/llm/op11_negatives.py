"""Hard negatives of anchor vectors by blocked dense products: exact integer scores, mergeable tops, score windows.

Components become integers, floor(256 * x); a score is the inner product of two such vectors. Products are taken in
float64, which is exact while every partial sum stays below 2^53; a bound on the largest component of either block
says so, and blocks beyond it are multiplied as Python integers. A score that is returned must fit a long, or the task
ends with an error, for there is no right number to return.

Anchors go round by round: at most ROUND_BYTES of them are broadcast, and tasks multiply each batch of candidates,
where they lie, with all anchors of the round. Candidates are never shuffled. In a first pass a task keeps the best
positives of each anchor (same label), tops of tasks are merged by rank, and the merged ones, ``positives`` an anchor,
fix the windows of the second pass, which keeps the best negatives of each window in the same way. A pass returns at
most a few rows an anchor and task, however many candidates tie or repeat. Rows grow with anchors times positives.

Rows with a null id, a null label, a null vector, or a null or non-finite component take no part, and vectors of other
lengths than the anchor's are none of its candidates (empty vectors meet empty ones, with score 0). Ties go to the
smaller id. Rows that repeat an id count as rows of their own but never meet rows of that id; anchor rows that are equal
in id, label and vector count once. An empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.llm.common import materialise, read

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A window is ``LOW * positive <= 100 * negative <= HIGH * positive``.
LOW, HIGH = 50, 95
#: Bytes of anchor vectors that are broadcast in a round.
ROUND_BYTES = 16 << 20
#: Rows of anchors and of candidates that are multiplied at once.
ANCHOR_BLOCK, CANDIDATE_BLOCK = 256, 4096

POSITIVE = "anchor int, cand_id long, score long"
NEGATIVE = "anchor int, slot int, cand_id long, score long"


def usable(vectors: DataFrame, label: Column) -> DataFrame:
    """vec_id, label and x (doubles) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    use = F.coalesce(F.col("vec_id").isNotNull() & label.isNotNull() & finite, F.lit(False))
    return vectors.where(use).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): in float64 where all of it is finite, as Python integers otherwise."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * SCALE)
    if np.isfinite(scaled).all():
        return scaled
    return np.array([[int(v) * SCALE if abs(v) > 2.0**60 else int(np.floor(v * SCALE)) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: int64 where float64 is exact, else Python integers."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    if a.dtype != object and b.dtype != object and float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = [np.array([[int(v) for v in row] for row in m.tolist()], dtype=object).reshape(m.shape) for m in (a, b)]
    return exact[0] @ exact[1].T


def best(score: np.ndarray, may: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each row's k best allowed places; of equal scores the first places, so columns go by id.

    What exceeds the k-th score is in, and of what equals it the first places, as many as are left.
    """
    rows = np.flatnonzero(may.any(axis=1))
    if not len(rows):
        return rows, rows
    may, score = may[rows], score[rows]
    if score.dtype == object:
        score = np.searchsorted(np.unique(score[may]), score)  # ranks stand for scores
    low = np.iinfo(np.int64).min
    held = np.where(may, score, low)
    kth = held.max(axis=1) if k == 1 else np.partition(held, max(held.shape[1] - k, 0), axis=1)[:, max(held.shape[1] - k, 0)]
    above, equal = may & (held > kth[:, None]), may & (held == kth[:, None])
    left = k - above.sum(axis=1)
    n, place = np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= left[:, None])))
    return rows[n], place


class Tops:
    """The k best (score, id) of each of many keys; adding more of them keeps the k best."""

    def __init__(self, k: int) -> None:
        self.k, self.parts, self.size = k, [], 0

    def add(self, key: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if len(key):
            self.parts.append((key, ids, score))
            self.size += len(key)
            if self.size > 1_000_000:
                self.parts = [self.merged()]
                self.size = len(self.parts[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, ids, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        falling = -score if score.dtype != object else -np.searchsorted(np.unique(score), score)
        order = np.lexsort((ids, falling, key))
        key, ids, score = key[order], ids[order], score[order]
        top = np.arange(len(key)) - np.searchsorted(key, key) < self.k
        return key[top], ids[top], score[top]


def longs(score: np.ndarray) -> np.ndarray:
    if score.dtype == object and len(score) and (max(score) >= 1 << 63 or min(score) < -(1 << 63)):
        raise OverflowError("a score does not fit a long")
    return score.astype(np.int64)


def blocks(batches: Iterator[pa.RecordBatch], dims: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, ids, labels, whole components) of candidates of one length, by id within a block."""
    for batch in batches:
        ids, label = (np.asarray(batch.column(c)) for c in (0, 1))
        lists = batch.column(2)
        sizes = np.asarray(lists.value_lengths())
        flat, starts = np.asarray(lists.flatten(), float), np.concatenate([[0], np.cumsum(sizes)])
        for dim in dims & set(sizes.tolist()):
            at = np.flatnonzero(sizes == dim)
            at = at[np.argsort(ids[at], kind="stable")]
            for k in range(0, len(at), CANDIDATE_BLOCK):
                own = at[k : k + CANDIDATE_BLOCK]
                yield dim, ids[own], label[own], whole(flat[starts[own][:, None] + np.arange(dim)])


def anchors_by_dim(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Length: (number in the round, id, label, whole components) of its anchors."""
    out = {}
    for dim in sorted({len(r["x"]) for r in rows}):
        own = [(n, r) for n, r in enumerate(rows) if len(r["x"]) == dim]
        out[dim] = (np.array([n for n, _ in own]), np.array([r["vec_id"] for _, r in own]), np.array([r["label"] for _, r in own]), whole(np.array([r["x"] for _, r in own], float).reshape(len(own), dim)))
    return out


def _with_blocks(batches, anchors) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Tiles: anchors' numbers, candidates' ids, scores, whether they may meet, and whether labels are equal."""
    for dim, ids, label, v in blocks(batches, set(anchors)):
        number, own, own_label, a = anchors[dim]
        for k in range(0, len(number), ANCHOR_BLOCK):
            s = slice(k, k + ANCHOR_BLOCK)
            yield number[s], ids, scores(a[s], v), own[s][:, None] != ids[None, :], own_label[s][:, None] == label[None, :]


def positives_of(anchors, batches: Iterator[pa.RecordBatch], k: int) -> pa.RecordBatch:
    tops = Tops(k)
    for number, ids, score, other, same in _with_blocks(batches, anchors):
        row, place = best(score, other & same, k)
        tops.add(number[row], ids[place], score[row, place])
    key, ids, score = tops.merged()
    return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(ids), pa.array(longs(score))], names=["anchor", "cand_id", "score"])


def negatives_of(anchors, windows: tuple[np.ndarray, np.ndarray], batches: Iterator[pa.RecordBatch], k: int) -> pa.RecordBatch:
    """windows: the least and greatest negative score for each anchor's number and slot."""
    tops, (low, high) = Tops(k), windows
    slots = low.shape[1]
    for number, ids, score, other, same in _with_blocks(batches, anchors):
        for slot in range(slots):
            lo, hi = low[number, slot][:, None], high[number, slot][:, None]
            row, place = best(score, other & ~same & (score >= lo) & (score <= hi), k)
            tops.add(number[row] * slots + slot, ids[place], score[row, place])
    key, ids, score = tops.merged()
    return pa.RecordBatch.from_arrays([pa.array((key // slots).astype(np.int32)), pa.array((key % slots).astype(np.int32)), pa.array(ids), pa.array(longs(score))], names=["anchor", "slot", "cand_id", "score"])


def window_bounds(score: np.ndarray, low: int = LOW, high: int = HIGH) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest whole n with low * score <= 100 * n <= high * score; exact for every long."""
    exact = [int(s) for s in score.ravel()]
    lo = np.array([-((-low * s) // 100) for s in exact], np.int64).reshape(score.shape)
    return lo, np.array([high * s // 100 for s in exact], np.int64).reshape(score.shape)


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "cand_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of all anchors' hard negatives."""
    spark = vectors.sparkSession
    rows = usable(vectors, label)
    anchors = materialise(rows.where(is_anchor).distinct())
    out = None
    for own in rounds(anchors.toLocalIterator(), round_bytes):
        found = _round(rows, own, positives, negatives)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def rounds(rows: Iterator, most: int) -> Iterator[list]:
    """Rows in lists of at most ``most`` bytes of vectors; a longer one is a list of its own."""
    own, size = [], 0
    for r in rows:
        more = 8 * len(r["x"]) + 64
        if own and size + more > most:
            yield own
            own, size = [], 0
        own.append(r)
        size += more
    if own:
        yield own


def _round(rows: DataFrame, own: list, positives: int, negatives: int) -> DataFrame:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(anchors_by_dim(own))  # ROUND_BYTES bound it

    def first(batches):
        yield positives_of(shared.value, batches, positives)

    tops = _ranked(rows.mapInArrow(first, POSITIVE), ["anchor"], positives).toArrow()  # ``positives`` rows an anchor of the round
    anchor, slot, ids, score = (np.asarray(tops.column(c)) for c in ("anchor", "rank", "cand_id", "score"))
    slots = max(1, positives)
    low, high = np.ones((len(own), slots), np.int64), np.zeros((len(own), slots), np.int64)  # an empty window where there is no positive
    low[anchor, slot - 1], high[anchor, slot - 1] = window_bounds(score)
    windows = spark.sparkContext.broadcast((low, high))

    def second(batches):
        yield negatives_of(shared.value, windows.value, batches, negatives)

    names = spark.createDataFrame(pa.table({"anchor": pa.array(anchor, pa.int32()), "slot": pa.array(slot - 1, pa.int32()), "anchor_id": pa.array([own[n]["vec_id"] for n in anchor], pa.int64()), "positive_id": pa.array(ids, pa.int64()), "positive_score": pa.array(score, pa.int64())}))
    found = _ranked(rows.mapInArrow(second, NEGATIVE), ["anchor", "slot"], negatives)
    named = found.join(F.broadcast(names), ["anchor", "slot"])  # as many rows as the anchors of a round times ``positives``
    out = named.select("anchor_id", "positive_id", "rank", F.col("cand_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    return materialise(out)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of each vector whose id is divisible by 50; labels of ids divisible by 7 are moved up by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)
