"""Near-duplicate documents by BagMinHash.

A document is a bag of five-word shingles (words as runs of anything but white space, A-Z lower-cased; a document of
fewer words is one shingle). Two are linked if the weighted Jaccard similarity of their bags is 0.8 or more; classes
are connected by links.

Signatures. Shingle weights are whole numbers. Each shingle owns Poisson processes over time, signature component and
weight level: one for level 0 and one for each doubling of the level range. A document meets the points below its
weight, and a component is the time of its first point, so two components agree with probability equal to the weighted
Jaccard similarity. Points come in order of time and a process stops beyond the latest component, which leaves a few
points for each component however long the text; levels inside a range are halved bit by bit.

Joins. Documents with equal word sequences (two 64-bit hashes and the length agree) are one text, which has a number of
its own; ids are only looked at in the end, so rows that share an id are never mixed up. Texts that share a band (ROWS
components, of BANDS; a pair at 0.8 shares none with probability 5e-5) are compared in two steps. First each text of a
bucket with the first text of it, by exact multiset overlap. Then, where a bucket still holds several classes, texts of
different classes: those of one class need no further link. Lengths that rule 0.8 out are not compared. Of such a
bucket, up to PAIRED texts are paired; a larger one is dealt to blocks of about BLOCK_ITEMS shingles, so that texts
travel as rarely as memory allows, and each two blocks meet in a task of their own, which adds up overlaps in slices of
the shingles and returns at most one link a text. So no bucket is capped, none is held by one task, and no row is made
for each pair of a group.

Results: documents without words (null, empty or white space) are classes of their own, as are rows without an id, whose
class_id is null. Rows of equal words are one class, whatever their ids; rows with one id and different texts are
compared like any others. A class is named by its least doc_id, and the row of that id (of several, that of the least text
hash) is kept; ties between equal rows are of no account, as rows that repeat both id and text are one document. Texts of
any length are compared whole. An empty table gives an empty result; other columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import materialise, mix, read, slices_of, word_hashes, word_spans
from wattloom.llm.components import connected_components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
PAIRED = 16
#: Shingles and texts of a block; a tile has two. Shingles of more than RARE of its texts are added up WIDTH at once.
BLOCK_ITEMS, BLOCK, RARE, WIDTH = 1 << 19, 1024, 24, 2048

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def shingle_bags(raw: np.ndarray, bounds: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash) of every shingle occurrence of a slice of texts, and two hashes (2, rows) of the whole texts."""
    starts, stops, first = word_spans(raw, bounds)
    words = word_hashes(raw, starts, stops)
    n = np.diff(first)
    row_of_word = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(words)) - first[row_of_word]
    # hashes of each whole word sequence: sums of words mixed with their places
    whole, sums = np.zeros((2, len(n)), _U), np.zeros(len(words) + 1, _U)
    placed = mix(words + _STEP * (place.astype(_U) + _U(1)))
    for k in range(2):
        np.cumsum(placed, out=sums[1:])
        whole[k] = mix((sums[first[1:]] - sums[first[:-1]]) ^ mix(n.astype(_U)))
        placed = mix(placed ^ _STEP)
    shingle = np.zeros(len(words), _U)
    left = n[row_of_word] - place  # words from here to the end of the row
    for k in range(width):
        use = np.flatnonzero(left > k)
        shingle[use] = mix(shingle[use] * _STEP + words[use + k])
    keep = (left >= width) | (place == 0)
    return row_of_word[keep], shingle[keep], whole


def weighted(row: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) and their counts."""
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(new)
    return row[at], shingle[at], np.diff(np.append(at, len(row)))


def _unit(x: np.ndarray) -> np.ndarray:
    """(0, 1] from 64 bits."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


def bag_minhash(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """Signatures (n_rows, m) of weighted sets: times of first points; infinite for rows without shingles."""
    parts = [(row, shingle, np.ones(len(row)), np.zeros(len(row), np.int64), count)]
    low = 1
    while len(more := np.flatnonzero(count > low)):  # levels low .. 2 low - 1
        seed = mix(shingle[more] ^ mix(np.full(len(more), low, _U)))
        parts.append((row[more], seed, np.full(len(more), float(low)), np.full(len(more), low), count[more]))
        low *= 2
    row, seed, width, low_level, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    partial = low_level + width > weight
    sig = np.full(n_rows * m, np.inf)
    time, point, block = np.zeros(len(row)), 0, 1
    scale = 1.0 / (m * width)
    while len(row):
        steps = point + 1 + np.arange(block, dtype=_U)[:, None]
        draw = mix(seed[None, :] + _STEP * steps.astype(_U))
        gaps = -np.log(_unit(draw)) * scale
        gaps[0] += time
        times = np.cumsum(gaps, axis=0) if block > 1 else gaps
        other = mix(draw ^ _STEP)
        component = ((other >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
        level = low_level + (other & (width.astype(_U) - _U(1))).astype(np.int64)
        taken = ~partial | (level < weight)
        np.minimum.at(sig, (row * m + component)[taken], times[taken])
        latest = sig.reshape(n_rows, m).max(axis=1)
        live = np.flatnonzero(times[-1] <= latest[row])
        row, seed, width, low_level, weight, partial, scale = (x[live] for x in (row, seed, width, low_level, weight, partial, scale))
        time, point = times[-1][live], point + block
        block = int(min(64, 2 * block, max(1, (1 << 20) // max(1, len(row)))))
    return sig.reshape(n_rows, m)


def bands_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash per band, (n, bands), of the components' exact times."""
    bits = sig.view(_U).reshape(len(sig), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=_U), (len(sig), bands)).copy()
    for k in range(rows):
        out = mix(out * _STEP + bits[:, :, k])
    return out


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE) -> DataFrame:
    """doc_id, h, hashes of the words, number of shingles and band hashes of each row with an id; no bands without words.

    ``h`` tells texts of one id apart.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, bounds in slices_of(batch.column(2)):
                row, shingle, whole = shingle_bags(raw, bounds, width)
                total = np.bincount(row, minlength=j - i)
                sig = bag_minhash(*weighted(row, shingle), j - i, bands * rows)
                hashes = bands_of(sig, bands, rows).view(np.int64)
                filled = total > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(filled, bands, 0))])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes[filled].ravel()))
                own = [x.slice(i, j - i) for x in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(w.view(np.int64)) for w in whole], pa.array(total, pa.int32()), lists], names=["doc_id", "h", "w1", "w2", "n", "bands"])

    narrow = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("h"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(sign, f"doc_id {kind}, h bigint, w1 bigint, w2 bigint, n int, bands array<bigint>")


def shingle_sets(texts: DataFrame, width: int = SHINGLE) -> DataFrame:
    """t and ``items``: the bag as a set, the k-th occurrence of a shingle being an element of its own; texts: t, text."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, bounds in slices_of(batch.column(1)):
                row, shingle, _ = shingle_bags(raw, bounds, width)
                row, shingle, count = weighted(row, shingle)
                again = np.repeat(np.arange(len(row)), count)
                nth = np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)
                items = mix(shingle[again] + _STEP * nth.astype(_U)).view(np.int64)
                offsets = np.searchsorted(row[again], np.arange(j - i + 1))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(items))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], names=["t", "items"])

    return texts.select("t", "text").mapInArrow(collect, "t bigint, items array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the distinct pairs (a, b) whose bags reach ``similarity``."""
    left = pairs.join(sets.select(F.col("t").alias("a"), F.col("items").alias("x")), "a")
    both = left.join(sets.select(F.col("t").alias("b"), F.col("items").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared)).select("a", "b")


def linked_in_tile(ids: np.ndarray, classes: np.ndarray, sizes: np.ndarray, items: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what similar texts of different classes join: each text and the least one it gets to."""
    owner = np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(items, kind="stable")
    new = np.diff(items[order], prepend=items[order[:1]] - 1 if len(items) else 0) != 0
    code = np.cumsum(new) - 1
    owner = owner[order]
    first, texts = np.flatnonzero(new), np.bincount(code)  # an item of one text overlaps with nothing
    shared = np.zeros((len(ids), len(ids)), np.float32)
    for n in range(2, min(RARE, len(ids)) + 1):
        own = owner[first[texts == n][:, None] + np.arange(n)]
        for x in range(n):
            for y in range(n):
                np.add.at(shared, (own[:, x], own[:, y]), 1)
    place = np.where(texts > RARE, np.cumsum(texts > RARE) - 1, -1)[code]
    use = place >= 0
    owner, place = owner[use], place[use]
    for low in range(0, int(place.max(initial=-1)) + 1, WIDTH):
        span = slice(*np.searchsorted(place, [low, low + WIDTH]))
        has = np.zeros((len(ids), WIDTH), np.float32)
        has[owner[span], place[span] - low] = 1
        shared += has @ has.T
    linked = shared >= similarity * (sizes[:, None] + sizes[None, :] - shared)
    linked &= classes[:, None] != classes[None, :]
    label = np.arange(len(ids), dtype=np.int32)
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], np.int32(len(ids))).min(axis=1))
        least = least[least]
        if (least == label).all():
            break
        label = least
    at = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[at]], ids[at]


def linked_in_large(rest: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the classes of each band of ``rest``: band, t, class and ``items``, the band's shingles."""
    blocks = F.greatest(F.ceil(F.col("items") / BLOCK_ITEMS), F.ceil(F.col("k") / BLOCK)).cast("int")
    dealt = rest.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("t", "band"), F.col("blocks")).cast("int"))
    tiles = dealt.select("band", "t", "class", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "t", "class")

    def link(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks()
        lists = tile.column("items").combine_chunks()
        offsets = np.asarray(lists.offsets)
        items = np.asarray(lists.values)[offsets[0] : offsets[-1]]
        classes = np.unique(np.asarray(tile.column("class")), return_inverse=True)[1]
        a, b = linked_in_tile(np.asarray(tile.column("t")), classes, np.diff(offsets), items, similarity)
        return pa.table({"a": a, "b": b})

    return tiles.join(sets, "t").groupBy("band", "i", "j").applyInArrow(link, "a bigint, b bigint")


def classes_of(docs: DataFrame, similarity: float, bands: int, rows: int, width: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows (doc_id, h, w1, w2, n), and for each text (w1, w2, n) ``keeper``, the doc_id and h of its class."""
    signed = materialise(signatures(docs, bands, rows, width))
    # numbers of texts are fixed by writing them
    texts = signed.where("n > 0").groupBy("w1", "w2", "n").agg(F.min(F.struct("doc_id", "h")).alias("own"), F.first("bands").alias("bands"))
    texts = materialise(texts.withColumn("t", F.monotonically_increasing_id()))
    kept = texts.select("t", "n", F.explode("bands").alias("band"))

    # buckets of two texts or more, with their first text
    heads = kept.groupBy("band").agg(F.min("t").alias("head"), F.max("t").alias("last")).where("last > head").drop("last")
    bucket = materialise(kept.join(heads, "band"))
    pairs = bucket.where("t > head").select(F.col("head").alias("a"), F.col("t").alias("b")).distinct()
    members = texts.join(bucket.select("t").distinct(), "t", "left_semi").select("t", "own.doc_id", "own.h")
    wanted = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").join(members, ["doc_id", "h"])
    sets = materialise(shingle_sets(wanted, width).dropDuplicates(["t"]))
    links = materialise(verified(pairs, sets, similarity))

    # buckets that hold more than one class yet
    linked = connected_components(links).select(F.col("node").alias("t"), F.col("component").alias("class"))
    classed = bucket.join(linked, "t", "left").withColumn("class", F.coalesce("class", "t"))
    open_bands = classed.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("k"), F.sum("n").alias("items")).where("hi > lo").select("band", "k", "items")
    rest = materialise(classed.join(open_bands, "band").select("band", "t", "n", "class", "head", "k", "items"))
    x, y = rest.where(F.col("k") <= PAIRED).alias("x"), rest.where(F.col("k") <= PAIRED).alias("y")
    near = (F.col("x.n") >= similarity * F.col("y.n")) & (F.col("y.n") >= similarity * F.col("x.n"))
    new = (F.col("x.t") != F.col("x.head")) & (F.col("y.t") != F.col("y.head"))  # compared before
    cross = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.class") < F.col("y.class")) & near & new)
    more = verified(cross.select(F.col("x.t").alias("a"), F.col("y.t").alias("b")).distinct(), sets, similarity)
    large = linked_in_large(rest.where(F.col("k") > PAIRED), sets, similarity)

    found = materialise(connected_components(links.unionByName(more).unionByName(large)).select(F.col("node").alias("t"), "component"))
    named = texts.select("t", "own").join(found, "t").groupBy("component").agg(F.min("own").alias("keeper"))
    by_text = texts.select("t", "w1", "w2", "n", "own").join(found.join(named, "component").select("t", "keeper"), "t", "left")
    return signed.drop("bands"), by_text.select("w1", "w2", "n", F.coalesce("keeper", "own").alias("keeper"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE) -> DataFrame:
    """doc_id, class_id and kept of each row; class_id is the least doc_id of the class."""
    signed, by_text = classes_of(docs, similarity, bands, rows, width)
    out = signed.join(by_text, ["w1", "w2", "n"], "left")
    own = F.struct("doc_id", "h") == F.col("keeper")
    out = out.select("doc_id", F.coalesce("keeper.doc_id", "doc_id").alias("class_id"), F.coalesce(own, F.lit(True)).alias("kept"))
    nameless = docs.where(F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return out.unionByName(nameless)


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE) -> DataFrame:
    """One row of each class. Rows without words or an id stay; of rows that repeat id and text, one of least hash stays."""
    _, by_text = classes_of(docs, similarity, bands, rows, width)
    keepers = by_text.select(F.col("keeper.doc_id").alias("doc_id"), F.col("keeper.h").alias("h")).distinct()
    alone = F.col("doc_id").isNull() | ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.where(~alone).select("doc_id", F.xxhash64("text").alias("h"), whole.alias("row"))
    one = packed.join(keepers, ["doc_id", "h"], "left_semi").groupBy("doc_id", "h").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return one.select("row.*").unionByName(docs.where(alone))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id and kept of every document."""
    return near_duplicates(read(spark, sf_dir, "documents"))
