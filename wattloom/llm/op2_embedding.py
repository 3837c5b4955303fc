"""Near-duplicate embeddings: binary codes with error bounds choose the pairs that are compared exactly.

Vectors are compared within a label only, by cosine in double precision. Equal vectors are one point with its number of
rows. Points of a large label are dealt to cells around pivots; two cells are compared only if their distance, less
both radii, leaves room for a pair (on the unit sphere a cosine of 0.98 is a distance of 0.2), which is exact. Cells are
cut in blocks of about BLOCK points, and each two blocks meet in a task of their own.

Each unit vector o is turned by a random rotation once and stored as the signs of its coordinates, one bit each (a unit
vector c once scaled), with the correction factor f = <c, o>. In a tile, codes meet by popcounts first: the bits of two
vectors at cosine s differ with chance arccos(s) / pi each, so pairs with more differing bits than a pair at 0.98 has with
probability above CHANCE are dropped. For the others <c, q> / f estimates <o, q> without bias; at cosine s it is off by
sqrt(1 - s^2) sqrt(1 - f^2) / f times a coordinate of a random unit vector, which DEVIATIONS standard deviations bound
(with up to DEVIATIONS^2 dimensions the bound is certain). Pairs whose estimate, from either side, is below what 0.98
allows are dropped, and the remaining ones are computed exactly. A task returns a count for each point and edges that join
what is linked, not pairs.

Null, zero, not finite or unlabelled vectors link with nothing: n_links 0, component_id their own id. Vectors of
different lengths do not link. Rows without an id take no part either. Repeated rows are vectors of their own; rows of one id
with different vectors each have a row in the result. An empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import materialise, read
from wattloom.llm.components import connected_components

SIMILARITY = 0.98
CHANCE, DEVIATIONS = 1e-10, 6.5
BLOCK, CELL, MAX_PIVOTS = 512, 4096, 1024
SEED = 11


def split_usable(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that may link, as vec_id, label, dim and v (array<double>), and the ids of the others."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    use = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & nonzero, F.lit(False))
    good = vectors.where(use).select("vec_id", "label", F.size("embedding").alias("dim"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return good, vectors.where(~use).select("vec_id")


@cache
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit_rows(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def encode(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the turned unit vectors, and the correction factors."""
    turned = unit_rows(v) @ rotation(v.shape[1]).T
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(v.shape[1])


def differing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows of a, rows of b): how many bits of two codes differ."""
    a, b = (np.pad(x, ((0, 0), (0, -x.shape[1] % 8))).view(np.uint64) for x in (np.ascontiguousarray(a), np.ascontiguousarray(b)))
    out = np.bitwise_count(a[:, :1] ^ b[:, 0])
    for k in range(1, a.shape[1]):
        out = out.astype(np.uint16) + np.bitwise_count(a[:, k, None] ^ b[:, k])
    return out


@cache
def most_differing(dim: int, similarity: float, chance: float = CHANCE) -> int:
    """The least number of bits that codes of a pair at ``similarity`` differ in more of with no more than ``chance``."""
    p, tail = math.acos(similarity) / math.pi, 0.0
    for h in range(dim, -1, -1):
        log_pmf = math.lgamma(dim + 1) - math.lgamma(h + 1) - math.lgamma(dim - h + 1) + h * math.log(p) + (dim - h) * math.log1p(-p)
        tail += math.exp(log_pmf)
        if tail > chance:
            return h
    return dim


def signs_of(code: np.ndarray, dim: int) -> np.ndarray:
    return np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1


def estimates(signs: np.ndarray, factor: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Unbiased estimates of <o, q> for pairs: each o's signs and factor, and the turned unit q."""
    return np.einsum("ij,ij->i", signs, other) / (math.sqrt(other.shape[1]) * factor)


def least_estimate(factor: np.ndarray, dim: int, similarity: float) -> np.ndarray:
    """What the estimate of a pair at ``similarity`` or above does not fall below, with confidence DEVIATIONS."""
    off = np.sqrt(np.maximum(1 - factor**2, 0)) / factor * math.sqrt(1 - similarity**2)
    return similarity - off * min(1.0, DEVIATIONS / math.sqrt(max(dim - 1, 1))) - 1e-5  # estimates are in single precision


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows, each scaled by a power of two first: squares neither overflow nor vanish, and other results stay as they are."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def links_between(left: tuple, right: tuple, same: bool, similarity: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Places (i, j) of linked points of two blocks, and how many pairs were computed exactly. same: i < j only.

    A block is its vectors, codes and factors.
    """
    dim = left[0].shape[1]
    maybe = differing_bits(left[1], right[1]) <= most_differing(dim, similarity)
    if same:
        maybe = np.triu(maybe, 1)
    i, j = np.divmod(np.flatnonzero(maybe), maybe.shape[1])
    turn = rotation(dim)
    a, b = ((unit_rows(x[0]) @ turn.T).astype(np.float32) for x in (left, right))
    signs = [signs_of(x[1], dim) for x in (left, right)]
    least_a, least_b = (least_estimate(x[2], dim, similarity) for x in (left, right))
    kept = []
    for k in range(0, len(i), 50_000):
        x, y = i[k : k + 50_000], j[k : k + 50_000]
        near = estimates(signs[0][x], left[2][x], b[y]) >= least_a[x]
        x, y = x[near], y[near]
        near = estimates(signs[1][y], right[2][y], a[x]) >= least_b[y]
        kept.append((x[near], y[near]))
    i, j = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (i, j)
    linked = np.concatenate([cosine(left[0][i[k : k + 100_000]], right[0][j[k : k + 100_000]]) >= similarity for k in range(0, len(i), 100_000)] or [np.zeros(0, bool)])
    return i[linked], j[linked], len(i)


def _spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n points the least one that it reaches by the links (i, j)."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(lists.flatten(), float).reshape(n, -1)


def link_tile(tile: pa.Table, similarity: float) -> pa.Table:
    """point, n (links by rows) and root (a point that it is joined to) of the points of one or two blocks."""
    ids, block, rows = (np.asarray(tile.column(c)) for c in ("point", "block", "rows"))
    v = _matrix(tile.column("v"), len(ids))
    code = np.frombuffer(b"".join(tile.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
    factor = np.asarray(tile.column("factor"))
    first = np.flatnonzero(block == block.min())
    second = np.flatnonzero(block != block.min())
    own = bool(tile.column("own")[0].as_py())
    i, j, _ = links_between(*((v[x], code[x], factor[x]) for x in (first, first if own else second)), own, similarity)
    i, j = first[i], (first if own else second)[j]
    n = np.bincount(i, rows[j], len(ids)) + np.bincount(j, rows[i], len(ids))
    order = np.argsort(ids, kind="stable")
    back = np.empty(len(ids), np.int64)
    back[order] = np.arange(len(ids))
    root = ids[order[_spanning(back[i], back[j], len(ids))[back]]]
    at = np.flatnonzero(n)
    return pa.table({"point": ids[at], "n": n[at].astype(np.int64), "root": root[at]})


def to_cells(points: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``points`` with cell and block, and the pairs of cells that may hold links (each with itself, too).

    Pivots are points of least hash, one for CELL points of a label and MAX_PIVOTS in all, so they fit the driver.
    """
    sizes = [(r["label"], r["dim"], r["n"]) for r in points.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > CELL).collect()]
    cell_of_label = F.xxhash64(F.lit(SEED), "label", "dim")
    if not sizes:
        return points.withColumn("cell", cell_of_label).withColumn("block", _block()), []
    # one pass for the pivots of all labels: points whose hash is in the label's share, which add up to MAX_PIVOTS about;
    # labels that are too many for a pivot each stay in blocks
    scale = min(1.0, MAX_PIVOTS / sum(-(-n // CELL) for *_, n in sizes))
    shares = [(label, dim, scale * -(-n // CELL) / n) for label, dim, n in sizes]
    table = points.sparkSession.createDataFrame(shares, ", ".join(f"{c} {t}" for c, t in points.dtypes if c in ("label", "dim")) + ", share double")
    place = F.pmod(F.xxhash64(F.lit(SEED), "point"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    near = points.join(table, ["label", "dim"]).where(place < F.col("share")).select("label", "dim", "v", place.alias("at"))
    parts = near.orderBy("at").limit(2 * MAX_PIVOTS).collect()
    by_group: dict[tuple, list] = {}
    for r in parts:
        by_group.setdefault((r["label"], r["dim"]), []).append(r["v"])
    pivots, names = {}, {}
    for (label, dim), v in by_group.items():
        pivots[label, dim] = unit_rows(np.array(v))
        names[label, dim] = len(names) << 20
    shared = points.sparkSession.sparkContext.broadcast((pivots, names))

    def assign(batches):
        pivots, names = shared.value
        for frame in batches:
            cell, far = np.zeros(len(frame), np.int64), np.zeros(len(frame))
            for key, rows in frame.groupby(["label", "dim"]).indices.items():
                if key in pivots:
                    near = unit_rows(np.stack(frame["v"].to_numpy()[rows])) @ pivots[key].T
                    cell[rows] = names[key] + near.argmax(axis=1)
                    far[rows] = np.arccos(np.clip(near.max(axis=1), -1, 1))
                else:
                    cell[rows] = -1
            yield frame.assign(cell=cell, far=far)

    schema = ", ".join(f"{c} {t}" for c, t in points.dtypes) + ", cell bigint, far double"
    dealt = materialise(points.mapInPandas(assign, schema))
    radius = {r["cell"]: r["far"] for r in dealt.where("cell >= 0").groupBy("cell").agg(F.max("far").alias("far")).collect()}
    room, pairs = math.acos(SIMILARITY) + 1e-6, []
    for key, own in pivots.items():
        angle = np.arccos(np.clip(own @ own.T, -1, 1))
        for a in range(len(own)):
            for b in range(a + 1, len(own)):
                x, y = names[key] + a, names[key] + b
                if x in radius and y in radius and angle[a, b] <= radius[x] + radius[y] + room:
                    pairs.append((x, y))
    dealt = dealt.drop("far").withColumn("cell", F.when(F.col("cell") < 0, cell_of_label).otherwise(F.col("cell")))
    return dealt.withColumn("block", _block()), pairs


def _block():
    """A number that spreads the points of a cell; blocks are its remainders."""
    return F.xxhash64(F.lit(SEED + 1), "point")


def near_duplicates(vectors: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """vec_id, n_links and component_id of each row of ``vectors``."""
    spark = vectors.sparkSession
    good, others = split_usable(vectors)
    # the point's number is the least id of its rows
    whole = good.groupBy("label", "dim", "v").agg(F.count("*").alias("rows"), F.min("vec_id").cast("long").alias("point"))
    kinds = ", ".join(f"{c} {t}" for c, t in whole.dtypes)

    def to_codes(batches):
        for batch in batches:
            codes, factors = [None] * batch.num_rows, np.zeros(batch.num_rows)
            dims = np.asarray(batch.column(1))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                code, factors[at] = encode(_matrix(batch.column(2).take(pa.array(at)), len(at)))
                for k, row in zip(at, code, strict=True):
                    codes[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(factors)], names=[*batch.schema.names, "code", "factor"])

    points = materialise(whole.mapInArrow(to_codes, kinds + ", code binary, factor double"))
    cells, pairs = to_cells(points)
    cells = cells.withColumnRenamed("block", "h")
    counts = cells.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    neighbours = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "cell bigint, near bigint")
    near = neighbours.join(counts.select(F.col("cell").alias("near"), F.col("blocks").alias("near_blocks")), "near")
    near = near.unionByName(counts.select("cell", F.col("cell").alias("near"), F.col("blocks").alias("near_blocks")))
    per_cell = near.groupBy("cell").agg(F.collect_list(F.struct("near", "near_blocks")).alias("around"))  # as many as pivots at most
    placed = cells.join(counts.join(per_cell, "cell"), "cell").withColumn("b", F.pmod("h", F.col("blocks")).cast("int"))
    other = F.explode(F.flatten(F.transform("around", lambda x: F.transform(F.sequence(F.lit(0), x["near_blocks"] - 1), lambda k: F.struct(x["near"].alias("cell"), k.alias("b"))))))
    dealt = placed.select(F.struct("cell", "b").alias("here"), other.alias("there"), "point", "rows", "v", "code", "factor")
    tiles = dealt.select(F.least("here", "there").alias("lo"), F.greatest("here", "there").alias("hi"), (F.col("here") > F.col("there")).cast("int").alias("block"), (F.col("here") == F.col("there")).alias("own"), "point", "rows", "v", "code", "factor")

    def link(tile: pa.Table) -> pa.Table:
        return link_tile(tile, similarity)

    found = materialise(tiles.groupBy("lo", "hi").applyInArrow(link, "point bigint, n bigint, root bigint"))
    n_links = found.groupBy("point").agg(F.sum("n").alias("n"))
    components = connected_components(found.select(F.col("point").alias("a"), F.col("root").alias("b")))
    known = points.select("label", "v", "point", "rows").join(n_links, "point", "left")
    known = known.join(components.withColumnRenamed("node", "point"), "point", "left")
    known = known.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("component", "point").alias("component_id"))
    linked = good.select("vec_id", "label", "v").join(known, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = others.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionByName(alone)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    found = near_duplicates(read(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))
