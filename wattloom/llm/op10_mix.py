"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame and SQL functions only.

Every document of a source gets the same rate, its source's target over its source's size: the whole part of the rate
in sure copies, the rest as a fractional copy. Fractions are settled in pairs. Two documents with open words (fraction
times size) move words from one to the other until one of them is taken whole or not at all; which way is drawn so
that expectations stay, and the words of the pair stay the same. The open one of the two meets the next document.

Documents are dealt by a hash to groups of about GROUP of one source, so no source is ever in one task; each group
leaves one open document. Those of GROUP neighbouring groups meet on the next level, and so on to one per source, which
is drawn by its fraction. A source's words so miss the target by less than one document. Draws are hashes of ids: reruns agree.

Sources are ordered by code point, nulls last as a source of their own, with weights 3, 1, 2 repeating. Null texts have
size 0 and take nothing; an empty table gives an empty result. Texts of any length are one number here, their size.

Rows that repeat an id are documents of their own. A row is told by its id, source, size and a hash of all its columns;
rows that agree in these are interchangeable and numbered, within the partition that read them first, so that a group of
any number of them is never in one task. ``apply_mix`` keeps all columns of its input, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.llm.common import materialise, read

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
GROUP = 64
SEED = 20
#: With more sources than this their targets are joined by a shuffle.
MAX_BROADCAST_SOURCES = 50_000

_WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def with_sums_before(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the sums of all rows before each in a total order, without any task that sees them all.

    Rows are dealt to ranges of the order; sums are taken within a range and shifted by those of the ranges before.
    """
    ranged = materialise(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    per_part = ranged.groupBy("part").agg(*[F.sum(c).alias(f"{n}_all") for n, c in sums.items()])  # as many rows as partitions
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_part.select("part", *[F.coalesce(F.sum(f"{n}_all").over(ahead), F.lit(0)).alias(f"{n}_shift") for n in sums])
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = ranged.withColumns({n: F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()}).join(F.broadcast(shifts), "part")
    return met.withColumns({n: F.col(n) + F.col(f"{n}_shift") for n in sums}).drop("part", *[f"{n}_shift" for n in sums])


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, n_docs and target; one row a source.

    Handing the excess over until no source is above its limit fills all sources to a level: the words a unit of weight
    gets. In the order of limit over weight, the sources before the level are full and the others share what is left.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    name = F.col("source").asc_nulls_last()
    placed = with_sums_before(by_source, [name], {"place": F.lit(1)})
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighed = placed.withColumn("weight", F.get(table, F.pmod("place", F.lit(len(weights))).cast("int")))
    limit = F.lit(float(most)) * F.col("source_size")
    ranked = materialise(with_sums_before(weighed.withColumn("limit", limit), [(F.col("limit") / F.col("weight")).asc(), name], {"limits": F.col("limit"), "weights": F.col("weight")}))
    all_words, all_weights = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level = (F.lit(float(share) * all_words) - F.col("limits")) / (F.lit(float(all_weights)) - F.col("weights"))
    full = F.col("limit") <= level * F.col("weight")
    # the level of the first source that stays below its limit holds for all after it
    final = ranked.agg(F.min(F.when(~full, F.struct(F.col("limit") / F.col("weight"), level.alias("level"))))).first()[0]
    target = F.when(full, F.col("limit")).otherwise(F.lit(final["level"] if final else None).cast("double") * F.col("weight"))
    return ranked.select("source", "source_size", "n_docs", target.alias("target"))


#: Folds a group. ``now`` is the open document, ``out`` has the settled ones with the words that their fraction takes.
#: Words go from ``now`` to ``b`` with chance take / (give + take), and the other way otherwise.
_FOLD = """
aggregate(
  slice(items, 2, size(items)),
  struct(items[0] as now, slice(items, 1, 0) as out),
  (acc, b) -> transform(
    array(struct(
      least(acc.now.open, b.size - b.open) as give,
      least(b.open, acc.now.size - acc.now.open) as take,
      shiftrightunsigned(xxhash64({seed}, {level}, acc.now.id, b.id), 11) / 9007199254740992.0D as u)),
    m -> case when m.u * (m.give + m.take) < m.take
      then case when acc.now.open <= b.size - b.open
        then struct(struct(b.id as id, b.size as size, b.open + m.give as open) as now,
                    array_append(acc.out, struct(acc.now.id as id, acc.now.size as size, 0D as open)) as out)
        else struct(struct(acc.now.id as id, acc.now.size as size, acc.now.open - m.give as open) as now,
                    array_append(acc.out, struct(b.id as id, b.size as size, b.size as open)) as out) end
      else case when b.open <= acc.now.size - acc.now.open
        then struct(struct(acc.now.id as id, acc.now.size as size, acc.now.open + m.take as open) as now,
                    array_append(acc.out, struct(b.id as id, b.size as size, 0D as open)) as out)
        else struct(struct(b.id as id, b.size as size, b.open - m.take as open) as now,
                    array_append(acc.out, struct(acc.now.id as id, acc.now.size as size, acc.now.size as open)) as out) end
      end)[0])
"""


def settle(items: DataFrame, levels: int, seed: int = SEED) -> DataFrame:
    """source, id and open (0 or the size) of every item; items: source, node, id, size, open with 0 < open < size.

    ``node`` is the item's group on the lowest level; on the next, GROUP neighbouring groups are one.
    """
    settled = None
    for level in range(levels):
        grouped = items.groupBy("source", "node").agg(F.array_sort(F.collect_list(F.struct("id", "size", "open"))).alias("items"))
        folded = grouped.select("source", "node", F.expr(_FOLD.format(seed=seed, level=level)).alias("fold"))
        if level < levels - 1:
            folded = materialise(folded)
        done = folded.select("source", F.explode("fold.out").alias("x")).select("source", "x.id", "x.open")
        settled = done if settled is None else settled.unionByName(done)
        items = folded.select("source", F.floor(F.col("node") / GROUP).alias("node"), "fold.now.*")
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(-1), F.col("id")), 11) / F.lit(float(1 << 53))
    last = items.select("source", "id", F.when(drawn * F.col("size") < F.col("open"), F.col("size")).otherwise(F.lit(0.0)).alias("open"))
    return last if settled is None else settled.unionByName(last)


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row; maps, which can't be hashed, are left out."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if not f.dataType.simpleString().count("map<")])


def numbered(rows: DataFrame, keys: list[str], part: str) -> DataFrame:
    """``rows`` with ``row``, 1 to n within the rows of the same ``keys``, which are told apart by ``part`` only.

    Ranks are taken within a part and shifted by the counts of the parts before it, so equal keys are spread over tasks.
    """
    per_part = rows.groupBy(*keys, part).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy(part)) - F.col("n")
    shifts = per_part.select(F.struct(*keys).alias("k"), F.col(part).alias("p"), before.alias("before")).where("before > 0")
    own = rows.withColumn("row", F.row_number().over(Window.partitionBy(*keys, part).orderBy(*keys)))
    same = F.struct(*[own[k] for k in keys]).eqNullSafe(F.col("k")) & (own[part] == F.col("p"))
    return own.join(shifts, same, "left").withColumn("row", F.col("row") + F.coalesce("before", F.lit(0))).drop("k", "p", "before")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, hash, row, source_size, target and copies; ``row`` tells rows apart that agree in the first four."""
    keys = ["doc_id", "source", "size", "hash"]
    sizes = docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), row_hash(docs).alias("hash"), F.spark_partition_id().alias("part"))
    sizes = numbered(materialise(sizes), keys, "part").drop("part")
    sizes = materialise(sizes)
    targets = materialise(source_targets(sizes, weights, share, most))
    n_sources, largest = targets.agg(F.count("*"), F.max("n_docs")).first()
    if n_sources <= MAX_BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"]).withColumn("rate", rate)
    rated = rated.withColumn("sure", F.floor("rate")).withColumn("open", F.col("size") * (F.col("rate") - F.floor("rate")))
    rated = rated.withColumn("id", F.struct("doc_id", "size", "hash", "row"))
    is_open = (F.col("open") > 0) & (F.col("open") < F.col("size"))
    groups = F.ceil(F.col("n_docs") / GROUP)
    items = rated.where(is_open).select("source", F.pmod(F.xxhash64(F.lit(seed), F.lit(-2), "id"), groups).alias("node"), "id", F.col("size").cast("double").alias("size"), "open")
    levels, n = 1, -(-(largest or 1) // GROUP)
    while n > 1:
        levels, n = levels + 1, -(-n // GROUP)
    settled = settle(items, levels, seed).select(F.col("source").alias("s"), "id", F.col("open").alias("words"))
    out = rated.join(settled, rated["source"].eqNullSafe(F.col("s")) & (rated["id"] == settled["id"]), "left")
    copies = (F.col("sure") + F.when(F.col("words") > 0, 1).otherwise(0)).cast("long")
    return out.select(*keys, "row", "source_size", "target", copies.alias("copies"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; size 0 takes part by its rate's whole part only.

    Interchangeable rows share their copies: each gets the whole part of the mean, the first ones one more.
    """
    keys = ["doc_id", "source", "size", "hash"]
    per_key = mix_sources(docs, **options).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("copies").alias("total"))
    per_key = per_key.where("total > 0").select(F.struct(*keys).alias("k"), "n", "total")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.struct("doc_id", "source", count_words(F.col("text")).alias("size"), row_hash(docs).alias("hash")).alias("key"))
    joined = packed.join(per_key, F.col("key") == F.col("k")).drop("k")
    alone = joined.where("n = 1").select("doc", F.col("total").alias("times"))
    # only interchangeable rows need numbers
    several = materialise(joined.where("n > 1").withColumn("part", F.spark_partition_id()))
    ranked = numbered(several, ["key"], "part")
    times = F.floor(F.col("total") / F.col("n")) + F.when(F.col("row") <= F.col("total") % F.col("n"), 1).otherwise(0)
    both = alone.unionByName(ranked.select("doc", times.cast("long").alias("times")))
    repeated = both.where("times > 0").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"))
    return repeated.select("doc.*")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    mixed = mix_sources(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
