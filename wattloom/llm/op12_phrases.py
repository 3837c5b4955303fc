"""Phrase collocations by hierarchical pair naming.

Words that occur often enough in their language get a number, and texts become sequences of numbers with breaks where a
piece ends or a word is rare. A phrase of k words is the pair of its first and its last k - 1 words, so one round turns
a sequence of (k-1)-word numbers into one of k-word numbers: adjacent numbers are counted as pairs over all texts, the
pairs that are frequent get numbers by a join over the whole corpus, and each place gets the number of its pair or a
break. No phrase is frequent unless both parts are, so nothing is lost. A pair's two numbers point to its parents: what
comes before or after a cut is found by following the left or the right ones, and a phrase lies inside a longer one if
it is parent of one (a phrase of two words more holds one of one word more that is at least as frequent).

Counting: a task gathers the pairs of half a million places, sorts and counts them, and sends each bucket (a hash of
the pair) one run of sorted, packed keys. Buckets grow in number with the corpus, so that a bucket's distinct pairs
fit a task, and a pair adds one entry a run however often it occurs. Naming: up to MAX_WORDS words or MAX_PAIRS pairs
are broadcast; more are joined with the distinct words or pairs of each slice of text (never with its places), which
gives the same numbers. Numbers are dense; 2^31 frequent phrases of one length are the most, beyond it an error is raised.

Pieces end at ``. , ; : ! ?`` and at line and page breaks, words at blanks and tabs; A-Z count as a-z. A null text is empty,
and a null language is ``und``. Scores are exact: products are decimals of 38 digits. Repeated rows count once
each; ties in score go by frequency, then by the phrase's UTF-8 bytes, which no two phrases of a language share. An empty
table gives an empty result, and columns other than lang and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.llm.common import delete_dir, fold, materialise, mix, read, shared_dir, slices_of, word_spans
from wattloom.llm.op10_mix import with_sums_before

LEAST, LONGEST, SUBSUMED, MOST = 100, 5, 100, 2000
#: Frequent words and pairs up to these numbers are broadcast, as about 100 and 8 bytes each.
MAX_WORDS, MAX_PAIRS = 500_000, 4_000_000
#: Places of text whose pairs a task counts at once, and those a bucket is made for.
RUN, BUCKET = 500_000, 4_000_000
#: Bytes of text at a time, whose words are one row of numbers: rows beyond half a megabyte cost the JVM's heap far more than their size.
SLICE = 1 << 18
#: Words that a task gathers before it adds up equal ones, and those it keeps after.
GATHERED, KEPT = 400_000, 200_000
BUCKETS = 64

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[list(_BREAKS)] = True
_INSIDE = ~_IS_BREAK
_INSIDE[[0x20, 0x09]] = False

SEQUENCE = "chunk long, ids binary"
RUNS = "bucket int, n int, keys binary, counts binary"


def words_of(raw: np.ndarray, bounds: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of some texts, lower-cased, and whether a piece begins at each."""
    starts, stops, first = word_spans(raw, bounds, _INSIDE)
    breaks = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_IS_BREAK[raw], out=breaks[1:])
    begins = np.ones(len(starts), bool)
    begins[1:] = breaks[starts[1:]] != breaks[stops[:-1]]
    begins[first[first < len(starts)]] = True
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(stops - starts, out=offsets[1:])
    letters = fold(raw[_INSIDE[raw]])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters)))
    return words.dictionary_encode(), begins


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.DictionaryArray, np.ndarray]]:
    """Language, words and piece starts of slices of about SLICE bytes (lang and text are the first columns)."""
    for batch in batches:
        langs = pc.fill_null(batch.column(0).cast(pa.string()), "und").dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column(1).filter(pc.equal(langs.indices, k))
            for _, _, raw, bounds in slices_of(texts, SLICE):
                words, begins = words_of(raw, bounds)
                if len(words):
                    yield lang, words, begins


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word and n; all words of a language together have a null word."""
    held: dict[str, list[pa.Table]] = {}
    size = 0

    def merged(lang: str) -> pa.Table:
        return pa.concat_tables(held[lang]).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def rows(lang: str, own: pa.Table) -> Iterator[pa.RecordBatch]:
        own = pa.concat_tables([own, pa.table({"word": pa.array([None], own.schema.field("word").type), "n": pa.array([pc.sum(own.column("n")).as_py()], pa.int64())})])
        for part in own.combine_chunks().to_batches(max_chunksize=50_000):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * part.num_rows, pa.string()), part.column("word").cast(pa.string()), part.column("n")], names=["lang", "word", "n"])

    for lang, words, _ in by_language(batches):
        n = np.bincount(words.indices, minlength=len(words.dictionary))
        held.setdefault(lang, []).append(pa.table({"word": words.dictionary, "n": pa.array(n, pa.int64())}))
        size += len(n)
        if size > GATHERED:
            held = {x: [merged(x)] for x in held}
            size = sum(len(t[0]) for t in held.values())
            if size > KEPT:
                for x, tables in held.items():
                    yield from rows(x, tables[0])
                held, size = {}, 0
    for lang in held:
        yield from rows(lang, merged(lang))


def broken(ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """``ids`` with a break (-1) before each start of a piece."""
    return compact(np.insert(ids, np.flatnonzero(begins), -1))


def compact(ids: np.ndarray) -> np.ndarray:
    """Runs of breaks as one, none at the ends but one at the start."""
    keep = ids >= 0
    keep[:-1] |= ids[1:] >= 0
    return ids[keep].astype(np.int32)


def chunk_numbers() -> Iterator[int]:
    """Numbers of the rows that a task makes, which no other task makes; a task that runs again makes the same."""
    n = TaskContext.get().partitionId() << 40
    while True:
        yield n
        n += 1


def _rows(rows: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for chunk, ids in rows:
        if (ids >= 0).any():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([ids.astype(np.int32).tobytes()], pa.binary())], names=["chunk", "ids"])


def sequences(batches: Iterator[pa.RecordBatch], numbers: dict[str, dict[str, int]]) -> Iterator[pa.RecordBatch]:
    chunks = chunk_numbers()

    def rows():
        for lang, words, begins in by_language(batches):
            own = numbers.get(lang, {})
            ids = np.array([own.get(w, -1) for w in words.dictionary.to_pylist()], np.int64)
            yield next(chunks), broken(ids[np.asarray(words.indices)], begins)

    return _rows(rows())


def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices as places in their own list of words, for words that are too many to broadcast."""
    chunks = chunk_numbers()
    for lang, words, begins in by_language(batches):
        places = broken(np.asarray(words.indices, np.int64), begins)
        yield pa.RecordBatch.from_arrays(
            [pa.array([next(chunks)], pa.int64()), pa.array([lang]), pa.array([words.dictionary.to_pylist()], pa.list_(pa.string())), pa.array([places.tobytes()], pa.binary())],
            names=["chunk", "lang", "words", "ids"],
        )


def ids_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for chunk, ids in zip(batch.column("chunk").to_pylist(), batch.column("ids"), strict=True):
            yield chunk, np.frombuffer(ids.as_buffer(), np.int32)


def pair_keys(ids: np.ndarray) -> np.ndarray:
    """The key of the pair that begins at each place, -1 where there is none."""
    left, right = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
    return np.where((left >= 0) & (right >= 0), left << 32 | right, -1)


def runs_of_pairs(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs of the pairs of RUN places, one a bucket."""
    codec, held, size = pa.Codec("zstd"), [], 0

    def run() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        bucket = (mix(keys.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")  # keys stay sorted within a bucket
        keys, counts = keys[order], counts[order].astype(np.uint32)
        names, at = np.unique(bucket[order], return_index=True)
        ends = np.append(at[1:], len(keys))
        packed = [[codec.compress(np.diff(keys[i:j], prepend=0).tobytes(), asbytes=True), codec.compress(counts[i:j].tobytes(), asbytes=True)] for i, j in zip(at, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array((ends - at).astype(np.int32)), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())], names=["bucket", "n", "keys", "counts"])

    for _, ids in ids_in(batches):
        for k in range(0, max(len(ids) - 1, 0), RUN):  # a part takes one place of the next with it
            keys = pair_keys(ids[k : k + RUN + 1])
            held.append(keys[keys >= 0])
            size += len(held[-1])
            if size >= RUN:
                yield run()
                held, size = [], 0
    if size:
        yield run()


def summed_pairs(runs: pa.Table, least: int) -> pa.Table:
    """left, right and f of a bucket's pairs that occur ``least`` times or more."""
    codec, keys, counts = pa.Codec("zstd"), [], []
    for n, k, c in zip(*(runs.column(x).to_pylist() for x in ("n", "keys", "counts")), strict=True):
        keys.append(np.cumsum(np.frombuffer(codec.decompress(k, decompressed_size=8 * n), np.int64)))
        counts.append(np.frombuffer(codec.decompress(c, decompressed_size=4 * n), np.uint32))
        if len(keys) > 16:  # runs share their frequent keys
            keys, counts = ([x] for x in _sums(keys, counts))
    own, f = _sums(keys, counts)
    own, f = own[f >= least], f[f >= least]
    return pa.table({"left": pa.array((own >> 32).astype(np.int32)), "right": pa.array((own & 0xFFFFFFFF).astype(np.int32)), "f": pa.array(f)})


def _sums(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate([c.astype(np.int64) for c in counts])
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[at], np.add.reduceat(n[order], at)


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with dense ids in the given order, as a written table, and how many there are."""
    out = materialise(with_sums_before(rows, [F.col(c) for c in order], {"id": F.lit(1)}).withColumn("id", F.col("id").cast("long")))
    n = out.count()
    if n >= 1 << 31:
        raise OverflowError(f"{n} frequent phrases of one length; 2^31 is the most")
    return out, n


def named_words(docs: DataFrame, words: DataFrame, n: int, most: int) -> DataFrame:
    """The sequences of word numbers."""
    spark = docs.sparkSession
    if n <= most:
        numbers: dict[str, dict[str, int]] = {}
        for r in words.select("lang", "word", "id").toLocalIterator():
            numbers.setdefault(r["lang"], {})[r["word"]] = r["id"]
        shared = spark.sparkContext.broadcast(numbers)
        return docs.mapInArrow(lambda batches: sequences(batches, shared.value), SEQUENCE)
    slices = materialise(docs.mapInArrow(coded, "chunk long, lang string, words array<string>, ids binary"))
    needs = slices.select("chunk", "lang", F.posexplode("words").alias("place", "word")).join(words, ["lang", "word"]).select(F.col("chunk").alias("of"), "place", "id")

    def name(own: pa.Table, found: pa.Table) -> pa.Table:
        ((chunk, places),) = ids_in(own.to_batches())
        return _named(chunk, places, int(places.max(initial=-1)) + 1, found)

    return slices.select("chunk", "ids").groupBy("chunk").cogroup(needs.groupBy("of")).applyInArrow(name, SEQUENCE)


def _named(chunk: int, places: np.ndarray, size: int, found: pa.Table) -> pa.Table:
    numbers = np.full(size + 1, -1, np.int64)  # the last stands for a break
    numbers[np.asarray(found.column("place"))] = np.asarray(found.column("id"))
    return pa.Table.from_batches(_rows([(chunk, compact(numbers[places]))]), pa.schema([("chunk", pa.int64()), ("ids", pa.binary())]))


def named_pairs(sequence: DataFrame, pairs: DataFrame, n: int, most: int) -> DataFrame:
    """The sequences with each place's pair in place of its number."""
    spark = sequence.sparkSession
    if n <= most:
        table = pairs.select(((F.col("left").cast("long") * (1 << 32)) + F.col("right")).alias("key")).toArrow()
        shared = spark.sparkContext.broadcast(np.sort(np.asarray(table.column("key"))))  # ids are places in this order

        def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            return _rows((chunk, compact(np.where(known[at := np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys, at, -1))) for chunk, keys in ((c, pair_keys(ids)) for c, ids in ids_in(batches)))

        return sequence.mapInArrow(replace, SEQUENCE)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids in ids_in(batches):
            keys = np.unique(pair_keys(ids))
            at = np.flatnonzero(keys >= 0).astype(np.int32)
            keys = keys[at]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), chunk)), pa.array(at), pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32))], names=["chunk", "place", "left", "right"])

    def name(own: pa.Table, found: pa.Table) -> pa.Table:
        ((chunk, ids),) = ids_in(own.to_batches())
        keys, places = np.unique(pair_keys(ids), return_inverse=True)
        return _named(chunk, places, len(keys), found)

    needs = sequence.mapInArrow(distinct, "chunk long, place int, left int, right int").join(pairs, ["left", "right"]).select(F.col("chunk").alias("of"), "place", "id")
    return sequence.groupBy("chunk").cogroup(needs.groupBy("of")).applyInArrow(name, SEQUENCE)


def levels_of(docs: DataFrame, least: int, longest: int, max_words: int, max_pairs: int) -> tuple[DataFrame, list[DataFrame]]:
    """lang and n; and for each length the frequent phrases: id, lang, phrase, last (word), a, left, right, and the frequencies
    of what comes before and after each cut (``before``, ``after``, by length)."""
    docs = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = docs.mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = materialise(counts.where((F.col("n") >= least) | F.col("word").isNull()))
    totals = counts.where("word is null").select("lang", "n")
    words, n = numbered(counts.where("word is not null"), ["lang", "word"])
    nothing = F.array().cast("array<bigint>")
    levels = [words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.col("n").alias("a"), nothing.alias("before"), nothing.alias("after"))]
    if not n:
        return totals, levels
    n_buckets = max(BUCKETS, -(-int(totals.agg(F.sum("n")).first()[0]) // BUCKET))
    here = shared_dir(docs.sparkSession)
    sequence = materialise(named_words(docs, words, n, max_words), here)
    for k in range(2, longest + 1):
        runs = sequence.mapInArrow(lambda batches: runs_of_pairs(batches, n_buckets), RUNS)
        frequent = runs.groupBy("bucket").applyInArrow(lambda t: summed_pairs(t, least), "left int, right int, f long")
        pairs, n = numbered(materialise(frequent), ["left", "right"])
        if not n:
            break
        x, y = (levels[-1].select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("lang", "phrase", "last", "a", "before", "after")]) for side in ("left", "right"))
        joined = pairs.join(x, "left").join(y, "right")
        levels.append(materialise(joined.select(
            "id", F.col("left_lang").alias("lang"), F.concat_ws(" ", "left_phrase", "right_last").alias("phrase"), F.col("right_last").alias("last"), F.col("f").alias("a"),
            F.concat("left_before", F.array("left_a")).alias("before"), F.concat("right_after", F.array("right_a")).alias("after"), "left", "right",
        )))
        if k < longest:
            there = shared_dir(docs.sparkSession)
            sequence = materialise(named_pairs(sequence, pairs, n, max_pairs), there)
            delete_dir(docs.sparkSession, here)
            here = there
    delete_dir(docs.sparkSession, here)
    return totals, levels


def _decimal(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def _cut(length: int):
    """The score, place and parts' frequencies of a phrase's cut after its first j words, as a function of j."""
    product = F.lit(1000).cast("decimal(4,0)") * (_decimal(F.col("a")) * _decimal(F.col("n")))

    def cut(j: Column) -> Column:
        left, right = F.get("before", j - 1), F.get("after", F.lit(length - 1) - j)
        score = F.call_function("div", product, _decimal(left) * _decimal(right))
        return F.struct(score.alias("score"), j.alias("k"), left.alias("l"), right.alias("r"))

    return cut


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, subsumed: int = SUBSUMED, max_words: int = MAX_WORDS, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """lang, phrase, a, l, r, n and score of every phrase of two words or more that no longer one subsumes."""
    totals, levels = levels_of(docs, least, longest, max_words, max_pairs)
    out = None
    for k, level in enumerate(levels[1:], 2):
        own = level
        if k < len(levels):
            longer = levels[k].select(F.col("left").cast("long").alias("id"), F.col("a").alias("longer")).unionByName(levels[k].select(F.col("right").cast("long").alias("id"), F.col("a").alias("longer")))
            own = own.join(longer.groupBy("id").agg(F.max("longer").alias("longer")), "id", "left").where(F.expr(f"longer is null or 100 * longer < {int(subsumed)} * a"))
        own = own.join(totals, "lang")
        best = F.array_min(F.transform(F.sequence(F.lit(1), F.lit(k - 1)), _cut(k)))
        rows = own.withColumn("cut", best).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return docs.sparkSession.createDataFrame([], "lang string, phrase string, a long, l long, r long, n long, score long")
    return out


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language."""
    found = collocations(read(spark, sf_dir, "documents"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= MOST)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
