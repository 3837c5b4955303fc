"""Toxicity by the nearest labelled examples.

Labelled texts of a bounded sample become TF-IDF vectors over all of their terms. Terms that tell toxic texts (a
likelihood-ratio test against chance, on texts that are not copies of each other) may weigh some times as much, as topics
can rule the cosine otherwise; every other term keeps its idf. How much is chosen among FACTORS on examples alone: terms and
neighbours come from one part of them, and the factor whose votes tell the labels of another part best is taken. The lists of
the FREQUENT most frequent terms, which have most of the postings, are cut into blocks of BLOCK examples that are alike in
those terms, and the largest weight of each block is stored. The next terms up to COMMON are rows of a dense matrix, the
others are whole inverted lists; both are added up for a batch of texts at once. Those sums and the blocks' maxima bound
each cosine from above. The K-th best cosine among the examples of the LEAD blocks of largest bound is a floor of the K-th best of all, blocks
whose bounds stay below it are skipped, and examples at the floor or above are summed again in double precision, so the K
nearest are exact.

Neighbours vote, each by its cosine; votes are calibrated on the examples themselves, each left out of its own vote (a
Spark job over the examples), by the rising step function that fits best (isotonic regression). A text without any term
of the examples has no neighbours and gets the share of toxic labels among examples without a telling term. The nearest
examples come along as evidence.

EXAMPLES labelled rows of least hash and MAX_ENTRIES entries bound the index, nothing bounds the texts; queries are whole texts
of all rows. Nulls count as empty texts. Ties between examples go to the smaller doc_id. Without usable labels every
score is 0. Labels without a document are ignored; repeated rows get equal scores; an empty table gives an empty result.
Columns other than doc_id and text are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import ALPHANUMERIC, crc_mod, labelled_sample, materialise, mix, read, slices_of, word_hashes, word_spans

EXAMPLES, COMMON, FREQUENT = 24_000, 512, 64
#: A term tells toxic texts if so many texts have it, with so large a statistic, and toxic texts so much oftener.
LEAST_TEXTS, LEAST_EVIDENCE, LEAST_LIFT = 5, 20.0, 3.0
#: What telling terms may weigh more by; the fit chooses, on a fold of at most CHOICE examples that neither the terms nor the neighbours come from.
FACTORS, CHOICE = (1.0, 2.0, 4.0, 8.0), (4_000, 1_000)
#: Entries (a term of an example) of the index; examples of least hash are kept until they have so many, always whole texts.
MAX_ENTRIES = 20_000_000
K, BLOCK, EVIDENCE = 15, 8, 3
#: Blocks of largest bound whose examples give the floor.
LEAD = 192
#: Texts whose dense parts are added up at once, and whose lists are; sums are in single precision, off by far less than SLACK.
BATCH, LISTED, SLACK = 256, 8, 1e-5


def row_terms(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, term hash) of every word of letters and digits."""
    starts, stops, first = word_spans(raw, bounds, ALPHANUMERIC)
    return np.repeat(np.arange(len(bounds) - 1), np.diff(first)), word_hashes(raw, starts, stops).view(np.int64)


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges that begin at ``first``, one range after the other."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def alike(rows: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The rows by number, those that are alike close to each other: by halves along the axis of greatest variance, and
    halves of those, down to a few blocks. Halves are whole blocks."""
    if len(of) <= BLOCK:
        return of
    apart = rows[of] - rows[of].mean(axis=0)
    axis = np.linalg.eigh(apart.T @ apart)[1][:, -1]
    order = of[np.argsort(apart @ axis, kind="stable")]
    if len(of) <= 8 * BLOCK:
        return order
    half = (-(-len(of) // BLOCK) + 1) // 2 * BLOCK
    return np.concatenate([alike(rows, order[:half]), alike(rows, order[half:])])


def example_terms(sample: DataFrame) -> DataFrame:
    """doc_id, label and the arrays term and tf of each sampled text that has a term; the distinct texts only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, bounds in slices_of(batch.column(1)):
                row, term = row_terms(raw, bounds)
                order = np.lexsort((term, row))
                row, term = row[order], term[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
                at = np.flatnonzero(new)
                offsets = pa.array(np.searchsorted(row[at], np.arange(j - i + 1)), pa.int32())
                tf = np.diff(np.append(at, len(row)))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (term[at], tf.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), *lists], names=["doc_id", "label", "term", "tf"])

    texts = sample.where(F.col("text").isNotNull()).groupBy(F.xxhash64("text").alias("h"), F.md5("text").alias("m")).agg(F.min_by(F.struct("doc_id", "text", "label"), "doc_id").alias("x")).select("x.*")
    counted = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("label").cast("int").alias("label")).mapInArrow(count, "doc_id bigint, label int, term array<bigint>, tf array<int>")
    return counted.where(F.size("term") > 0)


def telling_terms(a: np.ndarray, df: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Which terms tell toxic texts; a, df: how many toxic and how many texts have each."""
    b, total = df - a, n_toxic + n_clean

    def part(seen, of, row):  # observed times log of observed over expected
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(seen > 0, seen * np.log(seen * total / (of * row)), 0.0)

    g = 2 * (part(a, n_toxic, df) + part(b, n_clean, df) + part(n_toxic - a, n_toxic, total - df) + part(n_clean - b, n_clean, total - df))
    return (df >= LEAST_TEXTS) & (g >= LEAST_EVIDENCE) & (a * n_clean >= LEAST_LIFT * n_toxic * b)


class BlockMaxIndex:
    """Examples' TF-IDF vectors, by example and by term."""

    n_blocks = 1  # pieces of a term's list in ``edges``; the maxima are of ``frequent``

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, places: np.ndarray, tf: np.ndarray, n_empty: tuple[int, int], telling: np.ndarray | None = None) -> None:
        """vocabulary: sorted hashes, ``telling`` marks those that tell toxic texts (without it, all); rows, places, tf:
        the examples' entries by example; ids ascend. n_empty: toxic and all examples without a telling term."""
        self.vocabulary, self.idf, self.ids, self.labels = vocabulary, idf, ids, labels
        self.terms = vocabulary if telling is None else vocabulary[telling]
        self.own, self.place, self.own_tf = np.searchsorted(rows, np.arange(len(ids) + 1)), places.astype(np.int32, copy=False), tf.astype(np.int32)
        self.own_weight = np.empty(len(places), np.float32)
        for lo in range(0, len(ids), 1024):  # some examples at a time: the driver holds little beside the index
            hi = min(lo + 1024, len(ids))
            span = slice(self.own[lo], self.own[hi])
            weight = (1 + np.log(tf[span])) * idf[places[span]]
            self.own_weight[span] = weight / np.sqrt(np.bincount(rows[span] - lo, weight**2, minlength=hi - lo))[rows[span] - lo]
        toxic, every = n_empty
        self.empty_score = toxic / every if every else float(labels.mean()) if len(labels) else 0.0
        self.shared = None
        self.looked = np.zeros(2, np.int64)  # places in lists of frequent terms: looked at, and all of the texts asked about

    def __getstate__(self) -> dict:
        """What a task can't make of the rest."""
        return {k: v for k, v in self.__dict__.items() if k not in ("shared", "steps", "lists", "common", "frequent")}

    @cached_property
    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each term's list begins, and the examples and weights of the lists."""
        order = np.argsort(self.place, kind="stable")
        row = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.own))
        return np.searchsorted(self.place[order], np.arange(len(self.vocabulary) + 1)), row[order], self.own_weight[order]

    @property
    def edges(self) -> np.ndarray:
        return self.lists[0]

    @property
    def example(self) -> np.ndarray:
        return self.lists[1]

    @property
    def weight(self) -> np.ndarray:
        return self.lists[2]

    @cached_property
    def ranked(self) -> np.ndarray:
        """The COMMON most frequent terms."""
        return np.argsort(-np.diff(self.edges), kind="stable")[:COMMON]

    def _matrix(self, terms: np.ndarray, column: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Each term's row of a dense matrix (-1: it has none) and the matrix of their weights, with each example's column."""
        row = np.full(len(self.vocabulary), -1, np.int32)
        row[terms] = np.arange(len(terms))
        dense = np.zeros((len(terms), width), np.float32)
        for k, c in enumerate(terms):
            span = slice(self.edges[c], self.edges[c + 1])
            dense[k, column[self.example[span]]] = self.weight[span]
        return row, dense

    @cached_property
    def frequent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The frequent terms' rows, the example of each slot, each example's slot, the terms' weights by slot and their maxima
        by block. A block is BLOCK examples that are alike; of n blocks, b has the slots b, b + n, b + 2n and so on."""
        n = len(self.ids)
        row, dense = self._matrix(self.ranked[:FREQUENT], np.arange(n), n)
        order, width = alike(dense.T, np.arange(n)), -(-n // BLOCK)
        slot, example_of = np.empty(n, np.int64), np.full(width * BLOCK, -1)
        slot[order] = np.arange(n) % BLOCK * width + np.arange(n) // BLOCK
        example_of[slot] = np.arange(n)
        by_slot = np.zeros((width * BLOCK, len(dense)), np.float32)
        by_slot[slot] = dense.T
        return row, example_of, slot, by_slot, by_slot.reshape(BLOCK, width, -1).max(axis=0).T.copy()

    @cached_property
    def common(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows and weights by slot of the common terms that are not among the frequent ones."""
        _, _, slot, by_slot, _ = self.frequent
        return self._matrix(self.ranked[FREQUENT:], slot, len(by_slot))

    def nearest_of(self, edges: np.ndarray, places: np.ndarray, weight: np.ndarray, skip: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of each of a few vectors, whose entries lie between ``edges``."""
        n = len(edges) - 1
        frequent, example_of, slot_of, by_slot, maxima = self.frequent
        row, dense = self.common
        query, at, top = np.repeat(np.arange(n), np.diff(edges)), row[places], frequent[places]
        first, often = np.zeros((n, len(dense)), np.float32), at >= 0
        first[query[often], at[often]] = weight[often]
        asked, told = np.zeros((n, len(maxima)), np.float32), top >= 0
        asked[query[told], top[told]] = weight[told]
        sums = first @ dense
        other = ~often & ~told
        rare, held, of = places[other], weight[other].astype(np.float32), query[other]
        size = self.edges[rare + 1] - self.edges[rare]
        cut = np.searchsorted(of, np.arange(0, n + LISTED, LISTED))
        for k in range(len(cut) - 1):
            part = slice(cut[k], cut[k + 1])
            spot = _spans(self.edges[rare[part]], size[part])
            cell = np.repeat(of[part] * sums.shape[1], size[part]) + slot_of[self.example[spot]]
            np.add.at(sums.reshape(-1), cell, np.repeat(held[part], size[part]) * self.weight[spot])
        if skip is not None:
            sums[np.arange(n), slot_of[skip]] = -4  # more than a cosine can mend
        blocks, bounds = sums.reshape(n, BLOCK, -1), asked @ maxima
        peaks = blocks.max(axis=1) + bounds
        width, vector = maxima.shape[1], np.zeros(len(self.vocabulary))
        for k in range(n):
            peak, floor = peaks[k], 0.0
            if len(peak) > LEAD:
                lead = np.argpartition(peak, -LEAD)[-LEAD:]
                lead += blocks[k][:, lead].argmax(axis=0) * width
                floor = max(0.0, np.partition(sums[k, lead] + by_slot[lead] @ asked[k], -K)[-K] - SLACK)
            # only blocks whose bound reaches the floor are looked into
            block = np.flatnonzero((peak > 0) & (peak >= floor))
            place, which = np.nonzero(blocks[k][:, block] + bounds[k, block] >= floor)
            own = block[which] + place * width
            score = sums[k, own] + by_slot[own] @ asked[k]
            self.looked += np.array([len(own), len(peak) * BLOCK]) * np.count_nonzero(asked[k])
            if len(own) > K:
                floor = max(floor, np.partition(score, -K)[-K] - SLACK)
            own = example_of[own[(score > 0) & (score >= floor)]]
            span = slice(edges[k], edges[k + 1])
            vector[places[span]] = weight[span]
            size = self.own[own + 1] - self.own[own]
            spot = _spans(self.own[own], size)
            score = np.bincount(np.repeat(np.arange(len(own)), size), vector[self.place[spot]] * self.own_weight[spot], minlength=len(own)).astype(float)
            vector[places[span]] = 0
            order = np.lexsort((own, -np.round(score, 12)))[:K]
            yield own[order], score[order]

    def nearest(self, places: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The K nearest examples of a unit vector and their cosines, nearest first, ties by example."""
        return next(self.nearest_of(np.array([0, len(places)]), places, weight))

    def votes(self, edges: np.ndarray, places: np.ndarray, tf: np.ndarray, skip: np.ndarray | None = None) -> Iterator[tuple[float, np.ndarray]]:
        """The share of cosine that falls to toxic neighbours (nan without any), and the neighbours, of each vector."""
        for i in range(0, len(edges) - 1, BATCH):
            part = edges[i : i + BATCH + 1]
            span = slice(part[0], part[-1])
            weight = (1 + np.log(tf[span])) * self.idf[places[span]]
            row = np.repeat(np.arange(len(part) - 1), np.diff(part))
            weight /= np.sqrt(np.bincount(row, weight**2, minlength=len(part) - 1))[row]
            for best, score in self.nearest_of(part - part[0], places[span], weight, None if skip is None else skip[i : i + BATCH]):
                yield (float(score @ self.labels[best] / score.sum()) if len(best) else np.nan), best

    def left_out(self, lo: int, hi: int) -> np.ndarray:
        """Votes of the examples lo to hi, each left out of its own."""
        span = slice(self.own[lo], self.own[hi])
        return np.array([v for v, _ in self.votes(self.own[lo : hi + 1] - self.own[lo], self.place[span], self.own_tf[span].astype(float), np.arange(lo, hi))])

    @cached_property
    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        return self.calibrate(self.left_out(0, len(self.ids)))

    def calibrate(self, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Votes and the share of toxic examples at them, rising: pools of adjacent violators."""
        use = ~np.isnan(votes)
        order = np.argsort(votes[use], kind="stable")
        x, y = votes[use][order], self.labels[use][order].astype(float)
        pools: list[list[float]] = []  # toxic, all, least vote, greatest vote
        for vote, label in zip(x, y, strict=True):
            pools.append([label, 1.0, vote, vote])
            while len(pools) > 1 and (pools[-2][3] == pools[-1][2] or pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]):
                toxic, n, _, most = pools.pop()
                pools[-1][0] += toxic
                pools[-1][1] += n
                pools[-1][3] = most
        at = [(p[2] + p[3]) / 2 for p in pools]
        share = [(p[0] + self.empty_score) / (p[1] + 1) for p in pools]  # one example's worth of doubt
        return np.array(at), np.maximum.accumulate(np.array(share)) if share else np.array([])


@dataclass
class Examples:
    """Labelled texts by term: ids, labels, and entries (row, place in the vocabulary, count) by row."""

    ids: np.ndarray
    labels: np.ndarray
    vocabulary: np.ndarray
    rows: np.ndarray
    places: np.ndarray
    tf: np.ndarray

    def take(self, which: np.ndarray) -> Examples:
        """Some of the examples, in the order given."""
        edges = np.searchsorted(self.rows, np.arange(len(self.ids) + 1))
        size = edges[which + 1] - edges[which]
        spot = _spans(edges[which], size)
        rows = np.repeat(np.arange(len(which), dtype=np.int32), size)
        return Examples(self.ids[which], self.labels[which], self.vocabulary, rows, self.places[spot], self.tf[spot])

    def of_terms(self, used: np.ndarray) -> Examples:
        """The same over a part of the vocabulary, which has all of their terms."""
        return Examples(self.ids, self.labels, self.vocabulary[used], self.rows, np.searchsorted(used, self.places).astype(np.int32), self.tf)

    def index(self, factor: float) -> BlockMaxIndex:
        n, n_toxic = len(self.ids), int(self.labels.sum())
        df, toxic = (np.bincount(x, minlength=len(self.vocabulary)) for x in (self.places, self.places[self.labels[self.rows] == 1]))
        telling = telling_terms(toxic, df, n_toxic, n - n_toxic)
        told = np.zeros(n, bool)
        told[self.rows[telling[self.places]]] = True
        idf = (np.log((1 + n) / (1 + df)) + 1) * np.where(telling, factor, 1.0)
        return BlockMaxIndex(self.vocabulary, idf, self.ids, self.labels, self.rows, self.places, self.tf, (int(self.labels[~told].sum()), int((~told).sum())), telling)


def best_split(votes: np.ndarray, labels: np.ndarray) -> int:
    """The most labels that one threshold of the votes tells; texts without a vote count as clean."""
    order = np.argsort(-np.nan_to_num(votes, nan=-1.0), kind="stable")
    vote, toxic = np.nan_to_num(votes, nan=-1.0)[order], labels[order]
    right = np.concatenate([[0], np.cumsum(np.where(toxic == 1, 1, -1))]) + int((labels == 0).sum())
    ends = np.concatenate([[True], vote[1:] != vote[:-1], [True]]) if len(vote) else np.array([True])
    return int(right[ends].max())


def chosen_factor(spark: SparkSession, examples: Examples) -> float:
    """The factor whose votes tell the labels of the choice's second part best; the least of equals."""
    order = np.argsort(mix(examples.ids.astype(np.uint64)), kind="stable")  # by hash: ids may rise with time or source
    cut = min(CHOICE[0], len(order) * 4 // 5)
    learn, ask = examples.take(order[:cut]), examples.take(order[cut : cut + CHOICE[1]])
    used = np.unique(np.concatenate([learn.places, ask.places]))
    learn, ask = learn.of_terms(used), ask.of_terms(used)
    if not 0 < learn.labels.sum() < len(learn.labels) or not len(ask.labels):
        return 1.0
    right = []
    edges = np.searchsorted(ask.rows, np.arange(len(ask.ids) + 1))
    for factor in FACTORS:
        shared = spark.sparkContext.broadcast((learn.index(factor), edges, ask.places, ask.tf))

        def vote(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, edges, places, tf = shared.value
            for batch in batches:
                k = np.asarray(batch.column(0))  # consecutive
                if len(k):
                    own, span = edges[k[0] : k[-1] + 2], slice(edges[k[0]], edges[k[-1] + 1])
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v for v, _ in index.votes(own - own[0], places[span], tf[span].astype(float))], pa.float64())], names=["k", "vote"])

        votes = spark.range(0, len(ask.ids), 1, 4).mapInArrow(vote, "k bigint, vote double").toArrow().sort_by("k")
        right.append(best_split(votes.column("vote").to_numpy(), ask.labels))
        shared.destroy()
    return FACTORS[int(np.argmax(right))]


def bounded(counted: DataFrame) -> DataFrame:
    """The examples of least hash that have MAX_ENTRIES entries together."""
    rows = materialise(counted.withColumn("h", F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string"))))
    sizes = rows.select("h", "doc_id", F.size("term").alias("n")).orderBy("h", "doc_id").collect()  # at most EXAMPLES rows
    total = np.cumsum([r["n"] for r in sizes])
    if len(total) and total[-1] > MAX_ENTRIES:
        last = sizes[max(0, int(np.searchsorted(total, MAX_ENTRIES, side="right")) - 1)]
        rows = rows.where((F.col("h") < last["h"]) | ((F.col("h") == last["h"]) & (F.col("doc_id") <= last["doc_id"])))
    return rows.drop("h")


def fit(docs: DataFrame, labels: DataFrame, may_learn) -> BlockMaxIndex | None:
    """The index of the bounded sample, built on the driver; the choice of the factor and the calibration are jobs over the examples."""
    spark = docs.sparkSession
    got = bounded(example_terms(labelled_sample(docs, labels, "toxic", may_learn, EXAMPLES))).orderBy("doc_id").toArrow().combine_chunks()
    own = got.column("label").to_numpy().astype(np.int64)
    n, n_toxic = len(own), int(own.sum())
    if not 0 < n_toxic < n:
        return None
    ids, lists = got.column("doc_id").to_numpy(), got.column("term").combine_chunks()
    rows = np.repeat(np.arange(n, dtype=np.int32), np.diff(np.asarray(lists.offsets)))
    term, tf = lists.flatten().to_numpy(), got.column("tf").combine_chunks().flatten().to_numpy()
    vocabulary = np.unique(term)
    places = np.empty(len(term), np.int32)
    for k in range(0, len(term), 1 << 20):
        places[k : k + (1 << 20)] = np.searchsorted(vocabulary, term[k : k + (1 << 20)])
    examples = Examples(ids, own, vocabulary, rows, places, tf.astype(np.float32))
    del got, lists, term, rows, tf, vocabulary, places
    index = examples.index(chosen_factor(spark, examples))
    del examples
    shared = index.shared = spark.sparkContext.broadcast(index)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.asarray(batch.column(0))  # consecutive
            if len(k):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.left_out(int(k[0]), int(k[-1]) + 1))], names=["k", "vote"])

    votes = spark.range(0, n, 1, -(-n // 512)).mapInArrow(vote, "k bigint, vote double").toArrow().sort_by("k")
    index.steps = index.calibrate(votes.column("vote").to_numpy())
    return index


def score_toxicity(docs: DataFrame, index: BlockMaxIndex | None) -> DataFrame:
    """doc_id, score and evidence (doc_ids of the nearest examples) of each row."""
    shared = index and (index.shared or docs.sparkSession.sparkContext.broadcast(index))
    steps, empty_score = (index.steps, index.empty_score) if index else (None, 0.0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared and shared.value
        for batch in batches:
            for i, j, raw, bounds in slices_of(batch.column(1)):
                scores, evidence = np.full(j - i, empty_score), [[] for _ in range(j - i)]
                if own is not None:
                    row, term = row_terms(raw, bounds)
                    place = np.minimum(np.searchsorted(own.vocabulary, term), len(own.vocabulary) - 1)
                    hit = own.vocabulary[place] == term
                    pairs, tf = np.unique(row[hit] * len(own.vocabulary) + place[hit], return_counts=True)
                    rows = pairs // len(own.vocabulary)
                    edges = np.append(np.flatnonzero(np.diff(rows, prepend=-1)), len(rows))
                    for at, (vote, best) in zip(rows[edges[:-1]], own.votes(edges, pairs % len(own.vocabulary), tf.astype(float)), strict=True):
                        if len(best):
                            scores[at], evidence[at] = np.interp(vote, *steps) if len(steps[0]) else empty_score, own.ids[best[:EVIDENCE]].tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(scores), pa.array(evidence, pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double, evidence array<bigint>")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every document; a null id counts as held out."""
    docs = read(spark, sf_dir, "documents")
    index = fit(docs, read(spark, sf_dir, "labels"), F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(False)))
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(True))
    scored = score_toxicity(docs, index)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")
