"""Packing documents into sequences by bin completion over the histogram of piece lengths.

Documents become ids with a public tokenizer, one end id each, and only those longer than a sequence are cut. What
fits together depends on lengths alone, and there are at most as many lengths as a sequence has places. So one job
counts lengths, the driver plans patterns (some lengths that share a sequence, and how often), and a last job deals
ranks within each length to the places of the patterns. Nothing that grows with the documents goes through the driver.

Plan: best fit by descending length is the first incumbent. Unless it meets a lower bound (``least_bins``), a
depth-first search completes bins around the largest open length with undominated fillings, uses a completion as often
as the counts allow, and turns back when the waste so far rules out one sequence less than the incumbent. It ends at
the bound or after SEARCH_NODES steps, to which all of its work is charged; where that leaves the bound unproven, a
warning says so. Dominance is told within PARTED_STEPS; a filling beyond that is kept, which costs time and no quality.

A null text is an empty one: one piece that holds the end id. Repeated rows are packed once each. An empty table gives
an empty result. Whole texts are tokenised, whatever their length; ties between pieces of one length go by id, piece and
checksum. Columns other than doc_id and text are never read.
"""

from __future__ import annotations

import logging
import os
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.llm.common import byte_buffer, materialise, read, row_slices

CAPACITY, END_ID = 2048, 0
SEARCH_NODES = 200_000
#: Distinct words whose ids a task remembers at once; beyond it goes on with those it met again.
REMEMBERED = 800_000
log = logging.getLogger(__name__)
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

# --- ids -----------------------------------------------------------------------------------------------------------


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of texts with a tokenizer whose pre-tokens never span white space, looked up word by word.

    The ids of a text are those of its white-space separated words, as the tokenizer splits at white space and drops
    it. A word is encoded once while it is remembered. Words of plain Latin letters with a run of ASCII marks after them
    are the tokens of the lower-case letters, then those of the run; letters are encoded many at a time, and a word's
    last id is the one that closes a word. Texts in Latin-1 are lower-cased whole, as the tokenizer would.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share out the cores
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.bare = None, Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.plain = re.compile("([a-zß-öø-ÿ]+)([!-&(-/:-@[-`{-~]+)").fullmatch  # a run without apostrophes is one pre-token
        self.odd_space = re.compile("[\x1c-\x1f]").search  # str.split takes these for white space, the tokenizer doesn't
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.closes[i] = token.endswith("</w>")
        self.marks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.again: set[str] = set()

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str], lowered: bool) -> None:
        """lowered: the words are of texts in Latin-1, in lower case."""
        stems = dict.fromkeys(w for w in words if w.isalpha()) if lowered else {}
        marked, other = [], []
        for w in words - stems.keys():
            if lowered and (m := self.plain(w)):
                marked.append((w, m[1], m[2]))
            else:
                other.append(w)
        stems.update((stem, None) for _, stem, _ in marked if stem not in self.words)
        if stems:
            # plain lower-case letters need no normalising and no splitting but at white space
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.bare
            joined = np.array(self.tokenizer.encode_batch_fast([" ".join(stems)], add_special_tokens=False)[0].ids, "<u4").tobytes()
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.whole
            ends = (np.flatnonzero(self.closes[np.frombuffer(joined, "<u4")]) * 4 + 4).tolist()
            if len(ends) != len(stems):
                raise ValueError("the tokenizer doesn't close each word with one token")
            self.words.update(zip(stems, [joined[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        if len(self.marks) > self.remembered:
            self.marks = {}
        for mark in {mark for _, _, mark in marked} - self.marks.keys():
            self.marks[mark] = self._encode(mark)
        known, marks = self.words, self.marks
        self.words.update([(w, known[stem] + marks[mark]) for w, stem, mark in marked])
        for w, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self.words[w] = np.array(e.ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        if len(self.words) > self.remembered:
            kept = self.again if 2 * len(self.again) < self.remembered else ()
            self.words = {w: self.words[w] for w in kept}
            self.again = set()
        lower = [_lowered(t) for t in texts]
        split = [(t if low is None else low).split() for t, low in zip(texts, lower, strict=True)]
        for lowered in (True, False):
            met = set().union(*[ws for ws, low in zip(split, lower, strict=True) if (low is not None) == lowered])
            known = met & self.words.keys()
            self.again |= known
            self._learn(met - known, lowered)
        ids_of = self.words.__getitem__
        return [self._encode(t) if self.odd_space(t) else b"".join(map(ids_of, ws)) for t, ws in zip(texts, split, strict=True)]


def _lowered(text: str) -> str | None:
    """Lower case of a text in Latin-1; None for others and for texts with special tokens, which are told by their case."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if "<|" in text else text.lower()


@cache
def word_ids(path: str, remembered: int = REMEMBERED) -> WordIds:
    return WordIds(path, remembered)


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of each piece of a document's ids."""
    for start in range(0, len(ids) // 4, capacity):
        part = ids[4 * start : 4 * (start + capacity)]
        yield start, len(part) // 4, zlib.crc32(part)


def tokenise(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, remembered: int = REMEMBERED) -> DataFrame:
    """One row a piece of each row of ``docs``: doc_id, piece, start, length and ids_crc32."""
    path = tokenizer or default_tokenizer()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path, remembered)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for i, j in row_slices(byte_buffer(texts)[1], 1 << 20):
                rows, found = [], []
                for k, ids in enumerate(encode(texts.slice(i, j - i).to_pylist()), i):
                    for n, piece in enumerate(cut(ids + end, capacity)):
                        rows.append(k)
                        found.append((n, *piece))
                if rows:
                    columns = zip(*found, strict=True)
                    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES)


# --- plan ----------------------------------------------------------------------------------------------------------

Plan = list[tuple[tuple[int, ...], int]]


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit by descending length; bins that hold the same lengths are handled together."""
    by_room: dict[int, Counter] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r, bins in by_room.items() if r >= length and bins), default=None)
            if room is None:
                each = min(capacity // length, left)
                bins = left // each
                by_room.setdefault(capacity - each * length, Counter())[(length,) * each] += bins
                left -= bins * each
                continue
            held, bins = next(iter(by_room[room].items()))
            used = min(bins, left)
            by_room[room][held] -= used
            if not by_room[room][held]:
                del by_room[room][held]
            by_room.setdefault(room - length, Counter())[(*held, length)] += used
            left -= used
    return [(held, n) for bins in by_room.values() for held, n in bins.items() if n]


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound of the bins: ceil(total / capacity), and the same for lengths that dual feasible functions make of them.

    The k-th function counts a length by the whole number of (k + 1)-th parts of a bin that it fills, each worth a k-th
    of a bin: of what exceeds a (k + 1)-th part, no bin holds more than k. Exact (k + 1)-ths count as they are.
    """
    best = -(-sum(x * n for x, n in counts.items()) // capacity)
    for k in range(1, 101):
        worth = sum(n * (x * k if (k + 1) * x % capacity == 0 else (k + 1) * x // capacity * capacity) for x, n in counts.items())
        best = max(best, -(-worth // (k * capacity)))
    return best


class BinCompletion:
    """Depth-first search for a plan with fewer bins than the incumbent.

    All work is charged to ``nodes``: lengths and copies that are tried, tables that are built, comparisons between
    fillings. A node is some microseconds, so the search ends in time whatever the histogram.
    """

    def __init__(self, counts: dict[int, int], capacity: int, nodes: int = SEARCH_NODES) -> None:
        self.capacity, self.nodes = capacity, nodes
        self.total = sum(length * n for length, n in counts.items())
        self.counts = Counter(counts)
        self.least = least_bins(counts, capacity)

    def _step(self, cost: int = 1) -> bool:
        self.nodes -= cost
        return self.nodes >= 0

    def _exact(self, sizes: list[int], sums: list[int], left: Counter, target: int) -> Iterator[tuple[int, ...]]:
        """Every choice from ``sizes``, as often as there are, that adds up to ``target``; larger lengths and more copies first.

        A level is a length with its copies, so that many short lengths are one level, not hundreds.
        """
        if not target:
            yield ()
            return
        levels: list[tuple[int, int]] = []
        at, rest, copies = 0, target, None  # copies: the most that the next try at ``at`` may take
        while True:
            if copies is None:
                at = max(at, bisect_left(sizes, -rest, key=lambda x: -x))
                if at < len(sizes) and sums[at] >> rest & 1:  # sums[at]: what sizes[at:] can add up to
                    copies = min(left[sizes[at]], rest // sizes[at])
            if copies is not None:
                while copies and not sums[at + 1] >> (rest - copies * sizes[at]) & 1:
                    copies -= 1
                    self.nodes -= 1
                if not self._step():
                    return
                if not copies:
                    at, copies = at + 1, None
                    continue
                levels.append((at, copies))
                rest -= copies * sizes[at]
                if rest:
                    at, copies = at + 1, None
                    continue
                yield tuple(sizes[i] for i, n in levels for _ in range(n))
            if not levels or not self._step():
                return
            at, copies = levels.pop()
            rest += copies * sizes[at]
            copies -= 1

    def _improvable(self, filling: tuple[int, ...], waste: int, rising: list[int], left: Counter) -> bool:
        """Whether a length of the filling, or nothing, could be a longer one that fits into the waste and is there."""
        used = Counter(filling)
        for s in {0, *used}:
            at = bisect_right(rising, s)
            while at < len(rising) and rising[at] <= s + waste:
                self.nodes -= 1
                if left[rising[at]] > used[rising[at]]:
                    return True
                at += 1
        return False

    def fillings(self, room: int, own: int) -> Iterator[tuple[int, ...]]:
        """The undominated fillings of ``room`` beside one bin's largest length ``own``, least waste first.

        One filling dominates another if the other's lengths can be parted over its own: whatever holds it holds the
        other, too, so a bin with the dominating one is never worse. Where that takes long to tell, the filling stays.
        """
        left = self.counts.copy()
        left[own] -= 1
        if left[room] > 0:  # one length that fits exactly dominates all others
            yield (room,)
            return
        sizes = [s for s in self.sizes if s <= room and left[s] > 0]
        self.nodes -= len(sizes) // 2 + len(left) // 16
        sums, mask = [1] * (len(sizes) + 1), (1 << (room + 1)) - 1
        for k in range(len(sizes) - 1, -1, -1):
            sums[k], step, copies = sums[k + 1], sizes[k], left[sizes[k]]
            while step <= room and copies > 0:  # 1, 2, 4, ... copies, which add up to no more than twice as many as there are
                sums[k] |= sums[k] << step & mask
                step, copies = step * 2, copies // 2
        rising = sizes[::-1]
        found: list[tuple[int, ...]] = []
        for waste in range(room + 1):
            if not sums[0] >> (room - waste) & 1:
                continue
            for filling in self._exact(sizes, sums, left, room - waste):
                if waste and self._improvable(filling, waste, rising, left) or self._dominated(filling, found):
                    continue
                found.append(filling)
                yield filling
            if self.nodes <= 0:
                break
        if not found:
            yield ()

    def _dominated(self, filling: tuple[int, ...], found: list[tuple[int, ...]]) -> bool:
        for other in found:
            told, steps = parted(filling, other)
            self.nodes -= 1 + steps
            if told or self.nodes <= 0:
                return told
        return False

    def search(self, incumbent: Plan) -> Plan:
        best, bins = incumbent, sum(n for _, n in incumbent)
        # a level keeps how many completions it has tried, not the enumeration, whose tables would add up over the levels
        stack: list[tuple[int, tuple[int, ...], int, int]] = []
        waste = used = 0
        self.sizes = sorted((s for s, n in self.counts.items() if n > 0), reverse=True)
        choices: Iterator | None = None
        tried = 0
        while bins > self.least and self._step():
            if choices is None:
                if not self.sizes:  # everything is placed, in fewer bins
                    best, bins, choices = [(held, n) for _, held, n, _ in stack], used, iter(())
                else:
                    own = self.sizes[0]
                    choices, tried = self._completions(own), 0
            allowed = (bins - 1) * self.capacity - self.total  # waste of a plan with one bin less
            for held, times in choices:
                tried += 1
                lost = (self.capacity - sum(held)) * times
                if waste + lost <= allowed:
                    break
            else:
                if not stack:
                    break
                tried, held, times, lost = stack.pop()
                self._put(held, times)
                choices = islice(self._completions(held[0]), tried, None)
                waste, used = waste - lost, used - times
                continue
            self._put(held, -times)
            waste, used = waste + lost, used + times
            stack.append((tried, held, times, lost))
            choices = None
        return best

    def _completions(self, own: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """Bins around the largest length with how often each is used: as often as there are lengths, then less often."""
        for filling in self.fillings(self.capacity - own, own):
            held = (own, *filling)
            most = min(self.counts[s] // n for s, n in Counter(held).items())
            times = most
            while times:
                yield held, times
                times //= 2

    def _put(self, held: tuple[int, ...], times: int) -> None:
        self.nodes -= (len(held) + len(self.counts)) // 16
        for s in held:
            self.counts[s] += times
        self.sizes = sorted((s for s, n in self.counts.items() if n > 0), reverse=True)


#: Parting more lengths than this, or in more steps, is not tried.
PARTED_LENGTHS, PARTED_STEPS = 24, 100


def parted(filling: tuple[int, ...], other: tuple[int, ...]) -> tuple[bool, int]:
    """Whether the lengths of ``filling`` can be parted over those of ``other`` without exceeding any, and the steps it took.

    False if that is not so, or not found within the limits.
    """
    if not len(other) <= len(filling) <= PARTED_LENGTHS or sum(filling) > sum(other):
        return False, 0
    order, steps = sorted(filling, reverse=True), 0

    def place(k: int, rooms: tuple[int, ...]) -> bool:
        nonlocal steps
        if k == len(order):
            return True
        for room in sorted(set(rooms)):
            if room >= order[k]:
                steps += 1
                at = rooms.index(room)
                if steps > PARTED_STEPS:
                    return False
                if place(k + 1, (*rooms[:at], room - order[k], *rooms[at + 1 :])):
                    return True
        return False

    return place(0, tuple(other)), steps


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = SEARCH_NODES) -> Plan:
    """The best plan found; a warning is logged if it has more bins than the bound and the search could not end."""
    search = BinCompletion(counts, capacity, nodes)
    plan = search.search(best_fit(counts, capacity))
    bins = sum(n for _, n in plan)
    if bins > search.least and search.nodes <= 0:
        log.warning("packing: %d sequences, the bound is %d, and the search ended after %d steps", bins, search.least, nodes)
    return plan


# --- placing -------------------------------------------------------------------------------------------------------


def places(plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lookups by (length, rank): sorted keys, and for each the first sequence and the offset."""
    rank: Counter = Counter()
    rows, first = [], 0
    for held, times in plan:
        offset = 0
        for length in held:
            rows.append(((length << 48) + rank[length], first - rank[length], offset))
            rank[length] += times
            offset += length
        first += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, nodes: int = SEARCH_NODES, remembered: int = REMEMBERED) -> DataFrame:
    """The pieces of all documents with sequence_id and offset. ``remembered`` words cost a task some 150 bytes each."""
    spark = docs.sparkSession
    pieces = materialise(tokenise(docs, tokenizer, capacity, remembered))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    shared = spark.sparkContext.broadcast(places(plan_patterns(counts, capacity, nodes)))

    # ranks within a length, dealt over salts so that no length is in one task
    salts = max(16, -(-max(counts.values(), default=1) // 100_000))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    per_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    per_salt = per_salt.select("length", "salt", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("own", own).join(per_salt, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, offsets = shared.value
        for batch in batches:
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (batch.column(3).to_numpy(zero_copy_only=False) << 48) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(first[at] + rank), pa.array(offsets[at])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ordered = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ordered.mapInArrow(place, PIECES + ", sequence_id bigint, offset bigint")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    return pack(read(spark, sf_dir, "documents"))
