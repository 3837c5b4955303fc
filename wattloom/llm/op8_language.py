"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of a bounded sample of labelled text is built. A text is cut greedily into the longest
phrases that the automaton of a language holds; log2(sample length) bits point at each phrase, and a phrase's next
letter starts the following one. The language that needs the fewest bits a letter wins.

The automata become one transition table over letter classes, and blocks of BLOCK bytes of a slice of texts step through
it side by side, each as if a phrase began with it. Then the phrase that truly crosses into a block is followed until
some phrase begins where one of the block's own begins; from there both go on alike. Blocks that never meet the true
phrases (long runs of one pattern) are read one after the other. So a text is parsed whole, and its phrases are those of
one pass from its first letter to its last.

Sample: of each language, about SAMPLE_DOCS training rows by least hash of id and text. The whole of their texts is cut
into sentences and lines (PASSAGE characters at most); repeated ones are removed, and those of least hash are taken up to
LANGUAGE_CHARS (less with very many languages, MODEL_CHARS in all), so any place of a text is as likely as its opening.
These bounds do not grow with the table; the sample alone goes through the driver, and the table stays within some GB/4.

Results: ``und`` with score 0 for null texts, texts without a letter, and where no language can be learned. Ties go to
the language that sorts first. Rows do not depend on each other, so repeated rows agree; an empty table gives an empty
result; columns that the operator does not name are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wattloom.llm.common import byte_buffer, crc_mod, read, slices_of

SAMPLE_DOCS, PASSAGE, LANGUAGE_CHARS, MODEL_CHARS = 192, 400, 40_000, 800_000
BLOCK = 512
UNKNOWN = "und"


def training_sample(docs: DataFrame, may_learn: Column) -> list[tuple[str, str]]:
    """(language, text) of the bounded sample, each language joined to one string, by language."""
    known = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string"), "text").alias("h"))
    share = {r["lang"]: min(1.0, SAMPLE_DOCS / r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return []
    # a share of each language by hash first, so that only the sample is sorted
    edge = F.create_map(*[F.lit(x) for lang, s in sorted(share.items()) for x in (lang, min(int((2 * s - 1) * 2**63), 2**63 - 1))])
    few = known.where(F.col("h") <= edge[F.col("lang")])
    passage = F.explode(F.regexp_extract_all("text", F.lit(rf"[^.!?\n]{{1,{PASSAGE}}}[.!?]*"), F.lit(0)))
    passages = few.select("lang", passage.alias("text")).select("lang", F.trim("text").alias("text")).where("text != ''").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit("passage"), "text"), "text")  # passages of a bounded number of rows
    taken = passages.withColumn("n", F.row_number().over(order)).withColumn("end", F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    listed = F.array_sort(F.collect_list(F.struct("n", "text")))
    joined = taken.where(F.col("end") <= min(LANGUAGE_CHARS, MODEL_CHARS // len(share))).groupBy("lang").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("text"))
    found = {r["lang"]: r["text"] for r in joined.collect()}
    rows = [{"lang": lang, "text": found.get(lang, "")} for lang in share]  # a language may have blank texts only
    return sorted((r["lang"], r["text"]) for r in rows)


def suffix_automaton(letters: np.ndarray, n_classes: int) -> np.ndarray:
    """Transitions (state, class) of the suffix automaton of a sequence of classes; -1 where there is none."""
    size = 2 * len(letters) + 2
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in letters.tolist():
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    assert len(moves) <= size
    table = np.full((len(moves), n_classes), -1, np.int32)
    for s, row in enumerate(moves):
        for c, t in row.items():
            table[s, c] = t
    return table


class Model:
    """One table for all languages. Entries hold the next row's place times two, plus one where a phrase begins."""

    def __init__(self, sample: list[tuple[str, str]]) -> None:
        self.languages = [lang for lang, _ in sample]
        texts = [letters_of(*byte_buffer(pa.array([text])))[0] for _, text in sample]
        used = np.unique(np.concatenate([np.array([32], np.uint8), *texts]))
        self.classes = np.zeros(256, np.uint8)  # class 0: bytes that no sample has
        self.classes[used] = np.arange(1, len(used) + 1)
        k = self.k = len(used) + 1
        tables, self.starts, self.bits, base = [], [], [], 0
        for text in texts:
            own = self.classes[text]
            table = suffix_automaton(own, k)
            # a missing letter begins the next phrase; one that the language lacks is a phrase of its own, after which
            # any letter begins one: that is the last row
            alone = len(table)
            begin = np.where(table[0] >= 0, table[0], alone)
            full = np.where(table >= 0, (table + base) * k * 2, (begin + base)[None, :] * k * 2 + 1)
            full[0] = (begin + base) * k * 2  # the first phrase of a block is counted at its start
            full = np.vstack([full, (begin + base)[None, :] * k * 2 + 1])
            tables.append(full.astype(np.int64 if base * k > 1 << 29 else np.int32))
            self.starts.append(base * k)
            self.bits.append(float(np.log2(len(own) + 1)))
            base += len(full)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(1, np.int32)

    def phrases(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases per row and language."""
        raw, bounds = letters_of(raw, bounds)
        sizes = np.diff(bounds)
        blocks = -(-sizes // BLOCK)
        row = np.repeat(np.arange(len(sizes)), blocks)
        first = bounds[:-1][row] + BLOCK * (np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        long = np.minimum(BLOCK, bounds[1:][row] - first)
        order = np.argsort(-long, kind="stable")
        row, first, long = row[order], first[order], long[order]
        letters = self.classes[raw]
        out = np.zeros((len(sizes), len(self.languages)))
        live = np.searchsorted(-long, -np.arange(BLOCK), side="left")  # blocks longer than the step
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        late = np.flatnonzero(np.diff(np.sort(row), prepend=-1) == 0)  # not the first of their text, in reading order
        here, before = place[late], place[late - 1]
        steps = int(long[0]) if len(long) else 0
        for lang, start in enumerate(self.starts):
            state = np.full(len(row), start, self.table.dtype)
            count = np.zeros(len(row), np.int64)
            begins = np.zeros((steps, len(row)), np.uint8)
            for step in range(steps):
                n = live[step]
                entry = self.table[state[:n] + letters[first[:n] + step]]
                begins[step, :n] = entry & 1 if step else 1
                count[:n] += begins[step, :n]
                state[:n] = entry >> 1
            if len(late):
                self._follow(letters, first, long, begins, count, state, here, before)
            out[:, lang] = np.bincount(row, weights=count, minlength=len(sizes))
        return out

    def _follow(self, letters: np.ndarray, first: np.ndarray, long: np.ndarray, begins: np.ndarray, count: np.ndarray, state: np.ndarray, here: np.ndarray, before: np.ndarray) -> None:
        """Put right the counts of the blocks ``here`` (in reading order), into which a phrase of ``before`` may go on."""
        open_, at = np.arange(len(here)), state[before]
        true, own = np.zeros(len(here), np.int64), np.zeros(len(here), np.int64)  # phrases so far, followed and its own
        met = np.zeros(len(here), bool)
        for step in range(len(begins)):
            open_ = open_[long[here[open_]] > step]
            if not len(open_):
                break
            block = here[open_]
            entry = self.table[at[open_] + letters[first[block] + step]]
            at[open_] = entry >> 1
            true[open_] += entry & 1
            own[open_] += begins[step, block]
            same = (entry & 1 & begins[step, block]).astype(bool)
            met[open_[same]] = True
            open_ = open_[~same]
        met |= at == state[here]  # the same phrase at the end of the block
        whole = true.copy()
        whole[met] += (count[here] - own)[met]
        at[met] = state[here][met]
        # behind a block that was not met, the phrase that goes on is another than was followed
        table, reached = None, -1
        for k in np.flatnonzero(~met).tolist():
            if k <= reached:
                continue
            while k + 1 < len(here) and before[k + 1] == here[k] and at[k] != state[here[k]]:
                k += 1
                table = table if table is not None else memoryview(self.table)
                block, n, s, left = here[k], 0, int(at[k - 1]), int(count[here[k]])
                span = letters[first[block] : first[block] + long[block]].tobytes()
                for letter, mark in zip(span, begins[:, block].tobytes(), strict=False):
                    entry = table[s + letter]
                    s, left = entry >> 1, left - mark
                    n += entry & 1
                    if entry & mark & 1:
                        n, s = n + left, int(state[block])
                        break
                whole[k], at[k] = n, s
            reached = k
        count[here] = whole

    def predict(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its score: the softmax of minus the bits, softened by SOFT."""
        bits = self.phrases(raw, bounds) * np.array(self.bits)
        best = bits.argmin(axis=1)
        gap = np.minimum((bits - bits.min(axis=1, keepdims=True)) * SOFT, 700)
        return best, 1 / np.exp(-gap).sum(axis=1)


#: Bits saved are not independent evidence; this much of them counts.
SOFT = 0.1

_LOWER = np.full(256, 32, np.uint8)
_LOWER[97:123] = _LOWER[65:91] = np.arange(97, 123)
_LOWER[128:] = np.arange(128, 256)


def letters_of(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with one space for each run of other ASCII; the rows' new offsets.

    A-Z and the two-byte Latin capitals (C3 80-9E) are lowered; punctuation, digits and markup say nothing of a language.
    """
    out = _LOWER[raw]
    wide = np.zeros(len(raw), bool)
    wide[1:] = raw[:-1] == 0xC3
    wide &= (raw >= 0x80) & (raw <= 0x9E)
    out[wide] += 0x20
    keep = out != 32
    before = np.zeros(len(raw), bool)
    before[:-1] = keep[1:]
    before[bounds[1:][bounds[1:] > 0] - 1] = False
    keep |= before  # the last space of each run, if a letter of the same row follows
    total = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], total[bounds]


def identify(docs: DataFrame, sample: list[tuple[str, str]], text: str = "text", names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with the language and its score added under two names, which ``docs`` may not have."""
    if clash := {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has columns {sorted(clash)}; choose other names")
    pred, score_name = names
    place = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(Model(sample))  # some 10 MB a language, as LANGUAGE_CHARS bounds it

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        languages = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            column = batch.column(place)
            has_letter = np.array(pa.compute.match_substring_regex(pa.compute.fill_null(column, ""), r"\pL"), dtype=bool)
            best, score = np.full(len(column), len(languages) - 1), np.zeros(len(column))
            if model.languages:
                for i, j, raw, bounds in slices_of(column):
                    best[i:j], score[i:j] = model.predict(raw, bounds)
            best[~has_letter], score[~has_letter] = len(languages) - 1, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages[best], pa.string()), pa.array(score)], names=[*batch.schema.names, pred, score_name])

    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score_name, T.DoubleType())])
    return docs.mapInArrow(predict, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; a null id counts as held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(True))
    out = identify(docs.select("doc_id", "text"), training_sample(docs, ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
