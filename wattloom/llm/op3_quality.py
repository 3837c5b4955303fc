"""Quality scores by a sparse rule ensemble.

Statistics of each text are computed once, over its whole length. A small forest on a bounded sample of labelled rows
gives tree paths; each path of one condition or more is a rule, a conjunction of comparisons. A lasso logistic
regression over the rules keeps a few of them. Rules and weights become one Spark column expression that scores every row.

SAMPLE labelled rows, those of least hash, bound what is fitted on. Nulls count as empty texts, which have a score like
any other text; texts of any length are measured whole. Scores depend on the text alone, so ties and repeated rows are
scored alike; other columns are never read, whatever their names. If no row is labelled, or all are alike, the score is that label's share (0.5 without labels). Labels
without a document are ignored; repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import crc_mod, materialise, read, slices_of, word_hashes, word_spans

SAMPLE, TREES, DEPTH, LASSO = 20_000, 16, 3, 0.002
STATISTICS = (
    "n_bytes", "n_words", "word_bytes", "letters", "capitals", "digits", "marks", "symbols", "lines", "short_words",
    "distinct_words", "top_word", "doubled_words", "symbol_words",
)

_UPPER, _LETTER, _DIGIT, _MARK, _SYMBOL = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT[48:58] = True
_MARK[[ord(c) for c in ".,;:!?'\"()-"]] = True
_SYMBOL[33:127] = True
_SYMBOL &= ~(_LETTER | _DIGIT | _MARK)


def statistics(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(rows, STATISTICS): sizes, and shares of bytes or words."""

    def per_row(mask: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[edges]).astype(float)

    n = np.diff(bounds).astype(float)
    starts, stops, first = word_spans(raw, bounds)
    words = np.diff(first)
    row = np.repeat(np.arange(len(n)), words)
    hashes, sizes = word_hashes(raw, starts, stops), stops - starts
    order = np.lexsort((hashes, row))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(order)))
    top = np.zeros(len(n))
    np.maximum.at(top, row[at], runs)
    doubled = np.zeros(len(row), bool)
    doubled[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])
    letters = per_row(_LETTER[raw], bounds)
    b, w = np.maximum(n, 1), np.maximum(words, 1)
    return np.column_stack([
        n, words, per_row(~np.isin(raw, [9, 10, 11, 12, 13, 32]), bounds) / w, letters / b, per_row(_UPPER[raw], bounds) / np.maximum(letters, 1),
        per_row(_DIGIT[raw], bounds) / b, per_row(_MARK[raw], bounds) / b, per_row(_SYMBOL[raw], bounds) / b, per_row(raw == 10, bounds) / w,
        per_row(sizes <= 3, first) / w, np.bincount(row[at], minlength=len(n)) / w, top / w, per_row(doubled, first) / w,
        per_row(symbols[stops] > symbols[starts], first) / w,
    ])


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, bounds in slices_of(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *map(pa.array, statistics(raw, bounds).T)], names=["doc_id", *STATISTICS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, at most or more than, threshold)."""

    conditions: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, value in self.conditions:
            out = out & (F.col(name) <= value if sign == "<=" else F.col(name) > value)
        return out.cast("double")


@dataclass(frozen=True)
class Ensemble:
    base: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        total = F.lit(self.base)
        for rule, weight in self.rules:
            total = total + rule.column() * weight
        return 1 / (1 + F.exp(-total))


_LINE = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\deE]+)\)", re.M)


def tree_rules(forest_text: str) -> list[Rule]:
    """Every path prefix of a printed forest as a rule, without repeats; of opposite pairs only one stays."""
    rules, path = {}, []
    for indent, feature, sign, value in _LINE.findall(forest_text):
        depth = len(indent)
        path = [p for p in path if p[0] < depth] + [(depth, (STATISTICS[int(feature)], sign, float(value)))]
        conditions = tuple(c for _, c in path)
        opposite = (*conditions[:-1], (conditions[-1][0], "<=" if sign == ">" else ">", conditions[-1][2]))
        if len(conditions) > 1 or opposite not in rules:
            rules[conditions] = Rule(conditions)
    return list(rules.values())


def fit(labelled: DataFrame, seed: int = 7) -> Ensemble:
    """labelled: the statistics and ``label`` (0 or 1), a bounded sample."""
    share = labelled.agg(F.avg("label")).first()[0]
    if share is None or share in (0.0, 1.0):
        edge = 0.5 if share is None else min(max(share, 1e-3), 1 - 1e-3)
        return Ensemble(float(np.log(edge / (1 - edge))), ())
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="x").transform(labelled)
    forest = RandomForestClassifier(featuresCol="x", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="sqrt", seed=seed).fit(vectors)
    rules = tree_rules(forest.toDebugString)
    applied = labelled.select("label", *[r.column().alias(f"r{k}") for k, r in enumerate(rules)])
    applied = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="x").transform(applied).select("label", "x")
    lasso = LogisticRegression(featuresCol="x", elasticNetParam=1.0, regParam=LASSO, maxIter=60).fit(applied)
    weights = lasso.coefficients.toArray()
    return Ensemble(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; a null id counts as held out."""
    measured = materialise(with_statistics(read(spark, sf_dir, "documents")))
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(True))
    known = read(spark, sf_dir, "labels").where(~held_out & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string")), "doc_id").limit(SAMPLE)
    # the sample is bounded, so one task holds it and every fit sees it in the same order
    labelled = materialise(measured.join(F.broadcast(chosen), "doc_id").coalesce(1).sortWithinPartitions("doc_id", *STATISTICS))
    ensemble = fit(labelled.select(*STATISTICS, F.col("label").cast("double").alias("label")))
    score = measured.select("doc_id", held_out.alias("held_out"), ensemble.score().alias("score"))
    return score.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
