"""Phrase collocations against brute force, in both ways of naming."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from wattloom.llm import op12_phrases as op

SCHEMA = "doc_id long, text string, lang string, n long, id long, phrase string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(docs, least, longest=5, subsumed=100):
    n, f = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    inside = {}
    for (lang, words), a in candidates.items():
        for k in range(1, len(words)):
            for i in range(len(words) - k + 1):
                key = (lang, words[i : i + k])
                if k < len(words):
                    inside[key] = max(inside.get(key, 0), a)
    out = []
    for (lang, words), a in candidates.items():
        if 100 * inside.get((lang, words), 0) >= subsumed * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score))
    return sorted(out)


def found(spark, docs, **options):
    df = spark.createDataFrame([(i, t, g, 1, 2, "x") for i, (t, g) in enumerate(docs)], SCHEMA)
    return sorted(map(tuple, op.collocations(df, **options).collect()))


def some_docs(seed=1, n=60):
    rng = random.Random(seed)
    words = "the Of and to river old mill fox É straße x y".split()
    fixed = ["the Old mill", "of the river", "x x x x x x", "fox and the old mill of"]
    docs = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(12)]
        docs.append(("".join(p + rng.choice([" ", ". ", "\n", "\t", "? ", " -- "]) for p in parts), rng.choice(["en", "de", None])))
    return docs + [(None, "en"), ("", "en"), (" \n\t..", "fr"), ("one", "es")]


@pytest.mark.parametrize("limits", [{}, {"max_words": 0, "max_pairs": 0}], ids=["broadcast", "joined"])
def test_equals_brute_force(spark, limits):
    docs = some_docs()
    expected = brute_force(docs, 5)
    assert len(expected) > 50
    assert found(spark, docs, least=5, **limits) == expected


def test_share_and_length_are_parameters(spark):
    docs = some_docs(seed=2)
    assert found(spark, docs, least=4, longest=3, subsumed=60) == brute_force(docs, 4, 3, 60)


def test_runs_and_buckets_of_few_places(spark, monkeypatch):
    docs = some_docs(seed=3)
    monkeypatch.setattr(op, "BUCKET", 50)
    assert found(spark, docs, least=5) == brute_force(docs, 5)
    ids = np.array([0, 1, 0, 1, -1, 1, 0, 1, 0, 0], np.int32)
    batches = [op.pa.RecordBatch.from_arrays([op.pa.array([1]), op.pa.array([ids.tobytes()])], names=["chunk", "ids"])]
    whole = op.summed_pairs(op.pa.Table.from_batches(op.runs_of_pairs(iter(batches), 1)), 1).to_pylist()
    monkeypatch.setattr(op, "RUN", 3)
    cut = op.summed_pairs(op.pa.Table.from_batches(op.runs_of_pairs(iter(batches), 1)), 1).to_pylist()
    assert whole == cut == [{"left": 0, "right": 0, "f": 1}, {"left": 0, "right": 1, "f": 3}, {"left": 1, "right": 0, "f": 3}]


def test_long_text_and_repeated_rows(spark):
    long = "a b c " * 300_000
    docs = [(long, "en"), (long, "en"), ("a b", "en"), ("a b", "en")]
    rows = found(spark, docs, least=100)
    assert {r[1] for r in rows} == {"a b", "a b c", "a b c a b", "b c a b c", "c a b c a"} and {r[5] for r in rows} == {1_800_004}
    assert next(r for r in rows if r[1] == "b c a b c")[2] == 2 * 299_999


def test_products_beyond_64_bits(spark):
    totals = spark.createDataFrame([("en", 10**13)], "lang string, n long")
    row = spark.createDataFrame([("en", "a b", 3 * 10**12, [4 * 10**12], [5 * 10**12])], "lang string, phrase string, a long, before array<long>, after array<long>")
    out = row.join(totals, "lang").withColumn("cut", op._cut(2)(op.F.lit(1))).first()["cut"]
    assert out["score"] == 1000 * 3 * 10**12 * 10**13 // (4 * 10**12 * 5 * 10**12)


def test_empty_and_odd_tables(spark, odd_documents):
    assert found(spark, []) == []
    assert found(spark, [("a b", "en")]) == []
    docs = [(r["text"], r["lang"]) for r in odd_documents.collect()]
    assert sorted(map(tuple, op.collocations(odd_documents, least=2).collect())) == brute_force(docs, 2)


def test_words_of_pieces():
    raw, bounds = np.frombuffer("Ab c.dE\tF\vg hÉ".encode(), np.uint8), np.array([0, 4, 15])
    words, begins = op.words_of(raw, bounds)
    assert words.to_pylist() == ["ab", "c", "de", "f", "g", "hÉ"]
    assert begins.tolist() == [True, False, True, False, True, False]


def test_rows_of_numbers_are_small(spark):
    text = " ".join(f"w{i % 50}" for i in range(200_000)) + "."
    docs = spark.createDataFrame([("en", text[k : k + 20_000]) for k in range(0, len(text), 20_000)] * 2, "lang string, text string").coalesce(1)
    sizes = docs.mapInArrow(lambda batches: op.sequences(batches, {"en": {f"w{i}": i for i in range(50)}}), op.SEQUENCE).selectExpr("length(ids) as n")
    assert max(r["n"] for r in sizes.collect()) < 1 << 19
