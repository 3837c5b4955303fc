"""Cross-parsing against a plain parser, and held-out accuracy."""

import random

import numpy as np
import pyarrow as pa

from wattloom.llm import op8_language as op
from wattloom.llm.common import byte_buffer

SF = "/root/testdata/sf0.01"
SAMPLE = [("aa", "the cat sat on the mat and the dog " * 3), ("bb", "der hund und die katze sitzen auf dem dach " * 3), ("cc", "")]


def fold(text):
    raw, bounds = op.letters_of(*byte_buffer(pa.array([text])))
    return bytes(raw)


def plain_phrases(block, train):
    """Greedy longest matches by substring search; a letter that the sample lacks is a phrase."""
    count = i = 0
    while i < len(block):
        j = i + 1
        while block[i:j] in train and j < len(block) and block[i : j + 1] in train:
            j += 1
        count, i = count + 1, j
    return count


def test_suffix_automaton_has_exactly_the_substrings():
    rng = random.Random(5)
    for _ in range(30):
        text = [rng.randrange(3) for _ in range(rng.randint(1, 40))]
        table = op.suffix_automaton(np.array(text), 3)
        assert len(table) <= 2 * len(text)
        have = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
        for _ in range(60):
            word, state = [rng.randrange(3) for _ in range(rng.randint(1, 6))], 0
            for c in word:
                state = table[state, c] if state >= 0 else -1
            assert (state >= 0) == (tuple(word) in have)


def test_phrases_are_greedy_longest_matches():
    model = op.Model(SAMPLE[:2])
    rng = random.Random(2)
    train = [fold(t) for _, t in SAMPLE[:2]]
    shared = sorted(set(train[0]) & set(train[1]))
    texts = ["".join(chr(rng.choice(shared)) for _ in range(rng.randint(1, 1300))) for _ in range(40)] + [SAMPLE[0][1], SAMPLE[1][1]]
    # phrases cross blocks; runs of one pattern keep out of step with a block's own phrases for long
    texts += ["at" * 3000, "the cat sat on " * 300, "e" * 5000, "h" * 700 + "the mat and the dog " * 90 + "e" * 1111, SAMPLE[0][1] * 40, SAMPLE[1][1] * 33]
    raw, bounds = byte_buffer(pa.array(texts))
    got = model.phrases(raw, bounds)
    for text, own in zip(texts, got, strict=True):
        text = fold(text)
        for lang in (0, 1):
            assert own[lang] == plain_phrases(text, train[lang])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = op.op8_language_id(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(spark, odd_documents):
    told = op.identify(odd_documents, SAMPLE[:2])
    got = {r["doc_id"]: r["lang_pred"] for r in told.collect() if r["doc_id"] is not None}
    assert told.columns == [*odd_documents.columns, "lang_pred", "lang_score"] and told.count() == odd_documents.count()
    assert [got[i] for i in (3, 4, 5, 8)] == ["und"] * 4 and got[1] == "aa"
    none = op.identify(odd_documents, [])
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert op.training_sample(odd_documents.limit(0), op.F.lit(True)) == []
    sample = dict(op.training_sample(odd_documents, op.F.col("doc_id") > 0))
    assert sorted(sample) == ["de", "en", "fr"] and len(sample["en"]) <= op.LANGUAGE_CHARS


def test_sample_goes_beyond_shared_openings(spark):
    """All documents of a language open with the same long passage; their own prose is in the sample all the same."""
    opening = " ".join(f"clause{i} of the licence" for i in range(120)) + ". "
    rows = [(i, opening + f"Prose number{i} stands far behind. " * 3 + f"End number{i}.", "en") for i in range(20)]
    (sample,) = op.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), op.F.lit(True))
    assert all(f"Prose number{i} stands" in sample[1] and f"End number{i}." in sample[1] for i in range(20))
    assert sample[1].count("clause7 of") == 1 and len(sample[1]) <= op.LANGUAGE_CHARS


def test_rows_do_not_depend_on_each_other():
    model = op.Model(SAMPLE[:2])
    texts = ["the cat", "dem dach", "x" * 2000, "", "und die katze und the mat"]
    whole = model.phrases(*byte_buffer(pa.array(texts)))
    for i, t in enumerate(texts):
        assert (model.phrases(*byte_buffer(pa.array([t])))[0] == whole[i]).all()
