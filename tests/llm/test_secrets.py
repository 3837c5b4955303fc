"""The combined automaton against regular expressions."""

import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wattloom.llm.op5_secrets import RULES, combined, find_secrets, op5_secret_scan, redact, scanner

SF = "/root/testdata/sf0.01"
VALUE = rb"[A-Za-z0-9+/_.=-]+"
PATTERNS = {
    "assign": (re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(""" + VALUE + rb")", re.I), 12),
    "access": (re.compile(rb"AKIA[A-Z0-9]+"), 18),
    "hex": (re.compile(rb"[0-9a-f]+"), 16),
    "pem": (re.compile(rb"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"), 1),
    "jwt": (re.compile(rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), 40),
    "forge": (re.compile(rb"gh[pousr]_[A-Za-z0-9]+"), 24),
    "chat": (re.compile(rb"xox[abprs]-[A-Za-z0-9-]+"), 20),
}


def brute(data: bytes):
    out = []
    for k, (kind, (pattern, least)) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(data):
            if len(m.group(2) if kind == "assign" else m.group()) >= least:
                out.append((m.start(), k, kind, len(data[: m.start()].decode()), len(data[: m.end()].decode())))
    return [(kind, s, e) for _, _, kind, s, e in sorted(out)]


PIECES = ["password", "TOKEN", "Secret", "api_key", "apikey", "PASSWD", ":", "=", " ", '"', "'", "abcdef0123456789", "AKIA", "ABCD1234EFGH", "0a", "xyz-_.", "é", "日", "\n", "deadbeef", "eyJ", "aGVsbG8td29ybGQ", ".", "ghp_", "a1B2c3D4e5F6", "xoxb-", "-----BEGIN ", "RSA ", "PRIVATE KEY-----"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_spans_are_those_of_the_patterns(pieces):
    data = "".join(pieces).encode()
    assert scanner(combined()).secrets(data) == brute(data)


@pytest.mark.parametrize("text", ["token=secret:" + "x" * 1_000_000, "token=secret:" * 80_000, "xoxb-AKIA" * 100_000, "eyJa." * 200_000])
def test_long_runs_take_linear_time(text):
    start = time.monotonic()
    found = scanner(combined()).secrets(text.encode())
    assert time.monotonic() - start < 10  # quadratic work would take hours
    assert found == brute(text.encode())


def test_automaton_is_minimal_and_total():
    moves, masks = combined()
    assert moves.shape == (len(masks), 256) and moves.max() < len(masks)
    rows = {(mask, row.tobytes()) for mask, row in zip(masks, moves, strict=True)}
    assert len(rows) == len(masks)


def test_query_over_whole_texts(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op5_secret_scan(spark, SF).collect():
        spans = brute(texts[r["doc_id"]].encode())
        base = [s for s in spans if s[0] in ("assign", "access", "hex")]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_odd_rows(spark, odd_documents):
    got = find_secrets(odd_documents, keep=["doc_id", "score"]).collect()
    assert len(got) == odd_documents.count()
    assert {r["doc_id"]: [(s["kind"], s["start"], s["stop"]) for s in r["secrets"]] for r in got if r["secrets"]} == {10: [("assign", 0, 24), ("access", 28, 46)]}
    clean = redact(odd_documents)
    assert clean.columns == odd_documents.columns
    assert clean.where("doc_id = 10").first()["text"] == '[assign]" é [access]' and clean.where("text is null").count() == 1
    assert find_secrets(odd_documents.limit(0)).count() == 0
    assert len(RULES) == len(PATTERNS)
