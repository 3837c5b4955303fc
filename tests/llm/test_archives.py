"""ARC to WARC: exact round trips, the rows of the query against brute force, and archives that break their declarations."""

import gzip
import hashlib
import os
import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from wattloom.llm import op13_archives as op
from wattloom.llm.common import shared_dir

NASTY = [b"", b"\n\n1 2 3\n", b"filedesc://x 0.0.0.0 20000101000000 text/plain 5\nhello\n", b"\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", b"\xff\x00\xfe" * 50, "é".encode() * 60]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [(b"http://a/%d" % i, b"20010203040506", op.http_response(p, str(i))) for i, p in enumerate(NASTY)] + [(b"dns:a", b"20010203", b"a 1 IN A 1.2.3.4")]
    info, *read = op.read_arc(op.arc_file(records, "x.arc", version))
    assert info.content.startswith(b"%d 0 " % version) and op.FIELDS[version] in info.content
    assert [(r.url, r.date, r.content) for r in read] == records
    assert [op.warc_type(r) for r in [info, *read]] == ["warcinfo", *["response"] * len(NASTY), "resource"]
    assert len({op.record_id(r.archive, r.offset) for r in read}) == len(records)


def test_header_lines_of_both_versions():
    one = b"http://a/x y 1.2.3.4 19970101000000 text/html; charset=utf-8 5"
    two = b"http://a/ 1.2.3.4 19970101000000 text/html; charset=x 404 abc - 17 f.arc 5"
    assert op._V1.fullmatch(one)["url"] == b"http://a/x y" and op._V1.fullmatch(one)["type"] == b"text/html; charset=utf-8"
    assert op._V2.fullmatch(two)["status"] == b"404" and op._V2.fullmatch(two)["length"] == b"5" and op._V2.fullmatch(two)["offset"] == b"17"


@pytest.mark.parametrize("data", [b"http://a 1.1.1.1 20000101000000 text/html 1\nx\n", op.arc_file([(b"http://a", b"20000101000000", b"abc")], "x", 1)[:-3], op.arc_file([], "x", 2) + b"no header\n", op.arc_file([], "x", 1).replace(b"1 0 ", b"3 0 ")])
def test_bad_arc_files_are_errors(data):
    with pytest.raises(op.BadArchive):
        list(op.read_arc(data))


def test_warc_round_trip_and_fields():
    date = op.warc_date(b"20010203040506")
    assert date == "2001-02-03T04:05:06Z" and op.warc_date(b"20010203") == "2001-02-03T00:00:00Z"
    whole = [op.warc_record("response", f"urn:uuid:{uuid.uuid4()}", date, op.http_response(p, "7"), b"http://a", op.sha256(p)) for p in NASTY]
    read = list(op.read_warc(b"".join(whole)))
    assert [op.split_http(block)[1] for _, block in read] == NASTY
    assert op.field(read[0][0], "warc-type") == "response" and op.field(read[0][0], "WARC-Target-URI") == "http://a"
    again = op.warc_record("revisit", "urn:uuid:b", date, b"HTTP/1.1 200 OK\r\n\r\n", b"http://a", op.sha256(b"x"), "urn:uuid:a")
    ((head, _),) = op.read_warc(again)
    assert op.field(head, "WARC-Refers-To") == "<urn:uuid:a>" and op.field(head, "WARC-Profile") == op.PROFILE
    with pytest.raises(op.BadArchive):
        list(op.read_warc(whole[1].replace(b"1 2 3", b"1 2 4")))
    with pytest.raises(op.BadArchive):
        list(op.read_warc(whole[1][:-10]))


def test_unpacked_reads_every_member():
    assert op.unpacked(gzip.compress(b"ab") + gzip.compress(b"cd")) == b"abcd" and op.unpacked(b"plain") == b"plain" and zlib


def brute_force(rows):
    out = []
    for id_, _, html in rows:
        payload = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == payload]
        first = min((x for x in same if x is not None), default=None)
        revisit = len(payload) >= 100 and id_ != first
        out.append((id_, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def written(spark, rows, monkeypatch=None):
    path = f"{shared_dir(spark)}/tables".removeprefix("file://")
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id long, url string, html string, record_id string, key string, payload_bytes int")
    df.repartition(3).write.parquet(f"{path}/pages.parquet")
    return sorted(map(tuple, op.op13_archives(spark, path).collect()), key=repr)


LONG = "<p>" + "häufig " * 40


def some_pages():
    rows = [(i, f"http://a/{i} b\n", f"<html>{i % 7}" + "x" * (90 + i % 20)) for i in range(60)]
    rows += [(100 + i, "http://hot", LONG) for i in range(50)]  # one payload that many share
    rows += [(200, None, None), (201, "", ""), (202, "http://c", None), (203, "http://w", "WARC/1.1\r\nContent-Length: 1\r\n\r\nx" * 9), (204, "http://zé\x01", "\n" * 120), (205, "http://big", "word " * 200_000)]
    return [*rows, (206, "http://nl", "x" * 100), (207, "http://nl", "x" * 100), (208, "http://nl", "x" * 99), (209, "http://nl", "x" * 99)]


def test_query_equals_brute_force(spark):
    rows = some_pages()
    assert written(spark, rows) == brute_force(rows)


def test_small_archives_give_the_same(spark, monkeypatch):
    rows = some_pages()
    arc, warc, again = (f"{shared_dir(spark)}/{x}" for x in ("arc", "warc", "again"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    op.pages_to_arc(df, arc, archive_bytes=2_000)
    assert len([f for f in os.listdir(arc.removeprefix("file://")) if f.startswith("part-")]) > 10
    records = op.arc_records(spark, arc)
    op.records_to_warc(records, op.revisits_of(records, F.col("key").cast("long")), warc, archive_bytes=5_000)
    found = {r["key"]: r for r in op.warc_records(spark, warc).collect()}
    for id_, size, digest, kind, first in brute_force(rows):
        r = found[str(id_)]
        assert (r["payload_bytes"], r["payload_digest"], r["type"]) == (size, digest, kind)
        assert r["refers_to_id"] == (found[str(first)]["record_id"] if first is not None else None)
        assert kind == "revisit" or r["payload"] == (dict((x, h) for x, _, h in rows)[id_] or "").encode()
    op.convert(spark, arc, again)  # without an order the least record id stays
    assert op.warc_records(spark, again).where("type = 'revisit'").count() == sum(r[3] == "revisit" for r in brute_force(rows))


def test_repeated_and_null_ids(spark):
    rows = [(5, "http://a", LONG), (5, "http://a", LONG), (None, "http://a", LONG), (None, "http://b", "z" * 150), (None, "http://b", "z" * 150)]
    out = written(spark, rows)
    assert sorted(map(repr, out)) == sorted(map(repr, [
        (5, len(LONG.encode()), op.sha256(LONG.encode()), "response", None), (5, len(LONG.encode()), op.sha256(LONG.encode()), "revisit", 5), (None, len(LONG.encode()), op.sha256(LONG.encode()), "revisit", 5),
        (None, 150, op.sha256(b"z" * 150), "response", None), (None, 150, op.sha256(b"z" * 150), "revisit", None),
    ]))


def test_empty_table(spark):
    assert written(spark, []) == []
