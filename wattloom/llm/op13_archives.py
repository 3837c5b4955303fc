"""Legacy web archives to WARC: ARC records of both versions become WARC records with ids, dates, types and digests.

An ARC file begins with a version block whose second line names the layout of the header lines that follow: version 1
has URL, IP, date, type and length, version 2 also result code, checksum, location, offset and file name. A record
is such a line and as many bytes as it declares. The converter reads header lines by the version that the file declares and content
by its length, never by looking for the next header, so payloads may hold anything, archives included.

Each record becomes one of WARC 1.1: its id is a name-based UUID of the archive's name and the record's offset, its date
the ARC date, its type response (http), resource (other schemes) or warcinfo (the version block), its digests the
SHA-256 of block and payload. Of records with equal payloads of at least REVISIT_BYTES bytes, the one with the
smallest key is kept whole; the others become revisits that hold their HTTP head and refer to its id.

Files: tasks cut records into archives of about ARCHIVE_BYTES, one written row each, so no file or row is larger than that or than one
record. Archives are compressed by Spark's writer and read by its binary source, through any file system that Spark
reaches. Payloads are shuffled once, by record; the choice between equal payloads is made on digests, whose least keys
are combined before the shuffle, so a page that a third of all records repeat is no large group.

``pages``: a null html is an empty payload and a null or empty url is ``unknown:``; blanks, line ends and control characters in urls are percent-encoded.
Rows that repeat a page_id are records of their own: among equal payloads with the same least key one is the response,
the one whose record id is least, and rows without a page_id come after all others. An empty table gives an empty result (and no archive); columns other than
page_id, url and html are never read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import delete_dir, read, shared_dir

REVISIT_BYTES = 100
ARCHIVE_BYTES = 32 << 20
#: Bytes of payloads that a task hands on at once.
BATCH_BYTES = 8 << 20
#: The date of records that come without one.
DATE = "20000101000000"
#: Record ids are UUIDs of this name space (that of URLs).
NAMESPACE = uuid.NAMESPACE_URL
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY_FIELD = "X-Archive-Key"

_V1 = re.compile(rb"(?P<url>.*) (?P<ip>\S+) (?P<date>\d{8,14}) (?P<type>.*) (?P<length>\d+)")
_V2 = re.compile(rb"(?P<url>.*) (?P<ip>\S+) (?P<date>\d{8,14}) (?P<type>.*) (?P<status>\d{3}|-) (?P<checksum>\S+) (?P<location>\S+) (?P<offset>\d+) (?P<name>\S+) (?P<length>\d+)")
LAYOUTS = {1: _V1, 2: _V2}
FIELDS = {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}


class BadArchive(ValueError):
    """A header line or a declared length that the archive does not keep."""


# --- ARC -------------------------------------------------------------------------------------------------------------


def clean_url(url: str | None) -> bytes:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url).encode() if url else b"unknown:"


def http_response(payload: bytes, key: str, status: int = 200, kind: str = "text/html; charset=utf-8") -> bytes:
    return f"HTTP/1.1 {status} OK\r\nContent-Type: {kind}\r\nContent-Length: {len(payload)}\r\n{KEY_FIELD}: {key}\r\n\r\n".encode() + payload


def arc_file(records: Iterable[tuple[bytes, bytes, bytes]], name: str, version: int, date: str = DATE) -> bytes:
    """An ARC file of (url, date, content) records. All records have a line end after their content, as after the version block."""
    block = b"%d 0 wattloom\n%s\n" % (version, FIELDS[version])
    out = bytearray()

    def add(url: bytes, when: bytes, kind: bytes, status: bytes, content: bytes) -> None:
        line = [url, b"0.0.0.0", when, kind]
        if version == 2:
            line += [status, hashlib.md5(content, usedforsecurity=False).hexdigest().encode(), b"-", b"%d" % len(out), name.encode()]
        out.extend(b" ".join([*line, b"%d" % len(content)]) + b"\n" + content + b"\n")

    add(b"filedesc://" + name.encode(), date.encode(), b"text/plain", b"200", block)
    for url, when, content in records:
        add(url, when, b"text/html", b"200", content)
    return bytes(out)


@dataclass
class ArcRecord:
    archive: str
    offset: int
    url: bytes
    ip: bytes
    date: bytes
    kind: bytes
    content: bytes


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, its version block first."""
    at, name, layout = 0, "", None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # between records
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r")
        if layout is None:
            # the version block's own line has the layout that its content declares
            m = _V2.fullmatch(line) or _V1.fullmatch(line)
            if not m or not line.startswith(b"filedesc://"):
                raise BadArchive("no version block")
        elif not (m := layout.fullmatch(line)):
            raise BadArchive(f"no header line at {at}")
        content = data[end + 1 : end + 1 + int(m["length"])]
        if len(content) != int(m["length"]):
            raise BadArchive(f"the record at {at} is cut off")
        if layout is None:
            version = content.split(b" ", 1)[0]
            if version not in (b"1", b"2"):
                raise BadArchive(f"version {version!r}")
            layout, name = LAYOUTS[int(version)], m["url"].removeprefix(b"filedesc://").decode()
        yield ArcRecord(name, at, m["url"], m["ip"], m["date"], m["type"], content)
        at = end + 1 + len(content)


# --- WARC ------------------------------------------------------------------------------------------------------------


def record_id(archive: str, offset: int) -> str:
    return f"urn:uuid:{uuid.uuid5(NAMESPACE, f'{archive}#{offset}')}"


def warc_date(date: bytes) -> str:
    d = date.decode().ljust(14, "0") if len(date) > 8 else date.decode() + "000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_type(record: ArcRecord) -> str:
    scheme = record.url.split(b":", 1)[0].lower()
    if scheme == b"filedesc":
        return "warcinfo"
    return "response" if record.content.startswith(b"HTTP/") else "resource"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head (with the empty line that ends it) and payload of an HTTP response."""
    end = block.find(b"\r\n\r\n")
    return (block[: end + 4], block[end + 4 :]) if end >= 0 else (block, b"")


def field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode(errors="replace") if m else None


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def warc_record(kind: str, id_: str, date: str, block: bytes, uri: bytes | None = None, payload_digest: str | None = None, refers_to: str | None = None) -> bytes:
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <" + id_.encode() + b">", b"WARC-Date: " + date.encode()]
    if uri is not None:
        lines.append(b"WARC-Target-URI: " + uri)
    if payload_digest is not None:
        lines.append(b"WARC-Payload-Digest: sha256:" + payload_digest.encode())
    if refers_to is not None:
        lines += [b"WARC-Refers-To: <" + refers_to.encode() + b">", b"WARC-Profile: " + PROFILE.encode()]
    content = {"warcinfo": b"application/warc-fields", "resource": b"application/octet-stream"}.get(kind, b"application/http;msgtype=response")
    lines += [b"WARC-Block-Digest: sha256:" + sha256(block).encode(), b"Content-Type: " + content, b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Head and block of each record of a WARC file; blocks are taken by their declared length and held against their digest."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\r", b"\n"):
            at += 1
            continue
        head, _ = split_http(data[at : at + 65_536])
        if not head.startswith(b"WARC/1.") or not head.endswith(b"\r\n\r\n") or (length := field(head, "Content-Length")) is None:
            raise BadArchive(f"no WARC record at {at}")
        start = at + len(head)
        block = data[start : start + int(length)]
        if len(block) != int(length) or field(head, "WARC-Block-Digest") != f"sha256:{sha256(block)}":
            raise BadArchive(f"the block at {at} is not what its head declares")
        yield head, block
        at = start + len(block)


# --- jobs ------------------------------------------------------------------------------------------------------------


def write_archives(archives: DataFrame, path: str, line_end: str) -> None:
    """One compressed file for each row of ``archive`` (binary); ``line_end`` is what ends it and is not in the value."""
    archives.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", line_end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def unpacked(content: bytes) -> bytes:
    """A file's bytes, of all its gzip members if it is compressed."""
    if not content.startswith(b"\x1f\x8b"):
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        for content in batch.column(0):
            yield unpacked(content.as_py())


def _batches(rows: Iterator[tuple], schema: str, payload: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about BATCH_BYTES of the column at ``payload``."""
    fields = [f.split() for f in schema.split(", ")]
    kinds = [{"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[kind] for _, kind in fields]

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], kind) for i, kind in enumerate(kinds)], names=[name for name, _ in fields])

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[payload] or b"") + 200
        if size >= BATCH_BYTES:
            yield batch(held)
            held, size = [], 0
    yield batch(held)


def _one(archive: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([archive], pa.large_binary()).cast(pa.binary())], names=["archive"])


def pages_to_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """ARC files of a table of pages, of both versions in turn."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for k, u, h in zip(*(batch.column(i) for i in range(3)), strict=True):
                payload = (h.as_py() or "").encode()
                held.append((clean_url(u.as_py()), DATE.encode(), http_response(payload, "" if k.as_py() is None else str(k.as_py()))))
                size += len(held[-1][2]) + 200
                if size >= archive_bytes:
                    yield _one(arc_file(held, f"part-{part:06d}-{n:06d}.arc", 1 + (part + n) % 2)[:-1])
                    n, held, size = n + 1, [], 0
        if held:
            yield _one(arc_file(held, f"part-{part:06d}-{n:06d}.arc", 1 + (part + n) % 2)[:-1])

    write_archives(pages.select(key, url, html).mapInArrow(pack, "archive binary"), path, "\n")


RECORDS = "record_id string, type string, key string, uri binary, date string, head binary, payload binary, payload_digest string, payload_bytes long"


def arc_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the ARC files below ``path`` as WARC ones, version blocks left out: RECORDS.

    ``key`` is the field KEY_FIELD of the HTTP head, null where there is none.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for data in _contents(batches):
            for r in read_arc(data):
                if (kind := warc_type(r)) == "warcinfo":
                    continue
                head, payload = split_http(r.content) if kind == "response" else (b"", r.content)
                yield record_id(r.archive, r.offset), kind, field(head, KEY_FIELD) or None, r.url, warc_date(r.date), head, payload, sha256(payload), len(payload)

    return read_archives(spark, path).mapInArrow(lambda batches: _batches(rows(batches), RECORDS, 6), RECORDS)


def revisits_of(records: DataFrame, order: Column, least: int = REVISIT_BYTES) -> DataFrame:
    """record_id and refers_to of the responses whose payload another one has that comes first in ``order``, then by id."""
    place = F.struct(order.isNull().alias("last"), order.alias("key"), F.col("record_id"))
    keys = records.where((F.col("type") == "response") & (F.col("payload_bytes") >= least)).select("payload_digest", "payload_bytes", place.alias("place"))
    first = keys.groupBy("payload_digest", "payload_bytes").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = keys.join(first, ["payload_digest", "payload_bytes"]).where("place.record_id <> first.record_id")
    return again.select(F.col("place.record_id").alias("record_id"), F.col("first.record_id").alias("refers_to"))


def records_to_warc(records: DataFrame, revisits: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """WARC files of ``records``; those in ``revisits`` keep their HTTP head only."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def archive() -> pa.RecordBatch:
            name = f"part-{part:06d}-{n:06d}.warc"
            info = warc_record("warcinfo", record_id(name, 0), warc_date(DATE.encode()), f"software: wattloom\r\nformat: WARC File Format 1.1\r\nfilename: {name}\r\n".encode())
            return _one((info + b"".join(held))[:-2])

        for batch in batches:
            for r in batch.to_pylist():
                kind = "revisit" if r["refers_to"] else r["type"]
                block = r["head"] if r["refers_to"] else r["head"] + r["payload"]
                held.append(warc_record(kind, r["record_id"], r["date"], block, r["uri"], r["payload_digest"], r["refers_to"]))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield archive()
                    n, held, size = n + 1, [], 0
        if held:
            yield archive()

    chosen = records.join(revisits, "record_id", "left").drop("key", "payload_bytes")
    write_archives(chosen.mapInArrow(pack, "archive binary"), path, "\r\n")


WARC = "record_id string, type string, key string, uri string, date string, payload_digest string, payload_bytes long, refers_to_id string, payload binary"


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files below ``path`` but for warcinfo: WARC. A revisit's payload is null and its length the declared one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for data in _contents(batches):
            for head, block in read_warc(data):
                if (kind := field(head, "WARC-Type")) == "warcinfo":
                    continue
                http, payload = split_http(block) if kind != "resource" else (b"", block)
                digest = (field(head, "WARC-Payload-Digest") or "").removeprefix("sha256:")
                if kind != "revisit" and digest != sha256(payload):
                    raise BadArchive("a payload is not what its digest declares")
                length = int(field(http, "Content-Length") or 0) if kind == "revisit" else len(payload)
                id_, refers_to = ((field(head, x) or "").strip("<>") or None for x in ("WARC-Record-ID", "WARC-Refers-To"))
                yield id_, kind, field(http, KEY_FIELD) or None, field(head, "WARC-Target-URI"), field(head, "WARC-Date"), digest, length, refers_to, None if kind == "revisit" else payload

    return read_archives(spark, path).mapInArrow(lambda batches: _batches(rows(batches), WARC, 8), WARC)


def convert(spark: SparkSession, arc: str, warc: str, order: Column | None = None) -> None:
    """The ARC files below ``arc`` as WARC files below ``warc``; equal payloads go to the least of ``order`` (the record id by default)."""
    records = arc_records(spark, arc)
    records_to_warc(records, revisits_of(records, F.lit(0) if order is None else order), warc)


def op13_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, as its WARC record says; the archives stay in the shared folder."""
    pages = read(spark, sf_dir, "pages")
    arc, warc = f"{shared_dir(spark)}/arc", f"{shared_dir(spark)}/warc"
    pages_to_arc(pages, arc)
    convert(spark, arc, warc, F.col("key").cast("long"))
    delete_dir(spark, arc)
    found = warc_records(spark, warc).drop("payload", "uri", "date")
    # a response is looked up as itself, so no key stands for all of them
    kept = found.where("type = 'response'").select(F.col("record_id").alias("first"), F.col("key").cast("long").alias("refers_to"))
    rows = found.withColumn("first", F.coalesce("refers_to_id", "record_id")).join(kept, "first", "left")
    refers_to = F.when(F.col("type") == "revisit", F.col("refers_to"))
    return rows.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), refers_to.alias("refers_to"))
