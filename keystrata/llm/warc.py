"""WARC from legacy ARC archives.

`to_arc` packs pages into ARC segments (version 1 and version 2 header lines),
`arc_to_warc` parses the version line, the header lines and the declared lengths
and writes the equivalent WARC records with record ids, dates, types and digests,
and `read_warc` parses WARC segments back. A segment is a bounded byte string of
whole records; segments are the rows of a table (column `archive`), so any store
that Spark writes can hold them.

Of records with equal payloads the one with the largest page_id is a response
and the others are revisits of it; payloads under `min_revisit` bytes are always
responses. The choice is made on (page_id, digest) rows alone.

Edge cases: null html is an empty payload; a null url is written as
urn:missing; spaces and control characters in a url are percent-encoded; a null
page_id is a response only if no other record has its payload; rows repeated
with the largest page_id are all responses; an empty table gives no segments.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table

#: A segment is closed once it holds this many bytes.
SEGMENT_BYTES = 1 << 20
#: ARC dates of pages that carry none: 14 digits.
ARC_DATE = "20000101000000"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Fixed values of the two ARC versions: the field names after the version line.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: str) -> str:
    """The same key always gets the same record id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'record:' + key)}>"


def _url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:missing"


def arc_version_block(version: int, name: str) -> bytes:
    """The version record that an ARC file begins with."""
    body = f"{version} 0 archive\n{FIELDS[version]}\n".encode()
    middle = "" if version == 1 else "200 - - 0 " + name + " "
    return f"filedesc://{name} 0.0.0.0 {ARC_DATE} text/plain {middle}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, name: str, offset: int, url: str | None, content: bytes, date: str = ARC_DATE) -> bytes:
    middle = "" if version == 1 else f"200 {hashlib.md5(content).hexdigest()} - {offset} {name} "
    return f"{_url(url)} 0.0.0.0 {date} text/html {middle}{len(content)}\n".encode() + content + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records after the version block: url, date, type and content by the declared length.

    The field names in the version block say how a header line is read, so both
    versions, and any other order of fields, are parsed by one rule.
    """
    end = data.index(b"\n")
    length = int(data[:end].rsplit(b" ", 1)[1])
    version, names = data[end + 1 : end + 1 + length].decode().split("\n")[:2]
    fields, at = names.split(), end + 1 + length
    if int(version.split()[0]) not in FIELDS:
        raise ValueError(f"unknown ARC version {version!r}")
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        values = data[at:end].decode().rstrip("\r").split(" ")
        if len(values) != len(fields):
            raise ValueError(f"an ARC header line has {len(values)} fields, not {len(fields)}")
        head = dict(zip(fields, values, strict=True))
        start = end + 1
        at = start + int(head["Archive-length"])
        if at > len(data):
            raise ValueError("an ARC record is shorter than its declared length")
        yield {"url": head["URL"], "date": head["Archive-date"], "mime": head["Content-type"], "content": data[start:at]}


def _headers(pairs) -> bytes:
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs).encode() + b"\r\n"


def warc_record(page_id: int | None, arc: dict, refers_to: int | None) -> bytes:
    """The WARC record equivalent to one ARC record, or a revisit record that refers to another page's."""
    http, payload = arc["content"].split(b"\r\n\r\n", 1)
    http += b"\r\n\r\n"
    block = http if refers_to is not None else http + payload
    d = arc["date"]
    digest = sha1_base32(payload)
    pairs = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(f"{page_id}:{digest}")),
        ("WARC-Target-URI", arc["url"]),
        ("WARC-Date", f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("X-Payload-Length", len(payload)),
    ]
    if page_id is not None:
        pairs.append(("X-Page-ID", page_id))
    if refers_to is not None:
        pairs += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(f"{refers_to}:{digest}")), ("X-Refers-To-Page", refers_to)]
    pairs += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return _headers(pairs) + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record; digests are checked."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        start = end + 4
        at = start + int(head["content-length"])
        block = data[start:at]
        if head.get("warc-block-digest") not in (None, f"sha1:{sha1_base32(block)}"):
            raise ValueError(f"block digest of {head.get('warc-record-id')} does not match")
        at += 4
        yield head, block


SEGMENTS = "archive binary, page_ids array<long>, refers_to array<long>"
_SEGMENT = pa.schema([("archive", pa.binary()), ("page_ids", pa.list_(pa.int64())), ("refers_to", pa.list_(pa.int64()))])
_WARC = pa.schema([("archive", pa.binary()), ("n_records", pa.int64())])


def _pack_arc(batches):
    made = 0
    held: list[bytes] = []
    ids, refers, size = [], [], 0

    def segment():
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary()), pa.array([ids], _SEGMENT[1].type), pa.array([refers], _SEGMENT[2].type)], schema=_SEGMENT)

    for b in batches:
        for page, url, html, to in zip(*(b.column(i) for i in range(4)), strict=True):
            version = 1 + made % 2
            name = f"segment-{made}.arc"
            if not held:
                held, ids, refers = [arc_version_block(version, name)], [], []
                size = len(held[0])
            held.append(arc_record(version, name, size, url.as_py(), HTTP + (html.as_py() or "").encode()))
            ids.append(page.as_py())
            refers.append(to.as_py())
            size += len(held[-1])
            if size >= SEGMENT_BYTES:
                yield segment()
                made, held = made + 1, []
    if held:
        yield segment()


def _convert(batches):
    for b in batches:
        for data, ids, refers in zip(*(b.column(i) for i in range(3)), strict=True):
            records = list(zip(parse_arc(data.as_py()), ids.as_py(), refers.as_py(), strict=True))
            out = b"".join(warc_record(page, arc, to) for arc, page, to in records)
            yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary()), pa.array([len(records)], pa.int64())], schema=_WARC)


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, payload binary"
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("warc_date", pa.string()), ("payload", pa.binary())])


def _read(payloads: bool):
    def run(batches):
        for b in batches:
            for data in b.column(0):
                rows = []
                for head, block in parse_warc(data.as_py()):
                    payload = block.split(b"\r\n\r\n", 1)[1]
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response" and (digest != sha1_base32(payload) or len(payload) != int(head["x-payload-length"])):
                        raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
                    number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                    rows.append((number("x-page-id"), head["warc-target-uri"], number("x-payload-length"), digest, head["warc-type"], number("x-refers-to-page"), head["warc-record-id"], head["warc-date"], payload if payloads else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _RECORD, strict=True)], schema=_RECORD)

    return run


def to_arc(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """ARC segments of pages (page_id, url, html), each with its records' page ids and what they revisit."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    digests = rows.where(F.octet_length(payload) >= min_revisit).select("page_id", F.sha1(payload.cast("binary")).alias("digest"))
    same = digests.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    revisits = digests.join(same.select("digest", "refers_to"), "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).dropDuplicates(["page_id", "digest"])
    r = revisits.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to")
    decided = rows.withColumn("digest", F.sha1(payload.cast("binary"))).join(r, (F.col("digest") == F.col("r_digest")) & F.col("page_id").eqNullSafe(F.col("r_id")), "left")
    small_batches(pages.sparkSession)
    return decided.select("page_id", "url", "html", "refers_to").mapInArrow(_pack_arc, SEGMENTS)


def arc_to_warc(segments: DataFrame) -> DataFrame:
    return segments.select("archive", "page_ids", "refers_to").mapInArrow(_convert, "archive binary, n_records long")


def read_warc(segments: DataFrame, payloads: bool = True) -> DataFrame:
    """One row for each record; with payloads, the bytes too (a revisit's are empty)."""
    return segments.select("archive").mapInArrow(_read(payloads), RECORDS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = cut(arc_to_warc(to_arc(table(spark, sf_dir, "pages"))), "warc")
    return read_warc(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {
    "op9_warc": """
WITH p AS (
  SELECT page_id, sha1(encode(COALESCE(html, ''))) AS h, octet_length(encode(COALESCE(html, ''))) AS n FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS keep FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM m
"""
}
