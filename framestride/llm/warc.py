"""Operator 7, WARC: writing with revisits and segments, reading with reassembly.

Writing: a record for each page. Of equal payloads the one with the largest
page_id is a ``response``, the others are ``revisit`` records that refer to it.
HTTP bodies are sent in chunks; a block longer than ``SEGMENT_BYTES`` is split into
a first segment and ``continuation`` records that name their origin and number,
the last one the total length. Records are gzip members of their own.

Reading: every file is parsed record by record; segments are grouped by the
origin's identifier (never more rows than one record has), put in the order of
their numbers, checked for gaps and for the total length, and the HTTP body is
taken out of its chunks. Files get a new name for each attempt and are listed in
what the task returns.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framestride.llm.common import Scratch, pick, table
from framestride.llm.rans import storage

#: Payloads below so many bytes are always written in full.
REVISIT_BYTES = 0
#: The longest block in one record.
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
#: A file that has reached so many bytes is closed and another one begun; a record is never split over files.
FILE_BYTES = 1 << 30
#: Bytes read from a file at once.
READ_BYTES = 1 << 16
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"


class Damaged(ValueError):
    """A record whose parts don't fit together."""


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP/1.1 chunked framing."""
    parts = [b"%x\r\n%s\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes:
    """The body of chunked framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = data.find(CRLF, at)
        if end < 0:
            raise Damaged("a chunk without its size line")
        try:
            n = int(data[at:end].split(b";")[0], 16)
        except ValueError:
            raise Damaged("a chunk size that is no number") from None
        if n == 0:
            return b"".join(out)
        if data[end + 2 + n : end + 4 + n] != CRLF:
            raise Damaged("a chunk of another length than its size")
        out.append(data[end + 2 : end + 2 + n])
        at = end + 4 + n


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + CRLF + CRLF) + z.flush()


def page_records(page_id: int | None, key: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> Iterator[bytes]:
    """All records of one page.

    Every record has an identifier of its own. A revisit, whose response another
    task writes, names it by its target and date, as WARC 1.1 allows.
    """
    ident = f"<urn:page:{'' if page_id is None else page_id}#{key}>"
    common = [("WARC-Date", DATE), ("WARC-Target-URI", f"urn:page:{'' if page_id is None else page_id}")]
    http = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", ident), *common, *http,
                      ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", f"urn:page:{refers_to}"), ("WARC-Refers-To-Date", DATE)], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= SEGMENT_BYTES:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", ident), *common, *http], block)
        return
    cuts = range(0, len(block), SEGMENT_BYTES)
    for n, at in enumerate(cuts, 1):
        part = block[at : at + SEGMENT_BYTES]
        if n == 1:
            yield record([("WARC-Type", "response"), ("WARC-Record-ID", ident), *common, *http, ("WARC-Segment-Number", "1")], part)
        else:
            last = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(cuts) else []
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{ident[:-1]}.{n}>"), *common, ("WARC-Segment-Origin-ID", ident), ("WARC-Segment-Number", str(n)), *last], part)


def parse_members(stream: io.IOBase | pa.NativeFile) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of a file of gzip members, read bit by bit."""
    data = b""
    while data := data or stream.read(READ_BYTES):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            data = data or stream.read(READ_BYTES)
            if not data:
                raise Damaged("a gzip member without its end")
            parts.append(z.decompress(data))
            data = z.unused_data
        got = b"".join(parts)
        head, found, rest = got.partition(CRLF + CRLF)
        lines = head.split(CRLF)
        if not found or not lines[0].startswith(b"WARC/"):
            raise Damaged("a record without its headers")
        names = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
        n = int(names["content-length"])
        if len(rest) < n:
            raise Damaged("a block shorter than its length")
        yield names, rest[:n]


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP headers and decoded body of a response."""
    head, found, body = block.partition(CRLF + CRLF)
    if not found:
        raise Damaged("an HTTP message without the end of its headers")
    names = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
    return names, unchunked(body) if "chunked" in names.get("transfer-encoding", "").lower() else body


def assemble(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The whole block of segments ``number, total length or None, bytes`` in the order of their numbers."""
    parts = sorted(parts, key=lambda p: p[0])
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)):
        raise Damaged("segments are missing or there twice")
    block = b"".join(p[2] for p in parts)
    if parts[-1][1] is None or parts[-1][1] != len(block):
        raise Damaged("the total length doesn't fit the segments")
    return block


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, payload, digest (hex), low`` and ``refers``: the largest page_id with this payload.

    One row for each payload is joined back; a payload with a third of all rows
    is a skewed side that the adaptive join splits.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload")).withColumn("digest", F.sha1("payload"))
    largest = rows.groupBy("digest").agg(F.max("page_id").alias("refers")).withColumnRenamed("digest", "d")
    return rows.join(largest, F.col("digest") == F.col("d")).drop("d")


def write_archives(rows: DataFrame, where: str, least: int = REVISIT_BYTES, upto: int = FILE_BYTES) -> DataFrame:
    """Write ``page_id, payload, refers`` to files of some ``upto`` bytes, one at least for each partition; rows: ``file, records``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, n, out = uuid.uuid4().hex[:12], 0, None
        written: list[tuple[str, int]] = []
        for b in batches:
            for page_id, payload, refers in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if out is None:
                    name, first = f"{where}/pages-{tag}-{len(written)}.warc.gz", n
                    fs, inner = storage(name)
                    fs.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(inner, compression=None, buffer_size=1 << 20)
                data = payload.encode()
                revisit = len(data) >= least and refers is not None and page_id != refers
                for x in page_records(page_id, f"{tag}-{n}", data, digest_of(data), refers, revisit):
                    out.write(x)
                n += 1
                if out.tell() >= upto:
                    out.close()
                    out = None
                    written.append((name, n - first))
        if out is not None:
            out.close()
            written.append((name, n - first))
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in written], pa.string()), pa.array([k for _, k in written], pa.int64())], ["file", "records"])

    return rows.select("page_id", "payload", "refers").mapInArrow(run, "file string, records long")


RECORD = "uri string, kind string, refers string, digest string, http_length long, origin string, number int, total long, block binary, fault string"


def members(fs: pafs.FileSystem, inner: str) -> Iterator[tuple[dict[str, str], bytes]]:
    with fs.open_input_stream(inner, compression=None) as f:
        yield from parse_members(f)


def read_records(files: DataFrame) -> DataFrame:
    """All records of the listed files. ``origin`` and ``number`` are set for segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, inner = storage(name)
                rows: list[tuple] = []
                held = 0
                for h, block in members(fs, inner):
                    segment = h["warc-type"] == "continuation" or "warc-segment-number" in h
                    rows.append((
                        h.get("warc-target-uri"), h["warc-type"], h.get("warc-refers-to-target-uri"), h.get("warc-payload-digest"), None, (h.get("warc-segment-origin-id") or h["warc-record-id"]) if segment else None,
                        int(h["warc-segment-number"]) if segment else None, int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, block, None))
                    held += len(block)
                    if held > 1 << 23:
                        yield batch(names, rows)
                        rows, held = [], 0
                if rows:
                    yield batch(names, rows)

    return files.select("file").mapInArrow(run, RECORD)


KINDS = {"uri": pa.string(), "kind": pa.string(), "refers": pa.string(), "digest": pa.string(), "http_length": pa.int64(), "origin": pa.string(), "number": pa.int32(), "total": pa.int64(), "block": pa.binary(), "fault": pa.string()}


def batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], KINDS[n]) for i, n in enumerate(names)], names)


def reassembled(records: DataFrame) -> DataFrame:
    """``uri, kind, refers, payload_bytes, payload_digest, payload, fault`` of every whole record.

    Records whose segments are missing, doubled or of another total length, and
    bodies with broken framing, have a ``fault`` and no payload.
    """
    single = records.filter("origin IS NULL").select("uri", "kind", "refers", "digest", F.array(F.struct(F.lit(1).alias("number"), F.octet_length("block").cast("long").alias("total"), "block")).alias("parts"))
    split = records.filter("origin IS NOT NULL").groupBy("origin").agg(
        F.max(F.when(F.col("number") == 1, F.col("uri"))).alias("uri"), F.coalesce(F.max(F.when(F.col("number") == 1, F.col("kind"))), F.lit("continuation")).alias("kind"),
        F.max("refers").alias("refers"), F.max("digest").alias("digest"), F.collect_list(F.struct("number", "total", "block")).alias("parts")).drop("origin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for uri, kind, refers, digest, parts in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                payload, length, fault = None, None, None
                try:
                    names, body = http_payload(assemble([(p["number"], p["total"], p["block"]) for p in parts]))
                    if kind == "revisit":
                        length, digest = int(names["content-length"]), (digest or "").removeprefix("sha1:")
                    else:
                        payload, length = body, len(body)
                        found = digest_of(body)
                        if digest and digest != f"sha1:{found}":
                            raise Damaged("the payload doesn't match its digest")
                        digest = found
                except Damaged as e:
                    payload, length, fault, digest = None, None, str(e), None
                out.append((uri, kind, refers, length, digest, payload, fault))
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["uri", "kind", "refers", "payload_bytes", "payload_digest", "payload", "fault"])

    return single.unionAll(split.select(*single.columns)).mapInArrow(run, "uri string, kind string, refers string, payload_bytes long, payload_digest string, payload binary, fault string")


def page_number(uri: Column) -> Column:
    return F.nullif(F.regexp_extract(uri, "urn:page:(-?[0-9]*)", 1), F.lit("")).cast("long")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages, read the archives back and tell every page's record.

    Null html is an empty payload, and empty payloads are equal ones; rows that
    share the largest page_id are all responses; a null page_id revisits any
    other and is a response where there is none; very long html is written in
    segments; an empty table gives none; further columns don't matter.
    """
    pages = pick(table(spark, sf_dir, "pages"), "page_id", "html")
    scratch = Scratch(spark, "op7")
    files = scratch.save(write_archives(with_revisits(pages), scratch.path("warc")))
    n = max(1, files.count())
    back = reassembled(read_records(files.repartition(n)))
    return back.select(
        page_number(F.col("uri")).alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), page_number(F.col("refers")).alias("refers_to"), "fault")


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t) AS n, sha1(t) AS h, max(page_id) OVER (PARTITION BY sha1(t)) AS m FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (j // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (j % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM m OR m IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM m THEN NULL ELSE m END AS refers_to, NULL::VARCHAR AS fault
FROM d
"""
