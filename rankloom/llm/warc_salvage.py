"""WARC archives: records written from pages, and a reader that salvages what follows damage and logs the bytes it skipped."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import staged

# Fixed values of the format (ISO 28500).
VERSION, GZIP, CRLF = b"WARC/1.1", b"\x1f\x8b\x08", b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A gzip member that holds nothing.
EMPTY_MEMBER = gzip.compress(b"", 6, mtime=0)
_START = re.compile(rb"WARC/1\.[01]\r\n")
RECORD_SCHEMA = "path string, offset long, kind string, length long, record_type string, record_id string, refers_to string, uri string, payload_digest string, payload_bytes long, payload binary, reason string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(record_id: str, uri: str, payload: bytes, refers_to: str | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record up to its block; the two CRLFs that end it are not included. A revisit has an empty block."""
    head = [VERSION.decode(), f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {quote(uri, safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    block = payload if refers_to is None else b""
    head += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + CRLF + CRLF + block


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


@dataclass
class _Log:
    out: list = field(default_factory=list)

    def gap(self, start: int, end: int, reason: str) -> None:
        if end > start:
            last = self.out[-1] if self.out else None
            if isinstance(last, Gap) and last.offset + last.length == start:
                last.length += end - start
            else:
                self.out.append(Gap(start, end - start, reason))


def _plain(data: bytes, at: int) -> tuple[Record, int] | str:
    """The record at this version line and where the next one may start, or what is wrong with it."""
    head_end = data.find(CRLF + CRLF, at)
    if head_end < 0:
        return "no end of headers"
    lines = data[at:head_end].split(CRLF)
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "a header without a colon"
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit():
        return "no content length"
    start = head_end + 4
    end = start + int(headers["content-length"])
    if end + 4 > len(data):
        return "the block is cut short"
    if data[end : end + 4] != CRLF + CRLF:
        return "no end of record"
    block = data[start:end]
    want = headers.get("warc-block-digest")
    if want and want != f"sha1:{base32_sha1(block)}":
        return "the block's digest differs"
    return Record(at, end + 4 - at, headers, block), end + 4


def _read_plain(data: bytes, log: _Log, base: int = 0) -> None:
    at = 0
    while at < len(data):
        if _START.match(data, at):
            got = _plain(data, at)
            if not isinstance(got, str):
                got[0].offset += base
                log.out.append(got[0])
                at = got[1]
                continue
            reason, skip = got, at + 1
        else:
            reason, skip = "no version line", at
        m = _START.search(data, skip)
        nxt = m.start() if m else len(data)
        log.gap(base + at, base + nxt, reason)
        at = nxt


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at this offset holds, where it ends, and what is wrong (then the bytes before the damage)."""
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof and pos < len(data):
            piece = data[pos : pos + (1 << 16)]
            out.append(z.decompress(piece))
            pos += len(piece)
    except zlib.error as e:
        return b"".join(out), -1, str(e)
    return (b"".join(out), pos - len(z.unused_data), "") if z.eof else (b"".join(out), -1, "the member is cut short")


def read_archive(data: bytes) -> list[Record | Gap]:
    """All records that can be had, and the gaps between, in order of offset.

    Plain and gzipped archives, also mixed; a gzip member may hold one record or many, whose offset is their member's. After a
    failed check the search goes on at the next version line or the next gzip member that inflates; what it passes is a Gap.
    Whole records that inflate before a member's damage are kept.
    """
    log, at = _Log(), 0
    while at < len(data):
        if data.startswith(GZIP, at):
            body, end, wrong = _inflate(data, at)
            if not wrong:
                inner = _Log()
                _read_plain(body, inner)
                for x in inner.out:
                    if isinstance(x, Record):
                        x.offset, x.length = at, end - at
                        log.out.append(x)
                    else:
                        log.out.append(Gap(at, end - at, f"in a member, {x.length} bytes at {x.offset}: {x.reason}"))
                at = end
                continue
            inner = _Log()
            _read_plain(body, inner)
            for x in inner.out:
                if isinstance(x, Record):
                    x.offset = at
                    log.out.append(x)
            nxt = _next(data, at + 1)
            log.gap(at, nxt, wrong)
            at = nxt
        elif _START.match(data, at):
            got = _plain(data, at)
            if isinstance(got, str):
                nxt = _next(data, at + 1)
                log.gap(at, nxt, got)
                at = nxt
            else:
                log.out.append(got[0])
                at = got[1]
        else:
            nxt = _next(data, at)
            log.gap(at, nxt, "neither a version line nor a gzip member")
            at = nxt
    return log.out


def _next(data: bytes, at: int) -> int:
    """The next offset at which a version line stands or a gzip member begins that inflates at least at first."""
    line = _START.search(data, at)
    stop = line.start() if line else len(data)
    g = data.find(GZIP, at)
    while 0 <= g < stop:
        try:
            if zlib.decompressobj(31).decompress(data[g : g + 4096]):
                return g
        except zlib.error:
            pass
        g = data.find(GZIP, g + 1)
    return stop


def records(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """(page_id, record binary): a WARC record per row of pages (page_id, url, html).

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of at least revisit_bytes bytes the one with
    the smallest page_id (ties: smallest url; of wholly equal rows one) is a response; the others revisit it. Null page_ids come
    last; null urls are empty. Extra columns are ignored; empty input gives no rows. Which row is the response depends on the data
    alone, so a lost task that is run again chooses as before.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("sha", F.sha1("html"))
    rows = staged(p.where(F.octet_length("html") >= revisit_bytes).groupBy("sha", "page_id", "url").agg(F.count("*").alias("n")), "payloads")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    first = rows.groupBy("sha").agg(F.min(order).alias("first"), F.sum("n").alias("n")).where("n > 1").select("sha", "first")
    j = p.join(first, "sha", "left")
    head = F.col("first.page_id").eqNullSafe(F.col("page_id")) & (F.col("first.url") == F.col("url"))
    if rows.where("n > 1").limit(1).count():  # rows repeated as a whole: one of the equal rows is the response
        j = j.withColumn("nth", F.row_number().over(W.partitionBy("sha", "page_id", "url").orderBy(F.lit(1))))
        head = head & (F.col("nth") == 1)
    refers = F.when(F.col("first").isNotNull() & ~head, F.struct(F.col("first.page_id").alias("id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for i, u, h, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                made.append(encode_record("" if i is None else str(i), u, h.encode(), None if r is None else "" if r["id"] is None else str(r["id"])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["page_id", "record"])

    return j.select("page_id", "url", "html", refers.alias("r")).mapInArrow(run, "page_id long, record binary")


def records_per_file(pages: DataFrame, file_bytes: int = 64 << 20) -> int:
    """How many records of pages (html) fill file_bytes, by the mean size of their payloads and 600 bytes of headers."""
    return max(1, int(file_bytes / (600 + (pages.agg(F.avg(F.octet_length(F.col("html").cast("string")))).first()[0] or 0))))


def write_archives(recs: DataFrame, path: str, per_file: int = 4000, compression: str = "gzip") -> None:
    """Archives of records (record binary) in a folder, by Spark's own writer, so any file system that Spark reaches will do.

    Each line of a text file is one record. gzip: a record and the two CRLFs after it are a gzip member of their own, so damage
    costs the records it hits and no other, and the line's end is an empty member. none: plain archives, the line's end is the two
    CRLFs. Part files are valid archives of at most per_file records (see records_per_file), as a reader holds a file in memory.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(r + CRLF + CRLF, 6, mtime=0) for r in b.column(0).to_pylist()], pa.binary())], names=["record"])

    lines, end = (recs.select("record"), CRLF + CRLF) if compression == "none" else (recs.select("record").mapInArrow(packed, "record binary"), EMPTY_MEMBER)
    out = lines.select(F.col("record").cast("string").alias("value")).write.mode("overwrite").option("encoding", "ISO-8859-1").option("lineSep", end.decode("latin-1"))
    out.option("maxRecordsPerFile", per_file).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records (kind 'record') and quarantined gaps (kind 'gap', with reason) of all files in a folder, whole payloads included.

    payload_digest (bare) and payload_bytes are those of the full payload; for revisits they come from the headers. An empty or
    damaged file never fails the job. One task holds one file at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([pa.field(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (c.split() for c in RECORD_SCHEMA.split(", "))])
        ident = lambda s: None if s is None else re.sub(r"^<urn:page:(.*)>$", r"\1", s)
        for b in batches:
            for path_, data in zip(b.column(0), b.column(1), strict=True):
                rows, held = [], 0
                for x in read_archive(data.as_py() or b""):
                    row = dict.fromkeys(kinds.names) | {"path": path_.as_py(), "offset": x.offset, "length": x.length}
                    if isinstance(x, Gap):
                        row |= {"kind": "gap", "reason": x.reason}
                    else:
                        h = x.headers
                        full = h.get("warc-type") != "revisit"
                        row |= {"kind": "record", "record_type": h.get("warc-type"), "record_id": ident(h.get("warc-record-id")), "refers_to": ident(h.get("warc-refers-to")), "uri": h.get("warc-target-uri"), "payload": x.block}
                        row |= {"payload_digest": base32_sha1(x.block) if full else h.get("warc-payload-digest", "").removeprefix("sha1:"), "payload_bytes": len(x.block) if full else int(h.get("x-payload-length") or 0)}
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, RECORD_SCHEMA)
