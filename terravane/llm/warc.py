"""Legacy archives: ARC written, converted to WARC, and WARC read.

The converter parses ARC records of version 1 or 2 by their header lines and declared lengths, and
synthesises the WARC records that a crawler would have written: identifiers, timestamps, types and digests.
Of records with equal payloads, the one with the largest id becomes a response and the others revisits that
refer to it. Archives are gzip-compressed text files in the shared folder, written by Spark's text sink
(a record and its closing line breaks per row) with RECORDS records each at most, so their size is bounded however
much a task writes. A file is read as one row and inflated piece by piece; a task holds its compressed bytes and one
record at a time, and gives records on in batches of about BATCH bytes.

Edge cases: a null payload counts as empty, and empty payloads equal each other; a null url is written as
"urn:none:", white space in one percent-encoded; a null id is never a response where another record has the
same payload; rows that repeat the largest id are all responses; payloads may hold line breaks, header
lines or record separators, as lengths decide; an empty table gives empty archives; further columns are
ignored; a damaged archive raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch

#: Fields of an ARC header line, by version.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Identifiers are derived from this namespace and the record's id.
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Rows of an archive, bytes inflated at once, and bytes of a batch of records.
RECORDS, PIECE, BATCH = 4000, 1 << 20, 16 << 20
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
_unsafe = re.compile("[\\x00-\\x20\\x7f\\x85\\xa0\\u2028\\u2029]")


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    kind: str
    content: bytes


def base32_sha1(b: bytes) -> str:
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def version_block(version: int, name: str, date: str) -> str:
    """The record that opens an ARC file."""
    body = f"{version} 0 terravane\n{FIELDS[version]}\n"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{' 200 - - 0 ' + name if version == 2 else ''} {len(body)}\n{body}"


def arc_record(version: int, url: str, date: str, content: str, name: str) -> str:
    raw = content.encode("utf-8", "surrogatepass")
    more = f" 200 {base32_sha1(raw)} - 0 {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} text/html{more} {len(raw)}\n{content}"


class Inflated:
    """The bytes of a file, compressed by gzip (in one member or many) or not, inflated as they are asked for."""

    def __init__(self, b: bytes) -> None:
        self.pieces = self._pieces(memoryview(b))
        self.held, self.at = b"", 0

    @staticmethod
    def _pieces(b: memoryview) -> Iterator[bytes]:
        if bytes(b[:2]) != b"\x1f\x8b":
            yield from (bytes(b[k : k + PIECE]) for k in range(0, len(b), PIECE))
            return
        while len(b):
            z = zlib.decompressobj(47)
            for k in range(0, len(b), PIECE):
                rest: bytes | memoryview = b[k : k + PIECE]
                while len(rest) and not z.eof:
                    yield z.decompress(rest, 4 * PIECE)
                    rest = z.unconsumed_tail
                if z.eof:
                    b = b[min(k + PIECE, len(b)) - len(z.unused_data) :]
                    break
            else:
                raise ValueError("the archive ends within its compressed data")

    def _more(self) -> bool:
        part = next(self.pieces, None)
        if part is None:
            return False
        self.held, self.at = self.held[self.at :] + part, 0
        return True

    def peek(self, n: int = 1) -> bytes:
        """The next n bytes, fewer at the end."""
        while len(self.held) - self.at < n and self._more():
            pass
        return self.held[self.at : self.at + n]

    def take(self, n: int) -> bytes:
        if len(self.held) - self.at < n:
            parts, size = [self.held[self.at :]], len(self.held) - self.at
            while size < n and (part := next(self.pieces, None)) is not None:
                parts.append(part)
                size += len(part)
            self.held, self.at = b"".join(parts), 0
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out

    def until(self, mark: bytes) -> bytes | None:
        """What comes before a mark, which is passed over; None if there is none."""
        start = self.at
        while (end := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - self.at - len(mark) + 1)
            if not self._more():
                return None
        out = self.held[self.at : end]
        self.at = end + len(mark)
        return out


def arc_records(b: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file after its version blocks, which say how header lines are read."""
    file, names = Inflated(b), FIELDS[1].split()
    while first := file.peek():
        if first in b"\r\n":
            file.take(1)
            continue
        line = file.until(b"\n")
        if line is None:
            raise ValueError("a header line has no end")
        line = line.decode("utf-8", "surrogatepass").rstrip("\r").split(" ")
        opens = line[0].startswith("filedesc://")
        if not opens and len(line) != len(names):
            raise ValueError(f"a header line has {len(line)} fields, not {len(names)}")
        if len(line) < 5 or not line[-1].isdigit():
            raise ValueError("a header line has no length")
        content = file.take(int(line[-1]))
        if len(content) < int(line[-1]):
            raise ValueError("the archive ends within a record")
        if opens:
            lines = content.decode("latin-1").split("\n")
            version = int(lines[0].split(" ")[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
            names = FIELDS[version].split()
            continue
        x = dict(zip(names, line))
        yield ArcRecord(x["URL"], x["IP-address"], x["Archive-date"], x["Content-type"], content)


def http_parts(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers in lower case, head, payload) of an HTTP response."""
    head, mark, payload = content.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, head + mark, payload


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{key} {digest}')}>"


def warc_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_record(r: ArcRecord, key: int | None, head: bytes, payload: bytes, digest: str, refers_to: int | None) -> str:
    """The WARC record, without the line breaks that close it; refers_to makes it a revisit."""
    revisit = refers_to is not None
    block = head if revisit else head + payload
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(key, digest)}",
        f"WARC-Date: {warc_date(r.date)}",
        f"WARC-Target-URI: {r.url}",
        f"WARC-IP-Address: {r.ip}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"WARC-Payload-Length: {len(payload)}",
        f"WARC-Source-ID: {'' if key is None else key}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[3:3] = [
            "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, digest)}",
            f"WARC-Refers-To-Source-ID: {refers_to}",
        ]
    return "\r\n".join(lines) + "\r\n\r\n" + block.decode("utf-8", "surrogatepass")


def warc_records(b: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of a WARC file."""
    file = Inflated(b)
    while first := file.peek(5):
        head = file.until(b"\r\n\r\n") if first == b"WARC/" else None
        if head is None:
            raise ValueError("no WARC record where one should begin")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        headers = {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["Content-Length"])
        block = file.take(size)
        if len(block) < size or file.take(4) != b"\r\n\r\n":
            raise ValueError("the archive ends within a record")
        yield headers, block


def batches_of(rows: Iterator[tuple[int, tuple]], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of rows (bytes, row), each of about BATCH bytes or 2000 rows."""
    held: list[tuple] = []
    size = 0
    for n, row in rows:
        held.append(row)
        size += n
        if size >= BATCH or len(held) == 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = "20000101000000") -> None:
    """One ARC record per page (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, written = f"{uuid.uuid5(NAMESPACE, path)}.arc", 0
        for b in batches:
            rows = []
            for key, url, html in zip(*(c.to_pylist() for c in b.columns)):
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nX-Record-Id: {'' if key is None else key}\r\n\r\n"
                url = _unsafe.sub(lambda m: "".join(f"%{x:02X}" for x in m[0].encode()), url or "") or "urn:none:"
                if written % RECORDS == 0:  # the sink begins a new file here
                    rows.append(version_block(version, name, date))
                    written += 1
                rows.append(arc_record(version, url, date, head + (html or ""), name))
                written += 1
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])

    slim = pages.select(F.col("page_id").cast("long"), "url", "html")
    slim.mapInArrow(run, "value string").write.option("lineSep", "\n").option("maxRecordsPerFile", RECORDS).options(**GZIP).text(path)


def _arc_rows(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    """id, digest and, if whole, the record's fields of all records in ARC files."""
    names = ["key", "digest", *(["url", "ip", "date", "kind", "content"] if whole else [])]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.binary()][: len(names)] if whole else [pa.int64(), pa.string()]

    def fields(archive: bytes) -> Iterator[tuple[int, tuple]]:
        for r in arc_records(archive):
            headers, _, payload = http_parts(r.content)
            key = headers.get("x-record-id") or None
            yield len(r.content) if whole else 0, (key and int(key), base32_sha1(payload), *(r if whole else ()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                yield from batches_of(fields(content.as_py()), kinds, names)

    more = ", url string, ip string, date string, kind string, content binary" if whole else ""
    return archives(spark, path).mapInArrow(run, "key long, digest string" + more)


def convert(spark: SparkSession, arc: str, warc: str, least: int = 0) -> None:
    """WARC files from ARC files; payloads of fewer than `least` bytes are never revisits."""
    # Copies are counted before they meet: the digests' table has a row per payload, and a hot one joins in parts.
    first = _arc_rows(spark, arc, False).groupBy("digest").agg(F.max("key").alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1 and __first is not null")
    joined = _arc_rows(spark, arc, True).join(first.drop("__n"), "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, key, url, ip, date, kind, content, to in zip(*(c.to_pylist() for c in b.columns)):
                _, head, payload = http_parts(content)
                to = None if key == to or len(payload) < least else to
                rows.append(warc_record(ArcRecord(url, ip, date, kind, b""), key, head, payload, digest, to))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])

    columns = joined.select("digest", "key", "url", "ip", "date", "kind", "content", "__first")
    columns.mapInArrow(run, "value string").write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS).options(**GZIP).text(warc)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id and date of all records.

    The digest of a response is computed from its payload, which must agree with its header.
    """

    def fields(archive: bytes) -> Iterator[tuple[int, tuple]]:
        for h, block in warc_records(archive):
            digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["WARC-Payload-Length"])
            if h["WARC-Type"] == "response":
                payload = http_parts(block)[2]
                if base32_sha1(payload) != digest or len(payload) != size:
                    raise ValueError(f"{h['WARC-Record-ID']}: the payload is not what its digest says")
            key, to = h["WARC-Source-ID"], h.get("WARC-Refers-To-Source-ID")
            yield 0, (int(key) if key else None, h["WARC-Target-URI"], size, digest, h["WARC-Type"], to and int(to), h["WARC-Record-ID"], h["WARC-Date"])

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                yield from batches_of(fields(content.as_py()), kinds, NAMES)

    return archives(spark, path).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, date string")


NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date"]


def round_trip(pages: DataFrame, version: int = 1) -> DataFrame:
    """The pages written as ARC, converted and read back."""
    spark = pages.sparkSession
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(pages, arc, version)
    convert(spark, arc, warc)
    return read_warc(spark, warc)
