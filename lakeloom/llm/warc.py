"""WARC archives: writing, and a sequential reader that checks what it reads.

Writing: one gzip member per record, each with its headers, Content-Length,
block and payload digests.  A payload that another page repeats is stored once
(response); the others point to it (revisit).  Archives are files of bounded
size in a folder that all executors share; Spark's own writer makes them, so they
may be in any store that Spark can reach.  That writer ends each file with a
zero byte, which gzip readers skip as padding.

Reading: a file is inflated incrementally, member by member, in pieces of bounded
size; records are framed by Content-Length, and digests are verified.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path

VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed by the format
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
REVISIT_BYTES = 1000  # payloads from this size on are stored once
ARCHIVE_BYTES = 8_000_000  # an archive is closed when it has this many bytes
PIECE = 1 << 16  # bytes given to the inflater at once
LEVEL = 6
NO_DATE = b"1970-01-01T00:00:00Z"  # pages carry no fetch time
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def sha1_label(data: bytes) -> bytes:
    return b"sha1:" + base64.b32encode(hashlib.sha1(data).digest())


def stated_sha1(headers: dict[str, str], part: str) -> str | None:
    """SHA-1 that a record states of its block or payload, in hexadecimal; None if it states none or another kind."""
    kind, _, value = headers.get(f"warc-{part}-digest", "").partition(":")
    if kind.lower() not in ("sha1", "sha-1"):
        return None
    try:
        return bytes.fromhex(value).hex() if len(value) == 40 else base64.b32decode(value.upper()).hex()
    except ValueError as e:
        raise WarcError("a digest that cannot be read") from e


def record_id(name: str) -> bytes:
    return b"<urn:uuid:" + str(uuid.uuid5(uuid.NAMESPACE_URL, name)).encode() + b">"


def _clean(value: str | None) -> bytes:
    """A header value on one line."""
    return " ".join((value or "").split()).encode("utf-8")


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, again: str = "") -> bytes:
    """One record, uncompressed.  A revisit has the response's head but no payload; ``again`` tells repeated rows apart."""
    head = HTTP_HEAD + b"Content-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = head if revisit else head + payload
    name = b"none" if page_id is None else b"%d" % page_id
    lines = [
        VERSION,
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: " + record_id(f"page:{name.decode()}:{digest}:{revisit}{again}"),
        b"WARC-Date: " + NO_DATE,
        b"WARC-Target-URI: " + _clean(url),
        b"WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)),
        b"WARC-Block-Digest: " + sha1_label(block),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
        b"X-Page-ID: " + name,
    ]
    if revisit:
        lines[5:5] = [
            b"WARC-Profile: " + PROFILE,
            b"WARC-Refers-To: " + record_id(f"page:{refers_to}:{digest}:False"),
            b"X-Refers-To-Page: %d" % refers_to,
            b"X-Payload-Length: %d" % len(payload),
        ]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    out = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return out.compress(data) + out.flush()


class WarcError(ValueError):
    """An archive that breaks the format or whose digest does not fit."""


def members(data: bytes | memoryview) -> Iterator[Iterator[bytes]]:
    """For each gzip member, its inflated pieces; zero padding between members is skipped."""
    view, at = memoryview(data), 0
    while True:
        while at < len(view) and view[at] == 0:
            at += 1
        if at >= len(view):
            return
        inflater = zlib.decompressobj(31)

        def pieces(inflater=inflater) -> Iterator[bytes]:
            nonlocal at
            while not inflater.eof:
                if at >= len(view):
                    raise WarcError("an archive ends within a record")
                piece = view[at : at + PIECE]
                at += len(piece)
                try:
                    out = inflater.decompress(piece)
                except zlib.error as e:
                    raise WarcError(str(e)) from e
                if out:
                    yield out
            at -= len(inflater.unused_data)

        yield pieces()


def read_record(pieces: Iterator[bytes]) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; the block's length and digest are verified."""
    buffer = bytearray()
    end = -1
    for piece in pieces:
        buffer += piece
        end = buffer.find(b"\r\n\r\n")
        if end >= 0:
            break
    if end < 0:
        raise WarcError("a record without an end of headers")
    lines = bytes(buffer[:end]).split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise WarcError("a record without a version")
    headers = {}
    for line in lines[1:]:
        name, found, value = line.partition(b":")
        if not found:
            raise WarcError("a header line without a colon")
        headers[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    try:
        size = int(headers["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("a record without a length") from e
    rest = bytearray(buffer[end + 4 :])
    for piece in pieces:
        rest += piece
        if len(rest) > size + 4:
            raise WarcError("a block longer than its length")
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError("a block shorter than its length")
    block = bytes(rest[:size])
    if stated_sha1(headers, "block") not in (None, hashlib.sha1(block).hexdigest()):
        raise WarcError("a block that does not fit its digest")
    return headers, block


def read_archive(data: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record.

    The payload of a response or revisit over HTTP stands after its HTTP headers;
    other records' payload is their block.  A SHA-1 payload digest of a response
    is verified; other algorithms, and records without one, are taken as they are.
    """
    for member in members(data):
        headers, block = read_record(member)
        payload = block
        if headers.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
            _, found, payload = block.partition(b"\r\n\r\n")
            if not found:
                raise WarcError("an HTTP block without an end of headers")
        if headers.get("warc-type") == "response" and stated_sha1(headers, "payload") not in (None, hashlib.sha1(payload).hexdigest()):
            raise WarcError("a payload that does not fit its digest")
        yield headers, payload


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdecimal() else None


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to archives under ``path``.

    Of equal payloads of ``revisit_bytes`` or more, the row with the largest
    page_id is the response (all rows that repeat this very page_id are), the
    others revisit it; a null page_id counts as smaller than any, and payloads
    that only such rows have are responses.  A null html is an empty payload.
    The group is found from digests alone: html moves once, and only if the
    revisits are too many to send to every executor.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("other", F.xxhash64("html"))  # two hashes: SHA-1 alone can be forged
    large = F.octet_length("html") >= revisit_bytes
    kept = rows.filter(large).groupBy("digest", "other").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    kept = kept.filter("n > 1 and last is not null").select("digest", "other", "last")
    rows = rows.join(kept, ["digest", "other"], "left").select(
        "page_id", "url", "html", "digest", F.expr("case when not (page_id <=> last) then last end").alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        named: set[tuple] = set()  # of the open archive
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, text, digest, refers_to = (c[i].as_py() for c in batch.columns)
                # The page that others refer to has an identifier that follows from the page; a row that repeats it in this task does not.
                again = "" if (page_id, digest) not in named else uuid.uuid4().hex
                named.add((page_id, digest))
                parts.append(gzip_member(make_record(page_id, url, text.encode("utf-8"), digest, refers_to, again)))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["archive"])
                    parts, size = [], 0
                    named.clear()
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["archive"])

    archives = rows.mapInArrow(run, "archive binary")
    # The text writer puts the bytes of a string into the file as they are; one archive a file.
    archives.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\u0000").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Read the archives under ``path``: a row per response and revisit, with its type, digest and size.

    A damaged archive raises :class:`WarcError`.  Records of other types
    (warcinfo, request, metadata and so on) are framed and verified but give no
    row.  The payload size of a revisit is that of the response, as its record
    says, or null; a response without a SHA-1 payload digest gets that of its
    payload, such a revisit null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, payload in read_archive(memoryview(content.as_buffer())):
                    page, first = headers.get("x-page-id", "none"), headers.get("x-refers-to-page")
                    kind = headers.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    size = len(payload) if kind == "response" else _number(headers.get("x-payload-length"))
                    digest = stated_sha1(headers, "payload") or (hashlib.sha1(payload).hexdigest() if kind == "response" else None)
                    rows.append((_number(page), size, digest, kind, _number(first), headers.get("warc-target-uri")))
                if rows:
                    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, READ_SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives to the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
