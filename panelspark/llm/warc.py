"""WARC: one gzip member per record, written from pages and read back by a sequential reader.

The reader inflates a file in small steps, starts a new inflater at each member, frames a record by its Content-Length and verifies
block and payload digests while the bytes pass. Memory is bounded by one read step and one record header.
"""
from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.layout import settle
from panelspark.llm.common import attempt_name, new_folder, open_store

FILE_BYTES = 256 << 20
STEP = 1 << 18
HEADER_LIMIT = 1 << 20
DATE = "2025-01-01T00:00:00Z"
PAGE_URN = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, block_ok boolean, payload_ok boolean"


def b32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: str, url: str | None, payload: bytes, first: str | None) -> bytes:
    """A response, or a revisit of ``first`` whose block keeps only the HTTP header with the payload's length; one gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{PAGE_URN}{page}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
        f"WARC-Block-Digest: sha1:{b32_sha1(block)}", f"WARC-Payload-Digest: sha1:{b32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if first is not None:
        head[4:4] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{PAGE_URN}{first}>"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_warc(pages: DataFrame, *, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write (page_id, url, html) as WARC files; returns (file, page_id) of what was written.

    Of pages with equal payloads those with the smallest page_id are responses, all others revisit it (a page_id that repeats
    with its payload is a response each time). NULL html is an empty payload. A NULL page_id is never the one that others
    refer to unless all are NULL; then all are responses. Files of attempts that did not finish are never listed.
    """
    folder = new_folder(pages.sparkSession, "warc")
    page = F.col("page_id").cast("long").alias("page_id")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    digests = pages.select(page, F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size"))
    firsts = digests.groupBy("digest", "size").agg(F.min("page_id").alias("first"))
    # only copies are looked up again by page, so pages keep their places and a large group of copies is never gathered
    copies = digests.join(firsts, ["digest", "size"]).filter("first is not null and (page_id is null or page_id > first)").select(F.col("page_id").alias("_page"), "digest", "first")
    named = pages.select(page, F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("_digest", F.sha1(F.col("html").cast("binary")))
    marked = named.join(copies.distinct(), F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_digest") == F.col("digest")), "left").select("page_id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        out, name, size = None, "", 0
        for batch in batches:
            files = []
            bodies = batch.column(2).cast(pa.binary())
            for page_id, url, body, first in zip(batch.column(0), batch.column(1), bodies, batch.column(3)):
                if out is None or size >= file_bytes:
                    if out is not None:
                        out.close()
                    name, size = attempt_name(folder, "pages", ".warc.gz"), 0
                    out = store.open_output_stream(open_store(name)[1], compression=None)
                first = first.as_py()
                data = record(str(page_id.as_py()), url.as_py(), body.as_py(), None if first is None else str(first))
                out.write(data)
                size += len(data)
                files.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), batch.column(0)], ["file", "page_id"])
        if out is not None:
            out.close()

    return settle(marked.mapInArrow(run, "file string, page_id long"), "warc-files")


class Corrupt(ValueError):
    """A file that is no sequence of whole records."""


def inflate(handle, step: int = STEP) -> Iterator[tuple[bool, bytes]]:
    """(member ends here, bytes) of concatenated gzip members, inflated ``step`` bytes at most at a time."""
    inflater, started = zlib.decompressobj(31), False
    data = handle.read(step)
    while data or inflater.unconsumed_tail:
        if not started and not data:
            break
        started = True
        try:
            got = inflater.decompress(inflater.unconsumed_tail + data if inflater.unconsumed_tail else data, step)
        except zlib.error as e:
            raise Corrupt(f"not gzip: {e}") from e
        yield inflater.eof, got
        if inflater.eof:
            data, inflater, started = inflater.unused_data or handle.read(step), zlib.decompressobj(31), False
        else:
            data = b"" if inflater.unconsumed_tail else handle.read(step)
            if not data and not inflater.unconsumed_tail:
                tail = inflater.flush()
                if tail:
                    yield inflater.eof, tail
                if not inflater.eof:
                    raise Corrupt("the last member is cut short")


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(b":")[::2] for line in lines.split(b"\r\n")[1:] if line)
    return {k.strip().lower().decode(): v.strip().decode() for k, v in pairs}


class _Record:
    """State of the record that is being read: its header, then its block, hashed as it passes."""

    def __init__(self):
        self.head, self.info, self.left = bytearray(), None, 0
        self.block, self.payload = hashlib.sha1(), hashlib.sha1()
        self.http, self.http_head, self.payload_bytes, self.end = bytearray(), None, 0, bytearray()

    def feed(self, data: bytes) -> None:
        if self.info is None:
            self.head += data
            cut = self.head.find(b"\r\n\r\n")
            if cut < 0:
                if len(self.head) > HEADER_LIMIT:
                    raise Corrupt("a record header without an end")
                return
            data, head = bytes(self.head[cut + 4 :]), bytes(self.head[:cut])
            if not head.startswith(b"WARC/"):
                raise Corrupt("no WARC version line")
            self.info = _headers(head)
            if not self.info.get("content-length", "").isdigit():
                raise Corrupt("no Content-Length")
            self.left = int(self.info["content-length"])
        body, rest = data[: self.left], data[self.left :]
        self.left -= len(body)
        self.block.update(body)
        self.end += rest
        if len(self.end) > 4:
            raise Corrupt("bytes after the record")
        if self.http_head is None and not self.is_http():
            self.http_head = {}
        if self.http_head is None:
            self.http += body
            cut = self.http.find(b"\r\n\r\n")
            if cut < 0:
                if len(self.http) > HEADER_LIMIT:
                    raise Corrupt("an HTTP header without an end")
                return
            self.http_head = _headers(bytes(self.http[:cut]))
            body = bytes(self.http[cut + 4 :])
            self.http = bytearray()
        self.payload.update(body)
        self.payload_bytes += len(body)

    def is_http(self) -> bool:
        """Whether the block is an HTTP message; without a Content-Type that is so for responses, requests and revisits."""
        kind = self.info.get("content-type", "").lower()
        return kind.startswith("application/http") or (not kind and self.info.get("warc-type") in ("response", "request", "revisit"))

    def row(self) -> tuple:
        """A revisit has no payload of its own: its length is the HTTP header's, its digest the record's."""
        if self.info is None or self.left or self.end != b"\r\n\r\n":
            raise Corrupt("a record is cut short or not closed")
        info, name = self.info, lambda k: (self.info.get(k) or "").strip("<>") or None
        digest = lambda h: base64.b32encode(h.digest()).decode()
        stated = (info.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        revisit = info.get("warc-type") == "revisit"
        length = int((self.http_head or {}).get("content-length", 0)) if revisit else self.payload_bytes
        whole = None if revisit else stated is None or stated == digest(self.payload)
        block = (info.get("warc-block-digest") or "").removeprefix("sha1:")
        return (
            name("warc-record-id"), info.get("warc-type"), name("warc-target-uri"), name("warc-refers-to"), length,
            stated if revisit or stated is not None else digest(self.payload), not block or block == digest(self.block), whole,
        )


def read_records(handle, step: int = STEP) -> Iterator[tuple]:
    """Rows of one open file, record by record; ``Corrupt`` if it is damaged."""
    now = _Record()
    for ended, data in inflate(handle, step):
        now.feed(data)
        if ended:
            yield now.row()
            now = _Record()


def read_warc(files: DataFrame, *, rows_a_batch: int = 4096) -> DataFrame:
    """One row per record of the WARC files that column ``file`` names, each file by one task in order.

    The payload of an HTTP message is what follows its header; the block of any other record (resource, metadata, conversion,
    warcinfo) is its payload as it stands.
    ``payload_bytes`` and ``payload_digest`` are those of the full payload, for revisits too. ``block_ok`` and ``payload_ok``
    tell whether the stated digests hold (``payload_ok`` is NULL for revisits, whose payload is elsewhere). A file that is no
    sequence of whole records fails the job and is named; an empty file has no records.
    """
    names = [f.split(" ")[0] for f in FIELDS.split(", ")]
    types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        rows = []
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = open_store(name)
                with store.open_input_stream(path, compression=None) as handle:
                    try:
                        for row in read_records(handle):
                            rows.append(row)
                            if len(rows) == rows_a_batch:
                                yield pack(rows)
                                rows = []
                    except Corrupt as e:
                        raise Corrupt(f"{name}: {e}") from e
        if rows:
            yield pack(rows)

    spark = files.sparkSession
    listed = settle(files.select("file").distinct(), "warc-list")
    tasks = max(1, listed.count())  # a few names are a few bytes: a stated count keeps one file a task
    return listed.repartition(max(tasks, spark.sparkContext.defaultParallelism), "file").mapInArrow(run, FIELDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, block_ok, payload_ok) as read back from the archives."""
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(PAGE_URN) + 1}) AS BIGINT)")
    back = read_warc(write_warc(pages))
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "block_ok", "payload_ok")
