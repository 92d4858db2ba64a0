"""WARC archives of web pages: one gzip member a record, written and read by tasks.

The reader goes through a file once, front to back: it inflates a member bit by bit, takes the record's header, frames
its block by Content-Length, and checks block and payload digests, so it holds one block at most.

A null html is an empty payload. Of equal payloads the smallest page_id is the response (rows that repeat it are too);
null ids come last. A payload of any length is one record, which a task holds whole. An empty table has no archives and no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, hot_join, written
from .files import create, open_input

READ = 1 << 16
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadRecord(ValueError):
    """A record whose framing or digest is wrong."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: dict[str, str], block: bytes, level: int = 4) -> bytes:
    """One WARC record as one gzip member."""
    named = headers | {"WARC-Block-Digest": "sha1:" + base32_sha1(block), "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named.items()) + "\r\n"
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(head.encode() + block + b"\r\n\r\n") + deflate.flush()


def page_record(page_id: int | None, url: str | None, html: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response with the payload, or a revisit that names the response's page."""
    where = " ".join((url or "").split())
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI": where or "urn:page:unknown",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": "sha1:" + base32_sha1(html),
        "Content-Type": "application/http; msgtype=response",
    }
    http = HTTP + f"Content-Length: {len(html)}\r\n\r\n".encode()
    if revisit:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{'' if refers_to is None else refers_to}>"}
        return record(headers, http)
    return record(headers, http + html)


class _Member:
    """The inflated bytes of the gzip members of a stream, one member at a time."""

    def __init__(self, stream):
        self.stream, self.raw, self.out, self.inflate = stream, b"", bytearray(), None

    def open(self) -> bool:
        """Go to the next member; False at the end of the file."""
        if not self.raw:
            self.raw = self.stream.read(READ)
        self.inflate, self.out = zlib.decompressobj(31), bytearray()
        return bool(self.raw)

    def more(self) -> bool:
        """Inflate some more; False when the member has ended."""
        if self.inflate.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(READ)
            if not self.raw:
                raise BadRecord("the file ends within a record")
        self.out += self.inflate.decompress(self.raw, READ * 16)
        self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        while (i := self.out.find(mark)) < 0:
            if not self.more():
                raise BadRecord("a record's header has no end")
        head = bytes(self.out[:i])
        del self.out[: i + len(mark)]
        return head

    def take(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self.more():
                raise BadRecord("a block is shorter than its Content-Length")
        got = bytes(self.out[:n])
        del self.out[:n]
        return got

    def end(self) -> None:
        while self.more():
            pass
        if self.out != b"\r\n\r\n":
            raise BadRecord("a block is longer than its Content-Length")


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record; raises BadRecord on wrong framing or digests."""
    member = _Member(stream)
    while member.open():
        lines = member.until(b"\r\n\r\n").decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise BadRecord(f"not a record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = member.take(int(headers["content-length"]))
        member.end()
        if headers.get("warc-block-digest", "") != "sha1:" + base32_sha1(block):
            raise BadRecord("a block's digest is wrong")
        yield headers, block


def payload_of(headers: dict[str, str], block: bytes) -> tuple[int, bytes]:
    """Bytes of the full payload, by its HTTP header, and what the record has of it (nothing for a revisit)."""
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if headers["warc-type"] == "response":
        if len(payload) != size:
            raise BadRecord("a payload is not as long as its HTTP header says")
        if headers["warc-payload-digest"] != "sha1:" + base32_sha1(payload):
            raise BadRecord("a payload's digest is wrong")
    return size, payload


def with_duplicates(pages: DataFrame) -> DataFrame:
    """page_id, url, html (never null), first: the smallest page_id of an equal payload that occurs again, else null."""
    digest = F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256)
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), digest.alias("_digest"))
    groups = keyed.groupBy("_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("_n")).filter("_n > 1")
    groups = written(groups, "warc-groups")
    return hot_join(keyed, groups, "_digest", "_n", pages.count()).drop("_digest")


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages as archives in `folder`, a file a task; return the manifest (path, n_records, n_bytes)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n, size = None, "", 0, 0
        for batch in batches:
            for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, out = create(folder, ".warc.gz")
                revisit = first is not None and page_id != first
                data = page_record(page_id, url, html.encode(), first, revisit)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "n_records", "n_bytes"])

    return with_duplicates(pages).select("page_id", "url", "html", "first").mapInArrow(write, "path string, n_records long, n_bytes long")


def read_warc(manifest: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits) of each record."""

    def number(x: str) -> int | None:
        x = x.removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x else None

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with open_input(path) as stream:
                    for h, block in read_records(stream):
                        size, payload = payload_of(h, block)
                        kind = h["warc-type"]
                        rows.append((number(h["warc-record-id"]), h["warc-target-uri"], size, h["warc-payload-digest"].removeprefix("sha1:"), kind, number(h["warc-refers-to"]) if kind == "revisit" else None, payload if kind == "response" else None))
                        held += len(payload)
                        if held > 8 << 20 or len(rows) == 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n, "path").mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Archive all pages, read the archives back, and return a row a page without its payload."""
    folder = fresh_dir(pages.sparkSession, "warc")
    return read_warc(written(write_warc(pages, folder), "warc-manifest")).drop("payload", "url")
