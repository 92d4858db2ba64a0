"""Token ids in a binary file format: patched frame-of-reference blocks.

A file holds blocks of BLOCK ids. Each block stores its minimum, a width that a percentile of the differences chooses, the
differences packed at that width, and an exception list of the positions and values that don't fit. A footer has the
starts of the blocks and the documents' ids and lengths, so a file can be read alone, whole or from any block on.

Nulls and empty texts have no ids besides the end id. Rows with the same doc_id, null included (first of all), are ordered by
a hash of their text; equal rows follow each other. Texts of any length are encoded whole, one at least at a time, and may fill many blocks.
An empty table has no files and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_dir, give_back, small_batches, written
from .files import create, open_random

BLOCK = 4096
PERCENTILE = 98
MAGIC = b"PFOR1\0\0\0"
HEAD = struct.Struct("<IBxHHxx")  # minimum, width, ids, exceptions
MEMORY = 128 << 20  # bytes of the pieces that a worker remembers
ENTRY = 170  # bytes of a remembered piece besides its own and its ids
SLICE = 4 << 20  # bytes of text that are encoded at once
MARKS = r"[!-&(-/:-@\[-`{-~]"  # ASCII punctuation; not the apostrophe, which tokenizers may join to letters
PARTS = re.compile(rf"({MARKS}*)([a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)({MARKS}*)")


# ---------------------------------------------------------------- blocks


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of at most 65535 ids below 2**32."""
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    width = int(np.partition(rest, k := min(len(rest) - 1, int(len(rest) * percentile / 100)))[k]).bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    head = HEAD.pack(low, width, len(ids), len(over))
    bits = np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
    return head + np.packbits(bits, bitorder="little").tobytes() + over.astype("<u2").tobytes() + rest[over].astype("<u4").tobytes()


def unpack_block(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The ids of the block at `at`, and where the next one starts."""
    low, width, n, n_over = HEAD.unpack_from(data, at)
    at += HEAD.size
    size = (n * width + 7) // 8
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    rest = np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)
    at += size
    over = np.frombuffer(data, "<u2", n_over, at)
    rest[over] = np.frombuffer(data, "<u4", n_over, at + 2 * n_over)
    return rest + np.uint32(low), at + 6 * n_over


class Writer:
    """Documents to a stream, block by block; only an unfinished block, the block starts and the document index are held."""

    def __init__(self, out, block: int = BLOCK):
        self.out, self.block, self.left, self.starts, self.docs, self.n = out, block, [], [], [], 0
        self.held, self.at = 0, len(MAGIC)
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id is None, doc_id or 0, len(ids)))
        self.left.append(ids)
        self.held += len(ids)
        self.n += len(ids)
        if self.held >= 64 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.left) if self.left else np.zeros(0, np.uint32)
        end = len(ids) if last else len(ids) // self.block * self.block
        blocks = [pack_block(ids[i : min(end, i + self.block)]) for i in range(0, end, self.block)]
        for b in blocks:
            self.starts.append(self.at)
            self.at += len(b)
        self.out.write(b"".join(blocks))
        self.left, self.held = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        docs = np.array(self.docs, np.int64).reshape(-1, 3)
        foot = np.array(self.starts, "<i8").tobytes() + docs[:, 0].astype("u1").tobytes() + docs[:, 1].astype("<i8").tobytes() + docs[:, 2].astype("<i8").tobytes()
        self.out.write(foot + struct.pack("<QQQ", len(self.starts), len(docs), self.at))
        self.out.close()


def read_file(path: str, many: int = 64) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids of each document of a file, some blocks in memory at a time (a document that is longer as a whole)."""
    with open_random(path) as f:
        size = f.size()
        f.seek(size - 24)
        n_blocks, n_docs, foot = struct.unpack("<QQQ", f.read(24))
        f.seek(foot)
        data = f.read(size - 24 - foot)
        starts = [*np.frombuffer(data, "<i8", n_blocks).tolist(), foot]
        null = np.frombuffer(data, "u1", n_docs, 8 * n_blocks)
        ids, lengths = np.frombuffer(data, "<i8", 2 * n_docs, 8 * n_blocks + n_docs).reshape(2, -1) if n_docs else ([], [])
        held, next_block = np.zeros(0, np.uint32), 0
        for is_null, doc_id, n in zip(null, ids, lengths):
            parts, have = [held], len(held)
            while have < n:
                f.seek(starts[next_block])
                to = min(n_blocks, next_block + many)
                raw, at = f.read(starts[to] - starts[next_block]), 0
                for _ in range(to - next_block):
                    got, at = unpack_block(raw, at)
                    parts.append(got)
                    have += len(got)
                next_block = to
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield (None if is_null else int(doc_id)), held[:n]
            held = held[n:]


# ---------------------------------------------------------------- encoding


class Encoder:
    """A text's ids from the tokenizers library, which sees each white-space-free piece once as long as it is remembered.

    Only for tokenizers that lower-case, drop white space, split letters from other characters and never let a token reach over
    such a border; the last token of a word ends in `end`. Pieces are remembered with A-Z as a-z, but for texts that could
    hold a special token. Where they take `most` bytes, those not met since half of that was last full are forgotten.
    """

    def __init__(self, tokenizer_file: str, most: int = MEMORY, end: str = "</w>"):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known, self.older, self.held = Tokenizer.from_file(tokenizer_file), most, {}, {}, 0
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(end)]] = True

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if self.held > self.most // 2:
            self.known, self.older, self.held = {}, self.known, 0
        known, older = self.known, self.older
        n = len(known)
        new = set().union(*split).difference(known)
        again = new.intersection(older)
        known.update((w, older[w]) for w in again)
        self._learn([w.decode() for w in new - again])
        find = known.__getitem__
        out = [b"".join(map(find, ws)) for ws in split]
        added = list(islice(reversed(known), len(known) - n))
        self.held += ENTRY * len(added) + sum(map(len, added)) + sum(map(len, map(find, added)))
        return iter(out)

    def _learn(self, new: list[str]) -> None:
        """Words of letters only are encoded many at once and told apart by their last tokens; a word with punctuation around it
        is put together from its parts, which are remembered too; other pieces one by one."""
        plain, other, made = [], [], []
        for w in new:
            if w.isascii() and w.isalpha() or w.lower().isalpha():
                plain.append(w)
            elif "<|" not in w and (found := PARTS.fullmatch(w)):  # it may be a special token
                made.append(found.groups())
            else:
                other.append(w)
        parts = {p for m in made for p in m if p}.difference(plain, other)
        for p in parts:
            if (b := p.encode()) in self.older:
                self.known[b] = self.older[b]
            elif b not in self.known:
                (plain if p[0].isalpha() else other).append(p)
        for i in range(0, len(plain), 2000):
            part = plain[i : i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or cuts[-1] != len(ids):  # some word isn't one for the tokenizer
                other += part
                continue
            raw, at = ids.tobytes(), 0
            for w, e in zip(part, (cuts * 4).tolist()):
                self.known[w.encode()] = raw[at:e]
                at = e
        for i in range(0, len(other), 4000):
            part = other[i : i + 4000]
            got = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.known.update((w.encode(), array("I", e.ids).tobytes()) for w, e in zip(part, got))
        find = self.known.get
        self.known.update(((a + b + c).encode(), find(a.encode(), b"") + find(b.encode()) + find(c.encode(), b"")) for a, b, c in made)


def encoded(texts: pa.Array, encode: Encoder, limit: int = SLICE) -> Iterator[bytes]:
    """The ids of each text, of about `limit` bytes of texts (one at least) at a time."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    ends, i = np.cumsum(pc.binary_length(texts).to_numpy()), 0
    while i < len(texts):
        j = max(i + 1, int(ends.searchsorted((ends[i - 1] if i else 0) + limit, "right")))
        yield from encode(texts.slice(i, j - i).to_pylist())
        i = j


@functools.cache
def encoder(tokenizer_file: str) -> Encoder:
    """A worker process's own encoder, which its tasks share."""
    return Encoder(tokenizer_file)


def write_token_ids(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 1) -> DataFrame:
    """Write all documents' ids, in ascending doc_id order, as files in `folder`; return the manifest.

    Manifest: part (files in ascending order of their documents), path, n_docs, n_tokens. One shuffle, by ranges of doc_id.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        encode, out, end, file = encoder(tokenizer_file), None, struct.pack("<I", end_id), ""
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1), encode)):
                if out is None:
                    file, stream = create(folder, ".pfor")
                    out = Writer(stream)
                out.add(doc_id, np.frombuffer(ids + end, "<u4"))
        give_back()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([file]), pa.array([len(out.docs)], pa.int64()), pa.array([out.n], pa.int64())], ["part", "path", "n_docs", "n_tokens"])

    ranged = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    return ranged.select("doc_id", "text").mapInArrow(write, "part long, path string, n_docs long, n_tokens long")


def read_token_ids(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files. The manifest must be a written table.

    start counts the ids of all documents before it. The running sum over files is over one row a file.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, at = [], 0
                for doc_id, ids in read_file(path):
                    rows.append((doc_id, part, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(rows) == 10_000:
                        yield to_batch(rows)
                        rows = []
                if rows:
                    yield to_batch(rows)

    def to_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())  # files, as many as the writer's tasks; `before` is broadcast with a row for each
    rows = manifest.select("part", "path").repartition(n, "part").mapInArrow(read, "doc_id long, part long, at long, n_tokens long, ids_crc32 long")
    before = manifest.select("part", (F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(docs: DataFrame, tokenizer_file: str, end_id: int = 1) -> DataFrame:
    """Encode, write, read back: (doc_id, start, n_tokens, ids_crc32)."""
    folder = fresh_dir(docs.sparkSession, "token-ids")
    return read_token_ids(written(write_token_ids(docs, folder, tokenizer_file, end_id), "token-manifest"))
