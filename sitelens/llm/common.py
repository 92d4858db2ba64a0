"""What the corpus operators share: text bytes, words, hashes, rows carried whole, fixed-width values."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import components, forest, hot_join, whole_groups  # noqa: F401
from ..operators.tables import discard, fresh_dir, mark, shared_dir  # noqa: F401
from ..operators.tables import materialized as written  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 1 << 19  # bytes of text that are worked on at once

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1


# ---------------------------------------------------------------- texts as bytes


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose rows Spark will hand to Python 1000 at a time, so that whole texts take bounded memory there."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df


def carried(docs: DataFrame, **more) -> DataFrame:
    """docs with each row as one struct `row`, beside other columns: what a stage adds can't clash with a column of its input."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")).withColumns(more)


def give_back() -> None:
    """Return freed memory to the system, as a worker process goes on to other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of some rows of a batch, of about `limit` bytes (one row at least); null texts are empty.

    The column may be a field of a struct, as in "row.text".
    """
    name, *inner = column.split(".")
    for batch in batches:
        whole = batch.column(batch.schema.get_field_index(name))
        texts = pc.fill_null((pc.struct_field(whole, inner) if inner else whole).cast(pa.large_utf8()), "")
        if not len(texts):
            continue
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] and at[-1] else np.zeros(0, np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            j = min(j, len(texts))
            yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j
    give_back()


def words(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes outside `space`; a row's end also ends a word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.empty(len(data), bool)
    before[0] = True
    np.logical_not(solid[:-1], out=before[1:])
    after = np.empty(len(data), bool)
    after[-1] = True
    np.logical_not(solid[1:], out=after[:-1])
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, _BASE, np.uint64))
        down = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z as a-z if asked: a polynomial from prefix sums, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = 1 << max(20, int(len(data)).bit_length())
    up, down = _powers(size)
    with np.errstate(over="ignore"):
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(((LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        raw = (sums[ends] - sums[starts]) * down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(hashes: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of k words; a row with fewer words (one at least) has one shingle of them all."""
    counts = np.bincount(row, minlength=n_rows)
    with np.errstate(over="ignore"):
        whole = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
        for i in range(k):
            whole = mix(whole * np.uint64(0xA24BAED4963EE407) + hashes[i : i + len(whole)] + np.uint64(i + 1))
        fits = row[: len(whole)] == row[k - 1 :] if len(whole) else np.zeros(0, bool)
        out, at = whole[fits], row[: len(whole)][fits]
        first = np.concatenate([[0], np.cumsum(counts)])
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for i in range(k - 1):
                has = counts[short] > i
                extra[has] = mix(extra[has] * np.uint64(0xA24BAED4963EE407) + hashes[first[short[has]] + i] + np.uint64(i + 1))
            out, at = np.concatenate([out, mix(extra + np.uint64(7))]), np.concatenate([at, short])
            order = np.argsort(at, kind="stable")
            out, at = out[order], at[order]
    return out, at


def crc_bucket(doc_id, n: int):
    """crc32 of doc_id written as text, modulo n; a null id counts as the text ''."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % n


# ---------------------------------------------------------------- fixed-width values


def fixed_matrix(column, width: int, dtype) -> np.ndarray:
    """A column of equally long binary values as a matrix."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    c = c.cast(pa.large_binary())
    at = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
    return np.frombuffer(c.buffers()[2], np.uint8)[at[0] : at[-1]].view(dtype).reshape(len(c), width) if len(c) else np.zeros((0, width), dtype)


def fixed_binary(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    raw = np.ascontiguousarray(matrix)
    width = raw.dtype.itemsize * raw.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(0, len(raw) * width + 1, max(1, width), dtype=np.int32) if width else np.zeros(len(raw) + 1, np.int32)), pa.py_buffer(raw.tobytes())])
