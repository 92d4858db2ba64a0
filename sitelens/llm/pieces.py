"""Sampled SentencePiece segmentations and their decoding.

A text is a space and its bytes; the lattice has an edge for each piece that its bytes spell, and byte edges where a
character has no piece. Forward filtering sums the weights of all paths to each place; backward sampling draws the last piece of the
paths that end at a place, and goes on from where it starts. No piece has a space after another byte, so the lattice of a text falls
into one for each run of spaces and what follows it: equal runs of a batch are filtered once, and all their occurrences are
sampled together. The draw at a place depends on the seed, the row key and the place only, so results don't depend on how rows
are dealt, and equal rows get equal segmentations. Runs of over LONG bytes, as in languages without spaces, are filtered by
their edges in windows; only the sums at each place are kept, and a window's edges are found again on the way back.

Weights are the model's scores for unigram models. A BPE model only ranks its pieces; there a piece of rank r weighs
1 / (r + 2), as words of a corpus do. `alpha` sharpens (> 1) or flattens (< 1) them; alpha = inf isn't supported.

Decoding joins the pieces' bytes and takes the first space off, which gives the text back byte by byte. A null or empty text has
no pieces and decodes to an empty text; a null row key counts as 0. Repeated rows have equal results. An empty table has no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _powers, mix, small_batches, text_chunks

CHUNK = 1 << 20
LONG = 4096  # bytes of a run that are filtered at once with others
GROUP = 1 << 18  # bytes of distinct runs that are filtered at once: about 300 bytes of memory each
WINDOW = 1 << 16
SPACE = 32
BYTE_WEIGHT = -12.0


class Model:
    """Pieces as bytes, with their weights, and the edges that bytes can be."""

    def __init__(self, model_file: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        scores = np.array([sp.get_score(i) for i in range(n)])
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        own = np.array([s for s, p in zip(scores, plain) if p])
        ranked = len(own) > 1 and bool(np.all(own == np.round(own)))  # BPE: whole numbers, falling by one
        if ranked:
            order = np.argsort(-scores, kind="stable")
            place = np.empty(n)
            place[order] = np.arange(n)
            weights = -np.log(place + 2)
        else:
            weights = scores
        self.byte_ids = np.zeros(256, np.int32)
        spelled: list[bytes] = []
        for i, name in enumerate(names):
            if sp.is_byte(i):
                spelled.append(bytes([int(name[3:5], 16)]))
                self.byte_ids[int(name[3:5], 16)] = i
            else:
                spelled.append(name.replace("▁", " ").encode() if plain[i] else b"")
        if any(" " in x.decode().lstrip(" ") for x, p in zip(spelled, plain) if p):
            raise ValueError("a piece has a space after another character")
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.most = int(max(len(x) for x, p in zip(spelled, plain) if p))
        self.tables = {}
        #: bit l: some piece of l bytes starts with these three (by _triple)
        self.starting = np.zeros(1 << 18, np.uint32)
        for l in range(1, self.most + 1):
            ids = [i for i in range(n) if plain[i] and len(spelled[i]) == l]
            if ids:
                data = np.frombuffer(b"".join(spelled[i] for i in ids), np.uint8)
                at = np.arange(len(ids)) * l
                h = _substrings(data, at, l)
                order = np.argsort(h)
                some = np.zeros(1 << 16, bool)  # most substrings are no pieces; their first 16 hash bits tell
                some[h >> np.uint64(48)] = True
                if l >= 3:
                    first = data.reshape(-1, l)[:, :3].astype(np.int64)
                    np.bitwise_or.at(self.starting, _triple(first[:, 0], first[:, 1], first[:, 2]), np.uint32(1 << l))
                self.tables[l] = h[order], np.array(ids, np.int32)[order], (alpha * weights[ids])[order], some

    def find(self, data: np.ndarray, sums: np.ndarray, l: int, able: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece (or -1) and weight of the l bytes from each place of data on; able has the lengths that a place's first three bytes allow."""
        n = max(0, len(data) - l + 1)
        ids, weights = np.full(len(data), -1, np.int32), np.full(len(data), -np.inf, np.float32)
        if l in self.tables and n:
            known, pieces, values, some = self.tables[l]
            at = np.arange(n) if l < 3 else np.flatnonzero(able[:n] & np.uint32(1 << l))
            h = _substrings(data, at, l, sums)
            maybe = np.flatnonzero(some[h >> np.uint64(48)])
            at, h = at[maybe], h[maybe]
            i = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[i] == h
            ids[at[hit]], weights[at[hit]] = pieces[i[hit]], values[i[hit]]
        return ids, weights


def _triple(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (a * 1031 + b * 37 * 257 + c * 65_537 * 3) & ((1 << 18) - 1)


def _sums(data: np.ndarray) -> np.ndarray:
    up, _ = _powers(1 << max(20, len(data).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def _substrings(data: np.ndarray, at: np.ndarray, l, sums: np.ndarray | None = None) -> np.ndarray:
    """A hash of the l bytes from each place on."""
    sums = _sums(data) if sums is None else sums
    _, down = _powers(1 << max(20, len(data).bit_length()))
    with np.errstate(over="ignore"):
        return mix((sums[at + l] - sums[at]) * down[at] + np.asarray(l).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@functools.cache
def model(model_file: str, alpha: float) -> Model:
    return Model(model_file, alpha)


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each run."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _filter(m: Model, data: np.ndarray, offs: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward filtering of runs of data; lens must not rise. For each end place: the cumulative chances of the last piece's length, and
    for each start place and length the piece."""
    size, most = len(data), m.most
    sums = _sums(data)
    ids, weights = np.empty((most + 1, size), np.int32), np.empty((most + 1, size), np.float32)
    wide = data.astype(np.int64)
    able = np.zeros(size, np.uint32)
    if size > 2:
        able[: size - 2] = m.starting[_triple(wide[:-2], wide[1:-1], wide[2:])]
    for l in range(1, most + 1):
        ids[l], weights[l] = m.find(data, sums, l, able)
    # characters without a piece are spelled by bytes
    lead = (data & 0xC0) != 0x80
    width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
    known = np.zeros(size, bool)
    for l in range(1, 5):
        if l <= most:
            known |= lead & (width == l) & (ids[l] >= 0)
    at = np.flatnonzero(lead & ~known)
    raw = _ragged(at, np.minimum(width[at], size - at))
    ids[1][raw], weights[1][raw] = m.byte_ids[data[raw]], BYTE_WEIGHT
    # place t of run r is at base[r] + t; place 0 is the run's start
    base = offs + np.arange(len(offs))
    alpha = np.full(size + len(offs), -np.inf)
    alpha[base] = 0
    chances = np.zeros((size + len(offs), most), np.float32)
    active = len(lens)
    for t in range(1, int(lens[0]) + 1 if len(lens) else 1):
        active = int(np.searchsorted(-lens, -t, "right"))
        top = min(t, most)
        grid = np.empty((top, active))
        for l in range(1, top + 1):
            grid[l - 1] = alpha[base[:active] + t - l] + weights[l][offs[:active] + t - l]
        high = grid.max(axis=0)
        np.subtract(grid, np.where(np.isfinite(high), high, 0), out=grid)
        np.exp(grid, out=grid)
        total = grid.sum(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha[base[:active] + t] = high + np.log(total)
            np.cumsum(grid, axis=0, out=grid)
            grid /= total
        chances[base[:active] + t, :top] = grid.T
        chances[base[:active] + t, top:] = 2
    return chances, ids


def _edges(m: Model, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, piece and weight of the edges within data (whole characters), by end and then length."""
    sums, size = _sums(data), len(data)
    wide, able = data.astype(np.int64), np.zeros(size, np.uint32)
    if size > 2:
        able[: size - 2] = m.starting[_triple(wide[:-2], wide[1:-1], wide[2:])]
    lead = (data & 0xC0) != 0x80
    width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
    known, found = np.zeros(size, bool), []
    for l in range(1, m.most + 1):
        ids, weights = m.find(data, sums, l, able)
        at = np.flatnonzero(ids >= 0)
        found.append((at, at + l, ids[at], weights[at].astype(float)))
        if l < 5:
            known[at] |= width[at] == l
    at = np.flatnonzero(lead & ~known)  # spelled by bytes
    raw = _ragged(at, np.minimum(width[at], size - at))
    found.append((raw, raw + 1, m.byte_ids[data[raw]], np.full(len(raw), BYTE_WEIGHT)))
    start, end, ids, weights = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((-start, end))
    return start[order], end[order], ids[order], weights[order]


def _draws(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for each row key and place."""
    with np.errstate(over="ignore"):
        return (mix(key + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)


def long_run(m: Model, run: np.ndarray, key: np.uint64, place: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Starts and pieces of one run of any length, which begins at `place` of its text: as encode, but a window at a time."""
    heads = np.append(np.flatnonzero((run & 0xC0) != 0x80), len(run))
    cuts = [0]
    while cuts[-1] < len(run):
        cuts.append(int(heads[max(np.searchsorted(heads, min(cuts[-1] + window, len(run)), "right") - 1, np.searchsorted(heads, cuts[-1], "right"))]))
    logs = np.full(len(run) + 1, -np.inf)
    logs[0] = 0

    def edges(a: int, b: int):
        """Where the slice starts, and the edges that end in (a, b]."""
        base = int(heads[max(0, np.searchsorted(heads, max(0, a - m.most), "right") - 1)])
        start, end, ids, weights = _edges(m, run[base:b])
        own = end > a - base
        return base, start[own], end[own], ids[own], weights[own]

    for a, b in zip(cuts, cuts[1:]):
        base, start, end, _, weights = edges(a, b)
        la = logs[base : b + 1].tolist()
        group = np.flatnonzero(np.diff(end, prepend=-1, append=-1))
        start, end, weights = start.tolist(), end.tolist(), weights.tolist()
        for i, j in zip(group.tolist(), group[1:].tolist()):
            if j - i == 1:
                la[end[i]] = la[start[i]] + weights[i]
            else:
                v = [la[x] + w for x, w in zip(start[i:j], weights[i:j])]
                top = max(v)
                la[end[i]] = top + math.log(sum([math.exp(x - top) for x in v])) if top > -math.inf else top
        logs[base : b + 1] = la
    p, starts, pieces = len(run), [], []
    for a, b in zip(cuts[-2::-1], cuts[:0:-1]):
        if p <= a:
            continue
        base, start, end, ids, weights = edges(a, b)
        first = np.searchsorted(end, np.arange(a - base, b - base + 2)).tolist()
        draw = _draws(key, np.arange(place + a, place + b + 1)).tolist()
        la, start, ids, weights = logs[base : b + 1].tolist(), start.tolist(), ids.tolist(), weights.tolist()
        while p > a:
            i, j = first[p - a], first[p - a + 1]
            if j - i > 1:
                v = [la[x] + w for x, w in zip(start[i:j], weights[i:j])]
                top = max(v)
                sums = list(itertools.accumulate([math.exp(x - top) for x in v]))
                i += bisect.bisect_right(sums, draw[p - a] * sums[-1], 0, j - i - 1)
            p = base + start[i]
            starts.append(p)
            pieces.append(ids[i])
    return np.array(starts[::-1], np.int64), np.array(pieces[::-1], np.int32)


def encode(m: Model, data: np.ndarray, at: np.ndarray, keys: np.ndarray, long: int = LONG, group: int = GROUP) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of each text, one after another, and how many each has; keys are 64-bit row keys."""
    n = len(at) - 1
    sizes = np.diff(at)
    full = np.flatnonzero(sizes > 0)
    if not len(full):
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    # a space before each text that isn't empty
    first = at[:-1][full] + np.arange(len(full))
    text = np.full(int(sizes.sum()) + len(full), SPACE, np.uint8)
    inner = np.ones(len(text), bool)
    inner[first] = False
    text[inner] = data
    space = text == SPACE
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[first] = True
    starts = np.flatnonzero(start)
    lens = np.diff(np.append(starts, len(text)))
    row = np.searchsorted(first, starts, "right") - 1
    key, place = keys[full][row], starts - first[row]
    found = np.full(len(text), -1, np.int32)
    for i in np.flatnonzero(lens > long).tolist():
        where, ids = long_run(m, text[starts[i] : starts[i] + lens[i]], key[i], int(place[i]))
        found[starts[i] + where] = ids
    short = lens <= long
    starts, lens, key, place = starts[short], lens[short], key[short], place[short].astype(np.uint64)
    h = _substrings(text, starts, lens)
    _, which, back = np.unique(h, return_index=True, return_inverse=True)
    order = np.argsort(-lens[which], kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    which, back = which[order], rank[back]
    cuts = np.searchsorted(np.cumsum(lens[which]), np.arange(0, int(lens[which].sum()) + group, group)) if len(which) else []
    for a, b in zip(cuts, [*cuts[1:], len(which)]):  # distinct runs of about `group` bytes at once
        if a < b:
            _sample(m, text, which[a:b], back - a, (back >= a) & (back < b), starts, lens, key, place, found)
    got = found >= 0
    counts = np.zeros(n, np.int64)
    counts[full] = np.add.reduceat(got, first)
    return found[got], counts


def _sample(m: Model, text: np.ndarray, which: np.ndarray, back: np.ndarray, own: np.ndarray, starts: np.ndarray, lens: np.ndarray, key: np.ndarray, place: np.ndarray, found: np.ndarray) -> None:
    """Filter some distinct runs, and sample all their occurrences (own) at once into found."""
    run_lens = lens[which]
    offs = np.cumsum(run_lens) - run_lens
    chances, ids = _filter(m, text[_ragged(starts[which], run_lens)], offs, run_lens)
    starts, key, place, pos, back = starts[own], key[own], place[own], lens[own], back[own]
    off, base = offs[back], offs[back] + back
    live = np.arange(len(starts))
    with np.errstate(over="ignore"):
        while len(live):
            p = pos[live]
            u = _draws(key[live], place[live] + p.astype(np.uint64))
            l = (chances[base[live] + p] <= u[:, None]).sum(axis=1) + 1
            p = p - l
            pos[live] = p
            found[starts[live] + p] = ids[l, off[live] + p]
            live = live[p > 0]


def decode(m: Model, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts that the pieces spell."""
    lengths = m.lengths[ids]
    data = m.bytes[_ragged(m.starts[ids], lengths)]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    at = ends[np.concatenate([[0], np.cumsum(counts)])]
    keep = np.ones(len(data), bool)
    full = np.flatnonzero(np.diff(at) > 0)
    keep[at[:-1][full]] = False
    gone = np.zeros(len(at), np.int64)
    gone[1:] = np.cumsum(np.diff(at) > 0)
    return data[keep], at - gone


def sampled_pieces(docs: DataFrame, model_file: str, seed: int = 3, alpha: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows' key, with ids array<int>, n_ids, n_bytes, decoded_sha256 and lossless (the decoded bytes are the text's). No shuffle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_file, alpha)
        for rows, data, at in text_chunks(batches, "text", CHUNK):
            own = np.asarray(rows.column(1).fill_null(0), np.int64).view(np.uint64)
            ids, counts = encode(m, data, at, mix(own + np.uint64(seed)))
            out, where = decode(m, ids, counts)
            raw, said = data.tobytes(), out.tobytes()
            pairs = [(raw[a:b], said[c:d]) for a, b, c, d in zip(at[:-1].tolist(), at[1:].tolist(), where[:-1].tolist(), where[1:].tolist())]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([rows.column(0), lists, pa.array(counts), pa.array(np.diff(at)), pa.array([hashlib.sha256(b).hexdigest() for _, b in pairs]), pa.array([a == b for a, b in pairs])], ["key", "ids", "n_ids", "n_bytes", "decoded_sha256", "lossless"])

    keyed = F.col(key).cast("long")
    return small_batches(docs).select(keyed.alias("key"), F.coalesce(keyed, F.lit(0)).alias("k"), F.col(text).alias("text")).mapInArrow(each, "key long, ids array<int>, n_ids long, n_bytes long, decoded_sha256 string, lossless boolean").withColumnRenamed("key", key)
