"""MinHash near-duplicates: a signature-coordinate inverted join, then exact similarity on full shingle sets.

1. A document's set of k-word shingles gets a signature of N coordinates. Equal sets are one class from here on.
2. Classes are posted under each (coordinate, value) pair of their prefix, the first N - MATCH + 1 coordinates: two signatures
   that agree in MATCH coordinates share one of them. Lists are merged by counting agreements coordinate by coordinate, skipping
   pairs that can no longer reach MATCH. Of the pairs that do, a list emits a spanning forest, so as many rows as it has members.
   A list of over LIST members is split into blocks; a cell takes two blocks.
3. The forests' components are candidate clusters. Their members' texts are read again, and a cluster's sets are intersected exactly,
   each with those that no link has reached yet. A large cluster is dealt over parts of bounded size, which are linked within
   themselves and with one set of the cluster. What that leaves unconnected is compared with all parts, by parity sketches as long as the
   sets have hashes at first; the pairs that these don't rule out make smaller clusters, which are gone through likewise, with full sets at the end.
4. Components of those links, over classes, give each document the smallest doc_id that it is linked with over any number of links.

MATCH follows from the similarity: a pair that just has it falls below with probability MISS at most (for 0.85, MATCH is 42).
Apart from that the result is exact, for groups of any size. A group of m copies that are all like one of them costs about m comparisons;
one of which nothing is linked costs m * m, spread over cells. Sets are named by 128 bits.

A document without words has no shingles and no links. Null doc_ids are linked like others but are nobody's component_id unless all
are null; rows that repeat a doc_id are documents of their own; rows that repeat a text are one class. Texts of any length are read whole, one
at least at a time. An empty table has no rows. Extra columns are ignored, and kept by without_near_duplicates whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, components, discard, fixed_binary, fixed_matrix, forest, hot_join, mark, mix, shingle_hashes, small_batches, text_chunks, whole_groups, word_hashes, words, written

N = 64
MISS = 5e-5
LIST = 2048
CELL = 100_000  # shingles of a block of a cluster
SKETCHES = 4_000_000  # bytes of a block of its sketches
MORE = 4  # times the bytes of large clusters, that their cells may take without these
FEW = 500_000  # keys of documents that are broadcast, at most: some 30 MB

_SALTS = mix(np.arange(1, N + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def least_matches(percent: int, n: int = N, miss: float = MISS) -> int:
    """The most agreements of n that a pair of this similarity reaches but with probability `miss`."""
    j, below = percent / 100, 0.0
    for t in range(n + 1):
        below += comb(n, t) * j**t * (1 - j) ** (n - t)
        if below > miss:
            return t
    return n


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, in ascending order, and where each text's begin (with the end)."""
    n = len(at) - 1
    starts, ends, row = words(data, at)
    h, r = shingle_hashes(word_hashes(data, starts, ends), row, n, k)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(r, minlength=n))])


def names_of(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 128-bit name of each set, as two numbers; zeros if it is empty."""
    full = np.flatnonzero(np.diff(at) > 0)
    out = np.zeros((len(at) - 1, 2), np.uint64)
    with np.errstate(over="ignore"):
        if len(full):
            a = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), at[full])
            b = np.add.reduceat(mix(h * np.uint64(0x2545F4914F6CDD1D) + np.uint64(0x14057B7EF767814F)), at[full])
            out[full, 0], out[full, 1] = mix(a), mix(b + mix(a))
    return out


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each set, N minima of its hashes under different multipliers; an empty set has zeros."""
    full = np.flatnonzero(np.diff(at) > 0)
    out = np.zeros((len(at) - 1, N), np.uint32)
    if len(full):
        with np.errstate(over="ignore"):
            for i, a in enumerate(_SALTS):
                out[full, i] = np.minimum.reduceat(((h * a) >> np.uint64(32)).astype(np.uint32), at[full])
    return out


def signed(docs: DataFrame, k: int, prefix: int) -> DataFrame:
    """doc_id, t (a hash of the text), n_shingles, name, prefix (that many 32-bit values), code (N 8-bit values) of each document. No shuffle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in text_chunks(batches, "text"):
            h, where = shingle_sets(data, at, k)
            sig = signatures(h, where)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(where)), fixed_binary(names_of(h, where)), fixed_binary(sig[:, :prefix]), fixed_binary((sig >> 8).astype(np.uint8))], ["doc_id", "t", "n_shingles", "name", "prefix", "code"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text").mapInArrow(each, "doc_id long, t long, n_shingles long, name binary, prefix binary, code binary")


def matches(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Which pairs of codes agree in `least` coordinates: all pairs' counts at first, then only of those that can still reach it."""
    n = a.shape[1]
    half = n // 2
    count = np.zeros((len(a), len(b)), np.uint8)
    for c in range(half):
        count += a[:, c, None] == b[None, :, c]
    i, j = np.nonzero(count >= max(0, least - (n - half)))
    got = np.zeros((len(a), len(b)), bool)
    for s in range(0, len(i), 1 << 20):
        x, y = i[s : s + (1 << 20)], j[s : s + (1 << 20)]
        total = count[x, y] + (a[x, half:] == b[y, half:]).sum(axis=1)
        got[x[total >= least], y[total >= least]] = True
    return got


def candidate_edges(classes: DataFrame, match: int) -> DataFrame:
    """(src, dst): spanning forests of the pairs that each posting list retains."""
    prefix = N - match + 1

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            for s in range(0, len(batch), 4096):
                part = batch.slice(s, 4096)
                values = fixed_matrix(part.column("prefix"), prefix, np.uint32)
                token = (np.arange(prefix, dtype=np.int64) << 32) | values.astype(np.int64)
                codes = fixed_matrix(part.column("code"), N, np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(token.ravel()), pa.array(np.repeat(node[s : s + 4096], prefix)), fixed_binary(np.repeat(codes, prefix, axis=0))], ["token", "node", "code"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["token", "a", "b"]):
            size = np.diff(starts)
            node, side, split = t.column("node").to_numpy(), t.column("side").to_numpy(), (t.column("a").to_numpy() != t.column("b").to_numpy())
            codes = fixed_matrix(t.column("code"), N, np.uint8)
            two = starts[:-1][size == 2]
            two = two[((codes[two] == codes[two + 1]).sum(axis=1) >= match) & (~split[two] | (side[two] != side[two + 1]))]
            src, dst = [node[two]], [node[two + 1]]
            for s, n in zip(starts[:-1][size > 2].tolist(), size[size > 2].tolist()):
                own = codes[s : s + n]
                links = matches(own, own, match) if not split[s] else np.zeros((n, n), bool)
                if split[s]:
                    x, y = np.flatnonzero(side[s : s + n] == 0), np.flatnonzero(side[s : s + n] == 1)
                    got = matches(own[x], own[y], match)
                    links[np.ix_(x, y)] = got
                    links[np.ix_(y, x)] = got.T
                edges = forest(links)
                if edges:
                    e = np.array(edges) + s
                    src.append(node[e[:, 0]])
                    dst.append(node[e[:, 1]])
            got = pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])
            if len(got):
                yield got

    postings = classes.select("node", "prefix", "code").mapInArrow(post, "token long, node long, code binary")
    counts = postings.groupBy("token").agg(F.count("*").alias("_n")).filter(F.col("_n") > LIST)
    counts = written(counts.select("token", F.ceil(F.col("_n") / LIST).cast("int").alias("parts")), "near-lists")
    if counts.head(1):
        few = counts.count() <= 100_000  # 16 bytes each
        rows = postings.join(F.broadcast(counts) if few else counts.hint("merge"), "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        rows = rows.withColumn("_p", part).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.select("token", F.least("_p", "_o").alias("a"), F.greatest("_p", "_o").alias("b"), F.when(F.col("_p") <= F.col("_o"), 0).otherwise(1).alias("side"), "node", "code")
    else:
        rows = postings.select("token", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"), "node", "code")
    dealt = rows.repartition("token", "a", "b").sortWithinPartitions("token", "a", "b", "node")
    return dealt.mapInArrow(merge, "src long, dst long")


def exact_forest(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links (100 * intersection >= percent * union) among sets, or between the two sides.

    A set is compared with those that nothing has reached yet, so a group whose sets are all like its first costs one comparison each.
    """
    sizes = np.array([len(x) for x in sets])
    names, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    common = df[token] > 1
    token, owner = token[common], owner[common]
    first = np.searchsorted(owner, np.arange(len(sets) + 1))
    mark = np.zeros(len(names), bool)
    left = np.ones(len(sets), bool)
    edges = []
    for i in range(len(sets)):
        if not left[i]:
            continue
        left[i] = False
        front = [i]
        while front:
            j = front.pop()
            own = token[first[j] : first[j + 1]]
            fits = left & (100 * np.minimum(sizes, sizes[j]) >= percent * np.maximum(sizes, sizes[j]))
            if side is not None:
                fits &= side != side[j]
            if not fits.any():
                continue
            mark[own] = True
            at = np.flatnonzero(fits[owner]) if fits.sum() < len(sets) // 2 else slice(None)
            both = np.bincount(owner[at], mark[token[at]], len(sets))
            mark[own] = False
            new = np.flatnonzero(fits & (100 * both >= percent * (sizes + sizes[j] - both)))
            left[new] = False
            edges += [(j, int(x)) for x in new]
            front += new.tolist()
    return edges


def _forests(cells: DataFrame, percent: int) -> DataFrame:
    """(src, dst): the forests of cells (component, a, b, side, node, shingles); with a <> b, between sides only.

    In a cell within a part, nodes that aren't connected there with the component's smallest node, which every part has, come with a null dst.
    """

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["component", "a", "b"]):
            node, side = t.column("node").to_numpy(), t.column("side").to_numpy()
            split = t.column("a").to_numpy() != t.column("b").to_numpy()
            raw = t.column("shingles")
            src, dst = [], []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if e - s < 2:
                    continue
                own = [np.frombuffer(raw[x].as_py(), np.uint64) for x in range(s, e)]
                edges = exact_forest(own, percent, side[s:e] if split[s] else None)
                reached = {0}  # the smallest node is the first, and edges lead on from where they start
                for i, j in edges:
                    src.append(int(node[s + i]))
                    dst.append(int(node[s + j]))
                    if i in reached:
                        reached.add(j)
                if not split[s]:
                    loose = [int(node[s + i]) for i in range(e - s) if i not in reached]
                    src += loose
                    dst += [None] * len(loose)
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return cells.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b", "node").mapInArrow(confirm, "src long, dst long")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """text, and the other columns of wanted, of the documents whose id and text it names by rep and rep_t; rows that repeat both follow each other.

    If wanted has FEW rows at most, the documents are looked through where they lie, and only those found are shuffled.
    """
    key = lambda c: [F.coalesce(F.col(c), F.lit(0)).alias("_k"), F.col(c).isNull().alias("_null")]
    wanted = wanted.select(*[c for c in wanted.columns if c not in ("rep", "rep_t")], *key("rep"), F.col("rep_t").alias("_t"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").select("text", *key("_id"), F.xxhash64("text").alias("_t"))
    on = ["_k", "_null", "_t"]
    if wanted.count() <= FEW:
        texts = texts.join(F.broadcast(wanted.select(*on)), on, "left_semi")
    return small_batches(texts).join(wanted.hint("merge"), on).drop(*on)


def confirmed_edges(docs: DataFrame, classes: DataFrame, clusters: DataFrame, k: int, percent: int) -> DataFrame:
    """(src, dst): spanning forests of the links within candidate clusters, on full sets.

    A cluster of over CELL shingles is dealt over parts. Each part is linked within itself and with the cluster's smallest class at
    first; only what that leaves unconnected is compared with all parts, by sketches before by sets.
    """
    named = clusters.join(classes.select(F.col("node").alias("id"), "rep", "rep_t", "n_shingles"), "id")
    named = written(named, "near-named")
    sizes = named.groupBy("component").agg(F.count("*").alias("_n"), F.greatest(F.lit(1), F.ceil(F.sum("n_shingles") / CELL)).cast("int").alias("parts"))
    members = written(hot_join(named, written(sizes, "near-sizes"), "component", "_n", named.count()), "near-members")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for rows, data, at in text_chunks(batches, "text"):
            node = rows.column(1).to_pylist()
            own = [i for i, n in enumerate(node) if n != (node[i - 1] if i else last)]  # rows that repeat an id and its text follow each other
            last = node[-1]
            h, where = shingle_sets(data, at, k)
            raw = h.tobytes()
            yield pa.RecordBatch.from_arrays([*(rows.column(i).take(pa.array(own, pa.int64())) for i in (1, 2, 3)), pa.array([raw[8 * where[i] : 8 * where[i + 1]] for i in own], pa.binary())], ["node", "component", "parts", "shingles"])

    texts = texts_of(docs, members.select(F.col("id").alias("node"), "component", "parts", "rep", "rep_t"))
    return _confirmed(written(texts.mapInArrow(sets, "node long, component long, parts int, shingles binary"), "near-sets", "none"), percent)


def _confirmed(rows: DataFrame, percent: int, narrow: bool = True) -> DataFrame:
    """(src, dst): the forests of the links within components of written rows (node, component, parts, shingles)."""
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    cell = lambda f, a, b, side: f.select("component", a.alias("a"), b.alias("b"), side.alias("side"), "node", "shingles")
    small = cell(rows.filter("parts = 1"), F.lit(0), F.lit(0), F.lit(0))
    large = rows.filter("parts > 1")
    if not large.head(1):
        return _forests(small, percent).filter("dst is not null")
    # a component's id is its smallest node: the hub, which goes to every part
    hubs = large.filter("node = component").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_p")).filter(F.col("_p") != part)
    found = written(_forests(cell(large, part, part, F.lit(0)).unionByName(cell(hubs, F.col("_p"), F.col("_p"), F.lit(0))), percent), "near-forests")
    every = found.filter("dst is not null").unionByName(_forests(small, percent).filter("dst is not null"))
    gone = found.filter("dst is null").select(F.col("src").alias("node"))
    if not gone.head(1):
        return every
    loose = written(large.join(gone.hint("merge"), "node", "left_semi"), "near-loose", "none")
    octets = F.sum(F.octet_length("shingles"))
    spread = written(loose.groupBy("component").agg(F.ceil(octets / (8 * CELL)).cast("int").alias("loose_parts"), octets.alias("_l")), "near-spread")
    if narrow:
        whole = large.groupBy("component", "parts").agg(octets.alias("_m")).join(spread.hint("merge"), "component")
        dealt, m = whole.agg(F.sum(F.col("_l") * F.col("parts") + F.col("_m") * F.col("loose_parts")), F.sum("_m")).first()
        if dealt > MORE * m:  # full sets meet only where sketches have left something
            return every.unionByName(_confirmed(_narrowed(large, gone, percent), percent, False))
    spread = spread.drop("_l")
    one = loose.join(spread.hint("merge"), "component").withColumn("_a", F.pmod(F.xxhash64("node"), F.col("loose_parts")).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    all_ = large.join(spread.hint("merge"), "component").withColumn("_a", F.explode(F.sequence(F.lit(0), F.col("loose_parts") - 1)))
    # a below b marks two sides
    across = cell(one, -1 - F.col("_a"), F.col("_b"), F.lit(0)).unionByName(cell(all_, -1 - F.col("_a"), part, F.lit(1)))
    return every.unionByName(_forests(across, percent))


def sketches(h: np.ndarray, percent: int) -> list[tuple[int, bytes]]:
    """A set's parity sketch at each level (sizes by powers of two) where it meets sets: from that of the smallest it can be linked with to its own.

    A level's sketches have a bit for each hash bucket, about as many as the sets have hashes: unlike ones differ in more bits than linked sets may.
    """
    out = []
    for level in range((-(-len(h) * percent // 100)).bit_length() - 1, len(h).bit_length()):
        bits = max(64, 2 << level)
        out.append((level, np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()))
    return out


def sketch_forest(n: np.ndarray, sketch: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs of the two sides that neither sizes nor sketches keep from being linked."""
    own, other = (np.flatnonzero(side == x) for x in (0, 1))
    sides = [x[np.argsort(n[x], kind="stable")] for x in (own, other)]  # by size, so that those that fit lie together
    sizes, bits = [n[x] for x in sides], [sketch[x] for x in sides]
    left = [np.ones(len(x), bool) for x in sides]
    edges = []
    for i in range(len(own)):
        if not left[0][i]:
            continue
        left[0][i] = False
        front = [(0, i)]
        while front:
            s, j = front.pop()
            size = sizes[s][j]
            lo, hi = np.searchsorted(sizes[1 - s], [-(-size * percent // 100), size * 100 // percent + 1])
            at = lo + np.flatnonzero(left[1 - s][lo:hi])
            if not len(at):
                continue
            rest = bits[1 - s][lo:hi] if len(at) == hi - lo else bits[1 - s][at]
            most = (sizes[1 - s][at] + size) * (100 - percent) // (100 + percent)
            new = at[np.bitwise_count(rest ^ bits[s][j]).sum(axis=1, dtype=np.int64) <= most]
            left[1 - s][new] = False
            edges += [(int(sides[s][j]), int(sides[1 - s][x])) for x in new]
            front += [(1 - s, int(x)) for x in new]
    return edges


def _narrowed(large: DataFrame, gone: DataFrame, percent: int) -> DataFrame:
    """The rows of large components that can still be linked with one of the nodes in `gone`, in components of such pairs. Written.

    Sketches meet in cells, not sets: a block of them has some 60 times as many.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("shingles")]
            some = [(i, len(h), *x) for i, h in enumerate(sets) for x in sketches(h, percent)]
            if some:
                row, n, level, bits = zip(*some)
                own = batch.select(["component", "node"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(level, pa.int32()), pa.array(n, pa.int64()), pa.array(bits, pa.binary())], ["component", "node", "level", "n", "sketch"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["component", "level", "a", "b"]):
            node, n, side, level = (t.column(x).to_numpy() for x in ("node", "n", "side", "level"))
            src, dst = [], []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if e - s > 1:
                    width = max(64, 2 << int(level[s])) // 64
                    for i, j in sketch_forest(n[s:e], fixed_matrix(t.column("sketch").slice(s, e - s), width, np.uint64), side[s:e], percent):
                        if node[s + i] != node[s + j]:
                            src.append(int(node[s + i]))
                            dst.append(int(node[s + j]))
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    every = written(small_batches(large).select("component", "node", "shingles").mapInArrow(sketch, "component long, node long, level int, n long, sketch binary"), "near-sketches")
    loose = written(every.join(gone.hint("merge"), "node", "left_semi"), "near-sketches")
    keys = ["component", "level"]
    blocks = lambda f, name: f.groupBy(*keys).agg(F.ceil(F.sum(F.octet_length("sketch")) / SKETCHES).cast("int").alias(name))
    spread = written(blocks(loose, "_x").join(blocks(every, "_y").hint("merge"), keys), "near-spread")
    few = spread.count() <= FEW
    dealt = lambda f: f.join(F.broadcast(spread) if few else spread.hint("merge"), keys)
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    all_ = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cell = lambda f, a, b, side: f.select(*keys, a.alias("a"), "_y", "node", "n", "sketch").select(*keys, "a", b.alias("b"), F.lit(side).alias("side"), "node", "n", "sketch")
    cells = cell(dealt(loose), own("_x"), all_("_y"), 0).unionByName(cell(dealt(every), all_("_x"), own("_y"), 1))
    met = cells.repartition(*keys, "a", "b").sortWithinPartitions(*keys, "a", "b", "node", "side").mapInArrow(meet, "src long, dst long")
    named = components(written(met, "near-met"))
    rows = written(large.drop("component", "parts").join(named.select(F.col("id").alias("node"), "component").hint("merge"), "node"), "near-sets", "none")
    sizes = rows.groupBy("component").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.octet_length("shingles")) / (8 * CELL))).cast("int").alias("parts"), F.count("*").alias("_n"))
    return hot_join(rows, written(sizes, "near-sizes"), "component", "_n", rows.count()).select("node", "component", "parts", "shingles")


def _least(doc_id: str, t: str):
    """The smallest (doc_id, t), null ids last."""
    return F.min(F.struct(F.col(doc_id).isNull(), F.col(doc_id).alias("doc_id"), F.col(t).alias("t")))


def classes_of(rows: DataFrame, *more: str) -> DataFrame:
    """Equal sets as one row: node (a number of its own), name, rep and rep_t (the smallest document), n_shingles, n_docs, and more columns. Written."""
    some = rows.filter("n_shingles > 0").groupBy("name").agg(_least("doc_id", "t").alias("r"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n_docs"), *[F.first(c).alias(c) for c in more])
    return written(some.select(F.monotonically_increasing_id().alias("node"), "name", F.col("r.doc_id").alias("rep"), F.col("r.t").alias("rep_t"), "n_shingles", "n_docs", *more), "near-classes")


def grouped(docs: DataFrame, rows: DataFrame, classes: DataFrame, candidates: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, t, n_shingles, component_id, first of each document, from candidate edges between classes."""
    spark, start = docs.sparkSession, mark()
    clusters = written(components(candidates), "near-clusters")
    discard(spark, start, "edges")
    links = written(confirmed_edges(docs, classes, clusters, k, percent), "near-links")
    discard(spark, start, "edges", "near-named", "near-sizes", "near-members", "near-sets", "near-forests", "near-loose", "near-spread", "near-sketches", "near-met")
    joined = components(links)
    named = classes.select("node", "name", "rep", "rep_t", "n_docs").join(joined.select(F.col("id").alias("node"), "component").hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = written(named, "near-components")
    best = named.groupBy("component").agg(_least("rep", "rep_t").alias("b"), F.count("*").alias("_n"))
    final = written(hot_join(named, written(best, "near-best"), "component", "_n", classes.count()).select("name", "b", "n_docs"), "near-final")
    found = hot_join(rows.filter("n_shingles > 0").select("doc_id", "t", "n_shingles", "name"), final, "name", "n_docs", rows.count())
    found = found.select("doc_id", "t", "n_shingles", F.col("b.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("t") == F.col("b.t"))).alias("first"))
    return found.unionByName(rows.filter("n_shingles = 0").select("doc_id", "t", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first")))


def linked(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, t, n_shingles, component_id, first of each document: whether it has the smallest id, and of its texts the one with the smallest hash."""
    match = least_matches(percent)
    rows = written(signed(docs, k, N - match + 1), "near-signed")
    classes = classes_of(rows, "prefix", "code")
    return grouped(docs, rows, classes, candidate_edges(classes, match), k, percent)


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document."""
    return linked(docs, k, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which each group of near-duplicates keeps one, with all their columns.

    That is the one with the smallest doc_id (null ids last), of its texts the one with the smallest hash, of rows that repeat both
    any one. Documents without words all stay.
    """
    found = written(linked(docs, k, percent).filter("n_shingles > 0"), "near-found")
    gone = found.filter("not first").select(F.col("doc_id").alias("_k"), F.col("t").alias("_t")).distinct()
    rows = carried(docs).select("row", F.col("row.doc_id").cast("long").alias("k"), F.xxhash64("row.text").alias("t"))
    same = lambda other: F.col("k").eqNullSafe(other["_k"]) & (F.col("t") == other["_t"])
    kept = rows.join(gone.hint("merge"), same(gone), "left_anti")
    again = written(found.filter("first").groupBy(F.col("doc_id").alias("_k"), F.col("t").alias("_t")).count().filter("count > 1").drop("count"), "near-again")
    if again.head(1):  # rows that repeat an id and its text
        kept = kept.join(again.hint("merge"), same(again), "left_anti").unionByName(kept.join(again.hint("merge"), same(again), "left_semi").dropDuplicates(["k", "t"]))
    return kept.select("row.*")
