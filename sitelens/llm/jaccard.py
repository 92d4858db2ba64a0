"""Exact Jaccard self-join of word n-gram sets, by a partition of the universe of tokens.

1. Sizes are banded by powers of two. A band hashes all tokens into segments, and a set of the band posts the hash of each segment's
   subset (empty subsets are not posted). Of two sets that link, the larger one asks: in its own band, and in the band below as far
   as the similarity lets sizes differ.
2. Let T be the most by which the two can differ. If no subset of the asking set, of those in E segments that it has tokens in,
   equals the other's, they differ in every one of them; so T + 1 segments are enough, and E - T - 1 may be left out. A set with
   fewer posts one-deletion neighbourhoods too: its subsets of T // 2 + T + 1 - E segments without one token each. The other set is no
   larger, so at most T // 2 of these segments can differ by one token that only the other has; each of the rest that isn't found
   so differs by two, and again the sum exceeds T.
3. Postings are grouped by hash, and those that stand alone vanish: they cost nothing. What is left is allocated by cost: each
   asking set leaves out as many of its longest lists as it may, exact lengths over all documents being known by now. Most sets, and most
   lists of passages that many documents share, are done with that.
4. In the lists that are still asked, a parity sketch (a bit for each hash bucket, whose difference never exceeds the sets') drops pairs, and
   each list emits a spanning forest of the rest. Full sets confirm, as in `near`.

Tokens and subsets are 64-bit hashes, sets 128-bit names. Equal sets are one class, so groups of copies cost one set. A set that has too
few segments even for step 2 is joined on a prefix of its tokens with all others' (`_by_tokens`); lists of over LIST members are split into
blocks and meet in cells. Nothing is left out at any length, so the result is exact.

A document without words has no shingles and no links; one with fewer than k words has one shingle of them all. Null doc_ids are linked
like others but are nobody's component_id unless all are null; rows that repeat an id or a text are documents of their own. Texts are
read whole, whatever their length. An empty table has no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fixed_binary, fixed_matrix, hot_join, mark, mix, shingle_hashes, small_batches, text_chunks, whole_groups, word_hashes, words, written
from .near import classes_of, grouped, names_of, shingle_sets, texts_of

SHARE = 1.3  # segments that a set posts, as a multiple of those that it needs if all hold tokens
MORE = 8  # and so many besides
WHOLE = 128  # bands that end below this post all segments
LIST = 2048
BITS = 1024  # of a sketch
TURNS = 2  # in which postings are dealt, each of some of the keys, so that not all of them are on disk at once
INDEX, ASK, BELOW, DELETION = 1, 2, 4, 8  # what a posting is: to be found, to find; in the band below the set's own; without one token


class Plan:
    """Segments and limits for a similarity of percent / 100."""

    def __init__(self, percent: int):
        if not 51 <= percent <= 100:
            raise ValueError("percent must be from 51 to 100")
        self.percent = percent
        self.slope = SHARE * 2 * (100 - percent) / (100 + percent) * 100 / percent

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most by which linked sets of these sizes differ."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def segments(self, band: np.ndarray) -> np.ndarray:
        """How many segments a band has."""
        return np.ceil(self.slope * ((2 << band) - 1)).astype(np.int64) + np.where(2 << band > WHOLE, MORE, 1)

    def posted(self, size: np.ndarray, band: np.ndarray) -> np.ndarray:
        """How many segments, from the first, a set of this size is to be found by in a band."""
        most = self.segments(band)
        return np.where(2 << band > WHOLE, np.minimum(most, np.ceil(self.slope * size).astype(np.int64) + MORE), most)

    def least(self, size: np.ndarray) -> np.ndarray:
        """The smallest size that a set of this size can be linked with."""
        return -(-size * self.percent // 100)

    def asks_below(self, size: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Which sets can be linked with some of the band below."""
        return (band > 0) & (self.least(size) < (1 << band))


def _band(size: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.frexp(size.astype(float))[1] - 1).astype(np.int64)


def _asked(plan: Plan, h: np.ndarray, at: np.ndarray, below: bool):
    """For each set: band asked, segments posted, segments asked, needed; and each token's set and segment, as far as posted."""
    size = np.diff(at)
    own = _band(size)
    band = own - 1 if below else own
    in_it = (size > 0) & (plan.asks_below(size, own) if below else True)
    band = np.maximum(band, 0)
    low = np.maximum(1 << band, plan.least(size))
    asked = np.where(in_it, plan.posted(low, band), 0)
    posted = np.where(in_it & (not below), plan.posted(size, band), asked)
    need = plan.differ(np.minimum(size, (2 << band) - 1), size) + 1
    row = np.repeat(np.arange(len(size)), size)
    with np.errstate(over="ignore"):
        spread = mix(h * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(32)
    segment = ((spread * plan.segments(band)[row].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    kept = np.flatnonzero(segment < posted[row])
    return band, posted, asked, need, row[kept], segment[kept], kept


def _spare(asked, need, posted, row, segment):
    """Segments with tokens that each set asks by, beyond those needed; and how many tokens each segment has (by set, from offsets)."""
    offset = np.concatenate([[0], np.cumsum(posted)])
    count = np.bincount(offset[row] + segment, minlength=offset[-1])
    owner = np.repeat(np.arange(len(posted)), posted)
    inside = np.arange(offset[-1]) - offset[owner] < asked[owner]
    return np.bincount(owner, (count > 0) & inside, len(posted)).astype(np.int64) - need, count, offset, owner, inside


def _neighbourhoods(plan: Plan, need, spare, count, owner, inside) -> tuple[np.ndarray, np.ndarray]:
    """The segments of which short sets post one-deletion neighbourhoods, and which sets have too few of them."""
    short = np.maximum(0, -spare)
    wanted = np.where(short > 0, (need - 1) // 2 + short, 0)
    can = (count > 1) & inside & (wanted[owner] > 0)
    before = np.cumsum(can) - can
    first = np.searchsorted(owner, np.arange(len(need)))
    start = np.append(before, can.sum())[np.minimum(first, len(before))]
    chosen = can & (before - start[owner] < wanted[owner])
    return chosen, np.bincount(owner, chosen, len(need)).astype(np.int64) < wanted


def described(docs: DataFrame, k: int, plan: Plan) -> DataFrame:
    """doc_id, t, n_shingles, name, short (the name's first half), sketch, spare and spare_below, weak (no segments enough) of each document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in text_chunks(batches, "text"):
            h, where = shingle_sets(data, at, k)
            size = np.diff(where)
            names = names_of(h, where)
            bit = (mix(h ^ np.uint64(0xD1B54A32D192ED03)) & np.uint64(BITS - 1)).astype(np.int64)
            owner = np.repeat(np.arange(len(size)), size)
            sketch = np.packbits((np.bincount(owner * BITS + bit, minlength=len(size) * BITS) & 1).astype(np.uint8).reshape(len(size), BITS), axis=1)
            spares, weak = [], np.zeros(len(size), bool)
            for below in (False, True):
                _, posted, asked, need, row, segment, _ = _asked(plan, h, where, below)
                spare, count, _, of, inside = _spare(asked, need, posted, row, segment)
                spare = np.where(asked > 0, spare, 0)
                weak |= _neighbourhoods(plan, need, spare, count, of, inside)[1]
                spares.append(pa.array(spare))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(size), fixed_binary(names), pa.array(names[:, 0].view(np.int64)), fixed_binary(sketch), *spares, pa.array(weak)], ["doc_id", "t", "n_shingles", "name", "short", "sketch", "spare", "spare_below", "weak"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text").mapInArrow(each, "doc_id long, t long, n_shingles long, name binary, short long, sketch binary, spare long, spare_below long, weak boolean")


def postings(docs: DataFrame, k: int, plan: Plan, turn: int = 0, turns: int = 1) -> DataFrame:
    """key, short, kind: the posted subsets and deletions of all sets, of the keys whose turn (of `turns`) it is. A task posts a set once,
    however many copies it reads."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, data, at in text_chunks(batches, "text"):
            h, where = shingle_sets(data, at, k)
            name = names_of(h, where)[:, 0].view(np.int64)
            own, first = np.unique(name, return_index=True)
            new = np.sort(first[[x not in seen for x in own.tolist()]])
            seen.update(name[new].tolist())
            new = new[np.diff(where)[new] > 0]
            if not len(new):
                continue
            h = np.concatenate([h[where[i] : where[i + 1]] for i in new])
            name, at = name[new], np.concatenate([[0], np.cumsum(np.diff(where)[new])])
            for below in (False, True):
                band, posted, asked, need, row, segment, kept = _asked(plan, h, at, below)
                if not len(row):
                    continue
                spare, count, offset, owner, inside = _spare(asked, need, posted, row, segment)
                with np.errstate(over="ignore"):
                    token = mix(h[kept] ^ np.uint64(0xA0761D6478BD642F))
                    place = offset[row] + segment
                    order = np.argsort(place, kind="stable")
                    full = np.flatnonzero(count)
                    sums = np.add.reduceat(token[order], np.concatenate([[0], np.cumsum(count[full])[:-1]]))
                    salt = mix((band[owner[full]] << 32 | (full - offset[owner[full]])).astype(np.uint64) + np.uint64(0xE7037ED1A0B428DB))
                    keys = [mix(sums + salt)]
                    kinds = [np.where(inside[full], ASK, 0) | (BELOW if below else INDEX)]
                    who = [owner[full]]
                    chosen = np.flatnonzero(_neighbourhoods(plan, need, np.where(asked > 0, spare, 0), count, owner, inside)[0][place])
                    if len(chosen):
                        of = np.searchsorted(full, place[chosen])
                        keys.append(mix(sums[of] - token[chosen] + salt[of]))
                        kinds.append(np.full(len(chosen), ASK | DELETION | (BELOW if below else 0)))
                        who.append(row[chosen])
                key, who, kind = np.concatenate(keys), np.concatenate(who), np.concatenate(kinds).astype(np.int8)
                now = key % np.uint64(turns) == turn
                yield pa.RecordBatch.from_arrays([pa.array(key[now].view(np.int64)), pa.array(name[who[now]]), pa.array(kind[now])], ["key", "short", "kind"])

    return small_batches(docs).select("text").mapInArrow(post, "key long, short long, kind byte")


def shared(posted: DataFrame) -> DataFrame:
    """The postings whose key another set has posted too, once each. A stream over sorted rows; no list is held."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone = None  # the last key's rows, a few kinds, while they are of one set
        known = None  # or its last row, if it has two
        for batch in batches:
            t = pa.Table.from_batches([batch] if alone is None else [alone, batch])
            if not len(t):
                continue
            key, short, kind = (t.column(c).to_numpy() for c in ("key", "short", "kind"))
            same = key[1:] == key[:-1]
            edge = np.flatnonzero(np.concatenate([[True], ~same]))
            two = short[edge] != short[np.append(edge[1:], len(key)) - 1]
            again = np.concatenate([[False], same & (short[1:] == short[:-1]) & (kind[1:] == kind[:-1])])
            if known is not None and known[0] == key[0]:
                two[0], again[0] = True, known == (key[0], short[0], kind[0])
            run = np.cumsum(np.concatenate([[0], ~same]))
            got = t.filter(pa.array(two[run] & ~again))
            tail = np.flatnonzero((run == run[-1]) & ~again)
            alone, known = (None, (key[-1], short[-1], kind[-1])) if two[-1] else (t.take(pa.array(tail)).combine_chunks().to_batches()[0], None)
            yield from got.to_batches()

    dealt = posted.repartition("key").sortWithinPartitions("key", "short", "kind")
    return dealt.mapInArrow(keep, "key long, short long, kind byte")


def candidate_edges(docs: DataFrame, classes: DataFrame, k: int, plan: Plan) -> DataFrame:
    """(src, dst) between classes: spanning forests of the pairs that no list and no sketch rules out."""
    start, found = mark(), None
    for turn in range(TURNS):
        some = written(shared(postings(docs, k, plan, turn, TURNS)), "jaccard-shared")
        discard(docs.sparkSession, start)  # its shuffle, the largest of all
        found = some if found is None else found.unionByName(some)
    is_ = lambda bit: F.col("kind").bitwiseAND(F.lit(bit)) != 0
    lists = found.groupBy("key").agg(F.count("*").alias("_n"), F.sum(is_(INDEX).cast("int")).alias("indexed")).filter("indexed > 0")
    lists = written(lists.withColumn("length", F.col("_n")), "jaccard-lists")
    listed = hot_join(found, lists, "key", "_n", found.count()).filter("length is not null")
    own = classes.select("short", "node", "spare", "spare_below")
    met = listed.join(own.hint("merge"), "short").withColumn("below", is_(BELOW))
    # lists in which an asking set finds another: whole subsets may be left out, the longest first
    asks = is_(ASK) & (F.col("indexed") > is_(INDEX).cast("int"))
    free = asks & ~is_(DELETION)
    rank = F.row_number().over(Window.partitionBy("node", "below", free).orderBy(F.desc("length"), "key"))
    spare = F.greatest(F.lit(0), F.when(F.col("below"), F.col("spare_below")).otherwise(F.col("spare")))
    marked = met.withColumn("asks", asks & (is_(DELETION) | (rank > spare))).select("key", "node", "length", "asks")
    marked = written(marked, "jaccard-marked")
    discard(docs.sparkSession, start, "jaccard-shared", "jaccard-lists")
    wanted = written(marked.groupBy("key").agg(F.count("*").alias("_n"), F.max("asks").alias("wanted")).filter("wanted").select("key", "_n", F.ceil(F.col("_n") / LIST).cast("int").alias("parts")), "jaccard-wanted")
    rows = hot_join(marked, wanted, "key", "_n", marked.count()).filter("parts is not null").select("key", "node", "parts").distinct()
    rows = rows.join(classes.select("node", "n_shingles", "sketch").hint("merge"), "node")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    rows = rows.withColumn("_p", part).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = rows.select("key", F.least("_p", "_o").alias("a"), F.greatest("_p", "_o").alias("b"), F.when(F.col("_p") <= F.col("_o"), 0).otherwise(1).alias("side"), "node", "n_shingles", "sketch")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["key", "a", "b"]):
            node, size, side = (t.column(c).to_numpy() for c in ("node", "n_shingles", "side"))
            sketch = fixed_matrix(t.column("sketch"), BITS // 64, np.uint64)
            split = t.column("a").to_numpy() != t.column("b").to_numpy()
            n = np.diff(starts)
            two = starts[:-1][n == 2]
            two = two[_near(plan, size[two], size[two + 1], sketch[two], sketch[two + 1]) & (~split[two] | (side[two] != side[two + 1]))]
            src, dst = [node[two]], [node[two + 1]]
            for s, m in zip(starts[:-1][n > 2].tolist(), n[n > 2].tolist()):
                e = np.array(_sketch_forest(plan, size[s : s + m], sketch[s : s + m], side[s : s + m] if split[s] else None), np.int64).reshape(-1, 2) + s
                src.append(node[e[:, 0]])
                dst.append(node[e[:, 1]])
            got = pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])
            if len(got):
                yield got

    return cells.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "node").mapInArrow(meet, "src long, dst long")


def _near(plan: Plan, size_a, size_b, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs neither their sizes nor their sketches keep from being linked."""
    fits = 100 * np.minimum(size_a, size_b) >= plan.percent * np.maximum(size_a, size_b)
    return fits & (np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) <= plan.differ(size_a, size_b))


def _sketch_forest(plan: Plan, size: np.ndarray, sketch: np.ndarray, side: np.ndarray | None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of such pairs; a set is compared with those that nothing has reached yet."""
    left, edges = np.ones(len(size), bool), []
    for i in range(len(size)):
        if not left[i]:
            continue
        left[i] = False
        front = [i]
        while front:
            j = front.pop()
            rest = np.flatnonzero(left if side is None else left & (side != side[j]))
            new = rest[_near(plan, size[rest], size[j], sketch[rest], sketch[j])]
            left[new] = False
            edges += [(j, int(x)) for x in new]
            front += new.tolist()
    return edges


def _by_tokens(docs: DataFrame, classes: DataFrame, k: int, plan: Plan) -> DataFrame:
    """(src, dst): weak classes and all that share a token of their prefix, the tokens of which one must be shared. Few sets are weak, if any."""
    weak = classes.filter("weak").select("node", "rep", "rep_t")
    asked = texts_of(docs, weak)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in text_chunks(batches, "text"):
            h, where = shingle_sets(data, at, k)
            size = np.diff(where)
            first = size - plan.least(size) + 1
            own = np.arange(len(h)) - np.repeat(where[:-1], size) < np.repeat(first, size)
            yield pa.RecordBatch.from_arrays([pa.array(h[own].view(np.int64)), rows.column(1).take(pa.array(np.repeat(np.arange(len(size)), size)[own]))], ["token", "src"])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, at in text_chunks(batches, "text"):
            h, where = shingle_sets(data, at, k)
            name = names_of(h, where)[:, 0].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.repeat(name, np.diff(where)))], ["token", "short"])

    asked = written(asked.select("text", "node").mapInArrow(prefixes, "token long, src long").distinct(), "jaccard-weak")
    few = asked.count() <= 1_000_000
    every = small_batches(docs).select("text").mapInArrow(tokens, "token long, short long")
    pairs = every.join(F.broadcast(asked) if few else asked.hint("merge"), "token").select("src", "short").distinct()
    return pairs.join(classes.select("short", F.col("node").alias("dst")).hint("merge"), "short").select("src", "dst")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    plan, spark, start = Plan(percent), docs.sparkSession, mark()
    rows = written(described(docs, k, plan), "jaccard-described")
    classes = classes_of(rows, "short", "sketch", "spare", "spare_below", "weak")
    edges = candidate_edges(docs, classes, k, plan)
    if classes.filter("weak").head(1):
        edges = edges.unionByName(_by_tokens(docs, classes, k, plan))
    edges = written(edges, "jaccard-edges")
    discard(spark, start, "jaccard-marked", "jaccard-wanted", "jaccard-weak")
    return grouped(docs, rows, classes, edges, k, percent).select("doc_id", "n_shingles", "component_id")
