"""Mixing sources to target weights, by words in fixed-length blocks.

Each source's documents, in an order of their own, make one stream of words, which is packed into blocks of `block_words` (the
last one may be shorter). A source's target fixes how many slots it fills. The slots of all sources are spread over output
shards by multinomial draws, one a source, so the shards' source counts are multinomial while the sources' sums
are exact. A draw is made of binomial ones, which part a range of shards in two until one of CHUNK shards is left, so each such
range is drawn in a task of its own. Slot j of a source takes block perm(j mod full blocks), perm being a pseudorandom permutation of the source's and
the pass's own; every pass ends with the short block. The last slot takes only the words still missing. Blocks are joined by
(source, block) to the documents that lie in them.

Everything follows from the seed and the rows, so reruns agree. Null and empty texts have size 0 and are never taken; rows
that repeat a doc_id are documents of their own; a null source is a source, the last in order. An empty table gives no rows.
Extra columns are ignored, and kept by mixed_documents whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, carried, mix, small_batches, words, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SLOTS_A_SHARD = 1 << 14
SLOTS_A_TASK = 1 << 17
CHUNK = 4096  # shards whose counts are drawn at once
LOT = 1000  # buckets of documents that are summed at once


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words), and a hash of the text that orders rows with the same doc_id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("_h"))


def targets(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """A row a source: source, s (its rank by code point, null last), weight, source_size, target.

    Targets are the weight times a common level, capped at `most` times the size. The level that the caps and the total fix is
    found by walking the sources in the order in which they are capped. Its windows run over one row a source.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy()
    ranked = sizes.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("s") % len(weights) + 1).cast("int")).cast("long")).withColumn("cap", F.col("source_size") * most)
    upto = Window.orderBy(F.col("cap") / F.col("weight"), "s").rowsBetween(Window.unboundedPreceding, -1)
    walked = ranked.select("*", (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(upto), F.lit(0))).alias("left_words"), (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0))).alias("left_weight"))
    level = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("left_words") / F.col("left_weight"), F.struct(F.col("cap") / F.col("weight"), "s", (F.col("left_words") / F.col("left_weight")).alias("level")))).over(every)["level"]
    return walked.withColumn("level", level).select("source", F.col("s").cast("long").alias("s"), "weight", "source_size", F.when(F.col("level").isNull() | (F.col("cap") < F.col("weight") * F.col("level")), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def permute(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the places i: a Feistel network, walked until it falls below n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, 5, dtype=np.uint64) + np.uint64(key & ((1 << 64) - 1)))

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & low
        for k in keys:
            a, b = b, a ^ (mix(b ^ k) & low)
        return a << np.uint64(half) | b

    x = once(i.astype(np.uint64))
    while len(off := np.flatnonzero(x >= n)):
        x[off] = once(x[off])
    return x.astype(np.int64)


def chunk_share(slots: int, shards: int, chunk: int, seed: list[int], size: int) -> tuple[int, int]:
    """Of a source's slots, dealt evenly over shards: how many lie before a chunk of `size` shards, and how many in it."""
    lo, hi, before = 0, -(-shards // size), 0
    while hi - lo > 1:
        mid = (lo + hi) // 2
        part = (mid - lo) * size / (min(hi * size, shards) - lo * size)
        left = int(np.random.default_rng([*seed, lo, hi]).binomial(slots, part))
        if chunk < mid:
            hi, slots = mid, left
        else:
            lo, slots, before = mid, slots - left, before + left
    return before, slots


def draw_slots(goals: DataFrame, block_words: int, seed: int, shard_slots: int = SLOTS_A_SHARD, size: int = CHUNK) -> DataFrame:
    """A row a slot: shard, s, slot, block, words (what it takes, from the block's start)."""
    counts = goals.filter("source_size > 0").select("s", "source_size", F.round("target").cast("long").alias("goal"))
    # a pass over a source fills one slot a block; what is missing then, one slot a block_words
    n_blocks = F.ceil(F.col("source_size") / block_words)
    passes = F.floor(F.col("goal") / F.col("source_size"))
    counts = counts.withColumn("slots", (passes * n_blocks + F.ceil((F.col("goal") - passes * F.col("source_size")) / block_words)).cast("long"))
    total, sources = counts.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-total // shard_slots))
    chunks = -(-shards // size)
    tasks = max(1, min(100_000, -(-total // SLOTS_A_TASK)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, of_source, goal, slots, chunk in zip(*(c.to_pylist() for c in batch.columns)):
                before, own = chunk_share(slots, shards, chunk, [seed, s], size)
                width = min(size, shards - chunk * size)
                n = np.random.default_rng([seed, s, chunk]).multinomial(own, np.full(width, 1 / width))
                first = before + np.cumsum(n) - n
                k = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), x, np.int64)) for x in (s, of_source, goal)] + [pa.array(k + chunk * size), pa.array(first[k]), pa.array(n[k])], ["s", "source_size", "goal", "shard", "first", "n"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, size, goal, shard, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                full, short = divmod(size, block_words)
                a_pass = full + (short > 0)
                slot = np.arange(first, first + n, dtype=np.int64)
                turn, at = slot // a_pass, slot % a_pass
                block = at.copy()
                for t in np.unique(turn).tolist():
                    own = (turn == t) & (at < full)
                    block[own] = permute(at[own], full, int(mix(np.array([seed + 1_000_003 * s + t], np.uint64))[0]))
                length = np.where(block < full, block_words, short)
                # words that the source's earlier slots of this pass took are at * block_words
                words = np.minimum(length, goal - turn * size - at * block_words)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, np.int64)), pa.array(np.full(n, s, np.int64)), pa.array(slot), pa.array(block), pa.array(words)], ["shard", "s", "slot", "block", "words"])

    parts = counts.select("s", "source_size", "goal", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))
    dealt = parts.repartition(max(1, min(tasks, sources * chunks)), "s", "chunk").mapInArrow(deal, "s long, source_size long, goal long, shard long, first long, n long")
    return dealt.repartition(tasks, "shard", "s").mapInArrow(fill, "shard long, s long, slot long, block long, words long")


def streams(docs: DataFrame, goals: DataFrame, rows_a_bucket: int = 1000) -> DataFrame:
    """Each document with s and `at`, the words of its source before it.

    A source's documents are hashed into buckets; sums run within a bucket and over the buckets, so no task has a whole source.
    """
    n = docs.count()
    buckets = max(1, -(-n // rows_a_bucket))
    keyed = docs.withColumn("_b", F.pmod(F.xxhash64("doc_id", "_h"), F.lit(buckets)))
    names = goals.select("source", "s", "source_size", "target")
    keyed = keyed.join(F.broadcast(names) if names.count() <= 100_000 else names, keyed["source"].eqNullSafe(names["source"]), "left").drop(names["source"])
    # buckets are summed in lots of LOT, lots over a source: a row for each million documents meets in a task
    sums = keyed.groupBy("s", "_b").agg(F.sum("size").alias("_n")).withColumn("_lot", F.floor(F.col("_b") / LOT))
    lots = sums.groupBy("s", "_lot").agg(F.sum("_n").alias("_l"))
    lots = lots.withColumn("_lots", F.sum("_l").over(Window.partitionBy("s").orderBy("_lot")) - F.col("_l")).drop("_l")
    upto = F.sum("_n").over(Window.partitionBy("s", "_lot").orderBy("_b")) - F.col("_n")
    sums = sums.withColumn("_upto", upto).join(lots, ["s", "_lot"]).select("s", "_b", (F.col("_upto") + F.col("_lots")).alias("_before"))
    within = Window.partitionBy("s", "_b").orderBy("doc_id", "_h", "size")
    run = keyed.withColumn("_run", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return run.join(sums, ["s", "_b"]).withColumn("at", F.col("_before") + F.col("_run")).drop("_before", "_run", "_b")


def segments(placed: DataFrame, block_words: int) -> DataFrame:
    """A row for each block that a document lies in: s, block, at, lo and hi (its words' places in the block)."""
    L = F.lit(block_words)
    spread = placed.filter("size > 0").select("doc_id", "s", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / L), F.floor((F.col("at") + F.col("size") - 1) / L))).alias("block"))
    return spread.select("doc_id", "s", "at", "size", F.col("block").cast("long").alias("block"), F.greatest(F.col("at") - F.col("block") * L, F.lit(0)).cast("long").alias("lo"), F.least(F.col("at") + F.col("size") - F.col("block") * L, L).cast("long").alias("hi"))


def packed(placed: DataFrame, goals: DataFrame, block_words: int, seed: int, shard_slots: int = SLOTS_A_SHARD) -> DataFrame:
    """The mix: a row for each shard's slot and document that it has words of: shard, s, slot, block, turn (the pass), at, lo, hi. Written.

    A slot's block is found by index among the blocks of its source; lo and hi are the document's words in it, as far as the slot takes them.
    """
    a_pass = F.floor(F.col("source_size") / block_words) + F.when(F.col("source_size") % block_words > 0, 1).otherwise(0)
    sizes = goals.select("s", "source_size")
    slots = draw_slots(goals, block_words, seed, shard_slots).join(F.broadcast(sizes) if goals.count() <= 100_000 else sizes, "s").select("shard", "s", "slot", "block", "words", F.floor(F.col("slot") / a_pass).cast("int").alias("turn"))
    found = segments(placed, block_words).join(slots.hint("merge"), ["s", "block"]).withColumn("hi", F.least("hi", "words")).filter("hi > lo")  # slots grow with the input: never broadcast
    return written(found.select("shard", "s", "slot", "block", "turn", "at", "lo", "hi"), "mix-packed")


def mixed_documents(docs: DataFrame, block_words: int = 64, seed: int = 17, shard_slots: int = SLOTS_A_SHARD) -> DataFrame:
    """The mix as documents: a row for each document and pass that takes words of it, with all columns, a shard's rows together.

    The text is what the pass takes of it: all of it byte by byte, or else the stretches between the first and last word of the
    blocks taken, a line each. It goes to the shard of its first slot. n_chars, if there is one, is the new text's. Documents without
    words stay out, as no slot takes them.
    """
    small = written(sized(docs), "mix-sizes")
    goals = written(targets(small), "mix-targets")
    own = carried(docs).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64("row.text").alias("_h"), F.col("row.source").cast("string").alias("source"), F.coalesce(F.regexp_count("row.text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    placed = streams(own, goals).filter("size > 0").select("row", "s", "at", "size")
    pieces = packed(written(streams(small, goals), "mix-placed"), goals, block_words, seed, shard_slots)
    first = F.col("block") * block_words - F.col("at")
    takes = pieces.select("s", "at", "turn", F.struct((first + F.col("lo")).cast("long").alias("a"), (first + F.col("hi")).cast("long").alias("b")).alias("p"), "slot", "shard").groupBy("s", "at", "turn").agg(F.sort_array(F.collect_list("p")).alias("takes"), F.min_by("shard", "slot").alias("shard"))  # a document's own blocks

    @F.pandas_udf("string")
    def cut(texts, takes):
        import pandas as pd

        out = []
        for text, spans in zip(texts, takes):
            data = text.encode()
            w, e, _ = words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
            runs: list[list[int]] = []
            for p in spans:
                if runs and runs[-1][1] == p["a"]:
                    runs[-1][1] = p["b"]
                else:
                    runs.append([p["a"], p["b"]])
            out.append(text if runs == [[0, len(w)]] else b"\n".join(data[w[a] : e[b - 1]] for a, b in runs).decode())
        return pd.Series(out)

    rows = small_batches(placed).join(takes.hint("merge"), ["s", "at"]).withColumn("cut", cut(F.col("row.text"), F.col("takes")))
    rows = rows.repartition("shard")
    new = {"text": F.col("cut")} | ({"n_chars": F.length("cut").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mix_sources(docs: DataFrame, block_words: int = 64, seed: int = 17, shard_slots: int = SLOTS_A_SHARD) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the shards have of it, repeats counted), shards (how many have some), shard (the first slot's)."""
    small = written(sized(docs), "mix-sizes")
    goals = written(targets(small), "mix-targets")
    placed = written(streams(small, goals), "mix-placed")
    mix_ = packed(placed, goals, block_words, seed, shard_slots)
    each = mix_.groupBy("s", "at", "shard").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"), F.min("slot").alias("slot"))
    got = each.groupBy("s", "at").agg(F.sum("taken").alias("taken"), F.count("*").alias("shards"), F.min_by("shard", "slot").alias("shard"))
    with_words = placed.filter("size > 0").join(got.hint("merge"), ["s", "at"], "left")
    rows = with_words.unionByName(placed.filter("size = 0"), allowMissingColumns=True)
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", F.lit(0)).cast("long").alias("shards"), "shard")
