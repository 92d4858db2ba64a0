"""Building blocks of links between rows: joins on hot keys, connected components, sorted streams."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialized

def hot_join(left: DataFrame, right: DataFrame, key: str, count: str, total: int, share: int = 1000) -> DataFrame:
    """left ⟕ right on one column, right having one row a key and in `count` how many left rows have it.

    Keys with more than total/share left rows are broadcast and their left rows stay where they are: at most `share` keys, whatever
    the size. The others go through an ordinary join, which streams a key's left rows past its one right row, and whose skewed
    partitions adaptive execution splits. `left` is read twice, so pass a written table or a scan. Null keys match nothing. `count`
    isn't in the result.
    """
    least = max(200, total // share)
    hot = right.filter(F.col(count) > least).drop(count)
    cold = right.filter(F.col(count) <= least).drop(count)
    keys = F.broadcast(hot.select(F.col(key).alias("_hot")))
    warm = left.join(F.broadcast(hot), key, "inner")
    rest = left.join(keys, left[key] == F.col("_hot"), "left_anti").join(cold, key, "left")
    return warm.unionByName(rest)


def components(edges: DataFrame, src: str = "src", dst: str = "dst", most: int | None = None) -> DataFrame:
    """(id, component) of every end of an edge; component is the smallest id reachable.

    Large-star and small-star rounds in turn; each round's edges are written to the shared folder, and the number of rounds grows
    with the logarithm of the largest component. It goes on until a round changes nothing, and raises if `most` rounds, where given,
    weren't enough. Null ends and loops are left out.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    e = materialized(e, "edges")
    before = None
    for rounds in itertools.count():
        total, *state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not total or [total, *state] == before:
            break
        if rounds == most:
            raise RuntimeError(f"components() hasn't converged in {most} rounds")
        before = [total, *state]
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = hot_join(both, least, "u", "n", total * 2).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialized(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = hot_join(large, least, "u", "n", total).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        e = materialized(small, "edges")
    tops = e.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").unionByName(tops)


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    n, edges = len(links), []
    left = np.ones(n, bool)
    for i in range(n):
        if not left[i]:
            continue
        left[i] = False
        front = [i]
        while front:
            j = front.pop()
            new = np.flatnonzero(links[j] & left)
            left[new] = False
            edges += [(j, int(x)) for x in new]
            front += new.tolist()
    return edges


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of a stream that is sorted by integer keys, cut between groups, and where each group starts (with the end)."""
    held: list[pa.RecordBatch] = []

    def cut(t: pa.Table) -> np.ndarray:
        edge = np.zeros(max(0, len(t) - 1), bool)
        for k in keys:
            x = t.column(k).to_numpy()
            edge |= x[1:] != x[:-1]
        return np.concatenate([[0], np.flatnonzero(edge) + 1])

    for batch in batches:
        if not len(batch):
            continue
        if held and all(batch.column(k)[len(batch) - 1] == held[0].column(k)[0] for k in keys):
            held.append(batch)  # one group still
            continue
        t = pa.Table.from_batches([*held, batch])
        starts = cut(t)
        if len(starts) > 1:
            yield t.slice(0, int(starts[-1])), starts
        held = t.slice(int(starts[-1])).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, np.append(cut(t), len(t))
