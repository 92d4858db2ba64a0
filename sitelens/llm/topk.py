"""Exact top-k search by inner product, with multi-resolution segment statistics.

A vector is cut into segments; of each, its mean and deviation are kept, at 4 segments and at 16. For two vectors the sum over
segments of length * (mean * mean + deviation * deviation) is at least their inner product (Cauchy and Schwarz within a segment),
just as it bounds distances from below. A cell takes a block of queries and a block of candidates: the coarse bounds of
all, exact scores of the k candidates with the highest bounds, which give each query a threshold, then the fine
bounds of those whose coarse bound reaches it, then exact scores of what is left. A bound equal to a threshold survives, so ties
are decided by the ids alone.

A first pass searches one block of candidates for each query; its k-th score there is a threshold for all cells, since the best k of
all can't be worse. So a later cell, or all of it for a block whose greatest bound stays below, adds only what can be among the best.
Candidates are shuffled once; the blocks of queries, a hundredth of the rows, go to each of their blocks.

Components are floor(1024 * x) of x as double. Vectors that are null or hold null or non-finite components take no part, nor do
null ids. Vectors of different lengths don't meet; empty vectors meet each other with score 0. Rows that repeat a query's
id are its own and no candidates of it; as a query, of rows with one id the smallest vector counts; a candidate's id can
appear once for each of its rows. Scores must fit 64 bits. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 1024
LEVELS = (4, 16)
PART = 8192  # candidates whose bounds with a block of queries are in memory at once


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: the vectors that take part, as arrays of longs."""
    x = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def pack(rows: DataFrame, block: str) -> DataFrame:
    """(d, block, ids, m, floor): the vectors of each block and length as one matrix. Blocks are small by construction."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("vec_id", kind="stable")
        d = int(f["d"].iloc[0])
        m = np.array(f["v"].tolist(), np.int64).reshape(len(f), d)
        return pd.DataFrame({"d": [d], block: [f[block].iloc[0]], "ids": [f["vec_id"].to_numpy(np.int64).tobytes()], "m": [m.tobytes()], "floor": [f["floor"].to_numpy(np.float64).tobytes()]})

    return rows.select("d", block, "vec_id", "v", "floor").groupBy("d", block).applyInPandas(one, f"d int, {block} long, ids binary, m binary, floor binary")


def bounds(m: np.ndarray, segments: int) -> np.ndarray:
    """For each vector, sqrt(length) * (mean, deviation) of its segments; their inner products are upper bounds."""
    n, d = m.shape
    edges = np.arange(min(segments, d) + 1) * d // max(1, min(segments, d))
    x = m.astype(float)
    cols = []
    for a, b in zip(edges, edges[1:]):
        cols += [x[:, a:b].mean(axis=1) * np.sqrt(b - a), x[:, a:b].std(axis=1) * np.sqrt(b - a)]
    return np.column_stack(cols) if cols else np.zeros((n, 1))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of a with rows of b, without rounding."""
    top = float(max(1, np.abs(a).max(initial=0))) * float(max(1, np.abs(b).max(initial=0))) * max(1, a.shape[1])
    if top < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T if top < 2**63 else (a.astype(object) @ b.T.astype(object)).astype(np.int64)


def search_cell(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, candidate, score of the k best candidates of each query with its floor at least; ties go to the smaller id."""
    best_ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
    best: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
    q_coarse, q_fine = (bounds(q, s) for s in LEVELS)
    slack = 1 + 1e-9 * float(max(1, np.abs(q).max(initial=0))) * float(max(1, np.abs(c).max(initial=0))) * max(1, q.shape[1])
    for i in range(0, len(c), PART):
        ids, m = c_ids[i : i + PART], c[i : i + PART]
        coarse_c = bounds(m, LEVELS[0])
        coarse = q_coarse @ coarse_c.T + slack
        coarse[q_ids[:, None] == ids] = -np.inf
        live = np.flatnonzero(coarse.max(axis=1, initial=-np.inf) >= floor)
        if not len(live):
            continue
        fine_c = bounds(m, LEVELS[1])
        for j in live.tolist():
            row = coarse[j]
            own = ids != q_ids[j]
            least = floor[j]
            if len(best[j]) >= k:
                least = max(least, best[j][k - 1])
            elif not np.isfinite(least) and int(own.sum()) >= k:
                seeds = np.argpartition(row, len(row) - k)[-k:] if len(row) > k else np.flatnonzero(own)
                if np.isfinite(row[seeds]).all():
                    least = int(exact(q[j : j + 1], m[seeds]).min())
            at = np.flatnonzero(own & (row >= least))
            at = at[fine_c[at] @ q_fine[j] + slack >= least]
            if not len(at):
                continue
            got = exact(q[j : j + 1], m[at])[0]
            scores, who = np.concatenate([best[j], got[got >= least]]), np.concatenate([best_ids[j], ids[at][got >= least]])
            order = np.lexsort((who, -scores))[:k]
            best[j], best_ids[j] = scores[order], who[order]
    return np.repeat(q_ids, [len(x) for x in best]), np.concatenate([np.zeros(0, np.int64), *best_ids]), np.concatenate([np.zeros(0, np.int64), *best])


def searched(blocks: DataFrame, asked: DataFrame, k: int, tasks: int) -> DataFrame:
    """query_id, vec_id, score: blocks of candidates (d, g, ids, m), each met by the blocks of queries (d, g, ids, m, floor) that are sent to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, held = None, None
        for batch in batches:
            for i in range(len(batch)):
                d, g, ids, m, floor = (batch.column(x)[i].as_py() for x in ("d", "g", "ids", "m", "floor"))
                ids = np.frombuffer(ids, np.int64)
                m = np.frombuffer(m, np.int64).reshape(len(ids), d)
                if floor is None:
                    where, held = (d, g), (ids, m)
                elif where == (d, g):
                    got = search_cell(ids, m, np.frombuffer(floor, np.float64), *held, k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["query_id", "vec_id", "score"])

    both = blocks.withColumn("floor", F.lit(None).cast("binary")).unionByName(asked.select("d", "g", "ids", "m", "floor"))
    dealt = both.repartition(tasks, "d", "g").sortWithinPartitions("d", "g", F.col("floor").isNotNull())
    return dealt.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, query_block: int = 1024, least_block: int = 2048, most_block: int = 65_536, tasks: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each row whose id is divisible by `every`.

    Queries and candidates are hashed into blocks, and a task holds a block of each at a time. Candidate blocks grow with the input
    up to most_block rows.
    """
    rows = whole(vectors).withColumn("d", F.size("v"))
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
    n, nq = rows.count(), queries.count()
    size = min(most_block, max(least_block, -(-n // tasks)))
    n_c, n_q = max(1, -(-n // size)), max(1, -(-nq // query_block))
    blocks = written(pack(rows.withColumn("g", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_c))).withColumn("floor", F.lit(float("-inf"))), "g").drop("floor"), "topk-candidates")
    queries = queries.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(n_q)))
    first = written(pack(queries.withColumn("floor", F.lit(float("-inf"))), "b"), "topk-queries")
    tried = searched(blocks, first.withColumn("g", F.pmod("b", F.lit(n_c))), k, min(n_c, 100_000)).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    floors = tried.filter(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), F.col("least").cast("double").alias("floor"))
    again = written(pack(queries.join(floors.hint("merge"), "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "b"), "topk-floors")
    found = searched(blocks, again.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_c - 1).cast("long")))), k, min(n_c, 100_000))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
