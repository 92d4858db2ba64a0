"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Documents' statistics are standardised with the training rows' mean and deviation, mapped to cosines of random projections
(which approximate a Gaussian kernel), and fitted by least squares with a penalty: each partition sums its part of the normal
equations, and the driver solves one system of D equations, whatever the input. Scores are calibrated by isotonic regression
over a histogram of fixed size, made of training rows that the fit didn't see.

Labels come from rows whose crc32(doc_id) mod 5 is not 0. Null and empty texts have the statistics of no words and are scored too. Where
labels repeat a doc_id, its largest label counts; null labels don't. With no labelled rows all scores are 0.5.
Repeated rows are scored each, equal texts alike; statistics that tie give equal scores. Texts of any length are read whole, one at least at
a time. An empty table has no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, small_batches, text_chunks, written
from .features import STATS, text_stats

D = 256
GAMMA = 0.05
RIDGE = 1e-2
BINS = 1000
LOTS = 64
CUT = 0.3


def with_stats(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of its whole text. No shuffle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in text_chunks(batches, "text"):
            x = text_stats(data, at)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column(0), values], ["doc_id", "x"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, x array<double>")


class Kernel:
    """The random Fourier map: x -> sqrt(2/D) cos(Wx + b), and a 1 for the constant."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, seed: int, gamma: float = GAMMA, d: int = D):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1)
        self.w = rng.normal(0, np.sqrt(2 * gamma), (len(mean), d))
        self.b = rng.uniform(0, 2 * np.pi, d)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        return np.column_stack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones(len(x))])


def normal_equations(train: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """Sum of z z' and of z y over rows (x, y): a partition sums its own, then Spark sums row by row of the matrix, LOTS lots of partitions at first."""

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            z = kernel(np.stack(f["x"].to_numpy()))
            got = np.column_stack([z.T @ z, z.T @ f["y"].to_numpy(float)])
            total = got if total is None else total + got
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "lot": TaskContext.get().partitionId() % LOTS, "v": list(total)})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for f in frames:
            for i, lot, v in zip(f["i"], f["lot"], f["v"]):
                sums[i, lot] = sums[i, lot] + v if (i, lot) in sums else v
        if sums:
            yield pd.DataFrame({"i": [i for i, _ in sums], "lot": 0, "v": list(sums.values())})

    schema = "i int, lot int, v array<double>"
    lots = train.select("x", "y").mapInPandas(part, schema).repartition("i", "lot").mapInPandas(add, schema)
    rows = lots.repartition(8, "i").mapInPandas(add, schema).collect()  # D + 1 rows
    m = np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])])
    return m[:, :-1], m[:, -1]


def isotonic(total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """The share of positives in each bin, made non-decreasing by pooling neighbours; empty bins follow their left one."""
    stack: list[list[float]] = []  # bins, rows, positives
    for n, p in zip(total, positive):
        stack.append([1, n, p])
        while len(stack) > 1 and (stack[-1][1] == 0 or stack[-2][1] == 0 or stack[-2][2] * stack[-1][1] >= stack[-1][2] * stack[-2][1]):
            last = stack.pop()
            stack[-1] = [a + b for a, b in zip(stack[-1], last)]
    return np.concatenate([np.full(int(b), p / n if n else 0.5) for b, n, p in stack])


def labelled(labels: DataFrame, column: str, folds: int, held: int) -> DataFrame:
    """doc_id and y of the rows that may be learnt from, a row a doc_id."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (crc_bucket(F.col("doc_id"), folds) != held))
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("double").alias("y"))


def quality(docs: DataFrame, labels: DataFrame, seed: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    stats = written(with_stats(docs), "quality-stats")
    train = written(stats.join(labelled(labels, "quality", 5, 0), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(4))), "quality-train")
    k = len(STATS)
    moments = train.agg(F.count("*").alias("n"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(k)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(k)]).first()
    held = (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out")
    if not moments["n"]:
        return stats.select("doc_id", held, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    kernel = Kernel(np.array([moments[f"m{i}"] for i in range(k)]), np.array([moments[f"s{i}"] for i in range(k)]), seed)
    a, b = normal_equations(train.filter("fold <> 0"), kernel) if train.filter("fold <> 0").head(1) else normal_equations(train, kernel)
    weights = np.linalg.solve(a + RIDGE * np.eye(len(a)), b)

    @F.pandas_udf("int")
    def binned(x: pd.Series) -> pd.Series:
        y = kernel(np.stack(x.to_numpy())) @ weights if len(x) else np.zeros(0)
        return pd.Series(np.clip((y + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32))

    unseen = train.filter("fold = 0")
    hist = (unseen if unseen.head(1) else train).select(binned("x").alias("bin"), "y").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()  # BINS rows
    total, positive = np.zeros(BINS), np.zeros(BINS)
    for r in hist:
        total[r["bin"]], positive[r["bin"]] = r["n"], r["p"]
    # a small slope keeps scores apart within a step
    share = isotonic(total, positive)
    curve = np.clip(0.998 * share + 0.002 * np.linspace(0, 1, BINS), 0, 1).tolist()
    scored = stats.select("doc_id", held, F.element_at(F.array(*map(F.lit, curve)), binned("x") + 1).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
