"""Filter interaction audit: what each filter removes in each place of each order of the filters.

Every document gets a mask of the filters that it fails, and a part's documents are summed by mask, so that 32 cells a part are all
that is left of the table. Then the 32 subsets of active filters are walked in Gray-code order, one filter toggled at a time: each cell
has a counter of the active filters that it fails, and where a counter leaves or reaches zero, the cell leaves or joins the running
survivors. The survivors of all 32 subsets are kept; what a step of an order removes is the difference of two of them.

The filters: A under 50 words; B fewer than 65 distinct words a hundred; C over 5 capitals A-Z a hundred code points; D a character of
#$%&*|; E the text of a smaller doc_id, anywhere in the table.

Null texts are empty ones. A null doc_id is no smaller than any and fails E never; rows that repeat an id and a text fail E only if a
still smaller id has the text. A null part counts as the empty string. Rows that repeat a label count once, as 1 if any says 1. Texts
are taken whole, whatever their length; they are compared by sha256. An empty table has no parts, so no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, hot_join, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ("docs", "good", "toxic")


def failures(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, digest (of the text), fails (a bit for each of A to D). One scan."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("_text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"))
    bits = [
        F.size("_words") < 50,
        F.size(F.array_distinct("_words")) * 100 < F.size("_words") * 65,
        F.regexp_count("_text", F.lit("[A-Z]")) * F.lit(100).cast("long") > F.length("_text") * F.lit(5).cast("long"),
        F.col("_text").rlike("[#$%&*|]"),
    ]
    mask = sum((b.cast("int") * (1 << i) for i, b in enumerate(bits)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("_text", 256)).alias("digest"), mask.alias("fails"))


def masked(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, mask (a bit for each filter that it fails), n: a row for each id, part and mask."""
    rows = written(failures(docs, part), "audit-rows")
    firsts = written(rows.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")), "audit-firsts")
    found = hot_join(rows, firsts, "digest", "_n", rows.count())
    again = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)).cast("int") * 16
    return found.groupBy("doc_id", "part", (F.col("fails") + again).alias("mask")).agg(F.count("*").alias("n"))


def cells(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, mask, docs, good, toxic: how many of a part's documents fail just these filters. 32 rows a part at most."""
    says = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality").alias("_good"), says("toxic").alias("_toxic"))
    # an id has a row a part and mask by now, so no id is hot in this join
    both = masked(docs, part).join(marks, "doc_id", "left")
    of = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0)))
    return both.groupBy("part", "mask").agg(F.sum("n").alias("docs"), of("_good").alias("good"), of("_toxic").alias("toxic"))


def survivors(counts: np.ndarray) -> np.ndarray:
    """Of (parts, 32 masks, counts), the sums that survive each of the 32 subsets of active filters."""
    parts, masks, kinds = counts.shape
    fails = np.array([[m >> f & 1 for f in range(len(FILTERS))] for m in range(masks)])
    active = 0
    counter = np.zeros(masks, np.int64)  # active filters that each cell fails
    running = counts.sum(axis=1)
    states = np.empty((masks, parts, kinds), np.int64)
    states[0] = running
    for step in range(1, masks):
        f = (step & -step).bit_length() - 1  # the one bit in which this Gray code differs from the last
        active ^= 1 << f
        own = np.flatnonzero(fails[:, f])
        if active >> f & 1:
            running = running - counts[:, own[counter[own] == 0]].sum(axis=1)
            counter[own] += 1
        else:
            counter[own] -= 1
            running = running + counts[:, own[counter[own] == 0]].sum(axis=1)
        states[active] = running
    return states.transpose(1, 0, 2)


def steps(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Of (parts, 32 masks, counts), the figures of each part, order and step, as (parts, orders, steps) each."""
    left = survivors(counts)
    which = np.array([[FILTERS.index(c) for c in o] for o in ORDERS])
    before = np.concatenate([np.zeros((len(which), 1), np.int64), np.cumsum(1 << which, axis=1)], axis=1)
    gone = left[:, before[:, :-1]] - left[:, before[:, 1:]]
    failing = np.stack([counts[:, np.flatnonzero(np.arange(32) >> f & 1), 0].sum(axis=1) for f in range(len(FILTERS))], axis=1)
    shapley = np.stack([(gone[..., 0] * (which == f)).sum(axis=(1, 2)) for f in range(len(FILTERS))], axis=1)
    return {
        "kept": left[:, before[:, 1:], 0],
        "removed": gone[..., 0],
        "redundant": failing[:, which] - gone[..., 0],
        "unique_fails": counts[:, 1 << which, 0],
        "good_lost": gone[..., 1],
        "toxic_lost": gone[..., 2],
        "shapley": shapley[:, which],
    }


FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, filter_order, step and FIGURES: 600 rows a part."""
    one = F.struct("mask", *COUNTS)
    parts = cells(docs, labels, part).groupBy("part").agg(F.collect_list(one).alias("cells"))  # 32 at most

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_steps = len(FILTERS)
        for batch in batches:
            for s in range(0, len(batch), 64):
                some = batch.slice(s, 64)
                counts = np.zeros((len(some), 32, len(COUNTS)), np.int64)
                for i, found in enumerate(some.column(1).to_pylist()):
                    for c in found:
                        counts[i, c["mask"]] = [c[k] for k in COUNTS]
                out = steps(counts)
                each = len(ORDERS) * n_steps
                names = some.column(0).take(pa.array(np.repeat(np.arange(len(some)), each)))
                order = pa.array(np.tile(np.repeat(ORDERS, n_steps), len(some)).tolist())
                step = pa.array(np.tile(np.arange(1, n_steps + 1, dtype=np.int32), len(some) * len(ORDERS)))
                yield pa.RecordBatch.from_arrays([names, order, step, *(pa.array(out[k].ravel()) for k in FIGURES)], ["part", "filter_order", "step", *FIGURES])

    return parts.mapInArrow(walk, "part string, filter_order string, step int, " + ", ".join(f"{k} long" for k in FIGURES))
