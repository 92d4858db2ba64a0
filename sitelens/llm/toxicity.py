"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of lexicon words and of lexicon word beginnings, how near such words are to a second person,
capitals, punctuation and obfuscation rates. The lexicons are the words, and the first 4, 5 or 6 bytes of words, that toxic
documents of the training rows have far more often. Lexicon, trees and calibration are each learnt from rows of their own.

Labels come from rows whose crc32(doc_id) mod 4 is not 2; at most FIT_ROWS of them, those with the smallest hash of doc_id,
are used for fitting. Null and empty texts have features of zero and are scored too. Where labels repeat a doc_id,
its largest label counts; null labels don't. With labels of one kind only, or none, all scores are that label or 0.5.
Repeated rows are scored each, equal texts alike. An empty table has no scores. Very long texts are read 500 kB at a time, a text at least.
Extra columns are ignored, and kept by without_toxic whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import SPACE, carried, crc_bucket, small_batches, text_chunks, word_hashes, words, written
from .features import BETWEEN, DIGIT, LETTER, PUNCT, SYMBOL, UPPER, _count, edge_hashes
from .quality import labelled

FIT_ROWS = 60_000
LEXICON = 4000
EDGES = (4, 5, 6)
NEAR = 5
CUT = 0.3
STEPS = 2000  # of the calibration curve

# Second-person words in English, German, French and Spanish.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta vous votre tú ti usted ustedes vos tus".split()

FEATURES = ["hits", "log_hits", "best", "edge_hits", "log_edge_hits", "best_edge", "near_you", "you", "upper", "caps_words", "bang", "punct", "obfuscated", "digits_in_words", "log_words"]


def _own_hashes(texts: list[str]) -> np.ndarray:
    data = np.frombuffer(b" ".join(t.encode() for t in texts), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]))
    return np.sort(word_hashes(data, starts, ends))


def _weights(hashes: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(known) or not len(hashes):
        return np.zeros(len(hashes))
    i = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[i] == hashes, values[i], 0.0)


def learn_lexicon(train: DataFrame, most: int = LEXICON, least_docs: int = 5, least_odds: float = 3.0) -> list[tuple[int, int, float]]:
    """(length or 0 for whole words, hash, log odds) of what toxic rows (text, y) have far more often; at most `most` entries."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in text_chunks(batches, "text"):
            y = np.asarray(rows.column(1), float)
            starts, ends, row = words(data, at, BETWEEN)
            for kind in (0, *EDGES):
                h = edge_hashes(data, starts, ends, kind) if kind else word_hashes(data, starts, ends)
                keep = h != 0
                pairs = np.unique(np.column_stack([h[keep], row[keep].astype(np.uint64)]), axis=0)
                names, which = np.unique(pairs[:, 0], return_inverse=True)
                toxic = y[pairs[:, 1].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), kind, np.int32)), pa.array(names.view(np.int64)), pa.array(np.bincount(which, minlength=len(names)).astype(np.int64)), pa.array(np.bincount(which, toxic, len(names)).astype(np.float64))], ["kind", "h", "n", "p"])

    sums = train.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    n, p = sums["n"] or 0, sums["p"] or 0.0
    odds = F.log((F.col("p") + 0.5) / (F.col("n") - F.col("p") + 0.5)) - F.log(F.lit((p + 0.5) / (n - p + 0.5)))
    found = train.select("text", "y").mapInArrow(counts, "kind int, h long, n long, p double").groupBy("kind", "h").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).filter(F.col("p") >= least_docs)
    best = found.select("kind", "h", odds.alias("odds")).filter(F.col("odds") >= least_odds).orderBy(F.desc("odds"), "kind", "h").limit(most)
    return [(r["kind"], r["h"], r["odds"]) for r in best.collect()]


def with_features(rows: DataFrame, lexicon: list[tuple[int, int, float]], column: str = "text") -> DataFrame:
    """row, and x: FEATURES of the whole text in `column`, which may be a field of row. No shuffle."""
    tables = {}
    for kind in (0, *EDGES):
        part = sorted((h % (1 << 64), w) for k, h, w in lexicon if k == kind)
        tables[kind] = np.array([h for h, _ in part], np.uint64), np.array([w for _, w in part])
    second = _own_hashes(SECOND_PERSON)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in text_chunks(batches, column):
            n, size = len(rows), np.maximum(np.diff(at), 1).astype(float)
            starts, ends, row = words(data, at, BETWEEN)
            count = np.bincount(row, minlength=n).astype(float)
            per_word = np.maximum(count, 1)
            hashes = word_hashes(data, starts, ends)
            hit = _weights(hashes, *tables[0])
            edge = np.max([_weights(edge_hashes(data, starts, ends, k), *tables[k]) for k in EDGES], axis=0)
            best, best_edge = np.zeros(n), np.zeros(n)
            np.maximum.at(best, row, hit)
            np.maximum.at(best_edge, row, edge)
            you = _weights(hashes, second, np.ones(len(second))) > 0
            sums = np.concatenate([[0], np.cumsum(you)])
            place, first = np.arange(len(row)), np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
            lo, hi = np.maximum(place - NEAR, first[row]), np.minimum(place + NEAR + 1, first[row + 1])
            any_hit = (hit > 0) | (edge > 0)
            near = any_hit & (sums[hi] > sums[lo])
            ws, we, wrow = words(data, at, SPACE)
            n_ws = np.maximum(np.bincount(wrow, minlength=n), 1)
            up, let, dig, odd = (np.concatenate([[0], np.cumsum(m[data])]) for m in (UPPER, LETTER, DIGIT, SYMBOL))
            caps = np.bincount(wrow, ((up[we] - up[ws]) >= 2) & ((up[we] - up[ws]) == (let[we] - let[ws])), n) / n_ws
            # symbols between letters: neither the first nor the last byte of a word
            inner = np.bincount(wrow, (odd[np.maximum(we - 1, ws)] > odd[np.minimum(ws + 1, we)]) & (let[we] > let[ws]), n) / n_ws
            mixed = np.bincount(wrow, (let[we] > let[ws]) & (dig[we] > dig[ws]), n) / n_ws
            hits, edges = np.bincount(row, hit > 0, n), np.bincount(row, edge > 0, n)
            x = np.column_stack([
                hits / per_word, np.log1p(hits), best, edges / per_word, np.log1p(edges), best_edge,
                np.bincount(row, near, n) / np.maximum(np.bincount(row, any_hit, n), 1), np.bincount(row, you, n) / per_word,
                _count(UPPER[data], at) / size, caps, _count(data == 33, at) / size, _count(PUNCT[data], at) / size, inner, mixed, np.log1p(count),
            ])
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("row")), values], ["row", "x"])

    return small_batches(rows).mapInArrow(each, StructType([rows.schema["row"], StructField("x", ArrayType(DoubleType()))]))


def scored(rows: DataFrame, column: str, texts: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 6) -> DataFrame:
    """row and score of the rows with a text in `column`, by a model of texts (doc_id, text) and labels."""
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(10)).cast("int").alias("fold")
    sample = labelled(labels, "toxic", 4, 2).select("doc_id", "y", fold, F.xxhash64("doc_id", F.lit(seed)).alias("_o")).orderBy("_o", "doc_id").limit(fit_rows).drop("_o")
    sample = written(sample, "toxic-sample")
    train = written(texts.join(F.broadcast(sample), "doc_id"), "toxic-train")  # fit_rows rows are broadcast at most
    kinds = [r["y"] for r in train.select("y").distinct().collect()]
    if len(kinds) < 2:
        return rows.select("row", F.lit(kinds[0] if kinds else 0.5).alias("score"))
    lexicon = learn_lexicon(train.filter("fold < 4"))
    known = written(with_features(train.select(F.struct("fold", "y").alias("row"), "text"), lexicon), "toxic-fit")
    n = known.count()
    known = known.select("row.fold", "row.y", array_to_vector("x").alias("features")).coalesce(max(1, min(8, n // 2000)))
    fit, rest = known.filter("fold between 4 and 7"), known.filter("fold > 7")
    if fit.select("y").distinct().count() < 2 or not rest.head(1):  # a handful of labels
        fit = rest = known
    grower = GBTClassifier(featuresCol="features", labelCol="y", predictionCol="kind", maxIter=20, maxDepth=3, stepSize=0.3, maxBins=64, minInstancesPerNode=5, seed=seed, cacheNodeIds=False)
    trees = grower.setRawPredictionCol("raw").setProbabilityCol("chances").fit(fit)

    def raw(df: DataFrame) -> DataFrame:
        return trees.transform(df).withColumn("p", vector_to_array("chances")[1])

    curve = IsotonicRegression(featuresCol="p", labelCol="y").fit(raw(rest).select("p", "y"))
    xs, ys = curve.boundaries.toArray().tolist(), curve.predictions.toArray().tolist()

    grid = np.linspace(0, 1, STEPS + 1)
    table = F.array(*map(F.lit, np.clip(0.998 * np.interp(grid, xs, ys) + 0.002 * grid, 0, 1).tolist()))
    calibrated = F.element_at(table, F.round(F.col("p") * STEPS).cast("int") + 1)
    return raw(with_features(rows, lexicon, column).select("row", array_to_vector("x").alias("features"))).select("row", calibrated.alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scored(texts.select(F.struct("doc_id").alias("row"), "text"), "text", texts, labels, fit_rows).select("row.doc_id", "score")
    return rows.select("doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that score below CUT, with all their columns. No shuffle of texts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(carried(docs), "row.text", texts, labels, fit_rows).filter(F.col("score") < CUT).select("row.*")
