"""Substring search over tables that are searched often: postings of trigrams, which say where a text can be at all.

The index is a table of (gram, key), partitioned by a bucket of the gram, so a search reads the buckets of its own grams only. Rows that
have all of them are looked through for the term itself, so results are those of a full scan. Terms of under three characters scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


def _grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case."""
    low = F.lower(text)
    n = F.length(low) - 2
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_index(rows: DataFrame, key: str, columns: list[str], folder: str) -> None:
    """Index some text columns of rows by a key that names each. A gram that very many rows have is dealt over tasks by its rows' keys."""
    grams = F.flatten(F.array(*[F.coalesce(_grams(F.col(c)), F.array().cast("array<string>")) for c in columns]))
    posted = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.explode(F.array_distinct(grams)).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
    dealt = posted.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("bucket", "gram", "key")
    dealt.write.mode("errorifexists").partitionBy("bucket").parquet(folder)


def has_term(columns: list[str], term: str) -> Column:
    """Whether one of the columns has the term, whatever its case."""
    low = term.strip().lower()
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(low), F.lit(False)) for c in columns])


def candidates(spark: SparkSession, folder: str, term: str) -> DataFrame:
    """The keys of the rows that have all trigrams of a term of three characters or more; in different columns, perhaps."""
    low = term.strip().lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    table = spark.createDataFrame([(g,) for g in grams], "gram string").withColumn("bucket", _bucket(F.col("gram"))).collect()  # the term's own
    posted = spark.read.parquet(folder).filter(F.col("bucket").isin(sorted({r.bucket for r in table})) & F.col("gram").isin(grams))
    return posted.groupBy("key").agg(F.count("*").alias("_n")).filter(F.col("_n") == len(grams)).select("key")


def search_rows(rows: DataFrame, key: str, columns: list[str], folder: str, term: str) -> DataFrame:
    """The rows with the term in one of the indexed columns, by way of the index."""
    if len(term.strip()) < 3:
        return rows.filter(has_term(columns, term))
    found = candidates(rows.sparkSession, folder, term)
    return rows.join(found, F.col(key) == found["key"], "left_semi").filter(has_term(columns, term))
