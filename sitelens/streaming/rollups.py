"""Log rollups over streams of files: the batch functions, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import logs as L
from ..operators import logs as ops


def stream_timeline(hits: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Human and crawler hits of each window of time; rows later than `late` are dropped."""
    human = F.col("crawler_type") == "Human"
    timed = hits.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width)).agg(F.count_if(human).alias("human"), F.count_if(~human).alias("crawler")).select(F.col("window.start").alias("start"), "human", "crawler")


def write_rollup(hits: DataFrame, key: str, folder: str, checkpoint: str):
    """Keep partial rollups of each micro-batch under its number, so a batch that is run again replaces what it wrote."""

    def save(batch: DataFrame, number: int) -> None:
        part = ops.rollup(batch, key).withColumn("batch", F.lit(number))
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)

    return hits.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_rollup(spark: SparkSession, key: str, folder: str) -> DataFrame:
    return spark.read.parquet(folder).groupBy(key, "segment").agg(F.sum("hit_count").alias("hit_count"))


# ---------------------------------------------------------------- states that are added up

def states(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: hits, crawled (whether any hit's path was), first_hit and last_hit; what a batch knows, and can be merged."""
    return hits.groupBy(*keys).agg(F.count("*").alias("hits"), F.coalesce(F.bool_or("crawled"), F.lit(False)).alias("crawled"), F.min("ts").alias("first_hit"), F.max("ts").alias("last_hit"))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """States of the same key as one."""
    return parts.groupBy(*keys).agg(F.sum("hits").alias("hits"), F.bool_or("crawled").alias("crawled"), F.min("first_hit").alias("first_hit"), F.max("last_hit").alias("last_hit"))


def _written(spark: SparkSession, folder: str) -> tuple[dict[int, str], dict[int, str], object]:
    """The finished bases and batches of a folder, by number, and its file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, dict[int, str]] = {"base": {}, "batch": {}}
    for status in fs.listStatus(where) if fs.exists(where) else []:
        kind, _, number = status.getPath().getName().partition("=")
        if kind in found and number.isdigit() and fs.exists(hadoop.Path(status.getPath(), "_SUCCESS")):
            found[kind][int(number)] = status.getPath().toString()
    return found["base"], found["batch"], fs


def compact(spark: SparkSession, keys: list[str], folder: str, upto: int) -> None:
    """Merge all batches up to a number, which must be finished, into one base, and delete what it replaces. Doing it again changes nothing."""
    bases, batches, fs = _written(spark, folder)
    if upto not in bases:
        if not any(n <= upto for n in batches):
            return
        read_states(spark, keys, folder, upto).write.mode("overwrite").parquet(f"{folder}/base={upto}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for old in [p for n, p in bases.items() if n < upto] + [p for n, p in batches.items() if n <= upto]:
        fs.delete(path(old), True)


def read_states(spark: SparkSession, keys: list[str], folder: str, upto: int | None = None) -> DataFrame | None:
    """The merged states of a folder, up to a batch's number if given: the newest base and the batches after it. None if there are none."""
    bases, batches, _ = _written(spark, folder)
    base = max((n for n in bases if upto is None or n <= upto), default=None)
    paths = [bases[base]] if base is not None else []
    paths += [p for n, p in sorted(batches.items()) if (base is None or n > base) and (upto is None or n <= upto)]
    return merged(spark.read.parquet(*paths), keys) if paths else None


def save_states(batch: DataFrame, number: int, keys: list[str], folder: str, every: int = 16) -> None:
    """Write a micro-batch's states under its number, in place of an earlier try. When a batch begins, those before it are finished, so each
    `every` batches they become one base, and files stay few."""
    if number and number % every == 0:
        compact(batch.sparkSession, keys, folder, number - 1)
    states(batch, keys).write.mode("overwrite").parquet(f"{folder}/batch={number}")


def write_states(hits: DataFrame, keys: list[str], folder: str, checkpoint: str, every: int = 16):
    """Keep the states of a stream of hits in a folder; a restart, or a batch that is run again, counts nothing twice."""
    return hits.writeStream.foreachBatch(lambda batch, number: save_states(batch, number, keys, folder, every)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(hits: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Visits: the hits of an address and user agent without a gap, with whether a crawler made them."""
    timed = hits.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("ip", "user_agent", F.session_window("ts", gap)).agg(F.count("*").alias("hits"), F.max(L.is_crawler(F.col("crawler_type"))).alias("crawler")).select("ip", "user_agent", F.col("session_window.start").alias("start"), "hits", "crawler")
