"""Intermediate tables: written to the folder that the executors share, and read again."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: dict[str, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a folder of this process, gone when it ends; only if all of Spark runs in this process. A cluster needs the setting.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def fresh_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def materialized(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage and survives lost executors.

    The write's own shuffle files go as soon as it has ended, not when the driver's JVM collects its plan.
    """
    path, conf = fresh_dir(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitioned(df: DataFrame, key: str, parts: int) -> DataFrame:
    """df kept on the executors' disks by a key's hash in so many parts, so that joins on it shuffle nothing; unpersist() it at the end.

    A lost part is made again, so df should read a written table. It is filled at once: plans know the partitions of what is there.
    """
    kept = df.repartition(parts, key).sortWithinPartitions(key).persist(StorageLevel.DISK_ONLY)
    kept.count()
    return kept


def mark() -> int:
    """A point in time for discard."""
    return len(_made)


def discard(spark: SparkSession, since: int, *names: str) -> None:
    """Delete the intermediate tables of these names made since a mark; nothing may read them any more.

    Spark deletes the shuffle files of a plan once the JVM has collected it, which an idle driver puts off: so that is asked for here.
    """
    jvm, gone = spark.sparkContext._jvm, [p for p in _made[since:] if p.rsplit("/", 1)[1].rsplit("-", 1)[0] in names]
    for path in gone:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _made[since:] = [p for p in _made[since:] if p not in gone]
    gc.collect()
    jvm.System.gc()
