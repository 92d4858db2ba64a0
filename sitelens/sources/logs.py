"""Access logs: Combined Log Format text to hits, in batch and streaming; the project log store; CSV exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH)\s+([^?"]+)(?:\?[^"]*)?\s+HTTP/[0-9.]+"\s+(\d{3})\s+(\d+)\s+"([^"]*)"\s+"([^"]*)"'
MONTHS = {m: i + 1 for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}


def _time(c: Column) -> Column:
    """Local wall-clock time; the offset is dropped. Null where it isn't one."""
    month = F.try_element_at(F.create_map(*[F.lit(x) for m, i in MONTHS.items() for x in (m, f"{i:02d}")]), F.substring(c, 4, 3))
    text = F.concat(F.substring(c, 8, 4), F.lit("-"), month, F.lit("-"), F.substring(c, 1, 2), F.lit(" "), F.substring(c, 13, 8))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Hits of text lines (value, filename); lines that don't match, or whose time isn't one, are left out."""
    part = lambda i: F.regexp_extract("value", LINE, i)
    rows = lines.filter(F.col("value").rlike(LINE)).select(
        part(1).alias("ip"), _time(part(2)).alias("ts"), part(3).alias("method"), part(4).alias("path"), part(5).cast("int").alias("status"), F.expr(f"try_cast(regexp_extract(value, r'{LINE}', 6) AS BIGINT)").alias("response_size"),
        F.nullif(part(7), F.lit("-")).alias("referer"), part(8).alias("user_agent"), "filename",
    )
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return rows.filter("ts is not null").withColumns({"day": F.substring(stamp, 1, 10), "hour": F.concat(F.substring(stamp, 1, 13), F.lit(":00:00"))})


def read_access_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path).select("value", F.col("_metadata.file_name").alias("filename")))


def stream_access_logs(spark: SparkSession, path: str, files_a_trigger: int = 100) -> DataFrame:
    return parse_lines(spark.readStream.option("maxFilesPerTrigger", files_a_trigger).text(path).select("value", F.col("_metadata.file_name").alias("filename")))


def format_lines(hits: DataFrame) -> DataFrame:
    """Hits as Combined Log Format lines (value), for tests and exports."""
    stamp = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    request = F.format_string('"%s %s HTTP/1.1"', "method", "path")
    return hits.select(F.concat_ws(" ", "ip", F.lit("- -"), F.concat(F.lit("["), stamp, F.lit(" +0000]")), request, F.col("status").cast("string"), F.col("response_size").cast("string"), F.format_string('"%s"', F.coalesce("referer", F.lit("-"))), F.format_string('"%s"', F.coalesce("user_agent", F.lit("-")))).alias("value"))


def append_project_logs(lines: DataFrame, folder: str, project: str) -> None:
    """Keep raw lines under their project; reading one project prunes the others' folders."""
    lines.withColumn("project", F.lit(project)).write.mode("append").partitionBy("project").parquet(folder)


def logs_by_project(spark: SparkSession, folder: str, project: str) -> DataFrame:
    return parse_lines(spark.read.parquet(folder).filter(F.col("project") == project).drop("project"))


def export_csv(df: DataFrame, folder: str, order: list[str] | None = None, columns: list[str] | None = None) -> None:
    """Rows as CSV files with a header, in global order if asked for."""
    rows = df.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]) if order else df
    (rows.select(*columns) if columns else rows).write.mode("overwrite").option("header", True).csv(folder)
