"""Search-performance operators: tracked keywords, query matching, summaries, comparison of periods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def match_tracked(tracked: DataFrame, gsc: DataFrame) -> DataFrame:
    """Tracked keywords with every search row of the same query, whatever its case."""
    t = tracked.select(*[C(c).alias(f"tracked_{c}") for c in tracked.columns]).withColumn("_q", F.lower("tracked_query"))
    return t.join(gsc.withColumn("_q", F.lower("query")), "_q").drop("_q")


def keyword_summary(matched: DataFrame) -> DataFrame:
    """Per tracked url and query: first clicks and impressions (distinct values summed), current ones of the same url, best and mean position."""
    own = C("url") == C("tracked_url")
    return matched.groupBy("tracked_url", "tracked_query").agg(
        F.sum_distinct(C("tracked_clicks")).alias("initial_clicks"), F.sum_distinct(C("tracked_impressions")).alias("initial_impressions"),
        F.coalesce(F.sum(F.when(own, C("clicks"))), F.lit(0)).alias("clicks"), F.coalesce(F.sum(F.when(own, C("impressions"))), F.lit(0)).alias("impressions"),
        F.min("position").alias("best_position"), F.round(F.avg("position"), 6).alias("mean_position"),
    )


def keyword_headline(summary: DataFrame) -> DataFrame:
    """Totals, click rate, mean position, and the queries with most impressions, most clicks and best position (ties by query)."""
    total = F.sum("impressions")
    by = lambda c: F.max_by("tracked_query", F.struct(c, "tracked_query"))
    return summary.agg(total.alias("impressions"), F.sum("clicks").alias("clicks"), F.when(total > 0, F.round(F.sum("clicks") * 100.0 / total, 6)).otherwise(0.0).alias("ctr"), F.round(F.avg("mean_position"), 6).alias("position"), by("impressions").alias("most_seen"), by("clicks").alias("most_clicked"), F.min_by("tracked_query", F.struct("best_position", "tracked_query")).alias("best_placed"))


def query_key(c):
    """Lower-case, url-decoded path and query without a trailing slash."""
    x = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^[a-z][\w+.-]*://[^/?#]*", ""), "#.*$", "")
    return F.regexp_replace(F.coalesce(F.try_url_decode(x), x), "/$", "")


def gsc_query_match(gsc: DataFrame, urls: DataFrame) -> DataFrame:
    """Per url: rows, clicks, impressions, click rate in percent, mean position, and the first five queries by clicks then name."""
    rows = urls.select("url", query_key(C("url")).alias("_k")).join(gsc.withColumn("_k", query_key(C("url"))).drop("url"), "_k")
    rank = F.row_number().over(Window.partitionBy("url").orderBy(F.desc_nulls_last("clicks"), F.col("query").asc_nulls_last()))
    best = rows.select("url", "clicks", "query").distinct().withColumn("_r", rank).filter(C("_r") <= 5)
    five = best.groupBy("url").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "query"))), lambda s: s["query"]), ", ").alias("queries"))
    imp = F.sum("impressions")
    totals = rows.groupBy("url").agg(F.count("*").alias("matches"), F.sum("clicks").alias("clicks"), imp.alias("impressions"), F.when(imp > 0, F.round(F.sum("clicks") * 100.0 / imp, 6)).otherwise(0.0).alias("ctr"), F.round(F.avg("position"), 6).alias("position"))
    return totals.join(five, "url")


def compare_periods(df: DataFrame, dims: list[str], metrics: list[str], date: str, start: str, end: str) -> DataFrame:
    """Per combination of dimensions: each metric from start to end, in as many days before, and the change in percent.

    The change is 0 where both are 0, and null where only the earlier one is.
    """
    d, s, e = F.to_date(C(date)), F.to_date(F.lit(start)), F.to_date(F.lit(end))
    days = F.datediff(e, s) + 1
    now, before = d.between(s, e), d.between(F.date_sub(s, days), F.date_sub(s, 1))
    sums = [F.coalesce(F.sum(F.when(w, C(m))), F.lit(0)).alias(f"{m}_{n}") for m in metrics for n, w in (("now", now), ("before", before))]
    rows = df.filter(now | before).groupBy(*dims).agg(*sums)
    change = lambda m: F.when((C(f"{m}_now") == 0) & (C(f"{m}_before") == 0), 0.0).when(C(f"{m}_before") != 0, F.round((C(f"{m}_now") - C(f"{m}_before")) * 100.0 / C(f"{m}_before"), 6))
    return reduce(lambda acc, m: acc.withColumn(f"{m}_change", change(m)), metrics, rows)
