"""Distributions of a crawl behind its charts, and its tree of addresses. Each is one aggregate over the pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U

C = F.col


def _bucketed(pages: DataFrame, value: Column, bounds: list[tuple[Column, str]], last: str) -> DataFrame:
    """bucket, pages and mean (of all values, rounded half up) over the pages that have a value; empty buckets are left out."""
    rows = pages.select(value.alias("_v")).filter("_v is not null")
    name = None
    for test, label in bounds:
        name = F.when(test, label) if name is None else name.when(test, label)
    counts = rows.groupBy(name.otherwise(last).alias("bucket")).agg(F.count("*").alias("pages"))
    return counts.crossJoin(rows.agg(F.floor(F.avg("_v") + 0.5).alias("mean")))  # one row


def page_weights(pages: DataFrame) -> DataFrame:
    """Pages by kB of html."""
    v = C("_v")
    return _bucketed(pages, C("kb"), [(v < 100, "Light (<100KB)"), (v < 500, "Medium (100-500KB)"), (v < 1024, "Heavy (500KB-1MB)")], "Very Heavy (>1MB)")


def link_scores(pages: DataFrame) -> DataFrame:
    """Pages by link score."""
    v = C("_v")
    return _bucketed(pages, C("link_score"), [(v == 0, "Orphaned (0)"), (v < 40, "Weak (1-39)"), (v < 70, "Moderate (40-69)")], "Strong (70-100)")


def asset_mix(pages: DataFrame) -> DataFrame:
    """name and n: pages, and the distinct stylesheets, scripts and images of them all, and redirects; none of a kind is no row."""
    of = lambda name, urls: F.transform(F.coalesce(urls, F.array().cast("array<string>")), lambda u: F.struct(F.lit(name).alias("name"), u.alias("u")))
    kinds = F.concat(of("CSS", C("css")), of("JavaScript", C("javascript")), of("Images", C("images.url")))
    assets = pages.select(F.explode(kinds).alias("r")).select("r.*").filter("u is not null").distinct().groupBy("name").agg(F.count("*").alias("n"))
    moved = F.coalesce("had_redirect", F.lit(False)) | F.coalesce(C("status_code").between(300, 399), F.lit(False))
    counts = pages.agg(F.count("*").alias("Pages"), F.count_if(moved).alias("Redirects"))
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), C(k).alias("n")) for k in ("Pages", "Redirects")])).alias("r")).select("r.*")
    return rows.filter("n > 0").unionByName(assets)


def compliance(pages: DataFrame) -> DataFrame:
    """signal, covered and percent of the pages: https, schema, mobile."""
    tests = {"https": C("url").startswith("https://"), "schema": F.coalesce("schema", F.lit("")) != "", "mobile": F.coalesce("mobile", F.lit(False))}
    one = pages.agg(F.count("*").alias("_all"), *[F.count_if(c).alias(k) for k, c in tests.items()])
    rows = one.select("_all", F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), C(k).alias("covered")) for k in tests])).alias("r"))
    return rows.select("r.*", F.when(C("_all") > 0, F.round(C("r.covered") * 100.0 / C("_all"), 6)).otherwise(0.0).alias("percent"))


def top_reasons(pages: DataFrame, most: int = 6) -> DataFrame:
    """The commonest reasons of (not) being indexable; ties by reason."""
    return pages.groupBy(F.coalesce("reason", F.lit("Unknown")).alias("reason")).agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "reason").limit(most)


def treemap(pages: DataFrame, folders: int = 10, below: int = 8) -> DataFrame:
    """top, sub and pages: the largest first path segments, and in each the largest second ones; the rest of each is a row '...' with how many
    it stands for in `names`. A page at the top has the segment '(root)', one right in a folder '(index)'. Ties by name."""
    parts = F.filter(F.split(U.url_path(C("url")), "/"), lambda p: p != "")
    rows = pages.filter("url is not null").select(F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("(root)")).alias("top"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("(index)")).alias("sub"))
    subs = rows.groupBy("top", "sub").agg(F.count("*").alias("n"))
    tops = subs.groupBy("top").agg(F.sum("n").alias("_t"))
    first = tops.orderBy(F.desc("_t"), "top").limit(folders).select(C("top").alias("_top"))
    shown = subs.join(F.broadcast(first), C("top") == C("_top"), "left")  # `folders` rows
    rank = F.row_number().over(Window.partitionBy("top").orderBy(F.desc("n"), "sub"))
    named = shown.withColumn("_r", F.when(C("_top").isNotNull(), rank))
    inside = C("_top").isNotNull()
    out = named.groupBy(F.when(inside, C("top")).otherwise("...").alias("top"), F.when(inside & (C("_r") <= below), C("sub")).otherwise("...").alias("sub"))
    return out.agg(F.sum("n").alias("pages"), F.when(F.min(inside), F.count("*")).otherwise(F.countDistinct(F.when(~inside, named["top"]))).alias("names"))


def url_tree(pages: DataFrame) -> DataFrame:
    """node (root, then the path's segments), depth, is_page, below (pages under it), status_code and indexable of the page there, the last by url, then status, then indexable."""
    parts = F.filter(F.split(U.url_path(C("url")), "/"), lambda p: p != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(F.array_join(F.concat(F.array(F.lit("root")), F.slice(parts, 1, i)), "/").alias("node"), i.alias("depth"), (i == F.size(parts)).alias("last")))
    own = F.coalesce("indexability", F.lit(0.5)) >= 0.5
    rows = pages.filter("url is not null").select("url", "status_code", own.alias("indexable"), F.explode(prefixes).alias("p")).select("url", "status_code", "indexable", "p.*")
    here = F.when(C("last"), F.struct("url", "status_code", "indexable"))
    nodes = rows.groupBy("node", "depth").agg(F.max("last").alias("is_page"), F.count_if(~C("last")).alias("below"), F.max(here).alias("_p"))
    return nodes.select("node", "depth", "is_page", "below", "_p.status_code", "_p.indexable")


def url_tree_totals(tree: DataFrame) -> DataFrame:
    """One row: nodes that are pages, nodes other than the root with pages below, and the greatest depth."""
    return tree.agg(F.count_if("is_page").alias("pages"), F.count_if((C("below") > 0) & (C("depth") > 0)).alias("folders"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
