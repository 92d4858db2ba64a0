"""Search-console rows, address lists, bot address ranges, sitemaps, robots rules, speed reports, crawl snapshots."""

from __future__ import annotations

from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.robots import RuleTrie
from ..operators.graphs import hot_join
from ..operators.logs import keep_last
from ..operators.tables import materialized

GSC_ROW = "date string, url string, position double, clicks long, impressions long, ctr double"


def read_gsc_json(spark: SparkSession, path: str, date: str) -> DataFrame:
    """API answers {rows: [{keys: [query, url], clicks, impressions, ctr, position}]}; of equal (date, url, query) the last row stays."""
    raw = spark.read.schema("rows array<struct<keys:array<string>,clicks:double,impressions:double,ctr:double,position:double>>").option("multiLine", True).json(path)
    rows = raw.select(F.col("_metadata.file_path").alias("_f"), F.posexplode("rows").alias("_i", "r"))
    flat = rows.select(F.lit(date).alias("date"), F.try_element_at("r.keys", F.lit(2)).alias("url"), F.try_element_at("r.keys", F.lit(1)).alias("query"), F.col("r.impressions").cast("long").alias("impressions"), F.col("r.clicks").cast("long").alias("clicks"), "r.ctr", "r.position", "_f", "_i")
    return keep_last(flat, ["date", "url", "query"], ["_f", "_i"]).drop("_f", "_i")


def read_gsc_table(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded CSV rows; those without both date and url are left out."""
    return spark.read.schema(GSC_ROW).option("header", True).csv(path).filter("coalesce(date, '') <> '' or coalesce(url, '') <> ''")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("url string").option("header", True).csv(path).filter("url is not null")


def read_ip_ranges(spark: SparkSession, path: str, family: str) -> DataFrame:
    """(family, cidr) of a published list {prefixes: [{ipv4Prefix | ipv6Prefix}]}."""
    raw = spark.read.schema("prefixes array<struct<ipv4Prefix:string,ipv6Prefix:string>>").option("multiLine", True).json(path)
    return raw.select(F.explode("prefixes").alias("p")).select(F.lit(family).alias("family"), F.explode(F.array("p.ipv4Prefix", "p.ipv6Prefix")).alias("cidr")).filter("cidr is not null")


def sitemap_entries(spark: SparkSession, path: str) -> DataFrame:
    """kind (page or sitemap), loc and file of the entries of sitemaps and sitemap indexes, by the XML source; documents that hold <html> have none.

    Only the loc of an entry itself counts, not that of an image or video in it; namespaces don't matter. Files are streamed, a task each.
    """

    def entries(tag: str, kind: str) -> DataFrame:
        rows = spark.read.format("xml").schema("loc string").option("rowTag", tag).option("ignoreNamespace", True).option("multiLine", True).load(path)
        return rows.select(F.lit(kind).alias("kind"), F.nullif(F.trim("loc"), F.lit("")).alias("loc"), F.col("_metadata.file_path").alias("file"))

    pages = spark.read.text(path).filter(F.lower("value").contains("<html")).select(F.col("_metadata.file_path").alias("file")).distinct()
    return entries("url", "page").unionByName(entries("sitemap", "sitemap")).filter("loc is not null").join(pages, "file", "left_anti").select("kind", "loc", "file")


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """kind and loc of sitemap_entries."""
    return sitemap_entries(spark, path).drop("file")


def _verdict(n, warn: int, refuse: int):
    return F.when(n > refuse, "refuse").when(n > warn, "warn").otherwise("ok")


def site_size(entries: DataFrame, warn: int = 5000, refuse: int = 10_000) -> DataFrame:
    """Addresses listed, and whether a crawl of them is ok, too much to go unasked (warn) or too much (refuse)."""
    return entries.agg(F.count_if(F.col("kind") == "page").alias("pages")).withColumn("verdict", _verdict(F.col("pages"), warn, refuse))


def estimated_size(entries: DataFrame, read: DataFrame, warn: int = 5000, refuse: int = 10_000) -> DataFrame:
    """One row: leaves, pages (listed in them), unread, urls (the estimate), from_sitemap, verdict.

    entries are (kind, loc, file), read the sitemaps (file) that were opened, with those that list nothing. A sitemap that an index names and
    nobody has opened counts as many pages as those opened do on average, cut to a whole number, and one at least. Without any entry
    nothing is known, and the verdict is ok.
    """
    opened = read.select("file").distinct()
    leaves = opened.join(entries.filter("kind = 'sitemap'").select("file").distinct(), "file", "left_anti").agg(F.count("*").alias("leaves"))
    unread = entries.filter("kind = 'sitemap'").select(F.col("loc").alias("file")).distinct().join(opened, "file", "left_anti").agg(F.count("*").alias("unread"))
    totals = entries.agg(F.count_if(F.col("kind") == "page").alias("pages"), (F.count("*") > 0).alias("from_sitemap"))
    each = F.when(F.col("leaves") > 0, F.greatest(F.floor(F.col("pages") / F.col("leaves")), F.lit(1))).otherwise(0)
    rows = totals.crossJoin(leaves).crossJoin(unread).withColumn("urls", (F.col("pages") + F.col("unread") * each).cast("long"))  # a row each
    return rows.select("leaves", "pages", "unread", "urls", "from_sitemap", F.when(F.col("from_sitemap"), _verdict(F.col("urls"), warn, refuse)).otherwise("ok").alias("verdict"))


# ---------------------------------------------------------------- robots


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """(host, allow, pattern) of the group that speaks to an agent, from robots files (host, body).

    Lines are numbered, and a group begins at a user-agent line that follows a rule; running sums within a file
    say which group a line is in. The group with the longest token that the agent contains wins, or else that of '*'.
    """
    clean = F.trim(F.split_part(F.regexp_replace("line", "^﻿", ""), F.lit("#"), F.lit(1)))
    lines = files.select("host", F.posexplode(F.split("body", r"\r?\n")).alias("n", "line")).withColumn("line", clean)
    lines = lines.filter(F.col("line").contains(":")).select("host", "n", F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))).alias("name"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    lines = lines.filter("(name = 'user-agent' and value <> '') or name in ('allow', 'disallow')")
    from pyspark.sql import Window

    w = Window.partitionBy("host").orderBy("n")  # the lines of one robots file
    starts = (F.col("name") == "user-agent") & (F.coalesce(F.lag("name").over(w), F.lit("")) != "user-agent")
    grouped = lines.withColumn("g", F.sum(starts.cast("int")).over(w)).filter("g > 0")
    token = F.lower("value")
    score = F.when(token == "*", 0).when(F.lit(agent.strip().lower()).contains(token), F.length(token))
    best = grouped.filter("name = 'user-agent'").groupBy("host", "g").agg(F.max(score).alias("score")).filter("score is not null")
    top = best.groupBy("host").agg(F.max("score").alias("_top"))
    chosen = best.join(top, "host").filter("score = _top").select("host", "g")
    return grouped.filter("name <> 'user-agent' and value <> ''").join(chosen, ["host", "g"]).select("host", (F.col("name") == "allow").alias("allow"), F.col("value").alias("pattern"))


def robots_sitemaps(files: DataFrame) -> DataFrame:
    """(host, url) of the Sitemap lines."""
    found = F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap\s*:\s*(https?://[^\s#]+)"), 1)
    return files.select("host", F.explode(F.array_distinct(found)).alias("url"))


#: Addresses of a host that are walked in one task; a host with more is dealt over several.
ROBOTS_PART = 20_000


def robots_allowed(urls: DataFrame, rules: DataFrame, part: int = ROBOTS_PART) -> DataFrame:
    """The urls (with host) and allowed: what the longest matching rule says, an Allow in ties, and True without a rule.

    Each distinct address of a host that has rules is walked once through a trie of that host's rules. Hosts meet their rules by a
    cogroup on host and a share of the addresses, so a host with many addresses is in many tasks, and rules are repeated for
    each share only. A null url counts as '/', null patterns are left out, and a null host has no rules. `urls` is read twice, so pass a written table or a scan.
    """

    def walked(asked: pa.Table, held: pa.Table) -> pa.Table:
        trie = RuleTrie(zip(held.column("allow").to_pylist(), held.column("pattern").to_pylist()))
        said = [trie.allowed(p) for p in asked.column("_robots_path").to_pylist()]
        return pa.table({"_robots_host": asked.column("_robots_host"), "_robots_path": asked.column("_robots_path"), "allowed": pa.array(said, pa.bool_())})

    said = F.coalesce(F.regexp_replace(F.regexp_replace("url", r"^[a-zA-Z][\w+.-]*://[^/?#]*", ""), "#.*$", ""), F.lit(""))
    path = F.when(said.startswith("/"), said).otherwise(F.concat(F.lit("/"), said))
    own = materialized(rules.filter("host is not null and pattern is not null").select(F.col("host").alias("_robots_host"), "allow", "pattern").distinct(), "robots-rules")
    asked = materialized(urls.filter("host is not null").select(F.col("host").alias("_robots_host"), path.alias("_robots_path")).distinct(), "robots-asked")
    sizes = asked.groupBy("_robots_host").agg(F.count("*").alias("_n")).join(own.select("_robots_host").distinct(), "_robots_host")
    sizes = materialized(sizes.withColumn("_parts", F.ceil(F.col("_n") / part).cast("int")), "robots-sizes")  # a row a host
    dealt = hot_join(asked, sizes, "_robots_host", "_n", asked.count()).filter("_parts is not null").withColumn("_part", F.pmod(F.xxhash64("_robots_path"), F.col("_parts")).cast("int"))
    held = own.join(sizes, "_robots_host").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    keys = ["_robots_host", "_part"]
    judged = dealt.select(*keys, "_robots_path").groupBy(*keys).cogroup(held.select(*keys, "allow", "pattern").groupBy(*keys)).applyInArrow(walked, "_robots_host string, _robots_path string, allowed boolean")
    judged = judged.withColumnRenamed("allowed", "_robots_allowed")
    rows = urls.withColumn("_robots_at", path).join(judged, (F.col("host") == F.col("_robots_host")) & (F.col("_robots_at") == F.col("_robots_path")), "left")
    return rows.select(*[F.col(c) for c in urls.columns if c != "allowed"], F.coalesce("_robots_allowed", F.lit(True)).alias("allowed"))


# ---------------------------------------------------------------- speed reports

METRICS = {"fcp": "first-contentful-paint", "lcp": "largest-contentful-paint", "tti": "interactive", "tbt": "total-blocking-time", "cls": "cumulative-layout-shift", "dom_size": "dom-size", "speed_index": "speed-index", "server_response_time": "server-response-time", "total_byte_weight": "total-byte-weight"}


def _number(path: str):
    return F.get_json_object("json", path).try_cast("double")


def psi_scores(df: DataFrame) -> DataFrame:
    """url and the mean score of each category over its reports (json); null where there is none."""
    names = {"performance": "performance", "accessibility": "accessibility", "best_practices": "best-practices", "seo": "seo"}
    rows = df.select("url", *[_number(f"$.categories['{v}'].score").alias(k) for k, v in names.items()])
    return rows.groupBy("url").agg(*[F.avg(k).alias(k) for k in names])


def psi_history(df: DataFrame) -> DataFrame:
    """A row a report: url, strategy, performance and nine audits; a missing audit is 0."""
    audit = lambda v: F.coalesce(_number(f"$.audits['{v}'].numericValue"), F.lit(0.0))
    return df.select("url", "strategy", F.coalesce(_number("$.categories.performance.score"), F.lit(0.0)).alias("performance"), *[audit(v).alias(k) for k, v in METRICS.items()])


#: The vitals table: what it has of the mobile and the desktop report, in order; `redirects` and `dom_nodes` are of the mobile one only.
VITALS = {
    "perf": "performance", "acc": "accessibility", "bp": "best-practices", "seo": "seo", "speed_index": "speed-index", "lcp": "largest-contentful-paint", "cls": "cumulative-layout-shift",
    "fcp": "first-contentful-paint", "interactive": "interactive", "tbt": "total-blocking-time", "redirects": "redirects", "ttfb": "server-response-time", "dom_nodes": "dom-size", "byte_weight": "total-byte-weight",
}
CATEGORIES = ("perf", "acc", "bp", "seo")


def vitals(df: DataFrame) -> DataFrame:
    """url and 26 texts a row: each measure of the mobile (_m) and the desktop (_d) report of psi_results, a JSON text {Ok: [mobile, desktop]}.

    A score is its percentage, a measure its display value or its number to two places; what isn't there is n/a. The text is parsed once, to a VARIANT.
    """
    rows = df.select("url", F.try_parse_json("psi_results").alias("_v"))
    at = lambda i, path, kind: F.try_variant_get("_v", f"$.Ok[{i}].{path}", kind)
    number = lambda i, path: F.when(F.schema_of_variant(F.try_variant_get("_v", f"$.Ok[{i}].{path}", "variant")) != "STRING", at(i, path, "double"))
    text = lambda i, path: F.when(F.schema_of_variant(F.try_variant_get("_v", f"$.Ok[{i}].{path}", "variant")) == "STRING", at(i, path, "string"))
    score = lambda i, path: F.coalesce((F.signum(number(i, path)) * F.floor(F.abs(number(i, path)) * 100 + 0.5)).cast("long").cast("string"), F.lit("n/a"))
    places = lambda x: F.when(x.isNotNull(), F.format_string("%.2f", x))
    audit = lambda i, name: F.coalesce(text(i, f"audits['{name}'].displayValue"), places(number(i, f"audits['{name}'].numericValue")), F.lit("n/a"))

    def of(i: int, short: str, name: str):
        if short in CATEGORIES:
            return score(i, f"categories['{name}'].score")
        if short == "redirects":
            return score(i, "audits.redirects.score")
        return audit(i, name)

    cells = []
    for short, name in VITALS.items():
        sides = ((0, ""),) if short in ("redirects", "dom_nodes") else ((0, "_m"), (1, "_d"))
        cells += [of(i, short, name).alias(short + side) for i, side in sides]
    return rows.select(F.coalesce("url", F.lit("")).alias("url"), *cells)


def read_analytics(spark: SparkSession, path: str) -> DataFrame:
    """Report rows {dimensionHeaders, metricHeaders, rows} as (row, name, value), dimensions and metrics alike."""
    cell = "array<struct<value:string>>"
    raw = spark.read.schema(f"dimensionHeaders array<struct<name:string>>, metricHeaders array<struct<name:string>>, rows array<struct<dimensionValues:{cell},metricValues:{cell}>>").option("multiLine", True).json(path)
    names = F.concat(F.col("dimensionHeaders.name"), F.col("metricHeaders.name"))
    rows = raw.select(names.alias("names"), F.posexplode("rows").alias("row", "r"))
    return rows.select("row", F.explode(F.arrays_zip("names", F.concat(F.col("r.dimensionValues.value"), F.col("r.metricValues.value")).alias("vals"))).alias("c")).select("row", F.col("c.names").alias("name"), F.col("c.vals").alias("value"))


# ---------------------------------------------------------------- stores


def save_snapshot(pages: DataFrame, folder: str, session: str) -> None:
    """A copy of the pages under a session; saving it again replaces that session only."""
    pages.withColumn("session_id", F.lit(session)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(folder)


def load_snapshot(spark: SparkSession, folder: str, session: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", False).parquet(folder).filter(F.col("session_id") == session).drop("session_id")


def export_crawl(pages: DataFrame, folder: str, domain: str, version: int = 1) -> None:
    """Pages and a one-row manifest."""
    pages.write.mode("overwrite").parquet(f"{folder}/pages")
    pages.agg(F.count("*").alias("page_count")).select(F.lit(version).alias("version"), F.current_timestamp().alias("saved_at"), F.lit(domain).alias("domain"), "page_count").write.mode("overwrite").json(f"{folder}/manifest")


def import_crawl(spark: SparkSession, folder: str, version: int = 1) -> DataFrame:
    """The pages of an exported crawl; a manifest of another version is an error."""
    found = spark.read.json(f"{folder}/manifest").first()["version"]
    if found != version:
        raise ValueError(f"the crawl was saved in version {found}, not {version}")
    return spark.read.parquet(f"{folder}/pages")


def append_rows(df: DataFrame, folder: str) -> None:
    """Add rows to a history (crawls, issue reports, on-page records)."""
    df.write.mode("append").parquet(folder)


def drop_snapshot(spark: SparkSession, folder: str, session: str) -> None:
    """Delete a session's snapshot; one that isn't there is no error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/session_id={quote(session, safe=' -_.')}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_history(spark: SparkSession, folder: str, domain: str | None = None) -> DataFrame:
    """A history's rows, of one domain if asked, newest first."""
    rows = spark.read.parquet(folder)
    return (rows if domain is None else rows.filter(F.col("domain") == domain)).orderBy(F.desc("date"), F.desc("id"))


def delete_history(spark: SparkSession, folder: str, into: str, ids: list | None = None, domain: str | None = None) -> None:
    """Write the history into another folder without the rows of these ids, or of this domain; the old folder stays as it is."""
    gone = F.lit(False)
    if ids is not None:
        gone = gone | F.coalesce(F.col("id").isin(ids), F.lit(False))
    if domain is not None:
        gone = gone | F.coalesce(F.col("domain") == domain, F.lit(False))
    spark.read.parquet(folder).filter(~gone).write.mode("errorifexists").parquet(into)


# ---------------------------------------------------------------- search rules


def put_rules(rules: DataFrame, folder: str, deleted: bool = False) -> None:
    """Add search rules (html.RULE) to a store, or with `deleted` take these ids out. Files are only added, each change with its time, so readers
    and writers don't meet; of the changes to a rule the last holds, as with enabling one."""
    rows = rules.withColumns({"seq": F.current_timestamp(), "deleted": F.lit(deleted)})
    rows.write.mode("append").parquet(folder)


def read_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The rules of a store, by id."""
    last = keep_last(spark.read.parquet(folder), ["id"], ["seq", "deleted"])
    return last.filter("not deleted").drop("seq", "deleted").orderBy("id")
