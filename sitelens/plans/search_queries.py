"""Registered search-performance, extraction and text queries with their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import keywords as K
from ..sources import html as H
from . import inputs as I

QUERIES, SQL = {}, {}

#: Search rows of the hits, and the queries of some of them as tracked keywords, in another case.
GSC = """
SELECT day AS date, concat('https://site.example', path) AS url, concat('query ', CAST(length(user_agent) % 12 AS STRING)) AS query,
  CAST(status AS BIGINT) AS impressions, CAST(hit_id % 50 AS BIGINT) AS clicks, CAST(hit_id % 30 AS DOUBLE) + 1 AS position FROM {hits}"""
TRACKED = """
SELECT url, upper(query) AS query, max(clicks) AS clicks, max(impressions) AS impressions FROM {gsc} WHERE clicks > 47 GROUP BY 1, 2"""
BASE = f"WITH hits AS ({I.HITS.format(events='events')}), gsc AS ({GSC.format(hits='hits')}), tracked AS ({TRACKED.format(gsc='gsc')}), m AS (SELECT t.url AS tracked_url, t.query AS tracked_query, t.clicks AS tracked_clicks, t.impressions AS tracked_impressions, g.* FROM tracked t JOIN gsc g ON lower(t.query) = lower(g.query))"


def gsc(spark, sf_dir):
    return spark.sql(GSC, hits=I.hits(spark, sf_dir))


def tracked(spark, sf_dir):
    return spark.sql(TRACKED, gsc=gsc(spark, sf_dir))


def matched(spark, sf_dir):
    return K.match_tracked(tracked(spark, sf_dir), gsc(spark, sf_dir))


def add(name, make, sql):
    QUERIES[name], SQL[name] = make, BASE + sql


add("j9_tracked_matches", lambda s, d: matched(s, d).groupBy("tracked_url", "tracked_query").agg(F.count("*").alias("rows")), " SELECT tracked_url, tracked_query, count(*) AS rows FROM m GROUP BY 1, 2")
SUMMARY = "SELECT tracked_url, tracked_query, CAST(sum(DISTINCT tracked_clicks) AS BIGINT) AS initial_clicks, CAST(sum(DISTINCT tracked_impressions) AS BIGINT) AS initial_impressions, CAST(coalesce(sum(clicks) FILTER (WHERE url = tracked_url), 0) AS BIGINT) AS clicks, CAST(coalesce(sum(impressions) FILTER (WHERE url = tracked_url), 0) AS BIGINT) AS impressions, min(position) AS best_position, round(avg(position), 6) AS mean_position FROM m GROUP BY 1, 2"
add("a30_keyword_summary", lambda s, d: K.keyword_summary(matched(s, d)), " " + SUMMARY)
add("a38_keyword_headline", lambda s, d: K.keyword_headline(K.keyword_summary(matched(s, d))), f", k AS ({SUMMARY}) SELECT CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, round(sum(clicks) * 100.0 / sum(impressions), 6) AS ctr, round(avg(mean_position), 6) AS position, arg_max(tracked_query, (impressions, tracked_query)) AS most_seen, arg_max(tracked_query, (clicks, tracked_query)) AS most_clicked, arg_min(tracked_query, (best_position, tracked_query)) AS best_placed FROM k")
add("j11_query_match", lambda s, d: K.gsc_query_match(gsc(s, d), tracked(s, d).select("url").distinct()), " SELECT url, count(*) AS matches, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, round(sum(clicks) * 100.0 / sum(impressions), 6) AS ctr, round(avg(position), 6) AS position, (SELECT string_agg(query, ', ' ORDER BY c DESC, query) FROM (SELECT DISTINCT clicks AS c, query FROM gsc g2 WHERE lower(rtrim(g2.url, '/')) = lower(rtrim(g.url, '/')) ORDER BY c DESC, query LIMIT 5)) AS queries FROM gsc g WHERE url IN (SELECT url FROM tracked) GROUP BY url")
PERIOD = ("2024-01-11", "2024-01-20")
add("w8_compare_periods", lambda s, d: K.compare_periods(gsc(s, d), ["query"], ["clicks"], "date", *PERIOD), " SELECT *, CASE WHEN clicks_now = 0 AND clicks_before = 0 THEN 0.0 WHEN clicks_before <> 0 THEN round((clicks_now - clicks_before) * 100.0 / clicks_before, 6) END AS clicks_change FROM (SELECT query, CAST(coalesce(sum(clicks) FILTER (WHERE date >= '2024-01-11'), 0) AS BIGINT) AS clicks_now, CAST(coalesce(sum(clicks) FILTER (WHERE date < '2024-01-11'), 0) AS BIGINT) AS clicks_before FROM gsc WHERE date BETWEEN '2024-01-01' AND '2024-01-20' GROUP BY 1)")


def page_facts(spark, sf_dir):
    """What SQL can check of the extraction: language, links, first headings and sizes."""
    f = H.extract_pages(I.table(spark, sf_dir, "pages"), "page_id", only=["language", "links", "headings", "html_bytes", "js_inline", "css_inline", "mobile"])
    return f.select("page_id", "language", F.size("links").alias("links"), F.size(F.col("headings")["h1"]).alias("h1s"), "html_bytes", "js_inline", "css_inline", "mobile")


QUERIES["s2_page_facts"] = page_facts
SQL["s2_page_facts"] = """SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language, CAST(len(regexp_extract_all(html, '<a href=')) AS INTEGER) AS links, CAST(len(regexp_extract_all(html, '<h1>')) AS INTEGER) AS h1s, CAST(strlen(html) AS INTEGER) AS html_bytes,
  CAST(len(regexp_extract_all(html, '<script>')) AS INTEGER) AS js_inline, CAST(len(regexp_extract_all(html, '<style>')) AS INTEGER) AS css_inline, contains(html, 'name="viewport"') AS mobile FROM pages"""


def readability(spark, sf_dir):
    """Reading ease and class of the documents that it says something about."""
    docs = I.table(spark, sf_dir, "documents").filter(X.scoreable(F.col("text"), F.col("lang")))
    return docs.select("doc_id", F.round(X.flesch(F.col("text")), 4).alias("flesch")).withColumn("class", X.flesch_class(F.col("flesch")))


QUERIES["t3_readability"] = readability
