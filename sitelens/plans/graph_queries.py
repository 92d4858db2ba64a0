"""Registered queries over the links of the given pages' own html, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import links as ops
from ..sources.html import extract_pages
from . import inputs as I
from .page_queries import ROUNDS

QUERIES, SQL = {}, {}

STATUS = "CASE WHEN page_id % 17 = 16 THEN 404 WHEN page_id % 23 = 22 THEN 500 WHEN page_id % 13 = 12 THEN 301 ELSE 200 END"
#: The crawl: the given pages, and of the addresses that they lead to those with a length that 5 doesn't divide.
CRAWLED = f"""
SELECT url, {STATUS} AS status_code FROM {{pages}}
UNION ALL SELECT url, CASE WHEN length(url) % 3 = 0 THEN 404 ELSE 200 END FROM (SELECT DISTINCT url FROM {{edges}}) WHERE length(url) % 5 <> 0"""
#: Pages that were asked for by another address, came over hops, or name another page as theirs; later rows have smaller targets, so chains end.
MOVED = f"""
SELECT page_id, url, {STATUS} AS status_code,
  CASE WHEN page_id % 7 = 3 THEN concat('https://old.example/', CAST(page_id % 40 AS STRING)) WHEN page_id % 11 = 5 THEN concat('https://old.example/', CAST(page_id % 40 + 1000 AS STRING)) END AS original_url,
  CASE WHEN page_id % 5 = 2 THEN concat('https://hop.example/', CAST(page_id % 30 AS STRING)) WHEN page_id % 5 = 4 THEN concat('https://old.example/', CAST(page_id % 40 AS STRING)) END AS hop,
  CASE WHEN page_id % 9 = 4 THEN concat('https://old.example/', CAST(page_id % 40 + 1000 AS STRING)) WHEN page_id % 9 = 6 THEN 'https://end.example/' END AS canonical
FROM {{pages}}"""

BASE = f"""
WITH p AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS src, lower(regexp_extract(url, '^(https?://[^/]+)', 1)) AS site, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs, {STATUS} AS status_code FROM pages),
link AS (SELECT page_id, url AS source_url, src, site || unnest(hrefs) AS url, CAST(unnest(range(len(hrefs))) AS INTEGER) AS slot FROM p),
crawled AS ({CRAWLED.format(pages="pages", edges="link")}),
known AS (SELECT regexp_replace(url, '#.*$', '') AS url, status_code FROM crawled),
status AS (SELECT link.*, status_code AS status, CASE WHEN status_code >= 400 THEN 'HTTP Error: ' || status_code END AS error FROM link LEFT JOIN known ON known.url = link.url)
"""
TARGET = "regexp_replace(split_part({}, '#', 1), '/$', '')"


def edges(spark, sf_dir):
    """The anchors of the given pages."""
    return ops.page_edges(extract_pages(I.table(spark, sf_dir, "pages"), "page_id", only=["url", "links"]), "page_id")


def crawled(spark, sf_dir, links):
    return spark.sql(CRAWLED, pages=I.table(spark, sf_dir, "pages"), edges=links)


def statuses(spark, sf_dir):
    links = ops.materialized(edges(spark, sf_dir), "anchors")  # parsed once
    return ops.reconcile(links, crawled(spark, sf_dir, links))


def add(name, make, sql):
    QUERIES[name] = make
    SQL[name] = BASE + sql


add("a19_page_inlinks", lambda s, d: ops.inlinks(edges(s, d)), f"SELECT {TARGET.format('url')} AS target, count(*) AS total, count(DISTINCT {TARGET.format('source_url')}) AS unique_sources FROM link GROUP BY 1")
add("a21_page_outlinks", lambda s, d: ops.outlinks(edges(s, d)), "SELECT source_url, count(*) AS total, count(DISTINCT split_part(url, '#', 1)) AS unique_links FROM link GROUP BY 1")
add("g5_page_degrees", lambda s, d: ops.degrees(edges(s, d)), "SELECT url, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT DISTINCT src AS url, 1 AS o, 0 AS i, url AS other FROM link UNION ALL SELECT DISTINCT url, 0, 1, src FROM link) GROUP BY 1")
add("j13_page_links", lambda s, d: statuses(s, d).select("source_url", "url", "slot", "status", "error"), "SELECT source_url, url, slot, status, error FROM status")
add("a20_page_broken_links", lambda s, d: ops.broken_links(statuses(s, d)), "SELECT url, max(status) AS status, max(error) AS reason, count(DISTINCT source_url) AS pages, string_agg(DISTINCT source_url, ' ' ORDER BY source_url) AS sources FROM status WHERE status >= 400 GROUP BY 1")
add("j16_page_carriers", lambda s, d: ops.carriers(I.table(s, d, "pages").select("page_id", "url"), statuses(s, d)), "SELECT page_id, url FROM p WHERE url IN (SELECT source_url FROM status WHERE status >= 400)")
add("g6_page_depth", lambda s, d: ops.click_depth(edges(s, d).select(U.norm_url(F.col("source_url")).alias("source_url"), U.norm_url(F.col("url")).alias("url")), I.table(s, d, "pages").filter("page_id % 10 = 0").select(U.norm_url(F.col("url")).alias("url"))),
    "SELECT url, CAST(depth AS INTEGER) AS depth FROM (WITH RECURSIVE e AS (SELECT DISTINCT src AS s, url AS t FROM link), r(url, depth) USING KEY (url) AS (SELECT DISTINCT src, 0 FROM p WHERE page_id % 10 = 0 UNION SELECT e.t, min(r.depth) + 1 FROM r JOIN e ON e.s = r.url WHERE NOT EXISTS (SELECT 1 FROM recurring.r k WHERE k.url = e.t) GROUP BY e.t) SELECT * FROM r)")


def _score(spark, sf_dir):
    links = ops.materialized(edges(spark, sf_dir), "anchors")
    return ops.link_score(crawled(spark, sf_dir, links).withColumn("canonical", F.lit(None).cast("string")), links)


add("g2_page_link_score", _score, f"""
, el AS (SELECT DISTINCT url FROM known WHERE status_code BETWEEN 200 AND 299), n AS (SELECT count(*) AS n FROM el),
ed AS (SELECT DISTINCT src AS s, url AS t FROM link WHERE src <> url AND src IN (SELECT url FROM el)),
w AS (SELECT s, t, 1.0::DOUBLE / count(*) OVER (PARTITION BY s) AS w FROM ed),
s0 AS (SELECT url, 1.0::DOUBLE / n AS v FROM el CROSS JOIN n), {ROUNDS}
SELECT url, CAST(floor(round(CASE WHEN (SELECT max(v) - min(v) FROM s10) < 1e-12 THEN 100.0 ELSE 1 + (v - (SELECT min(v) FROM s10)) / (SELECT max(v) - min(v) FROM s10) * 99 END, 6) + 0.5) AS BIGINT) AS score FROM s10""")


def moved(spark, sf_dir):
    """Pages with the addresses that they were reached by."""
    return spark.sql(MOVED, pages=I.table(spark, sf_dir, "pages")).withColumn("redirect_chain", F.when(F.col("hop").isNotNull(), F.array("hop"))).drop("hop")


def _bypass(spark, sf_dir):
    hops = ops.materialized(ops.bypass_of(moved(spark, sf_dir), "page_id"), "bypass")
    return ops.resolve_bypass(hops.select(F.col("src").alias("url")), hops)


QUERIES["g1_bypass"] = _bypass
SQL["g1_bypass"] = f"""
WITH RECURSIVE m AS (SELECT *, regexp_replace(url, '#.*$', '') AS own FROM ({MOVED.format(pages="pages")})),
ops AS (SELECT original_url AS src, own AS dst, page_id * 3 AS o, true AS over FROM m WHERE original_url IS NOT NULL UNION ALL SELECT hop, own, page_id * 3 + 1, false FROM m WHERE hop IS NOT NULL UNION ALL SELECT own, canonical, page_id * 3 + 2, true FROM m WHERE canonical IS NOT NULL),
b AS (SELECT src, coalesce(arg_max(dst, o) FILTER (WHERE over), arg_min(dst, o) FILTER (WHERE NOT over)) AS dst FROM ops GROUP BY src),
r(src, cur, n) USING KEY (src, cur) AS (SELECT src, src, 0 FROM b UNION SELECT r.src, b.dst, min(r.n) + 1 FROM r JOIN b ON b.src = r.cur WHERE NOT EXISTS (SELECT 1 FROM recurring.r k WHERE k.src = r.src AND k.cur = b.dst) GROUP BY r.src, b.dst),
l AS (SELECT src, arg_max(cur, n) AS cur FROM r GROUP BY src)
SELECT l.src, coalesce(b.dst, l.cur) AS dst FROM l LEFT JOIN b ON b.src = l.cur"""

#: Search rules over the given html: (id, name, mode, pattern, target, attribute, search_text, enabled).
SEARCHES = [
    (1, "Heading", "css", "article > h1", "text", None, None, True),
    (2, "T link", "css", 'nav li > a[href^="/t"]', "attribute", "href", None, True),
    (3, "Ad", "css", "body div.ad", "text", None, "la", True),
    (4, "Nothing", "css", "#none .x, aside", "text", None, None, True),
    (5, "Not a selector", "css", "a[", "text", None, None, True),
    (6, "Style", "css", "head style", "html", None, None, True),
    (7, "Disabled", "css", "p", "text", None, None, False),
]
RULES_SQL = {
    1: f"nullif({I.sql_text("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}, '')",
    2: "nullif(regexp_extract(html, '<li><a href=\"(/t[^\"]*)\"', 1), '')",
    3: I.sql_text("nullif(regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1), '')"),
    4: "NULL",
    5: "NULL",
    6: "nullif(regexp_extract(html, '<style>[^<]*</style>'), '')",
}


def _custom(spark, sf_dir):
    from ..sources.html import RULE, custom_results

    return custom_results(I.table(spark, sf_dir, "pages"), spark.createDataFrame(SEARCHES, RULE), "page_id").select("page_id", "rule_id", "name", "matched", "value")


QUERIES["x1_custom_search"] = _custom
_CUT = "CASE WHEN strlen(value) > 300 THEN value[1:list_max(list_filter(range(1, 301), lambda k: strlen(value[1:k]) <= 300))] || '...' ELSE value END"
SQL["x1_custom_search"] = f"SELECT page_id, rule_id, name, value IS NOT NULL AND (rule_id <> 3 OR contains(value, 'la')) AS matched, {_CUT} AS value FROM (" + " UNION ALL ".join(f"SELECT page_id, CAST({i} AS BIGINT) AS rule_id, '{SEARCHES[i - 1][1]}' AS name, CAST({sql} AS VARCHAR) AS value FROM pages" for i, sql in RULES_SQL.items()) + ")"
