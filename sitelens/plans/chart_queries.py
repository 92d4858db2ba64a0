"""Registered queries of the charts' distributions, the tree of addresses and the links' tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import urls as U
from ..operators import audit
from ..operators import charts as ops
from ..operators import links as links_ops
from ..operators.pages import page_indexability
from . import graph_queries as G
from . import inputs as I
from . import table_queries as TQ

QUERIES, SQL = {}, {}

#: What charts show beside the given addresses, by page.
MORE = "SELECT page_id, CASE WHEN page_id % 11 < 10 THEN page_id * 13 % 1500 END AS kb, CASE WHEN page_id % 7 < 6 THEN page_id * 17 % 101 END AS link_score, CASE WHEN page_id % 3 = 0 THEN 'Thing' END AS schema, page_id % 4 <> 1 AS mobile, page_id % 29 = 5 AS had_redirect FROM {pages}"


def pages(spark, sf_dir):
    own = page_indexability(TQ.headers(spark, sf_dir)).select("page_id", "url", "status_code", "indexability", "reason")
    return own.join(spark.sql(MORE, pages=I.table(spark, sf_dir, "pages")), "page_id")


BASE = f"""
WITH ix AS ({TQ.SQL["p28_page_indexability"]}),
s AS (SELECT h.page_id, h.url, h.status_code, ix.indexability, ix.reason, m.kb, m.link_score, m.schema, m.mobile, m.had_redirect, list_filter(string_split(regexp_extract(h.url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM ({TQ.HEADERS.format(pages="pages")}) h JOIN ix USING (page_id) JOIN ({MORE.format(pages="pages")}) m USING (page_id))
"""


def add(name, make, sql):
    QUERIES[name] = lambda spark, sf_dir: make(pages(spark, sf_dir))
    SQL[name] = BASE + sql


def _bucket(value: str, cases: str) -> str:
    return f"SELECT {cases} AS bucket, count(*) AS pages, (SELECT CAST(floor(avg({value}) + 0.5) AS BIGINT) FROM s) AS mean FROM s WHERE {value} IS NOT NULL GROUP BY 1"


add("a29_page_weights", ops.page_weights, _bucket("kb", "CASE WHEN kb < 100 THEN 'Light (<100KB)' WHEN kb < 500 THEN 'Medium (100-500KB)' WHEN kb < 1024 THEN 'Heavy (500KB-1MB)' ELSE 'Very Heavy (>1MB)' END"))
add("a29_link_scores", ops.link_scores, _bucket("link_score", "CASE WHEN link_score = 0 THEN 'Orphaned (0)' WHEN link_score < 40 THEN 'Weak (1-39)' WHEN link_score < 70 THEN 'Moderate (40-69)' ELSE 'Strong (70-100)' END"))
add("a29_compliance", ops.compliance, " UNION ALL ".join(f"SELECT '{k}' AS signal, count(*) FILTER (WHERE {c}) AS covered, round(count(*) FILTER (WHERE {c}) * 100.0 / count(*), 6) AS percent FROM s" for k, c in (("https", "starts_with(url, 'https://')"), ("schema", "schema IS NOT NULL"), ("mobile", "mobile"))))
add("a29_top_reasons", ops.top_reasons, "SELECT reason, count(*) AS pages FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
add("a29_treemap_levels", lambda p: ops.treemap(p, 3, 4), """
, t AS (SELECT coalesce(parts[1], '(root)') AS top, coalesce(parts[2], '(index)') AS sub, count(*) AS n FROM s GROUP BY 1, 2), f AS (SELECT top FROM t GROUP BY 1 ORDER BY sum(n) DESC, top LIMIT 3),
r AS (SELECT *, top IN (SELECT top FROM f) AS inside, row_number() OVER (PARTITION BY top ORDER BY n DESC, sub) AS r FROM t)
SELECT CASE WHEN inside THEN top ELSE '...' END AS top, CASE WHEN inside AND r <= 4 THEN sub ELSE '...' END AS sub, CAST(sum(n) AS BIGINT) AS pages, CASE WHEN bool_and(inside) THEN count(*) ELSE count(DISTINCT r.top) FILTER (WHERE NOT inside) END AS names FROM r GROUP BY 1, 2""")
add("a39_url_tree", ops.url_tree, """
SELECT node, CAST(depth AS INTEGER) AS depth, bool_or(last) AS is_page, count(*) FILTER (WHERE NOT last) AS below, arg_max(status_code, (url, status_code, indexability >= 0.5)) FILTER (WHERE last) AS status_code, arg_max(indexability >= 0.5, (url, status_code, indexability >= 0.5)) FILTER (WHERE last) AS indexable
FROM (SELECT *, array_to_string(['root'] || parts[1:depth], '/') AS node, depth = len(parts) AS last FROM (SELECT *, unnest(range(0, len(parts) + 1)) AS depth FROM s)) GROUP BY 1, 2""")
add("a39_url_tree_totals", lambda p: ops.url_tree_totals(ops.url_tree(p)), """
, n AS (SELECT array_to_string(['root'] || parts[1:depth], '/') AS node, depth, bool_or(depth = len(parts)) AS is_page, count(*) FILTER (WHERE depth < len(parts)) AS below FROM (SELECT *, unnest(range(0, len(parts) + 1)) AS depth FROM s) GROUP BY 1, 2)
SELECT count(*) FILTER (WHERE is_page) AS pages, count(*) FILTER (WHERE below > 0 AND depth > 0) AS folders, CAST(max(depth) AS INTEGER) AS max_depth FROM n""")
add("f12_redirects", lambda p: audit.redirects(p).select("page_id", "url"), "SELECT page_id, url FROM s WHERE had_redirect OR status_code BETWEEN 300 AND 399")

_END = "regexp_extract(list_last(string_split(regexp_extract({0}, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')), '\\.([^.]*)$', 1)"
_KIND = "CASE lower(" + _END + ") " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.CONTENT_TYPES.items()) + " ELSE '' END"
_ASSET = "url || '/dir.d/a.' || list_extract(['JS', 'png', 'tar.zip', 'none', 'woff2?x=a.css', ''], CAST(page_id % 6 + 1 AS INTEGER))"
QUERIES["p17_content_types"] = lambda s, d: I.table(s, d, "pages").select("page_id", F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/dir.d/a."), F.element_at(F.array(*map(F.lit, ["JS", "png", "tar.zip", "none", "woff2?x=a.css", ""])), (F.col("page_id") % 6 + 1).cast("int"))).alias("u")).select("page_id", U.content_type_for(F.col("u")).alias("content_type"), U.content_type_for(F.col("u"), F.when(F.col("page_id") % 5 == 0, "text/x")).alias("known"))
SQL["p17_content_types"] = f"SELECT page_id, {_KIND.format('u')} AS content_type, CASE WHEN page_id % 5 = 0 THEN 'text/x' ELSE {_KIND.format('u')} END AS known FROM (SELECT page_id, {_ASSET.replace('url', chr(114) + 'egexp_replace(url, ' + chr(39) + '[?#].*$' + chr(39) + ', ' + chr(39) * 2 + ')')} AS u FROM pages)"


# links of the given html
QUERIES["a21_page_outlinks_split"] = lambda s, d: links_ops.outlinks_split(G.edges(s, d).withColumn("internal", F.col("internal") & (F.col("slot") % 3 > 0)))
SQL["a21_page_outlinks_split"] = G.BASE + "SELECT source_url, count(*) FILTER (WHERE i) AS internal, count(DISTINCT url) FILTER (WHERE i) AS unique_internal, count(*) FILTER (WHERE NOT i) AS external, count(DISTINCT url) FILTER (WHERE NOT i) AS unique_external FROM (SELECT *, slot % 3 > 0 AS i FROM link) GROUP BY 1"


def _scored(spark, sf_dir):
    links = links_ops.materialized(G.edges(spark, sf_dir), "anchors")
    scores = links_ops.link_score(G.crawled(spark, sf_dir, links).withColumn("canonical", F.lit(None).cast("string")), links)
    return links_ops.scored_links(links, scores).select("page_id", "slot", "url", "link_score")


QUERIES["j12_scored_links"] = _scored
_SCORE = G.SQL["g2_page_link_score"].rsplit("SELECT url, CAST(floor(", 1)
SQL["j12_scored_links"] = _SCORE[0] + f", score AS (SELECT url AS u, CAST(floor({_SCORE[1]}) SELECT page_id, slot, url, score AS link_score FROM link LEFT JOIN score ON u = url"
QUERIES["a22_files"] = lambda s, d: links_ops.linked_files(G.edges(s, d).withColumn("url", F.concat("url", F.element_at(F.array(F.lit(".pdf"), F.lit(""), F.lit(".zip?x")), (F.col("slot") % 3 + 1).cast("int")))))
SQL["a22_files"] = G.BASE + f"SELECT DISTINCT url, content_type FROM (SELECT u AS url, {_KIND.format('u')} AS content_type FROM (SELECT url || list_extract(['.pdf', '', '.zip?x'], CAST(slot % 3 + 1 AS INTEGER)) AS u FROM link)) WHERE content_type <> ''"
_DRAWN = G.BASE + """, e AS (SELECT DISTINCT source_url AS a, url AS b FROM link WHERE source_url <> url), d AS (SELECT url, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(*) AS degree FROM (SELECT a AS url, 0 AS i, 1 AS o FROM e UNION ALL SELECT b, 1, 0 FROM e) GROUP BY 1),
top AS (SELECT url FROM d ORDER BY degree DESC, url LIMIT 40), root AS (SELECT p.url FROM p JOIN d ON d.url = p.url WHERE p.page_id = 249), kept AS (SELECT url FROM (SELECT url, min(o) AS o FROM (SELECT url, 0 AS o FROM root UNION ALL SELECT url, row_number() OVER (ORDER BY degree DESC, url) FROM d WHERE url IN (SELECT url FROM top)) GROUP BY 1) ORDER BY o LIMIT 40)
"""


def _drawn(which):
    def query(spark, sf_dir):
        depths = I.table(spark, sf_dir, "pages").select("url", F.when(F.col("page_id") == 249, 0).otherwise(1).alias("depth"))
        return links_ops.link_graph(G.edges(spark, sf_dir), depths, 40)[which]

    return query


QUERIES["g5_drawn_nodes"], SQL["g5_drawn_nodes"] = _drawn(0), _DRAWN + "SELECT url, in_degree, out_degree, degree FROM d WHERE url IN (SELECT url FROM kept)"
QUERIES["g5_drawn_edges"], SQL["g5_drawn_edges"] = _drawn(1), _DRAWN + "SELECT a AS source_url, b AS url FROM e WHERE a IN (SELECT url FROM kept) AND b IN (SELECT url FROM kept)"
