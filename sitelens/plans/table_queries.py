"""Registered queries of the internal table and of indexability in full, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as T
from ..operators import links as links_ops
from ..operators import pages as ops
from ..sources.html import extract_pages
from . import graph_queries as G
from . import inputs as I

QUERIES, SQL = {}, {}

#: What the crawl says beside the html, by page: response headers, metas and canonicals as they are written, all alike in both engines.
HEADERS = """
SELECT page_id, url, CASE WHEN page_id % 17 = 16 THEN 404 WHEN page_id % 23 = 22 THEN 204 WHEN page_id % 13 = 12 THEN 301 ELSE 200 END AS status_code,
  CASE page_id % 19 WHEN 0 THEN 'googlebot: noindex' WHEN 1 THEN 'unavailable_after: 25 Jun 2030, noarchive' WHEN 2 THEN 'otherbot: noindex; nosnippet' WHEN 3 THEN ' Index; NOFOLLOW' WHEN 4 THEN 'none' WHEN 5 THEN 'bingbot : "all"' END AS header,
  CASE page_id % 7 WHEN 0 THEN 'robots' WHEN 1 THEN ' GoogleBot-News ' WHEN 2 THEN 'otherbot' ELSE NULL END AS meta,
  CASE page_id % 11 WHEN 0 THEN 'noindex,follow' WHEN 1 THEN 'index follow' WHEN 2 THEN 'max-snippet:20, nofollow' WHEN 3 THEN 'none;' ELSE 'all' END AS content,
  CASE page_id % 8 WHEN 0 THEN '/elsewhere' WHEN 1 THEN concat(url, '#part') WHEN 2 THEN concat(url, ' ', url) WHEN 3 THEN 'HTTPS://Other.example:443' WHEN 4 THEN '?page=9' END AS canonical
FROM {pages}"""


def headers(spark, sf_dir):
    rows = spark.sql(HEADERS, pages=I.table(spark, sf_dir, "pages"))
    meta = F.struct(F.col("meta").alias("name"), F.col("content"))
    return rows.withColumns({"x_robots": F.when(F.col("header").isNotNull(), F.array("header")), "robots_meta": F.when(F.col("meta").isNotNull(), F.array(meta)), "canonicals": F.split("canonical", " ")})


def _words(value: str) -> str:
    """The directives in a text column, in SQL."""
    part = "CASE WHEN NOT contains(p, ':') THEN p WHEN trim(split_part(p, ':', 1)) IN (" + ", ".join(f"'{a}'" for a in T.ROBOT_AGENTS) + ") THEN regexp_replace(p, '^[^:]*:', '') ELSE '' END"
    return rf"list_transform(flatten(list_transform(regexp_split_to_array(lower(coalesce({value}, '')), '[,;]'), lambda p: regexp_split_to_array(trim({part}), '\s+'))), lambda w: regexp_replace(w, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g'))"


QUERIES["p28_page_indexability"] = lambda s, d: ops.page_indexability(headers(s, d)).select("page_id", "indexability", "reason")
SQL["p28_page_indexability"] = rf"""
WITH h AS (SELECT *, regexp_replace(url, '#.*$', '') AS own, {_words("header")} AS hw, {_words("CASE WHEN lower(trim(meta)) IN (" + ", ".join(f"'{a}'" for a in T.ROBOT_AGENTS) + ") THEN content END")} AS mw FROM ({HEADERS.format(pages="pages")})),
t AS (SELECT *, CASE page_id % 8 WHEN 0 THEN regexp_extract(url, '^(https?://[^/]*)', 1) || '/elsewhere' WHEN 1 THEN own WHEN 3 THEN 'https://other.example/' WHEN 4 THEN split_part(own, '?', 1) || '?page=9' END AS target FROM h)
SELECT page_id, CAST(CASE WHEN status_code NOT BETWEEN 200 AND 299 OR status_code = 204 OR list_has_any(hw, ['noindex', 'none']) OR list_has_any(mw, ['noindex', 'none']) OR page_id % 8 = 2 THEN 0 WHEN target = own THEN 1 WHEN target IS NOT NULL THEN 0 WHEN list_contains(hw, 'nofollow') OR list_contains(mw, 'nofollow') THEN 0.8 ELSE 1 END AS DOUBLE) AS indexability,
  CASE WHEN status_code NOT BETWEEN 200 AND 299 OR status_code = 204 THEN 'Not indexable: HTTP status ' || status_code WHEN list_has_any(hw, ['noindex', 'none']) THEN 'Not indexable: X-Robots-Tag contains noindex' WHEN list_has_any(mw, ['noindex', 'none']) THEN 'Not indexable: meta robots contains noindex'
    WHEN page_id % 8 = 2 THEN 'Not indexable: multiple canonical links found' WHEN target = own THEN 'Indexable: self-referencing canonical' WHEN target IS NOT NULL THEN 'Not indexable: canonical points to ' || target
    WHEN list_contains(hw, 'nofollow') OR list_contains(mw, 'nofollow') THEN 'Indexable: nofollow directive present' WHEN list_has_any(hw || mw, ['index', 'all']) THEN 'Indexable: explicit index directive present' ELSE 'Indexable: successful response with no blocking directive' END AS reason
FROM t"""


def internal(spark, sf_dir):
    """The internal table of the given pages: facts and links of their html in one parse, the crawl's side by page."""
    facts = extract_pages(I.table(spark, sf_dir, "pages"), "page_id", only=["url", "title", "headings", "links", "language", "html_bytes"]).withColumn("headings", F.col("headings")["h1"]).withColumnRenamed("headings", "h1")
    facts = I.materialized(facts, "facts")
    links = links_ops.page_edges(facts)
    crawl = ops.page_indexability(headers(spark, sf_dir)).select("page_id", "status_code", "x_robots", F.transform("robots_meta", lambda m: m["content"]).alias("robots"), "canonicals", "indexability", "reason")
    more = {"word_count": F.col("page_id") * 37 % 1200, "sentence_count": F.col("page_id") % 40, "flesch": (F.col("page_id") * 7 % 1000) / 9, "url_depth": F.when(F.col("page_id") % 9 < 8, F.col("page_id") % 6), "response_time": F.col("page_id") % 30 / 10, "cookies": F.col("page_id") % 7, "h2": F.when(F.col("page_id") % 3 == 0, F.array(F.lit("Part"), F.lit("Other part")))}
    pages = facts.drop("links").join(crawl, "page_id").withColumns(more)
    scores = links_ops.link_score(G.crawled(spark, sf_dir, links).withColumn("canonical", F.lit(None).cast("string")), links)
    return ops.internal_table(pages, links, scores)


QUERIES["p32_internal_table"] = internal
_KNOWN = {
    "address": "CASE WHEN contains(url, '%') THEN url_decode(url) ELSE url END", "content_type": "'text/html'", "status_code": "status_code", "status": "CASE status_code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in T.STATUS_TEXT.items()) + " ELSE '' END",
    "indexability": "CASE WHEN indexability >= 0.5 THEN 'Indexable' ELSE 'Non-Indexable' END", "indexability_status": "reason", "title_1": "title", "title_1_length": "nullif(length(title), 0)", "title_1_pixels": "CASE WHEN title <> '' THEN CAST(floor(length(title) * 9.5 + 0.5) AS BIGINT) END",
    "h1_1": "h1", "h1_1_length": "nullif(length(h1), 0)", "h2_1": "h2[1]", "h2_1_length": "length(h2[1])", "h2_2": "h2[2]", "h2_2_length": "length(h2[2])", "meta_robots_1": "CASE WHEN meta IS NOT NULL THEN content END", "x_robots_tag_1": "header", "canonical_1": "split_part(canonical, ' ', 1)",
    "size_bytes": "bytes", "transferred_bytes": "bytes", "total_transferred_bytes": "bytes", "co2_mg": "round(bytes * 0.000000000072::DOUBLE * 442 * 1000, 3)", "carbon_rating": "'A+'", "word_count": "words", "sentence_count": "page_id % 40", "words_per_sentence": "CASE WHEN words > 0 AND page_id % 40 > 0 THEN round(words / (page_id % 40), 2) END",
    "flesch": "round((page_id * 7 % 1000) / 9, 2)", "crawl_depth": "CASE WHEN page_id % 9 < 8 THEN page_id % 6 END", "folder_depth": "len(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''))", "link_score": "score",
    "inlinks": "coalesce(i.total, 0)", "unique_inlinks": "coalesce(i.sources, 0)", "percent_of_total": "round(coalesce(i.sources, 0) * 100.0 / greatest(count(*) OVER (), 1), 2)", "outlinks": "coalesce(o.total, 0)", "unique_outlinks": "coalesce(o.targets, 0)", "external_outlinks": "0", "unique_external_outlinks": "0",
    "response_time": "page_id % 30 / 10", "cookies": "page_id % 7", "language": "nullif(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1), '')",
    "encoded_address": "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(url_encode(CASE WHEN contains(url, '%') THEN url_decode(url) ELSE url END), '%3A', ':'), '%2F', '/'), '%3F', '?'), '%23', '#'), '%3D', '='), '%26', '&'), '%40', '@'), '%2B', '+'), '%24', '$'), '%2C', ','), '%3B', ';'), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')')",
}
SQL["p32_internal_table"] = G.SQL["g2_page_link_score"].rsplit("SELECT url, CAST(floor(", 1)[0] + f""",
score AS (SELECT url AS u, {"CAST(floor(" + G.SQL["g2_page_link_score"].rsplit("SELECT url, CAST(floor(", 1)[1]}),
ix AS ({SQL["p28_page_indexability"]}),
i AS (SELECT {G.TARGET.format('url')} AS k, count(*) AS total, count(DISTINCT {G.TARGET.format('source_url')}) AS sources FROM link GROUP BY 1), o AS (SELECT {G.TARGET.format('source_url')} AS k, count(*) AS total, count(DISTINCT {G.TARGET.format('url')}) AS targets FROM link GROUP BY 1),
z AS (SELECT h.*, ix.indexability, ix.reason, html, CAST(strlen(html) AS BIGINT) AS bytes, h.page_id * 37 % 1200 AS words, CASE WHEN h.page_id % 3 = 0 THEN ['Part', 'Other part'] END AS h2, trim(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&')) AS title, regexp_replace(trim(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;', '&')), '\\s+', ' ', 'g') AS h1
  FROM ({HEADERS.format(pages="pages")}) h JOIN ix USING (page_id) JOIN (SELECT page_id, html FROM pages) USING (page_id))
SELECT """ + ", ".join(f"{_KNOWN.get(c, 'CAST(NULL AS VARCHAR)')} AS {c}" for c in ops.INTERNAL) + f" FROM z LEFT JOIN i ON i.k = {G.TARGET.format('z.url')} LEFT JOIN o ON o.k = {G.TARGET.format('z.url')} LEFT JOIN score ON score.u = regexp_replace(z.url, '#.*$', '')"

#: Two reports a page, as the speed test answers: display values, numbers, nulls and missing measures by page.
REPORTS = """
SELECT page_id, url, concat('{{"Ok":[{{"categories":{{"performance":{{"score":0.', CAST(page_id % 90 + 10 AS STRING), '}},"seo":{{"score":', CASE WHEN page_id % 5 = 0 THEN 'null' ELSE '1' END, '}}}},"audits":{{"speed-index":{{', CASE WHEN page_id % 3 = 0 THEN concat('"displayValue":"', CAST(page_id % 9 AS STRING), ' s",') ELSE '' END, '"numericValue":', CAST(page_id % 7000 AS STRING), '.25}},"dom-size":{{"displayValue":"', CAST(page_id * 3 AS STRING), ' elements"}},"redirects":{{"score":', CAST(page_id % 2 AS STRING), '}}}}}}',
  CASE WHEN page_id % 4 = 1 THEN '' ELSE concat(',{{"categories":{{"performance":{{"score":0.5}}}},"audits":{{"total-byte-weight":{{"numericValue":', CAST(page_id * 1000 AS STRING), '}}}}}}') END, ']}}') AS psi_results
FROM {pages}"""


def _vitals(spark, sf_dir):
    from ..sources.web import vitals

    return vitals(spark.sql(REPORTS, pages=I.table(spark, sf_dir, "pages")))


def _vital(i: int, path: str, display: bool) -> str:
    at = lambda x: f"json_extract(psi_results, '$.Ok[{i}].{x}')"
    if not display:
        return f"coalesce(CAST(CAST(floor(TRY_CAST({at(path + '.score')} AS DOUBLE) * 100 + 0.5) AS BIGINT) AS VARCHAR), 'n/a')"
    return f"coalesce(json_extract_string(psi_results, '$.Ok[{i}].{path}.displayValue'), printf('%.2f', TRY_CAST({at(path + '.numericValue')} AS DOUBLE)), 'n/a')"


def _vitals_sql() -> str:
    from ..sources.web import CATEGORIES, VITALS

    cells = []
    for short, name in VITALS.items():
        sides = ((0, ""),) if short in ("redirects", "dom_nodes") else ((0, "_m"), (1, "_d"))
        path = f'categories."{name}"' if short in CATEGORIES else f'audits."{name}"'
        cells += [f"{_vital(i, path, short not in (*CATEGORIES, 'redirects'))} AS {short}{side}" for i, side in sides]
    return f"SELECT url, {', '.join(cells)} FROM ({REPORTS.format(pages='pages')})"


QUERIES["s21_vitals"] = _vitals
SQL["s21_vitals"] = _vitals_sql()


def _exports(spark, sf_dir):
    from ..operators import exports

    facts = extract_pages(I.table(spark, sf_dir, "pages"), "page_id", only=["url", "title", "headings", "links", "css", "images", "language", "mobile", "html_bytes"]).select("page_id", "url", "title", F.col("headings")["h1"].alias("h1"), "links", "css", "images", "language", "mobile", "html_bytes")
    hop = F.struct(F.concat(F.lit("https://old.example/"), F.col("page_id").cast("string")).alias("url"), F.lit(301).alias("status_code"), F.col("url").alias("location"))
    crawl = ops.page_indexability(headers(spark, sf_dir)).select("page_id", "status_code", "indexability", "robots_meta")
    pages = facts.join(crawl, "page_id").withColumns({"robots": F.transform("robots_meta", lambda m: m["content"]), "redirect_chain": F.when(F.col("page_id") % 13 == 12, F.array(hop))})
    return exports.crawl_tables(pages).select("kind", "url", F.array_join("cells", "|").alias("cells"))


QUERIES["s16_crawl_tables"] = _exports
SQL["s16_crawl_tables"] = f"""
WITH ix AS ({SQL["p28_page_indexability"]}),
z AS (SELECT h.*, ix.indexability, html, {I.sql_title()} AS title, {I.sql_h1()} AS h1,
  regexp_extract(html, '<html lang="([^"]*)"', 1) AS language FROM ({HEADERS.format(pages="pages")}) h JOIN ix USING (page_id) JOIN (SELECT page_id, html FROM pages) USING (page_id)),
l AS (SELECT url AS page, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS anchor FROM pages)
SELECT 'main' AS kind, url, url || '|' || title || '|' || length(title) || '|||' || h1 || '|' || length(h1) || '|||' || status_code || '|||||' || 'false' || '|' || coalesce(CASE WHEN meta IS NOT NULL THEN content END, '') || '||' || CASE WHEN indexability >= 0.5 THEN 'Indexable' ELSE 'Not indexable' END || '|' || language || '|||||' || strlen(html) || '|' AS cells FROM z
UNION ALL SELECT 'links', page, regexp_replace({I.sql_strip(I.sql_text("anchor"))}, '{I.BLANK}+', ' ', 'g') || '||' || regexp_extract(page, '^(https?://[^/]+)', 1) || href || '||||' || page FROM l
UNION ALL SELECT 'keywords', url, url || repeat('|', 20) FROM z
UNION ALL SELECT 'redirects', url, 'https://old.example/' || page_id || '|301|' || url || '|1|301 Redirect' FROM z WHERE page_id % 13 = 12
"""
