"""Registered audit queries with their SQL, over the pages' own html and derived facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import urls as U
from ..operators import audit as ops
from . import graph_queries
from . import inputs as I

QUERIES, SQL = {}, {}

KEY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '#.*$', ''), '^https?://', ''), '^www\\.', ''), '/$', '')"
ALTS = "list_transform(range(1, n_images + 1), lambda i: CASE WHEN (page_id + i) % 5 = 0 THEN '' WHEN (page_id + i) % 7 = 0 THEN repeat('alt ', 30) ELSE 'alt' END)"
BASE = rf"""
WITH raw AS ({I.AUDIT_ROWS.format(pages="pages")}),
found AS (SELECT page_id, trim(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&')) AS html_title, regexp_replace(trim(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;', '&')), '\s+', ' ', 'g') AS html_h1, CAST(contains(html, '<style') AS INTEGER) AS css_inline FROM pages),
p0 AS (SELECT raw.* EXCLUDE (h2, canonicals, robots), string_split(raw.h2, ',') AS h2, string_split(raw.canonicals, ',') AS canonicals, coalesce(lower(raw.robots), '') AS robots, css_inline,
  CASE WHEN page_id % 9 = 8 THEN '' ELSE html_title END AS title, CASE page_id % 10 WHEN 9 THEN CAST([] AS VARCHAR[]) WHEN 8 THEN [html_h1, 'Second'] ELSE [html_h1] END AS h1, {ALTS} AS alts,
  list_transform(range(1, n_images + 1), lambda i: (CASE WHEN page_id % 5 = 3 THEN 'http' ELSE 'https' END) || '://img.example/' || (page_id + i) % 50) AS image_urls, list_transform(range(1, n_images + 1), lambda i: (page_id * 31 + i * 17) % 200 * 1024) AS image_sizes FROM raw JOIN found USING (page_id)),
p AS (SELECT *, contains(content_type, 'html') AS page, coalesce(title, '') <> '' AND count(*) OVER (PARTITION BY trim(title)) > 1 AS dup_title, description IS NOT NULL AND count(*) OVER (PARTITION BY trim(description)) > 1 AS dup_description,
  coalesce(h1[1], '') <> '' AND count(*) OVER (PARTITION BY trim(coalesce(h1[1], ''))) > 1 AS dup_h1, coalesce(h2[1], '') <> '' AND count(*) OVER (PARTITION BY trim(coalesce(h2[1], ''))) > 1 AS dup_h2,
  coalesce({KEY.format("canonicals[1]")} = {KEY.format("url")}, false) AS own FROM p0)
"""
_TITLE = r"trim(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'))"
_H1 = r"regexp_replace(trim(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;', '&')), '\s+', ' ', 'g')"
#: BASE with titles and headings that have other references than &amp; too.
READ = BASE.replace(_TITLE, I.sql_title()).replace(_H1, I.sql_h1())


def add(name, make, sql, base=BASE):
    QUERIES[name] = lambda spark, sf_dir: make(I.audit_pages(spark, sf_dir))
    SQL[name] = base + sql


def _heading(h: str) -> dict[str, str]:
    return {"all": "true", "missing": f"page AND coalesce({h}[1], '') = ''", "duplicate": f"page AND dup_{h}", "over70": f"page AND length({h}[1]) > 70", "multiple": f"page AND len({h}) > 1"}


PAGED = "(next IS NOT NULL OR prev IS NOT NULL)"
TABS = {
    "pageTitles": {"all": "true", "missing": "page AND trim(title) = ''", "duplicate": "page AND dup_title", "over60": "page AND length(title) > 60", "below30": "page AND length(title) BETWEEN 1 AND 29", "multiple": "page AND titles > 1", "sameAsH1": "page AND title <> '' AND trim(title) = trim(coalesce(h1[1], ''))"},
    "metaDescription": {"all": "true", "missing": "page AND description IS NULL", "duplicate": "page AND dup_description", "over155": "page AND length(description) > 155", "below70": "page AND length(description) BETWEEN 1 AND 69"},
    "h1Tab": _heading("h1"), "h2Tab": _heading("h2"),
    "responseCodes": {"all": "true", "noResponse": "status_code = 0", "success": "status_code BETWEEN 200 AND 299", "redirect": "status_code BETWEEN 300 AND 399", "clientError": "status_code BETWEEN 400 AND 499", "serverError": "status_code >= 500"},
    "canonicalsTab": {"all": "true", "contains": "page AND canonicals IS NOT NULL", "self": "page AND own", "canonicalised": "page AND canonicals IS NOT NULL AND NOT own", "missing": "page AND canonicals IS NULL", "multiple": "page AND len(canonicals) > 1"},
    "directives": {"all": "true", "index": "contains(robots, 'index') AND NOT contains(robots, 'noindex')", "noindex": "contains(robots, 'noindex')", "follow": "contains(robots, 'follow') AND NOT contains(robots, 'nofollow')", "nofollow": "contains(robots, 'nofollow')", "noarchive": "contains(robots, 'noarchive')", "nosnippet": "contains(robots, 'nosnippet')", "none": "page AND robots = ''"},
    "security": {"all": "true", "http": "starts_with(url, 'http://')", "https": "starts_with(url, 'https://')", "mixed": "starts_with(url, 'https://') AND page_id % 5 = 3"},
    "contentTab": {"all": "true", "lowWord": "page AND word_count > 0 AND word_count < 300", "empty": "page AND word_count = 0", "readability": "flesch > 0 AND flesch < 30"},
    "urlTab": {"all": "true", "nonAscii": r"regexp_matches(url_decode(url), '[^\x00-\x7F]')", "underscores": "contains(url, '_')", "uppercase": "regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[A-Z]')", "multipleSlashes": "regexp_matches(replace(url, '://', ''), '//')", "params": "contains(url, '?')", "over115": "length(url) > 115", "space": r"regexp_matches(url, '%20|\s')"},
    "hreflangTab": {"all": "true", "contains": "page_id % 4 > 0", "missing": "page AND page_id % 4 = 0", "noSelf": "page_id % 4 = 3", "noXDefault": "page_id % 4 IN (1, 3)"},
    "structuredData": {"all": "true", "contains": "page_id % 3 = 0", "missing": "page AND page_id % 3 <> 0"},
    "imagesTab": {"all": "true", "missingAlt": "list_contains(alts, '')", "altOver100": "len(list_filter(alts, lambda x: length(x) > 100)) > 0"},
    "paginationTab": {"all": "true", "contains": PAGED, "firstPage": "next IS NOT NULL AND prev IS NULL", "lastPage": "prev IS NOT NULL AND next IS NULL", "selfRef": f"{KEY.format('next')} = {KEY.format('url')}", "nonIndexable": f"{PAGED} AND indexability < 0.5"},
    "ampTab": {"all": "true", "contains": "amp IS NOT NULL", "missing": "page AND amp IS NULL"},
}
add("f7_tab_counts", ops.tab_counts, " UNION ALL ".join(f"SELECT '{t}' AS tab, '{k}' AS filter, count(*) FILTER (WHERE {c}) AS pages, round(count(*) FILTER (WHERE {c}) * 100.0 / greatest(count(*), 1), 6) AS percent FROM p" for t, fs in TABS.items() for k, c in fs.items()), READ)
for _tab, _key in (("pageTitles", "duplicate"), ("canonicalsTab", "canonicalised"), ("metaDescription", "below70"), ("h2Tab", "duplicate"), ("imagesTab", "missingAlt"), ("hreflangTab", "noSelf"), ("urlTab", "uppercase")):
    add(f"f7_{_tab}_{_key}", lambda p, t=_tab, k=_key: ops.filter_tab(p, t, k).select("page_id", "url"), f"SELECT page_id, url FROM p WHERE {TABS[_tab][_key]}")
for _key, _sql in {"html": "contains(content_type, 'html')", "images": "starts_with(content_type, 'image')", "pdf": "contains(content_type, 'pdf')", "other": "content_type = 'application/octet-stream'"}.items():
    add(f"f8_content_{_key}", lambda p, k=_key: ops.content_tab(p, k).select("page_id", "content_type"), f"SELECT page_id, content_type FROM p WHERE {_sql}")
add("f9_url_filter", lambda p: ops.url_filter(p, ["/en/", "/fr/", "(("], ["page=2"]).select("page_id", "url"), "SELECT page_id, url FROM p WHERE (contains(url, '/en/') OR contains(url, '/fr/')) AND NOT contains(url, 'page=2')")
add("f11_page_search", lambda p: ops.search_pages(p.select("page_id", "url", "description", "h2"), "Only HERE 1").select("page_id"), "SELECT page_id FROM p WHERE contains(lower(array_to_string(h2, ' ')), 'only here 1')")
QUERIES["f14_html_test"] = lambda s, d: I.table(s, d, "pages").select("page_id", ops.is_html(F.col("html"), F.when(F.col("page_id") % 2 == 0, "text/html")).alias("is_html"), ops.is_html(F.substring("html", 1, 30), F.lit(None).cast("string")).alias("start_is_html"), ops.is_html(F.substring("html", 20, 9), F.lit("text/html")).alias("short_is_html"))
SQL["f14_html_test"] = "SELECT page_id, true AS is_html, contains(lower(html[1:30]), '<!doctype html') OR contains(lower(html[1:30]), '<html') AS start_is_html, false AS short_is_html FROM pages"

ISSUE_SQL = {
    1: "title = ''", 2: "description IS NULL", 3: "dup_title", 4: "length(title) > 60", 5: "length(title) < 30", 6: "dup_description", 7: "length(description) > 160", 8: "status_code BETWEEN 400 AND 499", 9: "status_code BETWEEN 500 AND 599",
    10: "len(h1) = 0", 11: "h2 IS NULL", 12: "len(h1) > 1", 13: "canonicals IS NULL", 14: "regexp_replace(canonicals[1], '/$', '') <> regexp_replace(url, '/$', '')", 15: "contains(robots, 'noindex')", 16: "contains(robots, 'nofollow')",
    17: "list_contains(alts, '')", 18: "len(list_filter(range(1, n_images + 1), lambda i: (page_id + i) % 13 = 0)) > 0", 19: "len(list_filter(image_sizes, lambda x: x > 102400)) > 0", 20: "response_time > 2", 21: "kb > 100", 22: "word_count < 300",
    23: "NOT starts_with(url, 'https')", 24: "redirect_count > 2", 25: "schema IS NULL", 26: "url_depth >= 4", 27: "NOT has_og", 29: "had_redirect", 30: "regexp_matches(url, '[A-Z]')", 31: "length(url) > 100",
    32: r"regexp_matches(url, '[_\s]')", 33: "flesch < 50", 34: "text_ratio < 10", 35: "language IS NULL", 36: "internal_links > 150", 37: "external_links > 50", 38: "css_inline > 0", 39: "mixed_content > 0", 40: "unsafe_anchors > 0", 41: "NOT mobile", 42: "cookies > 0",
    43: "len(list_filter(h2, lambda x: x IN (SELECT h FROM (SELECT unnest(h2) AS h FROM p) GROUP BY h HAVING count(*) > 1))) > 0",
}
ISSUE_SQL[43] = "page_id IN (SELECT page_id FROM (SELECT page_id, count(*) OVER (PARTITION BY h) AS n FROM (SELECT page_id, unnest(h2) AS h FROM p)) WHERE n > 1)"


#: The robots file of every host of the given pages.
ROBOTS = "# all\nUser-agent: *\nDisallow: /fr/\nAllow: /fr/8\nDisallow: /*ref=x$\n\nUser-agent: other\nDisallow: /\n"


def by_robots(pages):
    """The pages with their host and whether its robots file lets them be read."""
    from ..sources.web import robots_allowed, robots_rules

    named = pages.withColumn("host", U.host(F.col("url")))
    rules = robots_rules(named.select("host").distinct().withColumn("body", F.lit(ROBOTS)), "sitelens")
    return robots_allowed(named, rules)


def blocked(pages):
    """The pages (url) that their host's robots file keeps out."""
    return by_robots(pages.select("url")).filter("not allowed").select("url")


def _issues(make):
    """make(pages, blocked, broken): addresses by their robots rules, links by the anchors of the html and the crawl's statuses."""

    def query(spark, sf_dir):
        pages = I.materialized(I.audit_pages(spark, sf_dir), "audit-pages")
        dead = graph_queries.statuses(spark, sf_dir).filter("status >= 400").select("page_id").distinct()
        return make(pages, blocked(pages), dead, "page_id")

    return query


ROBOT_PATH = "regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '#.*$', '')"
ISSUE_SQL[28] = f"regexp_matches({ROBOT_PATH}, 'ref=x$') OR (starts_with({ROBOT_PATH}, '/fr/') AND NOT starts_with({ROBOT_PATH}, '/fr/8'))"
QUERIES["f10_robots_allowed"] = lambda s, d: by_robots(I.table(s, d, "pages").select("page_id", "url")).select("page_id", "allowed")
SQL["f10_robots_allowed"] = f"SELECT page_id, NOT ({ISSUE_SQL[28]}) AS allowed FROM pages"
ISSUE_SQL[44] = "page_id IN (SELECT page_id FROM (SELECT page_id, lower(regexp_extract(url, '^(https?://[^/]+)', 1)) || unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS target FROM pages) WHERE length(target) % 5 <> 0 AND length(target) % 3 = 0)"
ISSUES = " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS id, '{T.ISSUES[i][0]}' AS name, '{T.ISSUES[i][1]}' AS priority, url FROM p WHERE {c}" for i, c in ISSUE_SQL.items())
QUERIES["a24_issues"], SQL["a24_issues"] = _issues(ops.issues), READ + ISSUES
QUERIES["a24_issue_report"], SQL["a24_issue_report"] = _issues(ops.issue_report), READ + f"SELECT id, name, priority, count(*) AS urls FROM ({ISSUES}) GROUP BY 1, 2, 3"

SUMMARY = """SELECT count(*) AS pages, CAST(sum(internal_links) AS BIGINT) AS total_internal_links, CAST(sum(external_links) AS BIGINT) AS total_external_links, CAST(sum(internal_links + external_links) AS BIGINT) AS total_links,
  count(*) FILTER (WHERE indexability >= 0.5) AS indexable_pages, count(*) FILTER (WHERE indexability < 0.5) AS not_indexable_pages, count(*) FILTER (WHERE status_code >= 400) AS errors, count(*) FILTER (WHERE status_code BETWEEN 200 AND 299) AS status_2xx,
  count(*) FILTER (WHERE status_code BETWEEN 300 AND 399) AS status_3xx, count(*) FILTER (WHERE status_code BETWEEN 400 AND 499) AS status_4xx, count(*) FILTER (WHERE status_code >= 500) AS status_5xx, count(*) AS total_css, CAST(0 AS BIGINT) AS total_javascript,
  CAST(sum(n_images) AS BIGINT) AS total_images, count(*) FILTER (WHERE had_redirect) AS total_redirects, count(*) FILTER (WHERE title = '') AS missing_title, count(*) FILTER (WHERE description IS NULL) AS missing_description,
  CAST(floor(avg(response_time) * 1000) AS BIGINT) AS avg_response_time, CAST(max(url_depth) AS BIGINT) AS max_crawl_depth, count(*) FILTER (WHERE starts_with(url, 'https://')) AS total_secure_pages, count(*) FILTER (WHERE page_id % 3 = 0) AS total_schema_pages,
  count(*) FILTER (WHERE mobile) AS total_mobile_pages, count(*) FILTER (WHERE len(h1) = 0) AS missing_h1, count(*) FILTER (WHERE canonicals IS NULL) AS missing_canonical, count(*) FILTER (WHERE word_count < 300) AS thin_content_pages,
  count(*) FILTER (WHERE contains(robots, 'noindex')) AS noindex_pages, count(*) FILTER (WHERE mixed_content > 0) AS mixed_content_pages, count(*) FILTER (WHERE cookies > 0) AS cookies_pages, CAST(floor(avg(word_count)) AS BIGINT) AS avg_word_count,
  CAST(floor(avg(flesch)) AS BIGINT) AS avg_readability, CAST(floor(avg(kb)) AS BIGINT) AS avg_page_size_kb, count(nullif(title, '')) - count(DISTINCT nullif(title, '')) AS duplicate_titles, count(description) - count(DISTINCT description) AS duplicate_descriptions FROM p"""
add("a18_crawl_summary", ops.crawl_summary, SUMMARY)
add("a35_health", lambda p: ops.health(ops.crawl_summary(p)), f"""
, s AS ({SUMMARY}), h AS (SELECT CAST(floor(indexable_pages / pages * 100 + 0.5) AS DOUBLE) AS indexability, round(greatest(0, 100 - status_5xx / pages * 400 - status_4xx / pages * 220 - errors / pages * 140), 6) AS http,
  round(greatest(0, 100 - missing_title / pages * 130 - missing_h1 / pages * 60 - missing_description / pages * 55 - duplicate_titles / pages * 70 - duplicate_descriptions / pages * 40 - missing_canonical / pages * 30), 6) AS meta,
  round(greatest(0, 0.5 * (100 - thin_content_pages / pages * 130) + 0.25 * least(100, avg_word_count / 600 * 100) + 0.25 * avg_readability), 6) AS content,
  round(greatest(0, 0.55 * total_secure_pages / pages * 100 + 0.45 * total_mobile_pages / pages * 100 - mixed_content_pages / pages * 90), 6) AS security FROM s)
SELECT CAST(indexability AS DOUBLE) AS indexability, CAST(http AS DOUBLE) AS http, CAST(meta AS DOUBLE) AS meta, CAST(content AS DOUBLE) AS content, CAST(security AS DOUBLE) AS security, CAST(floor(round(indexability * 0.2 + http * 0.25 + meta * 0.2 + content * 0.15 + security * 0.2, 6) + 0.5) AS BIGINT) AS overall FROM h""")
add("a26_overview_report", ops.overview_report, " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({c} AS BIGINT) AS value FROM p" for m, c in {
    "Total URLs Crawled": "count(*)", "Success (2xx)": "count(*) FILTER (WHERE status_code BETWEEN 200 AND 299)", "Redirection (3xx)": "count(*) FILTER (WHERE status_code BETWEEN 300 AND 399)", "Client Error (4xx)": "count(*) FILTER (WHERE status_code BETWEEN 400 AND 499)", "Server Error (5xx)": "count(*) FILTER (WHERE status_code >= 500)",
    "Indexable": "count(*) FILTER (WHERE indexability >= 0.5)", "Non-Indexable": "count(*) FILTER (WHERE indexability < 0.5)", "Missing Title": "count(*) FILTER (WHERE trim(title) = '')", "Missing Meta Description": "count(*) FILTER (WHERE description IS NULL)", "Missing H1": "count(*) FILTER (WHERE len(h1) = 0)", "Average Word Count": "floor(avg(word_count) + 0.5)",
}.items()))
add("a22_images", lambda p: ops.assets(p, "images"), "SELECT url, min(alt) AS alt, CAST(min(size) AS BIGINT) AS size FROM (SELECT unnest(image_urls) AS url, unnest(alts) AS alt, unnest(image_sizes) AS size FROM p) GROUP BY 1")
add("a22_stylesheets", lambda p: ops.assets(p, "stylesheets"), "SELECT DISTINCT css AS url FROM p")
add("a23_hreflang", lambda p: ops.page_slice(p, "hreflang"), "SELECT url, unnest(CASE page_id % 4 WHEN 1 THEN ['en'] WHEN 2 THEN ['fr', 'X-Default'] WHEN 3 THEN ['de'] END) AS lang, unnest(CASE page_id % 4 WHEN 1 THEN [url] WHEN 2 THEN ['https://site.example/other', url] WHEN 3 THEN ['https://site.example/other'] END) AS href FROM p WHERE page_id % 4 > 0")
add("a23_headings", lambda p: ops.page_slice(p, "headings"), "SELECT url, 'h1' AS level, unnest(h1) AS heading FROM p UNION ALL SELECT url, 'h2', unnest(h2) FROM p WHERE h2 IS NOT NULL", READ)
add("a23_inventory", lambda p: ops.page_slice(p, "inventory"), "SELECT url, status_code, title, word_count, CAST(n_images AS INTEGER) AS images, CAST(1 AS INTEGER) AS css, CAST(0 AS INTEGER) AS javascript FROM p", READ)
add("report_insecure_content", ops.insecure_content, "SELECT DISTINCT url, 'stylesheet' AS kind, css AS resource FROM p WHERE starts_with(url, 'https://') AND starts_with(css, 'http://') UNION ALL SELECT DISTINCT url, 'image', r FROM (SELECT url, unnest(image_urls) AS r FROM p WHERE starts_with(url, 'https://')) WHERE starts_with(r, 'http://')")
add("report_canonical_problems", ops.canonical_errors, "SELECT url, 'missing' AS error FROM p WHERE canonicals IS NULL UNION ALL SELECT url, 'elsewhere' FROM p WHERE canonicals IS NOT NULL AND NOT own UNION ALL SELECT url, 'multiple' FROM p WHERE len(canonicals) > 1")
add("p29_resource_indexability", lambda p: ops.resource_indexability(p.filter("content_type not like '%html%'").drop("indexability")).select("page_id", "indexability", "reason"), "SELECT page_id, CASE WHEN status_code = 200 AND content_type = 'application/pdf' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS indexability, CASE WHEN status_code <> 200 THEN 'Not indexable: HTTP status ' || status_code WHEN content_type = 'application/pdf' THEN 'Indexable: PDF document' ELSE 'Not indexable: non-HTML content (' || content_type || ')' END AS reason FROM p WHERE NOT page")
add("p31_light_pages", lambda p: ops.light_pages(p.withColumn("title", F.repeat("title", F.lit(4)))).select("page_id", "title", "description"), "SELECT page_id, CASE WHEN length(title) * 4 > 200 THEN substr(repeat(title, 4), 1, 200) || '...' ELSE repeat(title, 4) END AS title, description FROM p", READ)
add("w3_duplicate_h2", lambda p: ops.dup_h2(p), f"SELECT DISTINCT url FROM p WHERE {ISSUE_SQL[43]}")
add("g3_heading_duplicates", lambda p: ops.heading_duplicates(p.withColumn("h1", F.array(F.lit("One")))), "SELECT md5(w) AS hash, count(*) AS pages, min(url) AS first_url, CAST(100 AS INTEGER) AS similarity FROM (SELECT url, trim(regexp_replace(lower('One ' || coalesce(array_to_string(h2, ' '), '')), '[^a-z0-9]+', ' ', 'g')) AS w FROM p) GROUP BY w HAVING count(*) > 1")


def _frontier(spark, sf_dir):
    """Links found in the html whose pages nobody has fetched: those of the derived site are visited for even ids."""
    from ..sources.html import extract_pages

    pages = I.table(spark, sf_dir, "pages")
    links = extract_pages(pages, only=["links"]).select(F.explode("links").alias("l")).select("l.url")
    return ops.frontier(links, pages.filter("page_id % 2 = 0").select(F.concat(F.regexp_extract("url", "^(https?://[^/]+)", 1), F.lit("/The")).alias("url")), exclude=["/attion$"])


QUERIES["g7_frontier"] = _frontier
SQL["g7_frontier"] = r"""
WITH l AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS site, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
u AS (SELECT DISTINCT lower(site) || href AS url FROM l)
SELECT url FROM u WHERE NOT ends_with(url, '/attion') AND NOT (""" + " OR ".join(f"contains(lower(url), '{p}')" for p in T.SKIPPED) + r""") AND url NOT IN (SELECT lower(regexp_extract(url, '^(https?://[^/]+)', 1)) || '/The' FROM pages WHERE page_id % 2 = 0)"""
