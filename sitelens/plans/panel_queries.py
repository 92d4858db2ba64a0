"""Registered queries of breakdown panels, the overview tree and dangerous paths, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import urls as U
from ..operators import panels as ops
from . import inputs as I
from .audit_queries import BASE, READ, TABS

QUERIES, SQL = {}, {}

#: What the panels read beside the audit's pages, by page_id, as both engines say it.
EXTRA = """SELECT page_id AS extra_id, CAST(page_id % 3 AS INT) AS n_iframes, CAST(page_id % 2 AS INT) AS unsandboxed_iframes, CAST(page_id % 5 AS INT) AS risky_scripts,
  CASE WHEN page_id % 6 = 5 THEN NULL WHEN page_id % 9 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST((page_id * 7) % 101 AS DOUBLE) END AS link_score,
  CASE WHEN page_id % 5 = 4 THEN 'Not indexable: noindex' WHEN page_id % 7 = 3 THEN NULL ELSE concat('Indexable ', CAST(page_id % 11 AS STRING)) END AS reason,
  CASE WHEN page_id % 4 < 3 THEN CAST((page_id * 3) % 101 AS DOUBLE) / 100 END AS performance_score, CASE WHEN page_id % 8 < 3 THEN 0.25 ELSE 0.75 END AS accessibility_score,
  CASE WHEN page_id % 2 = 0 THEN 0.5 END AS best_practices_score, CAST(NULL AS DOUBLE) AS seo_score,
  CASE WHEN page_id % 13 = 12 THEN CASE page_id % 3 WHEN 0 THEN 302 WHEN 1 THEN 301 ELSE 307 END END AS first_hop, CAST(page_id % 4 AS INT) AS n_hops, concat('s', CAST(page_id % 90 AS STRING)) AS script
FROM {pages}"""


def panel_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit's pages with what the panels need more; script addresses are those that the html has, and one by page_id."""
    more = spark.sql(EXTRA, pages=I.table(spark, sf_dir, "pages"))
    rows = I.audit_pages(spark, sf_dir).join(more, F.col("page_id") == F.col("extra_id")).drop("extra_id")
    hop = lambda i: F.struct(F.lit("https://site.example/hop").alias("url"), F.when(i == 1, F.col("first_hop")).otherwise(301).alias("status_code"))
    return rows.withColumns({
        "css_external": F.size("css"), "iframes": F.array_repeat(F.lit("https://frame.example/"), F.col("n_iframes")), "inline_scripts": F.array("script"), "javascript": F.concat("javascript", F.array(F.concat(F.lit("https://cdn.example/"), F.substring("script", 1, 2)))),
        "redirect_chain": F.when(F.col("first_hop").isNotNull() & (F.col("n_hops") > 0), F.transform(F.sequence(F.lit(1), F.greatest("n_hops", F.lit(1))), hop)),
    }).drop("n_iframes", "n_hops", "first_hop", "script")


WITH = BASE.rstrip() + f",\nx AS ({EXTRA.format(pages='pages')}),\nq AS (SELECT p.*, x.* EXCLUDE (extra_id), first_hop IS NOT NULL AND n_hops > 0 AS chained, CASE WHEN n_hops > 0 THEN coalesce(first_hop, status_code) ELSE status_code END AS hop, status_code BETWEEN 300 AND 399 OR had_redirect AS moved FROM p JOIN x ON page_id = extra_id)\n"


def _n(c: str) -> str:
    return f"count(*) FILTER (WHERE {c})"


ALL, SECURE, SCORED, FAST = "count(*)", _n("starts_with(url, 'https://')"), "count(link_score)", "count(performance_score)"
LINKS = "sum(internal_links) + sum(external_links)"
ANSWERED = _n("status_code >= 200")
CHAIN = "(redirect_count > 1 OR (chained AND n_hops > 2))"
OG = "page_id % 4 <> 0"
COUNTED = {
    "canonicals": [("Total Pages", ALL, ALL), ("With Canonical", _n("canonicals IS NOT NULL"), ALL), ("Without Canonical", _n("canonicals IS NULL"), ALL), ("Self-Referencing", _n("canonicals[1] = url"), ALL), ("External Canonical", _n("canonicals[1] <> url AND NOT contains(canonicals[1], regexp_extract(url, '://([^/:?#]*)', 1))"), ALL)],
    "cookies": [("Total Pages", ALL, ALL), ("With Cookies", _n("cookies > 0"), ALL), ("Without Cookies", _n("cookies = 0"), ALL), ("Avg. Cookies / Page", "floor(avg(cookies) * 10 + 0.5) / 10", None), ("Total Cookies Found", "sum(cookies)", None)],
    "css": [("External CSS", ALL, None), ("Internal CSS", "sum(css_inline)", None)],
    "iframes": [("Iframes Found", "sum(n_iframes)", None)],
    "images": [("Total Images", "sum(n_images)", None), ("Images with Alt Tags", "sum(len(list_filter(alts, lambda a: a <> '')))", None), ("Images without Alt Tags", "sum(len(list_filter(alts, lambda a: a = '')))", None)],
    "linkScore": [("Average Link Score", "floor(avg(link_score) + 0.5)", None), ("Strong (70-100)", _n("link_score >= 70"), SCORED), ("Moderate (40-69)", _n("link_score >= 40 AND link_score < 70"), SCORED), ("Weak (1-39)", _n("link_score > 0 AND link_score < 40"), SCORED), ("Orphaned (0 Score)", _n("link_score = 0"), SCORED)],
    "metaRobots": [("No Meta Robots Tag", _n("page_id % 11 < 8"), ALL), ("Index, Follow", _n("page_id % 11 IN (8, 9)"), ALL), ("Noindex", "0", ALL), ("Nofollow", "0", ALL), ("Noindex, Nofollow", _n("page_id % 11 = 10"), ALL)],
    "mobile": [("Total Pages", ALL, ALL), ("Mobile Friendly", _n("mobile"), ALL), ("Not Mobile Friendly", _n("NOT mobile"), ALL), ("Unknown", "0", ALL)],
    "openGraph": [("Total Pages", ALL, ALL), ("With OpenGraph", _n(OG), ALL), ("Without OpenGraph", _n(f"NOT ({OG})"), ALL), ("Has og:title", _n(OG), ALL), *[(f"Has og:{t}", "0", ALL) for t in ("description", "image", "url", "type")]],
    "pageWeight": [("Average Page Size", "floor(avg(kb) + 0.5)", None), ("Light (< 100 KB)", _n("kb < 100"), ALL), ("Medium (100-500 KB)", _n("kb BETWEEN 100 AND 499"), ALL), ("Heavy (500 KB-1 MB)", _n("kb BETWEEN 500 AND 1023"), ALL), ("Very Heavy (> 1 MB)", _n("kb > 1023"), ALL)],
    "performance": [("Performance Score", "floor(avg(performance_score * 100) + 0.5)", None), ("Accessibility Score", "floor(avg(accessibility_score * 100) + 0.5)", None), ("Best Practices", "floor(avg(best_practices_score * 100) + 0.5)", None), ("SEO Score", "max(CAST(NULL AS DOUBLE))", None), ("Good (90-100)", _n("performance_score * 100 >= 90"), FAST), ("Needs Improvement", _n("performance_score * 100 >= 50 AND performance_score * 100 < 90"), FAST), ("Poor (0-49)", _n("performance_score * 100 < 50"), FAST)],
    "readability": [("Average Reading Ease", "floor(avg(flesch) + 0.5)", None), ("Easy to Read (70-100)", _n("flesch >= 70"), "count(flesch)"), ("Standard (50-69)", _n("flesch >= 50 AND flesch < 70"), "count(flesch)"), ("Difficult (0-49)", _n("flesch < 50"), "count(flesch)"), ("Low Text-to-HTML Ratio (<10%)", _n("text_ratio < 10"), ALL)],
    "redirects": [("Total Pages", ALL, ALL), ("Total Redirects", _n("moved"), ALL), ("Permanent (301/308)", _n("moved AND hop IN (301, 308)"), ALL), ("Temporary (302/303/307)", _n("moved AND hop IN (302, 303, 307)"), ALL), ("Single Redirects", _n(f"moved AND NOT {CHAIN} AND (redirect_count = 1 OR (chained AND n_hops = 2) OR had_redirect)"), ALL), ("Redirect Chains", _n(f"moved AND {CHAIN}"), ALL)],
    "responseTime": [("Average Response Time", "floor(avg(response_time * 1000) + 0.5)", None), ("Fast (< 200ms)", _n("response_time * 1000 < 200"), ALL), ("Average (200ms-1s)", _n("response_time * 1000 BETWEEN 200 AND 1000"), ALL), ("Slow (> 1s)", _n("response_time * 1000 > 1000"), ALL)],
    "schema": [("Total Schemas Found", _n("page_id % 3 = 0"), None), ("Pages With Schema", _n("page_id % 3 = 0"), None), ("Pages Missing Schema", _n("page_id % 3 > 0"), None)],
    "security": [("HTTPS URLs", SECURE, ALL), ("HTTP URLs", _n("starts_with(url, 'http://')"), ALL), ("Mixed Content", _n("page_id % 5 = 3"), SECURE), ("Unsafe Anchors", _n("page_id % 5 = 2"), ALL), ("Insecure Iframes", "sum(page_id % 2)", ALL), ("Inline Scripts", "sum(page_id % 5)", ALL)],
    "statusCodes": [("Total", ANSWERED, ANSWERED), ("2xx Success", _n("status_code // 100 = 2"), ANSWERED), ("3xx Redirection", _n("status_code // 100 = 3"), ANSWERED), ("4xx Client Error", _n("status_code // 100 = 4"), ANSWERED), ("5xx Server Error", _n("status_code >= 500"), ANSWERED)],
    "summary": [("Pages crawled", ALL, ALL), ("Total Links Found", LINKS, LINKS), ("Total Internal Links", "sum(internal_links)", LINKS), ("Total External Links", "sum(external_links)", LINKS), ("Total Indexable Pages", _n("page_id % 5 <> 4"), ALL), ("Total Not Indexable Pages", _n("page_id % 5 = 4"), ALL)],
    "urlInfo": [
        ("Total", ALL, ALL), ("Non ASCII Characters", _n(r"regexp_matches(url, '[^\x00-\x7F]')"), ALL), ("Underscores", _n("contains(url, '_')"), ALL), ("Uppercase", _n("lower(url) <> url"), ALL), ("Multiple Slashes", _n("contains(replace(url, '://', ''), '//')"), ALL),
        ("Repetitive Path", _n("len(list_filter(string_split(url, '/'), lambda s: s <> '')) <> len(list_distinct(list_filter(string_split(url, '/'), lambda s: s <> '')))"), ALL), ("Contains Space", _n(r"regexp_matches(url, '\s|%20')"), ALL), ("Internal Search", _n(r"contains(url, 'search?') OR contains(url, 'q=') OR url LIKE '%?%=%'"), ALL), ("Parameters", _n("contains(url, '?')"), ALL), ("Over 115 Characters", _n("length(url) > 115"), ALL),
    ],
    "wordCount": [("Total Pages", ALL, ALL), ("No Content (0)", _n("word_count = 0"), ALL), *[(k, _n(f"word_count BETWEEN {a} AND {b}"), ALL) for k, a, b in (("Very Short (1-100)", 1, 100), ("Short (101-300)", 101, 300), ("Medium (301-600)", 301, 600), ("Long (601-1000)", 601, 1000), ("Very Long (1000+)", 1001, 10**9))]],
}


def _row(panel: str, label: str, value: str, whole: str | None, source: str) -> str:
    share = "CAST(NULL AS BIGINT)" if whole is None else f"CAST(CASE WHEN {whole} > 0 THEN least(100, floor(({value}) * 100.0 / ({whole}) + 0.5)) ELSE 0 END AS BIGINT)"
    return f"SELECT '{panel}' AS panel, '{label}' AS label, CAST({value} AS DOUBLE) AS value, {share} AS percent FROM {source}"


def add(name, make, sql, base=WITH):
    QUERIES[name] = lambda spark, sf_dir: make(panel_pages(spark, sf_dir))
    SQL[name] = base + sql


add("a36_panels", ops.counted, "\nUNION ALL ".join(_row(p, k, v, w, "q") for p, entries in COUNTED.items() for k, v, w in entries))

for _level in ("h1", "h2"):
    _named = [("Total", "filled", "pages"), ("Missing", "abs(pages - filled)", "pages"), (f"Duplicate {_level.upper()} Headings", "filled - own", "filled"), ("Over 155 Characters", "long", "filled"), ("Below 70 Characters", "short", "filled")]
    add(f"a36_{_level}", lambda p, h=_level: ops.breakdown(p, h), f", h AS (SELECT unnest({_level}) AS v FROM q), d AS (SELECT (SELECT count(*) FROM q) AS pages, count(v) AS filled, count(DISTINCT v) AS own, count(DISTINCT v) FILTER (WHERE length(v) > 155) AS long, count(DISTINCT v) FILTER (WHERE length(v) < 70) AS short FROM h) " + " UNION ALL ".join(_row(_level, *e, "d") for e in _named))
add("a36_titles", lambda p: ops.breakdown(p, "titles"), ", d AS (SELECT DISTINCT title AS v FROM q) " + " UNION ALL ".join(_row("titles", k, f"(SELECT {c})", None, s) for k, c, s in (("All", "count(*)", "q"),)).replace("(SELECT count(*))", "count(*)") + "".join(" UNION ALL " + _row("titles", k, _n(c), None, "d") for k, c in (("Over 60 Characters", "length(v) > 60"), ("Missing Page Title", "v = ''"), ("Below 30 Characters", "length(v) < 30"))), WITH.replace(BASE.rstrip(), READ.rstrip()))
add("a36_descriptions", lambda p: ops.breakdown(p, "descriptions"), ", d AS (SELECT count(*) AS pages, count(DISTINCT description) AS filled, max(CASE WHEN description IS NULL THEN 1 ELSE 0 END) AS none, count(DISTINCT description) FILTER (WHERE length(description) > 155) AS long, count(DISTINCT description) FILTER (WHERE length(description) < 70) AS short FROM q) " + " UNION ALL ".join(_row("descriptions", k, c, "pages", "d") for k, c in (("Total Description", "pages"), ("Empty Description", "none"), ("Duplicate Description", "pages - filled - none"), ("Over 155 Characters", "long"), ("Below 70 Characters", "short"))))
add("a36_javascript", lambda p: ops.breakdown(p, "javascript"), _row("javascript", "External Scripts", "count(DISTINCT substr(script, 1, 2))", None, "q") + " UNION ALL " + _row("javascript", "Inline Scripts", "count(DISTINCT script)", None, "q"))
add("a36_crawl_depth", lambda p: ops.breakdown(p, "crawlDepth"), ", d AS (SELECT url_depth, count(*) AS n, (SELECT count(*) FROM q) AS pages FROM q GROUP BY 1) SELECT 'crawlDepth' AS panel, CASE WHEN url_depth = 0 THEN 'Homepage (Level 0)' ELSE 'Level ' || url_depth END AS label, CAST(n AS DOUBLE) AS value, CAST(floor(n * 100.0 / pages + 0.5) AS BIGINT) AS percent FROM d")
add("a36_language", lambda p: ops.breakdown(p, "language"), _row("language", "Total Pages", ALL, ALL, "q") + " UNION ALL " + _row("language", "EN", _n("language = 'en'"), ALL, "q") + " UNION ALL " + _row("language", "No Language", _n("language IS NULL"), ALL, "q"))
add("a36_indexing", lambda p: ops.breakdown(p, "indexing"), ", d AS (SELECT coalesce(reason, 'Unknown') AS r, count(*) AS n, (SELECT count(*) FROM q) AS pages FROM q GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8) " + _row("indexing", "Indexable", _n("page_id % 5 <> 4"), ALL, "q") + " UNION ALL " + _row("indexing", "Non-Indexable", _n("page_id % 5 = 4"), ALL, "q") + " UNION ALL SELECT 'indexing', r, CAST(n AS DOUBLE), CAST(floor(n * 100.0 / pages + 0.5) AS BIGINT) FROM d")

# The overview: images in the audit's pages are assets, those with an even id not yet fetched.
TYPES = {"html": "type LIKE '%html%'", "javascript": "type LIKE '%javascript%'", "css": "type LIKE '%css%'", "images": "type LIKE 'image%'", "media": "type LIKE 'video%' OR type LIKE 'audio%'", "fonts": "type LIKE '%font%'", "xml": "type LIKE '%xml%'", "pdf": "type LIKE '%pdf%'", "other": "type = 'application/octet-stream'"}
SHARED = {"pageTitles": "title", "metaDescription": "description", "h1Tab": "h1[1]", "h2Tab": "h2[1]"}


def _overview_sql() -> str:
    cells = [("summary", "encountered", "true", "true"), ("summary", "crawled", "NOT asset OR status_code > 0", "true"), ("summary", "internal", "true", "true"), ("summary", "indexable", "page AND indexability >= 0.5", "true"), ("summary", "nonIndexable", "page AND indexability < 0.5", "true")]
    for element, filters in ops.OVERVIEW.items():
        whole = "true" if element in ops.OF_ALL else "page"
        cells.append((element, "all", whole, whole))
        for f in filters:
            test = TYPES[f] if element == "internal" else "page AND shared_" + element if f == "duplicate" else TABS[element][f]
            cells.append((element, f, test, whole))
    rows = " UNION ALL ".join(f"SELECT '{e}' AS element, '{f}' AS filter, {_n(c)} AS urls, CASE WHEN {_n(w)} > 0 THEN round({_n(c)} * 100.0 / {_n(w)}, 6) END AS percent FROM o" for e, f, c, w in cells)
    shared = ", ".join(f"coalesce(trim({c}) <> '', false) AND count(*) OVER (PARTITION BY page, trim({c})) > 1 AS shared_{e}" for e, c in SHARED.items())
    return f", m AS (SELECT * REPLACE (CASE WHEN content_type = 'image/png' AND page_id % 2 = 0 THEN 0 ELSE status_code END AS status_code), content_type AS type, content_type = 'image/png' AS asset FROM q), o AS (SELECT *, {shared} FROM m) {rows}"


add("a25_overview", lambda p: ops.overview(p.withColumn("is_asset", F.col("content_type") == "image/png").withColumn("status_code", F.when(F.col("is_asset") & (F.col("page_id") % 2 == 0), 0).otherwise(F.col("status_code")))), _overview_sql(), WITH.replace(BASE.rstrip(), READ.rstrip()))

# Endings put on the hits' paths by event, for paths that the patterns know.
ENDINGS = ["", "", "", "", "/../etc/passwd", ".bak", "/.git/config", "/administrator/", "?x=eval (1)", "/..%2Fx", "/id_rsa", "/feed", "/data.SQL", "/tmp/x", "/.well-known/acme-challenge/t", "/%2e%2e/", "/a.swp", "/sub~"]
PATHS = f"SELECT concat(path, CASE hit_id % {len(ENDINGS)} " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(ENDINGS)) + " END) AS path FROM "


def _danger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct paths that a pattern knows, with their hits: patterns are tried once a path."""
    paths = spark.sql(PATHS + "{hits}", hits=I.hits(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("hits"))
    return paths.filter(U.is_dangerous(F.col("path"))).select("path", "hits", U.path_danger(F.col("path")).alias("d")).select("path", "d.label", "d.category", "hits")


QUERIES["p23_dangerous_paths"] = _danger
SQL["p23_dangerous_paths"] = f"WITH h AS ({I.HITS.format(events='events') if '{events}' in I.HITS else I.HITS}), d AS ({PATHS} h), n AS (SELECT path, count(*) AS hits FROM d GROUP BY 1), k AS (SELECT unnest(range(0, {len(T.DANGEROUS_PATHS)})) AS i, unnest([" + ", ".join("'" + p + "'" for p, _, _ in T.DANGEROUS_PATHS) + "]) AS pattern, unnest([" + ", ".join(f"'{x}'" for _, x, _ in T.DANGEROUS_PATHS) + "]) AS label, unnest([" + ", ".join(f"'{x}'" for _, _, x in T.DANGEROUS_PATHS) + "]) AS category) SELECT path, arg_min(label, i) AS label, arg_min(category, i) AS category, any_value(hits) AS hits FROM n JOIN k ON regexp_matches(path, pattern, 'i') GROUP BY path"
