"""Registered page, link and text queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X
from ..functions import urls as U
from ..operators import links as links_ops
from ..operators import logs as log_ops
from ..operators import pages as ops
from . import inputs as I

QUERIES, SQL = {}, {}

SITE = "https://site.example/p/"
BASE = f"""
WITH site0 AS ({I.SITE_PAGES.format(pages="pages")}),
site AS (SELECT *,
  CASE WHEN status_code NOT BETWEEN 200 AND 299 OR status_code = 204 THEN 0.0 WHEN contains(robots, 'noindex') THEN 0.0 WHEN canonical = url THEN 1.0 WHEN canonical IS NOT NULL THEN 0.0 WHEN contains(robots, 'nofollow') THEN 0.8 ELSE 1.0 END AS indexability,
  CASE WHEN status_code NOT BETWEEN 200 AND 299 OR status_code = 204 THEN 'Not indexable: HTTP status ' || status_code WHEN contains(robots, 'noindex') THEN 'Not indexable: meta robots contains noindex' WHEN canonical = url THEN 'Indexable: self-referencing canonical' WHEN canonical IS NOT NULL THEN 'Not indexable: canonical points to ' || canonical WHEN contains(robots, 'nofollow') THEN 'Indexable: nofollow directive present' ELSE 'Indexable: successful response with no blocking directive' END AS reason,
  coalesce(count(*) OVER (PARTITION BY trim(title)) > 1 AND trim(title) <> '', false) AS dup_title, coalesce(count(*) OVER (PARTITION BY trim(description)) > 1 AND trim(description) <> '', false) AS dup_description FROM site0),
link AS (SELECT p.url AS source_url, l.url, l.rel, l.slot, l.source_id, 'to ' || l.slot AS anchor_text FROM ({I.SITE_LINKS.format(pages="pages")}) l JOIN site0 p ON p.page_id = l.source_id),
status AS (SELECT link.*, CASE WHEN status_code BETWEEN 100 AND 599 THEN status_code END AS status, CASE WHEN status_code >= 400 THEN 'HTTP Error: ' || status_code WHEN status_code = 0 THEN 'No response' END AS error FROM link LEFT JOIN site0 s ON s.url = regexp_replace(link.url, '#.*$', ''))
"""


def site(spark, sf_dir):
    return ops.indexability(I.site_pages(spark, sf_dir))


def links(spark, sf_dir):
    """Links with the address of their page."""
    of = I.site_pages(spark, sf_dir).select(F.col("page_id").alias("source_id"), F.col("url").alias("source_url"))
    return I.site_links(spark, sf_dir).join(of, "source_id").withColumn("anchor_text", F.concat(F.lit("to "), F.col("slot").cast("string")))


def statuses(spark, sf_dir):
    return links_ops.reconcile(links(spark, sf_dir), site(spark, sf_dir))


def add(name, make, sql, base=True):
    QUERIES[name] = make
    SQL[name] = (BASE if base else "") + sql


def on_site(name, make, sql):
    add(name, lambda s, d: make(site(s, d)), sql)


# pages
on_site("p28_indexability", lambda p: p.select("url", "indexability", "reason"), "SELECT url, CAST(indexability AS DOUBLE) AS indexability, reason FROM site")
on_site("a27_depth_histogram", ops.depth_histogram, "SELECT d.d AS depth, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for c, n in (("status_code = 0", "no_response"), ("status_code BETWEEN 200 AND 299", "s2xx"), ("status_code BETWEEN 300 AND 399", "s3xx"), ("status_code BETWEEN 400 AND 499", "s4xx"), ("status_code BETWEEN 500 AND 599", "s5xx"))) + " FROM (SELECT CAST(unnest(range(11)) AS BIGINT) AS d) d LEFT JOIN site ON least(url_depth, 10) = d.d GROUP BY 1")
for _kind, _sql in {
    "words": "CASE WHEN word_count = 0 THEN 'No Content' WHEN word_count <= 100 THEN '1-100' WHEN word_count <= 300 THEN '101-300' WHEN word_count <= 600 THEN '301-600' WHEN word_count <= 1000 THEN '601-1000' ELSE '1000+' END",
    "response_time": "CASE WHEN response_time < 0.2 THEN 'fast' WHEN response_time <= 1 THEN 'medium' ELSE 'slow' END", "status": "CAST(status_code AS STRING)", "depth": "CAST(url_depth AS STRING)",
    "indexability": "CASE WHEN indexability >= 0.5 THEN 'Indexable' ELSE 'Not indexable' END", "robots": "CASE WHEN robots = '' THEN 'none' ELSE robots END", "treemap": "'/' || split_part(url, '/', 4)",
}.items():
    on_site(f"a29_{_kind}_distribution", lambda p, k=_kind: ops.distribution(p, k), f"SELECT {_sql} AS bucket, count(*) AS pages FROM site GROUP BY 1")
KEY = "regexp_replace(regexp_replace(lower({}), '^https?://', ''), '/$', '')"
SELF = f"{KEY.format('canonical')} = {KEY.format('url')}"
on_site("w1_duplicate_flags", lambda p: ops.dup_flag(p, "title", "dup").select("url", "dup"), "SELECT url, dup_title AS dup FROM site")
on_site("w2_duplicate_titles", lambda p: ops.occurrences(p, "title"), "SELECT url, title, count(*) OVER (PARTITION BY trim(title)) AS occurrences FROM site WHERE dup_title")
on_site("w2_duplicate_descriptions", lambda p: ops.occurrences(p, "description"), "SELECT url, description, count(*) OVER (PARTITION BY trim(description)) AS occurrences FROM site WHERE dup_description")
on_site("report_canonical_errors", ops.canonical_errors, f"SELECT url, CASE WHEN canonical IS NULL THEN 'missing' ELSE 'elsewhere' END AS error FROM site WHERE canonical IS NULL OR NOT {SELF}")
on_site("report_non_indexable", lambda p: p.filter("indexability < 0.5").select("url", "status_code", "reason"), "SELECT url, status_code, reason FROM site WHERE indexability < 0.5")
on_site("report_redirects", lambda p: p.filter("status_code between 300 and 399").select("url", "status_code"), "SELECT url, status_code FROM site WHERE status_code BETWEEN 300 AND 399")
on_site("a28_path_tree", ops.path_tree, "SELECT node, count(*) AS pages FROM (SELECT unnest(['https:', 'https:/site.example', 'https:/site.example/p', 'https:/site.example/p/' || page_id]) AS node FROM site) GROUP BY 1")
STATUS = "CASE status_code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in T.STATUS_TEXT.items()) + " ELSE '' END"
on_site("p32_internal_view", ops.internal_view, f"SELECT url, status_code, {STATUS} AS status, CAST(indexability AS DOUBLE) AS indexability, reason AS indexability_status, title, CAST(length(title) AS INTEGER) AS title_length, CAST(floor(length(title) * 9.5 + 0.5) AS BIGINT) AS title_pixels, description, CAST(length(description) AS INTEGER) AS description_length, CAST(floor(length(description) * 6.8 + 0.5) AS BIGINT) AS description_pixels, canonical, robots, word_count, url_depth AS crawl_depth, CAST(2 AS INTEGER) AS folder_depth, response_time FROM site")
on_site("k8_even_sample", lambda p: ops.even_sample(p, 60, "page_id").select("page_id"), "SELECT page_id FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS r, count(*) OVER () AS n FROM site) WHERE n <= 60 OR r IN (SELECT floor(i * (SELECT count(*) FROM site) / 60) FROM (SELECT unnest(range(60)) AS i))")
on_site("u2_universe", lambda p: ops.universe((p, False), (p.filter("canonical is not null").select(F.col("canonical").alias("url")), True)), "SELECT url, bool_and(a) AS is_asset FROM (SELECT url, false AS a FROM site UNION ALL SELECT canonical, true FROM site WHERE canonical IS NOT NULL) GROUP BY 1")

# links
TARGET = "regexp_replace(split_part({}, '#', 1), '/$', '')"
add("a19_inlinks", lambda s, d: links_ops.inlinks(links(s, d)), f"SELECT {TARGET.format('url')} AS target, count(*) AS total, count(DISTINCT {TARGET.format('source_url')}) AS unique_sources FROM link GROUP BY 1")
add("a21_outlinks", lambda s, d: links_ops.outlinks(links(s, d)), "SELECT source_url, count(*) AS total, count(DISTINCT split_part(url, '#', 1)) AS unique_links FROM link GROUP BY 1")
add("j13_reconciled_links", lambda s, d: statuses(s, d).select("source_url", "url", "slot", "status", "error"), "SELECT source_url, url, slot, status, error FROM status")
add("a20_broken_links", lambda s, d: links_ops.broken_links(statuses(s, d)), "SELECT url, max(status) AS status, max(error) AS reason, count(DISTINCT source_url) AS pages, string_agg(DISTINCT source_url, ' ' ORDER BY source_url) AS sources FROM status WHERE status >= 400 OR error IS NOT NULL GROUP BY 1")
add("j16_broken_link_carriers", lambda s, d: links_ops.carriers(site(s, d), statuses(s, d)).select("url"), "SELECT url FROM site WHERE url IN (SELECT source_url FROM status WHERE status >= 400 OR error IS NOT NULL)")
add("j14_incoming_links", lambda s, d: links_ops.incoming(statuses(s, d), f"{SITE}14"), f"SELECT source_url, string_agg(DISTINCT anchor_text, ', ' ORDER BY anchor_text) AS anchors, max(status) AS status FROM status WHERE regexp_replace(url, '#.*$', '') = '{SITE}14' GROUP BY 1")
add("g5_link_degrees", lambda s, d: links_ops.degrees(links(s, d)), "SELECT url, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT s AS url, 1 AS o, 0 AS i FROM e UNION ALL SELECT t, 0, 1 FROM e) GROUP BY 1".replace("FROM (", "FROM (WITH e AS (SELECT DISTINCT source_url AS s, regexp_replace(url, '#.*$', '') AS t FROM link WHERE source_url <> regexp_replace(url, '#.*$', '')) ", 1))
add("g6_click_depth", lambda s, d: links_ops.click_depth(links(s, d).withColumn("url", U.norm_url(F.col("url"))), site(s, d).filter("page_id = 0").select("url")), f"""
, RECURSIVE_ AS (SELECT 1) SELECT url, CAST(depth AS INTEGER) AS depth FROM (WITH RECURSIVE e AS (SELECT DISTINCT source_url AS s, regexp_replace(url, '#.*$', '') AS t FROM link), r(url, depth) USING KEY (url) AS (SELECT url, 0 FROM site WHERE page_id = 0 UNION SELECT e.t, min(r.depth) + 1 FROM r JOIN e ON e.s = r.url WHERE NOT EXISTS (SELECT 1 FROM recurring.r k WHERE k.url = e.t) GROUP BY e.t) SELECT * FROM r)""")
ROUNDS = ", ".join(f"s{i + 1} AS (SELECT el.url, 0.15 / n.n + 0.85 * coalesce(sum(v * w), 0) AS v FROM el CROSS JOIN n LEFT JOIN w ON w.t = el.url LEFT JOIN s{i} ON s{i}.url = w.s GROUP BY el.url, n.n)" for i in range(10))
add("g2_link_score", lambda s, d: links_ops.link_score(I.site_pages(s, d), links(s, d)), f"""
, b AS (SELECT url AS src, canonical AS dst FROM site0 WHERE canonical IS NOT NULL AND canonical <> url),
names AS (SELECT url FROM site0 UNION SELECT regexp_replace(url, '#.*$', '') FROM link),
res AS (SELECT url AS src, coalesce(b3.dst, b2.dst, b1.dst, url) AS dst FROM names LEFT JOIN b b1 ON b1.src = url LEFT JOIN b b2 ON b2.src = b1.dst LEFT JOIN b b3 ON b3.src = b2.dst),
el AS (SELECT url FROM site0 JOIN res ON res.src = url AND res.dst = url WHERE status_code BETWEEN 200 AND 299),
n AS (SELECT count(*) AS n FROM el),
ed AS (SELECT source_url AS a, r1.dst AS s, r2.dst AS t, arg_min(contains(rel, 'nofollow'), slot) AS nf FROM link JOIN res r1 ON r1.src = source_url JOIN res r2 ON r2.src = regexp_replace(url, '#.*$', '') WHERE r1.dst <> r2.dst AND r1.dst IN (SELECT url FROM el) GROUP BY 1, 2, 3),
w AS (SELECT s, t, count(*) FILTER (WHERE NOT nf) / any_value(o) AS w FROM ed JOIN (SELECT s, count(*) AS o FROM ed GROUP BY 1) USING (s) GROUP BY 1, 2 HAVING count(*) FILTER (WHERE NOT nf) > 0),
s0 AS (SELECT url, 1.0::DOUBLE / n AS v FROM el CROSS JOIN n), {ROUNDS}
SELECT url, CAST(floor(round(CASE WHEN (SELECT max(v) - min(v) FROM s10) < 1e-12 THEN 100.0 ELSE 1 + (v - (SELECT min(v) FROM s10)) / (SELECT max(v) - min(v) FROM s10) * 99 END, 6) + 0.5) AS BIGINT) AS score FROM s10""")
PREV, CUR = "page_id % 3 <> 0", "page_id % 3 <> 1"
add("j5_crawl_diff", lambda s, d: links_ops.crawl_diff(site(s, d).filter(PREV), site(s, d).filter(CUR)), f"SELECT url, CASE WHEN {CUR} THEN 'added' ELSE 'removed' END AS change FROM site WHERE ({CUR}) <> ({PREV})")


def sitemap(spark, sf_dir):
    """Half of the pages and some unknown addresses."""
    own = I.site_pages(spark, sf_dir)
    return own.filter("page_id % 2 = 0").select("url").union(own.filter("page_id % 50 = 0").select(F.concat(F.lit(f"{SITE}gone-"), F.col("page_id").cast("string"))))


add("j8_sitemap_review", lambda s, d: links_ops.sitemap_review(sitemap(s, d), site(s, d)), f"""SELECT key, bucket FROM (SELECT key, CASE WHEN s IS NULL THEN 'orphan' WHEN s >= 400 THEN 'errors' WHEN i < 0.5 THEN 'nonIndexable' WHEN l THEN 'inSitemap' WHEN s < 300 THEN 'missing' END AS bucket FROM
  (SELECT DISTINCT {KEY.format('url')} AS key, true AS l FROM (SELECT url FROM site WHERE page_id % 2 = 0 UNION SELECT '{SITE}gone-' || page_id FROM site WHERE page_id % 50 = 0)) FULL JOIN (SELECT {KEY.format('url')} AS key, max(status_code) AS s, max(indexability) AS i FROM site GROUP BY 1) USING (key)) WHERE bucket IS NOT NULL""")
add("j7_orphan_pages", lambda s, d: sitemap(s, d).join(site(s, d).select(U.same_key(F.col("url")).alias("_k")), U.same_key(F.col("url")) == F.col("_k"), "left_anti"), f"SELECT '{SITE}gone-' || page_id AS url FROM site WHERE page_id % 50 = 0")
add("s9_upsert", lambda s, d: links_ops.upsert(site(s, d).filter(PREV).select("url", "title", F.col("page_id").alias("seq")), site(s, d).filter(CUR).select("url", F.upper("title").alias("title"), (F.col("page_id") % 5 + 20).alias("seq"))), f"SELECT url, arg_max(title, (seq, new)) AS title, max(seq) AS seq FROM (SELECT url, title, page_id AS seq, 0 AS new FROM site WHERE {PREV} UNION ALL SELECT url, upper(title), page_id % 5 + 20, 1 FROM site WHERE {CUR}) GROUP BY 1")

# addresses of the crawled pages, and their html
add("p9_page_addresses", lambda s, d: I.table(s, d, "pages").select("page_id", U.host(F.col("url")).alias("host"), U.inlink_key(F.col("url")).alias("inlink_key"), U.same_key(F.col("url")).alias("same_key"), U.folder_depth(F.col("url")).alias("folder_depth"), U.should_skip(F.col("url")).alias("skip"), U.url_pattern(F.col("url")).alias("pattern")),
    """SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_replace(split_part(url, '#', 1), '/$', '') AS inlink_key, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '#.*$', ''), '^https?://', ''), '^www\\.', ''), '/$', '') AS same_key,
  CAST(len(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')) AS INTEGER) AS folder_depth, """ + "contains(url, '#') OR " + " OR ".join(f"contains(lower(url), '{p}')" for p in T.SKIPPED) + """ AS skip,
  CASE WHEN TRY_CAST(regexp_extract(url, '[0-9]{4,9}') AS INT) BETWEEN 1900 AND 2099 THEN url ELSE regexp_replace(url, '[0-9]{4,9}', 'N') END AS pattern FROM pages""", False)  # fmt: skip
add("a33_pattern_counts", lambda s, d: I.table(s, d, "pages").groupBy(F.regexp_replace(U.url_pattern(F.col("url")), r"^https?://[^/]*|[?#].*$|/$", "").alias("pattern")).agg(F.count("*").alias("urls")), "SELECT regexp_replace(CASE WHEN TRY_CAST(regexp_extract(url, '[0-9]{4,9}') AS INT) BETWEEN 1900 AND 2099 THEN url ELSE regexp_replace(url, '[0-9]{4,9}', 'N') END, '^https?://[^/]*|[?#].*$|/$', '', 'g') AS pattern, count(*) AS urls FROM pages GROUP BY 1", False)
add("t14_html_measures", lambda s, d: I.table(s, d, "pages").select("page_id", F.octet_length("html").cast("long").alias("bytes"), X.html_kb(F.col("html")).alias("kb"), F.md5("html").alias("content_hash"), U.co2_mg(F.octet_length("html")).alias("co2_mg"), U.carbon_rating(U.co2_mg(F.octet_length("html"))).alias("carbon")),
    "SELECT page_id, CAST(strlen(html) AS BIGINT) AS bytes, CAST(floor(strlen(html) / 1024) AS BIGINT) AS kb, md5(html) AS content_hash, round(strlen(html) * 0.000000000072::DOUBLE * 442 * 1000, 3) AS co2_mg, 'A+' AS carbon FROM pages", False)

# texts
ALNUM = "regexp_matches(w, '[\\p{L}\\p{N}]')"
add("t1_word_counts", lambda s, d: I.table(s, d, "documents").select("doc_id", X.word_count(F.col("text")).alias("words"), X.reading_time(X.word_count(F.col("text"))).alias("minutes")), f"SELECT doc_id, CAST(n AS INTEGER) AS words, CAST(ceil(n / 200) AS BIGINT) AS minutes FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: {ALNUM})) AS n FROM documents)", False)
add("a31_word_frequency", lambda s, d: I.table(s, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z'-]{3,})"), 1)).alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n")), "SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z''-]{3,}')) AS w FROM documents) GROUP BY 1", False)


def top_keywords(spark, sf_dir):
    """The ten most frequent words of each document, ties by word."""
    words = I.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z'-]{3,})"), 1)).alias("w"))
    counts = words.groupBy("doc_id", F.lower("w").alias("word")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(log_ops.Window.partitionBy("doc_id").orderBy(F.desc("n"), "word"))
    return counts.withColumn("rank", rank).filter("rank <= 10")


add("w4_top_keywords", top_keywords, "SELECT * FROM (SELECT doc_id, word, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS INTEGER) AS rank FROM (SELECT doc_id, lower(w) AS word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z''-]{3,}')) AS w FROM documents) GROUP BY 1, 2)) WHERE rank <= 10", False)
add("t9_bigrams", lambda s, d: I.table(s, d, "documents").select(X.plain_words(F.col("text")).alias("w")).select(F.explode(X.ngrams(F.col("w"), 2)).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n")), r"SELECT b AS bigram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM (SELECT list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda x: regexp_replace(x, '[^\p{L}\p{N}]', '', 'g')), lambda x: x <> '') AS w FROM documents)) GROUP BY 1", False)
QUERIES["g4_near_duplicate_content"] = lambda s, d: links_ops.content_clusters(I.table(s, d, "documents"))  # xxhash64 isn't DuckDB's: no SQL
