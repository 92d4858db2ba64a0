"""Registered access-log queries with their SQL."""

from __future__ import annotations

from ..functions import tables as T
from ..operators import logs as ops
from ..operators.logs import Filters
from . import inputs as I

QUERIES, SQL = {}, {}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(cases, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {otherwise} END"


def _token(word: str) -> str:
    return rf"regexp_extract(user_agent, '(?i)[\p{{L}}\p{{N}}/]*?{word}[^ ;)""]*')"


BOT = _case([("user_agent IS NULL OR trim(user_agent) IN ('-', '')", "'No User Agent'")] + [(f"contains(lower(user_agent), {_q(k)})", _q(n)) for k, n in T.BOTS] + [(f"contains(lower(user_agent), {_q(k)})", _token(k)) for k in T.GENERIC_BOTS], "'Human'")
BROWSER = _case([(f"contains(lower(user_agent), {_q(k)})", f"split_part({_token(k)}, '/', 1)") for k in T.BROWSERS], "'Other'")
FILE_TYPE = _case([(" OR ".join([f"ends_with(lower(path), {_q(x)})" for x in e] + (["NOT contains(path, '.')"] if k == "HTML" else [])), _q(k)) for k, e in T.FILE_TYPES], "'Unknown'")
COUNTRY = _case([("contains(ip, ':')", "'Unknown (IPv6)'"), ("split_part(ip, '.', 1) IN ('66', '165', '200')", "'US'"), ("split_part(ip, '.', 1) = '163'", "'NL'")], "'Unknown'")
REFERER_CATEGORY = _case([("referer IS NULL OR referer IN ('', '-')", "'Direct/None'")] + [(f"contains(lower(referer), {_q(p)})", _q(c)) for p, c in T.REFERERS] + [(" OR ".join(f"contains(lower(referer), {_q(p)})" for p in T.LOCAL_REFERERS), "'Local/Internal'")], "'Other'")


def _has(*words: str) -> str:
    return "(" + " OR ".join(f"contains(lower(user_agent), {_q(w)})" for w in words) + ")"


SMALL = _has("mobile", "iphone", "ipad")
UA_CATEGORY = _case(
    [("user_agent IS NULL OR user_agent IN ('', '-', 'Unknown')", "'Unknown/Empty'"), *[(_has(p), _q(c)) for p, c in T.UA_BOTS], (_has(*T.UA_ANY_BOT), "'Other Bots'"), *[(_has(p), _q(c)) for p, c in T.UA_TOOLS]]
    + [(f"{_has('chrome')} AND NOT {_has('mobile')}", "'Chrome'"), (_has("chrome"), "'Chrome Mobile'"), (f"{_has('firefox')} AND NOT {_has('mobile')}", "'Firefox'"), (_has("firefox"), "'Firefox Mobile'")]
    + [(f"{_has('safari')} AND NOT {SMALL}", "'Safari'"), (_has("safari"), "'Safari Mobile'"), (_has("edge"), "'Microsoft Edge'"), (_has("opera"), "'Opera'"), (_has("trident", "msie"), "'Internet Explorer'")]
    + [(_has("android"), "'Android Browser'"), (_has("iphone", "ipad", "ipod"), "'iOS Browser'"), (_has("windows"), "'Windows'"), (_has("mac os"), "'macOS'"), (_has("linux"), "'Linux'")],
    "'Other'",
)
RULES = [("starts_with(path, '/blog/tag/')", "Tags", "startsWith", "/blog/tag/"), ("contains(path, 'product')", "Shop", "contains", "product"), ("starts_with(path, '/blog/')", "Blog", "startsWith", "/blog/"), ("path = '/'", "Home", "exactMatch", "/")]
FAMILY = {k: f"contains(lower(crawler_type), '{k}')" for k in ("google", "bing", "semrush", "ahrefs", "moz", "uptime")} | {
    "openai": "(contains(lower(crawler_type), 'openai') OR contains(lower(crawler_type), 'gpt') OR contains(lower(user_agent), 'chatgpt') OR contains(lower(user_agent), 'gptbot') OR contains(lower(user_agent), 'oai-'))",
    "claude": "(contains(lower(crawler_type), 'claude') OR contains(lower(user_agent), 'claude'))",
}
DULL = "(" + " OR ".join(f"path ILIKE '%{p}%'" for p in T.UNIMPORTANT) + ")"
# the paths of the hits need only lower-casing and the trailing slash taken off
NORM = "lower(CASE WHEN {0} = '/' THEN '/' ELSE rtrim({0}, '/') END)"

BASE = f"""
WITH hits AS ({I.HITS.format(events="events")}),
gsc0 AS ({I.GSC.format(hits="hits")}),
gsc AS (SELECT {NORM.format("path")} AS norm_path, arg_max(position, seq) AS position, arg_max(clicks, seq) AS clicks, arg_max(impressions, seq) AS impressions, arg_max(ctr, seq) AS ctr FROM gsc0 GROUP BY 1),
list AS ({I.CRAWL_LIST.format(hits="hits", nation="nation")}),
keys AS (SELECT DISTINCT {NORM.format("replace(url, 'https://site.example', '')")} AS norm_path FROM list),
e0 AS (SELECT *, {BOT} AS crawler_type, {BROWSER} AS browser, {FILE_TYPE} AS file_type, {COUNTRY} AS country, {NORM.format("path")} AS norm_path,
  {_case([(c, _q(n)) for c, n, _, _ in RULES], "'Other'")} AS segment, {_case([(c, _q(m)) for c, _, m, _ in RULES], "NULL")} AS segment_match, {_case([(c, _q(p)) for c, _, _, p in RULES], "'other'")} AS taxonomy FROM hits),
e AS (SELECT e0.*, crawler_type <> 'Human' AS is_crawler, position, clicks, impressions, ctr, k.norm_path IS NOT NULL AS crawled,
  CASE WHEN contains(lower(crawler_type), 'google') THEN (contains(ip, ':') AND starts_with(ip, '2001:4860:4801:')) OR (starts_with(ip, '66.249.') AND TRY_CAST(split_part(ip, '.', 3) AS INT) BETWEEN 64 AND 95)
       WHEN contains(lower(crawler_type), 'bing') THEN starts_with(ip, '203.0.113.') AND TRY_CAST(split_part(ip, '.', 4) AS INT) < 128
       WHEN lower(crawler_type) = 'gptbot' THEN starts_with(ip, '203.0.113.') AND TRY_CAST(split_part(ip, '.', 4) AS INT) BETWEEN 128 AND 191 ELSE false END AS verified
  FROM e0 LEFT JOIN gsc USING (norm_path) LEFT JOIN keys k USING (norm_path)),
paths AS (SELECT path, crawler_type, segment, bool_or(crawled) AS crawled, count(*) AS hit_count FROM e GROUP BY 1, 2, 3)
"""


def add(name: str, make, sql: str, joined: bool | str = True) -> None:
    """Register make(enriched hits) under a name, with the SQL that follows the common tables."""
    QUERIES[name] = lambda spark, sf_dir: make(I.enriched(spark, sf_dir, joined))
    SQL[name] = BASE + sql


def add_full(name: str, make, sql: str) -> None:
    """The same, with make(spark, sf_dir)."""
    QUERIES[name] = make
    SQL[name] = BASE + sql


def _n(cond: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {cond}) AS {name}"


CLASSES = ", ".join(_n(f"status >= {a} AND status < {a + 100}", n) for a, n in ((200, "success"), (300, "redirect"), (400, "client_error"), (500, "server_error")))
HUMAN = f"{_n('crawler_type = ' + _q('Human'), 'human')}, {_n('crawler_type <> ' + _q('Human'), 'crawler')}"
BIG4 = ("google", "bing", "openai", "claude")

# functions and joins
ENRICHED = ["hit_id", "crawler_type", "browser", "file_type", "country", "norm_path", "segment", "segment_match", "taxonomy", "is_crawler"]
add("p1_enrich_hits", lambda h: h.select(*ENRICHED), f"SELECT {', '.join(ENRICHED)} FROM e", joined=False)
add("p24_categories", lambda h: h.select("hit_id", ops.L.referer_category(ops.F.col("referer")).alias("referer_category"), ops.L.ua_category(ops.F.col("user_agent")).alias("ua_category"), ops.L.status_class(ops.F.col("status")).alias("status_class"), ops.L.unimportant(ops.F.col("path")).alias("unimportant")), f"SELECT hit_id, {REFERER_CATEGORY} AS referer_category, {UA_CATEGORY} AS ua_category, CASE WHEN status < 300 THEN '2xx' WHEN status < 400 THEN '3xx' WHEN status < 500 THEN '4xx' ELSE '5xx' END AS status_class, {DULL} AS unimportant FROM e", joined=False)
add("p26_bot_families", lambda h: h.select("hit_id", *[c.alias(k) for k, c in ops.L.bot_families(ops.F.col("crawler_type"), ops.F.col("user_agent")).items()], ops.F.array_join(ops.L.bot_group(ops.F.col("crawler_type")), ",").alias("groups")),
    f"SELECT hit_id, {', '.join(f'{c} AS {k}' for k, c in FAMILY.items())}, concat_ws(',', " + ", ".join(f"CASE WHEN lower(crawler_type) IN ({', '.join(_q(x.lower()) for x in names)}) THEN '{g}' END" for g, names in (("indexing", T.INDEXING_BOTS), ("retrieval", T.RETRIEVAL_AGENTS), ("agentic", T.AGENTIC_BOTS))) + ") AS groups FROM e", joined=False)
add("j1_search_metrics", lambda h: h.select("hit_id", "position", "clicks", "impressions", "ctr"), "SELECT hit_id, position, clicks, impressions, ctr FROM e", joined="listed")
add("j2_crawled", lambda h: h.select("hit_id", "crawled"), "SELECT hit_id, crawled FROM e", joined="listed")
add("j3_verified", lambda h: h.select("hit_id", "ip", "crawler_type", "verified"), "SELECT hit_id, ip, crawler_type, verified FROM e")
add_full("j6_crawl_coverage", lambda s, d: ops.crawl_coverage(I.crawl_list(s, d), I.enriched(s, d, False)), f"SELECT url, count(hit_id) > 0 AS crawled, count(hit_id) AS hits, count(*) FILTER (WHERE crawler_type <> 'Human') AS bot_hits, coalesce(max(CAST(ts AS STRING)), '-') AS last_hit FROM (SELECT url, {NORM.format(chr(114) + 'eplace(url, ' + _q('https://site.example') + ', ' + _q('') + ')')} AS norm_path FROM list) LEFT JOIN e USING (norm_path) GROUP BY url")

# filters
FILTERS = {
    "f1_status_method_type": (Filters(status=[404, 302], method=["GET", "POST"], file_type=["HTML", "PHP"]), "status IN (404, 302) AND method IN ('GET', 'POST') AND file_type IN ('HTML', 'PHP')"),
    "f1_bot_segment": (Filters(bot="bot", segment="Blog"), "crawler_type <> 'Human' AND segment = 'Blog'"),
    "f1_bot_type": (Filters(bot_type="Mobile"), "user_agent ILIKE '%Mobile%'"),
    "f1_crawler": (Filters(crawler="openai"), FAMILY["openai"]),
    "f1_verified": (Filters(verified=True), "verified"),
    "f2_referer": (Filters(referer_categories=["Google", "Direct/None"]), "contains(lower(referer), 'google.co') OR referer IS NULL OR referer IN ('', '-')"),
    "f2_referer_other": (Filters(referer_categories=["Other"], referer_specific=["https://site.example/blog/"]), "referer = 'https://site.example/blog/'"),
    "f3_user_agent": (Filters(ua_categories=["Firefox", "cURL"]), f"{UA_CATEGORY} IN ('Firefox', 'cURL')"),
    "f4_search": (Filters(search="Blog/Post-1"), "contains(lower(path), 'blog/post-1')"),
    "f5_crawl": (Filters(crawl="orphan"), "NOT crawled"),
}
for _name, (_f, _sql) in FILTERS.items():
    add(_name, lambda h, f=_f: ops.apply_filters(h, f).select("hit_id", "path", "user_agent"), f"SELECT hit_id, path, user_agent FROM e WHERE {_sql}", joined=True if _f.verified is not None else "listed" if _f.crawl else False)
ERR, CLK = "path IN (SELECT path FROM e WHERE status >= 400)", "path IN (SELECT path FROM e WHERE clicks > 0)"
BOTS = "crawler_type <> 'Human'"
for _kind, _sql in {"orphan": "NOT crawled", "orphan_gsc": f"NOT crawled AND {CLK}", "crawled": "crawled", "crawled_errors": f"crawled AND {ERR}", "dead": ERR, "non_important": f"{BOTS} AND {DULL}", "robots_canonical": f"{BOTS} AND {DULL} AND crawled", "low_frequency": f"{BOTS} AND NOT {DULL} AND hit_count <= 2"}.items():
    add(f"f5_paths_{_kind}", lambda h, k=_kind: ops.path_status(h, k).select("path", "crawler_type", "segment", "crawled", "hit_count"), f"SELECT path, crawler_type, segment, crawled, hit_count FROM paths WHERE {_sql}", joined="listed")

# rollups and timelines
add("a1_path_rollup", ops.path_rollup, "SELECT * FROM paths", joined="listed")
for _key in ("status", "method", "browser", "user_agent", "referer"):
    _value = "coalesce(referer, '-')" if _key == "referer" else _key
    add(f"a2_{_key}_rollup" if _key != "referer" else "a3_referer_rollup", lambda h, k=_key: ops.rollup(h, k), f"SELECT {_value} AS {_key}, segment, count(*) AS hit_count FROM e GROUP BY 1, 2", joined=False)
add("a4_verified_rollup", ops.verified_rollup, "SELECT path, crawler_type, verified, segment, count(*) AS hit_count FROM e WHERE crawler_type <> 'Human' GROUP BY ALL")
add("a5_human_rollup", ops.human_rollup, "SELECT path, browser, country, segment, count(*) AS hit_count FROM e WHERE crawler_type = 'Human' GROUP BY ALL", joined=False)
add("a6_ip_rollup", ops.ip_rollup, "SELECT path, ip, segment, count(*) AS hit_count FROM e GROUP BY ALL", joined=False)
add("a7_timeline_rollup", ops.timeline_rollup, " UNION ALL ".join(f"SELECT '{g}' AS grain, {g} AS date, {HUMAN}, {CLASSES}, {', '.join(_n(FAMILY[k], k) for k in BIG4)} FROM e GROUP BY 2" for g in ("day", "hour")), joined=False)
add("a8_daily_timeline", ops.timeline, f"SELECT day AS date, {HUMAN} FROM e GROUP BY 1", joined=False)
add("a8_hourly_timeline", lambda h: ops.timeline(h, "hour", 50), f"SELECT hour AS date, {HUMAN} FROM e GROUP BY 1 ORDER BY 1 DESC LIMIT 50", joined=False)
add("a9_status_timeline", ops.status_timeline, f"SELECT day AS date, {CLASSES} FROM e GROUP BY 1", joined=False)
add("a10_crawler_timeline", ops.crawler_timeline, f"SELECT *, greatest(n - google - bing - openai - claude, 0) AS other FROM (SELECT day AS date, count(*) AS n, {', '.join(_n(FAMILY[k], k) for k in BIG4)} FROM e WHERE crawler_type <> 'Human' GROUP BY 1)".replace("SELECT *,", "SELECT date, google, bing, openai, claude,"), joined=False)
add("a11_filetype_timeline", ops.filetype_timeline, "SELECT day AS date, " + ", ".join(_n(f"file_type = '{v}'", k) for k, v in (("html", "HTML"), ("css", "CSS"), ("js", "JS"), ("image", "Image"))) + ", " + _n("file_type NOT IN ('HTML', 'CSS', 'JS', 'Image')", "other") + " FROM e GROUP BY 1", joined=False)
add("a12_bandwidth_timeline", lambda h: ops.bandwidth_timeline(h, "hour"), "SELECT hour AS date, CAST(sum(coalesce(response_size, 0)) AS BIGINT) AS bytes FROM e GROUP BY 1", joined=False)
WIDGET_SQL = {"file_type": "file_type", "segment": "segment", "status": "CAST(status AS STRING)", "user_agent": "user_agent", "ua_category": UA_CATEGORY, "referer": "coalesce(referer, 'Direct/None')", "referer_category": REFERER_CATEGORY, "crawler_type": "crawler_type"}
for _name, _value in WIDGET_SQL.items():
    add(f"a13_widget_{_name}", lambda h, k=_name: ops.widget(h, k), f"SELECT {_value} AS name, count(*) AS hits FROM e {'WHERE crawler_type <> ' + _q('Human') if _name == 'crawler_type' else ''} GROUP BY 1" + (" ORDER BY hits DESC, name LIMIT 100" if _name in ("user_agent", "referer") else ""), joined=False)
add("a14_log_stats", ops.log_stats, f"SELECT count(*) AS total, {_n(BOTS, 'crawlers')}, count(DISTINCT ip) AS unique_ips, count(DISTINCT user_agent) AS unique_user_agents, {_n('status >= 200 AND status < 300', 'success')}, CAST(min(ts) AS STRING) AS first_hit, CAST(max(ts) AS STRING) AS last_hit, round(count(*) FILTER (WHERE status >= 200 AND status < 300) * 100.0 / greatest(count(*), 1), 6) AS success_rate, {', '.join(_n(c, k) for k, c in FAMILY.items())} FROM e", joined=False)
add("a15_segment_stats", ops.segment_stats, f"SELECT segment, count(*) AS total, {_n(BOTS, 'crawlers')}, count(DISTINCT ip) AS unique_ips, {CLASSES}, round(count(*) / count(DISTINCT path), 6) AS per_path FROM e GROUP BY 1", joined=False)
_STATUS = "segment, count(*) AS n FROM e GROUP BY ALL"
TRENDS = f""", st AS (SELECT status, {_STATUS}), mt AS (SELECT method, {_STATUS}), ut AS (SELECT user_agent, {_STATUS}), rt AS (SELECT coalesce(referer, '-') AS referer, {_STATUS}), bt AS (SELECT browser, {_STATUS}),
 vt AS (SELECT path, crawler_type, verified, {_STATUS.replace("FROM e", "FROM e WHERE crawler_type <> 'Human'")}), it AS (SELECT path, ip, {_STATUS}), ht AS (SELECT path, browser, coalesce(country, '-') AS country, {_STATUS.replace("FROM e", "FROM e WHERE crawler_type = 'Human'")})
"""


def add_trends(name: str, make, sql: str) -> None:
    """Register make(trend tables, hits, list of urls), whose SQL follows the common tables and the trend tables."""
    QUERIES[name] = lambda spark, sf_dir: make(ops.trend_rollups(h := I.enriched(spark, sf_dir)), h, I.crawl_list(spark, sf_dir))
    SQL[name] = BASE + TRENDS + sql


def _rows(n: str, table: str, where: str = "true", hits: str = "n") -> str:
    return f"(SELECT count(*) AS {n}_count, CAST(coalesce(sum({hits}), 0) AS BIGINT) AS {n}_hits FROM {table} WHERE {where})"


add_trends("a16_trend_totals", lambda t, h, u: ops.trend_totals(h, u, t), f"""
SELECT * FROM {_rows("status", "st")}, {_rows("method", "mt")}, {_rows("user_agent", "ut")}, {_rows("referer", "rt")}, {_rows("browser", "bt")}, {_rows("verified", "vt")}, {_rows("path", "paths", BOTS, "hit_count")}, {_rows("human", "paths", f"NOT ({BOTS})", "hit_count")},
 (SELECT count(DISTINCT ip) AS ip_count, count(*) AS ip_hits FROM e), (SELECT count(*) AS crawled_pages FROM list),
 (SELECT count(DISTINCT path) FILTER (WHERE NOT crawled) AS orphan_pages, count(DISTINCT path) FILTER (WHERE {DULL}) AS unimportant_crawled, count(DISTINCT path) FILTER (WHERE {DULL} AND NOT crawled) AS wasted_crawl_budget,
  count(DISTINCT path) FILTER (WHERE {DULL} AND crawled) AS robots_txt_improvements, count(DISTINCT path) FILTER (WHERE crawled AND hit_count <= 2) AS low_frequency_important FROM paths WHERE {BOTS}),
 (SELECT count(DISTINCT path) AS orphans_gsc_traffic FROM e WHERE {BOTS} AND NOT crawled AND (clicks > 0 OR impressions > 0)),
 (SELECT count(*) AS uncrawled_urls, count(*) AS dead_content FROM list WHERE {NORM.format("replace(url, 'https://site.example', '')")} NOT IN (SELECT path FROM e WHERE {BOTS}))""")
_TOP = {"path": f"SELECT path AS name, segment, crawler_type, hit_count AS n FROM paths WHERE {BOTS}"} | {k: f"SELECT CAST({k} AS STRING) AS name, segment, NULL AS crawler_type, n FROM {t}" for k, t in (("status", "st"), ("user_agent", "ut"), ("referer", "rt"), ("browser", "bt"))}
add_trends("a16_trend_top", lambda t, h, u: ops.trend_top(t), " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS kind, name, n AS hits FROM ({q}) ORDER BY n DESC, name, segment, crawler_type LIMIT 10)" for k, q in _TOP.items()))
_SHEETS = {"Timeline": "SELECT day, NULL, NULL, count(*) FILTER (WHERE crawler_type = 'Human'), count(*) FILTER (WHERE crawler_type <> 'Human') FROM e GROUP BY 1"} | {
    name: f"SELECT {keys}, {n}, NULL FROM {table} GROUP BY ALL"
    for name, keys, n, table in (
        ("File Types", "file_type, NULL, NULL", "count(*)", "e"), ("Content Segments", "segment, NULL, NULL", "count(*)", "e"), ("Path Frequency", "path, crawler_type, segment", "sum(hit_count)", "paths"), ("Status Codes", "CAST(status AS STRING), NULL, NULL", "sum(n)", "st"),
        ("Methods", "method, NULL, NULL", "sum(n)", "mt"), ("User Agents", "user_agent, NULL, NULL", "sum(n)", "ut"), ("Referrers", "referer, NULL, NULL", "sum(n)", "rt"), ("Browsers", "browser, NULL, NULL", "sum(n)", "bt"), ("Verified Bots", "crawler_type, NULL, NULL", "sum(n)", "vt"),
        ("IP Addresses", "ip, NULL, NULL", "sum(n)", "it"), ("Human Traffic", "path, browser, country", "sum(n)", "ht"),
    )
}
add_trends("s15_trend_sheets", lambda t, h, u: ops.trend_sheets(t), " UNION ALL ".join(f"SELECT '{k}' AS sheet, CAST(a AS STRING) AS key1, CAST(b AS STRING) AS key2, CAST(c AS STRING) AS key3, CAST(d AS BIGINT) AS hits, CAST(f AS BIGINT) AS crawler_hits FROM ({q}) AS x(a, b, c, d, f)" for k, q in _SHEETS.items()))
_SUMMARY = (("URL Path Frequency", "paths", "hit_count"), ("Status Codes Frequency", "st", "n"), ("Method Frequency", "mt", "n"), ("User Agents Frequency", "ut", "n"), ("Referrers Frequency", "rt", "n"), ("Browser Frequency", "bt", "n"), ("Verified Bots", "vt", "n"), ("IP frequency", "it", "n"), ("Human Traffic Frequency", "ht", "n"))
add_trends("s15_trend_summary", lambda t, h, u: ops.trend_summary(h.count(), t), " UNION ALL ".join(f"SELECT '{k}' AS metric, count(*) AS unique_count, CAST(sum({n}) AS BIGINT) AS total_hits FROM {t} HAVING count(*) > 0" for k, t, n in _SUMMARY) + " UNION ALL SELECT 'TOTAL LOG ENTRIES', NULL, count(*) FROM e")
add("a14_status_counts", ops.status_counts, "SELECT status, count(*) AS hits FROM e GROUP BY 1", joined=False)
add("a15_segment_bots", lambda h: ops.segment_bots(h).select("segment", "hits", "mean_hits", ops.F.array_join(ops.F.transform(ops.F.map_entries("bots"), lambda e: ops.F.concat(e["key"], ops.F.lit("="), e["value"].cast("string"))), ",").alias("bots")),
    "SELECT *, round(avg(hits) OVER (), 6) AS mean_hits FROM (SELECT segment, CAST(sum(n) AS BIGINT) AS hits, coalesce(string_agg(crawler_type || '=' || n, ',' ORDER BY crawler_type) FILTER (WHERE crawler_type <> 'Human'), '') AS bots FROM (SELECT segment, crawler_type, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1)", joined=False)
RULE_SQL = I.PATH_RULES.format(hits="hits")
add_full("p7_reclassify", lambda s, d: ops.reclassify(I.hits(s, d).withColumns({c: ops.F.lit(None).cast("string") for c in ("segment", "segment_match", "taxonomy")}), I.path_rules(s, d)).select("hit_id", "path", "segment", "segment_match", "taxonomy"), f""", rules AS ({RULE_SQL}),
 best AS (SELECT DISTINCT ON (p.path) p.path, r.name, r.match_type, r.path AS rule FROM (SELECT DISTINCT path FROM hits) p JOIN rules r ON CASE r.match_type WHEN 'contains' THEN contains(p.path, r.path) WHEN 'exactMatch' THEN p.path = r.path ELSE starts_with(p.path, r.path) END ORDER BY p.path, length(r.path) DESC, r.rank)
 SELECT hit_id, path, coalesce(name, 'Other') AS segment, match_type AS segment_match, coalesce(rule, 'other') AS taxonomy FROM hits LEFT JOIN best USING (path)""")
add("a17_bot_paths", ops.bot_paths, "SELECT path, crawler_type, user_agent, count(*) AS hits, CAST(sum(response_size) AS BIGINT) AS bytes, CAST(min(ts) AS STRING) AS first_hit, CAST(max(ts) AS STRING) AS last_hit, coalesce(string_agg(DISTINCT referer, ',' ORDER BY referer), '') AS referers, arg_max(file_type, (ts, hit_id)) AS file_type, arg_max(status, (ts, hit_id)) AS status, max(segment) AS segment FROM e WHERE crawler_type <> 'Human' GROUP BY 1, 2, 3", joined=False)
add("a34_bot_types", ops.bot_types, "SELECT DISTINCT crawler_type FROM e", joined=False)
for _kind, _col, _sql in (("referer", "referer", REFERER_CATEGORY), ("user_agent", "user_agent", UA_CATEGORY)):
    add(f"a37_{_kind}_examples", lambda h, k=_kind: ops.category_examples(h, k), f"SELECT category, CAST(sum(n) AS BIGINT) AS hits, coalesce(string_agg(v, ' | ' ORDER BY v) FILTER (WHERE r <= 5), '') AS examples FROM (SELECT {_sql} AS category, {_col} AS v, count(*) AS n, row_number() OVER (PARTITION BY {_sql} ORDER BY {_col} NULLS LAST) AS r FROM e GROUP BY 1, 2) GROUP BY 1", joined=False)

# pages of rows
add("k1_hits_page", lambda h: ops.page(h, 3, 50, "response_size", True).select("hit_id", "path", "response_size"), "SELECT hit_id, path, response_size FROM e ORDER BY response_size DESC, hit_id LIMIT 50 OFFSET 100", joined=False)
add("k3_rollup_page", lambda h: ops.rollup_page(ops.rollup(h, "user_agent"), 2, 10), "SELECT user_agent, segment, count(*) AS hit_count FROM e GROUP BY 1, 2 ORDER BY hit_count DESC, 1, 2 LIMIT 10 OFFSET 10", joined=False)
add("k4_top_paths", lambda h: ops.top(ops.path_rollup(h)), "SELECT * FROM paths ORDER BY hit_count DESC, path, crawler_type, segment LIMIT 10", joined="listed")
add("k9_downsample", lambda h: ops.downsample(ops.timeline(h, "hour", None), 40), f"SELECT min(date) AS date, CAST(sum(human) AS BIGINT) AS human, CAST(sum(crawler) AS BIGINT) AS crawler FROM (SELECT *, (row_number() OVER (ORDER BY date) - 1) // (SELECT CAST(ceil(count(DISTINCT hour) / 40) AS BIGINT) FROM e) AS b FROM (SELECT hour AS date, {HUMAN} FROM e GROUP BY 1)) GROUP BY b", joined=False)


def _indexed(spark, sf_dir):
    from ..operators import search
    from ..operators.tables import fresh_dir

    rows, columns, folder = I.hits(spark, sf_dir), ["ip", "path", "user_agent"], fresh_dir(spark, "trigrams")
    search.write_index(rows, "hit_id", columns, folder)
    return search.search_rows(rows, "hit_id", columns, folder, "Blog/Post-1").select("hit_id", "path", "user_agent")


add_full("f4_indexed_search", _indexed, "SELECT hit_id, path, user_agent FROM hits WHERE contains(lower(path), 'blog/post-1')")
