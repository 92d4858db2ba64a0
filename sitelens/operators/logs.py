"""Access-log operators: enrichment, joins, filters, rollups, timelines, widgets, statistics."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import automaton as A
from ..functions import logs as L
from ..functions import tables as T
from .tables import materialized

# ---------------------------------------------------------------- enrichment and joins


AGENTS = 200_000  # distinct user agents that are broadcast, at most: some 60 MB
CHAIN = 200  # rules that one expression says, at most
RULES = 100_000  # rules of a taxonomy, at most: users write them


def with_agents(hits: DataFrame) -> DataFrame:
    """Hits with crawler_type and browser: distinct user agents are looked through the lists once and joined back, by broadcast.

    Streams, and logs with more than AGENTS different user agents, run them through an automaton where they are.
    """
    ua = F.col("user_agent")
    many = {"crawler_type": A.detect_bot(ua), "browser": A.browser(ua)}
    if hits.isStreaming:
        return hits.withColumns(many)
    agents = materialized(hits.select("user_agent").distinct(), "agents")
    if agents.count() > AGENTS:
        return hits.withColumns(many)
    known = materialized(agents.withColumns({"crawler_type": L.detect_bot(ua), "browser": L.browser(ua)}), "agents").withColumnRenamed("user_agent", "_ua")
    return hits.join(F.broadcast(known), ua.eqNullSafe(F.col("_ua"))).drop("_ua")


def classified(hits: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Hits with segment, segment_match and taxonomy of the longest rule (path, match type, name) that fits; ties keep the rules' order.

    Up to CHAIN rules are one expression, more are an automaton; both say the same. No shuffle.
    """
    path = F.col("path")
    if len(rules) <= CHAIN:
        return hits.withColumns(L.classify(path, rules))
    return hits.withColumn("_c", A.classify_many(path, rules)).withColumns({k: F.col("_c")[k] for k in ("segment", "segment_match", "taxonomy")}).drop("_c")


def reclassify(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Hits classified anew by a table of rules (path, match_type, name, rank): those that the hits have had are replaced.

    Rules without a path or a name are left out; ties in length go by rank. The table is a user's, of RULES rows at most.
    """
    rows = rules.filter("path is not null and name is not null").select("path", "match_type", "name", "rank").limit(RULES + 1).collect()
    if len(rows) > RULES:
        raise ValueError(f"a taxonomy has {RULES} rules at most")
    ordered = sorted(rows, key=lambda r: (r.rank is None, r.rank or 0, r.path, r.name))
    return classified(hits, [(r.path, r.match_type, r.name) for r in ordered])


def enrich(hits: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Hits with crawler_type, browser, file_type, country, is_crawler, norm_path and the taxonomy's three columns; no shuffle of hits."""
    path = F.col("path")
    named = with_agents(hits).withColumns({"file_type": L.file_type(path), "country": L.country(F.col("ip")), "norm_path": L.norm_path(path), "is_crawler": L.is_crawler(F.col("crawler_type"))})
    return classified(named, rules)


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by the order columns; a partial aggregate, so a key's rows don't meet in one task."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return best.select(*key, "_last.*")


def with_gsc(hits: DataFrame, gsc: DataFrame) -> DataFrame:
    """Hits with position, clicks, impressions and ctr of their path's last search row (by seq)."""
    last = keep_last(gsc.withColumn("norm_path", L.norm_path(F.col("path"))).drop("path"), ["norm_path"], ["seq"]).drop("seq")
    return hits.join(last, "norm_path", "left")


def with_crawled(hits: DataFrame, urls: DataFrame) -> DataFrame:
    """Hits with crawled: whether their path is one of the listed urls'."""
    keys = urls.select(L.norm_path(F.col("url")).alias("norm_path")).distinct().withColumn("_c", F.lit(True))
    return hits.join(keys, "norm_path", "left").withColumn("crawled", F.coalesce("_c", F.lit(False))).drop("_c")


def ip_key(ip: Column) -> Column:
    """An address as text whose order is that of addresses: 4:XXXXXXXX or 6:32 hex digits; null if it isn't one."""
    octets = F.split(ip, r"\.")
    v4 = F.concat(F.lit("4:"), *[F.lpad(F.hex(F.element_at(octets, i).cast("int")), 2, "0") for i in range(1, 5)])
    sides = F.split(F.lower(ip), "::")
    groups = lambda s: F.filter(F.split(s, ":"), lambda x: x != "")
    head, tail = groups(F.element_at(sides, 1)), F.when(F.size(sides) > 1, groups(F.element_at(sides, -1))).otherwise(F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(head) - F.size(tail)))
    v6 = F.concat(F.lit("6:"), F.array_join(F.transform(F.concat(head, F.when(F.size(sides) > 1, zeros).otherwise(F.array().cast("array<string>")), tail), lambda g: F.lpad(g, 4, "0")), ""))
    valid4 = ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    return F.when(valid4, v4).when(ip.rlike("^[0-9a-fA-F:]+$") & ip.contains(":") & (F.length(v6) == 34), v6)


def ranges(cidrs: DataFrame) -> DataFrame:
    """(family, lo, hi) of CIDR rows; unparsable ones are left out."""
    base, bits = F.split_part("cidr", F.lit("/"), F.lit(1)), F.expr("try_cast(split_part(cidr, '/', 2) AS INT)")
    key = ip_key(base)
    width = F.when(key.startswith("4:"), 32).otherwise(128)
    nibbles = F.substring(key, 3, 32)

    def bound(fill: str) -> Column:  # whole hex digits, then the digit that the prefix cuts, then zeros or ones
        whole, rest = F.floor(bits / 4).cast("int"), bits % 4
        digit = F.conv(F.substring(nibbles, whole + 1, F.lit(1)), 16, 10).cast("int")
        step = F.pow(F.lit(2), 4 - rest).cast("int")
        cut = F.floor(digit / step).cast("int") * step + (F.lit(0) if fill == "0" else step - 1)
        last = F.when(rest > 0, F.hex(cut.cast("long"))).otherwise(F.lit(""))
        body = F.concat(F.substring(nibbles, F.lit(1), whole), last)
        return F.concat(F.substring(key, 1, 2), F.rpad(F.upper(body), F.floor(width / 4).cast("int"), fill))

    return cidrs.select("family", bound("0").alias("lo"), bound("F").alias("hi")).filter(F.col("lo").isNotNull() & F.col("hi").isNotNull() & bits.between(0, width))


def bot_family(crawler_type: Column) -> Column:
    """Which list of address ranges vouches for a crawler; null for none."""
    ct = F.lower(crawler_type)
    return F.when(ct.contains("google"), "google").when(ct.contains("bing"), "bing").when(ct.contains("chatgpt"), "chatgpt").when(ct == "gptbot", "gptbot").when(ct.contains("openai") | ct.contains("oai-searchbot"), "searchbot")


def _bucket(key: Column) -> Column:
    """The first octet of an IPv4 key, or the first 16 bits of an IPv6 one, as a number after its kind."""
    return F.conv(F.substring(key, 3, F.when(key.startswith("4:"), 2).otherwise(4)), 16, 10).cast("long")


def with_verified(hits: DataFrame, cidrs: DataFrame) -> DataFrame:
    """Hits with verified: the address is in a range of its crawler's operator.

    The join sees each (address, family) once. It is one of equal (family, kind, first bits); a range that is wider than these has a row for each.
    """
    named = hits.withColumn("_family", bot_family(F.col("crawler_type")))
    seen = materialized(named.filter("_family is not null").select("ip", "_family").distinct(), "addresses")
    seen = seen.withColumn("_k", F.upper(ip_key(F.col("ip")))).filter("_k is not null").select("*", F.substring("_k", 1, 1).alias("_kind"), _bucket(F.col("_k")).alias("_b"))
    r = ranges(cidrs).select(F.col("family").alias("_family"), F.upper("lo").alias("_lo"), F.upper("hi").alias("_hi"))
    r = r.select("*", F.substring("_lo", 1, 1).alias("_kind"), F.explode(F.sequence(_bucket(F.col("_lo")), _bucket(F.col("_hi")))).alias("_b"))
    good = seen.join(r, ["_family", "_kind", "_b"]).filter("_k between _lo and _hi").select("ip", "_family", F.lit(True).alias("_ok")).distinct()
    return named.join(materialized(good, "verified"), ["ip", "_family"], "left").withColumn("verified", F.coalesce("_ok", F.lit(False))).drop("_family", "_ok")


# ---------------------------------------------------------------- filters


@dataclass
class Filters:
    """What the log views can be narrowed by; empty fields don't narrow."""

    search: str = ""
    status: list[int] = field(default_factory=list)
    method: list[str] = field(default_factory=list)
    file_type: list[str] = field(default_factory=list)
    bot: str | None = None
    bot_type: str | None = None
    crawler: str | None = None
    verified: bool | None = None
    segment: str | None = None
    referer_categories: list[str] = field(default_factory=list)
    referer_specific: list[str] = field(default_factory=list)
    ua_categories: list[str] = field(default_factory=list)
    ua_specific: list[str] = field(default_factory=list)
    crawl: str | None = None


def _or(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def referer_pred(category: str) -> Column:
    """Whether the referer is of a category; a name that isn't one is searched for."""
    r = F.col("referer")
    low = F.lower(r)
    none = r.isNull() | r.isin("", "-")
    known = [p for p, _ in T.REFERERS]
    if category == "Direct/None":
        return none
    if category == "Local/Internal":
        return _or(low.contains(p) for p in T.LOCAL_REFERERS)
    if category == "Other":
        return ~none & ~_or(low.contains(p) for p in [*known, *T.LOCAL_REFERERS])
    if category in T.REFERER_FILTERS:
        return _or(low.like(p) for p in T.REFERER_FILTERS[category])
    own = [p for p, c in T.REFERERS if c == category]
    return _or(low.contains(p) for p in own or [category.lower()])


def ua_pred(category: str) -> Column:
    """Whether the user agent is of a category; a name that isn't one is searched for.

    The categories are those of ua_category, but bots and tools are named by their own word wherever it is.
    """
    ua = F.col("user_agent")
    low = F.lower(ua)
    words = dict((c, p) for p, c in [*T.UA_BOTS, *T.UA_TOOLS])
    if category in words:
        return low.contains(words[category])
    named = {"Other Bots", "Chrome", "Chrome Mobile", "Firefox", "Firefox Mobile", "Safari", "Safari Mobile", "Internet Explorer", "Android Browser", "iOS Browser", "Windows", "macOS", "Linux", "Unknown/Empty", "Other"}
    if category in ("Microsoft Edge", "Opera"):
        word = "edge" if category == "Microsoft Edge" else "opera"
        return low.contains(word) & ~_or(low.contains(p) for p in [*[b for b, _ in T.UA_BOTS], *T.UA_ANY_BOT, *[t for t, _ in T.UA_TOOLS]])
    return L.ua_category(ua) == category if category in named else low.contains(category.lower())


def search(term: str) -> Column:
    """Literal, case-insensitive substring of address, path or user agent."""
    return _or(F.lower(F.col(c)).contains(term.strip().lower()) for c in ("ip", "path", "user_agent"))


def crawler_pred(name: str) -> Column:
    families = L.bot_families(F.col("crawler_type"), F.col("user_agent"))
    key = {"hrefs": "ahrefs"}.get(name.lower(), name.lower())
    extra = {"google": "googlebot", "bing": "bingbot"}.get(key)
    if key in families:
        return families[key] | F.lower("user_agent").contains(extra) if extra else families[key]
    return F.col("crawler_type") == name


def filter_condition(f: Filters) -> Column:
    """All row-local conditions of the filters."""
    c = [F.lit(True)]
    if f.search.strip():
        c.append(search(f.search))
    for name in ("status", "method", "file_type"):
        if getattr(f, name):
            c.append(F.col(name).isin(getattr(f, name)))
    if f.bot in ("bot", "Human"):
        c.append((F.col("crawler_type") == "Human") == F.lit(f.bot == "Human"))
    if f.bot_type in ("Mobile", "Desktop"):
        c.append(F.col("user_agent").ilike("%Mobile%") == F.lit(f.bot_type == "Mobile"))
    elif f.bot_type in ("All Bots", "All Crawlers"):
        c.append(F.col("crawler_type") != "Human")
    elif f.bot_type:
        c.append(_or(F.lower(F.col(x)).contains(f.bot_type.lower()) for x in ("crawler_type", "user_agent")))
    if f.crawler:
        c.append(crawler_pred(f.crawler))
    if f.verified is not None:
        c.append(F.col("verified") == f.verified)
    if f.segment:
        c.append(F.col("segment") == f.segment)
    for values, pred in ((f.referer_categories, referer_pred), (f.ua_categories, ua_pred)):
        if values:
            c.append(_or(pred(v) for v in values))
    for values, name in ((f.referer_specific, "referer"), (f.ua_specific, "user_agent")):
        if values:
            c.append(F.col(name).isin(values))
    if f.crawl in ("crawled", "orphan"):
        c.append(F.col("crawled") == F.lit(f.crawl == "crawled"))
    elif f.crawl == "dead":
        c.append(F.col("status") >= 400)
    return reduce(lambda a, b: a & b, c)


def apply_filters(hits: DataFrame, f: Filters) -> DataFrame:
    return hits.filter(filter_condition(f))


def path_status(hits: DataFrame, kind: str) -> DataFrame:
    """Path rollup rows of a crawl status: orphan, orphan_gsc, crawled, crawled_errors, dead, non_important, wasted_crawl, robots_canonical, low_frequency."""
    paths = path_rollup(hits)
    bots = F.col("crawler_type") != "Human"
    errors = hits.filter("status >= 400").select("path").distinct()
    clicks = hits.filter("clicks > 0").select("path").distinct()
    dull = L.unimportant(F.col("path"))
    return {
        "orphan": lambda: paths.filter(~F.col("crawled")),
        "orphan_gsc": lambda: paths.filter(~F.col("crawled")).join(clicks, "path", "left_semi"),
        "crawled": lambda: paths.filter("crawled"),
        "crawled_errors": lambda: paths.filter("crawled").join(errors, "path", "left_semi"),
        "dead": lambda: paths.join(errors, "path", "left_semi"),
        "non_important": lambda: paths.filter(bots & dull),
        "wasted_crawl": lambda: paths.filter(bots & dull),
        "robots_canonical": lambda: paths.filter(bots & dull & F.col("crawled")),
        "low_frequency": lambda: paths.filter(bots & ~dull & (F.col("hit_count") <= 2)),
    }[kind]()


# ---------------------------------------------------------------- rollups


def path_rollup(hits: DataFrame) -> DataFrame:
    return hits.groupBy("path", "crawler_type", "segment").agg(F.bool_or("crawled").alias("crawled"), F.count("*").alias("hit_count"))


def rollup(hits: DataFrame, key: str) -> DataFrame:
    """Hits by a key and segment; a missing referer is '-'."""
    value = F.coalesce(F.col(key), F.lit("-")) if key == "referer" else F.col(key)
    return hits.groupBy(value.alias(key), "segment").agg(F.count("*").alias("hit_count"))


def verified_rollup(hits: DataFrame) -> DataFrame:
    return hits.filter("crawler_type <> 'Human'").groupBy("path", "crawler_type", "verified", "segment").agg(F.count("*").alias("hit_count"))


def human_rollup(hits: DataFrame) -> DataFrame:
    return hits.filter("crawler_type = 'Human'").groupBy("path", "browser", F.coalesce("country", F.lit("-")).alias("country"), "segment").agg(F.count("*").alias("hit_count"))


def ip_rollup(hits: DataFrame) -> DataFrame:
    return hits.groupBy("path", "ip", "segment").agg(F.count("*").alias("hit_count"))


def _n(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def _status_counts() -> list[Column]:
    s = F.col("status")
    return [_n((s >= a) & (s < a + 100), n) for a, n in ((200, "success"), (300, "redirect"), (400, "client_error"), (500, "server_error"))]


def timeline_rollup(hits: DataFrame) -> DataFrame:
    """Both grains at once: hits by hour, then the hours by day."""
    fam = L.bot_families(F.col("crawler_type"), F.col("user_agent"))
    human, names = F.col("crawler_type") == "Human", ["human", "crawler", "success", "redirect", "client_error", "server_error", "google", "bing", "openai", "claude"]
    hours = hits.groupBy("day", "hour").agg(_n(human, "human"), _n(~human, "crawler"), *_status_counts(), *[_n(fam[k], k) for k in ("google", "bing", "openai", "claude")])
    both = hours.withColumn("g", F.explode(F.array(F.struct(F.lit("day").alias("grain"), F.col("day").alias("date")), F.struct(F.lit("hour").alias("grain"), F.col("hour").alias("date")))))
    return both.groupBy("g.grain", "g.date").agg(*[F.sum(c).alias(c) for c in names])


def timeline(hits: DataFrame, grain: str = "day", last: int | None = 2000) -> DataFrame:
    """Human and crawler hits of the last points of time (None: all), in ascending order."""
    human = F.col("crawler_type") == "Human"
    points = hits.groupBy(F.col(grain).alias("date")).agg(_n(human, "human"), _n(~human, "crawler"))
    return points.orderBy("date") if last is None else points.orderBy(F.desc("date")).limit(last).orderBy("date")


def status_timeline(hits: DataFrame, grain: str = "day") -> DataFrame:
    return hits.groupBy(F.col(grain).alias("date")).agg(*_status_counts())


def crawler_timeline(hits: DataFrame, grain: str = "day") -> DataFrame:
    fam = L.bot_families(F.col("crawler_type"), F.col("user_agent"))
    keys = ["google", "bing", "openai", "claude"]
    rows = hits.filter("crawler_type <> 'Human'").groupBy(F.col(grain).alias("date")).agg(F.count("*").alias("_n"), *[_n(fam[k], k) for k in keys])
    return rows.withColumn("other", F.greatest(F.col("_n") - sum(F.col(k) for k in keys), F.lit(0))).drop("_n")


def filetype_timeline(hits: DataFrame, grain: str = "day") -> DataFrame:
    kinds = {"html": "HTML", "css": "CSS", "js": "JS", "image": "Image"}
    f = F.col("file_type")
    return hits.groupBy(F.col(grain).alias("date")).agg(*[_n(f == v, k) for k, v in kinds.items()], _n(~f.isin(list(kinds.values())), "other"))


def bandwidth_timeline(hits: DataFrame, grain: str = "day") -> DataFrame:
    return hits.groupBy(F.col(grain).alias("date")).agg(F.sum(F.coalesce("response_size", F.lit(0))).alias("bytes"))


WIDGETS = {
    "file_type": lambda: F.col("file_type"), "segment": lambda: F.col("segment"), "status": lambda: F.col("status").cast("string"), "user_agent": lambda: F.col("user_agent"),
    "ua_category": lambda: L.ua_category(F.col("user_agent")), "referer": lambda: F.coalesce(F.col("referer"), F.lit("Direct/None")), "referer_category": lambda: L.referer_category(F.col("referer")), "crawler_type": lambda: F.col("crawler_type"),
}


def widget(hits: DataFrame, name: str) -> DataFrame:
    """name and hits of one widget; user agents and referers are the 100 most frequent (ties by name)."""
    rows = hits.filter("crawler_type <> 'Human' and crawler_type <> ''") if name == "crawler_type" else hits
    source = {"ua_category": "user_agent", "referer_category": "referer"}.get(name)
    if source:  # by value first, so that each is put into its category once
        return rows.groupBy(source).agg(F.count("*").alias("_n")).groupBy(WIDGETS[name]().alias("name")).agg(F.sum("_n").alias("hits"))
    counts = rows.groupBy(WIDGETS[name]().alias("name")).agg(F.count("*").alias("hits"))
    return counts.orderBy(F.desc("hits"), "name").limit(100) if name in ("user_agent", "referer") else counts


def category_examples(hits: DataFrame, kind: str, most: int = 5) -> DataFrame:
    """Hits and up to five example values (in order) of each referer or user-agent category.

    Examples are chosen among distinct values, so no list grows with the hits.
    """
    col = "referer" if kind == "referer" else "user_agent"
    cat = L.referer_category(F.col(col)) if kind == "referer" else L.ua_category(F.col(col))
    values = hits.groupBy(F.col(col).alias("v")).agg(F.count("*").alias("n")).withColumn(col, F.col("v")).select(cat.alias("category"), "v", "n")
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.col("v").asc_nulls_last()))
    top = values.withColumn("r", rank).filter(F.col("r") <= most).groupBy("category").agg(F.array_join(F.sort_array(F.collect_list("v")), " | ").alias("examples"))
    return values.groupBy("category").agg(F.sum("n").alias("hits")).join(top, "category")


# ---------------------------------------------------------------- statistics


def log_stats(hits: DataFrame) -> DataFrame:
    """One row: counts, distinct addresses and user agents, success rate, times, and hits of eight crawler families."""
    fam = L.bot_families(F.col("crawler_type"), F.col("user_agent"))
    ok = (F.col("status") >= 200) & (F.col("status") < 300)
    return hits.agg(
        F.count("*").alias("total"), _n(F.col("crawler_type") != "Human", "crawlers"), F.countDistinct("ip").alias("unique_ips"), F.countDistinct("user_agent").alias("unique_user_agents"),
        _n(ok, "success"), F.min("ts").cast("string").alias("first_hit"), F.max("ts").cast("string").alias("last_hit"),
        F.round(F.count_if(ok) * 100.0 / F.greatest(F.count("*"), F.lit(1)), 6).alias("success_rate"), *[_n(c, k) for k, c in fam.items()],
    )


def segment_stats(hits: DataFrame) -> DataFrame:
    """Per segment: hits, crawlers, distinct addresses, status classes and hits a distinct path."""
    return hits.groupBy("segment").agg(F.count("*").alias("total"), _n(F.col("crawler_type") != "Human", "crawlers"), F.countDistinct("ip").alias("unique_ips"), *_status_counts(), F.round(F.count("*") / F.countDistinct("path"), 6).alias("per_path"))


def bot_types(hits: DataFrame) -> DataFrame:
    return hits.select("crawler_type").distinct().orderBy("crawler_type")


def bot_paths(hits: DataFrame) -> DataFrame:
    """Per path, crawler and user agent: hits, bytes, first and last time, distinct referers joined in order, and the latest row's file type and status."""
    latest = F.struct("ts", "hit_id")
    return hits.filter("crawler_type <> 'Human'").groupBy("path", "crawler_type", "user_agent").agg(
        F.count("*").alias("hits"), F.sum(F.coalesce("response_size", F.lit(0))).alias("bytes"), F.min("ts").cast("string").alias("first_hit"), F.max("ts").cast("string").alias("last_hit"),
        F.array_join(F.sort_array(F.collect_set("referer")), ",").alias("referers"), F.max_by("file_type", latest).alias("file_type"), F.max_by("status", latest).alias("status"), F.max("segment").alias("segment"),
    )


#: What the trend tables are grouped by; `human` is whether a hit is a person's.
TREND_KEYS = {
    "day": ("day", "human"),
    "file_type": ("file_type",),
    "segment": ("segment",),
    "path": ("path", "crawler_type", "segment", "human"),
    "status": ("status", "segment"),
    "method": ("method", "segment"),
    "user_agent": ("user_agent", "segment"),
    "referer": ("referer", "segment"),
    "browser": ("browser", "segment"),
    "verified": ("path", "crawler_type", "verified", "segment"),
    "ip": ("path", "ip", "segment"),
    "person": ("path", "browser", "country", "segment", "human"),
}


def trend_rollups(hits: DataFrame) -> DataFrame:
    """Every trend table in one scan: kind, its keys (others null), n, crawled, sought (a search click or impression of an uncrawled path). Written.

    Grouping sets add up each set's keys before the one shuffle, so rows that travel are distinct keys of a task. A crawler's `verified` rows
    are of crawlers only, `person` rows of people only.
    """
    keys = list(dict.fromkeys(k for ks in TREND_KEYS.values() for k in ks))
    rows = hits.select(*[F.col(k) for k in keys if k not in ("human", "referer", "country", "status")], F.col("status").cast("string").alias("status"), F.coalesce("referer", F.lit("-")).alias("referer"), F.coalesce("country", F.lit("-")).alias("country"), (F.col("crawler_type") == "Human").alias("human"), "crawled", (~F.col("crawled") & ((F.col("clicks") > 0) | (F.col("impressions") > 0))).alias("sought"))
    ids = {sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in ks): kind for kind, ks in TREND_KEYS.items()}
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in ids.items() for x in pair]), F.grouping_id().cast("int"))
    found = rows.groupingSets([list(ks) for ks in TREND_KEYS.values()], *keys).agg(kind.alias("kind"), F.count("*").alias("n"), F.max(F.coalesce("crawled", F.lit(False))).alias("crawled"), F.max(F.coalesce("sought", F.lit(False))).alias("sought"))
    return materialized(found.filter("(kind <> 'verified' or crawler_type <> 'Human') and (kind <> 'person' or human)"), "trends")


def trend_totals(hits: DataFrame, urls: DataFrame, rollups: DataFrame | None = None) -> DataFrame:
    """One row of 27 totals: rows and hits of each trend table, and paths that crawlers waste, miss or should be kept from.

    hits is read once (not at all if trend_rollups(hits) is given), the list of urls twice.
    """
    base = trend_rollups(hits) if rollups is None else rollups
    of = lambda c, n: (F.count_if(c).alias(f"{n}_count"), F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(f"{n}_hits"))
    kind = F.col("kind")
    own = {n: kind == n for n in ("status", "method", "user_agent", "referer", "browser", "verified")} | {"path": (kind == "path") & ~F.col("human"), "human": (kind == "path") & F.col("human")}
    tables = base.agg(*[c for n, x in own.items() for c in of(x, n)])
    ips = base.filter("kind = 'ip'").groupBy("ip").agg(F.sum("n").alias("n")).agg(F.count("*").alias("ip_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("ip_hits"))
    dull, crawled = L.unimportant(F.col("path")), F.col("crawled")
    bots = base.filter("kind = 'path' and not human")
    flag = lambda c: F.max(c)
    paths = bots.groupBy("path").agg(
        flag(~crawled).alias("orphan_pages"), flag(F.col("sought")).alias("orphans_gsc_traffic"), flag(dull).alias("unimportant_crawled"), flag(dull & ~crawled).alias("wasted_crawl_budget"),
        flag(dull & crawled).alias("robots_txt_improvements"), flag(crawled & (F.col("n") <= 2)).alias("low_frequency_important"),
    )
    names = [c for c in paths.columns if c != "path"]
    paths = paths.agg(*[F.count_if(c).alias(c) for c in names])
    listed = urls.select(L.norm_path(F.col("url")).alias("path"))
    missing = listed.join(bots.select("path").distinct(), "path", "left_anti").agg(F.count("*").alias("uncrawled_urls"), F.count("*").alias("dead_content"))
    return tables.crossJoin(ips).crossJoin(paths).crossJoin(listed.agg(F.count("*").alias("crawled_pages"))).crossJoin(missing)  # rows of aggregates


def trend_top(rollups: DataFrame, most: int = 10) -> DataFrame:
    """kind, name and hits of the largest rows of five trend tables (paths of crawlers only); ties by name, then by what else the row has."""
    out = None
    for kind in ("path", "status", "user_agent", "referer", "browser"):
        own = rollups.filter((F.col("kind") == kind) & (F.col("human").isNull() | ~F.col("human")))
        top_ = own.orderBy(F.desc("n"), kind, "segment", "crawler_type").limit(most).select(F.lit(kind).alias("kind"), F.col(kind).alias("name"), F.col("n").alias("hits"))
        out = top_ if out is None else out.unionByName(top_)
    return out


#: The sheets of the trends workbook: their headers, and the trend table and keys that they add up.
TREND_SHEETS = {
    "Timeline": (("Date", "Human Hits", "Crawler Hits"), "day", ("day",)),
    "File Types": (("File Type", "Hits"), "file_type", ("file_type",)),
    "Content Segments": (("Segment", "Hits"), "segment", ("segment",)),
    "Path Frequency": (("Path", "Hits", "Type", "Segment"), "path", ("path", "crawler_type", "segment")),
    "Status Codes": (("Status", "Hits"), "status", ("status",)),
    "Methods": (("Method", "Hits"), "method", ("method",)),
    "User Agents": (("User Agent", "Hits"), "user_agent", ("user_agent",)),
    "Referrers": (("Referer", "Hits"), "referer", ("referer",)),
    "Browsers": (("Browser", "Hits"), "browser", ("browser",)),
    "Verified Bots": (("Bot", "Hits"), "verified", ("crawler_type",)),
    "IP Addresses": (("IP", "Hits"), "ip", ("ip",)),
    "Human Traffic": (("Path", "Browser", "Country", "Hits"), "person", ("path", "browser", "country")),
}


def trend_sheets(rollups: DataFrame) -> DataFrame:
    """sheet, keys (three texts, null where it has fewer), hits and crawler_hits (of the timeline only): the rows of all sheets, from one aggregate."""
    sheet = F.create_map(*[F.lit(x) for name, (_, kind, _) in TREND_SHEETS.items() for x in (kind, name)])
    cases = {kind: [F.col(k) for k in keys] + [F.lit(None)] * (3 - len(keys)) for _, kind, keys in TREND_SHEETS.values()}
    key = lambda i: F.coalesce(*[F.when(F.col("kind") == kind, cols[i]) for kind, cols in cases.items()])
    timeline = F.col("kind") == "day"
    rows = rollups.select(F.element_at(sheet, F.col("kind")).alias("sheet"), *[key(i).cast("string").alias(f"key{i + 1}") for i in range(3)], F.when(timeline & ~F.col("human"), 0).otherwise(F.col("n")).alias("hits"), F.when(timeline, F.when(F.col("human"), 0).otherwise(F.col("n"))).alias("crawler_hits"))
    return rows.groupBy("sheet", "key1", "key2", "key3").agg(F.sum("hits").alias("hits"), F.sum("crawler_hits").alias("crawler_hits"))


def trend_summary(hits_total: int, rollups: DataFrame) -> DataFrame:
    """metric, unique_count and total_hits of nine trend tables, and the number of hits."""
    labels = {"path": "URL Path Frequency", "status": "Status Codes Frequency", "method": "Method Frequency", "user_agent": "User Agents Frequency", "referer": "Referrers Frequency", "browser": "Browser Frequency", "verified": "Verified Bots", "ip": "IP frequency", "person": "Human Traffic Frequency"}
    metric = F.element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), F.col("kind"))
    rows = rollups.filter(F.col("kind").isin(list(labels))).groupBy(metric.alias("metric")).agg(F.count("*").alias("unique_count"), F.sum("n").alias("total_hits"))
    return rows.unionByName(rollups.sparkSession.range(1).select(F.lit("TOTAL LOG ENTRIES").alias("metric"), F.lit(None).cast("long").alias("unique_count"), F.lit(hits_total).cast("long").alias("total_hits")))


def write_sheets(rows: DataFrame, folder: str, order: list[Column], kind: str = "sheet", ranges: int | None = None) -> None:
    """One job writes every kind's rows as CSV files of its own folder, in order over the files' names; no kind is sorted in one task."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(kind), *order]
    rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.mode("errorifexists").partitionBy(kind).option("header", True).csv(folder)


def status_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("status").agg(F.count("*").alias("hits"))


def segment_bots(hits: DataFrame) -> DataFrame:
    """Per segment: hits of each crawler as a map, and the mean of hits over segments."""
    each = hits.groupBy("segment", "crawler_type").agg(F.count("*").alias("n"))
    rows = each.groupBy("segment").agg(F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("crawler_type") != "Human", F.struct("crawler_type", "n"))))).alias("bots"), F.sum("n").alias("hits"))  # a row a crawler
    mean = rows.agg(F.round(F.avg("hits"), 6).alias("mean_hits"))
    return rows.crossJoin(mean)  # one row


def crawl_coverage(urls: DataFrame, hits: DataFrame) -> DataFrame:
    """Each listed url with the hits of its path: crawled or not, crawler hits, last time ('-' if none)."""
    seen = hits.groupBy("norm_path").agg(F.count("*").alias("n"), F.count_if(F.col("crawler_type") != "Human").alias("bots"), F.max("ts").cast("string").alias("last"))
    rows = urls.select("url", L.norm_path(F.col("url")).alias("norm_path")).join(seen, "norm_path", "left")
    return rows.select("url", F.col("n").isNotNull().alias("crawled"), F.coalesce("n", F.lit(0)).alias("hits"), F.coalesce("bots", F.lit(0)).alias("bot_hits"), F.coalesce("last", F.lit("-")).alias("last_hit"))


# ---------------------------------------------------------------- pages of rows

SORT_KEYS = ("ts", "ip", "path", "method", "status", "user_agent", "referer", "response_size", "crawler_type", "file_type", "country")


def page(df: DataFrame, number: int, size: int, sort: str | None = None, descending: bool = False, tie: str = "hit_id") -> DataFrame:
    """The number-th page (from 1) of `size` rows; unknown sort keys mean time. Ties are ordered by `tie`."""
    key = F.col(sort if sort in SORT_KEYS else "ts")
    return df.orderBy(key.desc() if descending else key.asc(), tie).offset((number - 1) * size).limit(size)


def rollup_page(df: DataFrame, number: int, size: int, sort: str = "hit_count", descending: bool = True) -> DataFrame:
    """A page of a rollup, ties by all its columns."""
    key = F.col(sort if sort in df.columns else "hit_count")
    return df.orderBy(key.desc() if descending else key.asc(), *df.columns).offset((number - 1) * size).limit(size)


def top(df: DataFrame, k: int = 10) -> DataFrame:
    return rollup_page(df, 1, k)


def downsample(points: DataFrame, target: int = 1000, measures: tuple[str, ...] = ("human", "crawler")) -> DataFrame:
    """At most `target` points: neighbours merged evenly, with the first date and summed measures. Takes one row a point of time."""
    n = points.count()
    width = max(1, -(-n // target))
    bucket = F.floor((F.row_number().over(Window.orderBy("date")) - 1) / width)
    return points.withColumn("_b", bucket).groupBy("_b").agg(F.min("date").alias("date"), *[F.sum(m).alias(m) for m in measures]).drop("_b")
