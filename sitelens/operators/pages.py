"""Operators over crawled pages: summaries, issues, tabs, distributions, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import urls as U

C = F.col


def _empty(c: str) -> Column:
    return C(c).isNull() | (C(c) == "")


def dup_flag(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rows with `name`: whether their trimmed, non-empty value is on more than one page. An aggregate and a join, so a
    value that many pages share is counted map-side."""
    v = F.nullif(F.trim(C(column)), F.lit(""))
    many = df.groupBy(v.alias("_v")).agg(F.count("*").alias("_n")).filter("_v is not null and _n > 1").select("_v", F.lit(True).alias(name))
    return df.withColumn("_v", v).join(many, "_v", "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("_v")


def occurrences(df: DataFrame, column: str) -> DataFrame:
    """Duplicate report: pages whose value another page has, with how many have it."""
    v = F.nullif(F.trim(C(column)), F.lit(""))
    many = df.groupBy(v.alias("_v")).agg(F.count("*").alias("occurrences")).filter("_v is not null and occurrences > 1")
    return df.withColumn("_v", v).join(many, "_v").select("url", column, "occurrences")


def indexability(pages: DataFrame) -> DataFrame:
    """Pages with indexability (0, 0.8 or 1) and its reason, by status, robots directives and canonical, in that order."""
    s, robots = C("status_code"), F.lower(F.coalesce("robots", F.lit("")))
    same = U.norm_url(C("canonical")) == U.norm_url(C("url"))
    rules = [
        (~s.between(200, 299) | (s == 204), 0.0, F.concat(F.lit("Not indexable: HTTP status "), s.cast("string"))),
        (robots.rlike(r"(^|[,\s])(noindex|none)([,\s]|$)"), 0.0, F.lit("Not indexable: meta robots contains noindex")),
        (C("canonical").isNotNull() & same, 1.0, F.lit("Indexable: self-referencing canonical")),
        (C("canonical").isNotNull(), 0.0, F.concat(F.lit("Not indexable: canonical points to "), U.norm_url(C("canonical")))),
        (robots.rlike(r"(^|[,\s])nofollow([,\s]|$)"), 0.8, F.lit("Indexable: nofollow directive present")),
    ]
    score, why = None, None
    for cond, value, reason in rules:
        score = F.when(cond, value) if score is None else score.when(cond, value)
        why = F.when(cond, reason) if why is None else why.when(cond, reason)
    return pages.withColumns({"indexability": score.otherwise(F.lit(1.0)), "reason": why.otherwise(F.lit("Indexable: successful response with no blocking directive"))})


def directives(values: Column) -> Column:
    """The robots directives in some values, in lower case and without signs around them.

    Values are cut at commas and semicolons; a part may begin with a crawler's name and a colon, and counts if that is one of ROBOT_AGENTS.
    """
    parts = F.flatten(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.split(F.lower(F.coalesce(v, F.lit(""))), "[,;]")))

    def own(part: Column) -> Column:
        agent, rest = F.trim(F.regexp_extract(part, "^([^:]*):", 1)), F.regexp_extract(part, "^[^:]*:(.*)$", 1)
        return F.when(~part.contains(":"), part).when(agent.isin(T.ROBOT_AGENTS), rest).otherwise("")

    words = F.flatten(F.transform(parts, lambda p: F.split(F.trim(own(p)), r"\s+")))
    return F.transform(words, lambda w: F.regexp_replace(w, "^[^a-z0-9]+|[^a-z0-9]+$", ""))


def page_indexability(pages: DataFrame) -> DataFrame:
    """Pages with indexability (0, 0.5, 0.8 or 1) and its reason, by the first that holds: status, X-Robots-Tag, meta robots, canonicals, directives.

    pages have url, status_code, x_robots (header values), robots_meta (name and content of robots metas, any names) and canonicals, as they
    are written; arrays may be null.
    """
    s = F.coalesce("status_code", F.lit(0))
    metas = F.filter("robots_meta", lambda m: F.lower(F.trim(m["name"])).isin(T.ROBOT_AGENTS))
    has = lambda words, *names: F.arrays_overlap(words, F.array(*map(F.lit, names)))
    rows = pages.withColumns({"_h": directives(C("x_robots")), "_m": directives(F.transform(metas, lambda m: m["content"])), "_c": F.coalesce("canonicals", F.array().cast("array<string>"))})
    target = U.norm_url(U.resolved(F.try_element_at("_c", F.lit(1)), C("url")))
    either = lambda *names: has(C("_h"), *names) | has(C("_m"), *names)
    rules = [
        (~s.between(200, 299) | (s == 204), 0.0, F.concat(F.lit("Not indexable: HTTP status "), s.cast("string"))),
        (has(C("_h"), "noindex", "none"), 0.0, F.lit("Not indexable: X-Robots-Tag contains noindex")),
        (has(C("_m"), "noindex", "none"), 0.0, F.lit("Not indexable: meta robots contains noindex")),
        (F.size("_c") > 1, 0.0, F.lit("Not indexable: multiple canonical links found")),
        ((F.size("_c") == 1) & C("url").isNull(), 0.5, F.concat(F.lit("Canonical found but page URL was unavailable: "), F.try_element_at("_c", F.lit(1)))),
        ((F.size("_c") == 1) & (target == U.norm_url(C("url"))), 1.0, F.lit("Indexable: self-referencing canonical")),
        (F.size("_c") == 1, 0.0, F.concat(F.lit("Not indexable: canonical points to "), target)),
        (either("nofollow", "none"), 0.8, F.lit("Indexable: nofollow directive present")),
        (either("index", "all"), 1.0, F.lit("Indexable: explicit index directive present")),
    ]
    score, why = None, None
    for cond, value, reason in rules:
        score = F.when(cond, value) if score is None else score.when(cond, value)
        why = F.when(cond, reason) if why is None else why.when(cond, reason)
    found = {"indexability": score.otherwise(F.lit(1.0)), "reason": why.otherwise(F.lit("Indexable: successful response with no blocking directive"))}
    return rows.withColumns(found).drop("_h", "_m", "_c")


def _n(cond: Column, name: str) -> Column:
    return F.count_if(cond).alias(name)


def depth_histogram(pages: DataFrame) -> DataFrame:
    """Depths 0 to 10 (and over) by response: all eleven rows are there."""
    s = C("status_code")
    rows = pages.groupBy(F.least(F.coalesce("url_depth", F.lit(0)), F.lit(10)).alias("depth")).agg(_n(s == 0, "no_response"), *[_n(s.between(a, a + 99), f"s{a // 100}xx") for a in (200, 300, 400, 500)])
    spark = pages.sparkSession
    return spark.range(11).withColumnRenamed("id", "depth").join(rows, "depth", "left").na.fill(0)


def _buckets(c: Column, cases: list[tuple[Column, str]], last: str) -> Column:
    out = None
    for cond, name in cases:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(last)


def distribution(pages: DataFrame, kind: str) -> DataFrame:
    """bucket and pages of one distribution: words, response_time, status, depth, indexability, robots, treemap."""
    w, t, s = F.coalesce("word_count", F.lit(0)), C("response_time"), C("status_code")
    value = {
        "words": lambda: _buckets(w, [(w == 0, "No Content"), (w <= 100, "1-100"), (w <= 300, "101-300"), (w <= 600, "301-600"), (w <= 1000, "601-1000")], "1000+"),
        "response_time": lambda: _buckets(t, [(t < 0.2, "fast"), (t <= 1, "medium")], "slow"),
        "status": lambda: F.coalesce(s.cast("string"), F.lit("0")),
        "depth": lambda: F.coalesce(C("url_depth"), F.lit(0)).cast("string"),
        "indexability": lambda: F.when(C("indexability") >= 0.5, "Indexable").otherwise("Not indexable"),
        "robots": lambda: F.when(F.coalesce("robots", F.lit("")) == "", "none").otherwise(C("robots")),
        "treemap": lambda: F.concat(F.lit("/"), F.array_join(F.slice(F.filter(F.split(U.url_path(C("url")), "/"), lambda p: p != ""), 1, 1), "/")),
    }[kind]()
    return pages.groupBy(value.alias("bucket")).agg(F.count("*").alias("pages"))


def canonical_errors(pages: DataFrame) -> DataFrame:
    """url and error: missing, or elsewhere."""
    elsewhere = C("canonical").isNotNull() & (U.same_key(C("canonical")) != U.same_key(C("url")))
    found = F.when(C("canonical").isNull(), "missing").when(elsewhere, "elsewhere")
    return pages.select("url", found.alias("error")).filter("error is not null")


def path_tree(pages: DataFrame) -> DataFrame:
    """node and pages at or below it, for every prefix of the addresses' scheme, host and path."""
    segments = F.filter(F.split(C("url"), "/+"), lambda p: p != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.array_join(F.slice(segments, 1, i), "/"))
    return pages.select(F.explode(F.array_distinct(prefixes)).alias("node")).groupBy("node").agg(F.count("*").alias("pages"))


def internal_view(pages: DataFrame) -> DataFrame:
    """The audit table's columns that these pages have, in its order of rows: by depth, then by length of address."""
    rows = pages.select(
        "url", "status_code", U.status_text(C("status_code")).alias("status"), C("indexability"), C("reason").alias("indexability_status"), "title", F.length("title").alias("title_length"), U.title_px(C("title")).alias("title_pixels"),
        C("description"), F.length("description").alias("description_length"), U.desc_px(C("description")).alias("description_pixels"), "canonical", "robots", "word_count", C("url_depth").alias("crawl_depth"), U.folder_depth(C("url")).alias("folder_depth"), "response_time",
    )
    return rows.orderBy(F.coalesce("crawl_depth", F.lit(99)), F.length("url"), "url")


#: The 73 columns of the internal table, in order; those without a source are null.
INTERNAL = (
    "address content_type status_code status indexability indexability_status title_1 title_1_length title_1_pixels description_1 description_1_length description_1_pixels keywords_1 keywords_1_length "
    "h1_1 h1_1_length h2_1 h2_1_length h2_2 h2_2_length meta_robots_1 meta_robots_2 x_robots_tag_1 meta_refresh_1 canonical_1 rel_next_1 rel_prev_1 http_rel_next_1 http_rel_prev_1 amphtml "
    "size_bytes transferred_bytes total_transferred_bytes co2_mg carbon_rating word_count sentence_count words_per_sentence flesch readability text_ratio crawl_depth folder_depth link_score "
    "inlinks unique_inlinks unique_js_inlinks percent_of_total outlinks unique_outlinks unique_js_outlinks external_outlinks unique_external_outlinks unique_external_js_outlinks "
    "closest_near_duplicate near_duplicates spelling_errors grammar_errors hash response_time last_modified redirect_url redirect_type cookies language http_version mobile_alternate "
    "closest_similar_address similarity_score similar_addresses relevance_score encoded_address crawl_timestamp"
).split()


def internal_table(pages: DataFrame, links: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """All INTERNAL columns of every page, by depth (missing: 99), then by length of address.

    pages have url, status_code and whatever else is known (missing columns are null); links source_url, url and internal; scores
    url and score, as link_score gives them. Link counts are partial sums by target and source, joined once each.
    """
    has = lambda c: C(c) if c in pages.columns else F.lit(None).cast("string")
    item = lambda c, i: F.try_element_at(c, F.lit(i)) if c in pages.columns else F.lit(None).cast("string")
    key = lambda c: U.inlink_key(C(c))
    ins = links.groupBy(key("url").alias("_in")).agg(F.count("*").alias("_inlinks"), F.countDistinct(key("source_url")).alias("_sources"))
    outer = lambda c: F.when(~F.coalesce("internal", F.lit(False)), c)
    outs = links.groupBy(key("source_url").alias("_out")).agg(F.count("*").alias("_outlinks"), F.countDistinct(key("url")).alias("_targets"), F.count(outer(C("url"))).alias("_ext"), F.countDistinct(outer(key("url"))).alias("_exts"))
    rows = pages.withColumn("_k", key("url")).join(ins, C("_k") == C("_in"), "left").join(outs, C("_k") == C("_out"), "left")
    if scores is not None:
        rows = rows.withColumn("_u", U.norm_url(C("url"))).join(scores.select(C("url").alias("_s"), C("score").alias("_score")), C("_u") == C("_s"), "left")
    rows = rows.crossJoin(pages.agg(F.count("*").alias("_all")))  # one row
    zero = lambda c: F.coalesce(C(c), F.lit(0)).cast("long")
    length = lambda c: F.nullif(F.length(c), F.lit(0))
    sent = F.coalesce(has("transferred_bytes").cast("long"), has("html_bytes").cast("long"))
    words, sentences = has("word_count").cast("long"), has("sentence_count").cast("long")
    title, desc, keywords, h1, h2, h22 = has("title"), has("description"), has("keywords"), item("h1", 1), item("h2", 1), item("h2", 2)
    found = {
        "address": U.display_url(C("url")), "content_type": F.coalesce(has("content_type"), F.lit("text/html")), "status_code": C("status_code"), "status": U.status_text(C("status_code")),
        "indexability": F.when(F.coalesce(has("indexability").cast("double"), F.lit(0.5)) >= 0.5, "Indexable").otherwise("Non-Indexable"), "indexability_status": has("reason"),
        "title_1": title, "title_1_length": length(title), "title_1_pixels": F.when(F.length(title) > 0, U.title_px(title)), "description_1": desc, "description_1_length": length(desc), "description_1_pixels": F.when(F.length(desc) > 0, U.desc_px(desc)),
        "keywords_1": keywords, "keywords_1_length": length(keywords), "h1_1": h1, "h1_1_length": length(h1), "h2_1": h2, "h2_1_length": length(h2), "h2_2": h22, "h2_2_length": length(h22),
        "meta_robots_1": item("robots", 1), "meta_robots_2": item("robots", 2), "x_robots_tag_1": item("x_robots", 1), "meta_refresh_1": has("refresh"), "canonical_1": item("canonicals", 1), "rel_next_1": has("next"), "rel_prev_1": has("prev"),
        "http_rel_next_1": has("http_rel_next"), "http_rel_prev_1": has("http_rel_prev"), "amphtml": has("amp"), "size_bytes": has("html_bytes").cast("long"), "transferred_bytes": sent, "total_transferred_bytes": sent,
        "co2_mg": U.co2_mg(sent), "carbon_rating": U.carbon_rating(U.co2_mg(sent)), "word_count": words, "sentence_count": sentences, "words_per_sentence": F.when((words > 0) & (sentences > 0), F.round(words / sentences, 2)),
        "flesch": F.round(has("flesch").cast("double"), 2), "readability": has("readability"), "text_ratio": F.round(has("text_ratio").cast("double"), 2), "crawl_depth": has("url_depth").cast("int"), "folder_depth": U.folder_depth(C("url")),
        "link_score": C("_score").cast("long") if scores is not None else F.lit(None).cast("long"), "inlinks": zero("_inlinks"), "unique_inlinks": zero("_sources"), "percent_of_total": F.round(zero("_sources") * 100.0 / F.greatest("_all", F.lit(1)), 2),
        "outlinks": zero("_outlinks"), "unique_outlinks": zero("_targets"), "external_outlinks": zero("_ext"), "unique_external_outlinks": zero("_exts"), "hash": has("hash"), "response_time": has("response_time").cast("double"),
        "last_modified": has("last_modified"), "redirect_url": has("redirect_url"), "redirect_type": has("redirection_type"), "cookies": has("cookies").cast("int"), "language": has("language"), "http_version": has("http_version"),
        "mobile_alternate": has("mobile_alternate"), "encoded_address": U.encoded_url(C("url")), "crawl_timestamp": has("crawl_timestamp"),
    }
    table = rows.select(*[found.get(c, F.lit(None).cast("string")).alias(c) for c in INTERNAL], F.length("url").alias("_n"), C("url").alias("_url"))
    return table.orderBy(F.coalesce("crawl_depth", F.lit(99)), "_n", "_url").drop("_n", "_url")


def even_sample(pages: DataFrame, most: int, order: str) -> DataFrame:
    """At most `most` rows, evenly spread over the order: the rows floor(i * n / most). Ranks come from range partitions, not from one task."""
    n = pages.count()
    ranked = ranks(pages, order)
    if n <= most:
        return ranked.drop("_r")
    i = F.ceil(C("_r") * most / n)
    return ranked.filter((F.floor(i * n / most) == C("_r")) & (i < most)).drop("_r")


def ranks(df: DataFrame, *order: str | Column) -> DataFrame:
    """Rows with _r, their place (from 0) by an order that has no ties."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    parts = parts.withColumn("_p", F.shiftright("_id", 33)).withColumn("_i", C("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = {r["_p"]: r["count"] for r in parts.groupBy("_p").count().collect()}  # a row a partition
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    offsets = F.create_map(*[F.lit(x) for kv in before for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    return parts.withColumn("_r", C("_i") + F.element_at(offsets, C("_p").cast("int"))).drop("_id", "_p", "_i")


def universe(*kinds: tuple[DataFrame, bool]) -> DataFrame:
    """url and is_asset of pages and then assets: http(s) only, each url as what it was first."""
    rows = None
    for i, (df, asset) in enumerate(kinds):
        part = df.select("url", F.lit(asset).alias("is_asset"), F.lit(i).alias("_p"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.filter(C("url").rlike("^https?://")).groupBy("url").agg(F.min_by("is_asset", "_p").alias("is_asset"))


def trend(history: DataFrame, metrics: list[str]) -> DataFrame:
    """Crawls with each metric's change since the domain's crawl before; the first one's is null."""
    w = Window.partitionBy("domain").orderBy("date", "id")
    return history.select("*", *[(C(m) - F.lag(m).over(w)).alias(f"{m}_delta") for m in metrics])
