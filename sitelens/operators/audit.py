"""The audit of whole crawls over page facts: issues, tabs, summary, health, overview, assets, slices, reports.

Pages have the columns of `WIDE`, which `sources.html.extract_pages` gives for the html and the crawl for the rest; a missing array is
as an empty one. Every function is one scan of the pages, with an aggregate and a join for each value that pages can share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import urls as U
from .pages import _n
from .tables import materialized

C = F.col

WIDE = (
    "url string, status_code int, content_type string, title string, titles int, description string, h1 array<string>, h2 array<string>, canonicals array<string>, robots array<string>, url_depth int, word_count int, "
    "response_time double, kb int, flesch double, text_ratio double, language string, mobile boolean, schema string, opengraph map<string,string>, hreflangs array<struct<lang:string,url:string>>, "
    "images array<struct<url:string,alt:string,size:long,broken:boolean>>, css array<string>, css_inline int, javascript array<string>, internal_links int, external_links int, mixed_content int, unsafe_anchors int, "
    "cookies int, redirect_count int, had_redirect boolean, next string, prev string, amp string, indexability double"
)


def _text(c: str) -> Column:
    return F.coalesce(C(c), F.lit(""))


def _size(c: str) -> Column:
    return F.greatest(F.size(F.coalesce(C(c), F.array())), F.lit(0))


def _first(c: str) -> Column:
    return F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))


def _any(c: str, test) -> Column:
    return F.coalesce(F.exists(c, test), F.lit(False))


def same_url(a: Column, b: Column) -> Column:
    """Equal but for case, scheme, www., fragment and one slash at the end; an empty address equals none."""
    return (F.coalesce(a, F.lit("")) != "") & (U.same_key(a) == U.same_key(b))


SHARED = {"title": "dup_title", "description": "dup_description", "_h1": "dup_h1", "_h2": "dup_h2"}


def flagged(pages: DataFrame) -> DataFrame:
    """Pages with dup_title, dup_description, dup_h1 and dup_h2: whether another page has their value.

    The pages are written once, so what they are derived from is read and parsed once; one aggregate finds the values of all four that
    pages share.
    """
    value = lambda c: F.nullif(F.trim(C(c)), F.lit(""))
    rows = materialized(pages.withColumns({"_h1": _first("h1"), "_h2": _first("h2")}), "audit")
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), value(c).alias("v")) for c in SHARED])).alias("r")).select("r.*").filter("v is not null")
    many = materialized(each.groupBy("c", "v").agg(F.count("*").alias("_n")).filter("_n > 1"), "shared")
    for c, name in SHARED.items():
        own = many.filter(C("c") == c).select(C("v").alias("_v"), F.lit(True).alias(name))
        rows = rows.withColumn("_v", value(c)).join(own, "_v", "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("_v")
    return rows.drop("_h1", "_h2")


# ---------------------------------------------------------------- tabs


def tab_filters() -> dict[str, dict[str, Column]]:
    """Row predicates of the 15 tabs, by tab and filter; dup_* come from `flagged`."""
    page = F.coalesce(C("content_type"), F.lit("text/html")).contains("html")
    s, title, desc, url = F.coalesce("status_code", F.lit(0)), _text("title"), _text("description"), _text("url")
    robots = F.lower(F.array_join(F.coalesce("robots", F.array()), ","))
    canonical, words = _first("canonicals"), F.coalesce("word_count", F.lit(0))
    secure = url.startswith("https://")
    next_, prev = _text("next"), _text("prev")
    langs = _size("hreflangs") > 0
    plain_http = F.exists(F.coalesce("css", F.array()), lambda u: u.startswith("http://")) | F.exists(F.coalesce("javascript", F.array()), lambda u: u.startswith("http://")) | _any("images", lambda i: i["url"].startswith("http://"))
    every = F.lit(True)

    def heading(c: str) -> dict[str, Column]:
        return {"all": every, "missing": page & (_first(c) == ""), "duplicate": page & C(f"dup_{c}"), "over70": page & (F.length(_first(c)) > 70), "multiple": page & (_size(c) > 1)}

    return {
        "pageTitles": {"all": every, "missing": page & (F.trim(title) == ""), "duplicate": page & C("dup_title"), "over60": page & (F.length(title) > 60), "below30": page & F.length(title).between(1, 29), "multiple": page & (C("titles") > 1), "sameAsH1": page & (F.trim(title) != "") & (F.trim(title) == F.trim(_first("h1")))},
        "metaDescription": {"all": every, "missing": page & (F.trim(desc) == ""), "duplicate": page & C("dup_description"), "over155": page & (F.length(desc) > 155), "below70": page & F.length(desc).between(1, 69)},
        "h1Tab": heading("h1"),
        "h2Tab": heading("h2"),
        "responseCodes": {"all": every, "noResponse": s == 0, "success": s.between(200, 299), "redirect": s.between(300, 399), "clientError": s.between(400, 499), "serverError": s >= 500},
        "canonicalsTab": {"all": every, "contains": page & (_size("canonicals") > 0), "self": page & same_url(canonical, url), "canonicalised": page & (canonical != "") & ~same_url(canonical, url), "missing": page & (_size("canonicals") == 0), "multiple": page & (_size("canonicals") > 1)},
        "directives": {"all": every, "index": robots.contains("index") & ~robots.contains("noindex"), "noindex": robots.contains("noindex"), "follow": robots.contains("follow") & ~robots.contains("nofollow"), "nofollow": robots.contains("nofollow"), "noarchive": robots.contains("noarchive"), "nosnippet": robots.contains("nosnippet"), "none": page & (robots == "")},
        "security": {"all": every, "http": url.startswith("http://"), "https": secure, "mixed": secure & plain_http},
        "contentTab": {"all": every, "lowWord": page & words.between(1, 299), "empty": page & (words == 0), "readability": (C("flesch") > 0) & (C("flesch") < 30)},
        "urlTab": {
            "all": every, "nonAscii": F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url).rlike(r"[^\x00-\x7F]"), "underscores": url.contains("_"), "uppercase": U.url_path(url).rlike("[A-Z]"),
            "multipleSlashes": url.rlike("(?<!:)//"), "params": url.contains("?"), "over115": F.length(url) > 115, "space": url.rlike(r"%20|\s"),
        },
        "hreflangTab": {"all": every, "contains": langs, "missing": page & ~langs, "noSelf": langs & ~_any("hreflangs", lambda h: (h["url"] != "") & (U.same_key(h["url"]) == U.same_key(url))), "noXDefault": langs & ~_any("hreflangs", lambda h: F.lower(h["lang"]) == "x-default")},
        "structuredData": {"all": every, "contains": ~_text("schema").isin("", "No"), "missing": page & _text("schema").isin("", "No")},
        "imagesTab": {"all": every, "missingAlt": _any("images", lambda i: F.trim(F.coalesce(i["alt"], F.lit(""))) == ""), "altOver100": _any("images", lambda i: F.length(F.coalesce(i["alt"], F.lit(""))) > 100)},
        "paginationTab": {"all": every, "contains": (next_ != "") | (prev != ""), "firstPage": (next_ != "") & (prev == ""), "lastPage": (prev != "") & (next_ == ""), "selfRef": same_url(C("next"), url) | same_url(C("prev"), url), "nonIndexable": ((next_ != "") | (prev != "")) & (F.coalesce("indexability", F.lit(0.5)) < 0.5)},
        "ampTab": {"all": every, "contains": _text("amp") != "", "missing": page & (_text("amp") == "")},
    }


def tab_counts(pages: DataFrame) -> DataFrame:
    """tab, filter, pages and percent of the tab's all, for every filter: one aggregate over all pages."""
    names = [(t, k, c) for t, fs in tab_filters().items() for k, c in fs.items()]
    one = flagged(pages).agg(F.count("*").alias("_all"), *[_n(F.coalesce(c, F.lit(False)), f"c{i}") for i, (_, _, c) in enumerate(names)])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("tab"), F.lit(k).alias("filter"), C(f"c{i}").alias("pages")) for i, (t, k, _) in enumerate(names)]))
    return one.select(rows.alias("r"), "_all").select("r.*", F.round(F.col("r.pages") * 100.0 / F.greatest("_all", F.lit(1)), 6).alias("percent"))


def filter_tab(pages: DataFrame, tab: str, key: str) -> DataFrame:
    return flagged(pages).filter(tab_filters()[tab][key]).drop("dup_title", "dup_description", "dup_h1", "dup_h2")


def content_tab(pages: DataFrame, key: str) -> DataFrame:
    """The rows of one of the content-type tabs: all, html, javascript, css, images, media, fonts, xml, pdf, other."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    test = F.lit(True) if key == "all" else ~kind.rlike("|".join(T.CONTENT_WORDS)) if key == "other" else kind.rlike(T.CONTENT_TABS[key])
    return pages.filter(test)


# ---------------------------------------------------------------- issues


def issue_conditions() -> dict[int, Column]:
    """Conditions of the row-local issues by id, over `flagged` pages."""
    s, title, desc, url = C("status_code"), F.length(_text("title")), F.length(_text("description")), _text("url")
    robots = F.lower(F.array_join(F.coalesce("robots", F.array()), ", "))
    slash = lambda c: F.regexp_replace(c, "/$", "")
    n = lambda c: F.coalesce(C(c), F.lit(0))
    return {
        1: title == 0, 2: desc == 0, 3: C("dup_title"), 4: title > 60, 5: title < 30, 6: C("dup_description"), 7: desc > 160, 8: s.between(400, 499), 9: s.between(500, 599),
        10: _size("h1") == 0, 11: _size("h2") == 0, 12: _size("h1") > 1, 13: _size("canonicals") == 0, 14: (_size("canonicals") > 0) & (slash(_first("canonicals")) != slash(url)), 15: robots.contains("noindex"), 16: robots.contains("nofollow"),
        17: _any("images", lambda i: F.coalesce(i["alt"], F.lit("")) == ""), 18: _any("images", lambda i: F.coalesce(i["broken"], F.lit(False))), 19: _any("images", lambda i: F.coalesce(i["size"], F.lit(0)) > 100 * 1024),
        20: C("response_time") > 2.0, 21: n("kb") > 100, 22: n("word_count") < 300, 23: ~url.startswith("https"), 24: n("redirect_count") > 2, 25: _text("schema") == "", 26: n("url_depth") >= 4,
        27: F.coalesce(F.size("opengraph"), F.lit(0)) < 1, 29: F.coalesce("had_redirect", F.lit(False)), 30: url.rlike("[A-Z]"), 31: F.length(url) > 100, 32: url.rlike(r"[_\s]"), 33: C("flesch") < 50, 34: C("text_ratio") < 10,
        35: _text("language") == "", 36: n("internal_links") > 150, 37: n("external_links") > 50, 38: n("css_inline") > 0, 39: n("mixed_content") > 0, 40: n("unsafe_anchors") > 0, 41: C("mobile") == F.lit(False), 42: n("cookies") > 0,
    }


def dup_h2(pages: DataFrame, key: str = "url") -> DataFrame:
    """url (or another key) of the pages with an H2 that is seen more than once, two on one page counted too."""
    h2 = pages.select(key, F.explode("h2").alias("h")).withColumn("h", F.trim("h")).filter("h <> ''")
    many = h2.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    return h2.join(many, "h").select(key).distinct()


def issues(pages: DataFrame, blocked: DataFrame | None = None, broken: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """A row for each page and issue that it has: id, name, priority, url.

    One scan serves the row-local issues; blocked (url) are addresses that robots rules keep out, broken (source_url) the pages
    with a link that leads nowhere. Pages that share an address are told apart by their key, where one is given; broken has it then.
    """
    label = F.create_map(*[x for i, (name, priority) in T.ISSUES.items() for x in (F.lit(i), F.struct(F.lit(name).alias("name"), F.lit(priority).alias("priority")))])
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(i)) for i, c in issue_conditions().items()]), lambda i: i.isNotNull())
    pages = flagged(pages)
    rows = pages.select("url", F.explode(found).alias("id"))
    of = lambda keys, i: pages.join(keys.distinct(), key or "url", "left_semi").select("url", F.lit(i).alias("id"))
    rows = rows.unionByName(of(dup_h2(pages, key), 43) if key else dup_h2(pages).withColumn("id", F.lit(43)))
    if blocked is not None:
        rows = rows.unionByName(blocked.select("url", F.lit(28).alias("id")))
    if broken is not None:
        rows = rows.unionByName(of(broken.select(key) if key else broken.select(C("source_url").alias("url")), 44))
    named = rows.withColumn("_l", F.element_at(label, C("id")))
    return named.select("id", "_l.name", "_l.priority", "url")


def issue_report(pages: DataFrame, blocked: DataFrame | None = None, broken: DataFrame | None = None, key: str | None = None) -> DataFrame:
    return issues(pages, blocked, broken, key).groupBy("id", "name", "priority").agg(F.count("*").alias("urls"))


# ---------------------------------------------------------------- summary


def _total(c: Column, name: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)


def crawl_summary(pages: DataFrame) -> DataFrame:
    """One row: 32 metrics of a crawl and total_links. Averages are cut to whole numbers."""
    s, n = F.coalesce("status_code", F.lit(0)), lambda c: F.coalesce(C(c), F.lit(0))
    filled = lambda c: F.when(_text(c) != "", C(c))
    whole = lambda c, name: F.floor(F.coalesce(F.avg(c), F.lit(0.0))).alias(name)
    return pages.agg(
        F.count("*").alias("pages"), _total(n("internal_links"), "total_internal_links"), _total(n("external_links"), "total_external_links"), _total(n("internal_links") + n("external_links"), "total_links"),
        _n(C("indexability") >= 0.5, "indexable_pages"), _n(C("indexability") < 0.5, "not_indexable_pages"), _n(s >= 400, "errors"), *[_n(s.between(a, a + 99), f"status_{a // 100}xx") for a in (200, 300, 400)], _n(s >= 500, "status_5xx"),
        _total(_size("css"), "total_css"), _total(_size("javascript"), "total_javascript"), _total(_size("images"), "total_images"), _n(F.coalesce("had_redirect", F.lit(False)), "total_redirects"),
        _n(_text("title") == "", "missing_title"), _n(_text("description") == "", "missing_description"), F.floor(F.coalesce(F.avg(F.coalesce("response_time", F.lit(0.0))), F.lit(0.0)) * 1000).alias("avg_response_time"), F.coalesce(F.max(n("url_depth")), F.lit(0)).cast("long").alias("max_crawl_depth"),
        _n(C("url").startswith("https://"), "total_secure_pages"), _n(_text("schema") != "", "total_schema_pages"), _n(F.coalesce("mobile", F.lit(False)), "total_mobile_pages"), _n(_size("h1") == 0, "missing_h1"), _n(_size("canonicals") == 0, "missing_canonical"),
        _n(n("word_count") < 300, "thin_content_pages"), _n(F.lower(F.array_join(F.coalesce("robots", F.array()), ",")).contains("noindex"), "noindex_pages"), _n(n("mixed_content") > 0, "mixed_content_pages"), _n(n("cookies") > 0, "cookies_pages"),
        whole(n("word_count"), "avg_word_count"), whole("flesch", "avg_readability"), whole(n("kb"), "avg_page_size_kb"),
        *[(F.count(filled(c)) - F.countDistinct(filled(c))).alias(f"duplicate_{c}s") for c in ("title", "description")],
    )


def health(summary: DataFrame) -> DataFrame:
    """Five pillars from 0 to 100 of a crawl summary, and their weighted mean, rounded; all 100 for a crawl without pages."""
    n = F.greatest(C("pages"), F.lit(1))
    r = lambda c: C(c) / n
    clamp = lambda c: F.when(C("pages") == 0, 100.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), c)), 6))
    readable = F.when(C("avg_readability") > 0, F.least(F.lit(100), C("avg_readability"))).otherwise(70)
    rows = summary.select(
        clamp(F.floor(r("indexable_pages") * 100 + 0.5).cast("double")).alias("indexability"),
        clamp(100 - r("status_5xx") * 400 - r("status_4xx") * 220 - r("errors") * 140).alias("http"),
        clamp(100 - r("missing_title") * 130 - r("missing_h1") * 60 - r("missing_description") * 55 - r("duplicate_titles") * 70 - r("duplicate_descriptions") * 40 - r("missing_canonical") * 30).alias("meta"),
        clamp(0.5 * (100 - r("thin_content_pages") * 130) + 0.25 * F.least(F.lit(100.0), C("avg_word_count") / 600 * 100) + 0.25 * readable).alias("content"),
        clamp(0.55 * r("total_secure_pages") * 100 + 0.45 * r("total_mobile_pages") * 100 - r("mixed_content_pages") * 90).alias("security"),
    )
    return rows.withColumn("overall", F.floor(F.round(C("indexability") * 0.2 + C("http") * 0.25 + C("meta") * 0.2 + C("content") * 0.15 + C("security") * 0.2, 6) + 0.5))


def overview_report(pages: DataFrame) -> DataFrame:
    """metric and value: the crawl overview as eleven rows; the average word count is rounded."""
    s, blank = F.coalesce("status_code", F.lit(0)), lambda c: F.trim(c) == ""
    index = F.coalesce("indexability", F.lit(0.5))
    metrics = {
        "Total URLs Crawled": F.count("*"), **{f"{name} ({a // 100}xx)": F.count_if(s.between(a, a + 99)) for name, a in (("Success", 200), ("Redirection", 300), ("Client Error", 400))}, "Server Error (5xx)": F.count_if(s >= 500),
        "Indexable": F.count_if(index >= 0.5), "Non-Indexable": F.count_if(index < 0.5), "Missing Title": F.count_if(blank(_text("title"))), "Missing Meta Description": F.count_if(blank(_text("description"))), "Missing H1": F.count_if(blank(_first("h1"))),
        "Average Word Count": F.floor(F.coalesce(F.avg(F.coalesce("word_count", F.lit(0))), F.lit(0.0)) + 0.5),
    }
    one = pages.agg(*[c.cast("long").alias(f"m{i}") for i, c in enumerate(metrics.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), C(f"m{i}").alias("value")) for i, x in enumerate(metrics)])).alias("r")).select("r.*")


# ---------------------------------------------------------------- assets, slices, reports


def assets(pages: DataFrame, kind: str) -> DataFrame:
    """Distinct images (by url, with alt and size of the smallest), scripts or stylesheets."""
    if kind == "images":
        rows = pages.select(F.explode("images").alias("i")).select("i.*")
        return rows.groupBy("url").agg(F.min("alt").alias("alt"), F.min("size").alias("size"))
    return pages.select(F.explode({"scripts": "javascript", "stylesheets": "css"}[kind]).alias("url")).distinct()


def page_slice(pages: DataFrame, kind: str) -> DataFrame:
    """One part of the pages that have it: hreflang (a row a language), schema, headings (a row a heading), inventory."""
    return {
        "hreflang": lambda: pages.select("url", F.explode("hreflangs").alias("h")).select("url", "h.lang", C("h.url").alias("href")),
        "schema": lambda: pages.filter(_text("schema") != "").select("url", "schema"),
        "headings": lambda: pages.select("url", F.explode(F.concat(F.transform(F.coalesce("h1", F.array()), lambda x: F.struct(F.lit("h1").alias("level"), x.alias("heading"))), F.transform(F.coalesce("h2", F.array()), lambda x: F.struct(F.lit("h2").alias("level"), x.alias("heading"))))).alias("h")).select("url", "h.*"),
        "inventory": lambda: pages.select("url", "status_code", "title", "word_count", _size("images").alias("images"), _size("css").alias("css"), _size("javascript").alias("javascript")),
    }[kind]()


def redirects(pages: DataFrame) -> DataFrame:
    """The pages that were redirected to, or that answer with a redirect."""
    return pages.filter(F.coalesce("had_redirect", F.lit(False)) | C("status_code").between(300, 399))


def insecure_content(pages: DataFrame) -> DataFrame:
    """A row for each HTTPS page and HTTP resource that it loads: url, kind, resource."""

    def of(kind: str, urls: Column) -> Column:
        return F.transform(F.coalesce(urls, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("resource")))

    found = F.concat(of("stylesheet", C("css")), of("script", C("javascript")), of("image", C("images.url")))
    rows = pages.filter(C("url").startswith("https://")).select("url", F.explode(found).alias("r")).select("url", "r.*")
    return rows.filter(C("resource").startswith("http://")).distinct()


def canonical_errors(pages: DataFrame) -> DataFrame:
    """url and error: missing, elsewhere, multiple; a page can have two."""
    url = _text("url")
    kinds = [("missing", _size("canonicals") == 0), ("elsewhere", (_first("canonicals") != "") & ~same_url(_first("canonicals"), url)), ("multiple", _size("canonicals") > 1)]
    return pages.select("url", F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in kinds]), lambda k: k.isNotNull())).alias("error"))


def resource_indexability(rows: DataFrame) -> DataFrame:
    """Resources (url, status_code, content_type) with indexability and reason: a PDF that answers is indexable, by its type or else its path."""
    kind, ok = F.coalesce("content_type", F.lit("")), C("status_code").between(200, 299) & (C("status_code") != 204)
    pdf = (F.lower(F.trim(F.split_part(kind, F.lit(";"), F.lit(1)))) == "application/pdf") | U.url_path(F.lower("url")).endswith(".pdf")
    reason = F.when(~ok, F.concat(F.lit("Not indexable: HTTP status "), C("status_code").cast("string"))).when(pdf, "Indexable: PDF document").otherwise(F.concat(F.lit("Not indexable: non-HTML content ("), kind, F.lit(")")))
    return rows.withColumns({"indexability": F.when(ok & pdf, 1.0).otherwise(0.0), "reason": reason})


def light_pages(pages: DataFrame) -> DataFrame:
    """Pages with long texts cut: titles and headings at 200 characters, descriptions at 500, ten headings a level."""
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)
    few = lambda c: F.transform(F.slice(c, 1, 10), lambda x: cut(x, 200))
    return pages.withColumns({"title": cut(C("title"), 200), "description": cut(C("description"), 500), "h1": few("h1"), "h2": few("h2"), "opengraph": F.transform_values("opengraph", lambda _, v: cut(v, 1000))})


def search_pages(pages: DataFrame, term: str) -> DataFrame:
    """Pages of which any column has the term, whatever its case, in its text as JSON."""
    return pages.filter(F.lower(F.to_json(F.struct(*pages.columns))).contains(term.lower()))


def url_filter(pages: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Pages whose url no exclude pattern matches, and some include pattern where there is one; patterns that aren't valid are ignored."""
    import re

    def valid(patterns: list[str]) -> list[str]:
        out = []
        for p in patterns:
            try:
                re.compile(p)
                out.append(p)
            except re.error:
                continue
        return out

    keep, drop = F.lit(not valid(include)), F.lit(False)
    for p in valid(include):
        keep = keep | C("url").rlike(p)
    for p in valid(exclude):
        drop = drop | C("url").rlike(p)
    return pages.filter(keep & ~drop)


def is_html(body: Column, content_type: Column) -> Column:
    """Whether a body of ten bytes or more is a page: its header says so, or it has a structural tag."""
    said = F.lower(F.coalesce(content_type, F.lit(""))).rlike("text/html|application/xhtml[+]xml|application/xml|text/xml|text/plain")
    return (F.octet_length(F.coalesce(body, F.lit(""))) >= 10) & (said | F.lower(body).rlike("<html|<body|<div|<p|<a |<script|<title|<!doctype html"))


def frontier(links: DataFrame, visited: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """url: addresses of links that are worth fetching, that the filters let through, robots rules don't block and nobody has fetched."""
    found = links.select(U.norm_url(C("url")).alias("url")).distinct()
    found = url_filter(found.filter(~U.should_skip(C("url")) & C("url").rlike("^https?://")), include or [], exclude or [])
    if blocked is not None:
        found = found.join(blocked.select("url"), "url", "left_anti")
    return found.join(visited.select(U.norm_url(C("url")).alias("url")), "url", "left_anti")


def heading_duplicates(pages: DataFrame) -> DataFrame:
    """hash, pages and the smallest url of each set of headings (h1, h2, lower case, letters and digits) that two pages or more share."""
    words = F.trim(F.regexp_replace(F.lower(F.array_join(F.concat(F.coalesce("h1", F.array()), F.coalesce("h2", F.array())), " ")), r"[^\p{L}\p{N}]+", " "))
    rows = pages.select("url", words.alias("w")).filter("w <> ''")
    return rows.groupBy(F.md5("w").alias("hash")).agg(F.count("*").alias("pages"), F.min("url").alias("first_url")).filter("pages > 1").withColumn("similarity", F.lit(100))


# ---------------------------------------------------------------- fetching: challenges, redirects

#: What an anti-bot page says, and its name; all needles of an entry must be there.
CHALLENGES = [
    (["error 1015"], "Cloudflare error 1015"),
    (["error 1020"], "Cloudflare error 1020"),
    (["challenge-form"], "challenge form"),
    (["cloudflare", "ray id"], "Cloudflare Ray ID block"),
    (["distilnetworks"], "Distil Networks block"),
    (["please enable js"], "JavaScript anti-bot challenge"),
]
SHORT_CHALLENGES = [
    (["access denied"], "access denied"),
    (["too many requests"], "rate limit"),
    (["rate limit"], "rate limit"),
    (["one more step"], "one more step challenge"),
    (["unusual traffic"], "unusual traffic challenge"),
    (["bot detection"], "bot detection challenge"),
]


def challenge_reason(html: Column) -> Column:
    """What an anti-bot page of under 25,000 bytes calls itself, or one of under 2,000 bytes by more words; null for other pages."""
    low, size, out = F.lower(html), F.octet_length(html), None
    for limit, known in ((25_000, CHALLENGES), (2_000, SHORT_CHALLENGES)):
        for needles, name in known:
            found = size < limit
            for x in needles:
                found = found & low.contains(x)
            out = F.when(found, name) if out is None else out.when(found, name)
    return out


def mark_challenges(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with crawl_error; a suspected challenge that was answered with 200 isn't indexable."""
    why = challenge_reason(C(html))
    hit = why.isNotNull() & (C("status_code") == 200)
    return pages.withColumns({"crawl_error": F.when(hit, why), "indexability": F.when(hit, 0.0).otherwise(C("indexability")), "reason": F.when(hit, "Not indexable: suspected anti-bot challenge returned HTTP 200").otherwise(C("reason"))})


def redirect_rows(pages: DataFrame) -> DataFrame:
    """A row for each 3xx hop in redirect_chain (url, status_code, location) whose address isn't the page's own: such hops are pages too."""
    hops = F.filter("redirect_chain", lambda h: h["status_code"].between(300, 399))
    rows = pages.select(C("url").alias("final_url"), "url_depth", F.size(hops).alias("redirect_count"), F.explode(hops).alias("h")).filter(U.norm_url(C("h.url")) != U.norm_url(C("final_url")))
    status = C("h.status_code").cast("string")
    return rows.select("h.url", "final_url", "url_depth", "h.status_code", C("h.location").alias("redirect_url"), "redirect_count", F.lit(True).alias("had_redirect"), F.concat(status, F.lit(" Redirect")).alias("redirection_type"), F.lit(0.0).alias("indexability"), F.concat(F.lit("Not indexable: HTTP redirect "), status).alias("reason"))


def search_hits(pages: DataFrame, rules: str = "custom_search") -> DataFrame:
    """rule and pages: how many pages each search rule (name, matched) matched; the rule null counts pages that any did."""
    hits = pages.select("url", F.array_distinct(F.transform(F.filter(rules, lambda r: r["matched"]), lambda r: r["name"])).alias("names")).filter(F.size("names") > 0)
    each = hits.select(F.explode("names").alias("rule")).groupBy("rule").agg(F.count("*").alias("pages"))
    return each.unionByName(hits.agg(F.count("*").alias("pages")).select(F.lit(None).cast("string").alias("rule"), "pages"))


# ---------------------------------------------------------------- order of cells


def cell_order(cell: Column, descending: bool = False) -> list[Column]:
    """Sort columns of a table's cell: numbers (without units and separators) by value, texts by their words with digit runs as numbers
    and whatever their case and accents, numbers before texts; blanks last in both directions. Add what breaks ties."""
    bare = F.regexp_replace(F.regexp_replace(cell.cast("string"), r"[\s,]", ""), "(?i)(KB|MB|B|%|ms|s)$", "")
    number = F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))
    padded = F.regexp_replace(F.regexp_replace(cell.cast("string"), r"(\d+)", "00000000000000000000$1"), r"0*(\d{20,})(?!\d)", "$1")
    blank = F.coalesce(cell.cast("string"), F.lit("")) == ""
    text = F.collate(F.when(number.isNull(), padded), "UNICODE_CI_AI")
    if descending:
        return [blank.asc(), number.isNull().desc(), text.desc_nulls_last(), number.desc_nulls_last()]
    return [blank.asc(), number.isNull().asc(), number.asc_nulls_last(), text.asc_nulls_last()]
