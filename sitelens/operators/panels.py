"""Breakdown panels of a crawl, and its overview tree.

Pages have the columns of `audit.WIDE`; panels that need more say so. Panels of counts share one scan; those of distinct values group
by the value first, so that a title on a third of the pages is one partial sum a task. Percentages are whole numbers, halves rounded up;
a panel's percentage is 0 where there is nothing to divide by, and null where it has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audit import _first, _size, _text, flagged, tab_filters
from .tables import materialized

C = F.col

#: Columns that the panels read beside `audit.WIDE`.
MORE = (
    "css_external int, iframes array<string>, inline_scripts array<string>, unsandboxed_iframes int, risky_scripts int, link_score double, reason string, performance_score double, accessibility_score double, "
    "best_practices_score double, seo_score double, redirect_chain array<struct<url:string,status_code:int>>"
)


def percent(part: Column, whole: Column) -> Column:
    """part of whole as a whole percentage, by integers; 0 of nothing."""
    p, w = part.cast("long"), whole.cast("long")
    return F.when(w > 0, F.floor((p * 200 + w) / F.greatest(w * 2, F.lit(1)))).otherwise(F.lit(0)).cast("long")


def _count(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def _mean(c: Column) -> Column:
    """Mean to the next whole number; null without values."""
    return F.floor(F.avg(c) + 0.5)


def _panels() -> dict[str, list[tuple[str, Column, Column | None]]]:
    """(label, aggregate, aggregate that it is a part of) of every panel of counts."""
    n = lambda c: F.coalesce(C(c), F.lit(0))
    pages, s, url, words = F.count("*"), F.coalesce("status_code", F.lit(0)), _text("url"), F.coalesce("word_count", F.lit(0))
    robots = F.lower(F.array_join(F.coalesce("robots", F.array()), ", "))
    noindex, nofollow = robots.contains("noindex"), robots.contains("nofollow")
    canonical, has_og = _first("canonicals"), F.coalesce(F.size("opengraph"), F.lit(0)) > 0
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)
    ms, flesch, kb, score, fast = C("response_time") * 1000, C("flesch"), C("kb"), C("link_score"), C("performance_score") * 100
    hops = F.coalesce(F.size("redirect_chain"), F.lit(0))
    moved = s.between(300, 399) | F.coalesce("had_redirect", F.lit(False))
    first_hop = F.coalesce(F.try_element_at("redirect_chain", F.lit(1))["status_code"], s)
    chain = (n("redirect_count") > 1) | (hops > 2)
    single = ~chain & ((n("redirect_count") == 1) | (hops == 2) | F.coalesce("had_redirect", F.lit(False)))
    alts = lambda c, test: F.size(F.filter(F.coalesce(c, F.array()), test))
    no_alt = lambda i: F.coalesce(i["alt"], F.lit("")) == ""
    parts = F.filter(F.split(url, "/"), lambda p: p != "")
    answered, addresses = _count(s.between(200, 599) | (s > 599)), _count(url != "")
    og = lambda tag: _count(has_og & (F.coalesce(F.try_element_at("opengraph", F.lit(tag)), F.lit("")) != ""))
    inside, outside = _sum(n("internal_links")), _sum(n("external_links"))
    good = F.coalesce("indexability", F.lit(0.0))
    all_pages = ("Total Pages", pages, pages)
    return {
        "canonicals": [all_pages, ("With Canonical", _count(_size("canonicals") > 0), pages), ("Without Canonical", _count(_size("canonicals") == 0), pages), ("Self-Referencing", _count((_size("canonicals") > 0) & (canonical == url)), pages), ("External Canonical", _count((canonical != "") & (canonical != url) & ~canonical.contains(host)), pages)],
        "cookies": [all_pages, ("With Cookies", _count(n("cookies") > 0), pages), ("Without Cookies", _count(n("cookies") <= 0), pages), ("Avg. Cookies / Page", F.floor(F.avg(n("cookies")) * 10 + 0.5) / 10, None), ("Total Cookies Found", _sum(n("cookies")), None)],
        "css": [("External CSS", _sum(n("css_external")), None), ("Internal CSS", _sum(n("css_inline")), None)],
        "iframes": [("Iframes Found", _sum(_size("iframes")), None)],
        "images": [("Total Images", _sum(_size("images")), None), ("Images with Alt Tags", _sum(alts("images", lambda i: ~no_alt(i))), None), ("Images without Alt Tags", _sum(alts("images", no_alt)), None)],
        "linkScore": [("Average Link Score", _mean(score), None), ("Strong (70-100)", _count(score >= 70), F.count(score)), ("Moderate (40-69)", _count((score >= 40) & (score < 70)), F.count(score)), ("Weak (1-39)", _count((score != 0) & (score < 40)), F.count(score)), ("Orphaned (0 Score)", _count(score == 0), F.count(score))],
        "metaRobots": [("No Meta Robots Tag", _count(robots == ""), pages), ("Index, Follow", _count((robots != "") & ~noindex & ~nofollow), pages), ("Noindex", _count(noindex & ~nofollow), pages), ("Nofollow", _count(nofollow & ~noindex), pages), ("Noindex, Nofollow", _count(noindex & nofollow), pages)],
        "mobile": [all_pages, ("Mobile Friendly", _count(C("mobile")), pages), ("Not Mobile Friendly", _count(~C("mobile")), pages), ("Unknown", _count(C("mobile").isNull()), pages)],
        "openGraph": [all_pages, ("With OpenGraph", _count(has_og), pages), ("Without OpenGraph", _count(~has_og), pages), *[(f"Has {t}", og(t), pages) for t in ("og:title", "og:description", "og:image", "og:url", "og:type")]],
        "pageWeight": [("Average Page Size", _mean(kb), None), ("Light (< 100 KB)", _count(kb < 100), F.count(kb)), ("Medium (100-500 KB)", _count((kb >= 100) & (kb < 500)), F.count(kb)), ("Heavy (500 KB-1 MB)", _count((kb >= 500) & (kb < 1024)), F.count(kb)), ("Very Heavy (> 1 MB)", _count(kb >= 1024), F.count(kb))],
        "performance": [("Performance Score", _mean(fast), None), ("Accessibility Score", _mean(C("accessibility_score") * 100), None), ("Best Practices", _mean(C("best_practices_score") * 100), None), ("SEO Score", _mean(C("seo_score") * 100), None), ("Good (90-100)", _count(fast >= 90), F.count(fast)), ("Needs Improvement", _count((fast >= 50) & (fast < 90)), F.count(fast)), ("Poor (0-49)", _count(fast < 50), F.count(fast))],
        "readability": [("Average Reading Ease", _mean(flesch), None), ("Easy to Read (70-100)", _count(flesch >= 70), F.count(flesch)), ("Standard (50-69)", _count((flesch >= 50) & (flesch < 70)), F.count(flesch)), ("Difficult (0-49)", _count(flesch < 50), F.count(flesch)), ("Low Text-to-HTML Ratio (<10%)", _count(C("text_ratio") < 10), F.count("text_ratio"))],
        "redirects": [all_pages, ("Total Redirects", _count(moved), pages), ("Permanent (301/308)", _count(moved & first_hop.isin(301, 308)), pages), ("Temporary (302/303/307)", _count(moved & first_hop.isin(302, 303, 307)), pages), ("Single Redirects", _count(moved & single), pages), ("Redirect Chains", _count(moved & chain), pages)],
        "responseTime": [("Average Response Time", F.coalesce(_mean(ms), F.lit(0)), None), ("Fast (< 200ms)", _count(ms < 200), pages), ("Average (200ms-1s)", _count((ms >= 200) & (ms <= 1000)), pages), ("Slow (> 1s)", _count(ms > 1000), pages)],
        "schema": [("Total Schemas Found", _count(_text("schema") != ""), None), ("Pages With Schema", _count(_text("schema") != ""), None), ("Pages Missing Schema", _count(_text("schema") == ""), None)],
        "security": [("HTTPS URLs", _count(url.startswith("https://")), pages), ("HTTP URLs", _count(url.startswith("http://")), pages), ("Mixed Content", _count(n("mixed_content") > 0), _count(url.startswith("https://"))), ("Unsafe Anchors", _sum(n("unsafe_anchors")), pages), ("Insecure Iframes", _sum(n("unsandboxed_iframes")), pages), ("Inline Scripts", _sum(n("risky_scripts")), pages)],
        "statusCodes": [("Total", answered, answered), *[(f"{k} {name}", _count(s.between(a, b)), answered) for k, name, a, b in (("2xx", "Success", 200, 299), ("3xx", "Redirection", 300, 399), ("4xx", "Client Error", 400, 499), ("5xx", "Server Error", 500, 2**31 - 1))]],
        "summary": [("Pages crawled", pages, pages), ("Total Links Found", inside + outside, inside + outside), ("Total Internal Links", inside, inside + outside), ("Total External Links", outside, inside + outside), ("Total Indexable Pages", _count(good > 0.5), pages), ("Total Not Indexable Pages", pages - _count(good > 0.5), pages)],
        "urlInfo": [
            ("Total", addresses, addresses), ("Non ASCII Characters", _count(url.rlike(r"[^\x00-\x7F]")), addresses), ("Underscores", _count(url.contains("_")), addresses), ("Uppercase", _count(url.rlike("[A-Z]")), addresses), ("Multiple Slashes", _count(F.regexp_replace(url, "^https?://", "").contains("//")), addresses),
            ("Repetitive Path", _count(F.size(F.array_distinct(parts)) != F.size(parts)), addresses), ("Contains Space", _count(url.rlike(r"\s|%20")), addresses), ("Internal Search", _count(url.rlike(r"search\?|q=|\?.*=")), addresses), ("Parameters", _count(url.contains("?")), addresses), ("Over 115 Characters", _count(F.length(url) > 115), addresses),
        ],
        "wordCount": [all_pages, ("No Content (0)", _count(words == 0), pages), ("Very Short (1-100)", _count((words != 0) & (words <= 100)), pages), *[(label, _count((words > a) & (words <= b)), pages) for label, a, b in (("Short (101-300)", 100, 300), ("Medium (301-600)", 300, 600), ("Long (601-1000)", 600, 1000))], ("Very Long (1000+)", _count(words > 1000), pages)],
    }


def _as_rows(one: DataFrame, entries: list[tuple[str, str, Column, Column | None]]) -> DataFrame:
    """A row an entry (panel, label, value, whole) of a table of one row; the percentage is 100 at most."""
    cells = [F.struct(F.lit(p).alias("panel"), F.lit(k).alias("label"), v.cast("double").alias("value"), (F.lit(None) if w is None else F.least(F.lit(100), percent(v, w))).cast("long").alias("percent")) for p, k, v, w in entries]
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def counted(pages: DataFrame, panels: list[str] | None = None) -> DataFrame:
    """panel, label, value, percent of the panels of counts (all, or those named): one aggregate over all pages."""
    found = [(p, k, v, w) for p, entries in _panels().items() if panels is None or p in panels for k, v, w in entries]
    one = pages.agg(*[c.alias(f"{name}{i}") for i, (_, _, v, w) in enumerate(found) for name, c in (("v", v), ("w", F.lit(0) if w is None else w))])
    return _as_rows(one, [(p, k, C(f"v{i}"), None if w is None else C(f"w{i}")) for i, (p, k, _, w) in enumerate(found)])


def _values(pages: DataFrame, column: Column, many: bool) -> DataFrame:
    """v, n and pages: how often a value is seen, and how many pages have it as their first or only one. Null stands for no value."""
    rows = pages.select(F.posexplode_outer(column).alias("i", "v")) if many else pages.select(F.lit(0).alias("i"), column.alias("v"))
    return rows.groupBy("v").agg(F.count("*").alias("n"), F.count_if(F.coalesce("i", F.lit(0)) == 0).alias("pages"))


def headings(pages: DataFrame, level: str) -> DataFrame:
    """The panel of h1 or h2: filled ones, how far their number is from that of the pages, repeats and blanks, distinct ones by length."""
    filled = F.coalesce(F.trim("v") != "", F.lit(False))
    one = _values(pages, C(level), True).agg(_sum("pages").alias("pages"), _sum(F.when(C("v").isNotNull(), C("n"))).alias("every"), _sum(F.when(filled, C("n"))).alias("filled"), _count(filled).alias("own"), _count(filled & (F.length("v") > 155)).alias("long"), _count(filled & (F.length("v") < 70)).alias("short"))
    name = level.upper()
    return _as_rows(one, [(level, "Total", C("filled"), C("pages")), (level, "Missing", F.abs(C("pages") - C("filled")), C("pages")), (level, f"Duplicate {name} Headings", C("every") - C("own"), C("every")), (level, "Over 155 Characters", C("long"), C("every")), (level, "Below 70 Characters", C("short"), C("every"))])


def page_texts(pages: DataFrame, kind: str) -> DataFrame:
    """The panel of titles or descriptions: lengths of distinct values, of which no value and the empty one are two."""
    long, short = {"titles": (60, 30), "descriptions": (155, 70)}[kind]
    one = _values(pages, C(kind[:-1]), False).agg(_sum("n").alias("pages"), F.count("*").alias("own"), _count(F.coalesce("v", F.lit("")) == "").alias("empty"), _count(F.length("v") > long).alias("long"), _count(F.length("v") < short).alias("short"))
    if kind == "titles":
        return _as_rows(one, [(kind, "All", C("pages"), None), (kind, "Over 60 Characters", C("long"), None), (kind, "Missing Page Title", C("empty"), None), (kind, "Below 30 Characters", C("short"), None)])
    return _as_rows(one, [(kind, "Total Description", C("pages"), C("pages")), (kind, "Empty Description", C("empty"), C("pages")), (kind, "Duplicate Description", C("pages") - C("own"), C("pages")), (kind, "Over 155 Characters", C("long"), C("pages")), (kind, "Below 70 Characters", C("short"), C("pages"))])


def scripts(pages: DataFrame) -> DataFrame:
    """Distinct scripts of all pages, by address and by text."""
    kinds = [pages.select(F.explode(c).alias("v")).filter("v is not null").select(F.lit(k).alias("k"), F.sha2("v", 256).alias("v")) for k, c in (("External Scripts", "javascript"), ("Inline Scripts", "inline_scripts"))]
    one = kinds[0].unionByName(kinds[1]).distinct().agg(*[_count(C("k") == k).alias(f"v{i}") for i, k in enumerate(("External Scripts", "Inline Scripts"))])
    return _as_rows(one, [("javascript", "External Scripts", C("v0"), None), ("javascript", "Inline Scripts", C("v1"), None)])


def shares(pages: DataFrame, panel: str) -> DataFrame:
    """Panels that have a row a value of the pages: crawlDepth, language (ten most frequent, then those without), indexing (with its eight most frequent reasons)."""
    good = F.coalesce("indexability", F.lit(0.0)) >= 0.5
    value = {"crawlDepth": F.coalesce("url_depth", F.lit(0)), "language": F.when(_text("language") != "", C("language")), "indexing": F.when(_text("reason") == "", "Unknown").otherwise(C("reason"))}[panel]
    # the only scan of the pages
    cells = materialized(pages.groupBy(value.alias("v"), (good if panel == "indexing" else F.lit(True)).alias("good")).agg(F.count("*").alias("n")), "shares")
    of = lambda c: F.coalesce(F.sum(F.when(c, C("n"))), F.lit(0))
    one = cells.agg(of(C("good")).alias("yes"), of(~C("good")).alias("no"), of(F.lit(True)).alias("all"))
    known, total = cells.groupBy("v").agg(F.sum("n").alias("n")), one.select("all").scalar()
    sized = lambda df, label: df.select(F.lit(panel).alias("panel"), label.alias("label"), C("n").cast("double").alias("value"), percent(C("n"), total).alias("percent"))
    if panel == "crawlDepth":
        return sized(known, F.when(C("v") == 0, "Homepage (Level 0)").otherwise(F.concat(F.lit("Level "), C("v").cast("string"))))
    if panel == "language":
        top = sized(known.filter("v is not null").orderBy(F.desc("n"), "v").limit(10), F.upper("v"))
        return _as_rows(one, [(panel, "Total Pages", C("all"), C("all"))]).unionByName(top).unionByName(sized(known.filter("v is null"), F.lit("No Language")))
    reasons = known.orderBy(F.desc("n"), "v").limit(8)
    return _as_rows(one, [(panel, "Indexable", C("yes"), C("all")), (panel, "Non-Indexable", C("no"), C("all"))]).unionByName(sized(reasons, C("v")))


#: Every panel by name; custom search has `audit.search_hits`.
NAMES = ["canonicals", "cookies", "css", "iframes", "images", "linkScore", "metaRobots", "mobile", "openGraph", "pageWeight", "performance", "readability", "redirects", "responseTime", "schema", "security", "statusCodes", "summary", "urlInfo", "wordCount", "h1", "h2", "titles", "descriptions", "javascript", "crawlDepth", "language", "indexing"]


def breakdown(pages: DataFrame, panel: str) -> DataFrame:
    """panel, label, value, percent of one panel."""
    if panel not in NAMES:
        raise ValueError(f"no panel {panel!r}")
    if panel in ("h1", "h2"):
        return headings(pages, panel)
    if panel in ("titles", "descriptions"):
        return page_texts(pages, panel)
    if panel == "javascript":
        return scripts(pages)
    return shares(pages, panel) if panel in ("crawlDepth", "language", "indexing") else counted(pages, [panel])


# ---------------------------------------------------------------- overview tree

#: Elements of the overview in their order, and their filters after "all".
OVERVIEW = {
    "internal": ["html", "javascript", "css", "images", "media", "fonts", "xml", "pdf", "other"],
    "security": ["http", "https"],
    "responseCodes": ["noResponse", "success", "redirect", "clientError", "serverError"],
    "urlTab": ["nonAscii", "underscores", "params", "over115"],
    "pageTitles": ["missing", "duplicate", "over60", "below30"],
    "metaDescription": ["missing", "duplicate", "over155", "below70"],
    "h1Tab": ["missing", "duplicate", "over70", "multiple"],
    "h2Tab": ["missing", "duplicate", "multiple"],
    "contentTab": ["lowWord", "empty"],
    "canonicalsTab": ["contains", "missing", "multiple"],
    "directives": ["noindex", "nofollow", "none"],
    "hreflangTab": ["contains", "missing"],
    "structuredData": ["contains", "missing"],
}
#: Elements whose "all" are all rows; that of the others are the pages of html.
OF_ALL = ("internal", "security", "responseCodes", "urlTab")


def overview(rows: DataFrame) -> DataFrame:
    """element, filter, urls and percent: five summary rows, then each element's filters as parts of its own "all".

    Rows are pages and assets (is_asset; null and a missing column are pages); assets aren't html whatever their type, and count as crawled
    once they have a status. One aggregate after the four joins that say which values are shared; percent is null where "all" is 0.
    """
    rows = rows if "is_asset" in rows.columns else rows.withColumn("is_asset", F.lit(False))
    kind, asset = F.lower(_text("content_type")), F.coalesce("is_asset", F.lit(False))
    html = ~asset & (kind.contains("html") | (kind == ""))
    types = {k: kind.contains(k[:-1] if k == "fonts" else k) for k in OVERVIEW["internal"]}
    types |= {"images": kind.startswith("image"), "media": kind.startswith("video") | kind.startswith("audio")}
    types["other"] = ~kind.rlike("html|javascript|css|image|video|audio|font|xml|pdf")
    # Texts are shared among html pages only, so those of other rows go before they are compared; the tabs tell html by its content type.
    typed = {f"_type_{k}": c for k, c in types.items()} | {"_html": html, "_crawled": ~asset | (F.coalesce("status_code", F.lit(0)) > 0)}
    shown = {c: F.when(C("_html"), C(c)) for c in ("title", "description", "h1", "h2")} | {"content_type": F.when(C("_html"), "text/html").otherwise("")}
    tabs, every, index = tab_filters(), F.count("*"), F.coalesce("indexability", F.lit(0.5)) >= 0.5
    cells = [("summary", k, c, every) for k, c in (("encountered", every), ("crawled", _count(C("_crawled"))), ("internal", every), ("indexable", _count(C("_html") & index)), ("nonIndexable", _count(C("_html") & ~index)))]
    for element, filters in OVERVIEW.items():
        whole = every if element in OF_ALL else _count(C("_html"))
        cells.append((element, "all", whole, whole))
        cells += [(element, f, _count(C(f"_type_{f}") if element == "internal" else tabs[element][f]), whole) for f in filters]
    one = flagged(rows.withColumns(typed).withColumns(shown)).agg(*[x.alias(f"{n}{i}") for i, (_, _, v, w) in enumerate(cells) for n, x in (("v", v), ("w", w))])
    found = [F.struct(F.lit(e).alias("element"), F.lit(f).alias("filter"), C(f"v{i}").alias("urls"), F.when(C(f"w{i}") > 0, F.round(C(f"v{i}") * 100.0 / C(f"w{i}"), 6)).alias("percent")) for i, (e, f, _, _) in enumerate(cells)]
    return one.select(F.explode(F.array(*found)).alias("r")).select("r.*")
