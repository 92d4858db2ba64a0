"""Column functions of access-log fields. Those that look through a list of names (detect_bot, ua_category, referer_category) cost as much as
the list is long, so apply them to distinct values, as operators.logs does."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T


def _first(cases, otherwise) -> Column:
    """The value of the first condition that holds."""
    return reduce(lambda acc, c: F.when(c[0], c[1]) if acc is None else acc.when(*c), cases, None).otherwise(otherwise)


def _any(c: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def _token(ua: Column, keyword: str) -> Column:
    """The token of the user agent around the first occurrence of a keyword."""
    return F.regexp_extract(ua, rf"(?i)[\p{{L}}\p{{N}}/]*?{keyword}[^ ;)\"]*", 0)


def _listed(low: Column, table) -> Column:
    """The name of the first (substring, name) that is contained, or null. The table is one literal, so generated code stays small."""
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(name).alias("name")) for k, name in table])
    return F.try_element_at(F.filter(rows, lambda r: F.contains(low, r["k"])), F.lit(1))["name"]


def detect_bot(ua: Column) -> Column:
    """Crawler name; 'Human' if there is none. Null counts as no user agent."""
    low = F.lower(ua)
    blank = ua.isNull() | F.trim(ua).isin("-", "")
    word = F.try_element_at(F.filter(F.array(*map(F.lit, T.GENERIC_BOTS)), lambda k: F.contains(low, k)), F.lit(1))
    token = F.regexp_substr(ua, F.concat(F.lit(r"(?i)[\p{L}\p{N}/]*?"), word, F.lit(r"[^ ;)\"]*")))
    return F.when(blank, "No User Agent").otherwise(F.coalesce(_listed(low, T.BOTS), token, F.lit("Human")))


def browser(ua: Column) -> Column:
    """Browser name: the token around the first known browser, up to its slash; 'Other' if there is none."""
    low = F.lower(ua)
    return _first([(low.contains(k), F.split_part(_token(ua, k), F.lit("/"), F.lit(1))) for k in T.BROWSERS], F.lit("Other"))


def file_type(path: Column) -> Column:
    low = F.lower(path)
    ends = lambda e: reduce(lambda a, b: a | b, [low.endswith(x) for x in e])
    return _first([(ends(e) | ~low.contains(".") if kind == "HTML" else ends(e), F.lit(kind)) for kind, e in T.FILE_TYPES], F.lit("Unknown"))


def country(ip: Column) -> Column:
    first = F.split_part(ip, F.lit("."), F.lit(1))
    return _first([(ip.contains(":"), F.lit("Unknown (IPv6)")), (first.isin("66", "165", "200"), F.lit("US")), (first == "163", F.lit("NL"))], F.lit("Unknown"))


def is_crawler(crawler_type: Column) -> Column:
    return crawler_type != "Human"


def status_class(status: Column) -> Column:
    return _first([((status >= i * 100) & (status < i * 100 + 100), F.lit(f"{i}xx")) for i in (2, 3, 4, 5)], F.lit("other"))


def norm_path(c: Column) -> Column:
    """Trimmed, lower-case path: no scheme, host, query or fragment, a leading slash, no trailing ones, // once to /."""
    x = F.lower(F.trim(c))
    x = F.regexp_replace(x, r"^[a-z][a-z0-9+.-]*://[^/?#]*", "")
    x = F.regexp_replace(x, r"[?#].*$", "")
    x = F.when(x.startswith("/"), x).otherwise(F.concat(F.lit("/"), x))
    x = F.when(x.rlike("^/+$"), F.lit("/")).otherwise(F.regexp_replace(x, r"/+$", ""))
    return F.replace(x, F.lit("//"), F.lit("/"))


def referer_category(referer: Column) -> Column:
    low = F.lower(referer)
    known = _listed(low, [*T.REFERERS, *[(p, "Local/Internal") for p in T.LOCAL_REFERERS]])
    return F.when(referer.isNull() | referer.isin("", "-"), "Direct/None").otherwise(F.coalesce(known, F.lit("Other")))


def ua_category(ua: Column) -> Column:
    low = F.lower(ua)
    has = low.contains
    phone = has("iphone") | has("ipad")
    small = has("mobile") | phone
    named = _listed(low, [*T.UA_BOTS, *[(p, "Other Bots") for p in T.UA_ANY_BOT], *T.UA_TOOLS])
    word = _listed(low, [(w, w) for w in ("chrome", "firefox", "safari")])
    mobile = F.when(word == "safari", small).otherwise(has("mobile"))
    browsing = F.concat(F.initcap(word), F.when(mobile, " Mobile").otherwise(""))
    rest = _listed(low, [("edge", "Microsoft Edge"), ("opera", "Opera"), ("trident", "Internet Explorer"), ("msie", "Internet Explorer"), ("android", "Android Browser"), ("iphone", "iOS Browser"), ("ipad", "iOS Browser"), ("ipod", "iOS Browser"), ("windows", "Windows"), ("mac os", "macOS"), ("linux", "Linux")])
    return F.when(ua.isNull() | ua.isin("", "-", "Unknown"), "Unknown/Empty").otherwise(F.coalesce(named, browsing, rest, F.lit("Other")))


def bot_families(crawler_type: Column, ua: Column) -> dict[str, Column]:
    """Membership of each crawler family, as non-null booleans."""
    ct, low = F.lower(crawler_type), F.lower(F.coalesce(ua, F.lit("")))
    plain = {k: ct.contains(k) for k in ("google", "bing", "semrush", "ahrefs", "moz", "uptime")}
    return plain | {"openai": _any(ct, ["openai", "gpt"]) | _any(low, ["chatgpt", "gptbot", "oai-"]), "claude": ct.contains("claude") | low.contains("claude")}


def bot_group(crawler_type: Column) -> Column:
    """The AI groups (indexing, retrieval, agentic) that a crawler name is in, by lower-cased name."""
    ct = F.lower(crawler_type)
    groups = [("indexing", T.INDEXING_BOTS), ("retrieval", T.RETRIEVAL_AGENTS), ("agentic", T.AGENTIC_BOTS)]
    return F.filter(F.array(*[F.when(ct.isin([x.lower() for x in names]), F.lit(g)) for g, names in groups]), lambda g: g.isNotNull())


def unimportant(path: Column) -> Column:
    return reduce(lambda a, b: a | b, [path.ilike(f"%{p}%") for p in T.UNIMPORTANT])


def classify(path: Column, rules: list[tuple[str, str, str]]) -> dict[str, Column]:
    """segment, segment_match and taxonomy of the longest rule (path, match type, name) that fits; ties keep the rules' order."""
    fits = {"contains": lambda p: path.contains(p), "exactMatch": lambda p: path == p}
    ordered = sorted(rules, key=lambda r: -len(r[0].encode()))
    cases = [(fits.get(m, lambda p: path.startswith(p))(p), p, m, n) for p, m, n in ordered]
    return {
        "segment": _first([(c, F.lit(n)) for c, _, _, n in cases], F.lit("Other")),
        "segment_match": _first([(c, F.lit(m)) for c, _, m, _ in cases], F.lit(None).cast("string")),
        "taxonomy": _first([(c, F.lit(p)) for c, p, _, _ in cases], F.lit("other")),
    }
