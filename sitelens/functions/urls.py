"""Column functions of addresses and page measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T


def norm_url(c: Column) -> Column:
    """Resource identity: lower-case scheme and host, no fragment or default port; query, escapes and trailing slash stay.

    Dot segments are resolved; what has no scheme and host is left as it is.
    """
    x = F.regexp_replace(F.trim(c), "#.*$", "")
    head = F.lower(F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    rest = F.substring(x, F.length(head) + 1, F.length(x))
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    path, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"(\?.*)$", 1)
    parts = F.split(path, "/")
    clean = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"), lambda acc, p: F.when(p == ".", acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    dots = F.concat(F.lit("/"), F.array_join(clean, "/"), F.when(path.rlike(r"/\.{1,2}$") & (F.size(clean) > 0), "/").otherwise(""))
    path = F.when(path == "", "/").when(path.rlike(r"/\.{1,2}(/|$)"), dots).otherwise(path)
    return F.when(head == "", c).otherwise(F.concat(head, path, query))


def same_key(c: Column) -> Column:
    """Comparison key: trimmed, lower case, no scheme, www., fragment or one trailing slash."""
    x = F.regexp_replace(F.lower(F.trim(c)), "#.*$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "^https?://", ""), r"^www\.", ""), "/$", "")


def inlink_key(c: Column) -> Column:
    return F.regexp_replace(F.substring_index(c, "#", 1), "/$", "")


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))


def is_internal(h: Column, base: Column) -> Column:
    """Equal hosts, but for www., or one a subdomain of the other."""
    a, b = F.regexp_replace(h, r"^www\.", ""), F.regexp_replace(base, r"^www\.", "")
    return (a == b) | h.endswith(F.concat(F.lit("."), b)) | base.endswith(F.concat(F.lit("."), a))


def url_path(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def folder_depth(c: Column) -> Column:
    return F.size(F.filter(F.split(url_path(c), "/"), lambda p: p != ""))


def url_pattern(c: Column) -> Column:
    """Runs of four or more digits over 999, but for 1900 to 2099, as N; a query with more than two & is dropped."""
    x = F.regexp_replace(c, r"(?<!\d)(?!0*(?:19\d\d|20\d\d)(?!\d))(?!0+\d{0,3}(?!\d))\d{4,9}(?!\d)", "N")
    query = F.regexp_extract(x, r"(\?.*)$", 1)
    return F.when(F.regexp_count(query, F.lit("&")) > 2, F.regexp_extract(x, r"^([^?]*)", 1)).otherwise(x)


def is_dangerous(c: Column) -> Column:
    """Whether any dangerous pattern is in a path: one alternation, as most paths are clean."""
    return F.coalesce(c.rlike("(?i)" + "|".join(f"(?:{p})" for p, _, _ in T.DANGEROUS_PATHS)), F.lit(False))


def path_danger(c: Column) -> Column:
    """label and category of the first dangerous pattern in a path; null for clean, empty and null paths.

    The place of the first match is found by a chain of tests that clean paths don't enter, and named by two lists. Filter with
    `is_dangerous`, not with this, or the chain is written into the filter too.
    """
    (first, _, _), *rest = T.DANGEROUS_PATHS
    place = F.when(~is_dangerous(c), None).when(c.rlike("(?i)" + first), 1)
    place = reduce(lambda acc, e: acc.when(c.rlike("(?i)" + e[1][0]), e[0]), enumerate(rest, 2), place)
    known = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(category).alias("category")) for _, label, category in T.DANGEROUS_PATHS])
    return F.try_element_at(known, place)


def should_skip(c: Column) -> Column:
    low = F.lower(c)
    return reduce(lambda a, b: a | b, [low.contains(p) for p in T.SKIPPED], c.contains("#")) | (F.regexp_count(c, F.lit("&")) > 8) | (F.octet_length(c) > 500)


def status_text(code: Column) -> Column:
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in T.STATUS_TEXT.items() for x in kv]), code.cast("int"))
    other = F.when(code >= 500, "Server Error").when(code >= 400, "Client Error").when(code >= 300, "Redirect").otherwise("OK")
    return F.when(code.isNull() | (code == 0), "").otherwise(F.coalesce(known, other))


def co2_mg(n_bytes: Column) -> Column:
    """Milligrams of CO2 of a page view, to three places; null without bytes."""
    return F.when(n_bytes > 0, F.round(n_bytes * F.lit(0.000000000072) * F.lit(442) * F.lit(1000), 3))


def carbon_rating(mg: Column) -> Column:
    rating = reduce(lambda acc, c: acc.when(mg / 1000 <= c[0], c[1]), T.CARBON[1:], F.when(mg / 1000 <= T.CARBON[0][0], T.CARBON[0][1]))
    return F.when(mg.isNull(), "").otherwise(rating.otherwise("F"))


def title_px(c: Column) -> Column:
    """Estimated pixel width of a title: 9.5 a character, as no text can be measured here."""
    return F.floor(F.length(c) * 9.5 + 0.5)


def desc_px(c: Column) -> Column:
    return F.floor(F.length(c) * 6.8 + 0.5)


#: The characters with a meaning in an address; they stay escaped where one is read, and stay as they are where one is written.
RESERVED = ";/?:@&=+$,#"
PLAIN = RESERVED + "!~'()"


def display_url(c: Column) -> Column:
    """The readable form: escapes decoded but for those of reserved characters; the address itself where an escape is malformed."""
    codes = "|".join(f"{ord(x):02X}" for x in RESERVED)
    kept = F.replace(F.regexp_replace(c, f"(?i)%({codes})", "%25$1"), F.lit("+"), F.lit("%2B"))
    read = F.try_url_decode(kept)
    bad = read.isNull() | (read.contains("\ufffd") & ~c.contains("\ufffd") & ~F.upper(c).contains("%EF%BF%BD"))
    return F.when(~c.contains("%"), c).when(bad, c).otherwise(read)


def encoded_url(c: Column) -> Column:
    """The form on the wire: decoded, then encoded, so that doing it twice changes nothing but escapes that stayed."""
    sent = F.replace(F.url_encode(display_url(c)), F.lit("+"), F.lit("%20"))
    for x in PLAIN:
        sent = F.replace(sent, F.lit(f"%{ord(x):02X}"), F.lit(x))
    malformed = c.contains("%") & (display_url(c) == c) & c.rlike("(?i)%(?![0-9a-f]{2})|%[89a-f][0-9a-f]")
    return F.when(malformed, c).otherwise(sent)


def resolved(href: Column, base: Column) -> Column:
    """A reference read on a page: whole addresses stay, others take the page's scheme, host or folder; dot segments are resolved by norm_url."""
    x = F.trim(href)
    scheme, site = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    plain = F.regexp_replace(base, "[?#].*$", "")
    folder = F.when(plain == site, F.concat(site, F.lit("/"))).otherwise(F.regexp_replace(plain, "[^/]*$", ""))
    return (
        F.when(x.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), x)
        .when(x.startswith("//"), F.concat(scheme, x))
        .when(x.startswith("/"), F.concat(site, x))
        .when(x.startswith("?"), F.concat(plain, x))
        .when(x.startswith("#") | (x == ""), F.concat(F.regexp_replace(base, "#.*$", ""), x))
        .otherwise(F.concat(folder, x))
    )


def extension(c: Column) -> Column:
    """What follows the last dot of an address's last path segment, in lower case; '' if there is none."""
    return F.lower(F.regexp_extract(F.element_at(F.split(url_path(c), "/"), -1), r"\.([^.]*)$", 1))


def content_type_for(c: Column, known: Column | None = None) -> Column:
    """The content type that is known, or else that of the address's ending; '' for other endings."""
    table = F.create_map(*[F.lit(x) for kv in T.CONTENT_TYPES.items() for x in kv])
    guess = F.coalesce(F.try_element_at(table, extension(c)), F.lit(""))
    return guess if known is None else F.coalesce(F.nullif(known, F.lit("")), guess)
