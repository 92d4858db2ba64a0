"""Crawled pages to page facts, in one pass over partitions.

HTML is parsed by the standard library's tolerant parser, which repairs nothing: an element ends at its own end tag, or with what
encloses it. Text of script, style, noscript and template is no text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import MapType, StructType

from ..functions.tables import RISKY_SCRIPTS
from . import selectors

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "noscript", "template"}
CONTENT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote"}

LINK = "struct<url:string,anchor_text:string,rel:string,title:string,target:string,internal:boolean>"
IMAGE = "struct<url:string,alt:string,size_missing:boolean>"
FORM = "struct<action:string,method:string,insecure:boolean>"
SCHEMA = (
    "url string, title string, title_len int, description string, canonicals array<string>, meta_robots array<string>, headings map<string,array<string>>, opengraph map<string,string>, "
    f"links array<{LINK}>, images array<{IMAGE}>, css array<string>, css_inline int, javascript array<string>, js_inline int, iframes array<string>, pdfs array<string>, schema string, "
    "hreflangs array<struct<lang:string,url:string>>, next string, prev string, amp string, language string, mobile boolean, keywords string, refresh string, "
    f"forms array<{FORM}>, unsafe_anchors int, unsandboxed_iframes int, mixed_content int, risky_scripts int, word_count int, sentence_count int, text string, paragraphs string, text_bytes int, html_bytes int"
)


RULE = "id long, name string, mode string, pattern string, target string, attribute string, search_text string, enabled boolean"
FOUND = "struct<rule_id:bigint,name:string,matched:boolean,value:string>"
CUT = 300  # bytes of a found value
SLICE = 1 << 19  # bytes of html that are parsed before their facts are handed on
BATCH = "4m"  # of the Arrow batches that Spark hands to Python


@dataclass
class Rule:
    """A custom search: mode css (target text, html or attribute of the first element that fits) or regex (of the visible text)."""

    id: int
    name: str
    mode: str
    pattern: str
    target: str = "text"
    attribute: str | None = None
    search_text: str | None = None

    def __post_init__(self):
        """A pattern that can't be read is none, and finds nothing."""
        self.chains, self.regex = None, None
        try:
            if self.mode == "css":
                self.chains = selectors.compiled(self.pattern)
            else:
                self.regex = re.compile(self.pattern)
        except (ValueError, re.error):
            pass

    def result(self, found: str | None) -> dict:
        """What is said of a page of which this was found (None: nothing)."""
        hit = found is not None and (self.mode != "css" or not self.search_text or self.search_text in found)
        return {"rule_id": self.id, "name": self.name, "matched": hit, "value": None if found is None else cut(found)}


def cut(value: str) -> str:
    """A value of over CUT bytes ends at the last character that begins by there, and in dots."""
    raw = value.encode()
    if len(raw) <= CUT:
        return value
    end = CUT
    while raw[end] & 0xC0 == 0x80:
        end -= 1
    return raw[:end].decode() + "..."


class _Page(HTMLParser):
    def __init__(self, url: str, html: str = "", rules: list[Rule] = ()):
        super().__init__(convert_charrefs=True)
        self.url, self.open, self.text, self.ended = url, [], [], False
        self.rules, self.found, self.taken = rules, {}, {}  # by rule: what was found; open elements whose text or source is wanted
        self.html, self.lines = html, [0, *[m.end() for m in re.finditer("\n", html)]] if rules else []
        self.f = {k: [] for k in ("titles", "canonicals", "meta_robots", "links", "images", "css", "javascript", "iframes", "schemas", "hreflangs", "forms", "blocks")}
        self.headings, self.og, self.meta, self.rel = {}, {}, {}, {}
        self.language, self.counts = None, dict.fromkeys(("css_inline", "js_inline", "unsafe", "sandbox", "risky"), 0)

    def link_to(self, href):
        try:
            return urljoin(self.url, (href or "").strip())
        except ValueError:
            return None

    def place(self) -> int:
        """Where the tag that is being handled begins."""
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def seek(self, tag, attrs):
        """Rules whose first element this start tag is."""
        stack = None
        for i, r in enumerate(self.rules):
            if not r.chains or i in self.found or i in self.taken:
                continue
            stack = stack or [*((t, x) for t, _, x, *_ in self.open), (tag, attrs)]
            if any(selectors.chain_fits(c, stack) for c in r.chains):
                if r.target == "attribute":
                    self.found[i] = attrs.get((r.attribute or "").lower())
                elif tag in VOID:
                    self.found[i] = self.get_starttag_text() if r.target == "html" else ""
                else:
                    self.taken[i] = (len(self.open), self.place())

    def close_taken(self, depth: int, end: int):
        """The open elements from a depth on end, in the source at `end`; the outermost one after its own end tag."""
        for i, (at, start) in list(self.taken.items()):
            if at >= depth:
                del self.taken[i]
                outer = end if at > depth or end == len(self.html) else self.html.find(">", end) + 1 or len(self.html)
                self.found[i] = self.html[start:outer] if self.rules[i].target == "html" else "".join(self.open[at][1])

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        if self.rules:
            self.seek(tag, a)
        name = (a.get("name") or "").lower()
        if tag == "html" and a.get("lang"):
            self.language = a["lang"]
        elif tag == "meta":
            content = a.get("content", "")
            if name == "robots":
                self.f["meta_robots"].append(content)
            if a.get("property", "").startswith("og:"):
                self.og.setdefault(a["property"], content)
            for key in (name, a.get("http-equiv", "").lower()):
                if key:
                    self.meta.setdefault(key, content)
        elif tag == "link":
            rel, href = a.get("rel", "").lower().split(), a.get("href", "")
            for r in rel:
                if r == "canonical" and href:
                    self.f["canonicals"].append(href)
                elif r == "stylesheet" and href:
                    self.f["css"].append(self.link_to(href))
                elif r == "alternate" and a.get("hreflang"):
                    self.f["hreflangs"].append({"lang": a["hreflang"], "url": href})
                elif r in ("next", "prev", "amphtml"):
                    self.rel.setdefault(r, href.strip() or None)
        elif tag == "a" and "href" in a:
            self.f["links"].append({"url": self.link_to(a["href"]), "anchor_text": [], "rel": a.get("rel"), "title": a.get("title"), "target": a.get("target")})
            self.counts["unsafe"] += a.get("target") == "_blank" and "noopener" not in a.get("rel", "")
        elif tag == "img" and a.get("src"):
            url = self.link_to(a["src"])
            if url and url.startswith(("http://", "https://")):
                self.f["images"].append({"url": url, "alt": a.get("alt"), "size_missing": not (a.get("width") and a.get("height"))})
        elif tag == "iframe":
            if a.get("src"):
                self.f["iframes"].append(self.link_to(a["src"]))
            self.counts["sandbox"] += "sandbox" not in a
        elif tag == "script":
            if a.get("src"):
                self.f["javascript"].append(self.link_to(a["src"]))
            else:
                self.counts["js_inline"] += 1
        elif tag == "style":
            self.counts["css_inline"] += 1
        elif tag == "form":
            action = self.link_to(a.get("action", ""))
            self.f["forms"].append({"action": action, "method": (a.get("method") or "GET").upper(), "insecure": (action or "").startswith("http://")})
        if tag not in VOID:
            self.open.append((tag, [], a, self.f["links"][-1] if tag == "a" and "href" in a else None))

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        if self.taken:
            self.close_taken(at, len(self.html) if self.ended else self.place())
        for t, parts, a, link in reversed(self.open[at:]):
            text = "".join(parts)
            if t == "title":
                self.f["titles"].append(text.strip())
            elif t in CONTENT:
                self.f["blocks"].append((t, text))
                if t[0] == "h":
                    self.headings.setdefault(t, []).append(" ".join(text.split()))
            elif link is not None:
                link["anchor_text"] = " ".join(text.split())
            elif t == "script":
                if "ld+json" in a.get("type", ""):
                    self.f["schemas"].append(text)
                self.counts["risky"] += "src" not in a and any(x in text for x in RISKY_SCRIPTS)
        del self.open[at:]

    def handle_data(self, data):
        for _, parts, *_ in self.open:
            parts.append(data)
        if not any(t in HIDDEN or t in ("head", "title") for t, *_ in self.open):
            self.text.append(data)


def _words(text: str) -> int:
    return sum(any(c.isalnum() for c in w) for w in text.split())


def _sentences(text: str) -> int:
    return sum(1 for part in re.split(r"[.!?؟۔…]+", text) if _words(part)) if _words(text) else 0


def page_facts(url: str | None, html: str | None, rules: list[Rule] = (), only: list[str] | None = None) -> dict:
    """The facts of one page (with `only`, just these), and with rules what each of them found; a null html is an empty one."""
    url, html = url or "", html or ""
    total = lambda name, count: sum(count(t) for _, t in f["blocks"]) if only is None or name in only else 0
    p = _Page(url, html, rules)
    p.feed(html)
    p.close()
    p.ended = True
    for tag, *_ in reversed(list(p.open)):
        p.handle_endtag(tag)
    f, host = p.f, re.sub(r"^www\.", "", urlsplit(url).hostname or "") if url else ""
    first = lambda *xs: next((x for x in xs if x), None)
    text = " ".join("".join(p.text).split())
    h = lambda t: next(iter(p.headings.get(t, [])), None)
    title = first(*f["titles"], h("h1"), h("h2"), h("h3"), h("h4"), p.meta.get("title"), p.og.get("og:title")) or (text[:50] + "..." if text else None)
    for x in f["links"]:
        own = re.sub(r"^www\.", "", (urlsplit(x["url"]).hostname or "") if x["url"] else "")
        x["internal"] = bool(own) and (own == host or own.endswith("." + host) or host.endswith("." + own))
        x["anchor_text"] = x["anchor_text"] or None
    schema = None
    for s in f["schemas"]:
        try:
            json.loads(s)
            schema = s
            break
        except ValueError:
            continue
    for i, r in enumerate(rules):
        if r.regex and (m := r.regex.search(text)):
            p.found[i] = next((x for x in (m[1] if r.regex.groups else None, m[0]) if x is not None), None)
    assets = [*f["css"], *f["javascript"], *f["iframes"], *[i["url"] for i in f["images"]]]
    facts = {
        "url": url, "title": title, "title_len": len(title.encode()) if title else 0, "description": p.meta.get("description"), "canonicals": f["canonicals"], "meta_robots": f["meta_robots"], "headings": p.headings, "opengraph": p.og,
        "links": f["links"], "images": f["images"], "css": f["css"], "css_inline": p.counts["css_inline"], "javascript": f["javascript"], "js_inline": p.counts["js_inline"], "iframes": f["iframes"],
        "pdfs": [x["url"] for x in f["links"] if x["url"] and urldefrag(x["url"])[0].endswith(".pdf")], "schema": schema, "hreflangs": f["hreflangs"], "next": p.rel.get("next"), "prev": p.rel.get("prev"), "amp": p.rel.get("amphtml"),
        "language": first(p.language, p.meta.get("content-language"), p.og.get("og:locale"), p.meta.get("language")), "mobile": "viewport" in p.meta, "keywords": p.meta.get("keywords"), "refresh": p.meta.get("refresh"),
        "forms": f["forms"], "unsafe_anchors": p.counts["unsafe"], "unsandboxed_iframes": p.counts["sandbox"], "mixed_content": sum(bool(x) and x.startswith("http://") for x in assets) if url.startswith("https://") else 0, "risky_scripts": p.counts["risky"],
        "word_count": total("word_count", _words), "sentence_count": total("sentence_count", _sentences), "text": text, "paragraphs": " ".join(t for k, t in f["blocks"] if k == "p"), "text_bytes": len(text.encode()), "html_bytes": len(html.encode()),
    }
    facts = facts if only is None else {c: facts[c] for c in only}
    return facts | ({"custom_search": [r.result(p.found.get(i)) for i, r in enumerate(rules)]} if rules else {})


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `limit` bytes of a text column, one row at least."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
    i = 0
    while i < len(ends):
        j = max(i + 1, int(ends.searchsorted((ends[i - 1] if i else 0) + limit, "right")))
        yield batch.slice(i, j - i)
        i = j


def extract_pages(pages: DataFrame, key: str | None = None, rules: list[Rule] = (), only: list[str] | None = None) -> DataFrame:
    """Facts of pages (url, html): a row a page. With a key, that column goes along; with `only`, just these facts; with rules,
    custom_search, one result a rule. No shuffle; a task holds a batch of BATCH and the facts of SLICE bytes of html (or of one page)."""
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    facts = SCHEMA if only is None else ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in map(StructType.fromDDL(SCHEMA).__getitem__, only))
    kind = f"{key} {pages.schema[key].dataType.simpleString()}, " if key else ""
    kind = kind + facts + (f", custom_search array<{FOUND}>" if rules else "")
    types = StructType.fromDDL(kind)
    schema, maps = to_arrow_schema(types), [f.name for f in types if isinstance(f.dataType, MapType)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                rows = [page_facts(u, h, rules, only) for u, h in zip(part.column("url").to_pylist(), part.column("html").to_pylist())]
                for r in rows:
                    r.update({c: list(r[c].items()) for c in maps})
                columns = [part.column(key)] if key else []
                columns += [pa.array([r[f.name] for r in rows], f.type) for f in list(schema)[len(columns) :]]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return pages.select(*([key] if key else []), "url", "html").mapInArrow(run, kind)


def enabled_rules(table: DataFrame, most: int = 1000) -> list[Rule]:
    """The enabled rules of a table (RULE), by id: a user's, `most` rows at most."""
    rows = table.filter("enabled and name is not null and pattern is not null").drop("enabled").orderBy("id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{most} search rules at most")
    return [Rule(r.id, r.name, r.mode or "css", r.pattern, r.target or "text", r.attribute, r.search_text) for r in rows]


def custom_results(pages: DataFrame, table: DataFrame, key: str | None = None) -> DataFrame:
    """url (and the key), rule_id, name, matched, value: a row for each page and enabled rule, matched or not, all from one parse of a page."""
    rules = enabled_rules(table)
    found = extract_pages(pages, key, rules, ["url"])
    if not rules:
        found = found.withColumn("custom_search", F.array().cast(f"array<{FOUND}>"))
    return found.select(*([key] if key else []), "url", F.explode("custom_search").alias("r")).select(*([key] if key else []), "url", "r.*")


def custom_search(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """A row for each page (url, text) and regex rule (name, pattern), matched or not: value is group 1, or else the match, cut at 300 characters."""
    one = []
    for name, pattern in rules:
        group = 1 if re.compile(pattern).groups else 0
        one.append(F.struct(F.lit(name).alias("rule"), F.col("text").rlike(pattern).alias("matched"), F.nullif(F.substring(F.regexp_extract("text", pattern, group), 1, 300), F.lit("")).alias("value")))
    return pages.select("url", F.explode(F.array(*one)).alias("r")).select("url", "r.*")
