"""Interleaved document sequences: HTML to ordered text and media references, payloads joined in by digest.

`parse_html` yields items in document order: {kind: text|media, text, digest, n_bytes, caption}. A media item is an <img>
with src "media:sha256-<hex>"; its caption is the figure's <figcaption>, before or after it, or else the alt text. `sequences`
gives a row an item with its position, and `resolve` joins the stored bytes to them by digest, so positions and captions stay
aligned with what was resolved; a digest that is not in the catalogue keeps a null.

The query makes a page of each document, its lines as paragraphs around a figure of its text stored as an 8-bit grey PNM
image, 24 samples a row. The figure's reference is resolved to the description of the stored bytes, as a second copy of the bytes
doesn't fit the disk that the query may use; `resolve` is the form that brings the bytes.

Nulls and empty texts are one block of padding on a page without paragraphs. Repeated rows stay repeated, null doc_ids stay;
equal texts share one medium. A null html has no items, an empty table no rows. A text is held whole by one task, as are its page and
its medium, and nothing else of it. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, small_batches, written

SIDE = 24
BLOCK = SIDE * SIDE
TAIL = 32
PREFIX = "media:sha256-"
SHARE = 500  # references to one copy of a medium
ITEM = "struct<kind:string,text:string,digest:string,n_bytes:bigint,caption:string>"


# ---------------------------------------------------------------- stored form


def pad(payload: bytes) -> bytes:
    """The payload with bytes 255 up to a positive multiple of BLOCK."""
    return payload + b"\xff" * (max(BLOCK, -(-len(payload) // BLOCK) * BLOCK) - len(payload))


def store_pgm(payload: bytes) -> bytes:
    """8-bit grey image whose samples are the payload, 24 a row."""
    return b"P5\n%d %d\n255\n" % (SIDE, len(payload) // SIDE) + payload


def load_pgm(media: bytes) -> tuple[int, int, bytes]:
    """Width, height and samples of a stored image."""
    kind, dims, top, samples = media.split(b"\n", 3)
    width, height = map(int, dims.split())
    if kind != b"P5" or top != b"255" or len(samples) != width * height:
        raise ValueError("not a stored medium")
    return width, height, samples


def feature(samples: bytes) -> str:
    """Shape, mean, deviation and 64-bit average hash (8 x 8 areas of equal size over the sample sequence)."""
    x = np.frombuffer(samples, np.uint8)
    areas = np.add.reduceat(x.astype(np.int64), np.arange(64) * len(x) // 64) * 1.0 / (len(x) // 64)
    bits = areas > areas.mean()
    return f"{SIDE}x{len(x) // SIDE};mean={x.mean():.3f};std={x.std():.3f};ahash={np.packbits(bits).tobytes().hex()}"


# ---------------------------------------------------------------- html


BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Items(HTMLParser):
    """Items in order. A figure ends at its end tag, at the next figure, or where an element around it ends; its caption with it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.text, self.hidden = [], [], 0
        self.figure = None  # where the open figure's items begin
        self.inside = []  # what is open inside it
        self.caption, self.said = None, None  # the open figcaption's pieces, and what the figure's caption says

    def add(self, **item):
        self.items.append({"kind": "text", "text": None, "digest": None, "n_bytes": None, "caption": None} | item)

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.add(text=text)

    def end_caption(self):
        if self.caption is not None:
            self.said, self.caption = " ".join([*([self.said] if self.said else []), *"".join(self.caption).split()]), None

    def end_figure(self):
        """Give the caption to the figure's media; without any, it is a text."""
        self.flush()
        self.end_caption()
        if self.figure is not None and self.said:
            media = [item for item in self.items[self.figure :] if item["kind"] == "media"]
            for item in media:
                item["caption"] = self.said
            if not media:
                self.add(text=self.said)
        self.figure, self.inside, self.said = None, [], None

    def edge(self):
        """The edge of a block parts words, in a caption too."""
        if self.caption is None:
            self.flush()
        else:
            self.caption.append(" ")

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "img":
            a = dict(attrs)
            self.flush()
            src, n = a.get("src") or "", a.get("data-bytes") or ""
            self.add(kind="media", digest=src.removeprefix(PREFIX) if src.startswith(PREFIX) else None, n_bytes=int(n) if n.isascii() and n.isdigit() and len(n) < 19 else None, caption=a.get("alt"))
        elif tag == "figure":
            self.end_figure()
            self.figure = len(self.items)
            return
        elif tag == "figcaption":
            self.flush()
            if self.figure is not None and self.caption is None:
                self.caption = []
        elif tag in BLOCKS:
            self.edge()
        if self.figure is not None and tag not in VOID:
            self.inside.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if tag == "figure":
            self.end_figure()
        elif self.figure is not None and tag in self.inside:
            while self.inside.pop() != tag:
                pass
        elif self.figure is not None and tag in BLOCKS and tag not in ("p", "br"):
            self.end_figure()  # what is around the figure ends
        if tag == "figcaption":
            self.end_caption()
            self.flush()
        elif tag in BLOCKS:
            self.edge()

    def handle_data(self, data):
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def parse_html(html: str | None) -> list[dict]:
    """The items of a page in document order."""
    p = _Items()
    p.feed(html or "")
    p.close()
    p.end_figure()
    return p.items


def sequences(pages: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """(key, n_items, position, kind, text, digest, n_bytes, caption): a row an item, positions from 0, n_items of its page."""

    @F.pandas_udf(f"array<{ITEM}>")
    def items(html):
        return html.map(parse_html)

    parsed = pages.select(F.col(key), items(F.col(html)).alias("_items"))
    return parsed.select(key, F.size("_items").alias("n_items"), F.posexplode("_items").alias("position", "_item")).select(key, "n_items", "position", "_item.*")


def resolve(items: DataFrame, stored: DataFrame) -> DataFrame:
    """Each item with the media bytes of its digest, null where there is no such digest. `stored` is a written table of (digest,
    media) in which a digest may repeat.

    A digest's references are dealt over cells of SHARE, each with its own copy of the bytes; only counts are ever broadcast.
    """
    items = written(items.withColumn("_spread", F.monotonically_increasing_id()), "media-refs")
    known = items.filter("digest is not null")
    counts = written(known.groupBy("digest").agg(F.count("*").alias("_n"), F.ceil(F.count("*") / SHARE).alias("_cells")), "media-counts")
    placed = hot_join(known, counts, "digest", "_n", known.count()).withColumn("_cell", F.pmod("_spread", "_cells"))
    each = stored.groupBy("digest").agg(F.first("media").alias("media")).join(counts.select("digest", "_cells").hint("merge"), "digest")
    copies = each.select("digest", "media", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cells") - 1)).alias("_cell"))
    found = placed.join(copies.hint("merge"), ["digest", "_cell"], "left").select(*items.columns, "media")
    return found.unionByName(items.filter("digest is null").withColumn("media", F.lit(None).cast("binary"))).drop("_spread")


# ---------------------------------------------------------------- media of texts


def page_of(text: str, digest: str, n_bytes: int) -> str:
    """A page of the text's lines as paragraphs, with the figure of its medium after the first half of them."""
    lines = [f"<p>{escape(x)}</p>" for x in text.split("\n") if x.strip()]
    half = (len(lines) + 1) // 2
    figure = f'<figure><img src="{PREFIX}{digest}" data-bytes="{n_bytes}" alt=""><figcaption>{n_bytes} bytes, {len(lines)} paragraphs</figcaption></figure>'
    return "<article>" + "".join([*lines[:half], figure, *lines[half:]]) + "</article>"


def _each_text(docs: DataFrame, names: list[str], make) -> DataFrame:
    """The columns of `names`, by make(doc_id, text, medium, its digest) of each whole text. No shuffle."""
    types = {"doc_id": (pa.int64(), "long"), "html": (pa.string(), "string"), "digest": (pa.string(), "string"), "media": (pa.binary(), "binary")}
    schema = pa.schema([(n, types[n][0]) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                ids, texts = (c.slice(i, 500) for c in batch.columns)
                rows = []
                for doc_id, text in zip(ids.to_pylist(), pc.fill_null(texts, "").to_pylist()):
                    media = store_pgm(pad(text.encode()))
                    rows.append(make(doc_id, text, media, hashlib.sha256(media).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} {types[n][1]}" for n in names))


def store_texts(docs: DataFrame) -> DataFrame:
    """digest, media: each whole text as a medium."""
    return _each_text(docs, ["digest", "media"], lambda doc_id, text, media, digest: (digest, media))


def text_pages(docs: DataFrame) -> DataFrame:
    """doc_id, html: a page of each text's paragraphs, which refers to its medium."""
    return _each_text(docs, ["doc_id", "html"], lambda doc_id, text, media, digest: (doc_id, page_of(text, digest, len(text.encode()))))


def catalogue(stored: DataFrame) -> DataFrame:
    """One row a digest, from the stored bytes: digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_refs.

    Raises where stored bytes don't have the digest that they were stored under.
    """
    schema = pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                found = hashlib.sha256(data).hexdigest()
                if found != digest:
                    raise ValueError(f"stored bytes of {digest} have the digest {found}")
                _, _, samples = load_pgm(data)
                rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-TAIL:]), len(data), found, feature(samples)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    names = [f.name for f in schema if f.name != "digest"]
    each = stored.select("digest", "media").mapInArrow(describe, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return each.groupBy("digest").agg(*[F.first(n).alias(n) for n in names], F.count("*").alias("n_refs"))


def text_media(docs: DataFrame) -> DataFrame:
    """A row a document: its medium, found in its page's sequence and resolved by digest to what the stored bytes say, with the number of
    the page's items, the medium's position among them and its caption.

    The catalogue of descriptions is what is joined here; `resolve` joins the bytes themselves.
    """
    about = written(catalogue(written(store_texts(docs), "media")), "media-catalogue")
    items = written(sequences(text_pages(docs)).filter("kind = 'media'").select("doc_id", "digest", "n_bytes", "n_items", "position", "caption"), "media-items")
    found = hot_join(items, about, "digest", "n_refs", items.count())
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_items", "position", "caption")
