"""Tables of a crawl as files: all kinds from one scan of the pages, written by one job."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import urls as U

C = F.col

#: The columns of each table, in order.
TABLES = {
    "main": ["URL", "Page Title", "Title Size", "Description", "Desc. Size", "H1", "H1 Size", "H2", "H2 Size", "Status Code", "Word Count", "Text Ratio", "Flesch Score", "Flesch Grade", "Mobile", "Meta Robots", "Content Type", "Indexability", "Language", "Schema", "Depth", "Opengraph", "Cookies", "Size", "Link Score"],
    "links": ["Anchor Text", "Rel", "HREF", "Title", "Target", "Status Code", "Page"],
    "keywords": ["URL", *[x for i in range(1, 11) for x in (f"Keyword {i}", f"Frequency {i}")]],
    "images": ["URL", "Alt Text", "Size", "Type", "Status Code"],
    "redirects": ["URL", "Status Code", "Redirect To", "Redirect Count", "Redirect Type"],
    "files": ["URL", "File Type", "Found At"],
    "css": ["URL"],
}


def _texts(*cells) -> Column:
    return F.array(*[F.coalesce((c if isinstance(c, Column) else F.lit(c)).cast("string"), F.lit("")) for c in cells])


def crawl_tables(pages: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """kind, url (of the page) and cells (as TABLES has them, texts; what isn't known is empty): the rows of all tables, from one scan.

    pages have url and what else is known: the facts of extract_pages, the crawl's columns, keywords (word and n, the commonest first),
    link_statuses (status by address), redirect_chain (url, status_code, location). A missing column or array gives empty cells or no rows.
    """
    kinds = list(TABLES) if kinds is None else kinds
    kind_of = dict(pages.dtypes)
    has = lambda c: C(c) if c in kind_of else F.lit(None).cast("string")
    item = lambda c, i=1: F.try_element_at(c, F.lit(i)) if c in kind_of else F.lit(None).cast("string")
    listed = lambda c, make: F.transform(c, make) if c in kind_of else F.array().cast("array<array<string>>")
    field = lambda c, x, name: x[name] if re.search(rf"[<,]{name}:", kind_of[c]) else F.lit(None).cast("string")
    size = lambda c: F.when(c.isNotNull(), F.length(c))
    h1, h2 = item("h1"), item("h2")
    status = lambda url: F.try_element_at("link_statuses", U.norm_url(url)) if "link_statuses" in kind_of else F.lit(None).cast("string")
    ends = lambda u: F.upper(F.regexp_extract(F.regexp_replace(u, "[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    words = [x for i in range(1, 11) for x in ((C("keywords_top")[i - 1]["word"], C("keywords_top")[i - 1]["n"]) if "keywords_top" in kind_of else (F.lit(None), F.lit(None)))]
    index = F.when(F.coalesce(has("indexability").cast("double"), F.lit(0.5)) >= 0.5, "Indexable").otherwise("Not indexable")
    files = F.filter("links", lambda x: F.coalesce(ends(x["url"]).isin(T.FILE_ENDINGS), F.lit(False))) if "links" in kind_of else None
    rows = {
        "main": F.array(_texts(C("url"), has("title"), size(has("title")), has("description"), size(has("description")), h1, size(h1), h2, size(h2), has("status_code"), has("word_count"), has("text_ratio"), has("flesch"), has("readability"), has("mobile"), F.array_join("robots", ", ") if "robots" in kind_of else None, has("content_type"), index, has("language"), has("schema"), has("url_depth"), F.size("opengraph") if "opengraph" in kind_of else None, has("cookies"), has("html_bytes"), has("link_score"))),
        "links": listed("links", lambda x: _texts(x["anchor_text"], x["rel"], x["url"], x["title"], x["target"], status(x["url"]), C("url"))),
        "keywords": F.array(_texts(C("url"), *words)),
        "images": listed("images", lambda x: _texts(x["url"], x["alt"], field("images", x, "size"), ends(x["url"]), status(x["url"]))),
        "redirects": listed("redirect_chain", lambda x: _texts(x["url"], x["status_code"], x["location"], F.size("redirect_chain"), F.concat(x["status_code"].cast("string"), F.lit(" Redirect")))),
        "files": F.array().cast("array<array<string>>") if files is None else F.transform(files, lambda x: _texts(x["url"], ends(x["url"]), C("url"))),
        "css": listed("css", lambda x: _texts(x)),
    }

    def named(kind: str) -> Column:
        return F.transform(F.coalesce(rows[kind], F.array().cast("array<array<string>>")), lambda cells: F.struct(F.lit(kind).alias("kind"), cells.alias("cells")))

    every = F.concat(*map(named, kinds))
    return pages.select("url", F.explode(every).alias("_r")).select("_r.kind", "url", "_r.cells")


def write_tables(rows: DataFrame, folder: str, ranges: int | None = None, headers: dict[str, list[str]] | None = None) -> None:
    """One job writes rows of (kind, url, cells) as quoted CSV lines, a folder a kind, ordered over the files' names by url and cells; each kind
    begins with its header. Rows are dealt by range, so a kind is as many files as it needs, and no kind meets in one task."""
    spark = rows.sparkSession
    heads = spark.createDataFrame([(k, None, h, 0) for k, h in (headers or TABLES).items()], "kind string, url string, cells array<string>, _o int")
    every = heads.unionByName(rows.withColumn("_o", F.lit(1)))
    line = F.array_join(F.transform("cells", lambda c: F.concat(F.lit('"'), F.replace(F.regexp_replace(c, r"[\r\n]+", " "), F.lit('"'), F.lit('""')), F.lit('"'))), ",")
    keys = [C("kind"), C("_o"), C("url"), C("cells")]
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    every.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("kind", line.alias("value")).write.mode("errorifexists").partitionBy("kind").text(folder)
