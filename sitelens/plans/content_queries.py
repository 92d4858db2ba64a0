"""Registered queries of addresses, readability, challenges, redirects and cell order, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import audit as A
from ..operators import pages as P
from .inputs import table

QUERIES, SQL = {}, {}


def p22_addresses(spark, sf_dir):
    tail = F.when(F.col("page_id") % 7 == 0, "%zz").when(F.col("page_id") % 7 == 1, "%ff").otherwise("")
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("/%D8%B3%D8%A6%D9%88?a=%2fb+c&d=%C3%A9%20~"), tail).alias("url"))
    return pages.select("page_id", U.display_url(F.col("url")).alias("display"), U.encoded_url(F.col("url")).alias("encoded"))


SQL["p22_addresses"] = """
SELECT page_id, CASE page_id % 7 WHEN 0 THEN url || '/%D8%B3%D8%A6%D9%88?a=%2fb+c&d=%C3%A9%20~%zz' WHEN 1 THEN url || '/%D8%B3%D8%A6%D9%88?a=%2fb+c&d=%C3%A9%20~%ff' ELSE url || '/سئو?a=%2fb+c&d=é ~' END AS display,
  CASE page_id % 7 WHEN 0 THEN url || '/%D8%B3%D8%A6%D9%88?a=%2fb+c&d=%C3%A9%20~%zz' WHEN 1 THEN url || '/%D8%B3%D8%A6%D9%88?a=%2fb+c&d=%C3%A9%20~%ff' ELSE url || '/%D8%B3%D8%A6%D9%88?a=%252fb+c&d=%C3%A9%20~' END AS encoded
FROM pages"""

SAID = ["Error 1015", "ERROR 1020", "<form id='challenge-form'>", "cloudflare", "Cloudflare Ray ID: 7", "Please enable JS", "Access Denied", "bot detection", ""]


def p30_challenges(spark, sf_dir):
    said = F.element_at(F.array(*[F.lit(x) for x in SAID]), (F.col("page_id") % len(SAID) + 1).cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("html", said).alias("html"), F.when(F.col("page_id") % 2 == 0, 200).otherwise(403).alias("status_code"), F.lit(1.0).alias("indexability"), F.lit("-").alias("reason"))
    return A.mark_challenges(pages).select("page_id", "crawl_error", "indexability", A.challenge_reason(F.col("html")).alias("challenge"))


SQL["p30_challenges"] = f"""
WITH b AS (SELECT page_id, lower(html || ({SAID!r})[page_id % {len(SAID)} + 1]) AS h, octet_length(encode(html || ({SAID!r})[page_id % {len(SAID)} + 1])) AS n FROM pages),
c AS (SELECT page_id, CASE WHEN n >= 25000 THEN NULL WHEN contains(h, 'error 1015') THEN 'Cloudflare error 1015' WHEN contains(h, 'error 1020') THEN 'Cloudflare error 1020' WHEN contains(h, 'challenge-form') THEN 'challenge form'
  WHEN contains(h, 'cloudflare') AND contains(h, 'ray id') THEN 'Cloudflare Ray ID block' WHEN contains(h, 'distilnetworks') THEN 'Distil Networks block' WHEN contains(h, 'please enable js') THEN 'JavaScript anti-bot challenge'
  WHEN n >= 2000 THEN NULL WHEN contains(h, 'access denied') THEN 'access denied' WHEN contains(h, 'too many requests') OR contains(h, 'rate limit') THEN 'rate limit' WHEN contains(h, 'one more step') THEN 'one more step challenge'
  WHEN contains(h, 'unusual traffic') THEN 'unusual traffic challenge' WHEN contains(h, 'bot detection') THEN 'bot detection challenge' END AS challenge FROM b)
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN challenge END AS crawl_error, CAST(CASE WHEN page_id % 2 = 0 AND challenge IS NOT NULL THEN 0 ELSE 1 END AS DOUBLE) AS indexability, challenge FROM c""".replace('"', "'").replace("'<form id='challenge-form'>'", "'<form id=''challenge-form''>'")


def p33_redirect_rows(spark, sf_dir):
    hop = lambda url, code, to: F.struct(url.alias("url"), F.lit(code).alias("status_code"), to.alias("location"))
    plain, own = F.regexp_replace("url", "^https?:", "ftp:"), F.col("url")
    chain = F.when(F.col("page_id") % 3 == 0, F.array(hop(F.concat(plain, F.lit("/a")), 301, plain), hop(plain, 302, own), hop(own, 200, F.lit(None).cast("string")))).when(F.col("page_id") % 3 == 1, F.array(hop(own, 307, own)))
    return A.redirect_rows(table(spark, sf_dir, "pages").select("url", F.lit(2).alias("url_depth"), chain.alias("redirect_chain"))).select("url", "final_url", "status_code", "redirect_url", "redirect_count", "redirection_type", "reason")


SQL["p33_redirect_rows"] = """
WITH p AS (SELECT url AS final_url, regexp_replace(url, '^https?:', 'ftp:') AS plain FROM pages WHERE page_id % 3 = 0)
SELECT plain || '/a' AS url, final_url, 301 AS status_code, plain AS redirect_url, 2 AS redirect_count, '301 Redirect' AS redirection_type, 'Not indexable: HTTP redirect 301' AS reason FROM p
UNION ALL SELECT plain, final_url, 302, final_url, 2, '302 Redirect', 'Not indexable: HTTP redirect 302' FROM p"""


def t5_reading_level(spark, sf_dir):
    scored = table(spark, sf_dir, "documents").select("doc_id", F.round(X.reading_level(F.col("text")), 6).alias("score"))
    return scored.select("doc_id", "score", X.reading_class(F.col("score")).alias("level"))


SQL["t5_reading_level"] = r"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[^\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+') AS w FROM documents),
n AS (SELECT doc_id, len(w) AS n, len(regexp_extract_all(text, '[.!?]')) + CASE WHEN text <> '' AND right(text, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS s,
  list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN ends_with(x, 'e') AND len(regexp_extract_all(x, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))) AS y FROM w),
r AS (SELECT doc_id, CASE WHEN n > 0 THEN round(206.835 - 1.015 * (n / s) - 84.6 * (y / n), 6) END AS score FROM n)
SELECT doc_id, score, CASE WHEN score BETWEEN 90 AND 100 THEN 'Very Easy' WHEN score BETWEEN 80 AND 89.9 THEN 'Easy' WHEN score BETWEEN 70 AND 79.9 THEN 'Fairly Easy' WHEN score BETWEEN 60 AND 69.9 THEN 'Standard'
  WHEN score BETWEEN 50 AND 59.9 THEN 'Fairly Difficult' WHEN score BETWEEN 30 AND 49.9 THEN 'Difficult' WHEN score BETWEEN 0 AND 29.9 THEN 'Very Confusing' ELSE 'Unknown' END AS level FROM r"""


def k6_cell_order(spark, sf_dir):
    """Places of cells of size, some blank and some words, in descending order."""
    i = F.col("page_id")
    cell = F.when(i % 11 == 0, "").when(i % 13 == 0, "Page 2").when(i % 17 == 0, "page 10").otherwise(F.concat(F.format_number(F.octet_length("html") * (i % 5), 0), F.lit(" KB")))
    pages = table(spark, sf_dir, "pages").select("page_id", cell.alias("cell"))
    return P.ranks(pages, *A.cell_order(F.col("cell"), descending=True), F.col("page_id").asc()).select("page_id", F.col("_r").cast("long").alias("place"))


SQL["k6_cell_order"] = """
WITH c AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 4 WHEN page_id % 13 = 0 THEN 2 WHEN page_id % 17 = 0 THEN 1 ELSE 3 END AS kind, octet_length(encode(html)) * (page_id % 5) AS n FROM pages)
SELECT page_id, row_number() OVER (ORDER BY kind, CASE WHEN kind = 3 THEN n END DESC, page_id) - 1 AS place FROM c"""

QUERIES.update(p22_addresses=p22_addresses, p30_challenges=p30_challenges, p33_redirect_rows=p33_redirect_rows, t5_reading_level=t5_reading_level, k6_cell_order=k6_cell_order)
