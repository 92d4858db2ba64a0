"""Pages, links, robots, sitemaps, search rows and stores on literal rows."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitelens.functions import text as X
from sitelens.functions import urls as U
from sitelens.operators import keywords as K
from sitelens.operators import audit as A
from sitelens.operators import links as links_ops
from sitelens.operators import pages as ops
from sitelens.operators import panels as P
from sitelens.plans import inputs as I
from sitelens.sources import html as H
from sitelens.sources import web as W


def one(spark, column, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", column(F.col("v")).alias("o")).orderBy("i").collect()]


def test_addresses(spark):
    assert one(spark, U.norm_url, ["HTTP://A.com:80/x#f", "https://a.com:443", "https://a.com/p/?q=B#x", "https://a.com/a/./b/../c", "/rel"]) == ["http://a.com/x", "https://a.com/", "https://a.com/p/?q=B", "https://a.com/a/c", "/rel"]
    assert one(spark, U.same_key, [" HTTPS://www.A.com/x/#f"]) == ["a.com/x"]
    assert one(spark, U.inlink_key, ["https://a/x/#s", "https://a/x"]) == ["https://a/x", "https://a/x"]
    assert one(spark, U.url_pattern, ["/a/12345/b", "/y/2024/x", "/z/123", "/q?a=1&b=2&c=3&d=4", "/0099"]) == ["/a/N/b", "/y/2024/x", "/z/123", "/q", "/0099"]
    assert one(spark, U.should_skip, ["http://a/x", "http://a/#x", "mailto:x", "http://a/b.PDF", "http://a/?" + "&" * 9]) == [False, True, True, True, True]
    assert one(spark, U.status_text, [200, 418, 599, 0, None], "int") == ["OK", "Client Error", "Server Error", "", ""]
    assert one(spark, lambda c: U.is_internal(c, F.lit("site.example")), ["www.site.example", "b.site.example", "notsite.example"]) == [True, True, False]


def test_text_functions(spark):
    assert one(spark, X.word_count, ["a b - c1", "", None, "é ..."]) == [3, 0, 0, 1]
    assert one(spark, X.sentence_count, ["One. Two!! Three", "", "no end", "A?! B…"]) == [3, 0, 1, 2]
    assert one(spark, lambda c: X.ngrams(X.plain_words(c), 2), ["A b, c", "x", None]) == [["a b", "b c"], [], []]
    h = one(spark, lambda c: X.simhash(X.plain_words(c)), ["the cat sat on the mat today", "The CAT sat on the mat, today", "", "entirely other words here now"])
    assert h[0] == h[1] != h[3] and h[2] == 0


def test_page_facts():
    html = """<html lang="en"><head><title> T </title><meta name="description" content="d"><meta name="robots" content="noindex"><link rel="canonical" href="/c"><link rel="stylesheet" href="s.css">
    <meta name="viewport" content="x"><meta property="og:title" content="o"><script type="application/ld+json">{"a": 1}</script></head><body><h1>Head</h1><h2>Sub</h2><p>One two. Three <b>four!</p>
    <a href="https://b.site.example/x" rel="nofollow">in</a><a href="http://other.example/f.pdf" target="_blank">out</a><img src="http://i.example/a.png"><iframe src="f"></iframe><form action="http://site.example/go" method="post"></form><style>p{}</style></body></html>"""
    f = H.page_facts("https://www.site.example/p/", html)
    assert (f["title"], f["description"], f["canonicals"], f["meta_robots"], f["language"], f["mobile"]) == ("T", "d", ["/c"], ["noindex"], "en", True)
    assert f["headings"] == {"h1": ["Head"], "h2": ["Sub"]} and f["schema"] == '{"a": 1}' and f["opengraph"] == {"og:title": "o"}
    assert [(x["url"], x["internal"], x["anchor_text"]) for x in f["links"]] == [("https://b.site.example/x", True, "in"), ("http://other.example/f.pdf", False, "out")]
    assert f["pdfs"] == ["http://other.example/f.pdf"] and f["unsafe_anchors"] == 1 and f["mixed_content"] == 1 and f["unsandboxed_iframes"] == 1
    assert f["forms"] == [{"action": "http://site.example/go", "method": "POST", "insecure": True}] and f["word_count"] == 6 and f["sentence_count"] == 4
    empty = H.page_facts(None, None)
    assert empty["title"] is None and empty["links"] == [] and empty["word_count"] == 0


def test_extraction_over_the_given_pages(spark, sf_dir):
    pages = I.table(spark, sf_dir, "pages")
    facts = H.extract_pages(pages, "page_id")
    assert facts.count() == pages.count() and facts.filter("title is null or size(headings['h1']) <> 1 or language is null").count() == 0
    found = H.custom_search(facts, [("title", "(?i)the (\\w+)"), ("never", "zzzzqqq")])
    assert found.count() == 2 * pages.count() and found.filter("rule = 'never' and matched").count() == 0


def test_robots(spark):
    body = "# c\nUser-agent: a\nUser-agent: mybot\nDisallow: /private\nAllow: /private/ok$\nDisallow:\n\nUser-agent: *\nDisallow: /\nSitemap: https://h/s.xml\n"
    files = spark.createDataFrame([("h", body), ("k", "User-agent: *\nDisallow: /x*z\nAllow: /xyz")], "host string, body string")
    rules = W.robots_rules(files, "MyBot/2.0")
    assert {tuple(r) for r in rules.collect()} == {("h", False, "/private"), ("h", True, "/private/ok$"), ("k", False, "/x*z"), ("k", True, "/xyz")}
    urls = spark.createDataFrame([("h", "https://h/private/ok"), ("h", "https://h/private/ok2"), ("h", "https://h/open"), ("k", "https://k/xyz"), ("k", "https://k/x1z?q"), ("m", "https://m/")], "host string, url string")
    got = {r["url"]: r["allowed"] for r in W.robots_allowed(urls, rules).collect()}
    assert got == {"https://h/private/ok": True, "https://h/private/ok2": False, "https://h/open": True, "https://k/xyz": True, "https://k/x1z?q": False, "https://m/": True}
    assert [r["url"] for r in W.robots_sitemaps(files).collect()] == ["https://h/s.xml"]


def test_rule_trie_against_expressions():
    import random
    import re

    from sitelens.functions.robots import RuleTrie

    rng = random.Random(10)
    for _ in range(400):
        rules = [(rng.random() < 0.5, "".join(rng.choices("/ab*$.", (4, 4, 3, 3, 1, 1), k=rng.randint(1, 6)))) for _ in range(rng.randint(0, 6))]
        trie = RuleTrie(rules)
        for _ in range(20):
            path = "/" + "".join(rng.choices("/ab$.", k=rng.randint(0, 7)))
            fit = [(len(p.replace("*", "").replace("$", "")), allow) for allow, p in rules if re.match(".*".join(map(re.escape, re.sub(r"\$$", "", p).split("*"))) + ("$" if p.endswith("$") else ""), path)]
            assert trie.allowed(path) == (max(fit)[1] if fit else True), (rules, path)


def test_robots_of_hot_hosts_and_odd_rows(spark):
    rules = spark.createDataFrame([("h", False, "/p"), ("h", True, "/p1*9$"), ("h", True, None), (None, False, "/"), ("e", False, "/")], "host string, allow boolean, pattern string")
    rows = [("h", f"https://h/p{i}", i) for i in range(300)] + [("h", "https://h/p7", 7), ("h", None, 1), (None, "https://x/", 2), ("none", "https://none/", 3), ("e", None, 4), ("e", "https://e?q", 5)]
    urls = spark.createDataFrame(rows, "host string, url string, allowed int").withColumnRenamed("allowed", "_part")
    got = W.robots_allowed(urls, rules, part=16)
    assert got.columns == ["host", "url", "_part", "allowed"]
    said = sorted((str(r["host"]), str(r["url"]), r["allowed"]) for r in got.collect())
    want = [(str(h), str(u), (u[10:].startswith("p1") and u.endswith("9")) if h == "h" and u else h != "e") for h, u, _ in rows]
    assert said == sorted(want)
    assert W.robots_allowed(urls.limit(0), rules).count() == 0 and W.robots_allowed(urls, rules.limit(0)).filter("allowed").count() == len(rows)


def test_sitemaps(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<urlset xmlns='x'><url><loc> https://a/?x=1&amp;y=2 </loc><image:image><image:loc>https://a/i.png</image:loc></image:image></url><url><loc>https://a/b</loc></url></urlset>")
    (tmp_path / "i.xml").write_text("<sitemapindex><sitemap><loc>https://a/a.xml</loc></sitemap></sitemapindex>")
    (tmp_path / "h.xml").write_text("<html><url><loc>https://no</loc></url></html>")
    got = {tuple(r) for r in W.read_sitemaps(spark, str(tmp_path)).collect()}
    assert got == {("page", "https://a/?x=1&y=2"), ("page", "https://a/b"), ("sitemap", "https://a/a.xml")}
    assert W.site_size(W.read_sitemaps(spark, str(tmp_path))).first()["verdict"] == "ok"


def test_link_score(spark):
    def score(pages, links):
        p = spark.createDataFrame([(u, 200, c) for u, c in pages], "url string, status_code int, canonical string")
        e = spark.createDataFrame([(a, b, r, i) for i, (a, b, r) in enumerate(links)], "source_url string, url string, rel string, slot int")
        return {r["url"]: r["score"] for r in links_ops.link_score(p, e).collect()}

    h = "https://s/"
    hub = score([(h + x, None) for x in "abcd"], [(h + x, h + "a", "") for x in "bcd"])
    assert hub[h + "a"] == 100 and hub[h + "b"] == 1
    assert score([(h + "a", None)], [(h + "a", h + "a", "")]) == {h + "a": 100}
    nofollow = score([(h + x, None) for x in "abc"], [(h + "b", h + "a", "nofollow"), (h + "c", h + "b", "")])
    assert nofollow[h + "b"] == 100 and nofollow[h + "a"] == 1
    moved = score([(h + "a", None), (h + "b", None), (h + "c", h + "a")], [(h + "b", h + "c", "")])
    assert moved == {h + "a": 100, h + "b": 1}


def test_bypass_cycles(spark):
    names = spark.createDataFrame([(x,) for x in "abcde"], "url string")
    bypass = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "e")], "src string, dst string")
    assert {r["src"]: r["dst"] for r in links_ops.resolve_bypass(names, bypass).collect()} == {"a": "b", "b": "b", "c": "c", "d": "e", "e": "e"}


def test_clusters_of_near_duplicate_content(spark):
    texts = ["the quick brown fox jumps over the lazy dog", "The quick, brown fox jumps over the lazy dog.", "something else entirely is written here today", "", None]
    rows = [(i, t) for i, t in enumerate(texts * 5 + ["alone in all of this is only me", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (2048, 1):
        got = {r["doc_id"]: (r["component_id"], r["pages"], r["similarity"]) for r in links_ops.content_clusters(docs, block=block).collect()}
        assert got == {i: (0, 10, 100) if i % 5 < 2 else (2, 5, 100) for i in range(25) if i % 5 < 3}


def test_depth_and_chains_have_no_limit(spark):
    edges = spark.createDataFrame([(f"u{i}", f"u{i + 1}") for i in range(35)], "source_url string, url string")
    seed = spark.createDataFrame([("u0",)], "url string")
    assert {r["url"]: r["depth"] for r in links_ops.click_depth(edges, seed).collect()} == {f"u{i}": i for i in range(36)}
    hops = [(f"n{i}", f"n{i + 1}") for i in range(20)] + [("x", "y"), ("y", "z"), ("z", "y")]
    names = spark.createDataFrame([(f"n{i}",) for i in range(21)] + [("x",), ("y",), ("z",)], "url string")
    got = {r["src"]: r["dst"] for r in links_ops.resolve_bypass(names, spark.createDataFrame(hops, "src string, dst string")).collect()}
    assert got == {f"n{i}": "n20" for i in range(21)} | {"x": "y", "y": "y", "z": "z"}


def test_keywords(spark):
    tracked = spark.createDataFrame([("u", "Red Shoes", 3, 30), ("u", "none", 1, 1)], "url string, query string, clicks int, impressions int")
    gsc = spark.createDataFrame([("u", "red shoes", 5, 50, 2.0), ("v", "RED SHOES", 7, 70, 4.0)], "url string, query string, clicks int, impressions int, position double")
    s = K.keyword_summary(K.match_tracked(tracked, gsc))
    assert [tuple(r) for r in s.collect()] == [("u", "Red Shoes", 3, 30, 5, 50, 2.0, 3.0)]
    assert K.keyword_headline(s).first()["ctr"] == 10.0
    m = K.gsc_query_match(gsc.withColumn("url", F.concat(F.lit("https://x/"), "url", F.lit("/"))), spark.createDataFrame([("http://y/U",)], "url string")).first()
    assert (m["matches"], m["clicks"], m["queries"]) == (1, 5, "red shoes")
    days = spark.createDataFrame([("a", "2024-01-03", 4), ("a", "2024-01-01", 2), ("b", "2024-01-02", 5), ("b", "2024-01-04", 0), ("c", "2024-01-03", 1), ("d", "2023-01-01", 9)], "k string, date string, n int")
    got = {r["k"]: (r["n_now"], r["n_before"], r["n_change"]) for r in K.compare_periods(days, ["k"], ["n"], "date", "2024-01-03", "2024-01-04").collect()}
    assert got == {"a": (4, 2, 100.0), "b": (0, 5, -100.0), "c": (1, 0, None)}


def test_stores(spark, tmp_path):
    pages = spark.createDataFrame([("u", 1)], "url string, n int")
    for s, n in (("one", 1), ("two", 2), ("one", 3)):
        W.save_snapshot(pages.withColumn("n", F.lit(n)), str(tmp_path / "snap"), s)
    assert [W.load_snapshot(spark, str(tmp_path / "snap"), s).first()["n"] for s in ("one", "two")] == [3, 2]
    W.export_crawl(pages, str(tmp_path / "crawl"), "u.example")
    assert W.import_crawl(spark, str(tmp_path / "crawl")).count() == 1
    base, delta = spark.createDataFrame([("a", 1, 1), ("b", 1, 5)], "url string, v int, seq int"), spark.createDataFrame([("a", 2, 1), ("b", 2, 4)], "url string, v int, seq int")
    assert {r["url"]: r["v"] for r in links_ops.upsert(base, delta).collect()} == {"a": 2, "b": 1}
    history = spark.createDataFrame([("d", "1", 1, 10), ("d", "2", 2, 7)], "domain string, date string, id int, errors int")
    assert [r["errors_delta"] for r in ops.trend(history, ["errors"]).orderBy("id").collect()] == [None, -3]


def test_reports_of_a_speed_test(spark):
    doc = '{"categories":{"performance":{"score":0.5}},"audits":{"interactive":{"numericValue":9}}}'
    df = spark.createDataFrame([("u", "mobile", doc), ("u", "desktop", "{}"), ("v", "mobile", None)], "url string, strategy string, json string")
    assert {r["url"]: (r["performance"], r["seo"]) for r in W.psi_scores(df).collect()} == {"u": (0.5, None), "v": (None, None)}
    assert [(r["tti"], r["fcp"]) for r in W.psi_history(df).filter("strategy = 'mobile' and url = 'u'").collect()] == [(9.0, 0.0)]


def test_search_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"rows": [{"keys": ["q", "u"], "clicks": 1, "impressions": 2, "ctr": 0.5, "position": 3}, {"keys": ["q", "u"], "clicks": 9, "impressions": 2, "ctr": 0.5, "position": 3}]}')
    assert [r["clicks"] for r in W.read_gsc_json(spark, str(tmp_path / "a.json"), "2024-01-01").collect()] == [9]
    (tmp_path / "r.json").write_text('{"prefixes": [{"ipv4Prefix": "1.0.0.0/8"}, {"ipv6Prefix": "2001::/16"}]}')
    assert W.read_ip_ranges(spark, str(tmp_path / "r.json"), "google").count() == 2
    (tmp_path / "t.csv").write_text("date,url,position,clicks,impressions,ctr\n2024-01-01,u,1,2,3,0.1\n,,1,1,1,1\n")
    assert W.read_gsc_table(spark, str(tmp_path / "t.csv")).count() == 1


def test_anchor_text_belongs_to_its_own_link_and_risky_scripts_count():
    from sitelens.sources.html import page_facts

    facts = page_facts("https://h/", "<a href='/1'>one</a><a name='x'>two</a><a href='/2' target='_blank' rel='noreferrer'>th<b>ree</b></a><script>fetch('/x')</script><script>var a = 1</script><script src='s.js'>eval(1)</script>")
    assert [(x["url"], x["anchor_text"]) for x in facts["links"]] == [("https://h/1", "one"), ("https://h/2", "three")]
    assert facts["risky_scripts"] == 1 and facts["unsafe_anchors"] == 1


def test_audit_of_odd_pages(spark):
    from sitelens.operators import audit

    empty = spark.createDataFrame([], audit.WIDE)
    row = spark.createDataFrame([(None,) * 36], audit.WIDE)
    for pages, n in ((empty, 0), (row, 1)):
        assert audit.crawl_summary(pages).first()["pages"] == n and audit.tab_counts(pages).count() == 78
        health = audit.health(audit.crawl_summary(pages)).first()
        assert health["overall"] == (100 if n == 0 else health["overall"]) and audit.issue_report(pages).filter("urls > 1").count() == 0


def test_addresses_read_and_sent(spark):
    from sitelens.functions.urls import display_url, encoded_url

    cases = [("https://a/%C3%A9?x=%26+1", "https://a/é?x=%26+1", "https://a/%C3%A9?x=%2526+1"), ("https://a/%zz", "https://a/%zz", "https://a/%zz"), ("https://a/%ff", "https://a/%ff", "https://a/%ff"), ("https://a/é b", "https://a/é b", "https://a/%C3%A9%20b"), ("https://a/!~'()*$,;", "https://a/!~'()*$,;", "https://a/!~'()*$,;"), ("", "", ""), (None, None, None)]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, u string").select("i", display_url(F.col("u")), encoded_url(F.col("u"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == {i: c[1:] for i, c in enumerate(cases)}


def test_reading_level_of_odd_texts(spark):
    from sitelens.functions.text import heading_hash, reading_class, reading_level

    rows = spark.createDataFrame([(0, None), (1, ""), (2, " . "), (3, "The cat sat. The dog ate!"), (4, "rhythm")], "i int, t string")
    got = {r[0]: (r[1], r[2]) for r in rows.select("i", reading_level(F.col("t")), reading_class(reading_level(F.col("t")))).collect()}
    assert got[0][0] is None and got[1][0] is None and got[0][1] == "Unknown"
    assert abs(got[2][0] - (206.835 - 1.015 / 2 - 84.6)) < 1e-9  # two pieces, one word
    assert abs(got[3][0] - (206.835 - 1.015 * 3 - 84.6 * 7 / 6)) < 1e-9 and got[3][1] == "Unknown"  # "ate!" doesn't end with e
    assert abs(got[4][0] - (206.835 - 1.015 - 84.6)) < 1e-9
    heads = spark.createDataFrame([(0, ["One, two"], None), (1, ["one"], ["TWO!"]), (2, None, ["--"])], "i int, a array<string>, b array<string>").select("i", heading_hash(F.col("a"), F.col("b"))).collect()
    assert heads[0][1] == heads[1][1] is not None and heads[2][1] is None


def test_challenges_need_short_pages(spark):
    from sitelens.operators.audit import challenge_reason

    cases = [("Error 1015", "Cloudflare error 1015"), ("x" * 25_000 + "error 1015", None), ("Access Denied" + "x" * 2_000, None), ("RATE LIMIT", "rate limit"), ("cloudflare", None), ("", None), (None, None)]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, h string").select("i", challenge_reason(F.col("h"))).collect()
    assert {r[0]: r[1] for r in rows} == {i: c[1] for i, c in enumerate(cases)}


def test_cells_in_order(spark):
    from sitelens.operators.audit import cell_order
    from sitelens.operators.pages import ranks

    up = ["9 ms", "1,024 KB", "alpha", "Page 2", "page 10", "\u00c9t\u00e9 3", "etf", "", None]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(up)], "i int, c string")
    order = lambda down: [r["i"] for r in sorted(ranks(rows, *cell_order(F.col("c"), down), F.col("i").asc()).collect(), key=lambda r: r["_r"])]
    assert order(False) == [0, 1, 2, 5, 6, 3, 4, 7, 8]
    assert order(True) == [4, 3, 6, 5, 2, 1, 0, 7, 8]


def test_search_hits(spark):
    from sitelens.operators.audit import search_hits

    pages = spark.createDataFrame([("a", [("r", True), ("r", True), ("s", False)]), ("b", [("r", True), ("s", True)]), ("c", []), ("d", None)], "url string, custom_search array<struct<name: string, matched: boolean>>")
    assert {r["rule"]: r["pages"] for r in search_hits(pages).collect()} == {"r": 2, "s": 1, None: 2}


def test_stores_delete(spark, tmp_path):
    from sitelens.sources import web

    pages = spark.range(3)
    for name in ("one", "two words"):
        web.save_snapshot(pages, str(tmp_path / "s"), name)
    web.drop_snapshot(spark, str(tmp_path / "s"), "two words")
    web.drop_snapshot(spark, str(tmp_path / "s"), "never there")
    assert web.load_snapshot(spark, str(tmp_path / "s"), "one").count() == 3 and web.load_snapshot(spark, str(tmp_path / "s"), "two words").count() == 0
    web.append_rows(spark.createDataFrame([(1, "a", "2024-01-01"), (2, "b", "2024-01-02"), (3, None, "2024-01-03"), (4, "a", "2024-01-03")], "id long, domain string, date string"), str(tmp_path / "h"))
    assert [r["id"] for r in web.read_history(spark, str(tmp_path / "h"), "a").collect()] == [4, 1]
    web.delete_history(spark, str(tmp_path / "h"), str(tmp_path / "h2"), ids=[1], domain="b")
    assert [r["id"] for r in web.read_history(spark, str(tmp_path / "h2")).collect()] == [4, 3]


def test_dangerous_paths(spark):
    rows = one(spark, U.path_danger, ["/.ENV", "/a/.env.prod", "/wp-login.php?x", "/x.php", "/..%2fetc/passwd", "/blog/post", "", None, "/systems", "/a.json"])
    assert [r and tuple(r) for r in rows] == [("Environment file", "sensitive"), ("Environment file", "sensitive"), ("WP login", "exploit"), ("PHP file", "exploit"), ("Path traversal", "exploit"), None, None, None, None, ("JSON config", "config")]
    assert one(spark, U.is_dangerous, ["/.env", "/blog", "", None]) == [True, False, False, False]


def test_panels_of_odd_pages(spark):
    fields = f"{A.WIDE}, {P.MORE}"
    names = StructType.fromDDL(fields).fieldNames()
    given = [{"url": "http://a/x/x/?q=1", "title": "", "description": "d", "h1": ["One", "One", " "], "status_code": 301, "had_redirect": True, "redirect_count": 2, "indexability": 0.0, "opengraph": {"og:title": "x"}, "images": [("u", None, 1, False), ("u", "a", 1, False)], "link_score": 0.0, "cookies": 1}, {"url": "https://a/y", "link_score": 39.5, "language": "fa"}, {}]
    rows = spark.createDataFrame([tuple(g.get(n) for n in names) for g in given], fields)
    got = {(r["panel"], r["label"]): (r["value"], r["percent"]) for r in P.counted(rows).collect()}
    assert got["urlInfo", "Repetitive Path"] == (1, 50) and got["urlInfo", "Total"] == (2, 100) and got["urlInfo", "Internal Search"] == (1, 50)
    assert got["cookies", "Avg. Cookies / Page"] == (0.3, None) and got["linkScore", "Average Link Score"] == (20, None) and got["linkScore", "Weak (1-39)"] == (1, 50)
    assert got["redirects", "Redirect Chains"] == (1, 33) and got["redirects", "Permanent (301/308)"] == (1, 33) and got["images", "Images without Alt Tags"] == (1, None)
    assert got["statusCodes", "Total"] == (1, 100) and got["mobile", "Unknown"] == (3, 100) and got["readability", "Average Reading Ease"] == (None, None)
    h1 = {r["label"]: (r["value"], r["percent"]) for r in P.breakdown(rows, "h1").collect()}
    assert h1 == {"Total": (2, 67), "Missing": (1, 33), "Duplicate H1 Headings": (2, 67), "Over 155 Characters": (0, 0), "Below 70 Characters": (1, 33)}
    assert {r["label"]: r["value"] for r in P.breakdown(rows, "titles").collect()} == {"All": 3, "Over 60 Characters": 0, "Missing Page Title": 2, "Below 30 Characters": 1}
    assert [(r["label"], r["value"]) for r in P.breakdown(rows, "language").collect()] == [("Total Pages", 3), ("FA", 1), ("No Language", 2)]
    assert {r["value"] for r in P.counted(rows.limit(0), ["canonicals", "summary"]).collect()} == {0}
    tree = {(r["element"], r["filter"]): (r["urls"], r["percent"]) for r in P.overview(rows.limit(0)).collect()}
    assert len(tree) == 65 and set(tree.values()) == {(0, None)}


# ---------------------------------------------------------------- graphs of real anchors


MOVES = "n int, url string, status_code int, canonical string, original_url string, redirect_chain array<string>"


def _bypass(spark, rows):
    return {r.src: r.dst for r in links_ops.bypass_of(spark.createDataFrame(rows, MOVES), "n").collect()}


def test_redirect_bypasses_to_final_target(spark):
    h = "https://s/"
    assert _bypass(spark, [(1, h + "new", 200, None, h + "old", [h + "hop", h + "new", None])]) == {h + "old": h + "new", h + "hop": h + "new"}
    rows = [(1, h + "new", 200, None, h + "old", [h + "hop"]), (2, h + "x", 200, None, None, None)]
    pages = spark.createDataFrame(rows, MOVES)
    links = spark.createDataFrame([(h + "x", h + "old", None, 0), (h + "x", h + "hop", None, 1)], "source_url string, url string, rel string, slot int")
    assert {r.url: r.score for r in links_ops.link_score(pages, links, order="n").collect()} == {h + "new": 100, h + "x": 1}


def test_rows_of_bypasses_count_in_order(spark):
    h = "https://s/"
    a, b, c, d = (h + x for x in "abcd")
    assert _bypass(spark, [(1, b, 200, None, None, [a]), (2, c, 200, None, None, [a])]) == {a: b}  # the first hop holds
    assert _bypass(spark, [(1, b, 200, None, None, [a]), (2, c, 200, None, a, None)]) == {a: c}  # an original address replaces it
    assert _bypass(spark, [(1, c, 200, None, a, None), (2, b, 200, None, None, [a])]) == {a: c}  # and no later hop replaces that
    assert _bypass(spark, [(1, b, 200, None, a, None), (2, c, 200, None, a, None)]) == {a: c}  # the last original address holds
    assert _bypass(spark, [(1, a, 200, d, None, None), (2, b, 200, None, a, None)]) == {a: b}
    assert _bypass(spark, [(2, a, 200, d, None, None), (1, b, 200, None, a, None)]) == {a: d}
    assert _bypass(spark, [(1, a, 200, a + "#x", a, [a]), (2, None, 200, None, None, None)]) == {}


def test_edges_are_shuffled_once_for_all_rounds(spark):
    from pyspark.sql import functions as F

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = spark.range(3000).select((F.col("id") % 97).cast("string").alias("s"), (F.col("id") % 89).cast("string").alias("t"), F.lit(0.01).alias("w"))
    eligible = spark.range(97).select(F.col("id").cast("string").alias("url"))
    kept = [links_ops.partitioned(eligible, "url", parts), links_ops.partitioned(e, "s", parts)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = links_ops.damped_rounds(*kept, 97, 10, 0.85)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "REPARTITION" not in line]
    assert len(shuffles) == 10 and all("hashpartitioning(t#" in line for line in shuffles)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for x in kept:
        x.unpersist()


def test_edges_of_pages(spark):
    from sitelens.sources.html import extract_pages

    html = '<a href="/x#f">one <b>two</b></a><a>no</a><a href="https://other.example/y" rel="nofollow">z</a>'
    pages = spark.createDataFrame([(1, "https://s.example/p", html), (2, "https://s.example/q", None), (3, None, html)], "id int, url string, html string")
    got = links_ops.page_edges(extract_pages(pages, "id"), "id").filter("id < 3").orderBy("slot").collect()
    assert [(r.id, r.source_url, r.url, r.anchor_text, r.rel, r.internal, r.slot) for r in got] == [(1, "https://s.example/p", "https://s.example/x#f", "one two", None, True, 0), (1, "https://s.example/p", "https://other.example/y", "z", "nofollow", False, 1)]
    assert links_ops.page_edges(extract_pages(pages.limit(0))).count() == 0


def test_the_audit_parses_pages_once(spark, sf_dir):
    from sitelens.operators import audit
    from sitelens.plans import inputs

    for make in (audit.tab_counts, audit.issue_report):
        plan = make(inputs.audit_pages(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInPandas" not in plan


# ---------------------------------------------------------------- sitemaps, vitals, indexability


def test_sitemap_entries_by_the_xml_source(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<?xml version='1.0'?>\n<urlset xmlns='x' xmlns:image='y'>\n<url>\n <loc>\n https://s/ü?a=1&amp;b=2\n</loc><image:image><image:loc>https://s/i.png</image:loc></image:image></url><url><loc><![CDATA[https://s/b]]></loc></url><url><lastmod>x</lastmod></url><url><loc> </loc></url></urlset>")
    (tmp_path / "c.xml").write_text('<sm:sitemapindex xmlns:sm="q"><sm:sitemap><sm:loc>https://s/c.xml</sm:loc></sm:sitemap></sm:sitemapindex>')
    (tmp_path / "d.xml").write_text("<!doctype html>\n<HTML><body><url><loc>https://no</loc></url></body></HTML>")
    (tmp_path / "e.xml").write_text("")
    got = {(r.kind, r.loc, r.file.rsplit("/", 1)[1]) for r in W.sitemap_entries(spark, str(tmp_path)).collect()}
    assert got == {("page", "https://s/ü?a=1&b=2", "a.xml"), ("page", "https://s/b", "a.xml"), ("sitemap", "https://s/c.xml", "c.xml")}


def test_unread_sitemaps_are_estimated(spark):
    import random

    def measured(entries, read):
        e = spark.createDataFrame(entries, "kind string, loc string, file string")
        return tuple(W.estimated_size(e, spark.createDataFrame([(x,) for x in read], "file string"), 50, 100).first())

    rng = random.Random(3)
    for _ in range(6):
        read = [f"s{i}" for i in range(rng.randrange(1, 6))]
        index = read[: rng.randrange(2)]
        entries = [("page", f"u{i}", rng.choice([x for x in read if x not in index] or ["s9"])) for i in range(rng.randrange(40))] if len(read) > len(index) else []
        children = [f"s{rng.randrange(20)}" for _ in range(rng.randrange(30))] if index else []
        entries += [("sitemap", c, index[0]) for c in children]
        leaves, pages = len(read) - len({f for k, _, f in entries if k == "sitemap"}), sum(k == "page" for k, *_ in entries)
        unread = len(set(children) - set(read))
        urls = pages + (unread * max(1, pages // leaves) if leaves else 0)
        verdict = "ok" if not entries else "refuse" if urls > 100 else "warn" if urls > 50 else "ok"
        assert measured(entries, read) == (leaves, pages, unread, urls, bool(entries), verdict)
    assert measured([], []) == (0, 0, 0, 0, False, "ok")
    assert measured([("sitemap", f"c{i}", "i") for i in range(101)] + [("page", "u", "l")], ["i", "l", "empty"])[3:] == (102, True, "refuse")  # one page at least each


def test_vitals_of_odd_reports(spark):
    one = '{"Ok":[{"categories":{"performance":{"score":0.935},"seo":{"score":1},"accessibility":{"score":null}},"audits":{"speed-index":{"displayValue":"1.2 s","numericValue":1200},"largest-contentful-paint":{"numericValue":2345.678},"redirects":{"score":0},"dom-size":{"displayValue":""},"interactive":{"displayValue":3,"numericValue":7}}},{"categories":{"performance":{"score":"x"}}}]}'
    rows = {r.url: r for r in W.vitals(spark.createDataFrame([("a", one), ("b", None), ("c", "{"), ("d", '{"Err":"no"}'), (None, '{"Ok":[]}')], "url string, psi_results string")).collect()}
    a = rows["a"]
    assert len(a) == 27 and (a.perf_m, a.seo_m, a.acc_m, a.bp_m, a.perf_d) == ("94", "100", "n/a", "n/a", "n/a")
    assert (a.speed_index_m, a.lcp_m, a.redirects, a.dom_nodes, a.interactive_m, a.speed_index_d) == ("1.2 s", "2345.68", "0", "", "7.00", "n/a")
    assert all(set(rows[k][1:]) == {"n/a"} for k in ("b", "c", "d", ""))


def test_indexability_in_full(spark):
    from sitelens.operators import pages as P

    rows = [
        (0, "https://s/p", 404, None, None, None), (1, "https://s/p", 204, None, None, None), (2, "https://s/p", 200, ["googlebot: noindex"], None, ["/x"]), (3, "https://s/p", 200, ["otherbot: noindex"], [("RobotS ", "None;")], None),
        (4, "https://s/p", 200, None, [("otherbot", "noindex")], ["/p", "/p"]), (5, "https://s/p", 200, None, None, ["../p#x"]), (6, "https://s/p", 200, ["nofollow"], None, ["//t/"]), (7, "https://s/p", 200, ["unavailable_after: noindex", "\"NoFollow\""], None, []),
        (8, "https://s/p", 200, None, [("bingbot", "all")], None), (9, "https://s/p", 200, [None], [("robots", None)], None), (10, None, 200, None, None, ["/x"]), (11, None, None, None, None, None),
    ]
    got = P.page_indexability(spark.createDataFrame(rows, "n int, url string, status_code int, x_robots array<string>, robots_meta array<struct<name:string,content:string>>, canonicals array<string>")).orderBy("n").collect()
    assert [r.indexability for r in got] == [0, 0, 0, 0, 0, 1, 0, 0.8, 1, 1, 0.5, 0]
    said = [r.reason.split(": ", 1)[1] for r in got]
    assert said[2:10] == ["X-Robots-Tag contains noindex", "meta robots contains noindex", "multiple canonical links found", "self-referencing canonical", "canonical points to https://t/", "nofollow directive present", "explicit index directive present", "successful response with no blocking directive"]
