"""Rules by automaton, and the trend tables and sheets."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitelens.functions import automaton as A
from sitelens.functions import logs as L
from sitelens.functions import tables as T
from sitelens.operators import logs as ops
from sitelens.plans import inputs as I


def plain(path, rules):
    """The longest rule that fits, ties in order."""
    if path is not None:
        for p, m, n in sorted(rules, key=lambda r: -len(r[0].encode())):
            if p in path if m == "contains" else path == p if m == "exactMatch" else path.startswith(p):
                return n, m, p
    return "Other", None, "other"


def test_five_thousand_rules_by_automaton(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abé/_%.") for _ in range(rng.randrange(1, 7)))
    rules = [("/" * rng.randrange(2) + word(), rng.choice(["contains", "startsWith", "exactMatch", "glob"]), f"n{i}") for i in range(5000)]
    paths = ["/" + word() + word() + word() for _ in range(3000)] + [r[0] for r in rules[:200]] + [None, "", "/", "%", "é"] * 3
    hits = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "id long, path string")
    got = ops.classified(hits, rules).orderBy("id").collect()
    assert [(r.segment, r.segment_match, r.taxonomy) for r in got] == [plain(p, rules) for p in paths]
    few = rules[:150] + [("", "contains", "any"), ("", "exactMatch", "none")]
    chain, auto = hits.withColumns(L.classify(F.col("path"), few)), hits.withColumn("c", A.classify_many(F.col("path"), few))
    expected = [(r.segment, r.segment_match, r.taxonomy) for r in chain.filter("path is not null").orderBy("id").collect()]
    assert [tuple(r.c) for r in auto.filter("path is not null").orderBy("id").collect()] == expected


def test_a_distinct_value_is_looked_at_once():
    finder = A.FirstMatch([("b", "contains"), ("a", "startsWith")])
    seen = []
    finder.rank = lambda v: seen.append(v) or A.FirstMatch.rank(finder, v)
    assert finder.ranks(pd.Series(["ab", "ac", None, "ab", "x"] * 100)).tolist() == [0, 1, 2, 0, 2] * 100
    assert sorted(seen) == ["ab", "ac", "x"]
    assert A.FirstMatch([]).ranks(pd.Series(["a", None])).tolist() == [0, 0]


def test_agents_by_automaton_as_by_list(spark, monkeypatch):
    words = [k for k, _ in T.BOTS] + list(T.GENERIC_BOTS) + list(T.BROWSERS)
    agents = [f"Mozilla/5.0 ({w.title()}/2.1; x)" for w in words] + [f"{a} {b}" for a, b in zip(words, reversed(words))] + [None, "", " - ", "-", "plain", "My-Rocket Bot/1 x"]
    rows = spark.createDataFrame([(a,) for a in agents], "user_agent string")
    ua = F.col("user_agent")
    got = rows.select(L.detect_bot(ua).alias("a"), A.detect_bot(ua).alias("b"), L.browser(ua).alias("c"), A.browser(ua).alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in got)
    monkeypatch.setattr(ops, "AGENTS", 3)
    named = ops.with_agents(rows)
    assert named.count() == len(agents) and "ArrowEvalPython" in named._jdf.queryExecution().executedPlan().toString()


def test_reclassify_replaces_and_refuses_too_many(spark, monkeypatch):
    hits = spark.createDataFrame([("/a/b", "Old", "contains", "/a"), (None, "Old", None, None)], "path string, segment string, segment_match string, taxonomy string")
    rules = spark.createDataFrame([("/a", "startsWith", "First", 2), ("/b", "contains", "Second", 1), (None, "contains", "no", 0), ("/x", "contains", None, 0)], "path string, match_type string, name string, rank int")
    got = ops.reclassify(hits, rules).collect()
    assert [(r.path, r.segment, r.taxonomy) for r in got] == [("/a/b", "Second", "/b"), (None, "Other", "other")]
    monkeypatch.setattr(ops, "RULES", 1)
    with pytest.raises(ValueError):
        ops.reclassify(hits, rules)


def test_trend_sheets_are_written_in_order(spark, sf_dir, tmp_path):
    rollups = ops.trend_rollups(I.enriched(spark, sf_dir))
    rows = ops.trend_sheets(rollups)
    ops.write_sheets(rows, f"{tmp_path}/sheets", [F.when(F.col("sheet") != "Timeline", -F.col("hits")), F.col("key1"), F.col("key2"), F.col("key3")], ranges=5)
    back = spark.read.option("header", True).csv(f"{tmp_path}/sheets")
    assert back.count() == rows.count() and {r.sheet for r in back.select("sheet").distinct().collect()} == set(ops.TREND_SHEETS)
    for sheet in ops.TREND_SHEETS:
        folder = tmp_path / "sheets" / f"sheet={sheet.replace(' ', '%20')}"
        folder = folder if folder.exists() else tmp_path / "sheets" / f"sheet={sheet}"
        lines = [x for f in sorted(folder.glob("*.csv")) for x in f.read_text().splitlines()[1:]]
        keys = [line.split(",")[0] if sheet == "Timeline" else -int(line.split(",")[-1 if not line.endswith(",") else -2].strip('"') or 0) for line in lines]
        assert keys == sorted(keys), sheet


def test_trend_totals_read_the_hits_once(spark, sf_dir):
    hits = I.enriched(spark, sf_dir)
    totals = ops.trend_totals(hits, I.crawl_list(spark, sf_dir), ops.trend_rollups(hits))
    plan = totals._jdf.queryExecution().optimizedPlan().toString()
    assert len(totals.columns) == 27 and plan.count("events.parquet") + plan.count("event_id") // 100 <= 3
    row = totals.first()
    assert row.ip_hits == hits.count() == row.status_hits and row.path_hits + row.human_hits == row.ip_hits
    empty = ops.trend_totals(hits.limit(0), I.crawl_list(spark, sf_dir).limit(0)).first()
    assert set(empty) == {0}


# ---------------------------------------------------------------- selectors and custom search


HTML = """<html><body class="a main"><div id="top" data-x="en-US"><ul><li>one <b>1</b></li><li class="hit x">two</li></ul></div>
<div><p>para<script>let y</script></p><img src="i.png" alt="A"><p lang="en">open <i>x</div><section><ul><li>far</section><em>rest"""


@pytest.mark.parametrize("selector,expected", [
    ("li", "one 1"), ("LI.hit", "two"), ("li.x.hit", "two"), (".a.main #top li.hit", "two"), ("#top > li", None), ("#top > ul > li", "one 1"), ("body>div > p", "paralet y"), ("div div p", None), ("section li", "far"),
    ("[data-x]", "one 1two"), ('[data-x="en-US"] b', "1"), ("[data-x|=en] b", "1"), ("[class~=main] b", "1"), ("[class^=hit]", "two"), ("[class$=' x']", "two"), ("[class*='t x']", "two"), ("[class^='']", None), ("[lang]", "open x"),
    ("i", "x"), ("em", "rest"), ("h1, h2, b", "1"), ("*", None), ("#nope", None), ("img", ""), ("[data-y='a,b'], b", "1"),
])
def test_first_elements_of_selectors(selector, expected):
    from sitelens.sources import html as H

    found = H.page_facts("https://s/", HTML, [H.Rule(1, "r", "css", selector)])["custom_search"][0]
    if selector == "*":
        assert found["matched"] and found["value"].startswith("one 1two")
    else:
        assert (found["value"], found["matched"]) == (expected, expected is not None)


def test_targets_of_rules():
    from sitelens.sources import html as H

    def of(**rule):
        r = H.page_facts("https://s/", HTML, [H.Rule(1, "r", **{"mode": "css", "pattern": "li"} | rule)])["custom_search"][0]
        return r["matched"], r["value"]

    assert of(target="html") == (True, "<li>one <b>1</b></li>")
    assert of(pattern="img", target="html") == (True, '<img src="i.png" alt="A">')
    assert of(pattern="section ul", target="html") == (True, "<ul><li>far")  # ends where what is around it ends
    assert of(pattern="em", target="html") == (True, "<em>rest")
    assert of(pattern="img", target="attribute", attribute="ALT") == (True, "A")
    assert of(pattern="img", target="attribute", attribute="none") == (False, None) == of(pattern="img", target="attribute")
    assert of(search_text="one") == (True, "one 1") and of(search_text="zzz") == (False, "one 1") and of(search_text="") == (True, "one 1")
    assert of(pattern="a[") == (False, None) == of(pattern="li:first-child") == of(pattern="") == of(mode="regex", pattern="(")
    assert of(mode="regex", pattern="t(w)o") == (True, "w") and of(mode="regex", pattern="t(x)?wo") == (True, "two") and of(mode="regex", pattern="let y") == (False, None)
    assert H.cut("é" * 150) == "é" * 150 and H.cut("é" * 151) == "é" * 150 + "..." and H.cut("x" + "é" * 150) == "x" + "é" * 149 + "..."


def test_rule_store_and_results(spark, tmp_path):
    from sitelens.sources import html as H
    from sitelens.sources import web

    store = f"{tmp_path}/rules"
    row = lambda i, pattern, enabled=True, mode="css": (i, f"n{i}", mode, pattern, "text", None, None, enabled)
    put = lambda rows, **more: web.put_rules(spark.createDataFrame(rows, H.RULE), store, **more)
    put([row(1, "h1"), row(2, "b"), row(3, "i"), row(4, "never.x")])
    put([row(2, "p")])
    put([row(1, "h1", False)])
    put([row(3, "i")], deleted=True)
    assert [(r.id, r.pattern, r.enabled) for r in web.read_rules(spark, store).collect()] == [(1, "h1", False), (2, "p", True), (4, "never.x", True)]
    pages = spark.createDataFrame([(7, "u", "<h1>t</h1><p>x</p>"), (8, "v", None)], "id int, url string, html string")
    got = H.custom_results(pages, web.read_rules(spark, store), "id").orderBy("id", "rule_id").collect()
    assert [tuple(r) for r in got] == [(7, "u", 2, "n2", True, "x"), (7, "u", 4, "n4", False, None), (8, "v", 2, "n2", False, None), (8, "v", 4, "n4", False, None)]
    assert H.custom_results(pages, web.read_rules(spark, store).limit(0)).count() == 0
    with pytest.raises(ValueError):
        H.enabled_rules(web.read_rules(spark, store), 1)


def test_crawl_tables_are_written_by_one_job(spark, tmp_path):
    import csv

    from sitelens.operators import exports as X
    from sitelens.sources.html import extract_pages

    html = '<title>Say "hi", you</title><link rel="stylesheet" href="/s.css"><a href="/a.pdf?x#y" title="T" target="_blank">one\ntwo</a><a href="/b" rel="nofollow">b</a><img src="/i.PNG" alt="pic">'
    pages = spark.createDataFrame([("https://s/1", html), ("https://s/2", None)], "url string, html string")
    hop = F.struct(F.lit("https://s/0").alias("url"), F.lit(302).alias("status_code"), F.lit("https://s/1").alias("location"))
    rows = extract_pages(pages).withColumns({"redirect_chain": F.when(F.col("url") == "https://s/1", F.array(hop)), "link_statuses": F.create_map(F.lit("https://s/b"), F.lit(404)), "keywords_top": F.array(F.struct(F.lit("w").alias("word"), F.lit(3).alias("n")))})
    X.write_tables(X.crawl_tables(rows), f"{tmp_path}/t", ranges=4)
    got = {}
    for kind, header in X.TABLES.items():
        lines = [x for f in sorted((tmp_path / "t" / f"kind={kind}").glob("*.txt")) for x in f.read_text().splitlines()]
        got[kind] = list(csv.reader(lines))
        assert got[kind][0] == header and all(len(r) == len(header) for r in got[kind])
    assert [r[1] for r in got["main"][1:]] == ['Say "hi", you', ""] and got["main"][1][16:18] == ["", "Indexable"]
    assert sorted(got["links"][1:]) == sorted([["one two", "", "https://s/a.pdf?x#y", "T", "_blank", "", "https://s/1"], ["b", "nofollow", "https://s/b", "", "", "404", "https://s/1"]])
    assert got["files"][1:] == [["https://s/a.pdf?x#y", "PDF", "https://s/1"]] and got["css"][1:] == [["https://s/s.css"]]
    assert got["images"][1:] == [["https://s/i.PNG", "pic", "", "PNG", ""]] and got["redirects"][1:] == [["https://s/0", "302", "https://s/1", "1", "302 Redirect"]]
    assert got["keywords"][1][:3] == ["https://s/1", "w", "3"] and len(got["keywords"]) == 3
    few = spark.createDataFrame([("u",)], "url string")
    assert [r.kind for r in X.crawl_tables(few).collect()] == ["main", "keywords"] and X.crawl_tables(few.limit(0)).count() == 0


def test_charts_of_odd_pages(spark):
    from sitelens.operators import charts as Ch
    from sitelens.operators import links as Li

    kind = "url string, status_code int, kb int, css array<string>, javascript array<string>, images array<struct<url:string>>, had_redirect boolean, schema string, mobile boolean, indexability double, reason string"
    rows = [("https://s/a/b", 200, 10, ["x", "x", None], None, [("i",)], True, "T", True, 1.0, "r"), ("https://s/a/b?q", 404, None, ["x", "y"], ["j"], None, None, None, None, None, None), ("http://s", None, 2000, None, [], [], False, "", False, 0.0, "r"), (None, 301, None, None, None, None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, kind)
    assert {tuple(r) for r in Ch.asset_mix(pages).collect()} == {("Pages", 4), ("Redirects", 2), ("CSS", 2), ("JavaScript", 1), ("Images", 1)}
    assert {tuple(r) for r in Ch.page_weights(pages).collect()} == {("Light (<100KB)", 1, 1005), ("Very Heavy (>1MB)", 1, 1005)}
    assert {tuple(r) for r in Ch.compliance(pages).collect()} == {("https", 2, 50.0), ("schema", 1, 25.0), ("mobile", 1, 25.0)}
    tree = {r.node: tuple(r)[1:] for r in Ch.url_tree(pages).collect()}
    assert tree == {"root": (0, True, 2, None, False), "root/a": (1, False, 2, None, None), "root/a/b": (2, True, 0, 404, True)}
    assert tuple(Ch.url_tree_totals(Ch.url_tree(pages)).first()) == (2, 1, 2)
    assert [tuple(r) for r in Ch.top_reasons(pages, 1).collect()] == [("Unknown", 2)]
    none = pages.limit(0)
    assert Ch.asset_mix(none).count() == Ch.page_weights(none).count() == Ch.treemap(none).count() == 0 and tuple(Ch.url_tree_totals(Ch.url_tree(none)).first()) == (0, 0, 0)
    links = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a"), ("c", "a"), ("c", "a"), ("a", "a"), (None, "a"), ("d", "b")], "source_url string, url string")
    depths = spark.createDataFrame([("r", 0), ("a", 1), ("zz", -1), ("b", None)], "url string, depth int")
    nodes, edges = Li.link_graph(links, depths, 2)
    assert {tuple(r) for r in nodes.collect()} == {("a", 3, 1, 4), ("r", 0, 1, 1)} and [tuple(r) for r in edges.collect()] == [("r", "a")]


def test_searches_by_trigrams_find_what_scans_find(spark, tmp_path):
    from sitelens.operators import search as S

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aAbBcé/. ") for _ in range(rng.randrange(9)))
    rows = [(i, rng.choice([word(), None]), word() + "/Blog/post-" + str(i % 50) if i % 3 else word()) for i in range(2000)]
    table = spark.createDataFrame(rows, "id long, a string, b string")
    S.write_index(table, "id", ["a", "b"], f"{tmp_path}/index")
    for term in ["Blog/Post-1", " blog/post-49 ", "abc", "é/.", "ab", "", "zzz", "st-", "/blog"]:
        low = term.strip().lower()
        want = [i for i, a, b in rows if low in (a or "").lower() and a is not None or low in b.lower()]
        assert sorted(r.id for r in S.search_rows(table, "id", ["a", "b"], f"{tmp_path}/index", term).collect()) == want, term
    found = S.candidates(spark, f"{tmp_path}/index", "blog/post-49")
    read = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in read.replace("[isnotnull(bucket", "[bucket") or "PartitionFilters: [" in read
    some = spark.read.parquet(f"{tmp_path}/index")
    buckets = {r.bucket for r in some.filter(F.col("gram").isin([t for t in ("blo", "log", "og/", "g/p", "/po", "pos", "ost", "st-", "t-4", "-49")])).select("bucket").distinct().collect()}
    assert some.filter(F.col("bucket").isin(list(buckets))).count() < some.count() / 2 and found.count() < 60  # what is read, and what is looked through
