"""Access logs: line parsing, functions, joins, filters, stores and streams on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sitelens.functions import logs as L
from sitelens.operators import logs as ops
from sitelens.plans import inputs as I
from sitelens.sources import logs as src
from sitelens.streaming import rollups

GOOD = '1.2.3.4 - - [02/Jan/2024:03:04:05 +0200] "GET /a/b?x=1 HTTP/1.1" 200 512 "-" "curl/8"'


def one(spark, column, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", column(F.col("v")).alias("o")).orderBy("i").collect()]


def test_lines(spark, tmp_path):
    bad = ["", GOOD.replace("512", "-"), GOOD.replace("GET", "CONNECT"), GOOD.replace("Jan", "Foo"), GOOD.rsplit(' "', 1)[0], GOOD.replace("03:04:05", "99:04:05")]
    (tmp_path / "a.log").write_text("\n".join([GOOD, *bad, GOOD.replace('"-"', '"http://r/"') + " tail"]))
    rows = src.read_access_logs(spark, str(tmp_path)).orderBy(F.col("referer").asc_nulls_first()).collect()
    assert len(rows) == 2
    r = rows[0]
    assert (r["ip"], r["path"], r["status"], r["response_size"], r["referer"], r["user_agent"], r["filename"]) == ("1.2.3.4", "/a/b", 200, 512, None, "curl/8", "a.log")
    assert r["ts"] == dt.datetime(2024, 1, 2, 3, 4, 5) and r["hour"] == "2024-01-02 03:00:00" and rows[1]["referer"] == "http://r/"


def test_round_trip_of_derived_hits(spark, sf_dir, tmp_path):
    hits = I.hits(spark, sf_dir).filter("response_size >= 0 and path not like '%?%'")
    src.format_lines(hits).write.text(str(tmp_path / "logs"))
    back = src.read_access_logs(spark, str(tmp_path / "logs"))
    keys = ["ip", "method", "path", "status", "response_size", "user_agent", "day"]
    assert back.count() == hits.count() and back.select(*keys).exceptAll(hits.select(*keys)).count() == 0


def test_detect_bot(spark):
    cases = {None: "No User Agent", " - ": "No User Agent", "": "No User Agent", "x Googlebot/2.1": "Google Bot", "a bingbot/2": "Bing", "Mozilla (compatible; AcmeSpider/3.1; +x)": "AcmeSpider/3.1", "My-Uptime/1 x": "Uptime/1", "Mozilla Firefox/1": "Human", "python-requests": "Python Bot"}
    assert one(spark, L.detect_bot, list(cases)) == list(cases.values())
    assert one(spark, L.browser, ["Mozilla/5.0 Chrome/1.2 Safari/3", "X Edg/1", "Opera/9"]) == ["Chrome", "Other", "Opera"]
    assert one(spark, L.file_type, ["/a.PNG", "/", "/x", "/a.htm", "/a.woff2", "/a.exe", "/.env"]) == ["Image", "HTML", "HTML", "HTML", "Font", "Unknown", "Unknown"]
    assert one(spark, L.country, ["66.1.1.1", "163.2.2.2", "9.9.9.9", "::1"]) == ["US", "NL", "Unknown", "Unknown (IPv6)"]
    assert one(spark, L.norm_path, [" HTTPS://H.x/A//b/?q#f", "a", "///", "/x///"]) == ["/a/b", "/a", "/", "/x"]


def test_classify_takes_the_longest_rule(spark):
    df = spark.createDataFrame([("/blog/tag/x",), ("/blog/y",), ("/my-product",), ("/",), ("/Blog/",)], "path string")
    got = [tuple(r) for r in df.select(*[c.alias(k) for k, c in L.classify(F.col("path"), I.RULES).items()]).collect()]
    assert got == [("Tags", "startsWith", "/blog/tag/"), ("Blog", "startsWith", "/blog/"), ("Shop", "contains", "product"), ("Home", "exactMatch", "/"), ("Other", None, "other")]


def test_ranges_and_verification(spark):
    cidrs = spark.createDataFrame([("google", "66.249.64.0/19"), ("google", "2001:4860:4801::/48"), ("bing", "10.0.0.8/29"), ("bing", "nonsense"), ("bing", "1.2.3.4/99")], "family string, cidr string")
    assert ops.ranges(cidrs).count() == 3
    ips = {("66.249.95.255", "Google Bot"): True, ("66.249.96.0", "Google Bot"): False, ("66.249.63.255", "Google Bot"): False, ("2001:4860:4801::9", "Google Bot"): True, ("2001:4860:4802::", "Google Bot"): False, ("10.0.0.15", "Bing"): True, ("10.0.0.16", "Bing"): False, ("10.0.0.9", "Human"): False, ("not an ip", "Bing"): False}
    hits = spark.createDataFrame([k for k in ips], "ip string, crawler_type string")
    assert {(r["ip"], r["crawler_type"]): r["verified"] for r in ops.with_verified(hits, cidrs).collect()} == ips


def test_filters_match_their_meaning(spark, sf_dir):
    hits = I.enriched(spark, sf_dir)
    n = hits.count()
    parts = [ops.apply_filters(hits, ops.Filters(bot=b)).count() for b in ("bot", "Human")]
    assert sum(parts) == n and all(parts)
    assert ops.apply_filters(hits, ops.Filters()).count() == n
    assert ops.apply_filters(hits, ops.Filters(search="nothing-like-this")).count() == 0


def test_project_store(spark, tmp_path):
    for project in ("a", "b"):
        src.append_project_logs(spark.createDataFrame([(GOOD, f"{project}.log")], "value string, filename string"), str(tmp_path / "store"), project)
    assert [r["filename"] for r in src.logs_by_project(spark, str(tmp_path / "store"), "b").collect()] == ["b.log"]
    src.export_csv(ops.rollup(ops.enrich(src.logs_by_project(spark, str(tmp_path / "store"), "a"), I.RULES), "status"), str(tmp_path / "out"), ["-hit_count"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1


@pytest.mark.parametrize("width", ["1 hour", "1 day"])
def test_stream_equals_batch(spark, sf_dir, tmp_path, width):
    hits = I.hits(spark, sf_dir)
    src.format_lines(hits).repartition(3).write.text(str(tmp_path / "logs"))
    stream = ops.enrich(src.stream_access_logs(spark, str(tmp_path / "logs"), 1), I.RULES)
    q = rollups.stream_timeline(stream, width, "400 days").writeStream.outputMode("complete").format("memory").queryName(f"t{width[2:]}").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {str(r["start"]): (r["human"], r["crawler"]) for r in spark.sql(f"select * from t{width[2:]}").collect()}
    batch = ops.timeline(ops.enrich(src.read_access_logs(spark, str(tmp_path / "logs")), I.RULES), width[2:], None).collect()
    assert got == {r["date"] if width == "1 hour" else r["date"] + " 00:00:00": (r["human"], r["crawler"]) for r in batch}


def test_partial_rollups_of_a_stream(spark, sf_dir, tmp_path):
    src.format_lines(I.hits(spark, sf_dir)).repartition(4).write.text(str(tmp_path / "logs"))
    stream = ops.enrich(src.stream_access_logs(spark, str(tmp_path / "logs"), 1), I.RULES)
    rollups.write_rollup(stream, "status", str(tmp_path / "parts"), str(tmp_path / "cp")).awaitTermination()
    want = ops.rollup(ops.enrich(src.read_access_logs(spark, str(tmp_path / "logs")), I.RULES), "status")
    assert {tuple(r) for r in rollups.read_rollup(spark, "status", str(tmp_path / "parts")).collect()} == {tuple(r) for r in want.collect()}


def test_states_of_a_stream_equal_the_batch_after_replays(spark, tmp_path):
    keys = ["path", "segment"]
    kind = "ts string, path string, segment string, crawled boolean"
    rows = [(f"2024-01-01 00:{i % 60:02d}", f"/p{i % 7}", "S" if i % 3 else None, None if i % 5 == 0 else i % 11 == 0) for i in range(230)]
    folder = str(tmp_path / "states")
    for n in range(23):
        part = spark.createDataFrame(rows[n * 10 : n * 10 + 10], kind)
        if n % 4 == 1:  # a try that failed half-way
            rollups.save_states(part.limit(3), n, keys, folder, every=5)
        rollups.save_states(part, n, keys, folder, every=5)
        if n in (5, 10):  # and one whose compaction had been done
            rollups.save_states(part, n, keys, folder, every=5)
    got = sorted([tuple(r) for r in rollups.read_states(spark, keys, folder).collect()], key=str)
    assert got == sorted([tuple(r) for r in rollups.states(spark.createDataFrame(rows, kind), keys).collect()], key=str) and sum(r[2] for r in got) == 230
    assert sorted(p.name for p in (tmp_path / "states").iterdir()) == ["base=19", "batch=20", "batch=21", "batch=22"]
    rollups.compact(spark, keys, folder, 19)
    rollups.compact(spark, keys, folder, 22)
    assert [p.name for p in (tmp_path / "states").iterdir()] == ["base=22"]
    assert sorted([tuple(r) for r in rollups.read_states(spark, keys, folder).collect()], key=str) == got
    assert rollups.read_states(spark, keys, str(tmp_path / "none")) is None


def test_states_of_log_files(spark, sf_dir, tmp_path):
    lines = [f'10.0.0.{i % 9} - - [01/Jan/2024:00:00:{i % 60:02d} +0000] "GET /p{i % 4} HTTP/1.1" 200 5 "-" "curl/8"' for i in range(90)]
    (tmp_path / "logs").mkdir()
    for i in range(6):
        (tmp_path / "logs" / f"{i}.log").write_text("\n".join(lines[i * 15 : i * 15 + 15]) + "\n")
    known = lambda df: df.withColumn("crawled", F.col("path") == "/p1")
    for _ in range(2):  # nothing new the second time
        rollups.write_states(known(src.stream_access_logs(spark, str(tmp_path / "logs"), 1)), ["path"], str(tmp_path / "s"), str(tmp_path / "cp"), 4).awaitTermination()
    got = {r.path: (r.hits, r.crawled) for r in rollups.read_states(spark, ["path"], str(tmp_path / "s")).collect()}
    assert got == {f"/p{i}": (sum(j % 4 == i for j in range(90)), i == 1) for i in range(4)}
    assert len(list((tmp_path / "s").iterdir())) <= 4
