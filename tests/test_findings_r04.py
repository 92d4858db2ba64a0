"""Tests of what the review of round 4 found."""


def test_a_dead_target_names_all_pages_that_link_there(spark):
    from sitelens.operators.links import broken_links

    n = 1200
    rows = [(f"https://s/{i:05}", "https://s/gone", 404, "HTTP Error: 404") for i in reversed(range(n))] * 2
    rows += [("https://s/1", "https://s/odd", None, "No response"), (None, "https://s/odd", 500, None), (None, "https://s/none", 410, None), ("https://s/1", None, 404, None), ("https://s/1", "https://s/there", 200, None), ("https://s/2", "https://s/there", None, None)]
    found = {r["url"]: r for r in broken_links(spark.createDataFrame(rows, "source_url string, url string, status int, error string")).collect()}
    assert found.keys() == {"https://s/gone", "https://s/odd", "https://s/none"}
    gone = found["https://s/gone"]
    assert gone["pages"] == n and gone["sources"].split(" ") == [f"https://s/{i:05}" for i in range(n)]  # before: the first 1000
    assert tuple(found["https://s/odd"])[1:] == (500, "No response", 2, "https://s/1") and tuple(found["https://s/none"])[1:] == (410, None, 1, "")


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    import os
    import time

    from pyspark.sql import functions as F

    from sitelens.operators import tables

    where = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f for d in where for _, _, names in os.walk(str(d)) for f in names if f.startswith("shuffle_")}
    spark.sparkContext._jvm.System.gc()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, set_ = files(), spark.conf.get(name, None)
    rows = spark.range(1000).withColumn("g", F.xxhash64("id") % 100)
    made = tables.materialized(rows.groupBy("g").count().join(rows, "g"), "files")
    left = files() - before
    for _ in range(50):  # executors are asked, and don't answer
        if left:
            time.sleep(0.1)
            left = files() - before
    assert not left  # before: until the driver's JVM collected the plan
    assert made.count() == 1000 and spark.conf.get(name, None) == set_


def test_unlike_sets_of_a_large_candidate_cluster_meet_by_sketches(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from sitelens.llm import near

    rng = random.Random(4)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 260))] for _ in range(60)]
    texts = [" ".join(b) for b in base] + [" ".join(b[: len(b) * 24 // 25] + ["new"] * (i % 3)) for i, b in enumerate(base[20:40])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near, "CELL", 500)
    monkeypatch.setattr(near, "SKETCHES", 200, raising=False)
    forests, met = near._forests, []
    monkeypatch.setattr(near, "_forests", lambda cells, percent: (met.append(cells.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0), forests(cells, percent))[1])
    rows = near.written(near.signed(docs, 5, 23), "near-signed")
    classes = near.classes_of(rows, "prefix", "code")
    one = classes.agg(F.min("node").alias("component"))
    got = near.confirmed_edges(docs, classes, classes.select(F.col("node").alias("id")).crossJoin(one), 5, 80)
    of = {r["node"]: r["rep"] for r in classes.collect()}
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in enumerate(texts)}
    linked = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    found = {tuple(sorted((of[r["src"]], of[r["dst"]]))) for r in got.collect()}
    assert len(linked) == 20 and {x for x in found if x[0] != x[1]} == linked
    assert sum(met) < 4 * sum(8 * len(x) for x in sets.values())  # before: every set met in some 20 cells


def test_every_run_of_words_is_a_seed(spark):
    import numpy as np

    from sitelens.llm import passages

    rows = [(1, " ".join(f"w{i}" for i in range(70))), (2, "x " * 80), (3, "too short"), (4, None)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for turn in range(3) for r in passages.seeds_of(texts, turn, 3).collect()]
    places = lambda i: np.bincount([r["pos"] for r in got if r["doc_id"] == i]).tolist()
    assert places(1) == [2] * 64 + [1] * 2  # before: a quarter of the runs of 5 words, a sixth of those of 7
    assert len({(r["doc_id"], r["h"]) for r in got if r["doc_id"] == 1}) == 130 and sum(r["doc_id"] > 2 for r in got) == 0


def test_no_passage_is_lost_for_want_of_a_seed(spark):
    """Passages of 50 words of which every sixth is another: of their 8 shared runs of 5 words a sample left none for some."""
    import random

    from sitelens.llm import passages

    rng = random.Random(7)
    word = lambda: f"v{rng.randrange(10**7)}"
    texts, want = [], set()
    for i in range(150):
        shared = [word() for _ in range(50)]
        changed = [word() if j % 6 == 5 else w for j, w in enumerate(shared)]
        texts += [(2 * i, " ".join([*(word() for _ in range(8)), *shared, *(word() for _ in range(8))])), (2 * i + 1, " ".join([*(word() for _ in range(8)), *changed, *(word() for _ in range(8))]))]
        want.add((2 * i + 1, 2 * i))
    found = passages.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["other_id"]) for r in found} == want
