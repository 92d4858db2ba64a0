"""Operators over links: counts, reconciliation, link graph, link score, click depth, near-duplicate content."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from .graphs import components, forest, hot_join, whole_groups
from .tables import materialized, partitioned

C = F.col


def inlinks(links: DataFrame) -> DataFrame:
    """Target key with all links to it and its distinct source pages; fragments and one trailing slash fold."""
    return links.groupBy(U.inlink_key(C("url")).alias("target")).agg(F.count("*").alias("total"), F.countDistinct(U.inlink_key(C("source_url"))).alias("unique_sources"))


def outlinks(links: DataFrame) -> DataFrame:
    """Links of each page, all and without those that differ in the fragment only."""
    return links.groupBy("source_url").agg(F.count("*").alias("total"), F.countDistinct(F.substring_index("url", "#", 1)).alias("unique_links"))


def outlinks_split(links: DataFrame) -> DataFrame:
    """Links of each page within its site and out of it, all and without those that differ in the fragment only."""
    own, plain = F.coalesce("internal", F.lit(False)), F.substring_index("url", "#", 1)
    each = links.groupBy("source_url", own.alias("_i"), plain.alias("_u")).agg(F.count("*").alias("_n"))
    of = lambda side: (F.coalesce(F.sum(F.when(side, C("_n"))), F.lit(0)), F.count_if(side))
    (i, ui), (e, ue) = of(C("_i")), of(~C("_i"))
    return each.groupBy("source_url").agg(i.alias("internal"), ui.alias("unique_internal"), e.alias("external"), ue.alias("unique_external"))


def scored_links(links: DataFrame, scores: DataFrame) -> DataFrame:
    """Links with the link_score of the address that they lead to, letter by letter; null where it has none."""
    own = scores.groupBy(C("url").alias("_t")).agg(F.max("score").alias("link_score"))
    return links.join(own, C("url") == C("_t"), "left").drop("_t")


def linked_files(links: DataFrame) -> DataFrame:
    """url and content_type of the addresses with a known ending that links lead to, within the site or out of it, once each."""
    kind = U.content_type_for(C("url"))
    return links.select("url", kind.alias("content_type")).filter("content_type <> ''").distinct()


def link_graph(links: DataFrame, depths: DataFrame, most: int = 220) -> tuple[DataFrame, DataFrame]:
    """Nodes (url, in_degree, out_degree, degree) and edges of the part of a site's graph that can be drawn.

    Degrees are of all distinct links without loops; the `most` nodes of the highest stay (ties by url), and the one with the least depth
    (url, depth) always does, for the weakest. Edges are those among them.
    """
    e = materialized(links.filter("source_url is not null and url is not null and source_url <> url").select("source_url", "url").distinct(), "graph")
    ends = e.select(C("source_url").alias("url"), F.lit(1).alias("o")).unionByName(e.select("url", F.lit(0).alias("o")))
    nodes = materialized(ends.groupBy("url").agg(F.sum(1 - C("o")).alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree")), "degrees")
    root = nodes.join(depths.select("url", "depth"), "url").filter("depth is not null").orderBy("depth", "url").limit(1).select("url", F.lit(0).alias("_p"))
    first = nodes.orderBy(F.desc("degree"), "url").limit(most).select("url", F.lit(1).alias("_p"), (-C("degree")).alias("_d"))
    # the root first, then the others: of `most` + 1 rows the last one goes
    kept = root.withColumn("_d", F.lit(0).cast("long")).unionByName(first).groupBy("url").agg(F.min("_p").alias("_p"), F.min("_d").alias("_d")).orderBy("_p", "_d", "url").limit(most)
    kept = materialized(kept.select("url"), "kept")  # `most` rows
    near = F.broadcast(kept)
    return nodes.join(near, "url", "left_semi"), e.join(near, "url", "left_semi").join(F.broadcast(kept.withColumnRenamed("url", "source_url")), "source_url", "left_semi")


def reconcile(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links with the status of the page that they lead to: null if it wasn't crawled, an error from 400 on, or for 0."""
    target = pages.select(U.norm_url(C("url")).alias("_k"), C("status_code").alias("_s"))
    joined = links.withColumn("_k", U.norm_url(C("url"))).join(target, "_k", "left")
    error = F.when(C("_s") >= 400, F.concat(F.lit("HTTP Error: "), C("_s").cast("string"))).when(C("_s") == 0, F.lit("No response"))
    return joined.withColumn("status", F.when(C("_s").between(100, 599), C("_s"))).withColumn("error", error).drop("_k", "_s")


def broken_links(links: DataFrame) -> DataFrame:
    """Dead targets: status, pages that link there, and all of them in order. A link without status or error isn't broken."""
    dead = links.filter(C("url").isNotNull() & ((C("status") >= 400) | C("error").isNotNull()))
    pairs = dead.groupBy("url", "source_url").agg(F.max("status").alias("status"), F.max("error").alias("error"))
    sources = F.array_join(F.sort_array(F.collect_list("source_url")), " ")  # a target's pages are one value of its row
    return pairs.groupBy("url").agg(F.max("status").alias("status"), F.max("error").alias("reason"), F.count("*").alias("pages"), sources.alias("sources"))


def carriers(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages with a broken link."""
    dead = links.filter((C("status") >= 400) | C("error").isNotNull()).select(C("source_url").alias("url")).distinct()
    return pages.join(dead, "url", "left_semi")


def incoming(links: DataFrame, url: str) -> DataFrame:
    """Sources of links to one address, with their distinct anchors in order and the links' greatest status."""
    at = links.filter(U.norm_url(C("url")) == U.norm_url(F.lit(url)))
    return at.groupBy("source_url").agg(F.array_join(F.sort_array(F.collect_set("anchor_text")), ", ").alias("anchors"), F.max("status").alias("status"))


def degrees(links: DataFrame) -> DataFrame:
    """In and out degree of every page over distinct links without loops."""
    e = links.select(U.norm_url(C("source_url")).alias("s"), U.norm_url(C("url")).alias("t")).filter("s <> t").distinct()
    both = e.select(C("s").alias("url"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(C("t").alias("url"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("url").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def click_depth(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """url and depth: fewest links from a seed, up to `most` where given. Each round joins the frontier only, until it is empty."""
    e = edges.select(C("source_url").alias("s"), C("url").alias("t")).distinct()
    seen = seeds.select("url", F.lit(0).alias("depth")).distinct()
    front = seen
    for d in itertools.count(1) if most is None else range(1, most + 1):
        front = front.join(e, front["url"] == e["s"]).select(C("t").alias("url")).distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(d))
        front = materialized(front, "frontier")
        if not front.head(1):
            break
        seen = seen.unionByName(front)
        if d % 16 == 0:
            seen = materialized(seen, "reached")  # so that plans stay short on deep sites
    return seen


def page_edges(facts: DataFrame, key: str | None = None) -> DataFrame:
    """source_url, url, anchor_text, rel, internal and slot (its place on the page) of every anchor that extract_pages found, and the key.

    Targets that nobody has crawled are targets as well; an anchor without an address is none.
    """
    rows = facts.select(*([key] if key else []), C("url").alias("source_url"), F.posexplode("links").alias("slot", "_l"))
    return rows.select(*([key] if key else []), "source_url", "_l.url", "_l.anchor_text", "_l.rel", "_l.internal", "slot").filter("url is not null")


def bypass_of(pages: DataFrame, order: str | None = None) -> DataFrame:
    """src and dst: addresses whose weight another one takes.

    A page's original_url and the hops of its redirect_chain lead to it, where it has these columns; a page with another canonical leads to
    that. Rows count in `order` (None: by url), and in a row the original address, the hops, then the canonical. The last original or
    canonical of an address holds; without any, the first hop.
    """
    url = U.norm_url(C("url"))
    rank = C(order) if order else C("url")
    hold = lambda src, dst, at, over: F.struct(src.alias("src"), dst.alias("dst"), F.struct(rank.alias("row"), F.lit(at).alias("at")).alias("order"), F.lit(over).alias("over"))
    moves = [F.array(hold(url, U.norm_url(C("canonical")), 2, True))]
    if "redirect_chain" in pages.columns:
        moves.insert(0, F.transform(F.coalesce("redirect_chain", F.array().cast("array<string>")), lambda h: hold(U.norm_url(h), url, 1, False)))
    if "original_url" in pages.columns:
        moves.insert(0, F.array(hold(U.norm_url(C("original_url")), url, 0, True)))
    rows = pages.select(F.explode(F.concat(*moves)).alias("m")).select("m.*").filter("src is not null and dst is not null and src <> dst")
    of = lambda c: F.when(c, C("dst"))
    best = rows.groupBy("src").agg(F.max_by(of(C("over")), F.when(C("over"), C("order"))).alias("_o"), F.min_by(of(~C("over")), F.when(~C("over"), C("order"))).alias("_i"))
    return best.select("src", F.coalesce("_o", "_i").alias("dst"))


def _ends(hops: DataFrame) -> DataFrame:
    """src and dst of each hop, followed to the chain's end by doubling; chains that lead into a cycle end somewhere on it."""
    n, length = hops.count(), 1
    while True:
        left = hops.join(hops.select(C("src").alias("dst")), "dst", "left_semi")
        if length > n or not left.head(1):
            return hops
        step = hops.select(C("src").alias("dst"), C("dst").alias("_d"))
        hops = materialized(hops.join(step, "dst", "left").select("src", F.coalesce("_d", "dst").alias("dst")), "hops")
        length *= 2


def resolve_bypass(names: DataFrame, bypass: DataFrame) -> DataFrame:
    """src and dst of each name: where its chain of bypasses ends, however long; on a cycle, the first name met twice."""
    hops = bypass.select("src", "dst")
    ends = _ends(hops)
    cycle = materialized(ends.join(hops.select(C("src").alias("dst")), "dst", "left_semi").select(C("dst").alias("src")).distinct(), "cycles")
    if cycle.head(1):  # all names on cycles: chains end where they meet one
        ends = _ends(materialized(hops.join(cycle, "src", "left_anti"), "hops"))
    to = ends.select(C("src").alias("_s"), C("dst").alias("_d"))
    return names.join(to, C("url") == C("_s"), "left").select(C("url").alias("src"), F.coalesce("_d", "url").alias("dst"))


def weights(pages: DataFrame, links: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(url) of the eligible pages, and (s, t, w): the share of a page's weight that each target gets. Both written.

    Eligible are successful pages that aren't bypassed. Ends of links are resolved by `bypass_of`; of a page's links to one target the first counts.
    """
    bypass = bypass_of(pages, order)
    own = pages.select(U.norm_url(C("url")).alias("url"), "status_code")
    names = own.select("url").union(links.select(U.norm_url(C("url")))).distinct()
    to = materialized(resolve_bypass(names, materialized(bypass, "bypass")), "resolved")
    eligible = materialized(own.filter("status_code between 200 and 299").select("url").distinct().join(to.filter("src = dst").select(C("src").alias("url")), "url"), "eligible")
    named = links.select(U.norm_url(C("source_url")).alias("a"), U.norm_url(C("url")).alias("b"), F.lower(F.coalesce("rel", F.lit(""))).contains("nofollow").alias("nofollow"), "slot")
    s, t = to.select(C("src").alias("a"), C("dst").alias("s")), to.select(C("src").alias("b"), C("dst").alias("t"))
    e = named.join(s, "a").join(t, "b").filter("s <> t").join(eligible.select(C("url").alias("s")), "s", "left_semi")
    e = e.groupBy("a", "s", "t").agg(F.min_by("nofollow", "slot").alias("nofollow"))  # a row's first link to a target counts
    out = e.groupBy("s").agg(F.count("*").alias("n_out"))
    e = e.filter("not nofollow").join(out, "s").groupBy("s", "t").agg((F.count("*") / F.first("n_out")).alias("w"))
    return eligible, materialized(e, "weights")


def damped_rounds(eligible: DataFrame, edges: DataFrame, n: int, rounds: int, damping: float) -> DataFrame:
    """url and v after some rounds. eligible is partitioned by url and edges by s, in as many parts as shuffles have.

    A round joins the edges where they are; what travels is a partial sum for each target and task, and it arrives where the target's scores are.
    """
    scores = eligible.withColumn("v", F.lit(1.0 / n))
    for _ in range(rounds):
        got = edges.join(scores, edges["s"] == scores["url"]).groupBy("t").agg(F.sum(C("v") * C("w")).alias("g"))
        scores = eligible.join(got, eligible["url"] == got["t"], "left").select("url", (F.lit((1 - damping) / n) + damping * F.coalesce("g", F.lit(0.0))).alias("v"))
    return scores


def link_score(pages: DataFrame, links: DataFrame, rounds: int = 10, damping: float = 0.85, order: str | None = None) -> DataFrame:
    """url and score from 1 to 100: damped link weight of successful pages that aren't bypassed, over distinct links without loops.

    Links marked nofollow, or to pages that aren't eligible, take their share and pass nothing on. Equal scores are 100. The edges are
    shuffled once, for all rounds.
    """
    eligible, e = weights(pages, links, order)
    n = eligible.count()
    if not n:
        return eligible.withColumn("score", F.lit(0).cast("long"))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = [partitioned(eligible, "url", parts), partitioned(e, "s", parts)]
    scores = materialized(damped_rounds(*kept, n, rounds, damping), "scores")
    for x in kept:
        x.unpersist()
    ends = scores.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    norm = F.when(C("hi") - C("lo") < 1e-12, 100.0).otherwise(1 + (C("v") - C("lo")) / (C("hi") - C("lo")) * 99)
    return scores.crossJoin(ends).select("url", F.floor(F.round(norm, 6) + 0.5).alias("score"))  # one row of ends


def _cells(rows: DataFrame, key: str, block: int) -> DataFrame:
    """key, a, b, side, h: rows of a key in blocks of about `block`, each two of which meet in a cell (a, b)."""
    parts = materialized(rows.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("_parts")).filter("_parts > 1"), "cells")
    dealt = rows.join(parts, key, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    dealt = dealt.withColumn("_p", F.pmod(F.xxhash64("h"), C("_parts")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), C("_parts") - 1)))
    cells = dealt.select(key, F.least("_p", "_o").alias("a"), F.greatest("_p", "_o").alias("b"), F.when(C("_p") <= C("_o"), 0).otherwise(1).alias("side"), "h")
    return cells.repartition(key, "a", "b").sortWithinPartitions(key, "a", "b", "h")


def content_clusters(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: int = 4, most: int = 6, block: int = 2048) -> DataFrame:
    """key, hash, component_id, pages and similarity of each document in a cluster of two or more.

    Hashes that share a 16-bit band and differ in at most `most` bits are linked, equal ones are one class; component_id is the smallest
    key linked over any number of links, similarity 100 less the greatest distance within the cluster in percent of 64 bits.
    Bands and clusters are compared in cells of two blocks, which emit a spanning forest or a maximum.
    """
    hashed = materialized(docs.select(C(key).alias("k"), X.simhash(X.plain_words(C(text))).alias("h")).filter("h <> 0"), "simhash")
    classes = materialized(hashed.groupBy("h").agg(F.min("k").alias("k"), F.count("*").alias("n")), "classes")
    width = 64 // bands
    token = [F.shiftrightunsigned("h", i * width).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(i << width)) for i in range(bands)]

    def distances(t, s, e):
        h, side = (t.column(x).to_numpy()[s:e] for x in ("h", "side"))
        split = t.column("a")[s] != t.column("b")[s]
        x, y = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if split else (np.arange(e - s),) * 2
        return h, x, y, np.bitwise_count((h[x][:, None] ^ h[y]).view(np.uint64))

    def link(batches):
        for t, starts in whole_groups(batches, ["token", "a", "b"]):
            src, dst = [], []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if e - s < 2:
                    continue
                h, x, y, d = distances(t, s, e)
                near = np.zeros((e - s, e - s), bool)
                near[np.ix_(x, y)] = d <= most
                for i, j in forest(near | near.T):
                    src.append(h[i])
                    dst.append(h[j])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    def widest(batches):
        for t, starts in whole_groups(batches, ["component", "a", "b"]):
            found = [int(distances(t, s, e)[3].max(initial=0)) for s, e in zip(starts[:-1].tolist(), starts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([t.column("component").take(pa.array(starts[:-1])).combine_chunks(), pa.array(found, pa.int64())], ["component", "d"])

    banded = classes.select("h", F.explode(F.array(*token)).alias("token"))
    joined = components(materialized(_cells(banded, "token", block).mapInArrow(link, "src long, dst long"), "links"))
    named = classes.join(joined.select(C("id").alias("h"), "component"), "h", "left").withColumn("component", F.coalesce("component", "h"))
    named = materialized(named, "named")
    groups = named.groupBy("component").agg(F.min("k").alias("component_id"), F.sum("n").alias("pages"), F.count("*").alias("_n")).filter("pages > 1")
    far = _cells(named.select("component", "h"), "component", block).mapInArrow(widest, "component long, d long").groupBy("component").agg(F.max("d").alias("d"))
    groups = materialized(groups.join(far, "component").withColumn("similarity", 100 - F.floor(C("d") * 100 / 64)).drop("d"), "groups")
    of = hot_join(named.select("component", "h", "n"), groups, "component", "_n", classes.count()).filter("component_id is not null or pages > 1")
    final = materialized(of.select("h", "n", "component_id", "pages", "similarity"), "clusters")
    return hot_join(hashed, final, "h", "n", hashed.count()).filter("pages > 1").select(C("k").alias(key), C("h").alias("hash"), "component_id", "pages", "similarity")


def crawl_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """url and change (added or removed) between two crawls."""
    added = now.select("url").join(before.select("url"), "url", "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(before.select("url").join(now.select("url"), "url", "left_anti").withColumn("change", F.lit("removed")))


def sitemap_review(sitemap: DataFrame, pages: DataFrame) -> DataFrame:
    """key and bucket: inSitemap, orphan (listed, not crawled), missing (crawled and indexable, not listed), nonIndexable, errors."""
    listed = sitemap.select(U.same_key(C("url")).alias("key")).distinct().withColumn("_l", F.lit(True))
    seen = pages.groupBy(U.same_key(C("url")).alias("key")).agg(F.max("status_code").alias("s"), F.max("indexability").alias("i"))
    rows = listed.join(seen, "key", "full")
    bucket = F.when(C("s").isNull(), "orphan").when(C("s") >= 400, "errors").when(C("i") < 0.5, "nonIndexable").when(C("_l"), "inSitemap").when(C("s") < 300, "missing")
    return rows.select("key", bucket.alias("bucket")).filter("bucket is not null")


def upsert(base: DataFrame, delta: DataFrame, key: str = "url", order: str = "seq") -> DataFrame:
    """The last row of each key, by the order column; new rows win over old ones in ties."""
    cols = [c for c in base.columns if c != key]
    both = base.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(order, "_new")).alias("_r")).select(key, "_r.*")
