"""The manifest, the filter audit and the Jaccard join against brute force and odd input."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

pytest.importorskip("sitelens.llm")

from sitelens.llm import audit, jaccard, merkle, near  # noqa: E402
from test_llm import ODD, make, prose  # noqa: E402

LABELS = "doc_id long, quality int, toxic int, x string"
WORDS = re.compile(r"[^\x20\x09-\x0d]+")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """All levels, plainly."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def root_with(levels, at, node):
    """The root and the siblings, when one leaf is replaced, all hashed anew."""
    siblings = []
    for level in levels[:-1]:
        first = at // 8 * 8
        run = list(level[first : first + 8])
        siblings += run[: at - first] + run[at - first + 1 :]
        run[at - first] = node
        node, at = sha(*run), at // 8
    return node, siblings


def expected_manifest(rows):
    """Of (doc_id, source, lang, n_chars, text) rows, by hashing whole trees."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)
    of_lang = defaultdict(list)
    for d, s, lang, n, t in rows:
        leaf = sha(*map(field, (d, s, lang, n, t)))
        touched = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        of_lang[lang].append(((d is not None, d or 0), leaf, sha(*map(field, (d, s, lang, n, low(t)))) if touched else leaf, d))
    langs = sorted(of_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        of_lang[lang].sort(key=lambda r: r[:2])
        trees[lang] = tree([r[1] for r in of_lang[lang]])
    top = tree([trees[lang][-1][0] for lang in langs])
    out = []
    for g, lang in enumerate(langs):
        for i, (_, leaf, other, d) in enumerate(of_lang[lang]):
            sub, low_siblings = root_with(trees[lang], i, other)
            root, high = root_with(top, g, sub)
            out.append((d, leaf, trees[lang][-1][0], top[-1][0], sha(*low_siblings, *high), root, root == top[-1][0]))
    return sorted(out, key=str)


def test_parent_resumes_at_every_slot():
    for n in range(1, 9):
        children = [sha(str(i)) for i in range(n)]
        p = merkle.Parent(children)
        assert p.digest == sha(*children)
        for slot in range(n):
            assert p.replaced(slot, sha("new")) == sha(*children[:slot], sha("new"), *children[slot + 1 :])


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8, "b": 1}, {"a": 9, None: 65, "ü": 513, "z": 2}, {"a": 4097, "b": 1}, {f"l{i}": 2 for i in range(20)}])
def test_manifest_against_plain_trees(spark, sizes):
    rng = random.Random(5)
    rows = []
    for lang, n in sizes.items():
        rows += [(len(rows) + i if i % 50 else rng.randrange(9), rng.choice(["s", None, ""]), lang, i if i % 7 else None, rng.choice([f"Text {i % 11}", None, "", "ÄB", "low"])) for i in range(n)]
    rows += rows[:3]  # rows that repeat
    rows.append((None, None, "a", None, "NULL id"))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "x", 1, 2, b"3") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, digest string, gid long, pos long, path binary")
    assert sorted([tuple(r) for r in merkle.tampered_manifest(docs).collect()], key=str) == expected_manifest(rows)


def test_manifest_takes_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(i, "s", f"l{i % 9}" if i % 3 else "en", 1, f"T {i}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.tampered_manifest(docs)
    assert sorted([tuple(r) for r in got.collect()], key=str) == expected_manifest(rows)


def test_manifest_of_odd_and_empty_tables(spark):
    docs = make(spark, [*ODD, "Long " * 50_000], ids=[None, None, *range(1, len(ODD))])
    got = merkle.tampered_manifest(docs)
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted([tuple(r) for r in got.collect()], key=str) == expected_manifest(rows)
    empty = merkle.tampered_manifest(docs.limit(0))
    assert empty.collect() == [] and empty.columns == got.columns


# ---------------------------------------------------------------- filter audit


def expected_audit(rows, labels):
    """Each order applied to the rows, filter by filter."""
    marks = {}
    for d, q, t in labels:
        good, toxic = marks.get(d, (0, 0))
        marks[d] = (good or int(q == 1), toxic or int(t == 1))
    least = {}
    for d, text, _ in rows:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    parts = defaultdict(list)
    for d, text, source in rows:
        t = text or ""
        w = WORDS.findall(t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": d is not None and least[t] < d,
        }
        parts[source or ""].append((fails, *(marks.get(d, (0, 0)) if d is not None else (0, 0))))
    out = []
    for part, docs in parts.items():
        shapley, found = defaultdict(int), []
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                shapley[f] += len(gone)
                redundant = sum(x[0][f] for x in docs) - len(gone)
                unique = sum(x[0][f] and sum(x[0].values()) == 1 for x in docs)
                found.append([part, "".join(order), step, len(left), len(gone), redundant, unique, sum(x[1] for x in gone), sum(x[2] for x in gone), f])
        out += [(*r[:-1], shapley[r[-1]]) for r in found]
    return sorted(out)


def test_survivors_of_all_subsets():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 9, (4, 32, 3))
    got = audit.survivors(counts)
    for active in range(32):
        assert (got[:, active] == counts[:, [m for m in range(32) if not m & active]].sum(axis=1)).all()


def test_filter_audit_against_each_order(spark):
    rng = random.Random(8)
    texts = []
    for i in range(160):
        t = prose(rng, rng.choice([3, 49, 50, 51, 90]), rng.choice([30, 60, 4000]))
        texts.append(rng.choice([str, str.upper, lambda x: x + " #", lambda x: x + " é|"])(t) if i % 4 else rng.choice(texts or [t]))
    texts += [*ODD, "W " * 40_000, "w" * 100 + "A" * 5, "w" * 95 + "A" * 5, "w" * 94 + "A" * 6]
    ids = [i if i % 9 else rng.choice([None, 3, 5]) for i in range(len(texts))]
    sources = [rng.choice(["a", "b", "ü", None, ""]) for _ in texts]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "y") for i in range(0, len(texts), 2)] + [(3, 1, 0, "z"), (3, 0, 1, "z"), (None, 1, 1, "n")]
    docs = make(spark, texts, ids=ids, sources=sources).withColumnsRenamed({"x": "mask", "h": "digest"})
    got = audit.filter_audit(docs, spark.createDataFrame(labels, LABELS))
    assert sorted(tuple(r) for r in got.collect()) == expected_audit(list(zip(ids, texts, sources)), [x[:3] for x in labels])


def test_filter_audit_of_no_rows(spark):
    docs, labels = make(spark, ["a"]), spark.createDataFrame([], LABELS)
    assert audit.filter_audit(docs.limit(0), labels).count() == 0
    rows = audit.filter_audit(docs, labels).collect()
    assert len(rows) == 600 and sum(r.kept for r in rows) == sum(not r.removed and r.step < r.filter_order.index("A") + 1 for r in rows)


# ---------------------------------------------------------------- Jaccard join


def grams(text, k):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def expected_components(rows, k, percent):
    sets = [grams(t, k) for _, t in rows]
    to = list(range(len(rows)))

    def top(i):
        while to[i] != i:
            i = to[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                to[top(i)] = top(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[top(i)].append((d is None, d or 0, d))
    return sorted([(d, len(s), min(least[top(i)])[2]) for i, ((d, _), s) in enumerate(zip(rows, sets))], key=str)


def changed(rng, text, share):
    return " ".join(f"n{rng.random()}" if rng.random() < share else w for w in text.split())


def near_texts(rng, sizes, per_size):
    """Groups of texts that differ by about as much as still links, and some that share passages."""
    passage = prose(rng, 60, 10**6)
    out = []
    for n in sizes:
        for _ in range(per_size):
            base = prose(rng, n, 10**6)
            out.append(base)
            for share in (0.01, 0.02, 0.025, 0.03, 0.05):
                out.append(changed(rng, base, share))
            cut = base.split()
            out += [" ".join(cut[: max(1, int(n * x))]) for x in (0.78, 0.8, 0.81, 0.9)]
            out.append(base.upper() + " tail " + passage)
            out.append(passage + " " + prose(rng, n, 10**6))
    return out


@pytest.mark.parametrize("percent,k", [(80, 5), (60, 2), (95, 1)])
def test_jaccard_join_against_all_pairs(spark, percent, k):
    rng = random.Random(percent + k)
    texts = near_texts(rng, (1, 2, 3, 5, 8, 12, 17, 31, 33, 40, 64, 90, 130, 260, 520), 2) + ODD
    rng.shuffle(texts)
    ids = [i if i % 17 else None for i in range(len(texts))]
    docs = make(spark, texts, ids=ids)
    got = sorted([tuple(r) for r in jaccard.jaccard_components(docs, k, percent).collect()], key=str)
    assert got == expected_components(list(zip(ids, texts)), k, percent)


def test_pairs_at_the_bound_are_never_lost():
    """Sets that just link share a posting that the larger one asks by, whatever the segments of the tokens."""
    rng = np.random.default_rng(1)
    plan = jaccard.Plan(80)
    lost = tried = 0
    for size in [1, 2, 3, 4, 5, 6, 8, 9, 10, 13, 16, 20, 31, 32, 36, 45, 63, 64, 72, 80, 99, 127, 128, 160, 255, 300, 511, 640]:
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            most = len(a) * 100 // 80
            b_size = int(rng.integers(len(a), most + 1))
            both = -(-(80 * (len(a) + b_size)) // 180)  # the least intersection that links
            if both > len(a):
                continue
            b = np.unique(np.concatenate([rng.permutation(a)[:both], rng.integers(0, 2**63, b_size - both, dtype=np.uint64)]))
            tried += 1
            lost += not asked_finds(plan, a, b)
    assert tried > 1000 and lost == 0


def asked_finds(plan, small, large):
    """Whether a posting of the larger set meets one of the smaller, with the longest lists left out at random; weak sets aside."""
    def of(h, below):
        at = np.array([0, len(h)])
        band, posted, asked, need, row, segment, kept = jaccard._asked(plan, h, at, below)
        spare, count, offset, owner, inside = jaccard._spare(asked, need, posted, row, segment)
        chosen, weak = jaccard._neighbourhoods(plan, need, np.where(asked > 0, spare, 0), count, owner, inside)
        subsets = {int(s): frozenset(h[kept[segment == s]].tolist()) for s in np.unique(segment)}
        return int(band[0]), subsets, {s for s in subsets if inside[s]}, set(np.flatnonzero(chosen).tolist()), int(spare[0]), bool(weak[0])

    band_s, subsets_s, *_ = of(small, False)
    below = int(jaccard._band(np.array([len(large)]))[0]) > band_s
    band_l, subsets_l, asks, deleted, spare, weak = of(large, below)
    assert band_s == band_l
    if weak:
        return True
    equal = [s for s in asks if subsets_s.get(s) == subsets_l[s]]
    if len(equal) > max(0, spare):
        return True
    return any(subsets_s.get(s) == subsets_l[s] - {x} for s in deleted for x in subsets_l[s])


def test_weak_sets_are_joined_by_tokens(spark, monkeypatch):
    rng = random.Random(4)
    texts = near_texts(rng, (5, 20, 60), 2)
    docs = make(spark, texts)
    real = jaccard._neighbourhoods
    monkeypatch.setattr(jaccard, "candidate_edges", lambda docs, *_: docs.sparkSession.createDataFrame([], "src long, dst long"))
    monkeypatch.setattr(jaccard, "_neighbourhoods", lambda *a: (real(*a)[0], np.ones(len(a[1]), bool)))
    described = jaccard.described

    def all_weak(docs, k, plan):
        from pyspark.sql import functions as F

        return described(docs, k, plan).withColumn("weak", F.lit(True))

    monkeypatch.setattr(jaccard, "described", all_weak)
    got = sorted([tuple(r) for r in jaccard.jaccard_components(docs).collect()], key=str)
    assert got == expected_components(list(enumerate(texts)), 5, 80)


def test_jaccard_groups_split_into_cells(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST", 3)
    monkeypatch.setattr("sitelens.llm.near.CELL", 400)
    rng = random.Random(6)
    base = prose(rng, 120, 10**6)
    texts = [changed(rng, base, 0.01) for _ in range(30)]
    chain = base.split()
    for _ in range(25):  # each links with its neighbours only
        chain = chain[3:] + [f"c{rng.random()}" for _ in range(3)]
        texts.append(" ".join(chain))
    texts += [base] * 20
    got = sorted([tuple(r) for r in jaccard.jaccard_components(make(spark, texts)).collect()], key=str)
    assert got == expected_components(list(enumerate(texts)), 5, 80)


def test_jaccard_of_odd_and_empty_tables(spark):
    texts = [*ODD, "word " * 60_000, "a b c d e f g " * 30_000]
    docs = make(spark, texts, ids=[None, None, 5, 5, *range(4, len(texts))])
    got = jaccard.jaccard_components(docs)
    ids = [None, None, 5, 5, *range(4, len(texts))]
    assert sorted([tuple(r) for r in got.collect()], key=str) == expected_components(list(zip(ids, texts)), 5, 80)
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_exact_forest_compares_a_group_once():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: 190 + i % 10], rng.integers(0, 2**63, 5, dtype=np.uint64)])) for i in range(300)]
    edges = near.exact_forest(sets, 80)
    assert len(edges) == 299
    assert sum(a == 0 for a, _ in edges) > 290  # nearly all are linked with the first


def test_shared_keeps_keys_of_two_sets_across_batches(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(300), rng.randrange(3), rng.choice([1, 3])) for _ in range(1500)] + [(-5, 9, 1)] * 50 + [(-6, i, 1) for i in range(40)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = jaccard.shared(spark.createDataFrame(rows, "key long, short long, kind byte")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    sets = defaultdict(set)
    for k, s, _ in rows:
        sets[k].add(s)
    assert sorted(tuple(r) for r in got) == sorted({r for r in rows if len(sets[r[0]]) > 1})


# ---------------------------------------------------------------- statistics and the pipeline


def plain_stats(text):
    """features.STATS of one text, byte by byte."""
    t = (text or "").encode()
    lower = t.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
    pattern = re.compile(rb"[^\x20\x09-\x0d]+")
    w, lw = pattern.findall(t), pattern.findall(lower)
    n, size = max(len(w), 1), max(len(t), 1)
    upper = lambda b: 65 <= b <= 90
    letter = lambda b: upper(b) or 97 <= b <= 122 or b >= 128
    space = lambda b: b == 32 or 9 <= b <= 13
    digit = lambda b: 48 <= b <= 57
    symbol = lambda b: b in b"#$%&*+<=>@\\^_`{|}~"
    length = [len(x) for x in w]
    mean = sum(length) / n
    pairs = list(zip(lw, lw[1:]))
    lines = re.findall(rb"[^\n]+", lower)
    share = lambda test: sum(map(test, t)) / size
    return [
        np.log1p(len(w)), mean, np.sqrt(max(0, sum(x * x for x in length) / n - mean**2)), sum(x > 20 for x in length) / n, share(upper),
        sum(sum(map(upper, x)) >= 2 and sum(map(upper, x)) == sum(map(letter, x)) for x in w) / n, share(digit), share(lambda b: b >= 32 and b != 127 and not (letter(b) or digit(b) or space(b))), share(symbol), sum(any(map(symbol, x)) for x in w) / n,
        share(lambda b: b == 33), len(set(lw)) / n, max([lw.count(x) for x in set(lw)], default=0) / n, 1 - len(set(pairs)) / max(len(pairs), 1), sum(a == b for a, b in pairs) / max(len(pairs), 1),
        max(len(lines), 1) / n, 1 - len(set(lines)) / max(len(lines), 1), share(lambda b: b >= 128), sum(b in b".," for b in t) / n,
    ]


def test_statistics_against_plain_python(spark):
    from sitelens.llm.features import STATS, text_stats

    rng = random.Random(12)
    texts = [*[t or "" for t in ODD], "One TWO two Two!!\nline, line.\nLine, line.\n\n A1 $x #y ABC ÄÖ \x7f\x01 averyveryverylongwordindeed x x x", *(prose(rng, 80, 9).upper() + "\n" + prose(rng, 30, 5) for _ in range(5)), "A. " * 20_000]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    got = text_stats(data, at)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain_stats(t), abs=1e-9), (t[:40], [s for s, a, b in zip(STATS, got[i], plain_stats(t)) if abs(a - b) > 1e-9])


def test_quality_of_long_texts_ties_and_repeats(spark):
    from sitelens.llm import quality

    rng = random.Random(2)
    texts = [prose(rng, 40) if i % 2 else "$$$ " * 30 for i in range(200)] + ["long text " * 40_000, "$$$ " * 30, prose(random.Random(5), 40)] + [prose(random.Random(5), 40)] * 2
    labels = spark.createDataFrame([(i, i % 2, None, "x") for i in range(200)], LABELS)
    rows = quality.quality(make(spark, texts, ids=[*range(203), 202, 202]), labels).collect()
    assert len(rows) == 205 and len({r.score for r in rows if r.doc_id == 202}) == 1 and len({r.score for r in rows if r.doc_id % 2 == 0 and r.doc_id < 200 or r.doc_id == 201}) == 1


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    texts = [*ODD, *(prose(rng, 90) for _ in range(12))] * 2
    docs = make(spark, texts, ids=[None if i % 9 == 0 else i // 2 for i in range(len(texts))], sources=[rng.choice(["a", None, ""]) for _ in texts])
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(10)] + [(None, 1, 1, "y")], LABELS)
    for name, some in (("odd", docs), ("empty", docs.limit(0))):
        some.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    odd = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    assert odd.count() > 5 and odd.filter("not lossless").count() == 0
    empty = corpus_pipeline.run(spark, f"{tmp_path}/empty")
    assert empty.count() == 0 and empty.columns == odd.columns
