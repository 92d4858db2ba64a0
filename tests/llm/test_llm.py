"""The corpus operators against brute force, round trips and odd input: nulls, empty and long texts, ties, repeats, clashing names."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("sitelens.llm")

from sitelens.llm import media, mixing, near, passages, pieces, quality, token_ids, topk, toxicity, warc  # noqa: E402
from sitelens.llm.common import components, hot_join, word_hashes, words  # noqa: E402
import public_tokenizers  # noqa: E402

BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
CLASHING = "row k t p y cut cuts takes score features raw chances kind first fold component _x _p _h _k _t _n _b _text _cuts _gone _score _id _size _row _hot size at s block".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, x string, h string, node long, " + ", ".join(f"{c} string" for c in CLASHING)
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def low(text):
    return (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def make(spark, texts, ids=None, sources=None):
    """Documents with extra columns whose names the operators use inside."""
    rows = [(i if ids is None else ids[i], t, "en" if i % 3 else None, (sources[i] if sources else f"s{i % 3}"), len(t or ""), "x", "h", 7, *[f"{c}{i}" for c in CLASHING]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", "   \n", "one", "one two", "ÄÖ ü   x y", "日本 語", "a" * 5000, "😀 " * 40, "x\x00y \x1c z", "same", "same", "<|endoftext|> ▁ _"]


# ---------------------------------------------------------------- shared helpers


def test_words_match_the_pattern():
    for t in ["", " a b", "a\tb\x0bc\x0c", "ü x"]:
        data = np.frombuffer(t.encode(), np.uint8)
        s, e, _ = words(data, np.array([0, len(data)]))
        assert [t.encode()[a:b] for a, b in zip(s, e)] == WORD.findall(t.encode())
    data = np.frombuffer(b"abcd", np.uint8)
    s, e, r = words(data, np.array([0, 2, 2, 4]))  # rows end words
    assert list(r) == [0, 2] and list(e) == [2, 4]
    a = np.frombuffer(b"Ab ab xab", np.uint8)
    h = word_hashes(a, *words(a, np.array([0, 9]))[:2])
    assert h[0] == h[1] != h[2]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(None, 3), (5, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    top = {i: i for i in range(60)}
    for _ in range(60):
        for a, b in edges:
            if a is not None:
                top[a] = top[b] = min(top[a], top[b])
    ends = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {i: top[i] for i in ends}


def test_components_that_are_not_done_raise(spark):
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long"), most=1)


def test_hot_join(spark):
    left = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 3000 + [2, 2, 3, None])], "k long, v long")
    right = spark.createDataFrame([(1, "a", 3000), (2, "b", 2)], "k long, n string, c long")
    got = Counter(r["n"] for r in hot_join(left, right, "k", "c", 3004, share=2).collect())
    assert got == {"a": 3000, "b": 2, None: 2}


# ---------------------------------------------------------------- 1 media columns


def test_media_round_trip(spark):
    texts = [*ODD, "q" * 576, "q" * 577, "one <b>&amp;\n\n two\x1d\nthree  x\n"]
    got = {r["doc_id"]: r for r in media.text_media(make(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b"\xff" * (max(1, math.ceil(len(data) / 576)) * 576 - len(data))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = media.store_pgm(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        x = [sum(payload[(len(payload) * a) // 64 : (len(payload) * (a + 1)) // 64]) / len(payload) * 64 for a in range(64)]
        bits = "".join("01"[v > sum(x) / 64] for v in x)
        mean = sum(payload) / len(payload)
        std = math.sqrt(sum((v - mean) ** 2 for v in payload) / len(payload))
        assert r["feature"] == f"24x{len(payload) // 24};mean={mean:.3f};std={std:.3f};ahash={int(bits, 2):016x}"
        lines = [" ".join(x.split()) for x in (t or "").split("\n") if x.strip()]
        assert (r["n_items"], r["position"], r["caption"]) == (len(lines) + 1, (len(lines) + 1) // 2, f"{len(data)} bytes, {len(lines)} paragraphs")
        items = media.parse_html(media.page_of(t or "", r["media_sha256"], len(data)))
        assert [i["text"] for i in items if i["kind"] == "text"] == lines and items[r["position"]]["digest"] == r["media_sha256"]
    assert got[10]["feature"] == got[11]["feature"]
    assert media.text_media(make(spark, [])).count() == 0


def test_items_keep_order_and_captions(spark):
    html = "<h1>T &amp; t</h1><p>a<img src='media:sha256-01' data-bytes='3' alt='alt'>b</p><figure><img src='media:sha256-02'><figcaption>cap <b>x</b></figcaption></figure><script>no</script>z"
    items = media.parse_html(html)
    assert [(i["kind"], i["text"] or i["digest"], i["caption"]) for i in items] == [("text", "T & t", None), ("text", "a", None), ("media", "01", "alt"), ("text", "b", None), ("media", "02", "cap x"), ("text", "z", None)]
    assert media.parse_html(None) == []
    said = lambda html: [(i["kind"], i["text"] or i["digest"], i["caption"]) for i in media.parse_html(html)]
    img = "<img src='media:sha256-01'>"
    assert said(f"<figure><figcaption>first</figcaption>{img}</figure>z") == [("media", "01", "first"), ("text", "z", None)]
    assert said(f"<div><figure>{img}<figcaption>open</div><p>z</p>") == [("media", "01", "open"), ("text", "z", None)]
    assert said(f"<figure>{img}<figcaption>open <p>in</p>") == [("media", "01", "open in")]
    assert said("<figure><figcaption>alone</figcaption></figure><figcaption>loose</figcaption>y") == [("text", "alone", None), ("text", "loose", None), ("text", "y", None)]
    assert said(f"<figure>{img}<figcaption>a</figcaption><figure>{img}<figcaption>b</figcaption></figure>") == [("media", "01", "a"), ("media", "01", "b")]
    assert said("<table><td>a</td><td>b</td></table><blockquote>q</blockquote>r") == [("text", x, None) for x in "abqr"]
    assert [i["n_bytes"] for i in media.parse_html("".join(f"<img data-bytes='{n}'>" for n in ["\u00b2", "9" * 30, "-1", "07"]))] == [None, None, None, 7]
    rows = media.sequences(spark.createDataFrame([(1, html), (2, None)], "doc_id long, html string")).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(6)) and rows[2]["n_bytes"] == 3


def test_payloads_are_resolved_by_digest(spark, tmp_path):
    rows = [(i, p, "media", None, d, 1, f"c{i}") for i, (p, d) in enumerate([(0, "a")] * 1200 + [(1, "b"), (2, None), (3, "gone")])]
    items = spark.createDataFrame(rows, "doc_id long, position int, kind string, text string, digest string, n_bytes long, caption string")
    stored = spark.createDataFrame([("a", b"A"), ("a", b"A"), ("b", b"B"), ("c", b"C")], "digest string, media binary")
    got = {r["doc_id"]: r for r in media.resolve(items, stored).collect()}
    assert len(got) == len(rows) == media.resolve(items, stored).count()
    for i, position, _, _, digest, _, caption in rows:
        r = got[i]
        assert (r["position"], r["digest"], r["caption"]) == (position, digest, caption)
        assert (None if r["media"] is None else bytes(r["media"])) == {"a": b"A", "b": b"B"}.get(digest)
    assert media.resolve(items.limit(0), stored).count() == 0


# ---------------------------------------------------------------- 2 substring dedup


def test_fenwick_chain_is_the_best_chain():
    rng = random.Random(3)
    for _ in range(60):
        pts = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(9)})
        p, o = np.array([x for x, _ in pts]), np.array([y for _, y in pts])
        best = 0.0
        score = []
        for i in range(len(pts)):
            s = 5.0
            for j in range(i):
                if p[j] < p[i] and o[j] < o[i]:
                    s = max(s, 5 + score[j] - 0.1 * (p[i] - p[j] + o[i] - o[j]))
            score.append(s)
        best = max(score)
        c = passages.chains(p, o)[0]
        total = 5.0 + sum(5 - 0.1 * (p[b] - p[a] + o[b] - o[a]) for a, b in zip(c, c[1:]))
        assert total == pytest.approx(best)


def test_planted_passages(spark):
    rng = random.Random(4)
    shared = prose(rng, 60, 10**6)
    fuzzy = shared.split()
    fuzzy[30] = "changed"
    long = prose(rng, 20_000, 10**6)
    texts = [prose(rng, 90, 10**6) + " " + shared, prose(rng, 200, 10**6), prose(rng, 30, 10**6) + "\n" + shared + " " + prose(rng, 25, 10**6), " ".join(fuzzy), long, "head " + long, "Big " + prose(rng, 60, 10**6), *ODD]
    docs = make(spark, texts)
    got = passages.repeated_passages(docs).collect()
    rows = {(r["doc_id"], r["other_id"]): r for r in got}
    assert set(rows) == {(2, 0), (3, 0), (5, 4)}
    assert (rows[2, 0]["start"], rows[2, 0]["end"], rows[2, 0]["other_start"]) == (30, 90, 90)
    assert rows[3, 0]["matched"] == 59 and rows[3, 0]["n_words"] == 60
    assert rows[5, 4]["n_words"] == 20_000 and rows[5, 4]["start"] == 1
    left = {r["doc_id"]: r["text"] for r in passages.without_passages(docs, passages.repeated_passages(docs)).collect()}
    assert 3 not in left and left[5] == "head " and left[1] == texts[1] and left[7] is None and left[8] == ""
    assert left[2].split() == texts[2].split()[:30] + texts[2].split()[90:]
    assert passages.repeated_passages(make(spark, [])).count() == 0


def test_every_exact_run_is_found(spark):
    rng = random.Random(5)
    blocks = [prose(rng, 55, 10**6) for _ in range(12)]
    texts = [" ".join(rng.choice([prose(rng, 40, 10**6), rng.choice(blocks)]) for _ in range(5)) for _ in range(60)]
    texts += texts[:5]
    covered = defaultdict(set)
    for r in passages.repeated_passages(make(spark, texts)).collect():
        covered[r["doc_id"]].update(range(r["start"], r["end"]))
    first = {}
    for i, t in enumerate(texts):
        w = t.split()
        for j in range(len(w) - 54):
            key = tuple(w[j : j + 55])
            if first.setdefault(key, i) != i:
                assert set(range(j, j + 55)) <= covered[i], (i, j)


def test_a_repeat_whose_parts_are_in_other_documents_is_found(spark):
    rng = random.Random(15)
    texts, stitched = [], []
    for _ in range(12):
        a, b = prose(rng, 30, 10**6), prose(rng, 30, 10**6)
        texts += [f"{prose(rng, 40, 10**6)} {a} {prose(rng, 40, 10**6)}", f"{prose(rng, 40, 10**6)} {b} {prose(rng, 40, 10**6)}"]
        stitched.append(f"{a} {b}")
    n = len(texts)
    texts += [f"{prose(rng, 20, 10**6)} {c}" for c in stitched]
    ends = [" ".join(c.split()[5:55]) for c in stitched]  # just MIN_WORDS words
    texts += [f"{prose(rng, 15, 10**6)} {c} {prose(rng, 9, 10**6)}" for c in ends] + ["x " * 300 + prose(rng, 9), "y " + "x " * 420]
    rows = passages.repeated_passages(make(spark, texts)).collect()
    got = {(r["doc_id"], r["other_id"], r["start"], r["end"], r["other_start"], r["matched"]) for r in rows}
    assert {(n + 12 + i, n + i, 15, 65, 25, 50) for i in range(12)} <= got
    of_x = [r for r in rows if r["doc_id"] == n + 25]
    assert set(range(1, 421)) == {x for r in of_x for x in range(r["start"], r["end"])} and len(of_x) < 20


def test_passages_with_a_fifth_of_their_words_changed_are_found(spark):
    rng = random.Random(16)
    cases = [(n, percent) for n in (52, 60, 80) for percent in (10, 15, 20) for _ in range(20)]
    shared = [prose(rng, n, 10**6).split() for n, _ in cases]
    texts = [f"{prose(rng, 30, 10**6)} {' '.join(w)} {prose(rng, 30, 10**6)}" for w in shared]
    for w, (n, percent) in zip(shared, cases):
        for i in rng.sample(range(n), n * percent // 100):
            w[i] = f"changed{rng.random()}"
        texts.append(f"{prose(rng, 40, 10**6)} {' '.join(w)} {prose(rng, 20, 10**6)}")
    got = {(r["doc_id"], r["other_id"]) for r in passages.repeated_passages(make(spark, texts)).collect()}
    assert sum((len(cases) + i, i) in got for i in range(len(cases))) >= 0.99 * len(cases)


def test_fuzzy_passages_whose_sentences_other_documents_have_are_found(spark):
    """Every sentence of a passage is in an earlier document of its own; a later document repeats the passage with words changed."""
    rng = random.Random(17)
    texts, made, cases = [], [], []
    for n in range(60):
        sentences = [prose(rng, 15, 10**6) for _ in range(5)]
        texts += [f"{prose(rng, 40, 10**6)} {x} {prose(rng, 40, 10**6)}" for x in sentences]
        made.append(" ".join(sentences))
    first = len(texts)
    texts += [f"{prose(rng, 30, 10**6)} {w} {prose(rng, 30, 10**6)}" for w in made]
    for n, w in enumerate(made):
        w, percent = w.split(), (5, 10, 20)[n % 3]
        for i in rng.sample(range(len(w)), len(w) * percent // 100):
            w[i] = f"changed{rng.random()}"
        cases.append((percent, len(texts), first + n))
        texts.append(f"{prose(rng, 40, 10**6)} {' '.join(w)} {prose(rng, 20, 10**6)}")
    got = {(r["doc_id"], r["other_id"]) for r in passages.repeated_passages(make(spark, texts)).collect()}
    recall = {p: sum((a, b) in got for q, a, b in cases if q == p) / 20 for p in (5, 10, 20)}
    assert min(recall.values()) >= 0.9, recall


def test_passages_that_very_many_documents_share(spark):
    """Hot seeds: their matches come as runs, the passages are the same."""
    rng = random.Random(18)
    shared = prose(rng, 80, 10**6)
    texts = [f"{prose(rng, rng.randrange(1, 30), 10**6)} {shared} {prose(rng, 20, 10**6)}" for _ in range(6000)]
    docs = make(spark, texts).select("doc_id", "text").repartition(4)
    rows = passages.repeated_passages(docs).collect()
    own = {i: texts[i].split().index(shared.split()[0]) for i in range(6000)}
    assert {r["doc_id"] for r in rows} == set(range(1, 6000)) and len(rows) < 9000  # other first documents of seeds at the ends add some
    assert {i for i in range(1, 6000) if any(r["start"] <= own[i] and own[i] + 80 <= r["end"] for r in rows if r["doc_id"] == i)} == set(range(1, 6000))


# ---------------------------------------------------------------- 3 near-duplicates


def brute_components(texts, k, percent, ids):
    sets = []
    for t in texts:
        w = WORD.findall(low(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    best = {}
    for i in range(len(texts)):
        best[find(i)] = min(best.get(find(i), 10**18), ids[i])
    return [(ids[i], len(sets[i]), best[find(i)]) for i in range(len(texts))]


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, monkeypatch, k, percent):
    monkeypatch.setattr(near, "LIST", 8)  # lists and clusters that need several blocks
    monkeypatch.setattr(near, "CELL", 600)
    rng = random.Random(6)
    base = prose(rng, 120).split()
    texts = []
    for _ in range(60):
        w = base[:]
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"new{rng.random()}"
        texts.append(" ".join(w))
    texts += [prose(rng, rng.randrange(1, 60)) for _ in range(40)] + texts[:9] + [texts[3].upper(), *ODD, "A b C", "a B c", prose(rng, 20_000)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near.near_duplicates(make(spark, texts, ids), k, percent).collect())
    assert got == sorted(brute_components(texts, k, percent, ids))


def test_near_duplicates_of_odd_ids(spark):
    docs = make(spark, ["a b c d", "a b c d", "a b c d", "q r s t", "q r s t"], [None, 4, 4, None, None])
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near.near_duplicates(docs).collect())
    assert got == {(None, 4, False): 1, (4, 4, True): 2, (None, None, True): 2}
    assert near.near_duplicates(make(spark, [])).count() == 0
    assert near.without_near_duplicates(docs).columns == docs.columns
    kept = Counter((r["doc_id"], r["text"]) for r in near.without_near_duplicates(docs, 3, 85).collect())
    assert kept == {(4, "a b c d"): 1, (None, "q r s t"): 1}


def test_without_near_duplicates_decides_by_row(spark):
    base = "a b c d e f g h i j k l m n o p q r s t"
    texts = [base, "own words of this one", base + " u", "own words of that one", "", "", None, "v w", "v w"]
    docs = make(spark, texts, [1, 2, 2, 3, 4, 4, 4, 5, 5])
    rows = near.without_near_duplicates(docs, 3, 80).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == {(1, base): 1, (2, texts[1]): 1, (3, texts[3]): 1, (4, ""): 2, (4, None): 1, (5, "v w"): 1}
    assert all(r["_k"].startswith("_k") and r["row"].startswith("row") for r in rows)


# ---------------------------------------------------------------- 4 and 6 classifiers


def labelled(spark, texts, bad, column):
    other = "toxic" if column == "quality" else "quality"
    return spark.createDataFrame([(i, b if column == "quality" else 0, b if column == "toxic" else 1) for i, b in enumerate(bad)] + [(None, 1, 1), (0, None, None)], "doc_id long, quality int, toxic int").select("doc_id", column, other)


def test_quality(spark):
    rng = random.Random(7)
    y = [int(i % 4 > 0) for i in range(400)]
    texts = [" ".join(f"Word{rng.randrange(90)}" * rng.randrange(1, 3) for _ in range(60)) + "." if k else " ".join(f"{prose(rng, 1)}$$$" for _ in range(50)) for k in y]
    docs = make(spark, [*texts, *ODD])
    rows = {r["doc_id"]: r for r in quality.quality(docs, labelled(spark, texts, y, "quality")).collect()}
    assert len(rows) == len(texts) + len(ODD) and all(0 <= r["score"] <= 1 for r in rows.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i]["held_out"] == (i in set(held)) for i in range(400))
    assert sum(rows[i]["predicted"] == y[i] for i in held) >= 0.95 * len(held)
    assert {r["score"] for r in quality.quality(docs, labelled(spark, [], [], "quality").limit(0)).collect()} == {0.5}
    assert quality.quality(make(spark, []), labelled(spark, texts, y, "quality")).count() == 0


def test_normal_equations_give_the_least_squares(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(300, 5)), rng.integers(0, 2, 300).astype(float)
    kernel = quality.Kernel(x.mean(axis=0), x.std(axis=0), 1, d=20)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(5)
    a, b = quality.normal_equations(rows, kernel)
    z = kernel(x)
    assert np.allclose(a, z.T @ z) and np.allclose(np.linalg.solve(a + 0.01 * np.eye(21), b), np.linalg.lstsq(np.vstack([z, 0.1 * np.eye(21)]), np.append(y, np.zeros(21)), rcond=None)[0])


def test_fourier_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 6))
    kernel = quality.Kernel(np.zeros(6), np.ones(6), 2, gamma=0.05, d=20_000)
    z = kernel(x)[:, :-1]
    want = np.exp(-0.05 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_isotonic():
    got = quality.isotonic(np.array([1, 1, 0, 2, 1]), np.array([0, 1, 0, 1, 1]))
    assert list(got) == pytest.approx([0, 2 / 3, 2 / 3, 2 / 3, 1])


def test_toxicity(spark):
    rng = random.Random(8)
    y = [int(i % 5 == 0) for i in range(500)]
    texts = [prose(rng, 40) + (" you are a " + rng.choice(["vilex", "Nastyq,", "grubzor"]) + " " + prose(rng, 20) if k else " " + prose(rng, 20)) for k in y]
    docs = make(spark, [*texts, *ODD])
    labels = labelled(spark, texts, y, "toxic")
    rows = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(rows[i]["predicted"] == y[i] for i in held) >= 0.97 * len(held)
    assert len(rows) == len(texts) + len(ODD) and all(0 <= r["score"] <= 1 for r in rows.values())
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in rows.values())
    assert toxicity.toxicity(docs, labels.limit(0)).count() == len(rows)


def test_toxicity_of_short_empty_and_null_texts(spark):
    texts = [("you bad a1", "ok fine 2", "", None, "x")[i % 5] for i in range(400)]
    docs = make(spark, texts)
    labels = labelled(spark, texts, [int(i % 5 == 0) for i in range(400)], "toxic")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 400 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if texts[r["doc_id"]] == "you bad a1"}) == 1  # ties
    kept = toxicity.without_toxic(docs, labels).collect()
    assert len(kept) == sum(r["predicted"] == 0 for r in rows) and all(r["_score"] == f"_score{r['doc_id']}" for r in kept)
    empty = make(spark, ["", None] * 50)
    assert {r["predicted"] for r in toxicity.toxicity(empty, labels.filter("doc_id < 100")).collect()} <= {0, 1}
    assert toxicity.toxicity(make(spark, []), labels).count() == 0


def test_toxicity_features_against_plain_python(spark):
    lexicon_words = {"bad": 2.0, "worse": 3.0}
    hashes = toxicity._own_hashes(["bad"])[0], toxicity._own_hashes(["worse"])[0]
    lexicon = [(0, int(hashes[0].view(np.int64)), 2.0), (0, int(hashes[1].view(np.int64)), 3.0)]
    texts = ["You are BAD and worse than that, far from all other good people bad!", "nothing here at all", "", None, "bad " * 3000 + "you", "F.U.N b4d A B"]
    docs = make(spark, texts).selectExpr("struct(doc_id) AS row", "text")
    names = toxicity.FEATURES
    for r in toxicity.with_features(docs, lexicon).collect():
        text, x = texts[r["row"]["doc_id"]] or "", dict(zip(names, r["x"]))
        w = re.findall(r"[a-z0-9]+", text.lower()) if "." not in text else None
        size = max(len(text.encode()), 1)
        assert x["upper"] == pytest.approx(sum(c.isupper() for c in text) / size) and x["bang"] == pytest.approx(text.count("!") / size)
        if w is not None:
            hit = [i for i, v in enumerate(w) if v in lexicon_words]
            you = [i for i, v in enumerate(w) if v in toxicity.SECOND_PERSON]
            assert x["hits"] == pytest.approx(len(hit) / max(len(w), 1)) and x["log_hits"] == pytest.approx(math.log1p(len(hit)))
            assert x["best"] == max([lexicon_words[w[i]] for i in hit], default=0) and x["you"] == pytest.approx(len(you) / max(len(w), 1))
            assert x["near_you"] == pytest.approx(sum(any(abs(i - j) <= toxicity.NEAR for j in you) for i in hit) / max(len(hit), 1))


# ---------------------------------------------------------------- 5 pieces


def test_long_runs_are_sampled_as_short_ones():
    m = pieces.model(PIECES, 1.0)
    rng = random.Random(12)
    for t in ("".join(chr(rng.choice([rng.randrange(0x3041, 0x3097), rng.randrange(0x4E00, 0x9FA5), 0x1F600])) for _ in range(900)), "".join(rng.choice("abcdehinorst019") for _ in range(3000)), "a" * 700 + "é" * 300):
        data = np.frombuffer(t.encode(), np.uint8)
        key = np.array([5], np.uint64)
        want = pieces.encode(m, data, np.array([0, len(data)]), key, long=10**9)[0]
        run = np.append(np.uint8(32), data)
        starts, ids = pieces.long_run(m, run, key[0], 0, window=200)
        assert ids.tolist() == want.tolist() and starts[0] == 0
        assert pieces.decode(m, ids, np.array([len(ids)]))[0].tobytes() == t.encode()


def test_a_megabyte_without_spaces_takes_seconds(spark):
    import time

    rng = random.Random(13)
    text = "".join(chr(rng.choice([rng.randrange(0x3041, 0x3097), rng.randrange(0x4E00, 0x9FA5)])) for _ in range(333_000))
    pieces.model(PIECES, 1.0)
    began = time.time()
    data = np.frombuffer(text.encode(), np.uint8)
    ids, counts = pieces.encode(pieces.model(PIECES, 1.0), data, np.array([0, len(data)]), np.array([1], np.uint64))
    assert pieces.decode(pieces.model(PIECES, 1.0), ids, counts)[0].tobytes() == data.tobytes() and time.time() - began < 10
    assert pieces.sampled_pieces(make(spark, []), PIECES).count() == 0
    same = pieces.sampled_pieces(make(spark, ["a b c"] * 3, [1, 1, 1]), PIECES).collect()
    assert len(same) == 3 and len({tuple(r["ids"]) for r in same}) == 1


def test_pieces_are_lossless_and_reproducible(spark):
    docs = make(spark, [*ODD, "Hello  world, again\r\n", "a b" * 3000])
    rows = {r["doc_id"]: r for r in pieces.sampled_pieces(docs, PIECES).collect()}
    assert all(r["lossless"] for r in rows.values()) and rows[0]["ids"] == [] and rows[1]["n_ids"] == 0
    for i, t in enumerate(ODD):
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    again = {r["doc_id"]: r["ids"] for r in pieces.sampled_pieces(docs.repartition(3), PIECES).collect()}
    assert again == {i: r["ids"] for i, r in rows.items()}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert sp.decode(rows[13]["ids"]) == "Hello  world, again\r\n"


def test_samples_follow_the_lattice():
    m = pieces.model(PIECES, 0.3)
    known = {bytes(m.bytes[m.starts[i] : m.starts[i] + m.lengths[i]]): (int(i), float(w)) for h, ids, ws, _ in m.tables.values() for i, w in zip(ids, ws)}

    def paths(s):
        if not s:
            yield (), 0.0
        for n in range(1, len(s) + 1):
            if s[:n] in known:
                for p, w in paths(s[n:]):
                    yield (known[s[:n]][0], *p), known[s[:n]][1] + w

    want = {p: math.exp(w) for p, w in paths(b" thing")}
    total, n = sum(want.values()), 20_000
    data = np.frombuffer(b"thing" * n, np.uint8)
    ids, counts = pieces.encode(m, data, np.arange(0, 5 * n + 1, 5), pieces.mix(np.arange(n, dtype=np.uint64)))
    ends = np.cumsum(counts)
    got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(ends - counts, ends))
    assert sum(abs(got[p] / n - w / total) for p, w in want.items()) / 2 < 0.03


# ---------------------------------------------------------------- 7 token ids


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for x in ([0], [7] * 50, [0, 2**32 - 1], rng.integers(0, 49408, 1024), np.where(rng.random(1000) < 0.01, 2**31, rng.integers(0, 9, 1000))):
        x = np.array(x, np.uint32)
        got, end = token_ids.unpack_block(b"zz" + token_ids.pack_block(x), 2)
        assert (got == x).all() and end == 2 + len(token_ids.pack_block(x))


def test_token_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    rng = random.Random(9)
    texts = [*ODD, *(prose(rng, rng.randrange(1, 900)) for _ in range(30)), "It's Don'T 'S", "İI ΣΑΣ", "<|STARTOFTEXT|> <|startoftext|>"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = {r["doc_id"]: r for r in token_ids.token_ids(make(spark, texts, ids), BPE).collect()}
    at = 0
    for i, text in sorted(zip(ids, texts)):
        want = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(want), zlib.crc32(want.tobytes())), text
        at += len(want)
    repeated = token_ids.token_ids(make(spark, ["b", "a", "a", "c"], [3, 3, 3, None]), BPE).orderBy("start").collect()
    assert [r["doc_id"] for r in repeated] == [None, 3, 3, 3] and [r["start"] for r in repeated] == [0, 2, 4, 6]
    assert token_ids.token_ids(make(spark, []), BPE).count() == 0


# ---------------------------------------------------------------- 8 mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        weight = sum(w[s] for s in names if s not in capped)
        goal = {s: 2.0 * sizes[s] if s in capped else left * w[s] / weight for s in names}
        over = {s for s in names if s not in capped and goal[s] > 2 * sizes[s]}
        if not over:
            return goal
        capped |= over


def test_mixing(spark):
    rng = random.Random(10)
    texts = [prose(rng, rng.randrange(1, 700)) for _ in range(150)] + ODD
    sources = [rng.choice(["a", "b", "b", "b", "b", "é", None]) for _ in texts]
    docs = make(spark, texts, sources=sources)
    rows = {r["doc_id"]: r for r in mixing.mix_sources(docs).collect()}
    size = {i: len(WORD.findall((t or "").encode())) for i, t in enumerate(texts)}
    sizes = Counter()
    for i, s in enumerate(sources):
        sizes[s] += size[i]
    goal, taken = brute_targets(sizes), Counter()
    for i, r in rows.items():
        assert (r["size"], r["source_size"]) == (size[i], sizes[sources[i]]) and r["target"] == pytest.approx(goal[sources[i]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[sources[i]] += r["taken"]
    assert len(rows) == len(texts) and all(taken[s] == round(goal[s]) for s in sizes)
    assert {i: r["taken"] for i, r in rows.items()} == {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs.repartition(7)).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    n = Counter()
    for r in mixed.collect():
        n[r["doc_id"]] += len(WORD.findall(r["text"].encode()))
        assert r["n_chars"] == len(r["text"]) and set(r["text"].split()) <= set(texts[r["doc_id"]].split())
    assert n == {i: r["taken"] for i, r in rows.items() if r["taken"]}
    assert mixing.mix_sources(make(spark, [])).count() == 0 and mixing.mix_sources(make(spark, ["", None])).count() == 2


def test_taken_follows_the_slots(spark):
    """taken against the slots played out in plain Python, over several shards and chunks of them."""
    rng = random.Random(14)
    texts = [prose(rng, rng.randrange(1, 200)) for _ in range(80)]
    sources = [rng.choice("aabc") for _ in texts]
    docs = make(spark, texts, sources=sources)
    small = mixing.sized(docs)
    goals = mixing.targets(small)
    slots = mixing.draw_slots(goals, 16, 17, shard_slots=8, size=4).collect()
    placed = mixing.streams(small, goals).collect()
    goal = {r["s"]: round(r["target"]) for r in goals.collect()}
    at = defaultdict(dict)
    for r in placed:
        for i in range(r["size"]):
            at[r["s"]][r["at"] + i] = r["doc_id"]
    for s in at:
        assert sorted(at[s]) == list(range(len(at[s])))  # every word has a place of its own
        own = sorted((r["slot"], r["block"], r["words"]) for r in slots if r["s"] == s)
        assert [x[0] for x in own] == list(range(len(own))) and sum(x[2] for x in own) == goal[s]
        n_blocks = -(-len(at[s]) // 16)
        a_pass = [x[1] for x in own[:n_blocks]]
        assert len(set(a_pass)) == len(a_pass) and set(a_pass) <= set(range(n_blocks))  # a pass takes each block once
    taken = Counter()
    for r in slots:
        for i in range(r["words"]):
            taken[at[r["s"]][r["block"] * 16 + i]] += 1
    assert len({r["shard"] for r in slots}) > 8
    rows = mixing.mix_sources(docs, block_words=16, shard_slots=8).collect()
    assert {r["doc_id"]: r["taken"] for r in rows} == {i: taken[i] for i in range(len(texts))}
    # the shards that a document's words are in, by the slots that take them
    shards = defaultdict(set)
    for r in mixing.draw_slots(goals, 16, 17, shard_slots=8).collect():
        for i in range(r["words"]):
            shards[at[r["s"]][r["block"] * 16 + i]].add(r["shard"])
    assert {r["doc_id"]: r["shards"] for r in rows} == {i: len(shards[i]) for i in range(len(texts))} and all(r["shard"] in shards[r["doc_id"]] for r in rows if r["shards"])
    other = mixing.mix_sources(docs, block_words=16, seed=18, shard_slots=8).collect()
    assert [(r["doc_id"], r["shard"]) for r in sorted(other)] != [(r["doc_id"], r["shard"]) for r in sorted(rows)]


def test_shards_have_the_weights_of_their_sources(spark):
    goals = spark.createDataFrame([(0, 300_000, 400_000.0), (1, 200_000, 160_000.0), (2, 90_000, 80_000.0)], "s long, source_size long, target double")
    slots = mixing.draw_slots(goals, 16, 5, shard_slots=500).groupBy("shard", "s").count().collect()
    total = sum(r["count"] for r in slots)
    of = Counter()
    for r in slots:
        of[r["s"]] += r["count"]
    shards = 1 + max(r["shard"] for r in slots)
    assert shards == -(-total // 500) and {s: of[s] for s in (1, 2)} == {1: 10_000, 2: 5000}
    found = {(r["shard"], r["s"]): r["count"] for r in slots}
    chi = sum((found.get((i, s), 0) - of[s] / shards) ** 2 / (of[s] / shards) for s in of for i in range(shards))
    free = len(of) * (shards - 1)
    assert abs(chi - free) < 5 * math.sqrt(2 * free)


def test_mixing_of_repeated_rows_and_ties(spark):
    texts = ["a b c d"] * 30 + ["e f"] * 3 + [None] * 3
    docs = make(spark, texts, ids=[7] * 20 + [None] * 10 + list(range(6)), sources=["x"] * 30 + ["y", "y", None] * 2)
    rows = [tuple(r) for r in mixing.mix_sources(docs, block_words=3, shard_slots=4).collect()]
    again = [tuple(r) for r in mixing.mix_sources(docs.repartition(5), block_words=3, shard_slots=4).collect()]
    assert len(rows) == 36 and sorted(rows, key=str) == sorted(again, key=str) and all(r[4] <= 2 * r[1] for r in rows)


def test_chunks_share_all_slots():
    for slots, shards in ((1000, 37), (0, 5), (7, 1)):
        parts = [mixing.chunk_share(slots, shards, c, [1, 2], 4) for c in range(-(-shards // 4))]
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) == slots


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 5)) == list(range(n))
    assert list(mixing.permute(np.arange(100), 100, 1)) != list(mixing.permute(np.arange(100), 100, 2))


# ---------------------------------------------------------------- 9 top-k


def test_top_k(spark):
    rng = np.random.default_rng(11)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, 20)], i % 4) for i in range(700)]
    rows += [(1000 + i, rows[5][1], 0) for i in range(60)]  # ties
    rows += [(2000, None, 0), (2100, [float("nan")] * 20, 0), (2200, [None, 1.0], 0), (2300, [1.0, float("inf")], 0), (2400, [], 0), (2401, [], 0), (2500, [0.5], 1), (None, [0.1] * 20, 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumnRenamed("label", "d")
    got = defaultdict(list)
    for r in topk.top_k(vectors, query_block=3, least_block=100).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    usable = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in usable:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))[:10]
            want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert dict(got) == {q: b for q, b in want.items() if b}
    assert topk.top_k(vectors.limit(0)).count() == 0


def test_cells_below_the_floor_add_nothing():
    rng = np.random.default_rng(13)
    q, c = rng.integers(-900, 900, (4, 32)), rng.integers(-900, 900, (300, 32))
    none = np.full(4, -np.inf)
    who, ids, scores = topk.search_cell(np.arange(4), q, none, np.arange(100, 400), c, 10)
    floor = np.array([scores[who == i][4] for i in range(4)], float)
    w2, i2, s2 = topk.search_cell(np.arange(4), q, floor, np.arange(100, 400), c, 10)
    assert all((i2[w2 == i] == ids[who == i][:5]).all() and (w2 == i).sum() == 5 for i in range(4))
    assert len(topk.search_cell(np.arange(4), q, np.full(4, 1e12), np.arange(100, 400), c, 10)[0]) == 0


def test_bounds_hold():
    rng = np.random.default_rng(12)
    a, b = rng.integers(-900, 900, (40, 30)), rng.integers(-900, 900, (50, 30))
    for s in (1, 4, 16, 64):
        assert (topk.bounds(a, s) @ topk.bounds(b, s).T + 1e-3 >= a @ b.T).all()
    big = np.array([[2**40, 3]])
    assert topk.exact(big, np.array([[2**20, 5]]))[0, 0] == 2**60 + 15


# ---------------------------------------------------------------- 10 WARC


def test_warc(spark):
    html = ["<p>a</p>", None, "", "<p>a</p>", "<p>ü</p>" * 30_000, "<p>a</p>", "x\r\n\r\nContent-Length: 3"]
    ids = [5, 2, 9, 3, 4, None, 8]
    pages = spark.createDataFrame([(i, None if i == 4 else f"http://h/{i}\r\nx: y", h, 1) for i, h in zip(ids, html)], "page_id long, url string, html string, first int")
    got = {r["page_id"]: r for r in warc.warc_round_trip(pages).collect()}
    for i, h in zip(ids, html):
        data = (h or "").encode()
        same = [j for j, g in zip(ids, html) if (g or "") == (h or "") and j is not None]
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == min(same) else ("revisit", min(same)))
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_warc_reader_checks():
    import io

    a, b = (warc.page_record(i, "u", b"body" * 50_000, None, False) for i in (1, 2))
    assert [h["warc-record-id"] for h, _ in warc.read_records(io.BytesIO(a + b))] == ["<urn:page:1>", "<urn:page:2>"]
    raw = zlib.decompress(a, 31)
    again = lambda x: zlib.compressobj(6, zlib.DEFLATED, 31)
    for wrong in (raw.replace(b"bodybody", b"bodyBody", 1), raw[:-4] + b"more\r\n\r\n", raw[:-300]):
        z = again(wrong)
        with pytest.raises(warc.BadRecord):
            list(warc.read_records(io.BytesIO(z.compress(wrong) + z.flush())))
    with pytest.raises(warc.BadRecord):
        list(warc.read_records(io.BytesIO(a[:-20])))


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "sentencepiece"]
    columns, n = docs.columns, [docs.count()]
    from sitelens.llm.common import written

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        n.append(docs.count())
    assert n[1] <= n[0] and n[2] < n[1]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.filter("not lossless").count() == 0 and last.count() == n[-1]
