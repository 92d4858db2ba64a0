"""The registered queries of the corpus operators, and their SQL where SQL can say them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_columns(spark, sf_dir):
    from .media import text_media

    return text_media(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark, sf_dir):
    from .passages import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


def op3_minhash_dedup(spark, sf_dir):
    from .near import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_quality(spark, sf_dir):
    from .quality import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_sentencepiece(spark, sf_dir):
    from .pieces import sampled_pieces

    return sampled_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_toxicity(spark, sf_dir):
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_token_ids(spark, sf_dir):
    from .token_ids import token_ids

    return token_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_mixing(spark, sf_dir):
    from .mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"))


def op9_topk(spark, sf_dir):
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"))


def op10_warc(spark, sf_dir):
    from .warc import warc_round_trip

    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark, sf_dir):
    from .merkle import tampered_manifest

    return tampered_manifest(_table(spark, sf_dir, "documents"))


def op12_jaccard_join(spark, sf_dir):
    from .jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark, sf_dir):
    from .audit import filter_audit

    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_media_columns": op1_media_columns,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_quality": op4_quality,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_toxicity": op6_toxicity,
    "op7_token_ids": op7_token_ids,
    "op8_mixing": op8_mixing,
    "op9_topk": op9_topk,
    "op10_warc": op10_warc,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_filter_audit": op13_filter_audit,
}


def _merkle_sql(lower: int = 8, upper: int = 4) -> str:
    """The tree level by level: l0 to l8 within a lang (16,777,216 leaves at most), then over 4096 langs; f0 on, each leaf folded."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    hashed = lambda text: "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    out = [
        f"""d AS (
            SELECT row_number() OVER () AS r, doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, {hashed("text")} AS leaf,
                {hashed("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered,
                list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), [CAST(ord(c) AS UBIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
                    lambda s, b: list_reduce(list_prepend(xor(s, b), [CAST(0 AS UBIGINT) FOR _ IN range(8)]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS crc
            FROM documents
        )""",
        """p AS (
            SELECT r, doc_id, g, leaf, CASE WHEN xor(crc, CAST(4294967295 AS UBIGINT)) % 3 = 0 THEN lowered ELSE leaf END AS other,
                row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n
            FROM d
        )""",
        "l0 AS (SELECT g, i, n, leaf AS h FROM p)",
        "f0 AS (SELECT r, g, i, n, other AS h, '' AS path FROM p)",
    ]
    for k in range(lower + upper + 1):
        if k == lower:  # the subroots are the leaves of the upper tree
            out.append(f"l{k + 1} AS (SELECT 0 AS g, g AS i, count(*) OVER () AS n, h FROM l{k})")
            out.append(f"f{k + 1} AS (SELECT r, 0 AS g, g AS i, (SELECT count(*) FROM l{k}) AS n, h, path FROM f{k})")
            continue
        out.append(f"l{k + 1} AS (SELECT g, i // 8 AS i, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM l{k} GROUP BY g, i // 8, n)")
        out.append(f"""f{k + 1} AS (
            SELECT r, g, i // 8 AS i, (n + 7) // 8 AS n,
                CASE WHEN n = 1 THEN h ELSE sha256(coalesce(string_agg(sh, '' ORDER BY si) FILTER (si < i), '') || h || coalesce(string_agg(sh, '' ORDER BY si) FILTER (si > i), '')) END AS h,
                path || coalesce(string_agg(sh, '' ORDER BY si) FILTER (si <> i), '') AS path
            FROM (SELECT f.*, s.i AS si, s.h AS sh FROM f{k} f JOIN l{k} s ON s.g = f.g AND s.i // 8 = f.i // 8) GROUP BY r, g, i, n, h, path
        )""")
    last = lower + upper + 1
    return "WITH " + ", ".join(out) + f"""
        SELECT p.doc_id, p.leaf, s.h AS subroot, t.h AS root, sha256(f.path) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
        FROM p JOIN l{lower} s ON s.g = p.g JOIN f{last} f ON f.r = p.r CROSS JOIN l{last} t"""


def _linked_sql(k: int, percent: int, more: str = "") -> str:
    """Components of documents whose sets of k-word shingles have this similarity."""
    shingle = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
    return rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, CASE WHEN len(w) < {k} THEN array_to_string(w, ' ') ELSE {shingle} END AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), p AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), l AS (
            SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {percent} * (a.n + b.n - c)
        ), e AS (
            SELECT x, y FROM l UNION SELECT y, x FROM l
        ), r AS (
            SELECT doc_id, doc_id AS o FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.o
        ), m AS (
            SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id{more}
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.doc_id = d.doc_id"""


# The SQL of the records, over all rows.
ORACLE_SQL: dict[str, str] = {
    "op3_minhash_dedup": _linked_sql(3, 85, ", d.doc_id = m.component_id AS kept"),
    "op9_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_merkle_manifest": _merkle_sql(),
    "op12_jaccard_join": _linked_sql(5, 80),
    "op13_filter_audit": r"""
        WITH x AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), f AS (
            SELECT t, min(doc_id) AS first FROM x GROUP BY t
        ), y AS (
            SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
        ), m AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
                + CASE WHEN 100 * len(regexp_extract_all(x.t, '[A-Z]')) > 5 * length(x.t) THEN 4 ELSE 0 END
                + CASE WHEN regexp_matches(x.t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN x.doc_id > first THEN 16 ELSE 0 END AS mask
            FROM x JOIN f ON f.t = x.t LEFT JOIN y ON y.doc_id = x.doc_id
        ), c AS (
            SELECT part, mask, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask
        ), l AS (
            SELECT CAST(unnest(range(5)) AS INTEGER) AS i
        ), o AS (
            SELECT a.i AS i1, b.i AS i2, c.i AS i3, d.i AS i4, e.i AS i5 FROM l a, l b, l c, l d, l e
            WHERE (1 << a.i) | (1 << b.i) | (1 << c.i) | (1 << d.i) | (1 << e.i) = 31
        ), s AS (
            SELECT chr(65 + i1) || chr(65 + i2) || chr(65 + i3) || chr(65 + i4) || chr(65 + i5) AS filter_order, unnest(range(1, 6)) AS step,
                unnest([0, 1 << i1, (1 << i1) + (1 << i2), (1 << i1) + (1 << i2) + (1 << i3), 31 - (1 << i5)]) AS before,
                unnest([1 << i1, 1 << i2, 1 << i3, 1 << i4, 1 << i5]) AS own
            FROM o
        ), r AS (
            SELECT part, filter_order, step, own,
                sum(CASE WHEN mask & (before + own) = 0 THEN docs ELSE 0 END) AS kept,
                sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN docs ELSE 0 END) AS removed,
                sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN docs ELSE 0 END) AS redundant,
                sum(CASE WHEN mask = own THEN docs ELSE 0 END) AS unique_fails,
                sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost,
                sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
            FROM c, s GROUP BY part, filter_order, step, own
        )
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
            CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
            CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM r""",
}
