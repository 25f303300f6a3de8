"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from terrazzo.session import ship


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrazzo.llm.lm_score import pseudo_likelihood

    return pseudo_likelihood(_docs(spark, sf_dir))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrazzo.llm.secrets import scan

    return scan(_docs(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrazzo.llm.token_counts import cache_folder, token_counts

    return token_counts(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), cache_folder(spark, sf_dir))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrazzo.llm.quality_model import quality_scores

    return quality_scores(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrazzo.llm.packing import pack

    return pack(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrazzo.llm.host_rules import judge

    return judge(_docs(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrazzo.llm.simhash import near_duplicates

    return near_duplicates(_docs(spark, sf_dir), words=4)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrazzo.llm.exact_dedup import decide

    return decide(_docs(spark, sf_dir)).withColumnRenamed("text_digest", "text_sha256")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrazzo.llm.toxicity import toxicity

    return toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrazzo.llm.mixing import order

    return order(_docs(spark, sf_dir)).drop("source")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrazzo.llm.fill_middle import fill_in_middle, summary

    return summary(fill_in_middle(_docs(spark, sf_dir)))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrazzo.llm.repeats import remove_repeats, summary

    return summary(remove_repeats(_docs(spark, sf_dir)))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrazzo.llm.resampling import resample

    return resample(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("n_words")


QUERIES = {
    "op1_pseudo_likelihood": op1_pseudo_likelihood,
    "op2_secrets": op2_secrets,
    "op3_token_counts": op3_token_counts,
    "op4_quality_model": op4_quality_model,
    "op5_packing": op5_packing,
    "op6_host_rules": op6_host_rules,
    "op7_simhash": op7_simhash,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_fill_middle": op11_fill_middle,
    "op12_repeats": op12_repeats,
    "op13_resampling": op13_resampling,
}

ORACLE_SQL = {
    "op8_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             w AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, w.keep_id, w.group_size, d.doc_id IS NOT DISTINCT FROM w.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN w ON d.t = w.t
    """,
    "op11_fill_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
             u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS h FROM d),
             c AS (SELECT doc_id, t, units, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS i, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS j,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
             s AS (SELECT *, array_to_string(units[1:i], '') AS p, array_to_string(units[i + 1:j], '') AS m, array_to_string(units[j + 1:], '') AS f FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || f || '<M>' || m ELSE '<S>' || f || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
        FROM s
    """,
    "op12_repeats": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
             b AS (SELECT r, doc_id, len(h) // 2 AS n, 128 * j AS base, substr(h, 256 * j + 1, 354) AS h FROM (SELECT *, unnest(range(0, (len(h) + 255) // 256)) AS j FROM d)),
             w AS (SELECT r, doc_id, base + k AS i, substr(h, 2 * k + 1, 2) AS byte, CASE WHEN base + k + 50 <= n THEN substr(h, 2 * k + 1, 100) END AS s FROM (SELECT *, unnest(range(0, least(128, n - base))) AS k FROM b)),
             m AS (SELECT s, min(doc_id) AS first FROM w WHERE s IS NOT NULL GROUP BY s),
             c AS (SELECT r, i, byte, coalesce(bool_or(first < doc_id) OVER (PARTITION BY r ORDER BY i ROWS 49 PRECEDING), false) AS gone FROM w LEFT JOIN m USING (s)),
             e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS opens FROM c),
             k AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), '') AS rest FROM e GROUP BY r)
        SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (r)
    """,
    "op13_resampling": r"""
        WITH byte AS (SELECT list(c ORDER BY n) AS crc FROM (SELECT n, list_reduce([n] || [0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) AS r(n))),
             d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
             b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
             e AS (SELECT r, f, count(*) AS n FROM (SELECT r, unnest(w) AS f FROM d) GROUP BY r, f),
             v AS (SELECT f, sum(s) AS s, sum(t) AS t FROM (SELECT f, n AS s, 0 AS t FROM e UNION ALL SELECT f, 0, 1 FROM b) GROUP BY f),
             x AS (SELECT f, s, t, hex(encode(f)) AS hex FROM v),
             k AS (SELECT f, s, t, xor(list_reduce([4294967295] || list_transform(range(0, len(hex) // 2), lambda i: CAST('0x' || substr(hex, 2 * i + 1, 2) AS BIGINT)),
                 lambda a, b: xor(a >> 8, crc[CAST(xor(a, b) & 255 AS INTEGER) + 1])), 4294967295) % 10000 AS bucket FROM x, byte),
             h AS (SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM k GROUP BY bucket),
             z AS (SELECT coalesce(sum(s), 0) + 10000 AS s, coalesce(sum(t), 0) + 10000 AS t FROM h),
             g AS (SELECT bucket, CAST(floor(1000 * ln((h.t + 1) * z.s / ((h.s + 1) * z.t))) AS BIGINT) AS gain FROM h, z),
             q AS (SELECT r, CAST(sum(n * gain) AS BIGINT) AS weight FROM e JOIN k USING (f) JOIN g USING (bucket) GROUP BY r),
             o AS (SELECT d.doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
                 coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN q USING (r)),
             p AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 10 * count(*) OVER () // 100 AS drawn FROM o WHERE n_features >= 20)
        SELECT o.doc_id, n_features, weight, o.score, CASE WHEN rank <= drawn THEN rank END AS rank FROM o LEFT JOIN p ON o.doc_id = p.doc_id AND o.score = p.score
    """,
}
