"""The registered queries of this subpackage, over whole tables, and SQL where it can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterwise.llm import (
    conversation_repair,
    decontaminate,
    exact_dedup,
    html_text,
    language_id,
    lm_score,
    mixing,
    near_dedup,
    quality,
    secret_scan,
    substring_dedup,
    token_counts,
    whitening,
)


#: Folder of the public vocabulary files.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(_table(spark, sf_dir, "documents")).drop("tie")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~held))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.dealt_mix(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = token_counts.read_ranks(spark, f"{VOCABULARIES}/byte_bpe_50k.tiktoken")
    return token_counts.edited_counts(_table(spark, sf_dir, "documents"), ranks)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeat_digests(_table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score_documents(_table(spark, sf_dir, "documents"))
    # sums of floating numbers differ in their last digits with the order of the rows
    return scored.withColumns({c: F.round(c, 4) for c in ("log_score", "mean_log_score")})


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = quality.held_out(F.col("doc_id"))
    model = quality.fit(docs.where(~held), _table(spark, sf_dir, "labels").where(~held))
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_digests(conversation_repair.damaged(_table(spark, sf_dir, "conversations")))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit_whitening(vectors))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_secret_scan": op3_secret_scan,
    "op4_mixing": op4_mixing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_decontamination": op7_decontamination,
    "op8_token_counts": op8_token_counts,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_lm_score": op10_lm_score,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE = {
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op7_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
               FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
        dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
               FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
                     FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
        hit AS (SELECT doc_id, k, i, item FROM dw JOIN bw USING (k, g)),
        n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY 1),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
              FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
    "op9_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS g
                FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
        rep AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(i, i + 34)) AS p FROM win JOIN rep USING (g))),
        word AS (SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM d)),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op10_lm_score": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        g AS (SELECT doc_id, p, w[p] AS b, CASE WHEN p > 1 THEN w[p - 1] ELSE '' END AS a
              FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM d)),
        t AS (SELECT *, count(*) OVER (PARTITION BY a, b) - count(*) OVER (PARTITION BY doc_id, a, b) AS pair,
                     count(*) OVER (PARTITION BY a) - count(*) OVER (PARTITION BY doc_id, a) AS ctx,
                     count(*) OVER (PARTITION BY b) - count(*) OVER (PARTITION BY doc_id, b) AS uni,
                     greatest(count(*) OVER () - count(*) OVER (PARTITION BY doc_id), 1) AS rest FROM g),
        s AS (SELECT doc_id, sum(CASE WHEN pair > 0 THEN ln(pair) - ln(ctx)
                                      ELSE ln(0.4) + ln(CASE WHEN uni > 0 THEN uni ELSE 0.5 END) - ln(rest) END) AS x,
                     sum(CASE WHEN pair > 0 THEN 0 ELSE 1 END) AS backed, sum(CASE WHEN pair > 0 OR uni > 0 THEN 0 ELSE 1 END) AS unk
              FROM t GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(x, 0), 4) AS log_score,
               round(x / len(w), 4) AS mean_log_score, coalesce(backed, 0)::BIGINT AS n_backed_off, coalesce(unk, 0)::BIGINT AS n_unknown
        FROM d LEFT JOIN s USING (doc_id)
    """,
}
