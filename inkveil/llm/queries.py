"""The queries of this subpackage, as the entry module registers them, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkveil.llm.jaccard_join import jaccard_components

    return jaccard_components(documents(spark, sf_dir), words=3, top=90, bottom=100)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkveil.llm.exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir).select("doc_id", "text"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkveil.llm.mixing import mix

    return mix(documents(spark, sf_dir))


def word_tokenizer() -> str:
    """Path of the tokenizer file of op8, where the executor has it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_model() -> str:
    """Path of the sentencepiece model of op5, where the executor has it."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkveil.llm.chat_format import rotate_perspectives

    return rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkveil.llm.toxicity import grade_toxicity, train

    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return grade_toxicity(docs.select("doc_id", "text"), model).drop("text")


def op4_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkveil.llm.audio_columns import audio_columns, feature_digest

    return feature_digest(audio_columns(documents(spark, sf_dir), keep_media=False))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkveil.llm.pieces import piece_digests

    return piece_digests(documents(spark, sf_dir), piece_model)


def op6_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkveil.llm.html_wrapper import extract_text

    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_find_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkveil.llm.secrets import find_secrets

    found = find_secrets(documents(spark, sf_dir)).drop("spans")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.col("spans_text").alias("spans"), "n_learned")


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkveil.llm.token_records import token_records

    return token_records(documents(spark, sf_dir), word_tokenizer)


OP2_SQL = """
WITH seen AS (
  SELECT c.conv_id, p.perspective, c.turn, c.role, c.text, coalesce(c.role = p.perspective, false) AS mine,
         coalesce(c.role = 'system', false) AS told
  FROM conversations c JOIN (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role IS NOT NULL AND role <> 'system') p
    ON c.conv_id = p.conv_id),
named AS (
  SELECT *, CASE WHEN told THEN role WHEN mine THEN 'assistant' ELSE 'user' END AS chat_role,
         CASE WHEN NOT told AND NOT mine THEN role END AS name FROM seen),
cut AS (
  SELECT *, '<|im_start|>' || chat_role || coalesce(' name=' || translate(replace(name, '<|im_', '<| im_'), chr(10) || chr(13), '  '), '') || chr(10) AS head FROM named),
sized AS (
  SELECT *, head || replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS segment FROM cut),
placed AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS char_end FROM sized)
SELECT conv_id, perspective, turn, chat_role, name, segment, CAST(mine AS INT) AS mask,
       char_end - length(segment) AS char_start, char_end,
       CASE WHEN mine THEN char_end - length(segment) + length(head) END AS mask_start,
       CASE WHEN mine THEN char_end - 1 END AS mask_end
FROM placed
"""

#: All pairs that share a shingle: for small tables.
OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
         WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
t AS (SELECT doc_id, unnest(sh) AS x FROM s),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM met JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce((SELECT min(b) FROM reach WHERE a = n.doc_id), n.doc_id)) AS component_id,
       (SELECT count(*) FROM links WHERE a = n.doc_id) AS n_links FROM n
"""

OP10_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_chat_perspectives": op2_chat_perspectives,
    "op3_toxicity": op3_toxicity,
    "op4_audio_fingerprints": op4_audio_fingerprints,
    "op5_pieces": op5_pieces,
    "op6_extract_text": op6_extract_text,
    "op7_find_secrets": op7_find_secrets,
    "op8_token_records": op8_token_records,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_exact_dedup": op10_exact_dedup,
}
ORACLES = {"op2_chat_perspectives": OP2_SQL, "op9_jaccard_join": OP9_SQL, "op10_exact_dedup": OP10_SQL}
