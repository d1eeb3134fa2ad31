"""Queries of the training-data operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embedding, lm, minhash, mixing, packing, quality, search, secrets, warc
from .common import table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_turns(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return m.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.col("mix_rate").alias("rate"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.search(docs, docs.filter(F.col("doc_id") % 100 == 0))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can count of op10_secrets."""
    return op10_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


SECRET_COUNTS = r"""
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(coalesce("text", ''), '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(coalesce("text", ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(coalesce("text", ''), '[0-9a-f]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_hex FROM documents
"""


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op3_mix_sources: sizes and targets, the same for all documents of a source."""
    m = op3_mix_sources(spark, sf_dir)
    return m.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


#: Each round cuts what is above its cap and shares the rest again; rounds beyond the last change nothing.
MIX_TARGETS = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
r AS (SELECT 0 AS i, (SELECT CAST(sum(source_size) AS DOUBLE) / sum(w) FROM s) AS level UNION ALL
  SELECT i + 1, (SELECT ((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) FILTER (3 * source_size < r.level * w), 0)) / CAST(sum(w) FILTER (3 * source_size >= r.level * w) AS DOUBLE) FROM s) FROM r WHERE i < 40)
SELECT d.doc_id, d.size, s.source_size, round(least(3.0::DOUBLE * s.source_size, w * (SELECT level FROM r WHERE i = 40)), 3) AS target FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_dedup, op2_chat_format, op3_mix_sources, op4_quality, op5_embedding_dedup, op6_bm25_topk, op7_warc, op8_lm_score, op9_pack, op10_secrets, secret_counts, mix_targets)}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": minhash.ORACLE, "op2_chat_format": chat.ORACLE, "op5_embedding_dedup": embedding.ORACLE, "op6_bm25_topk": search.ORACLE, "op7_warc": warc.ORACLE, "secret_counts": SECRET_COUNTS, "mix_targets": MIX_TARGETS}
