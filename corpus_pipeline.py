"""The corpus pipeline: quality classifier, near-dedup, secret scan, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.  run() writes each stage's result to the
shared folder and reads it again as the next one's docs, then deletes the one
before.

Every stage takes nulls in any column, empty and very long texts, repeated rows
and ids, and tables without rows, which give none.  Columns beside those of
documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyflux.llm import minhash, mixing, packing, quality, secrets
from keyflux.llm.common import forget, materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of this input's documents, accepts.

    Null and empty texts are judged as an empty text is, equal texts alike; a
    document without an id is judged as well.  Without labels all have one
    score: 0.5, which is accepted.
    """
    return quality.accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on five-word shingles: that with the smallest id.

    Rows that repeat a kept id stay; texts without words and rows without an id
    are linked with nothing and stay.
    """
    return minhash.deduplicated(docs.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark, n_chars counted anew where a text changed; null texts stay null."""
    return secrets.redact(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null source is a source of its own; texts without words are taken once;
    repeated rows count each, and share their copies evenly.
    """
    mixed = mixing.mix(docs.select(*COLUMNS)).filter("mix_copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "mix_copies"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequence and place; a text that is null or empty is one piece of one id."""
    return packing.pack(docs.select(*COLUMNS))


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("secrets", secret_scan), ("mix", mix_sources), ("pack", pack_sequences)]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(spark, *before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
