"""From raw documents to packed token windows, one written table per stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitecontacts.llm.common import free_names, read
from sitecontacts.llm.dart_minhash import near_documents
from sitecontacts.llm.line_dedup import dedup_lines, with_words_left
from sitecontacts.llm.mixing import mix
from sitecontacts.llm.packing import pack
from sitecontacts.llm.quality_rules import POLICIES, ledger, passes
from sitecontacts.plans.lineage import checkpoint_dir


def _as_documents(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    if "n_chars" in columns:
        df = df.withColumn("n_chars", F.length("text").cast("bigint"))
    return df.select(*[F.col(f"`{c}`") for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the newest policy of the quality rules.

    Null and empty texts fail them. Rows are judged alone, so repeated rows share their fate.
    Like every stage, this one keeps all columns, whatever their names, and gives no rows for none.
    """
    df, bits, _ = ledger(docs)
    return df.filter(passes(F.col(bits), POLICIES["v2"])).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates; those left without a word by that go.

    Null and empty texts have no line and stay; repeated rows lose the same lines.
    """
    df, _, dropped = dedup_lines(docs)
    return _as_documents(with_words_left(df, dropped), docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Rows without an id, and all rows of an id that stays, are kept; so are texts without a word.
    """
    (chosen,) = free_names(docs, "chosen")
    kept = near_documents(docs).filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias(chosen)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(chosen)), "left_semi")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The default mixture over 80 % of all words, each document at most once.

    A null text has no words but its place in the order; null languages and sources count as
    empty names; rows that tie in the order are taken together or not at all.
    """
    return mix(docs, percent=80).select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the chosen documents in windows of 4096 tokens; null and empty texts have the end id only."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Tokens, similarity by hashed darts and windows have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
