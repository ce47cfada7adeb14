"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from sitecontacts.llm.common import read
from sitecontacts.llm.dart_minhash import minhash_dedup
from sitecontacts.llm.embedding_dedup import embedding_dedup
from sitecontacts.llm.license_scan import license_scan
from sitecontacts.llm.line_dedup import line_dedup
from sitecontacts.llm.merkle import merkle_manifest
from sitecontacts.llm.mixing import mixing
from sitecontacts.llm.packing import packing
from sitecontacts.llm.periodic_runs import periodic_runs
from sitecontacts.llm.quality_crf import quality_crf
from sitecontacts.llm.quality_rules import quality_rules
from sitecontacts.llm.secret_scan import secret_scan
from sitecontacts.llm.suffix_dedup import suffix_dedup
from sitecontacts.llm.token_counts import token_counts


def _over(operator: Callable[[DataFrame], DataFrame], table: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(read(spark, sf_dir, table))


def _crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": _over(secret_scan, "documents"),
    "op2_line_dedup": _over(line_dedup, "documents"),
    "op3_token_counts": _over(token_counts, "documents"),
    "op4_embedding_dedup": _over(embedding_dedup, "embeddings"),
    "op5_packing": _over(packing, "documents"),
    "op6_mixing": _over(mixing, "documents"),
    "op7_license_scan": _over(license_scan, "documents"),
    "op8_quality_rules": _over(quality_rules, "documents"),
    "op9_quality_crf": _crf,
    "op10_minhash_dedup": _over(minhash_dedup, "documents"),
    "op11_periodic_runs": _over(periodic_runs, "documents"),
    "op12_suffix_dedup": _over(suffix_dedup, "documents"),
    "op13_merkle_manifest": _over(merkle_manifest, "documents"),
    "pipeline": corpus_pipeline.run,
}
