"""From page sightings to scored candidates and one winner per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sitecontacts.functions import text as tx, urls as ur
from sitecontacts.operators import evidence as ev
from sitecontacts.operators.ranking import rank_within

CANDIDATE_COLUMNS = [
    "email", "email_source", "email_type", "confidence_score", "discovery_method",
    "source_type", "obf_method", "confidence", "base_score", "domain_match", "occurrences",
    "first_page", "first_order",
]


def count_candidates(page_emails: DataFrame, keys: list[str], page_order: str = "page_id") -> DataFrame:
    """Occurrences, best evidence and first sighting per address, in one aggregation.

    Every row is one address on one page. On equal confidence the earliest page wins.
    """
    order = F.col(page_order).cast("bigint")
    return page_emails.groupBy(*keys, "email").agg(
        F.count("*").alias("occurrences"),
        F.max(
            F.struct(
                ev.channel_confidence(F.col("channel_ord")).alias("confidence"),
                (-order).alias("page"),
                F.col("url"),
                F.col("channel_ord"),
            )
        ).alias("best"),
        F.min(F.struct(order.alias("page"), F.col("first_order").alias("place"))).alias("first"),
    )


def merge_candidates(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Combine partial counts of the same address."""
    return parts.groupBy(*keys, "email").agg(
        F.sum("occurrences").cast("bigint").alias("occurrences"),
        F.max("best").alias("best"),
        F.min("first").alias("first"),
    )


def score_candidates(counted: DataFrame, domain: str = "domain") -> DataFrame:
    """Final and base score of counted candidates; other columns stay."""
    ordinal = F.col("best.channel_ord")
    kept = [c for c in counted.columns if c not in ("best", "first", "email", "occurrences")]
    described = counted.select(
        *kept,
        "email",
        F.col("occurrences").cast("bigint").alias("occurrences"),
        F.col("best.url").alias("email_source"),
        F.col("best.confidence").alias("confidence"),
        ev.channel_source(ordinal).alias("source_type"),
        ev.channel_obfuscation(ordinal).alias("obf_method"),
        ur.evidence_method(
            ev.channel_source(ordinal), ev.channel_obfuscation(ordinal), F.col("best.url")
        ).alias("discovery_method"),
        F.col("first.page").alias("first_page"),
        F.col("first.place").alias("first_order"),
    )
    return described.select(
        "*",
        tx.email_type(F.col("email")).alias("email_type"),
        tx.base_score(F.col("email")).alias("base_score"),
        tx.is_domain_match(F.col("email"), F.col(domain)).alias("domain_match"),
        tx.final_score(
            F.col("confidence"), F.col("discovery_method"), F.col("source_type"),
            F.col("email"), F.col(domain), F.col("occurrences"),
        ).alias("confidence_score"),
    )


def _preference() -> Column:
    """Larger is better: score, base score, own domain, role address, seen first."""
    return F.struct(
        F.col("confidence_score"),
        F.col("base_score"),
        F.col("domain_match"),
        (F.col("email_type") == "role").alias("is_role"),
        (-F.col("first_page")).alias("page"),
        (-F.col("first_order")).alias("place"),
    )


def best_per_site(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The winner of every site; an aggregation, so large sites combine before the shuffle."""
    return (
        scored.groupBy(*keys)
        .agg(F.max_by(F.struct(*CANDIDATE_COLUMNS), _preference()).alias("w"))
        .select(*keys, "w.*")
    )


def rank_candidates(scored: DataFrame, keys: list[str], top: int | None = None) -> DataFrame:
    """All candidates of every site with their `rank`, or the first `top` of them.

    With `top`, every task keeps its own best few rows of a site before the shuffle.
    """
    if top is not None:
        order = Window.partitionBy(*keys).orderBy(_preference().desc())
        ranked = scored.withColumn("rank", F.row_number().over(order).cast("bigint"))
        return ranked.where(F.col("rank") <= top)
    return rank_within(
        scored,
        keys,
        coarse={
            "score": -F.col("confidence_score"),
            "base": -F.col("base_score"),
            "match": ~F.col("domain_match"),
            "role": F.col("email_type") != "role",
            "page": F.shiftright(F.col("first_page"), 16),
        },
        fine=[F.col("first_page"), F.col("first_order")],
        name="rank",
    )
