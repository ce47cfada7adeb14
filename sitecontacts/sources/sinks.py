"""Outputs: the enriched lead file and the event log of discovered emails."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sitecontacts import options as opt
from sitecontacts.sources.leads import quoted


def output_columns(lead_columns: list[str]) -> list[str]:
    """Lead columns with the result columns right after the website column, else at the end."""
    kept = [c for c in lead_columns if c not in opt.RESULT_COLUMNS and c != "row_index"]
    at = next(
        (i for i, c in enumerate(kept) if c.lower().strip() in opt.WEBSITE_COLUMN_NAMES), len(kept) - 1
    )
    return [*kept[: at + 1], *opt.RESULT_COLUMNS, *kept[at + 1 :]]


def place_results(enriched: DataFrame, lead_columns: list[str]) -> DataFrame:
    """Enriched rows as text columns in output order, blank where there is no value."""
    return enriched.select(
        *[F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")).alias(c) for c in output_columns(lead_columns)]
    )


def write_enriched(enriched: DataFrame, lead_columns: list[str], path: str, mode: str = "append") -> None:
    """Write enriched rows as CSV part files with a header."""
    (
        place_results(enriched, lead_columns)
        .write.mode(mode)
        .option("header", True).option("escape", '"').option("emptyValue", "")
        .csv(path)
    )


def discovery_events(first_seen: DataFrame, at=None) -> DataFrame:
    """One event per address and site: first_seen(domain, email, url, channel_ord) in event form."""
    from sitecontacts.functions import urls as ur
    from sitecontacts.operators import evidence as ev

    ordinal = F.col("channel_ord")
    return first_seen.select(
        (F.current_timestamp() if at is None else at).alias("timestamp"),
        "domain",
        "email",
        F.col("url").alias("emailSource"),
        ev.channel_confidence(ordinal).alias("confidenceScore"),
        ur.evidence_method(
            ev.channel_source(ordinal), ev.channel_obfuscation(ordinal), F.col("url")
        ).alias("discoveryMethod"),
    )


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Write events as JSON lines."""
    events.write.mode(mode).json(path)
