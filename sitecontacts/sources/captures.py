"""Captured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitecontacts.functions import urls as ur


def status_class(status: Column) -> Column:
    """usable, rate-limited, server-error or no-response."""
    return (
        F.when(status.isNull(), "no-response")
        .when(status == 429, "rate-limited")
        .when(status >= 500, "server-error")
        .otherwise("usable")
    )


def classify_pages(pages: DataFrame) -> DataFrame:
    if "status" not in pages.columns:
        return pages.withColumn("status_class", F.lit("usable"))
    return pages.withColumn("status_class", status_class(F.col("status")))


def usable_pages(pages: DataFrame) -> DataFrame:
    """Pages that were answered; a 404 page counts. All pages when there is no status."""
    if "status" not in pages.columns:
        return pages
    return pages.where(status_class(F.col("status")) == "usable")


def latest_unexpired(
    df: DataFrame, key: str, captured_at: str, ttl_seconds: int | None, as_of: Column
) -> DataFrame:
    """The newest live row of every key; a null TTL never expires.

    An aggregation rather than a window, so a key with very many versions combines
    before the shuffle. Rows of one key and one instant are ordered by their values.
    """
    live = df
    if ttl_seconds is not None:
        live = df.where(
            F.col(captured_at) + F.make_interval(secs=F.lit(ttl_seconds)) >= as_of
        )
    others = [c for c in df.columns if c not in (key, captured_at)]
    newest = live.groupBy(key).agg(F.max(F.struct(captured_at, *others)).alias("_v"))
    return newest.select(key, "_v.*").select(*df.columns)


def newest_pages(pages: DataFrame) -> DataFrame:
    """(url, page_id) of the newest capture of every canonical URL, by captured_at where there is one, then page_id."""
    age = [c for c in ("captured_at", "page_id") if c in pages.columns]
    by_url = pages.groupBy(capture_key(F.col("url")).alias("url"))
    if age == ["page_id"]:
        return by_url.agg(F.max("page_id").alias("page_id"))
    return by_url.agg(F.max(F.struct(*age)).alias("_v")).select("url", "_v.page_id")


def capture_key(url: Column) -> Column:
    """What links are matched on: the canonical URL without its fragment."""
    return F.coalesce(ur.drop_fragment(ur.canonical_url(url)), url)
