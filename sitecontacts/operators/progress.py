"""Resuming and progress over lead rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sitecontacts.plans.lineage import large


def remaining(leads: DataFrame, progress: DataFrame) -> DataFrame:
    """Leads that no progress row names."""
    return leads.join(large(progress.select("row_index")), "row_index", "left_anti")


def progress_mark(leads: DataFrame, progress: DataFrame) -> DataFrame:
    """Largest i such that rows 0..i are all done, as one row; -1 when row 0 is not."""
    done = progress.select("row_index").distinct().withColumn("_done", F.lit(True))
    return (
        leads.select("row_index").join(large(done), "row_index", "left")
        .agg(
            F.min(F.when(F.col("_done").isNull(), F.col("row_index"))).alias("_open"),
            F.max("row_index").alias("_last"),
        )
        .select(
            F.coalesce(F.col("_open") - 1, F.col("_last"), F.lit(-1)).cast("bigint").alias("mark")
        )
    )
