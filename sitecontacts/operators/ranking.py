"""Ranking inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sitecontacts.plans.lineage import key_hash, large, materialize


def rank_within(
    df: DataFrame, keys: list[str], coarse: dict[str, Column], fine: list[Column], name: str,
    after: DataFrame | None = None,
) -> DataFrame:
    """Number the rows of every group by `coarse`, then `fine`, both ascending.

    A group is cut into buckets of equal coarse values. Only bucket sizes are summed
    per group; rows are sorted per bucket, so a group that holds much of the table
    is spread over many tasks. Coarse values must not be null. With `after`, a row per group,
    numbers begin after its `_after`; groups it does not hold leave no row.
    """
    marked = materialize(df.withColumns({f"_c_{c}": v for c, v in coarse.items()})).withColumn("_k", key_hash(*keys))
    keys = ["_k", *keys]
    buckets = [*keys, *[f"_c_{c}" for c in coarse]]
    sizes = marked.groupBy(*buckets).agg(F.count("*").alias("_n"))
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(*[f"_c_{c}" for c in coarse])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    if after is not None:
        begun = after.withColumn("_k", key_hash(*keys[1:]))
        offsets = offsets.join(large(begun), keys).withColumn("_before", F.col("_before") + F.col("_after")).drop("_after")
    inside = F.row_number().over(Window.partitionBy(*buckets).orderBy(*fine))
    return (
        marked.join(large(offsets), buckets)
        .withColumn(name, (F.col("_before") + inside).cast("bigint"))
        .drop("_k", "_before", *[f"_c_{c}" for c in coarse])
    )
