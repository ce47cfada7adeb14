"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sitecontacts.plans.lineage import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge with the smallest node it can reach.

    Edges are undirected; loops, repeats and nulls do no harm, and no edges give no rows.
    Each round links nodes to the smallest neighbour of theirs, found by a partial
    aggregation, and is written to the shared folder; the join back to it has one row
    per node on one side, so that adaptive execution can split a hub. The number of
    rounds grows with the logarithm of the longest chain.
    """
    step = materialize(_ordered(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))))
    before = None
    while True:
        large = _star(step.unionByName(step.select(F.col("v").alias("u"), F.col("u").alias("v"))), larger=True)
        step = materialize(_star(large, larger=False))
        # a fixed point has the same edges; their number and sum of hashes tell, in one small row
        now = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return step.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        step.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    """Edges once each, from the larger to the smaller node."""
    return (
        pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Link the neighbours of every node, larger or smaller ones, to its smallest neighbour."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = pairs.join(least, "u")
    if larger:
        return _ordered(joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
    return _ordered(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))
