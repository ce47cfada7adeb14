"""Cutting lineage through written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder of the session; a folder of our own only on a local master."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    made = "file:" + tempfile.mkdtemp(prefix="sitecontacts-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write a result once to the shared folder and read it back.

    Unlike cached blocks, the table outlives lost executors, and everything built
    on it starts from columnar files.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the input and so is sorted and merged, never broadcast.

    Spark guesses sizes from files: compressed ones, and tables whose few narrow columns become many
    wide rows, look far smaller than they are, and a broadcast passes whole through the driver.
    """
    return df.hint("merge")


def key_hash(*keys: str) -> Column:
    """Hash of text keys, to stand before them in a sort.

    A sort compares eight bytes of its first column before whole rows, and those are alike in
    most URLs. The keys themselves still decide.
    """
    return F.xxhash64(*[F.col(k).cast("string") for k in keys])


def merged(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join of two tables that grow with the input, sorted by the hash of their text keys first."""
    sides = [side.withColumn("_key_hash", key_hash(*keys)) for side in (left, right)]
    return sides[0].join(large(sides[1]), ["_key_hash", *keys], how).drop("_key_hash")
