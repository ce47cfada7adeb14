"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Java pattern of the characters that end a word; other space characters belong to words.
SPACE = r"[ \x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words of a text, in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def has_word(text: Column) -> Column:
    """True where a text holds anything but ASCII white space."""
    return text.rlike(r"[^ \x09-\x0D]")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of `df` has yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def settled(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """The columns `keep` and new ones, which come out of a generator of one row.

    A filter above a projection is pushed through it with its expressions put in place,
    also into lambdas, where they are computed once per element. No filter passes a generator.
    """
    made = F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return df.select(*[F.col(f"`{c}`") for c in keep], made)


def batches(frames: Iterator[pd.DataFrame], column: str, max_chars: int = 16_000_000) -> Iterator[pd.DataFrame]:
    """Cut Arrow batches so that the texts of one piece stay near `max_chars`.

    A single longer text makes a piece of its own, whole. Missing texts become "".
    """
    for frame in frames:
        frame = frame.assign(**{column: frame[column].fillna("")}).reset_index(drop=True)
        total = frame[column].str.len().cumsum()
        piece = (total // max_chars).to_numpy()
        for _, part in frame.groupby(piece, sort=True):
            yield part.reset_index(drop=True)
