"""Small column helpers shared by the text and URL functions."""

from __future__ import annotations

import functools
import re

from pyspark import SparkContext
from pyspark.sql import Column, functions as F

# Browser notion of whitespace; Java's \s covers ASCII only.
WS = r"\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def reuse(build):
    """Keep the columns a function of plain arguments builds, per Spark context.

    Building a large expression takes many calls into the JVM; columns never change.
    """
    kept: dict = {}

    @functools.wraps(build)
    def wrapped(*args):
        context = SparkContext._active_spark_context
        key = (id(context), context.applicationId, args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return wrapped


def let(value: Column, body) -> Column:
    """Bind `value` once and use it several times in `body` without repeating its work."""
    return F.transform(F.array(value), body)[0]


def browser_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{WS}]+|[{WS}]+\z", "")


def any_of(words) -> str:
    """Regex alternation over literal words."""
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def replace_each(c: Column, pattern: str, fn) -> Column:
    """Replace every match of `pattern` by `fn(match)`; one linear pass over the text."""
    pieces = F.arrays_zip(
        F.split(c, pattern, -1).alias("kept"),
        F.regexp_extract_all(c, F.lit(pattern), F.lit(0)).alias("found"),
    )
    joined = F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(p["found"].isNull(), p["kept"]).otherwise(
                F.concat(p["kept"], fn(p["found"]))
            ),
        ),
        "",
    )
    return joined
