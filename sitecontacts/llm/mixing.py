"""Mixing sources to target weights by budgets that flow down a tree."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from sitecontacts.llm.common import SPACE, free_names
from sitecontacts.plans.lineage import materialize

#: Weights of the default mixture per level, in the order domain, language, source. What is not named weighs 10.
WEIGHTS: Mapping[str, Mapping[str, int]] = {
    "domain": {"d0": 40, "d1": 20, "d2": 20, "d3": 10},
    "lang": {"en": 50, "de": 20, "fr": 20, "es": 10},
    "source": {"src0": 30},
}
_LEVELS = ("domain", "lang", "source")
_OTHER = 10
#: Hexadecimal digits of the order that make a bucket: 4096 per leaf and epoch.
_DIGITS = 3


def domain_of(source: Column) -> Column:
    """Default domains: the number at the end of a source's name modulo 4; others are domain `d3`."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", "d3").otherwise(F.concat(F.lit("d"), (number.cast("bigint") % 4).cast("string")))


def _shared(nodes: DataFrame, parent: list[str], name: str, weights: Mapping[str, int]) -> DataFrame:
    """Split every parent's `budget` among its children by weight, up to their `capacity`.

    A child whose capacity is below its share is full; what it can't use goes to its
    siblings by weight. In order of capacity per weight, the full children come first, so
    a running sum tells how far they go. All arithmetic is in whole tokens; a remainder
    of less than a token per child is left out.
    """
    weight = F.coalesce(*[F.when(F.col(name) == k, F.lit(w)) for k, w in weights.items()], F.lit(_OTHER)).cast("bigint")
    group = Window.partitionBy(*parent)
    order = group.orderBy(F.col("capacity") / F.col("w"), name)
    df = nodes.withColumn("w", weight)
    df = df.withColumns({
        "before": F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "open": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("capacity", "open", "w")}
    rest = (F.col("budget") - F.col("before")).cast("decimal(19,0)")
    df = df.withColumn("full", exact["capacity"] * exact["open"] <= rest * exact["w"])
    # fullness is monotone in this order: the first child that isn't full fixes the shares of the rest
    first = F.min(F.when(~F.col("full"), F.struct(F.col("capacity") / F.col("w"), name, "before", "open"))).over(group)
    share = F.expr("cast(cast(budget - f.before as decimal(19,0)) * cast(w as decimal(19,0)) div f.open as bigint)")
    return (
        df.withColumn("f", first).withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(share))
        .drop("w", "before", "open", "full", "f")
    )


def mix(
    docs: DataFrame, percent: int = 50, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, epochs: int = 1,
    seed: int = 17, tokens: Column | None = None, domain: Column | None = None,
) -> DataFrame:
    """Documents chosen for the mixture, with all their columns, domain, tokens and epoch (from 0).

    `percent` is the share of all tokens to choose. The budget flows from the root through
    domains, languages and sources: each node shares it among its children by weight, none
    above `epochs` times its tokens. A shortage so goes to siblings first, and a parent only
    gets a budget that its children together can use, so what they lack goes to the parent's
    siblings. A leaf takes its documents in an order seeded anew per epoch, as long as their
    running total stays within its budget: whole epochs first, then a prefix of the next.

    A null text has no tokens, but its place in the order; null languages and sources count as
    empty names. Repeated rows count as often as they occur and, like all rows that tie in the
    order, are taken together or not at all. An empty table gives no rows. Names that are
    taken get a leading underscore.

    A leaf's order is cut into 4096 buckets of a hash. Only bucket sums are added up per leaf;
    rows are ordered only in the one bucket per leaf where its budget ends. What comes back to
    the documents is one bound per leaf and epoch, so that their texts need no shuffle.
    """
    tokens = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(f"[^{SPACE[1:]}+")).cast("bigint") if tokens is None else tokens
    domain = domain_of(F.col("source")) if domain is None else domain
    n, dom, key, ep, last, last_e, *last_levels = free_names(
        docs, "n_tokens", "domain", "order_key", "epoch", "last", "last_e", *[f"last_{v}" for v in _LEVELS]
    )
    last_of = dict(zip(_LEVELS, last_levels, strict=True))
    names = {dom: "domain", "lang": "lang", "source": "source"}
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ep).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = docs.withColumn(dom, domain).withColumn(ep, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn(key, order)
    node = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(v) for c, v in names.items()]
    # the text itself is neither shuffled nor written
    slim = materialize(rows.select(*node, F.col(ep).alias("e"), F.col(key).alias("k"), tokens.alias("n")))
    slim = slim.withColumn("b", F.conv(F.substring("k", 1, _DIGITS), 16, 10).cast("int"))
    cells = materialize(slim.groupBy(*_LEVELS, "e", "b").agg(F.sum("n").alias("t")))
    nodes = cells.groupBy(*_LEVELS).agg(F.sum("t").alias("capacity"))
    level = nodes.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    everything = F.sum("capacity").over(Window.partitionBy()).cast("decimal(19,0)")
    level = level.withColumn("budget", everything).withColumn("budget", F.expr(f"cast(budget * {percent} div {100 * epochs} as bigint)"))
    level = _shared(level, [], "domain", weights["domain"]).drop("capacity")
    level = nodes.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).join(level, "domain")
    level = _shared(level, ["domain"], "lang", weights["lang"]).drop("capacity")
    level = _shared(nodes.join(level, ["domain", "lang"]), ["domain", "lang"], "source", weights["source"])
    run = Window.partitionBy(*_LEVELS).orderBy("e", "b").rowsBetween(Window.unboundedPreceding, -1)
    within = cells.withColumn("before", F.coalesce(F.sum("t").over(run), F.lit(0))).join(level, list(_LEVELS)).filter("before <= budget")
    over = F.col("before") + F.col("t") > F.col("budget")
    # at most one bucket of a leaf is cut: later ones start beyond the budget
    limits = materialize(within.groupBy(*_LEVELS, "e").agg(
        F.min(F.when(over, F.col("b"))).alias("b"), F.min(F.when(over, F.col("budget") - F.col("before"))).alias("room")
    ))
    alike = Window.partitionBy(*_LEVELS, "e", "b").orderBy("k")  # rows that tie share a running total
    ends = (
        slim.join(limits.filter("b is not null"), [*_LEVELS, "e", "b"]).withColumn("sum", F.sum("n").over(alike))
        .filter("sum <= room").groupBy(*_LEVELS, "e").agg(F.max("k").alias("k"))
    )
    bound = F.when(F.col("b").isNull(), "g").otherwise(F.coalesce("k", F.lpad(F.lower(F.hex("b")), _DIGITS, "0")))
    # written, so that Spark knows its size and sends it to the documents where it is small
    bounds = materialize(limits.join(ends, [*_LEVELS, "e"], "left").select(
        *[F.col(v).alias(last_of[v]) for v in _LEVELS], F.col("e").alias(last_e), bound.alias(last)
    ))
    test = (F.col(ep) == F.col(last_e)) & (F.col(key) <= F.col(last))
    for c, v in names.items():
        test &= F.coalesce(F.col(c).cast("string"), F.lit("")) == F.col(last_of[v])
    return rows.join(bounds, test).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(dom), tokens.alias(n), F.col(ep))


def mixing(docs: DataFrame) -> DataFrame:
    """Digest of the default mixture: half of all words, each document at most once."""
    return mix(docs).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")
