"""Robots rules as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitecontacts.functions import urls as ur
from sitecontacts.functions.columns import browser_trim
from sitecontacts.options import Options
from sitecontacts.plans.lineage import large, merged

_AGENT_LINE = r"\n[^\S\n]*(?i:user-agent)[^\S\n]*:"


def robots_rules(robots: DataFrame, options: Options = Options()) -> DataFrame:
    """robots(origin, body) to (origin, kind, value, block_no, line_no).

    Disallow values are kept where the nearest agent line above names everyone or
    our agent; sitemap lines always are. A body is cut at its agent lines, so the
    whole reading stays inside one row and needs no shuffle.
    """
    text = F.concat(F.lit("\n"), F.regexp_replace("body", r"\r\n", "\n"))
    blocks = robots.select("origin", F.posexplode(F.split(text, _AGENT_LINE)).alias("block_no", "block"))
    agent = F.lower(browser_trim(F.substring_index("block", "\n", 1)))
    lines = blocks.withColumn(
        "_applies", (F.col("block_no") == 0) | agent.isin("*", options.robots_agent.lower())
    ).select(
        "origin", "block_no", "_applies",
        F.posexplode(F.split("block", "\n")).alias("line_no", "line"),
    )
    line = browser_trim(F.col("line"))
    key = F.lower(browser_trim(F.substring_index(F.col("_line"), ":", 1)))
    value = browser_trim(F.regexp_extract(F.col("_line"), r"(?s)\A[^:]*:(.*)\z", 1))
    read = (
        lines.where((F.col("block_no") == 0) | (F.col("line_no") > 0))
        .withColumn("_line", line)
        .where("_line not like '#%' and _line like '%:%'")
        .select("origin", "block_no", "line_no", "_applies", key.alias("kind"), value.alias("value"))
    )
    resolved = F.when(
        F.col("kind") == "sitemap",
        F.when(ur.is_http_url(F.col("value")), F.col("value")).otherwise(
            ur.resolve_url(
                F.col("value"),
                ur.base_parts(F.concat(F.col("origin"), F.lit("/robots.txt"))),
            )
        ),
    ).otherwise(F.col("value"))
    wanted = (F.col("kind") == "sitemap") | (
        (F.col("kind") == "disallow") & F.col("_applies") & (F.col("value") != "")
    )
    return (
        read.where(wanted)
        .select("origin", "kind", resolved.alias("value"), "block_no", "line_no")
        .where("value is not null")
    )


def _canonical(c: Column) -> Column:
    return F.coalesce(ur.canonical_url(c), c)


def denials(rules: DataFrame) -> DataFrame:
    """(origin, prefix) of the Disallow rules, once each."""
    origin = F.coalesce(ur.url_origin(_canonical(F.col("origin"))), F.col("origin"))
    return rules.where("kind = 'disallow'").select(origin.alias("_o"), F.col("value").alias("_prefix")).distinct()


def allowed_urls(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose URL, in canonical form, no Disallow rule of its origin covers."""
    return not_denied(urls, denials(rules), url)


def _placed(urls: DataFrame, url: str) -> DataFrame:
    """Add origin `_o` and `_path`, with the query, of the canonical URL."""
    # an origin that is never null spares the test for it, which would read the URL once more
    place = urls.withColumn("_path", _canonical(F.col(url))).withColumn("_o", F.coalesce(ur.url_origin(F.col("_path")), F.lit("")))
    return place.withColumn("_path", F.regexp_extract(F.col("_path"), r"\A[a-z]+://[^/?#]*([^#]*)", 1))


def not_denied(urls: DataFrame, denied: DataFrame, url: str = "url", repeated: bool = True) -> DataFrame:
    """Rows whose URL none of the `denials` covers; `repeated` tells that a URL may stand in many rows.

    A URL is cut to the prefix lengths that its origin's rules have, and each cut meets the
    rules by equality of origin and prefix; any number of rules on one origin so costs a
    look-up per length. URLs are read apart, and the rows, whatever they carry, meet the
    denied ones as they are written, in one anti join. A stream has one anti join per
    length instead, as its rows can't be put together again.
    """
    read = urls.select(url).distinct() if repeated and not urls.isStreaming else urls.select(url)
    if urls.isStreaming:
        place = _placed(urls, url)
        lengths = [r.n for r in denied.select(F.length("_prefix").alias("n")).distinct().collect()]
        for n in sorted(lengths):
            place = place.withColumn("_prefix", F.left(F.col("_path"), F.lit(n))).join(
                large(denied.where(F.length("_prefix") == n)), ["_o", "_prefix"], "left_anti"
            ).drop("_prefix")
        return place.drop("_o", "_path")
    lengths = denied.groupBy("_o").agg(F.collect_set(F.length("_prefix")).alias("_lengths"))
    fitting = F.filter("_lengths", lambda n: n <= F.length("_path"))
    cuts = merged(_placed(read, url), lengths, ["_o"]).select(
        url, "_o", F.explode(F.transform(fitting, lambda n: F.left(F.col("_path"), n))).alias("_prefix")
    )
    hit = merged(cuts, denied, ["_o", "_prefix"], "left_semi").select(url).distinct()
    return merged(urls, hit, [url], "left_anti")
