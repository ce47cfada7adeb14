"""Sitemap files as tables of URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sitecontacts.functions import text as tx
from sitecontacts.functions.columns import browser_trim, let
from sitecontacts.options import Options
from sitecontacts.plans.lineage import large, materialize


def _inside(element: str) -> str:
    """Pattern of an element up to its first end tag, its text as the group; runs are taken as a whole."""
    return rf"<{element}(?=[\s>])[^>]*+>([^<]*+(?:<(?!/{element}\s*>)[^<]*+)*+)</{element}\s*>"


def _trimmed(c: Column) -> Column:
    """The text without blanks around it; what stands between visible ASCII characters has none."""
    return let(F.trim(c), lambda t: F.when(t.rlike(r"(?s)\A[!-~](?:.*[!-~])?\z"), t).otherwise(browser_trim(t)))


def _locations(xml: Column, element: str, limit: int | None = None) -> Column:
    blocks = F.regexp_extract_all(xml, F.lit(_inside(element)), F.lit(1))
    if limit is not None:
        blocks = F.slice(blocks, 1, limit)

    def plain(loc: Column) -> Column:
        return F.when(
            F.contains(loc, F.lit("<![CDATA[")), F.regexp_replace(loc, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
        ).otherwise(loc)

    found = F.transform(
        blocks,
        lambda b: _trimmed(tx.decode_references(let(F.regexp_extract(b, _inside("loc"), 1), plain))),
    )
    return F.filter(found, lambda u: u != "")


def parse_sitemaps(sitemaps: DataFrame, options: Options = Options()) -> DataFrame:
    """sitemaps(sitemap_url, xml) to (sitemap_url, is_index, entries); comments hold no entries."""
    bare = F.when(
        F.contains("xml", F.lit("<!--")), F.regexp_replace("xml", r"(?s)(<!\[CDATA\[.*?\]\]>)|<!--.*?(?:-->|\z)", "$1")
    ).otherwise(F.col("xml"))
    # each step reads the earlier one once computed
    files = sitemaps.select("sitemap_url", bare.alias("_xml"))
    files = files.select("*", F.col("_xml").rlike(r"<sitemap[\s>]").alias("is_index"))
    xml, is_index = F.col("_xml"), F.col("is_index")
    urls = _locations(xml, "url")
    if options.max_urls_per_sitemap is not None:
        urls = F.slice(urls, 1, options.max_urls_per_sitemap)
    return files.select(
        "sitemap_url",
        "is_index",
        F.when(is_index, _locations(xml, "sitemap", options.max_children_per_index)).otherwise(urls).alias("entries"),
    )


def sitemap_roots(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """Sitemaps to read per site, in order: those of its robots file, else two usual names.

    sites(site_key, origin) to (site_key, sitemap_url, sitemap_no).
    """
    named = sites.join(
        large(rules.where("kind = 'sitemap'").select("origin", "value", "block_no", "line_no")), "origin", "left"
    )
    order = Window.partitionBy("site_key").orderBy("block_no", "line_no")
    usual = F.when(
        F.col("value").isNull(),
        F.array(
            F.concat(F.col("origin"), F.lit("/sitemap.xml")),
            F.concat(F.col("origin"), F.lit("/sitemap_index.xml")),
        ),
    ).otherwise(F.array("value"))
    return (
        named.withColumn("_no", F.row_number().over(order))
        .select("site_key", "_no", F.posexplode(usual).alias("_i", "sitemap_url"))
        .select("site_key", "sitemap_url", (F.col("_no") + F.col("_i")).alias("sitemap_no"))
    )


def sitemap_files(roots: DataFrame, parsed: DataFrame, options: Options = Options()) -> DataFrame:
    """Every file that a root sitemap leads to, once per root: (root, file, path).

    roots(sitemap_url). Breadth first: a file's place is its shortest path of entry numbers, of
    several the first, and a file that has one is not entered again. So files that list each
    other, or share children, cost one row per root and link, and a level is found by equi joins.
    """
    indexes = materialize(parsed.where("is_index").select(
        F.col("sitemap_url").alias("file"), F.posexplode("entries").alias("i", "next")
    ))
    level = materialize(roots.select(
        F.col("sitemap_url").alias("root"), F.col("sitemap_url").alias("file"), F.array().cast("array<int>").alias("path")
    ).distinct())
    placed, depth = level, 0
    while options.max_sitemap_depth is None or depth < options.max_sitemap_depth:
        found = level.join(large(indexes), "file").groupBy("root", F.col("next").alias("file")).agg(
            F.min(F.concat("path", F.array("i"))).alias("path")
        )
        level = materialize(found.join(large(placed.select("root", "file")), ["root", "file"], "left_anti"))
        if level.isEmpty():
            break
        placed = placed.unionByName(level)
        depth += 1
    return placed


def expand_sitemaps(roots: DataFrame, parsed: DataFrame, options: Options = Options()) -> DataFrame:
    """URLs of every root sitemap, indexes followed: (site_key, sitemap_no, url_no, url).

    Files are placed and numbered per distinct root, and meet the sites that name it last, so sites
    that share a root share its work. A file's URLs follow those of the files before it: only
    the files' sizes are summed, no task sorts URLs. Limits that are set cut as they say.
    """
    plain = parsed.where("not is_index").select(
        F.col("sitemap_url").alias("file"), "entries", F.size("entries").alias("n")
    )
    files = materialize(sitemap_files(roots.select("sitemap_url"), parsed, options).join(large(plain.select("file", "n")), "file"))
    earlier = Window.partitionBy("root").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    files = materialize(files.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    most = options.max_urls_per_sitemap
    named = roots.withColumnRenamed("sitemap_url", "root")
    if options.sitemap_url_stop is not None:
        # a root is read while the roots before it have given fewer URLs than this
        given = files.groupBy("root").agg(F.sum("n").alias("n"))
        given = given if most is None else given.withColumn("n", F.least("n", F.lit(most)))
        so_far = Window.partitionBy("site_key").orderBy("sitemap_no").rowsBetween(Window.unboundedPreceding, -1)
        named = named.join(large(given), "root").withColumn("_given", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
        named = named.where(F.col("_given") < options.sitemap_url_stop)
    if most is not None:
        files = files.where(F.col("before") < most)
    placed = named.select("site_key", "sitemap_no", "root").join(large(files.select("root", "file", "before")), "root")
    urls = placed.join(large(plain.select("file", "entries")), "file").select(
        "site_key", "sitemap_no", "before", F.posexplode("entries").alias("pos", "url")
    )
    urls = urls.withColumn("url_no", (F.col("before") + F.col("pos") + 1).cast("int"))
    return (urls if most is None else urls.where(F.col("url_no") <= most)).select("site_key", "sitemap_no", "url_no", "url")
