"""Lead files: any columns, all text, one of them naming a website."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sitecontacts import options as opt
from sitecontacts.functions import urls as ur
from sitecontacts.functions.columns import browser_trim


def read_leads(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Read lead CSV files with their own header; adds `row_index`, the 0-based row position.

    Files follow each other by name, whatever their sizes. Quoted line breaks need `multi_line`,
    which keeps a file in one task; turn it off for large files without them.
    """
    rows = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )
    values = [F.coalesce(F.col(quoted(c)), F.lit("")).alias(c) for c in rows.columns]
    place = _unused(rows.columns, "_place")
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return index_rows(rows.select(*values, block.alias(place)), place)


def _unused(columns: list[str], name: str) -> str:
    while name in columns:
        name = f"_{name}"
    return name


def index_rows(rows: DataFrame, place: str | None = None) -> DataFrame:
    """Add `row_index` in reading order: position in a stretch of rows plus rows before it.

    A stretch is a partition or, with `place`, the rows of one place: a task reads several files
    in an order of its own, so a file's block is what keeps its order. Places are sorted. The
    offsets have one row per stretch, so broadcasting them is bounded by the number of file
    blocks and tasks, not by the data.
    """
    kept = [c for c in rows.columns if c != place]
    row, stretch, first, before = (_unused(rows.columns, c) for c in ("_row", "_stretch", "_first", "_before"))
    placed = rows.withColumn(row, F.monotonically_increasing_id())
    placed = placed.withColumn(stretch, F.shiftright(F.col(row), 33) if place is None else F.col(place))
    sizes = placed.groupBy(stretch).agg(F.count("*").alias("n"), F.min(row).alias(first))
    earlier = Window.orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(stretch, first, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    return (
        placed.join(F.broadcast(offsets), stretch)
        .select((F.col(row) - F.col(first) + F.col(before)).alias("row_index"), *[F.col(quoted(c)) for c in kept])
    )


def quoted(name: str) -> str:
    """A lead column's name for use in an expression; headers may hold dots, spaces and backticks."""
    return "`" + name.replace("`", "``") + "`"


def _first_filled(df: DataFrame, columns: list[str]) -> Column:
    filled = [
        F.when(browser_trim(F.col(quoted(c))) != "", browser_trim(F.col(quoted(c)))) for c in columns
    ]
    return F.coalesce(*filled) if filled else F.lit(None).cast("string")


def lead_website(leads: DataFrame) -> Column:
    """First non-blank value among the columns whose name speaks of a website."""
    candidates = [
        c for c in leads.columns
        if c != "row_index" and any(w in c.lower().strip() for w in opt.WEBSITE_COLUMN_WORDS)
    ]
    return _first_filled(leads, candidates)


def to_targets(leads: DataFrame) -> DataFrame:
    """Leads with a website, plus a `target` struct.

    target: name, website and domain as given, start_url, site_domain (the bare
    domain) and site_key (domain and start URL, one per crawl).
    """
    def given(columns: list[str]) -> Column:
        named = [F.when(F.col(c) != "", F.col(c)) for c in columns if c in leads.columns]
        return F.coalesce(*named) if named else F.lit(None).cast("string")

    website = F.col("_website")
    domain = F.coalesce(given(["Domain", "domain"]), ur.normalize_domain(website))
    staged = (
        leads.withColumn("_website", lead_website(leads))
        .where("_website is not null")
        .withColumn("_domain", domain)
        .withColumn("_start", ur.normalize_url(website))
        .withColumn("_site", ur.normalize_domain(F.col("_domain")))
    )
    target = F.struct(
        F.coalesce(given(["Name", "name"]), F.lit("Unknown Company")).alias("name"),
        website.alias("website"),
        F.col("_domain").alias("domain"),
        F.col("_start").alias("start_url"),
        F.col("_site").alias("site_domain"),
        F.concat_ws(" ", "_site", "_start").alias("site_key"),
    )
    return staged.withColumn("target", target).drop("_website", "_domain", "_start", "_site")


def rejected_leads(leads: DataFrame) -> DataFrame:
    """Leads without a website; they get no output row."""
    return leads.where(lead_website(leads).isNull())


def sites_of(targets: DataFrame) -> DataFrame:
    """Distinct crawls of the targets: site_key, domain, start_url."""
    return targets.select(
        "target.site_key", F.col("target.site_domain").alias("domain"), "target.start_url"
    ).distinct()
