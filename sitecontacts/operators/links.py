"""Links of captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sitecontacts.functions import urls as ur
from sitecontacts.functions.columns import reuse
from sitecontacts.operators.evidence import attribute_values, markup_of


def with_links(pages: DataFrame) -> DataFrame:
    """Add `links`, the visitable link targets of a page in page order: array<struct<url, pos>>."""
    base_and_hrefs, links = _link_stages()
    return pages.withColumns(base_and_hrefs).withColumns(links).drop(*base_and_hrefs)


@reuse
def _link_stages() -> tuple[dict, dict]:
    html, base = F.col("html"), F.col("_base")
    first = {
        "_base": ur.base_parts(ur.canonical_url(F.col("url"))),
        "_hrefs": F.when(html.rlike(r"<[aA]\s"), attribute_values(markup_of(html), "a", "href")),
    }
    resolved = F.transform(
        F.col("_hrefs"),
        lambda h, i: F.struct(ur.resolve_url(h, base).alias("url"), i.alias("pos")),
    )
    links = F.filter(resolved, lambda l: l["url"].isNotNull() & ~ur.is_avoided(l["url"]))
    return first, {"links": links}


def explode_links(pages_with_links: DataFrame) -> DataFrame:
    """(page_id, src_url, url, priority, pos), one row per link."""
    # the outer form keeps the optimiser from repeating the extraction in an inferred filter
    rows = pages_with_links.select(
        "page_id", F.col("url").alias("src_url"), F.explode_outer("links").alias("l")
    ).where("l.url is not null")
    return rows.select(
        "page_id", "src_url", "l.url", ur.link_priority(F.col("l.url")).alias("priority"), "l.pos"
    )


def extract_links(pages: DataFrame) -> DataFrame:
    """Visitable links of captured pages, with repeats.

    Which of them are inside a site is decided where the site is known.
    """
    return explode_links(with_links(pages))


def link_lists(pages_with_links: DataFrame) -> DataFrame:
    """(src_url, links): the links of each page as `rank_page_links` ranks them, in one row: array<struct<link_rank, url>>.

    Pages are known by their URL. A page's links never leave its row, so there is no shuffle of link rows.
    """
    pages = pages_with_links.where(F.size("links") > 0).groupBy(F.col("url").alias("src_url")).agg(
        F.flatten(F.collect_list("links")).alias("l")
    )
    in_order = F.array_sort(F.transform("l", lambda l: F.struct(l["pos"], l["url"])))
    urls = F.array_distinct(F.transform(in_order, lambda l: l["url"]))
    ranked = F.array_sort(F.transform(urls, lambda u, i: F.struct(-ur.path_priority(u), i, u.alias("url"))))
    return pages.select(
        "src_url", F.transform(ranked, lambda l, i: F.struct((i + 1).alias("link_rank"), l["url"].alias("url"))).alias("links")
    )


def rank_page_links(links: DataFrame) -> DataFrame:
    """Distinct links of each page with their rank: priority first, then page order.

    A page's links come from one document, so the window never grows with the table.
    """
    distinct = links.groupBy("page_id", "src_url", "url").agg(
        F.min("pos").alias("pos"), F.first("priority").alias("priority")
    )
    order = Window.partitionBy("page_id", "src_url").orderBy(F.desc("priority"), "pos")
    return distinct.withColumn("link_rank", F.row_number().over(order))
