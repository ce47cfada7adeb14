"""Visit order of a site's pages, under depth and page budgets where they are set.

Breadth first with a queue visits all of depth d before depth d+1, so the queue is
built level by level, one join per depth. A row's visit_rank is its place in the
sequential queue of its site.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sitecontacts.functions import urls as ur
from sitecontacts.operators.ranking import rank_within
from sitecontacts.options import Options
from sitecontacts.plans.lineage import key_hash, large, materialize, merged
from sitecontacts.sources.robots import denials, not_denied

QUEUE_COLUMNS = ["site_key", "domain", "url", "depth", "referrer", "visit_rank", "parent_rank"]


def seed_urls(sitemap_urls: DataFrame, options: Options = Options()) -> DataFrame:
    """Sitemap URLs of a site with a contact or company path, in order: (site_key, url, seed_no)."""
    seeds = rank_within(
        sitemap_urls.where(ur.link_priority(F.col("url")) > 0), ["site_key"],
        {"file": F.col("sitemap_no")}, [F.col("url_no")], "seed_no",
    )
    if options.max_sitemap_seeds is not None:
        seeds = seeds.where(F.col("seed_no") <= options.max_sitemap_seeds)
    return seeds.select("site_key", ur.normalize_url(F.col("url")).alias("url"), F.col("seed_no").cast("int").alias("seed_no"))


def _initial_queue(sites: DataFrame, seeds: DataFrame | None) -> DataFrame:
    start = sites.select(
        "site_key", "domain", F.col("start_url").alias("url"), F.lit(0).alias("depth"),
        F.lit("").alias("referrer"), F.lit(0).alias("_order"),
    )
    if seeds is None:
        return start.select(
            "site_key", "domain", "url", "depth", "referrer",
            F.lit(1).alias("visit_rank"), F.lit(0).alias("parent_rank"),
        )
    more = seeds.join(large(sites.select("site_key", "domain")), "site_key").select(
        "site_key", "domain", "url", F.lit(1).alias("depth"),
        F.lit("sitemap").alias("referrer"), F.col("seed_no").alias("_order"),
    )
    once = start.unionByName(more).groupBy(key_hash("site_key", "url"), "site_key", "domain", "url").agg(
        F.min(F.struct("_order", "depth", "referrer")).alias("f")
    )
    once = once.select("site_key", "domain", "url", "f.*")
    ranked = rank_within(once, ["site_key"], {"block": F.col("_order").bitwiseAND(~1023)}, [F.col("_order")], "visit_rank")
    return ranked.select(
        "site_key", "domain", "url", "depth", "referrer",
        F.col("visit_rank").cast("int").alias("visit_rank"), F.lit(0).alias("parent_rank"),
    )


def expand_level(
    queue: DataFrame, level: DataFrame, queued: DataFrame, links: DataFrame, depth: int, options: Options,
    denied: DataFrame | None = None,
) -> DataFrame:
    """Queue rows that visiting the pages of one depth adds.

    `level` holds the queue rows of that depth, queued(site_key, _after) the length of the queue of
    their sites. links(src_url, links) holds the links of a captured page in one row, so a level meets
    pages, not links. Those that `denied` covers are left out where they are new.
    New rows are ranked per parent page, so no task sorts all URLs of a site.
    """
    parents = visited_pages(level, options).select(
        "site_key", "domain", F.col("url").alias("src_url"), F.col("visit_rank").alias("parent_rank"),
        ur.own_start(F.col("domain")).alias("_own"),
    )
    internal = F.coalesce(F.startswith("url", "_own"), F.lit(False)) | ur.is_internal_url(F.col("url"), F.col("domain"))
    children = (
        merged(parents, links.select("src_url", "links"), ["src_url"])
        .select("site_key", "domain", "src_url", "parent_rank", "_own", F.explode("links").alias("l"))
        .select("site_key", "domain", "src_url", "parent_rank", "_own", "l.url", "l.link_rank")
        .where((F.col("url") != F.col("src_url")) & internal)  # a parent is queued already
    )
    row = key_hash("site_key", "url").alias("_row")
    first = children.groupBy(row, "site_key", "domain", "url").agg(
        F.min(F.struct("parent_rank", "link_rank", "src_url")).alias("f")
    ).select("_row", "site_key", "domain", "url", "f.*")
    new = first.join(large(queue.select(row, "site_key", "url")), ["_row", "site_key", "url"], "left_anti").drop("_row")
    if denied is not None:
        new = not_denied(materialize(new), denied, repeated=False)
    ranked = rank_within(new, ["site_key"], {"parent": F.col("parent_rank")}, [F.col("link_rank")], "_n", queued)
    added = ranked.select(
        "site_key", "domain", "url", F.lit(depth + 1).alias("depth"), F.col("src_url").alias("referrer"),
        F.col("_n").cast("int").alias("visit_rank"), "parent_rank",
    )
    if options.max_queued_per_site is not None:
        added = added.where(F.col("visit_rank") <= options.max_queued_per_site)
    return added


def build_frontier(
    sites: DataFrame,
    page_links: DataFrame,
    seeds: DataFrame | None = None,
    options: Options = Options(),
    rules: DataFrame | None = None,
) -> DataFrame:
    """The queue of every site: start page, sitemap seeds, then links level by level.

    sites(site_key, domain, start_url); page_links(src_url, url, link_rank), one row
    per distinct link of a captured page, or link_lists. The result has QUEUE_COLUMNS. With `rules`,
    denied URLs are never queued; a site whose start page is denied has no queue. Rules meet
    the new URLs of a level, before they are ranked. A level reads its own rows only, and a site's
    queue is as long as its last rank, which the rows of a level hold; the rows of earlier levels
    are read by key alone, to leave out what is queued already.
    """
    denied = None
    if rules is not None and options.respect_robots:
        denied = materialize(denials(rules))
        sites = not_denied(sites, denied, "start_url")
        seeds = None if seeds is None else not_denied(seeds, denied)
    if "links" not in page_links.columns:
        page_links = materialize(page_links.groupBy("src_url").agg(F.collect_list(F.struct("link_rank", "url")).alias("links")))
    queue = initial = materialize(_initial_queue(sites, seeds))
    level, longest, depth = initial.where("depth = 0"), initial, 0
    while options.max_depth is None or depth < options.max_depth:
        queued = longest.groupBy("site_key").agg(F.max("visit_rank").alias("_after"))
        added = materialize(expand_level(queue, level, queued, page_links, depth, options, denied))
        # sitemap seeds have depth 1 already, so their links still wait after an empty first level
        if added.isEmpty() and depth > 0:
            break
        queue = queue.unionByName(added)
        level = longest = added if depth else added.unionByName(initial.where("depth = 1"))
        depth += 1
    return queue


def visited_pages(queue: DataFrame, options: Options = Options()) -> DataFrame:
    """The queue rows inside the page budget; pages without a capture use it up too."""
    if options.max_pages_per_site is None:
        return queue
    return queue.where(F.col("visit_rank") <= options.max_pages_per_site)


def next_fetch(queue: DataFrame, captured: DataFrame, options: Options = Options()) -> DataFrame:
    """Visited pages that have no capture, in visit order: what a fetcher gets next.

    captured(url) holds the canonical URLs of captured pages.
    """
    return merged(visited_pages(queue, options), captured.select("url"), ["url"], "left_anti").select(
        "site_key", "url", "depth", "referrer", "visit_rank"
    )
