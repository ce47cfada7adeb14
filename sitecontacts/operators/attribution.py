"""Which captured pages belong to which site, and the per-site summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sitecontacts.functions import urls as ur
from sitecontacts.operators import scoring as sc
from sitecontacts.plans.lineage import large


def count_hosts(page_emails: DataFrame) -> DataFrame:
    """Candidates counted per host: (host, site, email, occurrences, best, first); site is the host without www.

    page_emails(page_id, url, email, channel_ord, first_order).
    """
    named = page_emails.withColumns({"host": ur.url_host(F.col("url")), "site": site_domain(F.col("url"))})
    return sc.count_candidates(named, ["host", "site"])


def attribute_hosts(by_host: DataFrame, domains: DataFrame) -> DataFrame:
    """Counted candidates per target domain from those per host.

    A host belongs to every target whose domain is the host or a parent of it: an equi
    join on the exploded parent domains. A suffix of one label is shared by most hosts, so
    it is joined apart, with the few targets that have one label, which may be broadcast; the sum per (domain,
    email) has a partitioning of its own, which leaves a frequent domain of the join free to be split.
    by_host(host, email, occurrences, best, first); domains(domain).
    """
    wanted = domains.select("domain").distinct()
    one_label = ~F.contains("domain", F.lit("."))
    suffixes = by_host.select("*", ur.host_suffixes(F.col("host")).alias("_s"))
    several = suffixes.select("*", F.explode(F.filter("_s", lambda s: F.contains(s, F.lit(".")))).alias("domain"))
    last = suffixes.select("*", F.explode(F.filter("_s", lambda s: ~F.contains(s, F.lit(".")))).alias("domain"))
    matched = several.join(large(wanted.where(~one_label)), "domain").unionByName(last.join(wanted.where(one_label), "domain"))
    return sc.merge_candidates(matched.drop("_s").repartition("domain", "email"), ["domain"])


def hosts_of(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """The hosts that are a target domain or below one: hosts(host), domains(domain) to (host)."""
    parents = hosts.select("host", F.explode(ur.host_suffixes(F.col("host"))).alias("domain"))
    return parents.join(large(domains.select("domain").distinct()), "domain", "left_semi").select("host").distinct()


def attribute_candidates(page_emails: DataFrame, domains: DataFrame) -> DataFrame:
    """Counted candidates per target domain.

    A page belongs to every target whose domain is its host or a parent of it. Pages
    are first combined per host, so a host with very many pages meets the join as few rows.
    page_emails(page_id, url, email, channel_ord, first_order); domains(domain).
    """
    return attribute_hosts(count_hosts(page_emails), domains)


def site_domain(url) -> "F.Column":
    """Site of a page when no targets are given: its host without www."""
    return ur.normalize_domain(url)


def site_summary(
    pages: DataFrame, page_emails: DataFrame, best: DataFrame, sitemaps: DataFrame | None = None
) -> DataFrame:
    """Per site: pages, failed pages, sitemaps, distinct emails, chosen email and outcome.

    pages(site_key, page_id, status_class); page_emails(site_key, email);
    best(site_key, email); sitemaps(site_key, sitemap_no).
    """
    crawled = pages.groupBy("site_key").agg(
        F.count("*").alias("pages_crawled"),
        F.count_if(F.col("status_class") != "usable").alias("pages_failed"),
    )
    found = (
        page_emails.select("site_key", "email").distinct()
        .groupBy("site_key").agg(F.count("*").alias("emails_found"))
    )
    summary = crawled.join(large(found), "site_key", "left").join(
        large(best.select("site_key", F.col("email").alias("final_email"))), "site_key", "left"
    )
    if sitemaps is None:
        summary = summary.withColumn("sitemaps_parsed", F.lit(0).cast("bigint"))
    else:
        parsed = sitemaps.groupBy("site_key").agg(F.count_distinct("sitemap_no").alias("sitemaps_parsed"))
        summary = summary.join(large(parsed), "site_key", "left")
    return summary.select(
        "site_key", "pages_crawled", "pages_failed",
        F.coalesce("sitemaps_parsed", F.lit(0)).alias("sitemaps_parsed"),
        F.coalesce("emails_found", F.lit(0)).alias("emails_found"),
        F.coalesce("final_email", F.lit("None")).alias("final_email"),
        F.when(F.col("final_email").isNull(), "Empty").otherwise("Found").alias("outcome"),
        # a page that fails does not fail its site
        F.lit("success").alias("status"),
    )


def run_summary(enriched: DataFrame, leads: DataFrame) -> DataFrame:
    """One row: leads read, rows written, leads skipped and rows with an email."""
    one, none = F.lit(1).alias, F.lit(0).alias
    marks = leads.select(one("read"), none("written"), none("found")).unionByName(
        enriched.select(none("read"), one("written"), (F.col("email") != "").cast("int").alias("found"))
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return marks.agg(
        total("read").alias("leads"), total("written").alias("processed"), total("found").alias("with_email")
    ).select("leads", "processed", (F.col("leads") - F.col("processed")).alias("skipped"), "with_email")


def first_seen(page_emails: DataFrame, keys: list[str], page_order: str = "page_id") -> DataFrame:
    """First sighting of every address in a site, as the page's best evidence shows it."""
    row = F.struct(
        F.col(page_order).alias("page"), "first_order", "url", "channel_ord",
    )
    return page_emails.groupBy(*keys, "email").agg(F.min(row).alias("f")).select(
        *keys, "email", "f.url", "f.channel_ord"
    )
