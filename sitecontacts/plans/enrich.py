"""Whole runs: leads and captured pages in, enriched leads out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sitecontacts import options as opt
from sitecontacts.functions import text as tx, urls as ur
from sitecontacts.operators import attribution as at
from sitecontacts.operators import evidence as ev
from sitecontacts.operators import frontier as fr
from sitecontacts.operators import links as lk
from sitecontacts.operators import scoring as sc
from sitecontacts.options import Options
from sitecontacts.plans.lineage import large, materialize, merged
from sitecontacts.sources.captures import capture_key, newest_pages, usable_pages
from sitecontacts.sources.leads import quoted, sites_of, to_targets
from sitecontacts.sources.robots import allowed_urls
from sitecontacts.sources.sitemaps import expand_sitemaps, parse_sitemaps, sitemap_roots


def page_facts(pages: DataFrame, options: Options = Options()) -> DataFrame:
    """Evidence and links of every usable page, written once; the page text is read once.

    (page_id, url, evidence, links); `url` is the canonical URL without fragment and
    unique: of several captures the newest is kept. Which one that is comes from a scan
    of small columns alone, and meets the facts after extraction, so the page text stays
    out of every shuffle.
    """
    usable = usable_pages(pages).where("url is not null")
    # keys that are never null spare the test for it, which would read the URL once more
    never_null = lambda c: F.coalesce(c, F.lit("")).alias("url")
    kept = newest_pages(usable).select(never_null(F.col("url")), "page_id")
    read = lk.with_links(ev.with_evidence(usable, options)).select(
        "page_id", never_null(capture_key(F.col("url"))), "evidence", "links"
    )
    return materialize(read.join(large(kept), ["page_id", "url"]))


def fallback_contacts(targets: DataFrame, domain_dns: DataFrame, options: Options = Options()) -> DataFrame:
    """hello@ addresses of domains known to accept mail: (site_domain, fallback_email).

    domain_dns(domain, has_mx, disposable) stands for the live lookups.
    """
    good = domain_dns.where("has_mx and not disposable").select(F.col("domain").alias("site_domain")).distinct()
    address = F.concat(F.lit("hello@"), F.col("site_domain"))
    return (
        targets.select("target.site_domain").distinct()
        .join(large(good), "site_domain")
        .withColumn("fallback_email", address)
        .where(tx.is_valid_email(F.col("fallback_email"), options.exclude_words))
    )


def join_best(
    targets: DataFrame, best: DataFrame, key: str, domain_dns: DataFrame | None = None,
    options: Options = Options(),
) -> DataFrame:
    """Every target once, with its winner or blanks.

    `best` has one row per `key`, a field of the target struct.
    """
    lead_columns = [F.col(quoted(c)) for c in targets.columns if c not in opt.RESULT_COLUMNS and c != "target"]
    winner = best.select(
        F.col(key), *[F.col(c).alias(f"_{c}") for c in opt.RESULT_COLUMNS]
    )
    joined = targets.select(*lead_columns, "target", F.col(f"target.{key}").alias(key)).join(
        large(winner), key, "left"
    )
    values = {c: F.col(f"_{c}").cast("string") for c in opt.RESULT_COLUMNS}
    if options.fallback_contact and domain_dns is not None:
        guesses = fallback_contacts(targets, domain_dns, options)
        joined = joined.withColumn("_site", F.col("target.site_domain")).join(
            large(guesses.withColumnRenamed("site_domain", "_site")), "_site", "left"
        )
        guess = {
            "email": F.col("fallback_email"),
            "email_source": F.col("target.website"),
            "email_type": F.lit("role"),
            "confidence_score": F.lit("50"),
            "discovery_method": F.lit("fallback-hello"),
        }
        values = {
            c: F.when(F.col("_email").isNotNull(), v)
            .when(F.col("fallback_email").isNotNull(), guess[c])
            for c, v in values.items()
        }
    return joined.select(
        *lead_columns, *[F.coalesce(v, F.lit("")).alias(c) for c, v in values.items()]
    )


#: Hosts of targets, at most about 100 bytes each, that are sent to the pages.
_FEW_HOSTS = 200_000


def pages_of(pages: DataFrame, domains: DataFrame, few: int = _FEW_HOSTS) -> DataFrame:
    """Pages whose host belongs to a target, where the targets' hosts are few; else all pages.

    The hosts come from the URL column alone. Up to `few` of them are broadcast, so that the text of
    other pages is not even read from columns; beyond it, a filter would shuffle the texts
    and spare little, and candidates meet their targets after extraction anyway.
    """
    host = ur.url_host(F.col("url"))
    hosts = materialize(at.hosts_of(pages.select(host.alias("host")).distinct(), domains))
    if hosts.count() > few:
        return pages
    return pages.join(F.broadcast(hosts.withColumnRenamed("host", "_host")), host == F.col("_host"), "left_semi")


def best_by_domain(
    pages: DataFrame, domains: DataFrame, options: Options = Options(), rules: DataFrame | None = None
) -> DataFrame:
    """Winner per domain over all captured pages of it: domains(domain).

    Of several captures of a URL the newest counts. With `rules`, pages a robots file
    denies count as not captured; both are taken out after extraction, where rows no
    longer carry the page text.
    """
    usable = pages_of(usable_pages(pages), domains)
    page_emails = ev.dedupe_page_emails(ev.explode_evidence(ev.with_evidence(usable, options)))
    page_emails = page_emails.join(large(newest_pages(usable).select("page_id")), "page_id", "left_semi")
    if rules is not None and options.respect_robots:
        # the rules meet these rows twice; written once, pages are extracted once
        page_emails = allowed_urls(materialize(page_emails), materialize(rules))
    return sc.best_per_site(
        sc.score_candidates(at.attribute_candidates(page_emails, domains)), ["domain"]
    )


def enrich_captured(
    leads: DataFrame, pages: DataFrame, domain_dns: DataFrame | None = None,
    options: Options = Options(), rules: DataFrame | None = None,
) -> DataFrame:
    """Enrich leads from every captured page of their domains, without a visit budget."""
    targets = to_targets(leads)
    domains = targets.select(F.col("target.site_domain").alias("domain")).distinct()
    best = best_by_domain(pages, domains, options, rules).withColumnRenamed("domain", "site_domain")
    return join_best(targets, best, "site_domain", domain_dns, options)


def enrich_counted(
    leads: DataFrame, hosts: DataFrame, domain_dns: DataFrame | None = None, options: Options = Options()
) -> DataFrame:
    """Enrich leads from candidates that are already counted per host, without reading a page."""
    targets = to_targets(leads)
    domains = targets.select(F.col("target.site_domain").alias("domain")).distinct()
    best = sc.best_per_site(sc.score_candidates(at.attribute_hosts(hosts, domains)), ["domain"])
    return join_best(targets, best.withColumnRenamed("domain", "site_domain"), "site_domain", domain_dns, options)


def site_seeds(
    sites: DataFrame, rules: DataFrame | None, sitemaps: DataFrame | None, options: Options = Options()
) -> DataFrame | None:
    """Sitemap seeds of every site, or None without sitemaps."""
    if sitemaps is None:
        return None
    origins = sites.select("site_key", ur.url_origin(F.col("start_url")).alias("origin"))
    if rules is None:
        rules = sites.sparkSession.createDataFrame(
            [], "origin string, kind string, value string, block_no int, line_no int"
        )
    parsed = materialize(parse_sitemaps(sitemaps, options))
    return fr.seed_urls(expand_sitemaps(sitemap_roots(origins, rules), parsed, options), options)


def crawl_order(
    sites: DataFrame, facts: DataFrame, rules: DataFrame | None = None,
    sitemaps: DataFrame | None = None, options: Options = Options(),
) -> DataFrame:
    """Frontier of every site over the captured link graph."""
    links = materialize(lk.link_lists(facts))
    if rules is not None:
        rules = materialize(rules)
    return fr.build_frontier(sites, links, site_seeds(sites, rules, sitemaps, options), options, rules)


def visited_emails(queue: DataFrame, facts: DataFrame, options: Options = Options()) -> DataFrame:
    """Addresses on visited pages: one row per address and page, in visit order."""
    visits = fr.visited_pages(queue, options).select("site_key", "domain", "url", "visit_rank")
    emails = ev.dedupe_page_emails(ev.explode_evidence(facts.select("page_id", "url", "evidence")))
    return merged(visits, emails, ["url"])


def best_by_crawl(queue: DataFrame, facts: DataFrame, options: Options = Options()) -> DataFrame:
    """Winner per site_key over the captured pages of its queue."""
    counted = sc.count_candidates(visited_emails(queue, facts, options), ["site_key", "domain"], "visit_rank")
    return sc.best_per_site(sc.score_candidates(counted), ["site_key"])


def enrich_crawled(
    leads: DataFrame, pages: DataFrame, rules: DataFrame | None = None,
    sitemaps: DataFrame | None = None, domain_dns: DataFrame | None = None,
    options: Options = Options(),
) -> DataFrame:
    """Enrich leads from the captured pages that links and sitemaps lead to, within the limits that are set."""
    targets = to_targets(leads)
    facts = page_facts(pages, options)
    queue = crawl_order(sites_of(targets), facts, rules, sitemaps, options)
    return join_best(
        targets, best_by_crawl(queue, facts, options), "site_key", domain_dns, options
    )
