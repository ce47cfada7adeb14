"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitecontacts.functions import text as tx, urls as ur
from sitecontacts.operators import attribution as at
from sitecontacts.operators import evidence as ev
from sitecontacts.operators import frontier as fr
from sitecontacts.operators import links as lk
from sitecontacts.operators import progress as pg
from sitecontacts.operators import scoring as sc
from sitecontacts.options import Options
from sitecontacts.plans import enrich as en
from sitecontacts.plans.derived import derive
from sitecontacts.plans.lineage import checkpoint_dir, large, materialize
from sitecontacts.sources import captures as cp
from sitecontacts.sources import leads as ld
from sitecontacts.sources import robots as rb
from sitecontacts.sources import sinks
from sitecontacts.sources import sitemaps as sm
from sitecontacts.streaming import stream as st

RESULT = ["email", "email_source", "email_type", "confidence_score", "discovery_method"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- columns ----------------------------------------------------------------

def _emails(spark, d):
    return derive(spark, d, "d_email").select("c_custkey", tx.normalize_email(F.col("raw")).alias("email"))


def _urls(spark, d):
    return derive(spark, d, "d_url").select("o_orderkey", "raw", ur.normalize_url(F.col("raw")).alias("url"))


def normalized_emails(spark, d):
    return _emails(spark, d)


def valid_emails(spark, d):
    return _emails(spark, d).withColumn("is_valid", tx.is_valid_email(F.col("email")))


def excluded_emails(spark, d):
    words = Options(exclude_words=("privacy",)).with_excluded("Team, doe").exclude_words
    return _emails(spark, d).where(tx.is_valid_email(F.col("email"), words))


def email_types(spark, d):
    return (
        _emails(spark, d).where(tx.is_valid_email(F.col("email")))
        .withColumn("email_type", tx.email_type(F.col("email")))
    )


def base_scores(spark, d):
    return _emails(spark, d).withColumn("base_score", tx.base_score(F.col("email")))


def domain_matches(spark, d):
    return _emails(spark, d).withColumn("matches", tx.is_domain_match(F.col("email"), F.lit("acme.com")))


def normalized_domains(spark, d):
    return table(spark, d, "pages").select("page_id", ur.normalize_domain(F.col("url")).alias("domain"))


def normalized_urls(spark, d):
    return _urls(spark, d)


def link_priority(spark, d):
    return _urls(spark, d).select(
        "o_orderkey", ur.link_priority(F.col("url")).alias("priority"),
        ur.discovery_method(F.col("url")).alias("discovery_method"),
    )


def avoid_urls(spark, d):
    return _urls(spark, d).where(ur.should_avoid_url(F.col("url"))).select("o_orderkey", "url")


def internal_urls(spark, d):
    return _urls(spark, d).where(ur.is_internal_url(F.col("url"), F.lit("acme.com"))).select("o_orderkey", "url")


def page_status(spark, d):
    return cp.classify_pages(derive(spark, d, "d_status")).select("page_id", "status_class")


def latest_capture(spark, d):
    events = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    as_of = events.agg(F.max("ts")).first()[0]
    return cp.latest_unexpired(events, "user_id", "ts", 24 * 3600, F.lit(as_of)).drop("ts")


# --- evidence ---------------------------------------------------------------

def _site_pages(spark, d):
    return derive(spark, d, "d_pages")


def _usable(spark, d):
    return cp.usable_pages(_site_pages(spark, d))


def _channels(*names):
    def query(spark, d):
        return ev.extract_evidence(_usable(spark, d).select("page_id", "url", "html"), channels=list(names)).select(
            "page_id", "email", "source_type", "obf_method", "confidence", "email_type", "discovery_method", "pos"
        )

    return query


def evidence_all(spark, d):
    return ev.extract_evidence(_usable(spark, d).select("page_id", "url", "html")).select(
        "page_id", "email", "source_type", "obf_method", "confidence", "email_type", "discovery_method", "pos"
    )


def evidence_titles(spark, d):
    pages = _usable(spark, d).select("page_id", "url", "html")
    return ev.extract_evidence(pages, with_title=True).select(
        "page_id", "email", "page_title"
    )


def evidence_pages(spark, d):
    return ev.extract_evidence(table(spark, d, "pages")).select(
        "page_id", "email", "source_type", "confidence", "pos"
    )


def _document_pages(spark, d):
    """Documents as pages of the site that is their source."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("page_id"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/")).alias("url"),
        F.concat(F.lit("<body>"), "text", F.lit("</body>")).alias("html"),
    )


def evidence_text_documents(spark, d):
    return ev.extract_evidence(_document_pages(spark, d), channels=["text", "text_spelled_out"]).select(
        F.col("page_id").alias("doc_id"), "email", "channel_ord", "pos"
    )


def _page_emails(pages: DataFrame, keys: list[str]) -> DataFrame:
    found = ev.explode_evidence(ev.with_evidence(pages.select(*keys, "html")))
    return ev.dedupe_page_emails(found, keys)


def page_email_dedupe(spark, d):
    return _page_emails(_usable(spark, d), ["page_id", "url"]).select(
        "page_id", "email", ev.channel_source(F.col("channel_ord")).alias("source_type"),
        ev.channel_confidence(F.col("channel_ord")).alias("confidence"),
        F.floor(F.col("first_order") / F.lit(10**10)).cast("int").alias("first_channel"),
    )


# --- aggregation, scoring, ranking ------------------------------------------

def _site_emails(spark, d):
    pages = _usable(spark, d).withColumn("site_key", F.col("site")).withColumn("domain", F.col("site"))
    return _page_emails(pages, ["page_id", "url", "site_key", "domain"])


def _scored(spark, d):
    return sc.score_candidates(sc.count_candidates(_site_emails(spark, d), ["site_key", "domain"]))


def occurrences(spark, d):
    return sc.count_candidates(_site_emails(spark, d), ["site_key"]).select("site_key", "email", "occurrences")


def final_scores(spark, d):
    return _scored(spark, d).select(
        "site_key", "email", "email_source", "confidence", "source_type", "discovery_method",
        "confidence_score", "base_score", "domain_match",
    )


def ranked_candidates(spark, d):
    return sc.rank_candidates(_scored(spark, d), ["site_key"]).select("site_key", "email", "confidence_score", "rank")


def top_candidates(spark, d):
    return sc.rank_candidates(_scored(spark, d), ["site_key"], top=3).select(
        "site_key", "email", "confidence_score", "rank"
    )


def best_emails(spark, d):
    return sc.best_per_site(_scored(spark, d), ["site_key"]).select("site_key", *RESULT, "occurrences")


def first_seen_events(spark, d):
    emails = _page_emails(_document_pages(spark, d), ["page_id", "url"]).withColumn(
        "domain", ur.normalize_domain(F.col("url"))
    )
    return sinks.discovery_events(at.first_seen(emails, ["domain"])).drop("timestamp")


def site_best_contact(spark, d):
    """Best contact address of every site among the captured pages, sites without one included."""
    pages = table(spark, d, "pages")
    emails = _page_emails(pages, ["page_id", "url"]).withColumn("domain", at.site_domain(F.col("url")))
    best = sc.best_per_site(sc.score_candidates(sc.count_candidates(emails, ["domain"])), ["domain"])
    sites = pages.groupBy(at.site_domain(F.col("url")).alias("site_key")).agg(F.count("*").alias("pages"))
    return sites.join(
        large(best.select(F.col("domain").alias("site_key"), *RESULT)), "site_key", "left"
    ).select("site_key", "pages", *RESULT)


def site_summary(spark, d):
    pages = cp.classify_pages(_site_pages(spark, d)).select(
        F.col("site").alias("site_key"), "page_id", "status_class"
    )
    emails = materialize(_site_emails(spark, d))
    best = sc.best_per_site(
        sc.score_candidates(sc.count_candidates(emails, ["site_key", "domain"])), ["site_key"]
    )
    return at.site_summary(pages, emails, best).drop("sitemaps_parsed")


# --- links, robots, sitemaps, frontier --------------------------------------

def page_links(spark, d):
    return lk.rank_page_links(lk.extract_links(table(spark, d, "pages"))).select(
        "page_id", "url", "priority", "link_rank"
    )


def site_links(spark, d):
    return lk.rank_page_links(lk.extract_links(_usable(spark, d))).select("page_id", "url", "priority", "link_rank")


def robots_rules(spark, d):
    return rb.robots_rules(derive(spark, d, "d_robots")).groupBy("origin", "kind", "value").agg(
        F.count("*").alias("n")
    )


def robots_filter(spark, d):
    rules = materialize(rb.robots_rules(derive(spark, d, "d_robots")))  # read twice
    return rb.allowed_urls(_site_pages(spark, d).select("page_id", "url"), rules)


def sitemap_urls(spark, d):
    origins = derive(spark, d, "d_sites").select("site_key", ur.url_origin(F.col("start_url")).alias("origin"))
    roots = sm.sitemap_roots(origins, rb.robots_rules(derive(spark, d, "d_robots")))
    parsed = materialize(sm.parse_sitemaps(derive(spark, d, "d_sitemaps")))
    return sm.expand_sitemaps(roots, parsed)


def _crawl(spark, d):
    """Page facts and frontier of the derived sites."""
    facts = en.page_facts(_site_pages(spark, d).select("page_id", "url", "html", "status"))
    queue = en.crawl_order(
        derive(spark, d, "d_sites"), facts, rb.robots_rules(derive(spark, d, "d_robots")),
        derive(spark, d, "d_sitemaps"),
    )
    return facts, queue


def crawl_queue(spark, d):
    _, queue = _crawl(spark, d)
    return queue.select("site_key", "url", "depth", "referrer", "visit_rank", "parent_rank")


def next_fetch(spark, d):
    facts, queue = _crawl(spark, d)
    return fr.next_fetch(queue, facts)


def crawl_best(spark, d):
    facts, queue = _crawl(spark, d)
    return en.best_by_crawl(queue, facts).select("site_key", *RESULT)


# --- leads ------------------------------------------------------------------

def _leads(spark, d):
    return derive(spark, d, "d_leads")


def lead_targets(spark, d):
    return ld.to_targets(_leads(spark, d)).select(
        "row_index", "target.name", "target.website", "target.domain", "target.start_url"
    )


def rejected_leads(spark, d):
    return ld.rejected_leads(_leads(spark, d)).select("row_index", "Name")


def indexed_rows(spark, d):
    """Row positions of a table that is read without them."""
    return ld.index_rows(table(spark, d, "customer").select("c_custkey", "c_name"))


def lead_file(spark, d):
    """Leads written as CSV files of unequal sizes and read back in order with their own header."""
    path = f"{checkpoint_dir(spark)}/leads-{_fresh()}"
    leads = _leads(spark, d)
    n = leads.count()
    cuts = {"a": f"row_index < {n // 20}", "b": f"row_index >= {n // 20} and row_index < {n // 2}", "c": f"row_index >= {n // 2}"}
    for name, rows in cuts.items():
        part = leads.where(rows).coalesce(1).sortWithinPartitions("row_index")
        part.drop("row_index").write.option("header", True).option("escape", '"').csv(f"{path}/{name}")
    return ld.read_leads(spark, f"{path}/*", multi_line=False)


def robots_enriched_leads(spark, d):
    """Enriched leads without the pages that robots rules deny."""
    rules = rb.robots_rules(derive(spark, d, "d_robots"))
    return en.enrich_captured(_leads(spark, d), _site_pages(spark, d), rules=rules)


def enriched_leads(spark, d):
    return en.enrich_captured(_leads(spark, d), _site_pages(spark, d))


def output_columns(spark, d):
    """The enriched file's rows in output column order."""
    leads = _leads(spark, d)
    return sinks.place_results(en.enrich_captured(leads, _site_pages(spark, d)), leads.columns)


def fallback_contact(spark, d):
    return en.enrich_captured(
        _leads(spark, d), _site_pages(spark, d), derive(spark, d, "d_dns"), Options(fallback_contact=True)
    ).select("row_index", "email", "confidence_score", "discovery_method")


def run_summary(spark, d):
    leads = _leads(spark, d)
    return at.run_summary(en.enrich_captured(leads, _site_pages(spark, d)), leads)


def _progress(spark, d):
    return (
        table(spark, d, "orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
        .select(F.col("o_custkey").alias("row_index")).distinct()
    )


def _lead_rows(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("row_index"), F.col("c_name").alias("name"))


def resume_remaining(spark, d):
    return pg.remaining(_lead_rows(spark, d), _progress(spark, d))


def progress_mark(spark, d):
    return pg.progress_mark(_lead_rows(spark, d), _progress(spark, d))


# --- streaming --------------------------------------------------------------

def _arrive(spark, base: str, parts: list[DataFrame], run) -> None:
    """Write the parts to a folder one after the other; after each, `run` a stream over the folder, anew each time."""
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        run(spark.readStream.schema(part.schema).parquet(f"{base}/in")).awaitTermination()


def stream_equals_batch(spark, d):
    """Best address per site kept by a stream in which newer captures replace a third of the pages."""
    base = f"{checkpoint_dir(spark)}/stream-{_fresh()}"
    pages = table(spark, d, "pages").select("page_id", "url", "html")
    old = pages.where("page_id % 3 = 0").select(
        (F.col("page_id") - 10**9).alias("page_id"), "url", F.lit("<p>old@example.com older@example.com</p>").alias("html")
    )
    _arrive(
        spark, base, [old, pages.where("page_id % 2 = 0"), pages.where("page_id % 2 = 1")],
        lambda s: st.stream_running_best(s, f"{base}/state", f"{base}/log", compact_every=2),
    )
    return st.running_best(spark, f"{base}/state").select("domain", *RESULT, "occurrences")


def stream_evidence(spark, d):
    """Evidence of allowed pages as a stream writes it, restarted in the midst."""
    base = f"{checkpoint_dir(spark)}/evidence-{_fresh()}"
    rules = materialize(rb.robots_rules(derive(spark, d, "d_robots")))
    pages = _site_pages(spark, d).select("page_id", "url", "html", "status")
    _arrive(
        spark, base, [pages.where("page_id % 3 = 0"), pages.where("page_id % 3 > 0")],
        lambda s: st.stream_evidence(s, f"{base}/out", f"{base}/log", rules=rules),
    )
    return spark.read.parquet(f"{base}/out").select(
        "page_id", "email", "source_type", "obf_method", "confidence", "email_type", "discovery_method", "pos"
    )


def stream_enriched_leads(spark, d):
    """Leads enriched as they arrive in two files, from candidates that a stream of pages has counted."""
    base = f"{checkpoint_dir(spark)}/enriched-{_fresh()}"
    pages = _site_pages(spark, d).select("page_id", "url", "html", "status")
    _arrive(
        spark, f"{base}/pages", [pages.where("page_id % 2 = 0"), pages.where("page_id % 2 = 1")],
        lambda s: st.stream_running_best(s, f"{base}/state", f"{base}/pages-log", compact_every=2),
    )
    leads = _leads(spark, d)
    columns = [c for c in leads.columns if c != "row_index"]
    _arrive(
        spark, f"{base}/leads", [leads.where("row_index % 3 > 0"), leads.where("row_index % 3 = 0")],
        lambda s: st.stream_enrichment(s, None, columns, f"{base}/out", f"{base}/done", f"{base}/leads-log", state=f"{base}/state"),
    )
    return spark.read.option("header", True).option("escape", '"').csv(f"{base}/out").drop("batch").na.fill("")


def _fresh() -> str:
    import uuid

    return uuid.uuid4().hex


QUERIES = {
    f.__name__: f
    for f in (
        site_best_contact, normalized_emails, valid_emails, excluded_emails, email_types, base_scores,
        domain_matches, normalized_domains, normalized_urls, link_priority, avoid_urls, internal_urls,
        page_status, latest_capture, evidence_all, evidence_titles, evidence_pages, evidence_text_documents,
        page_email_dedupe, occurrences, final_scores, ranked_candidates, top_candidates, best_emails,
        first_seen_events, site_summary, page_links, site_links, robots_rules, robots_filter,
        sitemap_urls, crawl_queue, next_fetch, crawl_best,
        lead_targets, rejected_leads, indexed_rows, lead_file,
        enriched_leads, robots_enriched_leads, output_columns, fallback_contact,
        run_summary, resume_remaining, progress_mark, stream_equals_batch, stream_evidence, stream_enriched_leads,
    )
}
QUERIES |= {
    "evidence_protected": _channels("protected_attr", "protected_link"),
    "evidence_mailto": _channels("mailto"),
    "evidence_header": _channels("header"),
    "evidence_footer": _channels("footer"),
    "evidence_meta": _channels("meta"),
    "evidence_script": _channels("script", "script_spelled_out"),
    "evidence_base64": _channels("script_base64"),
    "evidence_text": _channels("text"),
    "evidence_spelled_out": _channels("text_spelled_out"),
}
