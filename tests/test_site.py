"""A small site from leads and pages to enriched rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sitecontacts import options as opt
from sitecontacts.functions import urls as ur
from sitecontacts.operators import attribution as at
from sitecontacts.operators import frontier as fr
from sitecontacts.operators import progress as pg
from sitecontacts.operators import scoring as sc
from sitecontacts.operators.ranking import rank_within
from sitecontacts.options import Options
from sitecontacts.plans import enrich as en
from sitecontacts.sources import captures as cp
from sitecontacts.sources import leads as ld
from sitecontacts.sources import sinks
from sitecontacts.sources.robots import allowed_urls, robots_rules
from sitecontacts.sources.sitemaps import expand_sitemaps, parse_sitemaps, sitemap_roots

A = "https://acme.com"


@pytest.fixture(scope="module")
def leads(spark):
    rows = [(0, "1001", A), (1, "1002", ""), (2, "1003", "acme.com"), (3, "1004", "www.beta.io/path")]
    return spark.createDataFrame(rows, "row_index long, CompanyID string, CompanyDomain string")


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (0, A + "/", '<a href="mailto:Contact@acme.com">m</a><a href=/about>a</a><a href="/contact">c</a>', 200),
        (1, A + "/about", '<header>info@acme.com</header><a href="/">h</a><a href="/gone">g</a>', 200),
        (2, A + "/contact", '<body>sales [at] acme [dot] com <a href="/deep">d</a></body>', 200),
        (3, A + "/deep", "<a href=/deeper>d</a>ceo@acme.com", 200),
        (4, A + "/down", "<p>down@acme.com", 503),
        (5, A + "/missing", "<p>missing@acme.com", 404),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, status int")


def queue_of(rows):
    return [(r.url.replace(A, ""), r.depth, r.visit_rank) for r in sorted(rows, key=lambda r: r.visit_rank)]


def test_usable_pages(pages):
    assert {r.page_id for r in cp.usable_pages(pages).collect()} == {0, 1, 2, 3, 5}
    assert cp.usable_pages(pages.drop("status")).count() == 6


def test_targets(leads):
    got = {r.row_index: r.target for r in ld.to_targets(leads).collect()}
    assert set(got) == {0, 2, 3}
    assert got[2].start_url == "https://acme.com/" and got[3].site_domain == "beta.io"
    assert got[0].name == "Unknown Company"
    assert [r.row_index for r in ld.rejected_leads(leads).collect()] == [1]


def test_read_and_write_leads(spark, tmp_path):
    source = tmp_path / "leads.csv"
    source.write_text('Name, Website ,email,Note\nAcme , acme.com,old@x.io,"two\nlines ""q"""\n,b.io,,\n')
    leads = ld.read_leads(spark, str(source))
    assert [r.row_index for r in leads.orderBy("row_index").collect()] == [0, 1]
    first = leads.orderBy("row_index").first()
    assert first.Name == "Acme" and first.Note == 'two\nlines "q"'
    assert sinks.output_columns(leads.columns) == [
        "Name", "Website", "email", "email_source", "email_type", "confidence_score", "discovery_method", "Note"]
    assert sinks.output_columns(["CompanyID", "CompanyDomain"])[-1] == "discovery_method"
    out = str(tmp_path / "out")
    blank = {c: F.lit("") for c in ("email", "email_source", "email_type", "confidence_score", "discovery_method")}
    sinks.write_enriched(leads.withColumns(blank), leads.columns, out)
    back = ld.read_leads(spark, out)
    assert back.count() == 2 and back.columns[1:4] == ["Name", "Website", "email"]


def test_row_index_counts_partitions(spark):
    rows = spark.range(0, 1000, 1, 7).select(F.col("id").alias("x"))
    got = ld.index_rows(rows).collect()
    assert all(r.row_index == r.x for r in got)


def test_latest_unexpired(spark):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    rows = [("a", 1, day(1)), ("a", 2, day(3)), ("a", 3, day(2)), ("b", 4, day(1)), ("c", 5, day(2, 1))]
    df = spark.createDataFrame(rows, "key string, value int, captured_at timestamp")
    live = cp.latest_unexpired(df, "key", "captured_at", 24 * 3600, F.lit(day(3)))
    assert {(r.key, r.value) for r in live.collect()} == {("a", 2), ("c", 5)}
    ever = cp.latest_unexpired(df, "key", "captured_at", None, F.lit(day(9)))
    assert {(r.key, r.value) for r in ever.collect()} == {("a", 2), ("b", 4), ("c", 5)}


ROBOTS = ("Disallow: /early\nUser-agent: other\nDisallow: /\nuser-agent : *\nDisallow: /go # x\n"
          "Sitemap: /sm.xml\n# c\nDisallow:\nAllow: /\nUser-agent: *\nUser-agent: other\nDisallow: /last\n")


def test_robots(spark):
    rules = robots_rules(spark.createDataFrame([(A, ROBOTS)], "origin string, body string"))
    assert {(r.kind, r.value) for r in rules.collect()} == {
        ("disallow", "/early"), ("disallow", "/go # x"), ("sitemap", A + "/sm.xml")}
    urls = spark.createDataFrame([(A + "/early/x",), (A + "/ok",), ("https://b.io/early",)], "url string")
    assert {r.url for r in allowed_urls(urls, rules).collect()} == {A + "/ok", "https://b.io/early"}


def sitemap(*urls, kind="url"):
    return "<x>" + "".join(f"<{kind}><loc> {u} </loc></{kind}>" for u in urls) + "</x>"


def test_sitemaps(spark):
    files = [
        (A + "/sm.xml", sitemap(*[f"{A}/s{i}.xml" for i in range(6)], kind="sitemap")),
        (A + "/s0.xml", sitemap(*[f"{A}/p{i}" for i in range(300)])),
        (A + "/s1.xml", sitemap(A + "/sm.xml", kind="sitemap")),
        (A + "/s2.xml", sitemap(A + "/q")),
        *[(f"{A}/s{i}.xml", sitemap(f"{A}/s{i + 1}.xml", kind="sitemap")) for i in range(3, 9)],
        (A + "/s9.xml", sitemap(A + "/deep")),
        ("https://b.io/sitemap_index.xml", "<!-- " + sitemap("https://b.io/old") + " -->" + sitemap(
            "https://b.io/a", "", "https://b.io/contact&amp;x", "<![CDATA[https://b.io/<!--c-->]]>")),
    ]
    files = spark.createDataFrame(files, "sitemap_url string, xml string")
    docs = parse_sitemaps(files)
    rules = spark.createDataFrame([(A, "sitemap", A + "/sm.xml", 0, 1)],
                                  "origin string, kind string, value string, block_no int, line_no int")
    sites = spark.createDataFrame([("a", A), ("b", "https://b.io")], "site_key string, origin string")
    got = expand_sitemaps(sitemap_roots(sites, rules), docs).collect()
    # 300 URLs and one, and the last file once, though the indexes 3, 4 and 5 all lead to it
    assert [r.url_no for r in sorted(got) if r.site_key == "a"] == list(range(1, 303))
    assert {r.url for r in got if r.site_key == "b"} == {"https://b.io/a", "https://b.io/contact&x", "https://b.io/<!--c-->"}
    limits = Options(max_children_per_index=5, max_urls_per_sitemap=250, max_sitemap_depth=3, sitemap_url_stop=500)
    cut = expand_sitemaps(sitemap_roots(sites, rules), parse_sitemaps(files, limits), limits).collect()
    assert sorted(r.url_no for r in cut if r.site_key == "a") == list(range(1, 251))


def brute_places(lists, root):
    """Shortest, then first path of every file that a root leads to."""
    place, level = {root: ()}, [root]
    while level:
        found = {}
        for f in level:
            for i, child in enumerate(lists.get(f, ())):
                if child not in place:
                    found[child] = min(found.get(child, (10**6,)), (*place[f], i))
        place |= found
        level = list(found)
    return place


def test_sitemaps_that_list_each_other(spark):
    """Twenty indexes that all list all of them, and files they share: every file once a root, for sites that share it."""
    names = [f"{A}/i{i}.xml" for i in range(20)]
    lists = {n: [*names[k:], *names[:k], f"{A}/f{k % 3}.xml"] for k, n in enumerate(names)}
    files = [(n, sitemap(*ls, kind="sitemap")) for n, ls in lists.items()]
    files += [(f"{A}/f{k}.xml", sitemap(*[f"{A}/p{k}-{j}" for j in range(3)])) for k in range(3)]
    parsed = parse_sitemaps(spark.createDataFrame(files, "sitemap_url string, xml string"))
    roots = spark.createDataFrame([("a", names[0], 1), ("b", names[0], 1), ("b", names[4], 2)], "site_key string, sitemap_url string, sitemap_no int")
    got = expand_sitemaps(roots, parsed).collect()
    for site, no, root in (("a", 1, names[0]), ("b", 1, names[0]), ("b", 2, names[4])):
        place = brute_places(lists, root)
        order = sorted((f for f in place if "/f" in f), key=lambda f: place[f])
        want = [f"{A}/p{f[-5]}-{j}" for f in order for j in range(3)]
        assert [r.url for r in sorted(got, key=lambda r: r.url_no) if (r.site_key, r.sitemap_no) == (site, no)] == want


def test_robots_with_many_rules(spark):
    """Ten thousand rules on one origin meet the URLs by equality: no prefix test is left in the plan."""
    rules = spark.range(10_000).selectExpr(f"'{A}' as origin", "'disallow' as kind", "concat('/d', id, '/') as value", "0 as block_no", "0 as line_no")
    urls = spark.range(12_000).selectExpr("id", f"concat('{A}/d', id, '/x') as url").unionByName(
        spark.createDataFrame([(-1, A + "/d"), (-2, A), (-3, "https://b.io/d1/x"), (-4, None), (-5, A + "/d17/x")], "id long, url string"))
    kept = allowed_urls(urls, rules)
    assert "StartsWith" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id for r in kept.collect()} == {*range(10_000, 12_000), -1, -2, -3, -4}


def test_frontier_and_seeds(spark, leads, pages):
    files = [(A + "/sm.xml", sitemap(A + "/contact", A + "/blog", "https://other.com/team"))]
    sitemaps = spark.createDataFrame(files, "sitemap_url string, xml string")
    rules = robots_rules(spark.createDataFrame([(A, ROBOTS)], "origin string, body string"))
    facts = en.page_facts(pages)
    sites = ld.sites_of(ld.to_targets(leads))
    queue = en.crawl_order(sites, facts, rules, sitemaps).where("domain = 'acme.com'")
    # /gone starts with the denied /go only when the rule's comment is cut, which it is not
    assert queue_of(queue.collect()) == [
        ("/", 0, 1), ("/contact", 1, 2), ("https://other.com/team", 1, 3), ("/about", 1, 4),
        ("/deep", 2, 5), ("/gone", 2, 6), ("/deeper", 3, 7)]
    assert {r.url for r in fr.next_fetch(queue, facts).collect()} == {"https://other.com/team", A + "/gone", A + "/deeper"}


def brute_queue(links, start, depth=10**6, budget=10**6, cap=10**6):
    """The sequential queue, page by page."""
    queue, seen, visited = [(start, 0)], {start}, 0
    while visited < min(budget, len(queue)):
        url, d = queue[visited]
        visited += 1
        if d < depth:
            for child in links.get(url, []):
                if child not in seen and len(seen) < cap:
                    seen.add(child)
                    queue.append((child, d + 1))
    return queue


def test_frontier_budgets_against_brute_force(spark):
    import random

    for seed in range(3):
        rnd = random.Random(seed)
        names = [f"{A}/p{i}" for i in range(400)]
        links = {u: list(dict.fromkeys(rnd.sample(names, rnd.choice([0, 3, 40, 150])))) for u in names[:200]}
        rows = [(u, t, i + 1) for u, ts in links.items() for i, t in enumerate(ts)]
        page_links = spark.createDataFrame(rows, "src_url string, url string, link_rank int")
        sites = spark.createDataFrame([("s", "acme.com", names[0])], "site_key string, domain string, start_url string")
        for limits in ({}, {"depth": 2, "budget": 25, "cap": 100}):
            options = Options(max_depth=limits.get("depth"), max_pages_per_site=limits.get("budget"), max_queued_per_site=limits.get("cap"))
            got = fr.build_frontier(sites, page_links, options=options).orderBy("visit_rank").collect()
            assert [(r.url, r.depth) for r in got] == brute_queue(links, names[0], **limits)


def test_enriched_rows(spark, leads, pages):
    for enriched in (en.enrich_crawled(leads, pages), en.enrich_captured(leads, pages)):
        rows = {r.row_index: r for r in enriched.collect()}
        assert set(rows) == {0, 2, 3}
        assert rows[0].email == rows[2].email == "contact@acme.com"
        assert rows[0].confidence_score == "100" and rows[0].discovery_method == "mailto-link"
        assert rows[3].email == "" and rows[3].confidence_score == ""
    summary = at.run_summary(en.enrich_captured(leads, pages), leads).first()
    assert (summary.leads, summary.processed, summary.skipped, summary.with_email) == (4, 3, 1, 2)


def test_fallback_is_off_by_default(spark, leads, pages):
    dns = spark.createDataFrame([("beta.io", True, False)], "domain string, has_mx boolean, disposable boolean")
    email = lambda df: {r.row_index: r.email for r in df.collect()}[3]
    assert email(en.enrich_captured(leads, pages, dns)) == ""
    assert email(en.enrich_captured(leads, pages, dns, Options(fallback_contact=True))) == "hello@beta.io"
    bad = dns.withColumn("disposable", F.lit(True))
    assert email(en.enrich_captured(leads, pages, bad, Options(fallback_contact=True))) == ""


def test_rank_within_matches_sort(spark):
    import random

    rnd = random.Random(1)
    rows = [(rnd.choice("aab"), rnd.randrange(3), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, c int, i int").repartition(5)
    got = rank_within(df, ["k"], {"c": -F.col("c")}, [F.col("i")], "rank").collect()
    for k in "ab":
        want = sorted([r for r in rows if r[0] == k], key=lambda r: (-r[1], r[2]))
        have = [(r.k, r.c, r.i) for r in sorted((r for r in got if r.k == k), key=lambda r: r["rank"])]
        assert have == want


def test_progress(spark):
    leads = spark.range(5).withColumnRenamed("id", "row_index")
    done = lambda xs: spark.createDataFrame([(x,) for x in xs], "row_index long")
    mark = lambda xs: pg.progress_mark(leads, done(xs)).first().mark
    assert (mark([0, 1, 3]), mark([]), mark(range(5))) == (1, -1, 4)
    assert {r.row_index for r in pg.remaining(leads, done([0, 1, 3])).collect()} == {2, 4}
    assert pg.progress_mark(leads.limit(0), done([])).first().mark == -1


def test_site_summary(spark):
    pages = spark.createDataFrame([("a", 1, "usable"), ("a", 2, "server-error"), ("b", 3, "rate-limited")],
                                  "site_key string, page_id long, status_class string")
    emails = spark.createDataFrame([("a", "x@a.io"), ("a", "x@a.io")], "site_key string, email string")
    best = spark.createDataFrame([("a", "x@a.io")], "site_key string, email string")
    maps = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2)], "site_key string, sitemap_no int")
    rows = {r.site_key: r for r in at.site_summary(pages, emails, best, maps).collect()}
    assert rows["a"].asDict() == {"site_key": "a", "pages_crawled": 2, "pages_failed": 1, "sitemaps_parsed": 2,
                                  "emails_found": 1, "final_email": "x@a.io", "outcome": "Found", "status": "success"}
    assert rows["b"].outcome == "Empty" and rows["b"].status == "success" and rows["b"].final_email == "None"


def test_merged_parts_equal_one_count(spark):
    rows = [(i, f"{A}/p{i}", "s", f"e{i % 3}@acme.com", 10 if i % 2 else 3, 10**11 + i) for i in range(20)]
    df = spark.createDataFrame(
        rows, "page_id long, url string, domain string, email string, channel_ord int, first_order long")
    whole = sc.count_candidates(df, ["domain"])
    parts = sc.count_candidates(df.where("page_id < 7"), ["domain"]).unionByName(
        sc.count_candidates(df.where("page_id >= 7"), ["domain"]))
    as_set = lambda x: {str(r.asDict(True)) for r in x.collect()}
    assert as_set(whole) == as_set(sc.merge_candidates(parts, ["domain"]))


def test_denied_start_page_is_not_visited(spark):
    rules = robots_rules(spark.createDataFrame([(A, "User-agent: *\nDisallow: /\n")], "origin string, body string"))
    sites = spark.createDataFrame(
        [("a", "acme.com", A + "/"), ("b", "b.io", "https://b.io/")], "site_key string, domain string, start_url string")
    links = spark.createDataFrame([], "src_url string, url string, link_rank int")
    assert {r.site_key for r in fr.build_frontier(sites, links, rules=rules).collect()} == {"b"}
    free = fr.build_frontier(sites, links, options=Options(respect_robots=False), rules=rules)
    assert {r.site_key for r in free.collect()} == {"a", "b"}


def test_headers_with_dots_spaces_and_backticks(spark, tmp_path, pages):
    (tmp_path / "in.csv").write_text('No.,Web Site,a`b\n1.,acme.com,x\n2,,y\n')
    read = ld.read_leads(spark, str(tmp_path / "in.csv"))
    assert read.columns == ["row_index", "No.", "Web Site", "a`b"]
    sinks.write_enriched(en.enrich_captured(read, pages), read.columns, str(tmp_path / "out"))
    out = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert [(r["No."], r["a`b"], r["email"]) for r in out] == [("1.", "x", "contact@acme.com")]


def test_the_newest_capture_counts_once(spark, leads):
    rows = [(i, "HTTPS://ACME.com/private/x" if i % 2 else A + "/private/x#a", f"<p>v{i // 5}@acme.com") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.row_index: (r.email, r.confidence_score) for r in en.enrich_captured(leads, pages).collect()}
    assert found[0] == ("v1@acme.com", "70")
    denied = robots_rules(spark.createDataFrame([(A, "User-agent: *\nDisallow: /private")], "origin string, body string"))
    assert {r.email for r in en.enrich_captured(leads, pages, rules=denied).collect()} == {""}


def test_a_target_may_be_a_parent_or_have_one_label(spark):
    rows = [(1, "https://a.b.acme.com/", "x@acme.com", 10, 1), (2, "https://q.com/", "y@q.com", 10, 1)]
    emails = spark.createDataFrame(rows, "page_id long, url string, email string, channel_ord int, first_order long")
    domains = spark.createDataFrame([("acme.com",), ("b.acme.com",), ("com",), ("cme.com",)], "domain string")
    got = {(r.domain, r.email) for r in at.attribute_candidates(emails, domains).collect()}
    assert got == {("acme.com", "x@acme.com"), ("b.acme.com", "x@acme.com"), ("com", "x@acme.com"), ("com", "y@q.com")}


def test_rows_of_several_files_keep_their_order(spark, tmp_path):
    """Files of unequal sizes share a task and are read by size, but are numbered by name."""
    at = 0
    for name, n in (("a", 3), ("b", 400), ("c", 1), ("d", 90)):
        (tmp_path / f"{name}.csv").write_text("id,_place,Website\n" + "".join(f"{at + i},p,s{at + i}.io\n" for i in range(n)))
        at += n
    got = ld.read_leads(spark, str(tmp_path), multi_line=False).collect()
    assert len(got) == at and all(r.row_index == int(r.id) and r["_place"] == "p" for r in got)


def test_only_pages_of_targets_are_extracted(spark):
    pages = spark.createDataFrame(
        [(i, f"https://{h}/p{i}", f"<p>info@{h}</p>") for i, h in enumerate(["s0.io", "docs.s0.io", "s1.io", "s2.io", "www.s1.io"] * 3)],
        "page_id long, url string, html string")
    domains = spark.createDataFrame([("s0.io",), ("s1.io",), ("none.io",)], "domain string")
    some, everything = en.pages_of(pages, domains), en.pages_of(pages, domains, few=0)
    assert {r.page_id % 5 for r in some.collect()} == {0, 1, 2, 4} and everything.count() == 15
    best = lambda ps: {(r.domain, r.email, r.occurrences) for r in en.best_by_domain(ps, domains).collect()}
    assert best(pages) == {("s0.io", "info@s0.io", 3), ("s1.io", "info@s1.io", 3)}


def test_joins_that_grow_with_the_input_are_not_broadcast(spark, leads, pages):
    """However small the tables look, as a broadcast passes whole through the driver."""
    rules = spark.createDataFrame([("https://a.io", "disallow", "/x", 0, 1)], "origin string, kind string, value string, block_no int, line_no int")
    urls = spark.createDataFrame([("s", "https://a.io/x", 1)], "site_key string, url string, n int")
    queue = urls.select("site_key", "url", F.lit(0).alias("depth"), F.lit("").alias("referrer"), F.lit(1).alias("visit_rank"))
    found = urls.select("site_key", F.col("url").alias("email"))
    targets = ld.to_targets(leads)
    best = spark.createDataFrame([("acme.com", "a@acme.com", "u", "role", 90, "m")], ["site_domain", *opt.RESULT_COLUMNS])
    frames = [
        allowed_urls(urls, rules), rank_within(urls, ["site_key"], {"n": F.col("n")}, [F.col("url")], "r"),
        fr.next_fetch(queue, urls), at.site_summary(urls.select("site_key", F.col("n").alias("page_id"), F.lit("usable").alias("status_class")), found, found),
        at.hosts_of(urls.select(F.col("site_key").alias("host")), urls.select(F.col("site_key").alias("domain"))),
        en.join_best(targets, best, "site_domain"), pg.remaining(urls.withColumnRenamed("n", "row_index"), urls.select(F.col("n").alias("row_index"))),
    ]
    for frame in frames:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, plan


def test_derived_pages_are_written_in_tasks_of_bounded_size(spark, tmp_path):
    from sitecontacts.plans.derived import derive

    spark.range(9000).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    pages = derive(spark, str(tmp_path), "d_pages")
    assert pages.rdd.getNumPartitions() == max(5, spark.sparkContext.defaultParallelism)


def test_links_that_are_canonical_lead_to_themselves(spark):
    hrefs = ["https://a.io/x", "https://a.io/x?q=1", "https://a.io/x#top", "https://A.io/x", " https://a.io/x ", "https://a.io/./x", "https:///a.io/x", "https://a.io", "https://a.io/x\n", None]
    rows = spark.createDataFrame([(h,) for h in hrefs], "h string").select(ur.resolve_url(F.col("h"), ur.base_parts(F.lit("https://b.io/y/z"))).alias("u"))
    x = "https://a.io/x"
    assert [r.u for r in rows.collect()] == [x, f"{x}?q=1", x, x, x, x, x, "https://a.io/", x, None]
    avoided = [("https://a.io/WP-Admin/", True), ("https://a.io/my-Cart", True), ("https://a.io/walk", False), ("https://login.io/x", False)]
    found = spark.createDataFrame(avoided, "u string, a boolean").where(ur.should_avoid_url(F.col("u")) != F.col("a"))
    assert found.count() == 0


def test_sitemap_files_are_cleaned_once(spark):
    """Comments are cut in one step that the tests and both kinds of entries read; odd entries stay as they were."""
    xml = (
        "<urlset><!-- <url><loc>no</loc></url> --><url><loc>  http://a.b/1\n</loc></url><url><loc>x</loc ></url >"
        "<url a='1'><lastmod/><loc><![CDATA[http://a.b/<!--2-->]]></loc></url><url><loc> </loc></url><url><loc>open</url></urlset>"
    )
    files = spark.createDataFrame([("s", xml), ("none", None)], "sitemap_url string, xml string").repartition(2)
    parsed = parse_sitemaps(files)
    got = {r.sitemap_url: r.entries for r in parsed.collect()}
    assert got == {"s": ["http://a.b/1", "x", "http://a.b/<!--2-->"], "none": None}
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("|<!--") == 1
