"""Links, robots rules and levels of the crawl queue, where rows are kept few."""

import random

import pytest
from pyspark.sql import functions as F

from sitecontacts.functions import urls as ur
from sitecontacts.operators import evidence as ev
from sitecontacts.operators import frontier as fr
from sitecontacts.operators import links as lk
from sitecontacts.options import Options
from sitecontacts.plans import enrich as en
from sitecontacts.plans.derived import derive
from sitecontacts.sources.captures import newest_pages
from sitecontacts.sources.robots import allowed_urls, robots_rules

A = "https://acme.com"


def test_link_lists_hold_the_ranked_links_of_a_page_in_one_row(spark):
    """The same links and ranks as the table of link rows, repeated pages included, with one shuffle of pages and no window."""
    links = "<a href=/x>x</a><a href=/contact>c</a><a href=/x>x</a><a href=/legal>l</a><a href='/team?a=1'>t</a><a href=/login>n</a><a href=/y>y</a>"
    rows = [(1, A + "/", links), (1, A + "/", links), (2, A + "/b", "<a href=/b>b</a>"), (3, A + "/c", "<p>none</p>"), (4, A + "/d", "<a>no</a>")]
    pages = lk.with_links(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    lists = lk.link_lists(pages)
    got = {(r.src_url, l.link_rank, l.url) for r in lists.collect() for l in r.links}
    want = {(r.src_url, r.link_rank, r.url) for r in lk.rank_page_links(lk.explode_links(pages)).collect()}
    assert got == want and len(want) == 6 and lists.count() == 2
    plan = lists._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "explode" not in plan


def brute_queue(lists, start, allowed):
    queue, at = [start], 0
    while at < len(queue):
        for url in lists.get(queue[at], []):
            if url not in queue and allowed(url):
                queue.append(url)
        at += 1
    return queue


@pytest.mark.parametrize("as_lists", [False, True])
def test_denied_links_are_left_out_of_every_level(spark, as_lists):
    rnd = random.Random(5)
    names = [f"{A}/{rnd.choice(['blog', 'item', 'team'])}/{i}" for i in range(120)]
    lists = {u: [u, *dict.fromkeys(rnd.sample(names, 6)), "https://other.org/x", A + "/"] for u in [A + "/", *names[:60]]}
    rows = [(u, t, i + 1) for u, ts in lists.items() for i, t in enumerate(ts)]
    links = spark.createDataFrame(rows, "src_url string, url string, link_rank int")
    if as_lists:
        links = links.groupBy("src_url").agg(F.collect_list(F.struct("link_rank", "url")).alias("links"))
    rules = robots_rules(spark.createDataFrame([(A, "User-agent: *\nDisallow: /blog\nDisallow: /team/1")], "origin string, body string"))
    sites = spark.createDataFrame([("s", "acme.com", A + "/"), ("t", "acme.com", names[0])], "site_key string, domain string, start_url string")
    allowed = lambda u: u.startswith(A) and not u.startswith((A + "/blog", A + "/team/1"))
    got = fr.build_frontier(sites, links, rules=rules).orderBy("visit_rank").collect()
    for site, start in (("s", A + "/"), ("t", names[0])):
        want = brute_queue(lists, start, allowed) if allowed(start) else []
        assert [r.url for r in got if r.site_key == site] == want
        assert [r.visit_rank for r in got if r.site_key == site] == list(range(1, len(want) + 1))


def test_a_level_meets_pages_not_links(spark):
    """The link table of a level has one row a page, and its join sorts by a hash before the URLs."""
    row = lambda cols, *rs: spark.createDataFrame(list(rs), cols)
    level = row("site_key string, domain string, url string, visit_rank int", ("s", "acme.com", A + "/", 1))
    lists = row("src_url string, links array<struct<link_rank:int,url:string>>", (A + "/", [(1, A + "/x"), (2, A + "/"), (3, "https://docs.acme.com/y")]))
    added = fr.expand_level(level, level, row("site_key string, _after int", ("s", 1)), lists, 0, Options())
    assert [(r.url, r.visit_rank, r.depth, r.referrer) for r in added.orderBy("visit_rank").collect()] == [
        (A + "/x", 2, 1, A + "/"), ("https://docs.acme.com/y", 3, 1, A + "/")]


def test_own_start_is_only_told_from_bare_domains(spark):
    domains = ["acme.com", "www.acme.com", "a@b.com", "Acme.com", "a.com/x", "acme.com:80", "", None]
    rows = spark.createDataFrame([(d,) for d in domains], "d string").select("d", ur.own_start(F.col("d")).alias("o"))
    assert [r.o for r in rows.collect()] == ["https://acme.com/", *[None] * 7]
    internal = rows.where("o is not null").select(ur.is_internal_url(F.concat("o", F.lit("p")), F.col("d")).alias("i"))
    assert all(r.i for r in internal.collect())


def test_rows_meet_denied_urls_as_they_are_written(spark):
    rules = spark.createDataFrame([(A, "disallow", "/no", 0, 1)], "origin string, kind string, value string, block_no int, line_no int")
    urls = [A + "/no", A + "/no", "HTTPS://ACME.com:443/no/x", A + "/yes", "not a url", None, None]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    assert sorted(r.i for r in allowed_urls(rows, rules).collect()) == [3, 4, 5, 6]
    # the rows are not taken apart, only the distinct URLs are
    plan = allowed_urls(rows, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan.split("LeftAnti")[1].split("LogicalRDD")[0]


def test_attribute_values_of_simple_and_odd_tags(spark):
    html = (
        '<a href="/1">x</a><a class="m" HREF="/2" href="/no">x</a><a data-href="/no" href="/3">x</a><a href="/4&amp;b">x</a>'
        "<a href='/5'>x</a><a href=/6>x</a><a href=\"\">x</a><a title=\"href=\" href=\"/7\">x</a><a>x</a><a x/href=\"/8\">x</a>"
        "<a\nrel=\"a\nb\"\n href=\"/9\n\"target=\"z\">x</a><a href = \"/10\">x</a><a href>x</a><a class=a href=\"/11\">x</a>"
    )
    got = spark.createDataFrame([(html,)], "h string").select(ev.attribute_values(F.col("h"), "a", "href").alias("v")).first().v
    assert got == ["/1", "/2", "/3", "/4&b", "/5", "/6", "", "/7", "/8", "/9\n", "/10", "/11"]


def test_the_newest_page_without_a_time_is_the_largest_id(spark):
    """A plain maximum, which needs no sort."""
    pages = spark.createDataFrame([(1, A + "/"), (3, A + "/#x"), (2, A + "/"), (None, A + "/n")], "page_id long, url string")
    newest = newest_pages(pages)
    assert {(r.url, r.page_id) for r in newest.collect()} == {(A + "/", 3), (A + "/n", None)}
    assert "SortAggregate" not in newest._jdf.queryExecution().sparkPlan().toString()


def test_robots_and_sitemap_files_are_read_in_tasks_of_bounded_size(spark, tmp_path):
    spark.range(9000).select(F.col("id").alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for name, files in (("d_robots", 1), ("d_sitemaps", 7)):
        assert derive(spark, str(tmp_path), name).rdd.getNumPartitions() >= files * max(5, spark.sparkContext.defaultParallelism)


def test_pages_are_extracted_once_where_robots_rules_meet_their_addresses(spark, monkeypatch):
    """The rules read the rows twice; the plan around them must not hold the extraction any more."""
    met = []
    join = en.allowed_urls
    monkeypatch.setattr(en, "allowed_urls", lambda rows, rules: met.append(rows) or join(rows, rules))
    pages = spark.createDataFrame([(1, A + "/", "<p>a@acme.com</p>"), (2, A + "/no", "<p>b@acme.com</p>")], "page_id long, url string, html string")
    rules = spark.createDataFrame([(A, "disallow", "/no", 0, 1)], "origin string, kind string, value string, block_no int, line_no int")
    best = en.best_by_domain(pages, spark.createDataFrame([("acme.com",)], "domain string"), rules=rules)
    assert [(r.domain, r.email, r.occurrences) for r in best.collect()] == [("acme.com", "a@acme.com", 1)]
    assert "_batch_offsets" not in met[0]._jdf.queryExecution().optimizedPlan().toString()


def test_what_to_fetch_and_what_was_found_meet_the_queue_by_hash_first(spark):
    """URLs are alike in the eight bytes that a sort compares first; rows without a URL find no capture."""
    queue = spark.createDataFrame(
        [("s", "acme.com", A + "/", 0, "", 1), ("s", "acme.com", A + "/x", 1, A + "/", 2), ("s", "acme.com", None, 1, A + "/", 3)],
        "site_key string, domain string, url string, depth int, referrer string, visit_rank int")
    fact = "page_id long, url string, evidence array<struct<email:string,channel_ord:int,pos:int>>"
    facts = spark.createDataFrame([(1, A + "/", [("a@acme.com", 10, 0)]), (2, None, [("b@acme.com", 10, 0)])], fact)
    missing, found = fr.next_fetch(queue, facts), en.visited_emails(queue, facts)
    assert {(r.url, r.visit_rank) for r in missing.collect()} == {(A + "/x", 2), (None, 3)}
    assert [(r.email, r.visit_rank) for r in found.collect()] == [("a@acme.com", 1)]
    for frame in (missing, found):
        plan = frame._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin [_key_hash" in plan, plan
