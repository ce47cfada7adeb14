"""Streams give what batches give, also when a step is run again."""

from pyspark.sql import functions as F

from sitecontacts.operators import evidence as ev
from sitecontacts.plans import enrich as en
from sitecontacts.sources import leads as ld
from sitecontacts.streaming import stream as st

SITE = "https://s{}.io/"

PAGES_SCHEMA = "page_id bigint, url string, html string"


def page_rows(n):
    return [(i, SITE.format(i % 4) + ("contact" if i % 3 == 0 else f"p{i}"), f"<p>info@s{i % 4}.io x{i}@gmail.com</p>")
            for i in range(n)]


def write_files(spark, folder, rows, count=3):
    for k in range(count):
        spark.createDataFrame(rows[k::count], PAGES_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def as_set(df, columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_streamed_evidence_and_running_best(spark, tmp_path):
    folder, rows = str(tmp_path / "in"), page_rows(24)
    write_files(spark, folder, rows[:12])
    run = lambda: (
        st.stream_evidence(st.read_page_stream(spark, folder), str(tmp_path / "ev"), str(tmp_path / "c1")).awaitTermination(),
        st.stream_running_best(st.read_page_stream(spark, folder), str(tmp_path / "parts"), str(tmp_path / "c2")).awaitTermination(),
    )
    run()
    write_files(spark, folder, rows[12:])
    run()
    pages = spark.createDataFrame(rows, PAGES_SCHEMA)
    columns = ["page_id", "email", "source_type", "confidence"]
    assert as_set(spark.read.parquet(str(tmp_path / "ev")), columns) == as_set(ev.extract_evidence(pages), columns)
    domains = spark.createDataFrame([(f"s{i}.io",) for i in range(4)], "domain string")
    columns = ["domain", "email", "email_source", "confidence_score", "occurrences"]
    batch = en.best_by_domain(pages, domains)
    assert as_set(st.running_best(spark, str(tmp_path / "parts")), columns) == as_set(batch, columns)


def test_resumed_steps_write_each_lead_once(spark, tmp_path):
    leads = spark.createDataFrame(
        [(i, f"s{i % 5}.io" if i != 3 else "") for i in range(8)], "row_index long, Website string")
    pages = spark.createDataFrame(page_rows(12), PAGES_SCHEMA)
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    st.enrich_remaining(leads.where("row_index < 4"), pages, out, progress, "first")
    st.enrich_remaining(leads.where("row_index < 4"), pages, out, progress, "first")
    st.enrich_remaining(leads, pages, out, progress, "second")
    done = st.done_rows(spark, progress)
    assert sorted(r.row_index for r in done.collect()) == list(range(8))
    assert {r.website for r in done.where("row_index = 3").collect()} == {"skipped-missing-url"}
    written = spark.read.option("header", True).csv(out)
    assert written.count() == 7


def test_streamed_enrichment(spark, tmp_path):
    folder = str(tmp_path / "leads")
    schema = "row_index long, Website string"
    pages = spark.createDataFrame(page_rows(12), PAGES_SCHEMA)

    def run():
        stream = spark.readStream.schema(schema).parquet(folder)
        st.stream_enrichment(stream, pages, ["Website"], str(tmp_path / "out"), str(tmp_path / "progress"),
                             str(tmp_path / "state")).awaitTermination()

    for part in ([(0, "s0.io"), (1, "s1.io")], [(1, "s1.io"), (2, "none.io")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(folder)
        run()
    rows = {r.Website: r.email for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()}
    assert rows == {"s0.io": "info@s0.io", "s1.io": "info@s1.io", "none.io": None}
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3


def test_newer_captures_take_back_what_older_ones_added(spark, tmp_path):
    """Four batches with recaptures: any compaction gives what one batch over the newest captures gives."""
    old = [(i - 100, u, "<p>gone@old.org info@s1.io</p>") for i, u, _ in page_rows(12)]
    rows = page_rows(12)
    batches = [old[:8], rows[:6], old[8:] + rows[6:9], rows[9:]]
    columns = ["domain", "email", "email_source", "confidence_score", "occurrences"]
    domains = spark.createDataFrame([(f"s{i}.io",) for i in range(4)], "domain string")
    want = as_set(en.best_by_domain(spark.createDataFrame(rows, PAGES_SCHEMA), domains), columns)
    for every in (1, 3, 10):
        folder, state = str(tmp_path / f"in{every}"), str(tmp_path / f"state{every}")
        for batch in batches:
            spark.createDataFrame(batch, PAGES_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
            st.stream_running_best(st.read_page_stream(spark, folder), state, str(tmp_path / f"log{every}"), compact_every=every).awaitTermination()
        assert as_set(st.running_best(spark, state), columns) == want
        base, deltas = st._parts(spark, state)
        assert (base, deltas) == {1: (3, []), 3: (2, [3]), 10: (None, [0, 1, 2, 3])}[every]


def test_steps_from_counted_candidates(spark, tmp_path):
    """Two steps give what one run gives, and no page is there to be read."""
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    write_files(spark, folder, page_rows(12))
    st.stream_running_best(st.read_page_stream(spark, folder), state, str(tmp_path / "log"), compact_every=1).awaitTermination()
    leads = spark.createDataFrame([(i, f"s{i % 5}.io") for i in range(8)], "row_index long, Website string")
    want = as_set(en.enrich_captured(leads, spark.createDataFrame(page_rows(12), PAGES_SCHEMA)), ["Website", "email", "confidence_score"])
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    for step, most in (("first", 4), ("first", 4), ("second", 8)):
        st.enrich_remaining(leads.where(f"row_index < {most}"), None, out, progress, step, state=state)
    rows = spark.read.option("header", True).csv(out).na.fill("")
    assert rows.count() == 8 and as_set(rows, ["Website", "email", "confidence_score"]) == want


def test_robots_rules_in_a_stream(spark, tmp_path):
    folder, rows = str(tmp_path / "in"), page_rows(12)
    write_files(spark, folder, rows)
    rules = spark.createDataFrame([("https://s1.io", "disallow", "/p"), ("https://s2.io", "disallow", "/contact"), ("https://s3.io", "disallow", "/")],
                                  "origin string, kind string, value string").selectExpr("*", "0 as block_no", "1 as line_no")
    st.stream_evidence(st.read_page_stream(spark, folder), str(tmp_path / "ev"), str(tmp_path / "log"), rules=rules).awaitTermination()
    denied = lambda u: u.startswith("https://s1.io/p") or u == "https://s2.io/contact" or u.startswith("https://s3.io/")
    assert {r.page_id for r in spark.read.parquet(str(tmp_path / "ev")).collect()} == {i for i, u, _ in rows if not denied(u)}


def test_robots_meet_evidence_not_page_text(spark, tmp_path, monkeypatch):
    """A join of the pages themselves would shuffle their text where rules are many."""
    from sitecontacts.streaming import stream

    spark.createDataFrame([(1, "https://a.io/x", "<p>a@a.io</p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/in")
    rules = spark.createDataFrame([("https://a.io", "disallow", "/x", 0, 1)], "origin string, kind string, value string, block_no int, line_no int")
    met = []
    join = stream.allowed_urls
    monkeypatch.setattr(stream, "allowed_urls", lambda rows, rules: met.append(rows.columns) or join(rows, rules))
    pages = stream.read_page_stream(spark, f"{tmp_path}/in", "*.parquet")
    stream.stream_evidence(pages, f"{tmp_path}/out", f"{tmp_path}/log", rules=rules).awaitTermination()
    assert met and "html" not in met[0]
    assert spark.read.schema("page_id long").parquet(f"{tmp_path}/out").count() == 0
