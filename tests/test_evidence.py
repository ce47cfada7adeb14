"""Evidence and links of hand-made pages."""

from pyspark.sql import functions as F

from sitecontacts.functions import text as tx
from sitecontacts.operators import evidence as ev
from sitecontacts.operators import links as lk
from sitecontacts.operators import regions as rg
from sitecontacts.operators.regions import find_regions
from sitecontacts.options import Options

PROTECTED = "54" + "".join(f"{b ^ 0x54:02x}" for b in b"cf@acme.com")

PAGES = [
    ("https://acme.com/",
     '<html><head><meta name=x content="meta@acme.com"></head><body>'
     '<a class="x" href="mailto:Contact@acme.com?subject=x">c</a><!-- <a href="mailto:hidden@acme.com">-->'
     "<footer>contact@acme.com</footer></body></html>"),
    ("https://acme.com/about", "<header>info@acme.com</header><footer>info@acme.com</footer>"),
    ("https://acme.com/contact", "<body>sales [at] acme [dot] com</body>"),
    ("https://acme.com/js", '<script>x="aW5mb0BhY21lLmNvbQ=="; y="s@acme.com"</script>'),
    ("https://acme.com/cf", f'<span DATA-CFEMAIL="{PROTECTED}">x</span>'
     f'<a href="/cdn-cgi/l/email-protection#{PROTECTED}">y</a>'),
    ("https://docs.acme.com/x",
     '<body>a@b.comé noreply@acme.com dev@example.com <div class="page-header"><div>h@acme.com<p>q</div>'
     " h2@acme.com</div> <div id=site-footer><p>f@acme.com</div>t@acme.com"),
    ("https://acme.com/empty", "<body>nothing</body>"),
    ("https://acme.com/null", None),
]


def pages(spark, parts=3):
    rows = [(i, u, h) for i, (u, h) in enumerate(PAGES)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)


EXPECTED = {
    (0, "contact@acme.com", "mailto", 90, "mailto-link"),
    (0, "contact@acme.com", "footer", 85, "general-page"),
    (0, "contact@acme.com", "text", 60, "general-page"),
    (0, "meta@acme.com", "meta", 60, "general-page"),
    (1, "info@acme.com", "header", 85, "about-page"),
    (1, "info@acme.com", "footer", 85, "about-page"),
    (1, "info@acme.com", "text", 60, "about-page"),
    (2, "sales@acme.com", "text", 50, "contact-page"),
    (3, "s@acme.com", "script", 40, "general-page"),
    (3, "info@acme.com", "script", 30, "general-page"),
    (4, "cf@acme.com", "obfuscated", 40, "obscure-js"),
    (5, "a@b.com", "text", 60, "general-page"),
    (5, "h@acme.com", "header", 85, "general-page"),
    (5, "h2@acme.com", "header", 85, "general-page"),
    (5, "f@acme.com", "footer", 85, "general-page"),
    (5, "h@acme.com", "text", 60, "general-page"),
    (5, "h2@acme.com", "text", 60, "general-page"),
    (5, "f@acme.com", "text", 60, "general-page"),
    (5, "t@acme.com", "text", 60, "general-page"),
}


def found(df):
    return {(r.page_id, r.email, r.source_type, r.confidence, r.discovery_method) for r in df.collect()}


def test_all_channels(spark):
    assert found(ev.extract_evidence(pages(spark))) == EXPECTED


def test_partitioning_does_not_matter(spark):
    assert found(ev.extract_evidence(pages(spark, 1))) == found(ev.extract_evidence(pages(spark, 7)))


def test_excluded_words(spark):
    rows = ev.extract_evidence(pages(spark), Options(exclude_words=("info", "sales")))
    assert {r.email for r in rows.collect()}.isdisjoint({"info@acme.com", "sales@acme.com"})


def test_channel_subset(spark):
    got = ev.extract_evidence(pages(spark), channels=["mailto", "meta"])
    assert {r.source_type for r in got.collect()} == {"mailto", "meta"}


def test_dedupe_keeps_best_and_first(spark):
    rows = ev.dedupe_page_emails(ev.extract_evidence(pages(spark))).collect()
    best = {(r.page_id, r.email): r.channel_ord for r in rows}
    assert best[(0, "contact@acme.com")] == 3
    assert best[(1, "info@acme.com")] == 4
    assert len(best) == len(rows)


def test_regions():
    cut = lambda h: [(k, h[a : a + n]) for k, a, n in find_regions(h)]
    assert cut('<div class="header"><header>x</header></div><p class=footer>a<p>b') == [
        ("header", "<header>x</header>"), ("footer", "a")]
    assert cut("<footer><b>a<footer>b</footer></b>c</footer>d") == [
        ("footer", "<b>a<footer>b</footer></b>c")]
    assert cut("<div><footer>x</div>y") == [("footer", "x")]
    assert cut('<ul><li id="footer">a<li>b</ul>') == [("footer", "a")]
    assert cut('<script id="x-header">"e"</script>') == [("header", '"e"')]
    assert cut('<!-- <footer>x</footer> --><div data-class="footer">y</div>') == []
    assert cut('<img class="header"><b><footer>a</b>b</footer>') == [("footer", "a</b>b")]


def test_cut_off_tag_does_not_stall():
    assert find_regions('<footer>a</footer><div ' + 'x="1" ' * 200) == [("footer", 8, 1)]


def test_regions_plain_and_stacked_agree(spark):
    bodies = ["<header>a@x.io</header><p>t</p><footer>b@x.io</footer>",
              "<footer>b@x.io</footer><footer>c@x.io</footer>"]
    plain = [(i, "https://x.io/", h) for i, h in enumerate(bodies)]
    forced = [(i, "https://x.io/", h + '<i class="header"></i>') for i, h in enumerate(bodies)]
    read = lambda rows: {
        (r.page_id, r.email, r.source_type)
        for r in ev.extract_evidence(
            spark.createDataFrame(rows, "page_id long, url string, html string"), channels=["header", "footer"]
        ).collect()
    }
    assert read(plain) == read(forced) != set()


def test_links(spark):
    html = ('<a href="/a">1</a><a href="/contact">2</a><A HREF=\'/a#x\'>3</A><a title="a>b" href="/legal">4</a>'
            '<a href="mailto:x@acme.com">5</a><a href="/authors">6</a><script>"<a href=/no>"</script>'
            '<a data-href="/no" href="/q?a=1&amp;b=2">7</a><!-- <a href="/no"> --><a href="https://other.com/x">8</a>')
    df = spark.createDataFrame([(1, "https://acme.com/d/", html)], "page_id long, url string, html string")
    ranked = lk.rank_page_links(lk.extract_links(df)).orderBy("link_rank").collect()
    assert [(r.url, r.priority) for r in ranked] == [
        ("https://acme.com/contact", 2), ("https://acme.com/legal", 1), ("https://acme.com/a", 0),
        ("https://acme.com/q?a=1&b=2", 0), ("https://other.com/x", 0)]


def test_title(spark):
    df = spark.createDataFrame([("<title> A &amp;\n B</title>",)], "html string")
    assert df.select(ev.page_title(F.col("html"))).first()[0] == "A & B"


def test_nothing_is_cut_or_tested_away(spark):
    many = " ".join(f'data-a{i}="v{i}"' for i in range(5_000))
    rows = [
        f'<a {many} href="mailto:many@acme.com">x</a>',
        '<a href="mailto&colon;colon@acme.com">x</a>',
        f'<a href="/cdn-cgi/l/email-protection&num;{PROTECTED}">y</a>',
        "<body>info [&#97;t] acme [d&#111;t] com</body>",
        "<script>var a = 'script [at] acme [dot] com'</script>",
        "<body>long&#0000000000000000000000064;acme.com</body>",
        '<a title="href=mailto:no@acme.com" href=mailto:plain@acme.com>z</a>',
    ]
    frame = spark.createDataFrame([(i, A_PAGE, h) for i, h in enumerate(rows)], "page_id long, url string, html string")
    got = {(r.page_id, r.email) for r in ev.extract_evidence(frame).collect()}
    assert got == {(0, "many@acme.com"), (1, "colon@acme.com"), (2, "cf@acme.com"), (3, "info@acme.com"),
                   (4, "script@acme.com"), (5, "long@acme.com"), (6, "plain@acme.com")}


A_PAGE = "https://acme.com/page"


def test_cuts_equal_the_plain_patterns(spark):
    """Runs taken as a whole cut what the lazy patterns cut, with missing ends, odd cases and nested marks."""
    import random
    import re

    from pyspark.sql import functions as F

    pieces = [
        "<!--", "-->", "--", "-", ">", "<", "</", "<script>", "<SCRIPT a=1>", "</script>", "</Script >", "</scriptx>", "<style>", "</style>",
        "<sty", "<title>", "</title>", "<iframe/>", "<body>", "<BODY class=x>", "</head>", "<header>", "</header>", "<footer id=f>", "</FOOTER>",
        "a@b.com", " ", "x", "<p>", "&amp;", "\n", "<nav class='header'>", "<textarea ", "</textarea>",
    ]
    pick = random.Random(3)
    pages = ["".join(pick.choices(pieces, k=pick.randrange(1, 14))) for _ in range(1500)] + [""]
    raw = "style|noscript|iframe|xmp|noembed|noframes|textarea|title"
    space = r"[\s/>]"
    no_markup = re.compile(rf"<(?:!--.*?(?:-->|\Z)|((?i:script|{raw}))(?={space}).*?(?:</(?i:\1)(?={space})|\Z))", re.S | re.A)
    body = re.compile(
        rf"<(?:!--.*?(?:-->|\Z)|((?i:{raw}))(?={space}).*?(?:</(?i:\1)(?={space})|\Z)"
        rf"|(?i:script)(?={space})[^>]*>(.*?)(?:</(?i:script)(?={space})|\Z))", re.S | re.A)
    no_scripts = re.compile(r"<((?i:script|style))\b.*?(?:</(?i:\1)\s*>|\Z)", re.S | re.A)
    start = re.compile(r"<(?:/(?i:head)\s*>|(?i:body)\b[^>]*>)", re.A)
    title = re.compile(r"<title\b.*?(?:</title\s*>|\Z)", re.I | re.S | re.A)
    tags = re.compile(r"<[A-Za-z/!?][^>]*(?:>|\Z)")

    def expected(page):
        parts = start.split(no_scripts.sub(" ", page), maxsplit=1)
        text = parts[1] if len(parts) == 2 else title.sub(" ", parts[0])
        regions = [" ".join(re.findall(rf"(?s)<(?i:{k})\b[^>]*>(.*?)</(?i:{k})\b", page)) for k in ("header", "footer")]
        scripts = "\x01".join(m[2] for m in body.finditer(page) if m[2])
        return (no_markup.sub(" ", page), scripts, tags.sub(" ", text), *regions)

    html = F.col("html")
    got = spark.createDataFrame(list(enumerate(pages)), "i int, html string").select(
        "i", ev.markup_of(html), ev.script_text(html), ev.body_text(html),
        F.coalesce(rg.plain_region(html, "header"), F.lit("")), F.coalesce(rg.plain_region(html, "footer"), F.lit("")),
    ).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {i: expected(p) for i, p in enumerate(pages)}


def test_rows_pass_the_region_function_without_the_page(spark):
    """Only pages that need the open-element stack carry their text past it, and no step repeats another's work."""
    plan = ev.with_evidence(pages(spark).select("page_id", "html")).drop("html")._jdf.queryExecution().executedPlan().toString()
    line = next(x for x in plan.splitlines() if "ArrowEvalPython" in x)
    after = plan[plan.index(line) + len(line):].splitlines()
    below = next(x for x in after if "Project" in x)
    assert not any(f" {name}#" in below.split("Project [")[1].split(" AS ")[0] for name in ("html", "_markup", "_body"))


def test_addresses_after_a_colon_an_equals_sign_or_a_bracket(spark):
    text = "Email:info@acme.com x=jane@acme.com;bob@acme.com,(eva@acme.com) >kim@acme.com @ x@y@acme.com- end"
    got = spark.createDataFrame([(text,)], "t string").select(tx.find_emails(F.col("t")).alias("e")).first().e
    assert got == ["info@acme.com", "jane@acme.com", "bob@acme.com", "eva@acme.com", "kim@acme.com", "y@acme.com"]


def test_plain_links_are_left_out_before_the_channels_are_read(spark):
    links = "".join(f'<a class="n" href="https://acme.com/p/{i}">page {i}</a> ' for i in range(5000))
    cases = {
        "nav": (f"<nav>{links}</nav><p>a@acme.com</p>", "<nav><br></nav><p>a@acme.com</p>"),
        "mark": ('<a href="mailto:a@acme.com">m</a><a href="/x">@</a><a href="/&#64;">r</a>', None),
        "inner": ('<a href="/x"><b>a@acme.com</b></a><a data-cfemail="00">h</a>', None),
        "value": ('<p>a@acme.com</p><i title="<a href="/x">y</a>" class="footer">z</i>', None),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "k string, html string")
    got = dict(df.select("k", ev.without_bare_links(F.col("html"))).collect())
    assert got == {k: short or page for k, (page, short) in cases.items()}


def test_evidence_is_the_same_with_and_without_plain_links(spark, monkeypatch):
    link = '<a href="/x" class="footer">y</a><a href="#top">t</a> <a href="https://acme.com/b">b</a>'
    bodies = [
        f"<!-- {link} a@acme.com --> b@acme.com", f'<div class="footer">{link}<p>a@acme.com</div>{link}c@acme.com',
        f"<header>a@acme.com{link}</header>{link}<footer>{link}<a href='mailto:d@acme.com'>m</a>{link}b@acme.com</footer>",
        f'<script>var x = \'{link}\'; var k = "YUBhY21lLmNvbQ=="; var m="s@acme.com"</script>{link}',
        f'<a href="/x">jane at</a>{link} acme dot com', f'{link}<span data-cfemail="54353435373931">x</span>&#64; a@acme.com',
        f'<a id="header" href="/o">{link}a@acme.com</a><p>{link}<p>b@acme.com{link}', f"<textarea>{link}</textarea>a&#64;acme.com",
    ]
    pages = spark.createDataFrame(
        [(i, "https://acme.com/", f"<html><head><title>{link}</title></head><body>{b}</body></html>") for i, b in enumerate(bodies)],
        "page_id long, url string, html string",
    )

    def rows():
        return sorted(map(tuple, ev.extract_evidence(pages).collect()))

    short = rows()
    monkeypatch.setattr(ev, "_extraction_stages", ev._extraction_stages.__wrapped__)
    monkeypatch.setattr(ev, "without_bare_links", lambda html: html)
    assert short == rows() and len(short) > 8
