"""Column expressions against hand-made values."""

from pyspark.sql import functions as F

from sitecontacts.functions import text as tx, urls as ur
from sitecontacts.options import Options, union_words


def check(values, fn, table):
    assert dict(zip(table, values(fn, list(table)))) == table


def test_normalize_email(values):
    check(values, tx.normalize_email, {
        "mailto:Contact@acme.com?subject=x": "contact@acme.com",
        ' "Info@acme.com". ': "info@acme.com",
        "a%40b.com": "a@b.com",
        "a+b%40c.com": "a+b@c.com",
        "bad%zz@x.com": "bad%zz@x.com",
        "%ff@x.com": "%ff@x.com",
        "mailto:a@x,b@x": "a@x,b@x",
        " a@b.com ": "a@b.com",
        "x@y.com#top": "x@y.com",
        "...dots@y.com.": "dots@y.com",
    })


def test_is_valid_email(values):
    check(values, lambda c: tx.is_valid_email(c, ("privacy", "a.b")), {
        "contact@acme.com": True, "noreply@acme.com": False, "no-reply-x@a.com": False,
        "abuse@a.com": False, "abuse-x@a.com": True, "x@example.com": False,
        "x@mail.example.com": True, "x@o1.sentry.io": False, "x@test.io": False,
        "x@a.local": False, "x@yopmail.fr": False, "my-privacy@a.com": False,
        "privacyx@a.com": True, "a.b@c.com": False, "axb@c.com": True, "x@a.com\n": False,
        "x@@a.com": False, None: False, "a" * 64 + "@b.com": True, "a" * 65 + "@b.com": False,
        "x@a.museumsmuseum": False, "x@" + "a" * 250 + ".com": False, "PRIVACY@a.com": False,
    })


def test_classes_and_scores(values):
    check(values, tx.email_type, {
        "bot@a.com": "automated", "bot-x@a.com": "automated", "bot.x@a.com": "personal",
        "info.x@a.com": "role", "privacy@a.com": "role", "owner@a.com": "personal",
        "alerts-x@a.com": "automated", "infox@a.com": "personal",
    })
    check(values, tx.base_score, {
        "bot@a.com": 0, "contact@a.com": 100, "pr@a.com": 55, "privacy@a.com": 40,
        "owner.x@a.com": 65, "notification-1@a.com": 0, "notifications@a.com": 40,
        "press-x@a.com": 40, "help@a.com": 85,
    })


def test_final_score(spark):
    rows = [
        # confidence, method, source, email, occurrences, expected
        (90, "mailto-link", "mailto", "a@acme.com", 1, 100),
        (85, "about-page", "header", "a@acme.com", 1, 100),
        (50, "contact-page", "text", "a@acme.com", 1, 70),
        (30, "general-page", "script", "a@acme.com", 1, 30),
        (40, "obscure-js", "obfuscated", "a@acme.com", 1, 45),
        (60, "general-page", "text", "a@other.com", 1, 10),
        (60, "general-page", "text", "a@gmail.com", 1, 45),
        (60, "general-page", "text", "a@gmail.com", 2, 49),
        (60, "general-page", "text", "a@docs.acme.com", 9, 80),
    ]
    df = spark.createDataFrame(rows, "c int, m string, s string, e string, n long, want int")
    got = df.select(
        "want", tx.final_score(F.col("c"), F.col("m"), F.col("s"), F.col("e"), F.lit("acme.com"), F.col("n")).alias("got")
    ).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_entities_and_text(values):
    check(values, tx.decode_numeric_entities, {
        "a&#64;b&#x2e;c": "a@b.c", "&#321;": "Ł", "&#65600;": "@", "&#00000000000000000000064;": "@", "&#x0000000000000040;": "@", "&#x10040;": "@", "&#x26;#64;": "@",
        "&#xd800;": "�", "&amp;": "&amp;",
    })
    check(values, tx.spaced_text, {
        "<p>a<script>x@y.com</script>b</p><style>q</style>5 < 6 c&#64;d.com<a href=\"":
            " a b  5 < 6 c@d.com ",
        "a&nbsp;b c": "a&nbsp;b&nbsp;c",
        "a&commat;b&period;c": "a@b.c",
    })


def test_searches(values):
    check(values, tx.find_emails, {
        "a@b.com.x@y.org": ["a@b.com", ".x@y.org"],
        "a@b.com_x@y.org": ["b.com_x@y.org"],
        "a@b.comé z@z.io, foo@bar.museumsmuseum x@y": ["a@b.com", "z@z.io"],
        "." * 5000 + "john@x.com": ["." * 5000 + "john@x.com"],
        "none": None,
    })
    check(values, tx.find_spelled_out, {
        "sales [at] acme [dot] com": ["sales@acme.com"],
        "x AT y DOT org and a(at)b(dot)com": ["x@y.org", "a@b.com"],
        "x   [at]\n y.z (dot)  io": ["x@y.z.io"],
        "meet at dot": [],
    })
    check(values, tx.find_base64, {
        'var a="aW5mb0BhY21lLmNvbQ==";': ["info@acme.com"],
        "aW5mb0BhY21lLmNvbQ x": ["info@acme.com"],
        "short": [],
    })
    protected = "54" + "".join(f"{b ^ 0x54:02x}" for b in b"cf@acme.com")
    check(values, tx.decode_protected, {protected: "cf@acme.com", "54": "", "5": ""})


def test_urls(values):
    check(values, ur.normalize_url, {
        "acme.com": "https://acme.com/",
        "HTTP://WWW.Acme.com:80/a/../b c?x=é#f": "http://www.acme.com/b%20c?x=%C3%A9#f",
        "https://acme.com:443": "https://acme.com/",
        "": "",
        "https://a b.com/x": "https://a b.com/x",
        "https://acme.com/a/./b/..": "https://acme.com/a/",
        "https://acme.com:8080?x": "https://acme.com:8080/?x",
        "https://my_host.acme.com/x|y": "https://my_host.acme.com/x|y",
        "https://acme.com\\x": "https://acme.com/x",
    })
    check(values, ur.normalize_domain, {
        "https://www.acme.com/x": "acme.com", "www.beta.io/path": "beta.io",
        "acme.com:8080": "acme.com:8080", "acme.com?x": "acme.com?x", "HTTP://A.com:80": "a.com",
    })
    check(values, ur.should_avoid_url, {
        "https://a.com/authors": True, "https://a.com/x.PDF?x": True, "https://a.com/x": False,
        "https://a.com/cartoon": True, "ftp://a/x": True, "https://a.com": False,
        "https://a.com/x?u=login": True, "https://a.com/pdf": False, "https://login.com/": False,
    })
    check(values, ur.link_priority, {
        "https://a.com/contact": 2, "https://a.com/legal": 1, "https://a.com/?contact": 0,
        "x": -1, "https://contact.com/": 0,
    })
    check(values, ur.discovery_method, {
        "https://a.com/Contact-us": "contact-page", "https://a.com/about": "about-page",
        "https://a.com/sitemap.html": "sitemap", "x": "general-page",
    })
    check(values, ur.host_suffixes, {"a.b.c": ["a.b.c", "b.c", "c"]})


def test_resolve(values):
    base = ur.base_parts(F.lit("https://acme.com/dir/page?x=1"))
    check(values, lambda c: ur.resolve_url(c, base), {
        "x": "https://acme.com/dir/x", "/root": "https://acme.com/root", "../up": "https://acme.com/up",
        "//other.com/a": "https://other.com/a", "?q=2": "https://acme.com/dir/page?q=2",
        "#f": "https://acme.com/dir/page?x=1", "mailto:x@y.com": None, "javascript:void(0)": None,
        "tel:1": None, "HTTPS://ABC.com": "https://abc.com/", " /sp ace ": "https://acme.com/sp%20ace",
        "/a/../b": "https://acme.com/b", "/x#y": "https://acme.com/x", "": None,
    })


def test_internal(values):
    check(values, lambda c: ur.is_internal_url(c, F.lit("acme.com")), {
        "https://acme.com/": True, "https://www.acme.com/": True, "https://docs.acme.com/x": True,
        "https://notacme.com/": False, "x": False,
    })


def test_option_words():
    assert union_words(["a"], " B, a,,c ") == ["a", "b", "c"]
    assert Options(exclude_words=("x",)).with_excluded(["Y", "x"]).exclude_words == ("x", "y")
