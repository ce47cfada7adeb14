"""Inputs derived from the given tables, in SQL that Spark and DuckDB both run.

The given pages hold few addresses and no links to captured pages, so addresses,
sites, pages, robots files and sitemaps are written out from customer, supplier and
orders keys. Every derivation reads the whole table and grows with it.
"""

from __future__ import annotations

# The few spots where the two SQL dialects differ.
DIALECTS = {
    "spark": {
        "series": "LATERAL explode(sequence(1, {last})) AS t(rn)",
        "base64": "base64(cast({x} AS binary))",
        "xor_hex": (
            "lower(array_join(transform(split({x}, ''), c -> lpad(hex(ascii(c) ^ 84), 2, '0')), ''))"
        ),
    },
    "duckdb": {
        "series": "unnest(range(1, {last} + 1)) AS t(rn)",
        "base64": "base64(encode({x}))",
        "xor_hex": (
            "array_to_string(list_transform(string_split({x}, ''),"
            " lambda c: printf('%02x', xor(ascii(c), 84))), '')"
        ),
    },
}


def _pick(key: str, values: list[str]) -> str:
    """CASE that picks the k-th value."""
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"(CASE {key} {whens} END)"


def _text(values: list[str]) -> list[str]:
    return [f"'{v}'" for v in values]


def _tens(x: str, by: int) -> str:
    return f"CAST(floor({x} / {by}) AS BIGINT)"


def d_email(dialect: str) -> str:
    """Raw addresses in the shapes pages show them: (c_custkey, raw)."""
    local = _pick("c_custkey % 10", _text(
        ["contact", "info", "hello", "noreply", "alerts-x", "privacy", "owner", "jane.doe",
         "press.team", "security-x"]))
    domain = _pick(f"{_tens('c_custkey', 10)} % 10", _text(
        ["acme.com", "www.acme.com", "docs.acme.com", "gmail.com", "example.com", "test.io",
         "test.acme.com", "cdn.net", "x.local", "yopmail.fr"]))
    raw = _pick(f"{_tens('c_custkey', 100)} % 4", [
        "'mailto:' || addr || '?subject=Order'", "'\"' || addr || '\". '", "upper(addr)",
        "replace(addr, '@', '%40')"])
    return (
        f"SELECT c_custkey, {raw} AS raw FROM"
        f" (SELECT c_custkey, {local} || '@' || {domain} AS addr FROM {{customer}}) a"
    )


def d_url(dialect: str) -> str:
    """URLs as people write them: (o_orderkey, raw)."""
    host = _pick("o_orderkey % 6", [
        "'https://acme.com'", "'HTTP://WWW.Acme.COM:80'", "'https://docs.acme.com:443'", "'acme.com'",
        "'https://other.org:8080'", "'http://' || 'client' || o_custkey || '.acme.com'"])
    path = _pick(f"{_tens('o_orderkey', 6)} % 11", _text(
        ["/contact", "/about/us", "/team", "/privacy", "/login", "/authors/x", "/files/x.pdf", "",
         "/a b/über", "/a/./b/../c", "/Sitemap"]))
    query = _pick(f"{_tens('o_orderkey', 66)} % 3", _text(["", "?q=contact", "?a=1&b=2#top"]))
    return f"SELECT o_orderkey, {host} || {path} || {query} AS raw FROM {{orders}}"


def d_leads(dialect: str) -> str:
    """Leads, all text: (row_index, Name, Segment, Website, url_hint)."""
    site = "'client' || c_custkey || '.acme.com'"
    website = _pick("c_nationkey % 6", [
        f"'https://' || {site}", site, f"'www.' || {site} || '/'", "''", "'  '", f"'http://' || {site} || '/start'"])
    hint = _pick("c_nationkey % 4", ["''", f"'https://' || {site}", "''", "''"])
    return (
        "SELECT c_custkey AS row_index, CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE c_name END AS Name,"
        f" c_mktsegment AS Segment, {website} AS Website, {hint} AS url_hint FROM {{customer}}"
    )


# --- derived sites: every customer has one with 4 to 26 pages ---------------

_WORDS = ["contact", "about", "team", "privacy", "blog", "services", "item"]


def page_url(rn: str) -> str:
    host = f"'https://' || (CASE WHEN {rn} % 6 = 5 THEN 'docs.' ELSE '' END) || 'client' || c_custkey || '.acme.com'"
    path = (
        f"(CASE WHEN {rn} = 1 THEN '/' ELSE '/' || {_pick(f'({rn}) % 7', _text(_WORDS))} || '/' || ({rn}) END)"
    )
    return f"({host} || {path})"


def d_pages(dialect: str) -> str:
    """Captured pages of the derived sites: (page_id, url, html, site, rn, status)."""
    sql = DIALECTS[dialect]
    local = _pick("(c_custkey * 3 + rn) % 12", _text(
        ["contact", "info", "hello", "sales", "support", "jane.doe", "noreply", "press.team", "bot-1",
         "owner", "privacy", "admin"]))
    domain = _pick("(c_custkey + rn) % 7", [
        "site", "site", "site", "site", "'mail.' || site", "'gmail.com'", "'cdn.net'"])
    channel = _pick("(c_custkey * 5 + rn) % 11", [
        "'<a class=\"m\" href=\"mailto:' || addr || '?subject=Order\">mail</a>'",
        "'<header id=\"top\"><p>' || addr || '</p></header>'",
        "'<div class=\"site-footer\"><span>' || addr || '</span></div>'",
        "'<meta name=\"author\" content=\"' || addr || '\">'",
        "'<script>var m = \"' || addr || '\";</script>'",
        "'<p>' || local || ' [at] ' || replace(domain, '.com', ' [dot] com') || '</p>'",
        "'<script>var k = \"' || " + sql["base64"].format(x="addr") + " || '\";</script>'",
        "'<span data-cfemail=\"54' || " + sql["xor_hex"].format(x="addr") + " || '\">hidden</span>'",
        "'<a href=\"/cdn-cgi/l/email-protection#54' || " + sql["xor_hex"].format(x="addr") + " || '\">hidden</a>'",
        "'<p>Write to ' || addr || ' today.</p>'",
        "'<p>' || local || '&#64;' || domain || '</p>'",
    ])
    links = " || ".join(
        f"'<a href=\"' || {page_url(f'(rn * 4 + {d})')} || '\">more</a>'" for d in (-2, -1, 0, 1)
    )
    return f"""
SELECT c_custkey * 100 + rn AS page_id, {page_url('rn')} AS url, site, rn,
  CASE WHEN (c_custkey + rn) % 13 = 0 THEN 503 WHEN rn % 9 = 0 THEN 404 ELSE 200 END AS status,
  '<!DOCTYPE html><html><head><title>Page ' || rn || ' of ' || site || '</title></head><body><nav>'
  || '<a href="/">home</a><a href="/login">in</a><a href="/files/a.pdf">file</a>'
  || '<a href="https://partner.example.org/contact">partner</a><a href="#top">top</a>'
  || CASE WHEN rn % 3 = 0 THEN '<a href="?page=2">next</a>' ELSE '' END
  || {links}
  || '</nav><!-- <a href="mailto:old@' || site || '">x</a> -->'
  || CASE WHEN c_custkey % 10 = 9 THEN '<p>No address here.</p>' ELSE {channel} END
  || CASE WHEN c_custkey % 2 = 0 THEN '<footer>office@' || site || '</footer>' ELSE '<footer>none</footer>' END
  || '</body></html>' AS html
FROM (
  SELECT c_custkey, rn, site, local, domain, local || '@' || domain AS addr FROM (
    SELECT c_custkey, rn, site, {local} AS local, {domain} AS domain FROM (
      SELECT c_custkey, rn, 'client' || c_custkey || '.acme.com' AS site
      FROM {{customer}}, {sql['series'].format(last='4 + c_custkey % 23')}
    ) p0
  ) p1
) p2"""


def d_sites(dialect: str) -> str:
    """One crawl per derived site: (site_key, domain, start_url)."""
    site = "'client' || c_custkey || '.acme.com'"
    return (
        f"SELECT {site} AS site_key, {site} AS domain, 'https://' || {site} || '/' AS start_url FROM {{customer}}"
    )


def d_robots(dialect: str) -> str:
    """Robots files of the derived sites: (origin, body)."""
    site = "'https://client' || c_custkey || '.acme.com'"
    body = _pick("c_custkey % 4", [
        "'User-agent: *\nDisallow: /blog\nDisallow: /privacy\n'",
        f"'# note\n\nUser-Agent: otherbot\nDisallow: /\n\nuser-agent: *\nDisallow:\nAllow: /\nSitemap: ' || {site} || '/maps.xml\n'",
        "'Disallow: /team\nUser-agent: sitecontacts\nDisallow: /item/ \nUser-agent: otherbot\nDisallow: /contact\nSitemap: /maps.xml\nCrawl-delay: 5'",
        "'User-agent: *\r\nDisallow: /login # not for bots\r\n'",
    ])
    return f"SELECT {site} AS origin, {body} AS body FROM {{customer}}"


def d_sitemaps(dialect: str) -> str:
    """Sitemap files of the derived sites, half of them behind an index, some by indexes that list each other: (sitemap_url, xml)."""
    base = "'https://client' || c_custkey || '.acme.com'"
    url = lambda rn: f"'<url><loc> ' || {page_url(rn)} || ' </loc><priority>1</priority></url>'"
    plain = (
        "'<urlset>' || " + " || ".join(url(str(n)) for n in (2, 9, 14, 7, 3, 8))
        + " || '<url><loc></loc></url></urlset>'"
    )
    index = (
        f"'<sitemapindex><sitemap><loc>' || {base} || '/part-1.xml</loc></sitemap><sitemap><loc>' || {base}"
        f" || '/sitemap.xml</loc></sitemap></sitemapindex>'"
    )
    listed = lambda *names: (
        "'<sitemapindex>'" + "".join(f" || '<sitemap><loc>' || {base} || '/{n}.xml</loc></sitemap>'" for n in names) + " || '</sitemapindex>'"
    )
    return f"""
SELECT {base} || '/part-1.xml' AS sitemap_url, {plain} AS xml FROM {{customer}} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
UNION ALL
SELECT {base} || '/sitemap.xml', CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN {index} ELSE {plain} END FROM {{customer}}
UNION ALL
SELECT {base} || '/maps.xml', CASE WHEN c_custkey % 5 = 0 THEN {listed('maps', 'part-2', 'part-3')} ELSE {plain} END FROM {{customer}}
UNION ALL
SELECT {base} || '/part-2.xml', {listed('maps', 'part-3', 'part-4')} FROM {{customer}} WHERE c_custkey % 5 = 0
UNION ALL
SELECT {base} || '/part-3.xml', {listed('part-2', 'part-5', 'part-4', 'maps')} FROM {{customer}} WHERE c_custkey % 5 = 0
UNION ALL
SELECT {base} || '/part-4.xml', {plain} FROM {{customer}} WHERE c_custkey % 5 = 0
UNION ALL
SELECT {base} || '/part-5.xml', '<urlset>' || {url('5')} || '</urlset>' FROM {{customer}} WHERE c_custkey % 5 = 0"""


def d_dns(dialect: str) -> str:
    """Which derived domains accept mail: (domain, has_mx, disposable)."""
    return (
        "SELECT 'client' || c_custkey || '.acme.com' AS domain, c_acctbal > 0 AS has_mx,"
        " c_mktsegment = 'AUTOMOBILE' AS disposable FROM {customer}"
    )


def d_status(dialect: str) -> str:
    """Fetch outcomes: (page_id, status)."""
    status = _pick("o_orderkey % 5", ["CAST(NULL AS INT)", "200", "404", "429", "503"])
    return f"SELECT o_orderkey AS page_id, {status} AS status FROM {{orders}}"


DERIVED = {
    "d_email": (d_email, "customer"), "d_url": (d_url, "orders"), "d_leads": (d_leads, "customer"),
    "d_pages": (d_pages, "customer"), "d_sites": (d_sites, "customer"),
    "d_robots": (d_robots, "customer"), "d_sitemaps": (d_sitemaps, "customer"),
    "d_dns": (d_dns, "customer"), "d_status": (d_status, "orders"),
}


#: Sites whose pages one task writes out, about 30,000 pages.
_SITES_PER_TASK = 2000

#: Columns read by the inputs whose rows hold text that is long to write out or to read.
_SPREAD = {"d_pages": ["c_custkey"], "d_robots": ["c_custkey"], "d_sitemaps": ["c_custkey", "c_mktsegment"]}


def derive(spark, sf_dir: str, name: str):
    """A derived input as a Spark DataFrame."""
    build, table = DERIVED[name]
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if name in _SPREAD:
        # keys are spread before each becomes many pages or files, so the text is never moved; a task's share stays the same as tables grow
        tasks = max(spark.sparkContext.defaultParallelism, -(-source.count() // _SITES_PER_TASK))
        source = source.select(*_SPREAD[name]).repartition(tasks)
    return spark.sql(build("spark"), **{table: source})


def derive_sql(name: str) -> str:
    """The same derivation as DuckDB SQL over the given views."""
    build, table = DERIVED[name]
    return build("duckdb").replace(f"{{{table}}}", table)
