"""DuckDB SQL for every registered query, written independently of the Spark side."""

from __future__ import annotations

from sitecontacts import options as opt
from sitecontacts.plans import derived as dv

EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,10}\b"
SPELLED = (
    r"([a-zA-Z0-9._%+-]+)\s*(?:\[at\]|\(at\)|\s+at\s+)\s*([a-zA-Z0-9.-]+)"
    r"\s*(?:\[dot\]|\(dot\)|\s+dot\s+)\s*([a-zA-Z]{2,10})\b"
)


def q(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


# --- scalar rules -----------------------------------------------------------

def norm_email(x: str) -> str:
    cut = f"split_part(split_part(regexp_replace(lower(trim({x})), '^mailto:', ''), '?', 1), '#', 1)"
    return f"regexp_replace(url_decode({cut}), '^[''\".\\s]+|[''\".\\s]+$', '', 'g')"


def local(x: str) -> str:
    return f"lower(split_part({x}, '@', 1))"


def dom(x: str) -> str:
    return f"lower(split_part({x}, '@', 2))"


def valid(x: str, words=()) -> str:
    checks = [
        f"length({x}) <= 254",
        f"regexp_full_match({x}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,10}}')",
        f"length({local(x)}) <= 64",
        f"{local(x)} NOT IN {q(opt.REJECTED_LOCALS)}",
        f"{dom(x)} NOT IN {q(opt.REJECTED_DOMAINS)}",
        f"NOT contains({dom(x)}, 'sentry.io')",
        *[f"NOT starts_with({local(x)}, '{w}')" for w in opt.REJECTED_LOCAL_STARTS],
        *[f"NOT contains({dom(x)}, '{w}')" for w in ("tempmail", "mailinator", "yopmail")],
        f"NOT starts_with({dom(x)}, 'test.')",
        f"split_part({dom(x)}, '.', -1) NOT IN ('local', 'temp', 'example')",
    ]
    for w in words:
        checks.append(f"NOT regexp_matches({local(x)}, '(^|[-._+]){w}($|[-._+])')")
    return "(" + " AND ".join(checks) + ")"


def starts(x: str, words, mark: str) -> str:
    tests = [f"{local(x)} = '{w}' OR starts_with({local(x)}, '{w}{mark}')" for w in words]
    return "(" + " OR ".join(tests) + ")"


def email_type(x: str) -> str:
    return (
        f"CASE WHEN {starts(x, opt.AUTOMATED_WORDS, '-')} THEN 'automated'"
        f" WHEN {starts(x, opt.ROLE_WORDS, '.')} THEN 'role' ELSE 'personal' END"
    )


def base_score(x: str) -> str:
    whens = " ".join(f"WHEN {starts(x, words, '.')} THEN {score}" for words, score in opt.BASE_SCORES)
    return f"CAST(CASE {whens} WHEN {starts(x, opt.BASE_AUTOMATED_WORDS, '-')} THEN 0 ELSE 40 END AS INT)"


def norm_domain(x: str) -> str:
    s = f"lower(trim({x}))"
    host = f"CASE WHEN regexp_matches({s}, '^https?://') THEN regexp_extract({s}, '^https?://([^/?#:]*)', 1) ELSE {s} END"
    return f"split_part(regexp_replace({host}, '^www\\.', ''), '/', 1)"


def domain_match(x: str, target: str) -> str:
    d = f"regexp_replace({dom(x)}, '^www\\.', '')"
    return f"({d} = {target} OR ends_with({d}, '.' || {target}))"


def path(u: str) -> str:
    return f"lower(regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1))"


def page_method(u: str) -> str:
    p = path(u)
    return (
        f"CASE WHEN contains({p}, 'contact') THEN 'contact-page' WHEN contains({p}, 'about') THEN 'about-page'"
        f" WHEN contains({p}, 'sitemap') THEN 'sitemap' ELSE 'general-page' END"
    )


def priority(u: str) -> str:
    p = path(u)
    has = lambda words: " OR ".join(f"contains({p}, '{w}')" for w in words)
    return (
        f"CAST(CASE WHEN {has(opt.HIGH_PRIORITY_WORDS)} THEN 2 WHEN {has(opt.MEDIUM_PRIORITY_WORDS)} THEN 1"
        " ELSE 0 END AS INT)"
    )


def avoided(u: str) -> str:
    rest = f"lower(regexp_extract({u}, '^https?://[^/?#]*(.*)$', 1))"
    words = " OR ".join(f"contains({rest}, '{w}')" for w in opt.AVOIDED_WORDS)
    ext = f"split_part(split_part(split_part({rest}, '?', 1), '#', 1), '.', -1)"
    return f"(NOT regexp_matches({u}, '^https?://') OR {ext} IN {q(opt.AVOIDED_EXTENSIONS)} OR {words})"


# Source type, method and confidence by channel, as in the page rules.
SOURCE = (
    "CASE WHEN ord <= 2 THEN 'obfuscated' WHEN ord = 3 THEN 'mailto' WHEN ord = 4 THEN 'header'"
    " WHEN ord = 5 THEN 'footer' WHEN ord = 6 THEN 'meta' WHEN ord <= 9 THEN 'script' ELSE 'text' END"
)
OBF = (
    "CASE WHEN ord <= 2 THEN 'cloudflare' WHEN ord IN (8, 11) THEN 'text-obfuscation'"
    " WHEN ord = 9 THEN 'base64' END"
)
CONF = (
    "CAST(CASE WHEN ord IN (4, 5) THEN 85 WHEN ord = 3 THEN 90 WHEN ord <= 2 THEN 50 - 10 WHEN ord = 7 THEN 40"
    " WHEN ord IN (8, 9) THEN 40 - 10 WHEN ord = 11 THEN 60 - 10 ELSE 60 END AS INT)"
)


def method(u: str) -> str:
    return f"CASE WHEN ord <= 2 THEN 'obscure-js' WHEN ord = 3 THEN 'mailto-link' ELSE {page_method(u)} END"


# --- evidence ---------------------------------------------------------------

def _body(html: str) -> str:
    bare = f"regexp_replace({html}, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g')"
    body = f"regexp_extract({bare}, '(?is)(?:</head\\s*>|<body\\b[^>]*>)(.*)$', 1)"
    return f"replace(regexp_replace({body}, '<[A-Za-z/!?][^>]*(?:>|$)', ' ', 'g'), '&#64;', '@')"


def _unhex(h: str) -> str:
    return (
        f"array_to_string(list_transform(range(3, length({h}), 2), lambda i:"
        f" chr(xor(('0x' || substr({h}, i, 2))::INT, ('0x' || substr({h}, 1, 2))::INT))), '')"
    )


def _spelled(text: str) -> str:
    return (
        f"list_transform(list_zip(regexp_extract_all({text}, '(?i){SPELLED}', 1),"
        f" regexp_extract_all({text}, '(?i){SPELLED}', 2), regexp_extract_all({text}, '(?i){SPELLED}', 3)),"
        " lambda z: z[1] || '@' || z[2] || '.' || z[3])"
    )


def evidence_ctes(source: str, words=()) -> str:
    """CTEs from `source`(page_id, url, html) to evidence(page_id, url, ord, pos, email)."""
    no_comment = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    strip = lambda x: f"regexp_replace({x}, '<[A-Za-z/!?][^>]*>', ' ', 'g')"
    channels = [
        (1, f"list_transform(regexp_extract_all({no_comment}, 'data-cfemail=\"([0-9a-f]+)\"', 1), lambda h: {_unhex('h')})"),
        (2, f"list_transform(regexp_extract_all({no_comment}, 'href=\"/cdn-cgi/l/email-protection#([0-9a-f]+)\"', 1), lambda h: {_unhex('h')})"),
        (3, f"regexp_extract_all({no_comment}, '<a [^>]*href=\"(mailto:[^\"]*)\"', 1)"),
        (4, f"regexp_extract_all({strip('array_to_string(regexp_extract_all(html, $$(?is)<header\\b[^>]*>(.*?)</header>$$, 1), $$ $$)')}, '{EMAIL}')"),
        (5, f"regexp_extract_all({strip('array_to_string(list_concat(regexp_extract_all(html, $$(?is)<div class=.site-footer.>(.*?)</div>$$, 1), regexp_extract_all(html, $$(?is)<footer\\b[^>]*>(.*?)</footer>$$, 1)), $$ $$)')}, '{EMAIL}')"),
        (6, f"regexp_extract_all(array_to_string(regexp_extract_all(html, '(?i)<meta [^>]*content=\"([^\"]*)\"', 1), ' | '), '{EMAIL}')"),
        (7, "regexp_extract_all(scripts, '" + EMAIL + "')"),
        (8, _spelled("scripts")),
        (9, "list_transform(regexp_extract_all(scripts, '\"([a-zA-Z0-9+/]{12,80}={0,2})\"', 1), lambda b: CASE WHEN length(b) % 4 = 0 THEN try(decode(from_base64(b))) ELSE '' END)"),
        (10, f"regexp_extract_all(body, '{EMAIL}')"),
        (11, _spelled("body")),
    ]
    unions = "\n UNION ALL ".join(f"SELECT page_id, url, {n} AS ord, {expr} AS l FROM texts" for n, expr in channels)
    return f"""texts AS (
 SELECT page_id, url, html, {_body('html')} AS body,
  array_to_string(regexp_extract_all(html, '(?is)<script\\b[^>]*>(.*?)</script', 1), chr(1)) AS scripts FROM {source}),
lists AS ({unions}),
raw AS (SELECT page_id, url, ord, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS pos FROM lists),
normed AS (SELECT page_id, url, ord, pos, {norm_email('raw')} AS email FROM raw WHERE raw IS NOT NULL),
evidence AS (SELECT * FROM normed WHERE {valid('email', words)}),
page_emails AS (
 SELECT page_id, url, email, ord, first_ord, first_pos FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, email ORDER BY {CONF} DESC, ord, pos) AS n,
   first_value(ord) OVER (PARTITION BY page_id, email ORDER BY ord, pos) AS first_ord,
   first_value(pos) OVER (PARTITION BY page_id, email ORDER BY ord, pos) AS first_pos
  FROM evidence) x WHERE n = 1)"""


def candidate_ctes(page_emails: str, key: str = "site_key", order: str = "page_id") -> str:
    """CTEs to ranked(site_key, domain, email, ...): candidates with score and rank.

    `page_emails` needs site_key, domain, url, email, ord, first_ord, first_pos and the order column.
    """
    bonus = (
        f"CASE {method('url')} WHEN 'contact-page' THEN 10 WHEN 'about-page' THEN 5 WHEN 'sitemap' THEN 5 ELSE 0 END"
        f" + CASE {SOURCE} WHEN 'mailto' THEN 5 WHEN 'footer' THEN 5 WHEN 'script' THEN -10 WHEN 'obfuscated' THEN -5 ELSE 0 END"
        f" + CASE WHEN {domain_match('email', 'domain')} THEN 10"
        f" WHEN {dom('email')} IN {q(opt.PUBLIC_MAIL_DOMAINS)} THEN -15 ELSE -50 END"
        " + CASE WHEN occurrences > 1 THEN least(10, 2 * occurrences) ELSE 0 END"
    )
    return f"""best_evidence AS (
 SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {key}, email) AS occurrences,
   row_number() OVER (PARTITION BY {key}, email ORDER BY {CONF} DESC, {order}) AS n,
   first_value({order}) OVER (PARTITION BY {key}, email ORDER BY {order}) AS seen_page,
   first_value(first_ord) OVER (PARTITION BY {key}, email ORDER BY {order}) AS seen_ord,
   first_value(first_pos) OVER (PARTITION BY {key}, email ORDER BY {order}) AS seen_pos
  FROM {page_emails}) x WHERE n = 1),
scored AS (SELECT *, CAST(greatest(10, least(100, {CONF} + {bonus})) AS INT) AS score,
  {base_score('email')} AS base, {domain_match('email', 'domain')} AS matches, {email_type('email')} AS kind FROM best_evidence),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, base DESC, matches DESC,
  kind = 'role' DESC, seen_page, seen_ord, seen_pos) AS rank FROM scored)"""


RESULT = f"email, url AS email_source, kind AS email_type, score AS confidence_score, {method('url')} AS discovery_method"

SITE = norm_domain("url")
D = dv.derive_sql
PAGES = f"site_pages AS ({D('d_pages')})"
USABLE = "usable AS (SELECT * FROM site_pages WHERE status NOT IN (429) AND status < 500)"
SITE_EV = evidence_ctes("usable")


#: The rules that deny the URL of a row of table t.
DENIED = (
    "SELECT 1 FROM rules u WHERE u.kind = 'disallow' AND u.origin = regexp_extract({t}.url, '^(https?://[^/?#]+)', 1)"
    " AND starts_with(regexp_extract({t}.url, '^https?://[^/?#]*([^#]*)', 1), u.value)"
)


def channel_query(*ords: int) -> str:
    return f"""WITH {PAGES}, {USABLE}, {SITE_EV}
SELECT page_id, email, {SOURCE} AS source_type, {OBF} AS obf_method, {CONF} AS confidence,
 {email_type('email')} AS email_type, {method('url')} AS discovery_method, CAST(pos AS INT) AS pos
FROM evidence WHERE ord IN ({', '.join(map(str, ords))})"""


# --- links and frontier -----------------------------------------------------

def _encode_path(x: str) -> str:
    # the letters the given pages use in links
    for a, b in [(" ", "%20"), ("ü", "%C3%BC"), ("ö", "%C3%B6"), ("ä", "%C3%A4"), ("ß", "%C3%9F"),
                 ("Ä", "%C3%84"), ("Ö", "%C3%96"), ("Ü", "%C3%9C"), ("é", "%C3%A9"), ("è", "%C3%A8"),
                 ("ê", "%C3%AA"), ("ç", "%C3%A7"), ("É", "%C3%89"), ("È", "%C3%88"), ("Ê", "%C3%8A"),
                 ("Ç", "%C3%87"), ("á", "%C3%A1"), ("í", "%C3%AD"), ("ó", "%C3%B3"), ("ú", "%C3%BA"),
                 ("ñ", "%C3%B1"), ("Á", "%C3%81"), ("Ó", "%C3%93"), ("Í", "%C3%8D"), ("Ú", "%C3%9A"),
                 ("Ñ", "%C3%91")]:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def link_ctes(source: str) -> str:
    """CTEs to links(page_id, src_url, url, pos) and page_links with link_rank."""
    href = _encode_path("trim(href)")
    origin = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
    return f"""hrefs AS (
 SELECT page_id, url, unnest(l) AS href, generate_subscripts(l, 1) - 1 AS pos FROM (
  SELECT page_id, url, regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\\b.*?</script|<style\\b.*?</style|<title\\b.*?</title', ' ', 'g'), '<a [^>]*href="([^"]*)"', 1) AS l
  FROM {source}) x),
resolved AS (SELECT page_id, url AS src_url, pos, split_part(CASE
  WHEN regexp_matches(href, '^https?://') THEN {href}
  WHEN regexp_matches(href, '^[a-z]+:') THEN ''
  WHEN starts_with(href, '/') THEN {origin} || {href}
  WHEN starts_with(href, '?') THEN regexp_extract(url, '^([^?#]*)', 1) || {href}
  WHEN starts_with(href, '#') THEN split_part(url, '#', 1)
  ELSE regexp_extract(url, '^([^?#]*/)', 1) || {href} END, '#', 1) AS url FROM hrefs),
links AS (SELECT * FROM resolved WHERE url <> '' AND NOT {avoided('url')}),
page_links AS (SELECT page_id, src_url, url, pos, {priority('url')} AS priority,
  row_number() OVER (PARTITION BY page_id ORDER BY {priority('url')} DESC, pos) AS link_rank
 FROM (SELECT page_id, src_url, url, min(pos) AS pos FROM links GROUP BY ALL) x)"""


def robots_ctes() -> str:
    ws = " \\t\\r"
    return f"""robots AS ({D('d_robots')}),
lines AS (SELECT origin, unnest(l) AS line, generate_subscripts(l, 1) AS line_no
 FROM (SELECT origin, string_split(replace(body, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM robots) x),
keyed AS (SELECT origin, line_no, lower(trim(split_part(line, ':', 1))) AS key,
  trim(substr(line, position(':' IN line) + 1)) AS value FROM lines
 WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#') AND contains(line, ':')),
ruled AS (SELECT *, last_value(CASE WHEN key = 'user-agent' THEN lower(value) END IGNORE NULLS)
  OVER (PARTITION BY origin ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS agent FROM keyed),
rules AS (SELECT origin, key AS kind, CASE WHEN key = 'sitemap' AND starts_with(value, '/') THEN origin || value ELSE value END AS value, line_no
 FROM ruled WHERE key = 'sitemap' OR (key = 'disallow' AND value <> '' AND (agent IS NULL OR agent IN ('*', 'sitecontacts'))))"""


def sitemap_ctes() -> str:
    """CTEs to site_maps(site_key, sitemap_no, url_no, url) for the derived sites."""
    entries = lambda tag: (
        f"list_filter(list_transform(regexp_extract_all(xml, '(?s)<{tag}>(.*?)</{tag}>', 1),"
        " lambda b: trim(regexp_extract(b, '(?s)<loc>(.*?)</loc>', 1))), lambda u: u <> '')"
    )
    return f"""files AS ({D('d_sitemaps')}),
docs AS (SELECT sitemap_url AS doc, contains(xml, '<sitemap>') AS is_index,
  CASE WHEN contains(xml, '<sitemap>') THEN {entries('sitemap')} ELSE {entries('url')} END AS entries FROM files),
origins AS (SELECT site_key, regexp_extract(start_url, '^(https?://[^/]+)', 1) AS origin FROM ({D('d_sites')}) s),
roots AS (
 SELECT site_key, value AS doc, row_number() OVER (PARTITION BY site_key ORDER BY line_no) AS no
 FROM origins JOIN rules USING (origin) WHERE kind = 'sitemap'
 UNION ALL SELECT site_key, origin || f, i FROM origins, (VALUES ('/sitemap.xml', 1), ('/sitemap_index.xml', 2)) v(f, i)
 WHERE origin NOT IN (SELECT origin FROM rules WHERE kind = 'sitemap')),
walks AS (
 SELECT site_key, no, doc, [doc] AS seen, []::BIGINT[] AS path FROM roots
 UNION ALL SELECT site_key, no, child.u, list_append(seen, child.u), list_append(path, child.i) FROM (
  SELECT w.site_key, w.no, w.seen, w.path, unnest(list_transform(d.entries, lambda u, i: {{'u': u, 'i': i}})) AS child
  FROM walks w JOIN docs d USING (doc) WHERE d.is_index) x WHERE NOT list_contains(seen, child.u)),
placed AS (SELECT site_key, no, doc, arg_min(path, {{'n': len(path), 'p': path}}) AS path FROM walks GROUP BY ALL),
found AS (SELECT site_key, no, path AS i, unnest(entries) AS url, generate_subscripts(entries, 1) AS p
 FROM placed JOIN docs USING (doc) WHERE NOT is_index),
site_maps AS (SELECT site_key, no AS sitemap_no, row_number() OVER (PARTITION BY site_key, no ORDER BY i, p) AS url_no, url FROM found)"""


#: More levels than the link graph of the derived sites has.
LEVELS = 7


def frontier_ctes() -> str:
    """CTEs to queue(site_key, url, depth, referrer, visit_rank, parent_rank) over the derived sites."""
    allowed = lambda alias: (
        f"NOT EXISTS (SELECT 1 FROM rules r WHERE r.kind = 'disallow'"
        f" AND r.origin = regexp_extract({alias}.url, '^(https?://[^/?#]+)', 1)"
        f" AND starts_with(regexp_extract({alias}.url, '^https?://[^/?#]*([^#]*)', 1), r.value))"
    )
    host = "regexp_replace(regexp_extract(l.url, '^https?://([^/?#:]+)', 1), '^www\\.', '')"

    def level(depth: int, before: str) -> str:
        return f"""kids{depth} AS (
 SELECT p.site_key, p.domain, p.visit_rank AS parent_rank, l.src_url, l.url, l.link_rank
 FROM {before} p JOIN page_links l ON l.src_url = p.url
 WHERE p.depth = {depth} AND ({host} = p.domain OR ends_with({host}, '.' || p.domain)) AND {allowed('l')}),
first{depth} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_key, url ORDER BY parent_rank, link_rank) AS n FROM kids{depth}) x
 WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM {before} b WHERE b.site_key = x.site_key AND b.url = x.url)),
queue{depth + 1} AS MATERIALIZED (SELECT site_key, domain, url, depth, referrer, visit_rank, parent_rank FROM {before}
 UNION ALL SELECT f.site_key, f.domain, f.url, {depth + 1}, f.src_url,
  (SELECT count(*) FROM {before} b WHERE b.site_key = f.site_key) + row_number() OVER (PARTITION BY f.site_key ORDER BY f.parent_rank, f.link_rank),
  f.parent_rank FROM first{depth} f)"""

    return f"""sites AS ({D('d_sites')}),
seeds AS (SELECT site_key, url, row_number() OVER (PARTITION BY site_key ORDER BY sitemap_no, url_no) AS seed_no
 FROM site_maps WHERE {priority('url')} > 0),
firsts AS (SELECT site_key, domain, start_url AS url, 0 AS depth, '' AS referrer, 0 AS o FROM sites
 UNION ALL SELECT s.site_key, t.domain, s.url, 1, 'sitemap', s.seed_no FROM seeds s JOIN sites t USING (site_key) WHERE {allowed('s')}),
queue0 AS (SELECT site_key, domain, url, depth, referrer, row_number() OVER (PARTITION BY site_key ORDER BY o) AS visit_rank, 0 AS parent_rank
 FROM (SELECT *, row_number() OVER (PARTITION BY site_key, url ORDER BY o) AS n FROM firsts) x WHERE n = 1),
{", ".join(level(k, f'queue{k}') for k in range(LEVELS))},
queue AS (SELECT * FROM queue{LEVELS})"""


CRAWL = (
    f"{PAGES}, {USABLE}, {link_ctes('usable')}, {robots_ctes()}, {sitemap_ctes()}, {frontier_ctes()}"
)

VISITS = f"""{SITE_EV},
visit_emails AS (SELECT v.site_key, v.domain, v.visit_rank, e.* FROM queue v JOIN page_emails e USING (url))"""


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}

    # columns over derived values
    o["normalized_emails"] = f"SELECT c_custkey, {norm_email('raw')} AS email FROM ({D('d_email')}) d"
    o["valid_emails"] = (
        f"SELECT c_custkey, email, {valid('email')} AS is_valid FROM"
        f" (SELECT c_custkey, {norm_email('raw')} AS email FROM ({D('d_email')}) d) e"
    )
    o["excluded_emails"] = (
        f"SELECT c_custkey, email FROM (SELECT c_custkey, {norm_email('raw')} AS email FROM ({D('d_email')}) d) e"
        f" WHERE {valid('email', ['privacy', 'team', 'doe'])}"
    )
    o["email_types"] = (
        f"SELECT c_custkey, email, {email_type('email')} AS email_type FROM"
        f" (SELECT c_custkey, {norm_email('raw')} AS email FROM ({D('d_email')}) d) e WHERE {valid('email')}"
    )
    o["base_scores"] = (
        f"SELECT c_custkey, email, {base_score('email')} AS base_score FROM"
        f" (SELECT c_custkey, {norm_email('raw')} AS email FROM ({D('d_email')}) d) e"
    )
    o["domain_matches"] = (
        f"SELECT c_custkey, email, {domain_match('email', chr(39) + 'acme.com' + chr(39))} AS matches FROM"
        f" (SELECT c_custkey, {norm_email('raw')} AS email FROM ({D('d_email')}) d) e"
    )
    o["normalized_domains"] = f"SELECT page_id, {norm_domain('url')} AS domain FROM pages"
    full = "CASE WHEN regexp_matches(raw, '(?i)^https?://') THEN raw ELSE 'https://' || raw END"
    o["normalized_urls"] = f"""WITH u AS (SELECT o_orderkey, raw, {full} AS u FROM ({D('d_url')}) d),
p AS (SELECT o_orderkey, raw, lower(regexp_extract(u, '(?i)^(https?)://', 1)) AS scheme,
  lower(regexp_extract(u, '(?i)^https?://([^/?#]*)', 1)) AS host, regexp_extract(u, '(?i)^https?://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(u, '(?i)^https?://[^?#]*(.*)$', 1) AS tail FROM u)
SELECT o_orderkey, raw, scheme || '://'
 || CASE WHEN scheme = 'http' AND ends_with(host, ':80') THEN host[:-4] WHEN scheme = 'https' AND ends_with(host, ':443') THEN host[:-5] ELSE host END
 || CASE path WHEN '' THEN '/' WHEN '/a/./b/../c' THEN '/a/c' ELSE {_encode_path('path')} END || tail AS url FROM p"""
    o["link_priority"] = f"""WITH u AS ({o['normalized_urls']})
SELECT o_orderkey, {priority('url')} AS priority, {page_method('url')} AS discovery_method FROM u"""
    o["avoid_urls"] = f"""WITH u AS ({o['normalized_urls']}) SELECT o_orderkey, url FROM u WHERE {avoided('url')}"""
    o["internal_urls"] = f"""WITH u AS ({o['normalized_urls']}),
h AS (SELECT o_orderkey, url, regexp_replace(regexp_extract(url, '^https?://([^/?#:]*)', 1), '^www\\.', '') AS host FROM u)
SELECT o_orderkey, url FROM h WHERE host = 'acme.com' OR ends_with(host, '.acme.com')"""
    o["page_status"] = f"""SELECT page_id, CASE WHEN status IS NULL THEN 'no-response' WHEN status = 429 THEN 'rate-limited'
 WHEN status >= 500 THEN 'server-error' ELSE 'usable' END AS status_class FROM ({D('d_status')}) d"""
    o["latest_capture"] = """SELECT user_id, event_id, event_type, value FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events
 WHERE ts + INTERVAL 24 HOUR >= (SELECT max(ts) FROM events)) x WHERE n = 1"""

    # evidence channels
    o["evidence_protected"] = channel_query(1, 2)
    o["evidence_mailto"] = channel_query(3)
    o["evidence_header"] = channel_query(4)
    o["evidence_footer"] = channel_query(5)
    o["evidence_meta"] = channel_query(6)
    o["evidence_script"] = channel_query(7, 8)
    o["evidence_base64"] = channel_query(9)
    o["evidence_text"] = channel_query(10)
    o["evidence_spelled_out"] = channel_query(11)
    o["evidence_all"] = channel_query(*range(1, 12))
    o["stream_evidence"] = o["evidence_all"].replace("WITH ", f"WITH {robots_ctes()}, ", 1) + f" AND NOT EXISTS ({DENIED.format(t='evidence')})"
    o["evidence_titles"] = f"""WITH {PAGES}, {USABLE}, {SITE_EV}
SELECT page_id, email, regexp_extract(u.html, '<title>(.*?)</title>', 1) AS page_title FROM evidence JOIN usable u USING (page_id)"""
    o["evidence_pages"] = f"""WITH {evidence_ctes('pages')}
SELECT page_id, email, {SOURCE} AS source_type, {CONF} AS confidence, CAST(pos AS INT) AS pos FROM evidence"""
    docs = "(SELECT doc_id AS page_id, 'https://' || source || '.example.com/' AS url, '<body>' || text || '</body>' AS html FROM documents)"
    o["evidence_text_documents"] = f"""WITH {evidence_ctes(docs)}
SELECT page_id AS doc_id, email, CAST(ord AS INT) AS channel_ord, CAST(pos AS INT) AS pos FROM evidence WHERE ord >= 10"""
    o["page_email_dedupe"] = f"""WITH {PAGES}, {USABLE}, {SITE_EV}
SELECT page_id, email, {SOURCE} AS source_type, {CONF} AS confidence, CAST(first_ord AS INT) AS first_channel FROM page_emails"""

    # aggregation, scoring, ranking
    sited = "site_emails AS (SELECT site AS site_key, site AS domain, e.* FROM page_emails e JOIN usable USING (page_id))"
    site_rank = f"{PAGES}, {USABLE}, {SITE_EV}, {sited}, {candidate_ctes('site_emails')}"
    o["occurrences"] = f"WITH {site_rank} SELECT site_key, email, occurrences FROM scored"
    o["final_scores"] = f"""WITH {site_rank}
SELECT site_key, email, url AS email_source, {CONF} AS confidence, {SOURCE} AS source_type, {method('url')} AS discovery_method,
 score AS confidence_score, base AS base_score, matches AS domain_match FROM scored"""
    o["ranked_candidates"] = f"WITH {site_rank} SELECT site_key, email, score AS confidence_score, rank FROM ranked"
    o["top_candidates"] = f"WITH {site_rank} SELECT site_key, email, score AS confidence_score, rank FROM ranked WHERE rank <= 3"
    o["best_emails"] = f"WITH {site_rank} SELECT site_key, {RESULT}, occurrences FROM ranked WHERE rank = 1"
    o["first_seen_events"] = f"""WITH {evidence_ctes(docs)}
SELECT {norm_domain('url')} AS domain, email, url AS "emailSource", {CONF} AS "confidenceScore", {method('url')} AS "discoveryMethod"
FROM (SELECT *, row_number() OVER (PARTITION BY url, email ORDER BY page_id, first_ord, first_pos) AS n FROM page_emails) x WHERE n = 1"""
    own = f"own AS (SELECT {SITE} AS site_key, {SITE} AS domain, * FROM page_emails)"
    flagship = f"{evidence_ctes('pages')}, {own}, {candidate_ctes('own')}"
    o["site_best_contact"] = f"""WITH {flagship}, site AS (SELECT {SITE} AS site_key, count(*) AS pages FROM pages GROUP BY 1)
SELECT s.site_key, s.pages, r.email, r.url AS email_source, r.kind AS email_type, r.score AS confidence_score,
 CASE WHEN r.email IS NOT NULL THEN {method('r.url')} END AS discovery_method
FROM site s LEFT JOIN ranked r ON r.site_key = s.site_key AND r.rank = 1"""
    o["stream_equals_batch"] = f"WITH {flagship} SELECT site_key AS domain, {RESULT}, occurrences FROM ranked WHERE rank = 1"
    o["site_summary"] = f"""WITH {site_rank},
p AS (SELECT site AS site_key, count(*) AS pages_crawled, count(*) FILTER (status = 429 OR status >= 500) AS pages_failed FROM site_pages GROUP BY 1),
e AS (SELECT site_key, count(DISTINCT email) AS emails_found FROM site_emails GROUP BY 1)
SELECT p.site_key, p.pages_crawled, p.pages_failed, coalesce(e.emails_found, 0) AS emails_found, coalesce(r.email, 'None') AS final_email,
 CASE WHEN r.email IS NULL THEN 'Empty' ELSE 'Found' END AS outcome, 'success' AS status
FROM p LEFT JOIN e USING (site_key) LEFT JOIN ranked r ON r.site_key = p.site_key AND r.rank = 1"""

    # links
    o["page_links"] = f"WITH {link_ctes('pages')} SELECT page_id, url, priority, CAST(link_rank AS INT) AS link_rank FROM page_links"
    o["site_links"] = f"WITH {PAGES}, {USABLE}, {link_ctes('usable')} SELECT page_id, url, priority, CAST(link_rank AS INT) AS link_rank FROM page_links"

    # robots, sitemaps, frontier
    o["robots_rules"] = f"WITH {robots_ctes()} SELECT origin, kind, value, count(*) AS n FROM rules GROUP BY ALL"
    o["robots_filter"] = f"""WITH {robots_ctes()}, {PAGES}
SELECT page_id, url FROM site_pages p WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.kind = 'disallow'
 AND r.origin = regexp_extract(p.url, '^(https?://[^/?#]+)', 1) AND starts_with(regexp_extract(p.url, '^https?://[^/?#]*([^#]*)', 1), r.value))"""
    o["sitemap_urls"] = f"""WITH RECURSIVE {robots_ctes()}, {sitemap_ctes()}
SELECT site_key, CAST(sitemap_no AS INT) AS sitemap_no, CAST(url_no AS INT) AS url_no, url FROM site_maps"""
    o["crawl_queue"] = f"""WITH RECURSIVE {CRAWL}
SELECT site_key, url, CAST(depth AS INT) AS depth, referrer, CAST(visit_rank AS INT) AS visit_rank, CAST(parent_rank AS INT) AS parent_rank FROM queue"""
    o["next_fetch"] = f"""WITH RECURSIVE {CRAWL}
SELECT site_key, url, CAST(depth AS INT) AS depth, referrer, CAST(visit_rank AS INT) AS visit_rank FROM queue
WHERE url NOT IN (SELECT url FROM usable)"""
    o["crawl_best"] = f"""WITH RECURSIVE {CRAWL}, {VISITS}, {candidate_ctes("visit_emails", order="visit_rank")}
SELECT site_key, {RESULT} FROM ranked WHERE rank = 1"""

    # leads
    website = "coalesce(nullif(trim(Website), ''), nullif(trim(url_hint), ''))"
    targets = f"targets AS (SELECT *, {website} AS site FROM ({D('d_leads')}) l WHERE {website} IS NOT NULL)"
    o["lead_targets"] = f"""WITH {targets}
SELECT row_index, CASE WHEN Name = '' THEN 'Unknown Company' ELSE Name END AS name, site AS website, {norm_domain('site')} AS domain,
 CASE WHEN regexp_matches(site, '^https?://') THEN site ELSE 'https://' || site END
 || CASE WHEN regexp_matches(site, '^(https?://)?[^/]+$') THEN '/' ELSE '' END AS start_url FROM targets"""
    o["rejected_leads"] = f"SELECT row_index, Name FROM ({D('d_leads')}) l WHERE {website} IS NULL"
    lead_rank = (
        f"{targets}, {PAGES}, {SITE_EV.replace('FROM usable', 'FROM site_pages')},"
        " site_emails AS (SELECT site AS site_key, site AS domain, e.* FROM page_emails e JOIN site_pages USING (page_id)),"
        f" {candidate_ctes('site_emails')}"
    )
    blank = lambda v: f"coalesce(CAST({v} AS VARCHAR), '')"
    result = (
        f"{blank('r.email')} AS email, {blank('r.url')} AS email_source, {blank('r.kind')} AS email_type,"
        f" {blank('r.score')} AS confidence_score, CASE WHEN r.email IS NULL THEN '' ELSE {method('r.url')} END AS discovery_method"
    )
    usable_rank = lead_rank.replace("FROM site_pages)", "FROM usable)").replace(PAGES, f"{PAGES}, {USABLE}").replace(
        "FROM site_pages),", "FROM usable),").replace("JOIN site_pages USING", "JOIN usable USING")
    o["enriched_leads"] = f"""WITH {usable_rank}
SELECT t.row_index, t.Name, t.Segment, t.Website, t.url_hint, {result}
FROM targets t LEFT JOIN ranked r ON r.site_key = {norm_domain('t.site')} AND r.rank = 1"""
    o["fallback_contact"] = f"""WITH {usable_rank}, dns AS ({D('d_dns')}),
ok AS (SELECT domain AS d FROM dns WHERE has_mx AND NOT disposable)
SELECT t.row_index, CASE WHEN r.email IS NOT NULL THEN r.email WHEN ok.d IS NOT NULL THEN 'hello@' || ok.d ELSE '' END AS email,
 CASE WHEN r.email IS NOT NULL THEN CAST(r.score AS VARCHAR) WHEN ok.d IS NOT NULL THEN '50' ELSE '' END AS confidence_score,
 CASE WHEN r.email IS NOT NULL THEN {method('r.url')} WHEN ok.d IS NOT NULL THEN 'fallback-hello' ELSE '' END AS discovery_method
FROM targets t LEFT JOIN ranked r ON r.site_key = {norm_domain('t.site')} AND r.rank = 1
LEFT JOIN ok ON ok.d = {norm_domain('t.site')}"""
    o["lead_file"] = f"""SELECT row_number() OVER (ORDER BY row_index) - 1 AS row_index, Name, Segment, trim(Website) AS Website, trim(url_hint) AS url_hint FROM ({D('d_leads')}) l"""
    denied = DENIED.format(t="site_pages")
    o["robots_enriched_leads"] = f"""WITH {robots_ctes()}, {usable_rank.replace("status < 500)", f"status < 500 AND NOT EXISTS ({denied}))")}
SELECT t.row_index, t.Name, t.Segment, t.Website, t.url_hint, {result}
FROM targets t LEFT JOIN ranked r ON r.site_key = {norm_domain('t.site')} AND r.rank = 1"""
    o["output_columns"] = f"""WITH {usable_rank}
SELECT t.Name, t.Segment, t.Website, {result}, t.url_hint
FROM targets t LEFT JOIN ranked r ON r.site_key = {norm_domain('t.site')} AND r.rank = 1"""
    o["stream_enriched_leads"] = o["output_columns"]
    o["indexed_rows"] = "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_index, c_custkey, c_name FROM customer"
    o["run_summary"] = f"""WITH {usable_rank}
SELECT (SELECT count(*) FROM customer) AS leads, count(*) AS processed, (SELECT count(*) FROM customer) - count(*) AS skipped,
 count(r.email) AS with_email FROM targets t LEFT JOIN ranked r ON r.site_key = {norm_domain('t.site')} AND r.rank = 1"""

    # progress: customers with a finished urgent order count as done leads
    DONE = "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"
    o["resume_remaining"] = f"SELECT c_custkey AS row_index, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE {DONE})"
    o["progress_mark"] = f"""SELECT CAST(coalesce((SELECT min(c_custkey) - 1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE {DONE})),
 (SELECT max(c_custkey) FROM customer), -1) AS BIGINT) AS mark"""
    return o
