"""Column expressions over URLs and host names."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from sitecontacts import options as opt
from sitecontacts.functions.columns import any_of, browser_trim, let, replace_each

_USER = r"(?:[^/?#\\]*@)?"
_HOST = r"[^/?#\\:@\s\[\]<>^|%\"]+|\[[0-9a-fA-F:.]+\]"
_AUTHORITY = rf"(?i)\Ahttps?://{_USER}(?:{_HOST})(?::[0-9]{{0,5}})?"
_VALID = rf"{_AUTHORITY}(?=[/?#\\]|\z)"
# Already in canonical form: nothing to encode, fold or resolve.
_CANONICAL = (
    r"\Ahttps?://[a-z0-9][a-z0-9._-]*/"
    r"(?!\.)(?:[A-Za-z0-9_~!$&'()*+,;=:@%-]++|\.(?!/|\.)|/(?!\.))*+"
    r"(?:\?[A-Za-z0-9._~!$&()*+,;=:@%/?\[\]-]*)?(?:#[A-Za-z0-9._~!$&'()*+,;=:@%/?-]*)?\z"
)
# A domain that normalising leaves as it is.
_BARE_DOMAIN = r"\A(?!www\.)[abcdefghijklmnopqrstuvwxyz0123456789.-]+\z"
# A canonical URL without a fragment: as a link, it leads to itself.
_CANONICAL_LINK = _CANONICAL[: _CANONICAL.rindex("(?:#")] + r"\z"
# Words are only tried where one of their first letters stands.
_AVOIDED = (
    rf"(?is)\Ahttps?://[^/?#\\]*+(?:[^?#]*\.{any_of(opt.AVOIDED_EXTENSIONS)}(?:[?#]|\z)"
    rf"|.*(?=[{re.escape(''.join(sorted({w[0] for w in opt.AVOIDED_WORDS})))}]){any_of(opt.AVOIDED_WORDS)})"
)
# A path on the page's own host that is canonical as it stands.
_PLAIN_ROOT = (
    r"\A(?!//)(?:[A-Za-z0-9_~!$&'()*+,;=:@%-]++|\.(?!/|\.|\z)|/(?!\.))++"
    r"(?:\?[A-Za-z0-9._~!$&()*+,;=:@%/?\[\]-]*)?\z"
)


def is_http_url(c: Column) -> Column:
    """A complete http or https URL with a usable host."""
    return F.coalesce(c.rlike(_VALID), F.lit(False))


def url_host(c: Column) -> Column:
    """Lower-case host of an http(s) URL, without port; empty when there is none."""
    return F.lower(F.regexp_extract(c, rf"(?i)\Ahttps?://{_USER}({_HOST})", 1))


def url_path(c: Column) -> Column:
    return F.regexp_extract(c, r"(?i)\Ahttps?://[^/?#\\]*([^?#]*)", 1)


def url_origin(c: Column) -> Column:
    """scheme://host[:port] of a canonical URL."""
    return F.regexp_extract(c, r"\A(https?://[^/?#]+)", 1)


def drop_fragment(c: Column) -> Column:
    return F.substring_index(c, "#", 1)


def _percent_encode(run: Column) -> Column:
    # url_encode writes a space as a plus sign
    return F.replace(F.url_encode(run), F.lit("+"), F.lit("%20"))


def _encode(c: Column, unsafe: str) -> Column:
    return F.when(c.rlike(unsafe), replace_each(c, unsafe, _percent_encode)).otherwise(c)


def _resolve_dots(path: Column) -> Column:
    """Remove . and .. segments of an absolute path."""
    folded = F.regexp_replace(path, r"(?i)%2e", ".")
    parts = F.split(F.substring(folded, F.lit(2), F.length(folded)), "/", -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    # a last segment of . or .. leaves a trailing slash
    tail = F.when(folded.rlike(r"/\.{1,2}\z"), F.lit("/")).otherwise(F.lit(""))
    return let(
        F.concat(F.lit("/"), F.array_join(kept, "/"), tail),
        lambda p: F.when(p.rlike(r"\A//\z"), F.lit("/")).otherwise(p),
    )


def _canonical(c: Column) -> Column:
    scheme = F.lower(F.regexp_extract(c, r"(?i)\A(https?)://", 1))
    user = F.regexp_extract(c, r"(?i)\Ahttps?://((?:[^/?#\\]*@)?)", 1)
    port = F.regexp_extract(c, rf"{_AUTHORITY[:-len('(?::[0-9]{0,5})?')]}:([0-9]{{0,5}})", 1)
    rest = F.regexp_extract(c, r"(?is)\Ahttps?://[^/?#\\]*(.*)\z", 1)
    path = F.replace(F.regexp_extract(rest, r"(?s)\A([^?#]*)", 1), F.lit("\\"), F.lit("/"))
    query = F.regexp_extract(rest, r"(?s)\A[^?#]*(\?[^#]*)", 1)
    fragment = F.regexp_extract(rest, r"(?s)(#.*)\z", 1)
    port_out = F.when(
        (port == "")
        | ((scheme == "http") & (port.cast("int") == 80))
        | ((scheme == "https") & (port.cast("int") == 443)),
        F.lit(""),
    ).otherwise(F.concat(F.lit(":"), port.cast("int").cast("string")))
    path_out = let(
        F.when(path == "", F.lit("/")).otherwise(path),
        lambda p: F.when(p.rlike(r"(?i)/(?:\.|%2e)"), _resolve_dots(p)).otherwise(p),
    )
    return F.concat(
        scheme, F.lit("://"), user, url_host(c), port_out,
        _encode(path_out, r"[^\x21\x23-\x3b\x3d\x40-\x5d\x5f\x61-\x7a\x7c\x7e]+"),
        _encode(query, r"[^\x21\x23-\x26\x28-\x3b\x3d\x3f-\x7e]+"),
        _encode(fragment, r"[^\x21\x23-\x3b\x3d\x3f-\x5f\x61-\x7e]+"),
    )


def canonical_url(c: Column) -> Column:
    """Canonical href of a complete http(s) URL; null when it is not one."""
    return let(
        c,
        lambda u: F.when(u.rlike(_CANONICAL), u).otherwise(
            let(
                F.regexp_replace(u, r"[\t\r\n]", ""),
                lambda v: F.when(v.rlike(_VALID), _canonical(v)),
            )
        ),
    )


def normalize_url(c: Column) -> Column:
    """Add https:// where missing and make canonical; what cannot be read stays as it is."""
    full = let(
        browser_trim(c),
        lambda s: F.when(s == "", s)
        .when(s.rlike(r"(?i)\Ahttps?://"), s)
        .otherwise(F.concat(F.lit("https://"), s)),
    )
    return let(full, lambda u: F.when(u == "", u).otherwise(F.coalesce(canonical_url(u), u)))


def normalize_domain(c: Column) -> Column:
    """Bare lower-case domain of a URL or host text, without a leading www."""
    def bare(text: Column) -> Column:
        host = let(
            F.lower(browser_trim(text)),
            lambda s: F.when(
                s.rlike(r"\Ahttps?://"),
                F.when(s.rlike(_VALID), url_host(s)).otherwise(
                    F.regexp_replace(s, r"\Ahttps?://(?:www\.)?", "")
                ),
            ).otherwise(s),
        )
        return F.substring_index(F.regexp_replace(host, r"\Awww\.", ""), "/", 1)

    return let(c, lambda t: F.when(t.rlike(_BARE_DOMAIN), t).otherwise(bare(t)))


def is_internal_url(url: Column, target_domain: Column) -> Column:
    """The URL's host is the (normalised) target domain or one of its subdomains."""
    return F.coalesce(
        let(
            F.regexp_replace(url_host(url), r"\Awww\.", ""),
            lambda h: (h != "")
            & ((h == target_domain) | F.endswith(h, F.concat(F.lit("."), target_domain))),
        ),
        F.lit(False),
    )


def own_start(target_domain: Column) -> Column:
    """What a URL begins with whose host is surely the target domain; null where that can't be told from the domain."""
    return F.when(target_domain.rlike(_BARE_DOMAIN), F.concat(F.lit("https://"), target_domain, F.lit("/")))


def should_avoid_url(url: Column) -> Column:
    """Not http(s), a media or document file, or a page behind a login or a cart."""
    return ~is_http_url(url) | is_avoided(url)


def is_avoided(url: Column) -> Column:
    """The part of `should_avoid_url` that a resolved link needs, as it is a complete URL."""
    return url.rlike(_AVOIDED)


def link_priority(url: Column) -> Column:
    """2 for contact-like paths, 1 for company and legal pages, 0 otherwise, -1 when unreadable."""
    return F.when(~is_http_url(url), -1).otherwise(path_priority(url))


def path_priority(url: Column) -> Column:
    """The part of `link_priority` that a resolved link needs, as it is a complete URL."""
    path = F.lower(url_path(url))
    return (
        F.when(path.rlike(any_of(opt.HIGH_PRIORITY_WORDS)), 2)
        .when(path.rlike(any_of(opt.MEDIUM_PRIORITY_WORDS)), 1)
        .otherwise(0)
    )


def discovery_method(url: Column) -> Column:
    """Kind of page, from its path."""
    path = F.lower(url_path(url))
    return (
        F.when(F.contains(path, F.lit("contact")), "contact-page")
        .when(F.contains(path, F.lit("about")), "about-page")
        .when(F.contains(path, F.lit("sitemap")), "sitemap")
        .otherwise("general-page")
    )


def evidence_method(source_type: Column, obf_method: Column, url: Column) -> Column:
    """How an address was discovered: protected, mailto link, or the kind of page."""
    return (
        F.when(obf_method == "cloudflare", "obscure-js")
        .when(source_type == "mailto", "mailto-link")
        .otherwise(discovery_method(url))
    )


def base_parts(base: Column) -> Column:
    """What links of a page resolve against, from its canonical URL."""
    return F.struct(
        F.regexp_extract(base, r"\A(https?:)", 1).alias("scheme"),
        url_origin(base).alias("origin"),
        F.regexp_extract(base, r"\A([^?#]*/)", 1).alias("folder"),
        F.regexp_extract(base, r"\A([^?#]*)", 1).alias("page"),
        drop_fragment(base).alias("whole"),
        canonical_url(drop_fragment(base)).alias("here"),
    )


def resolve_url(href: Column, base: Column) -> Column:
    """Canonical target of a link, fragment dropped; null unless http(s).

    `base` is a `base_parts` column, computed once per page.
    """
    plain = F.startswith(href, F.lit("/")) & href.rlike(_PLAIN_ROOT)
    joined = let(
        F.regexp_replace(browser_trim(href), r"[\t\r\n]", ""),
        lambda h: F.when(h == "", F.lit(None).cast("string"))
        .when(h.rlike(r"\A/[^/\\]"), F.concat(base["origin"], h))
        .when(h.rlike(r"(?i)\Ahttps?:"), F.regexp_replace(h, r"(?i)\A(https?:)[/\\]+", "$1//"))
        .when(h.rlike(r"(?i)\A[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(h.rlike(r"\A[/\\]{2}"), F.concat(base["scheme"], h))
        .when(h.rlike(r"\A[/\\]"), F.concat(base["origin"], h))
        .when(F.startswith(h, F.lit("?")), F.concat(base["page"], h))
        .when(F.startswith(h, F.lit("#")), base["whole"])
        .otherwise(F.concat(base["folder"], h)),
    )
    whole = F.when(href.rlike(_CANONICAL_LINK), href).otherwise(canonical_url(drop_fragment(joined)))
    return (
        F.when(plain, F.concat(base["origin"], href))
        .when(F.startswith(href, F.lit("#")), base["here"])
        .otherwise(whole)
    )


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain of it: a.b.c gives a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
