"""Column expressions over addresses and page text."""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, functions as F

from sitecontacts import options as opt
from sitecontacts.functions.columns import WS, any_of, browser_trim, let, replace_each

# Character classes of an address, ASCII only. Written out, a class is one look into a table; a
# named class or a range is a call each. Runs are greedy inside (?>...): that takes as much as a possessive run, faster.
_ALNUM = string.ascii_letters + string.digits
_WORD = _ALNUM + "_"
LOCAL = _WORD + ".%+-"
DOMAIN = _ALNUM + ".-"

# A search may begin where a run of local-part characters begins or right where
# the last match ended. That equals trying every position, but stays linear on
# long runs such as hex dumps.
_RUN_START = rf"(?:(?<![{LOCAL}])|\G)"
# ASCII word boundary; \b depends on the Java version for other letters.
_WORD_END = rf"(?![{_WORD}])"
_WORD_EDGE = rf"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"

EMAIL = rf"{_RUN_START}(?>[{LOCAL}]+)@[{DOMAIN}]+\.\p{{Alpha}}{{2,10}}{_WORD_END}"
# Applies to text whose whitespace runs are collapsed to one space.
SPELLED_OUT = (
    rf"(?i){_RUN_START}([{LOCAL}]++)(?: ?(?:\[at\]|\(at\)) ?| at )([{DOMAIN}]+)"
    rf"(?: ?(?:\[dot\]|\(dot\)) ?| dot )(\p{{Alpha}}{{2,10}}){_WORD_END}"
)
BASE64 = rf"{_WORD_EDGE}[\p{{Alnum}}+/]{{12,80}}={{0,2}}{_WORD_EDGE}"


# An address that normalising leaves as it is.
_NORMAL_EMAIL = r"\A[a-z0-9_+-][a-z0-9._+-]*+@[a-z0-9.-]*(?<=[a-z0-9-])\z"


def normalize_email(c: Column) -> Column:
    """Trim, lower, drop mailto:, query and fragment, percent-decode, strip quotes and dots."""
    def clean(raw: Column) -> Column:
        bare = F.regexp_replace(F.lower(browser_trim(raw)), r"\Amailto:", "")
        bare = F.substring_index(F.substring_index(bare, "?", 1), "#", 1)
        decoded = let(
            bare,
            lambda s: F.when(F.contains(s, F.lit("%")), _percent_decoded(s)).otherwise(s),
        )
        return F.regexp_replace(decoded, rf"\A['\".{WS}]+|['\".{WS}]+\z", "")

    return let(c, lambda raw: F.when(raw.rlike(_NORMAL_EMAIL), raw).otherwise(clean(raw)))


def _percent_decoded(s: Column) -> Column:
    """Decoded text, or the text as it is when the escapes are malformed."""
    return let(
        F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))),
        lambda d: F.when(
            d.isNull() | (F.contains(d, F.lit("\ufffd")) & ~F.contains(s, F.lit("\ufffd"))), s
        ).otherwise(d),
    )


def _valid_pattern() -> str:
    rejected_exact = [
        w for w in opt.REJECTED_LOCALS
        if not any(w.startswith(p) for p in opt.REJECTED_LOCAL_STARTS)
    ]
    # words are only tried where one of their first letters stands; the last label follows the last dot
    parts = "".join(sorted({w[0] for w in opt.REJECTED_DOMAIN_PARTS}))
    return (
        rf"\A(?=.{{1,{opt.MAX_EMAIL_LENGTH}}}\z)"
        rf"(?!(?i:{any_of(opt.REJECTED_LOCAL_STARTS)}))"
        rf"(?!(?i:{any_of(rejected_exact)}@))"
        rf"[{LOCAL}]{{1,{opt.MAX_LOCAL_LENGTH}}}@"
        rf"(?!(?i:{any_of(opt.REJECTED_DOMAIN_STARTS)}))"
        rf"(?!(?i:{any_of(opt.REJECTED_DOMAINS)}\z))"
        rf"(?!(?i:.*(?=[{parts}]){any_of(opt.REJECTED_DOMAIN_PARTS)}))"
        rf"[{DOMAIN}]+\.(?!(?i:{any_of(opt.REJECTED_TLDS)}\z))\p{{Alpha}}{{2,10}}\z"
    )


VALID_EMAIL = _valid_pattern()


def is_valid_email(c: Column, exclude_words=()) -> Column:
    """Well-formed, not on a reject list and not holding an excluded word."""
    ok = c.rlike(VALID_EMAIL)
    if exclude_words:
        ok = ok & ~has_excluded_word(c, exclude_words)
    return F.coalesce(ok, F.lit(False))


def has_excluded_word(email: Column, words) -> Column:
    """True when the local part holds one of the words as a delimited token."""
    if not words:
        return F.lit(False)
    # the local part ends at the @ sign
    return email.rlike(rf"(?i)\A(?:[^@]*[-._+])?{any_of(words)}(?:[-._+@]|\z)")


def email_local(email: Column) -> Column:
    return F.substring_index(email, "@", 1)


def email_domain(email: Column) -> Column:
    return F.substring_index(email, "@", -1)


def _local_is(email: Column, words, delimiter: str) -> Column:
    return email.rlike(rf"(?i)\A{any_of(words)}(?:{delimiter}|@|\z)")


def email_type(email: Column) -> Column:
    """automated, role or personal; automated words are looked at first."""
    return (
        F.when(_local_is(email, opt.AUTOMATED_WORDS, "-"), "automated")
        .when(_local_is(email, opt.ROLE_WORDS, r"\."), "role")
        .otherwise("personal")
    )


def base_score(email: Column) -> Column:
    """Priority of the local part, 0 to 100; role words are looked at first."""
    (words, score), *rest = opt.BASE_SCORES
    chain = F.when(_local_is(email, words, r"\."), F.lit(score))
    for words, score in rest:
        chain = chain.when(_local_is(email, words, r"\."), F.lit(score))
    return chain.when(
        _local_is(email, opt.BASE_AUTOMATED_WORDS, "-"), F.lit(opt.BASE_AUTOMATED_SCORE)
    ).otherwise(F.lit(opt.BASE_DEFAULT_SCORE))


def extraction_confidence(source_type: Column, obf_method: Column) -> Column:
    """Confidence of a sighting from where and how it was found."""
    base = (
        F.when(source_type.isin("footer", "header"), 85)
        .when(source_type == "mailto", 90)
        .when(source_type == "obfuscated", 50)
        .when(source_type == "script", 40)
        .otherwise(60)
    )
    reduced = base - F.when(obf_method.isNotNull(), 10).otherwise(0)
    return F.greatest(F.lit(10), F.least(F.lit(100), reduced))


def is_domain_match(email: Column, target_domain: Column) -> Column:
    """The address is on the (normalised) target domain or one of its subdomains."""
    from sitecontacts.functions.urls import normalize_domain

    domain = normalize_domain(email_domain(email))
    return let(
        domain, lambda d: (d == target_domain) | F.endswith(d, F.concat(F.lit("."), target_domain))
    )


def score_bonus(
    discovery_method: Column, source_type: Column, email: Column, target_domain: Column
) -> Column:
    """What page, place and domain of a candidate add to its score."""
    from sitecontacts.functions.urls import normalize_domain

    by_method = (
        F.when(discovery_method == "contact-page", 10)
        .when(discovery_method.isin("about-page", "sitemap"), 5)
        .otherwise(0)
    )
    by_source = (
        F.when(source_type.isin("mailto", "footer"), 5)
        .when(source_type == "script", -10)
        .when(source_type == "obfuscated", -5)
        .otherwise(0)
    )
    by_domain = let(
        normalize_domain(email_domain(email)),
        lambda d: F.when(
            (d == target_domain) | F.endswith(d, F.concat(F.lit("."), target_domain)), 10
        )
        .when(d.isin(opt.PUBLIC_MAIL_DOMAINS), -15)
        .otherwise(-50),
    )
    return by_method + by_source + by_domain


def final_score(
    confidence: Column,
    discovery_method: Column,
    source_type: Column,
    email: Column,
    target_domain: Column,
    occurrences: Column,
) -> Column:
    """Score of a candidate for a site, 10 to 100."""
    by_count = F.when(
        occurrences > 1, F.least(F.lit(10), (occurrences * 2).cast("int"))
    ).otherwise(0)
    total = confidence + score_bonus(discovery_method, source_type, email, target_domain) + by_count
    return F.greatest(F.lit(10), F.least(F.lit(100), total)).cast("int")


# --- page text --------------------------------------------------------------

def _utf16_unit(n: Column) -> Column:
    """Character of a UTF-16 code unit number; lone surrogates become U+FFFD."""
    return let(
        n % 65536,
        lambda u: F.when(u.between(0xD800, 0xDFFF), F.lit("\ufffd")).otherwise(
            F.decode(F.unhex(F.lpad(F.hex(u), 4, "0")), "UTF-16BE")
        ),
    )


def _number(digits: Column, base: int) -> Column:
    """Numeric value of a digit string, as far as it counts modulo 65,536, of which 16^4 and 10^16 are multiples."""
    return F.conv(F.right(digits, F.lit(4 if base == 16 else 16)), base, 10).cast("bigint")


def _hex_reference(found: Column) -> Column:
    return _utf16_unit(_number(F.regexp_extract(found, r"(?i)x([0-9a-f]+)", 1), 16))


def _decimal_reference(found: Column) -> Column:
    return _utf16_unit(_number(F.regexp_extract(found, r"([0-9]+)", 1), 10))


def decode_numeric_entities(c: Column) -> Column:
    """&#xHH; then &#DD; to characters; named references stay."""

    def pass_over(mark: str, pattern: str, char):
        return lambda t: F.when(
            F.contains(t, F.lit(mark)), replace_each(t, pattern, char)
        ).otherwise(t)

    after_hex = let(c, pass_over("&#x", r"&#x[0-9a-fA-F]+;", _hex_reference))
    return let(after_hex, pass_over("&#", r"&#[0-9]+;", _decimal_reference))


# Named references that an HTML reader turns into characters an
# address or a spelled-out address can hold, and the ones that stay escaped in text.
ADDRESS_REFERENCES = {
    "&commat;": "@", "&period;": ".", "&lowbar;": "_", "&UnderBar;": "_",
    "&percnt;": "%", "&plus;": "+", "&lsqb;": "[", "&lbrack;": "[",
    "&rsqb;": "]", "&rbrack;": "]", "&lpar;": "(", "&rpar;": ")",
    "&Tab;": "\t", "&NewLine;": "\n",
}
MARKUP_REFERENCES = {
    "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'",
    "&nbsp;": "\u00a0", "&num;": "#", "&sol;": "/", "&colon;": ":",
    "&quest;": "?", "&equals;": "=",
}


def decode_references(c: Column, named: dict[str, str] | None = None) -> Column:
    """One pass over numeric and the given named references, as an HTML reader does it."""
    named = named or {**ADDRESS_REFERENCES, **MARKUP_REFERENCES}
    characters = F.from_json(F.lit(json.dumps(named)), "map<string,string>")

    def char(found: Column) -> Column:
        return (
            F.when(found.rlike(r"\A&#[xX]"), _hex_reference(found))
            .when(F.startswith(found, F.lit("&#")), _decimal_reference(found))
            .otherwise(F.try_element_at(characters, found))
        )

    names = any_of(name[1:-1] for name in named)
    pattern = rf"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|{names});"
    return let(
        c,
        lambda t: F.when(
            F.contains(t, F.lit("&")) & t.rlike(pattern), replace_each(t, pattern, char)
        ).otherwise(t),
    )


def spaced_text(html: Column) -> Column:
    """Text of a piece of HTML; scripts, styles and tags become spaces."""
    return tagless_text(drop_scripts(html))


def drop_scripts(html: Column) -> Column:
    """Scripts and styles become a space."""
    close = r"/(?i:\1)\s*+>"
    pattern = rf"<(?=[sS])((?i:script|style))\b[^<]*+(?:<(?!{close})[^<]*+)*+(?:<{close})?+"
    return let(
        html,
        lambda h: F.when(
            F.contains(h, F.lit("<s")) | F.contains(h, F.lit("<S")), F.regexp_replace(h, pattern, " ")
        ).otherwise(h),
    )


def tagless_text(html: Column) -> Column:
    """Text of a piece of HTML that holds no scripts or styles."""
    text = F.regexp_replace(html, r"<[\p{Alpha}/!?][^>]*>?", " ")
    # a no-break space is written back as a reference, so it is no whitespace here
    return F.replace(
        decode_references(text, ADDRESS_REFERENCES), F.lit("\u00a0"), F.lit("&nbsp;")
    )


# The next word that holds an @ sign, or nothing at the end; words before it are passed over, each read once.
_AROUND_AT = (
    rf"(?:(?>[{LOCAL}]*)(?>[^@{LOCAL}]+))*+(?:((?>[{LOCAL}]*)@(?>[@{LOCAL}]*))|(?>[{LOCAL}]*)\z)"
)


def find_emails(text: Column) -> Column:
    """Addresses in a text, in order.

    Only words around an @ sign are searched: an address lies inside one run of its
    own characters, and what ends a run also ends an address.
    """

    def search(t: Column) -> Column:
        words = F.array_join(F.regexp_extract_all(t, F.lit(_AROUND_AT), F.lit(1)), " ")
        return F.regexp_extract_all(words, F.lit(EMAIL), F.lit(0))

    return let(text, lambda t: F.when(F.contains(t, F.lit("@")), search(t)))


def find_spelled_out(text: Column) -> Column:
    """Addresses written with 'at' and 'dot', put together again."""
    flat = F.regexp_replace(text, rf"[{WS}]+", " ")
    whole = F.regexp_extract_all(flat, F.lit(SPELLED_OUT), F.lit(0))
    return F.transform(
        whole,
        lambda m: F.regexp_replace(m, SPELLED_OUT, "$1@$2.$3"),
    )


def find_base64(text: Column) -> Column:
    """Decoded texts of base64-looking words that hold an @ sign."""

    def decoded(word: Column) -> Column:
        digits = F.regexp_replace(word, r"=+\z", "")
        whole = let(
            digits,
            lambda d: F.when(
                F.length(d) % 4 == 1, F.substring(d, F.lit(1), F.length(d) - 1)
            ).otherwise(d),
        )
        return F.make_valid_utf8(F.unbase64(whole).cast("string"))

    words = F.regexp_extract_all(text, F.lit(BASE64), F.lit(0))
    return F.filter(F.transform(words, decoded), lambda t: F.contains(t, F.lit("@")))


def decode_protected(hex_text: Column) -> Column:
    """XOR-protected address: the first byte is the key of the others."""
    key = F.conv(F.substring(hex_text, 1, 2), 16, 10).cast("int")
    return F.when(
        F.length(hex_text) > 2,
        F.array_join(
            F.transform(
                F.sequence(F.lit(3), F.length(hex_text), F.lit(2)),
                lambda i: F.chr(
                    F.conv(F.substring(hex_text, i, F.lit(2)), 16, 10).cast("int").bitwiseXOR(key)
                ),
            ),
            "",
        ),
    ).otherwise(F.lit(""))
