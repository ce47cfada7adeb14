"""Evidence extraction: one captured page in, its published addresses out.

All channels of a page are computed in one pass over the scan and leave it as one
array, so the page text never crosses a shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from sitecontacts import options as opt
from sitecontacts.functions import text as tx, urls as ur
from sitecontacts.functions.columns import let, reuse
from sitecontacts.operators import regions as rg
from sitecontacts.options import Options

_RAW_ELEMENTS = "style|noscript|iframe|xmp|noembed|noframes|textarea|title"
# Only a "<" before one of these characters may begin a part that is cut out.
_MAY_CUT = "[!sSnNiIxXtT]"
# Runs are taken as a whole up to the next character that may end them.
_COMMENT = "!--(?>[^-]*)(?:-(?!->)(?>[^-]*))*+(?:-->)?+"


def _up_to(close: str) -> str:
    """Everything before a closing tag, or the rest of the page."""
    return rf"(?>[^<]*)(?:<(?!{close})(?>[^<]*))*+"


_SAME_CLOSE, _SCRIPT_CLOSE = r"/(?i:\1)(?=[\s/>])", r"/(?i:script)(?=[\s/>])"
# Parts of a page that hold no elements: comments and raw-text elements.
_NO_MARKUP = (
    rf"<(?={_MAY_CUT})(?:{_COMMENT}|((?i:script|{_RAW_ELEMENTS}))(?=[\s/>]){_up_to(_SAME_CLOSE)}(?:<{_SAME_CLOSE})?+)"
)
_SCRIPT_BODY = (
    rf"<(?={_MAY_CUT})(?:{_COMMENT}|((?i:{_RAW_ELEMENTS}))(?=[\s/>]){_up_to(_SAME_CLOSE)}(?:<{_SAME_CLOSE})?+"
    rf"|(?i:script)(?=[\s/>])[^>]*+>({_up_to(_SCRIPT_CLOSE)})(?:<{_SCRIPT_CLOSE})?+)"
)
_BODY_START = r"<(?:/(?i:head)\s*>|(?i:body)\b[^>]*>)"

_VALUE = r"\"[^\"]*+\"|'[^']*+'|[^\s>\"']++[^\s>]*+"
_ATTRIBUTE = rf"[\s/]*+[^\s/>=]++(?:\s*+=\s*+(?:{_VALUE}))?+"

# Links in a row whose attributes and text hold no address, reference or mark of a channel.
_BARE_VALUE = r"[^\"<>&@#]*\""
_BARE_LINKS = (
    rf"(?:<a(?: (?:href=\"(?!mailto:)#?|(?:class|id|title|target|rel)=\"){_BARE_VALUE})*+>[^<>&@]*</a>\s*+)++"
)
_LINK_STAND_IN = "<br>"
# A stand-in inside an attribute value, where the quotes of a link had ended the value.
_QUOTED_STAND_IN = rf"=\s*+(?:\"[^\"]*{_LINK_STAND_IN}|'[^']*{_LINK_STAND_IN})"

# Keeps matches of one script or meta value from running into the next one.
_GAP = "\x01"

_PROTECTED_NAME = r"-[cC][fF][eE][mM][aA][iI][lL]"

_TEXT_CHANNELS = {"text", "text_spelled_out"}
_SCRIPT_CHANNELS = {"script", "script_spelled_out", "script_base64"}
_LINK_CHANNELS = {"protected_link", "mailto"}
_REGION_CHANNELS = {"header", "footer"}
_LINK_MARKS = ("mailto:", "email-protection#")
_EVIDENCE = "array<struct<email:string,channel_ord:int,pos:int>>"


def attribute_values(markup: Column, element: str, attribute: str, marks: tuple = ()) -> Column:
    """Values of an attribute on every matching element, in page order, references decoded.

    With `marks`, values that hold none of these texts may be left out; a tag without a mark
    or a reference is not taken apart.
    """
    # a tag's attributes are taken as a whole, however many, then read one by one
    tags = F.regexp_extract_all(
        markup, F.lit(rf"(?s)<(?i:{element})(?=[\s/])((?:{_ATTRIBUTE})*+)"), F.lit(1)
    )
    if marks:
        tags = F.filter(tags, lambda t: _holds(t, "&", *marks))
    # most tags write it in quotes without references, after others written so
    simple = rf"\A(?:\s++(?!(?i:{attribute})=)[A-Za-z-]++=\"[^\"]*+\")*+\s++(?i:{attribute})=\"([^\"&]++)\""

    def value(tag: Column) -> Column:
        found = F.filter(
            F.regexp_extract_all(tag, F.lit(rf"(?s){_ATTRIBUTE}"), F.lit(0)),
            lambda a: a.rlike(rf"\A[\s/]*+(?i:{attribute})\s*+="),
        )
        written = let(found, lambda a: F.when(F.size(a) > 0, F.regexp_extract(a[0], rf"(?s)\A[^=]*+=\s*+({_VALUE})", 1)))
        return let(
            written,
            lambda v: tx.decode_references(
                F.when(v.rlike(r"\A[\"']"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
            ),
        )

    values = F.transform(
        tags,
        lambda t: let(
            F.regexp_extract(t, simple, 1),
            lambda v: F.when(v != "", v).when(t.rlike(rf"(?i)(?<![^\s/\"']){attribute}\s*+="), value(t)),
        ),
    )
    return F.filter(values, lambda v: v.isNotNull())


def without_bare_links(html: Column) -> Column:
    """The page with a line break for links in a row that can hold no evidence of any channel but script and spelled-out text.

    Tags become spaces in text, and neither a closed link without tags inside nor a line break
    changes which elements are open, so addresses and their order stay. Where a link seems
    to stand inside an attribute value the page stays whole.
    """
    return let(
        F.regexp_replace(html, _BARE_LINKS, _LINK_STAND_IN),
        lambda r: F.when(r.rlike(_QUOTED_STAND_IN), html).otherwise(r),
    )


def markup_of(html: Column) -> Column:
    """The page without comments and raw-text elements."""
    return F.regexp_replace(html, _NO_MARKUP, " ")


def script_text(html: Column) -> Column:
    """Bodies of the page's scripts, numeric references decoded."""
    bodies = F.filter(
        F.regexp_extract_all(html, F.lit(_SCRIPT_BODY), F.lit(2)), lambda b: b != ""
    )
    return tx.decode_numeric_entities(F.array_join(bodies, _GAP))


def body_text(html: Column) -> Column:
    """Text of the page body; a missing body or end tag is read as a browser reads it."""
    def after_head(page: Column) -> Column:
        inner = F.regexp_extract(page, rf"(?s){_BODY_START}(.*)", 1)
        no_body = F.regexp_replace(page, r"(?is)<title\b.*?(?:</title\s*>|\z)", " ")
        return let(inner, lambda i: F.when((i != "") | page.rlike(_BODY_START), i).otherwise(no_body))

    body = let(tx.drop_scripts(html), after_head)
    return tx.tagless_text(body)


def page_title(html: Column) -> Column:
    title = F.regexp_extract(html, rf"<(?i:title)\b[^>]*+>({_up_to('/(?i:title)')})", 1)
    return F.trim(F.regexp_replace(tx.decode_references(title), r"\s+", " "))


def _holds(text: Column, *marks: str) -> Column:
    """The text holds one of the marks."""
    return reduce(or_, [F.contains(text, F.lit(m)) for m in marks])


def _may_hold_address(html: Column) -> Column:
    return _holds(html, "@", "&#", "&commat;")


def _may_spell_out(html: Column) -> Column:
    spelled = (
        F.contains(F.lower(html), F.lit("dot"))
        & html.rlike(r"[dD][oO][tT](?![A-Za-z0-9])")
        & html.rlike(r"[aA][tT](?![A-Za-z0-9])(?<![A-Za-z0-9]..)")
    )
    return spelled | F.contains(html, F.lit("&#"))  # the words may be written as references


def _may_encode(html: Column) -> Column:
    """Quick test for references that may stand for a character of a link's mark."""
    return _holds(html, "&") & html.rlike(
        "&(?!(?:amp|nbsp|quot|lt|gt|copy|reg|laquo|raquo|mdash|ndash|hellip);)[#A-Za-z]"
    )


def _may_protect(html: Column) -> Column:
    """Quick test for the protected-address attribute, whose name may be in any case."""
    return _holds(html, "-cf", "-CF", "-Cf", "-cF") & html.rlike(_PROTECTED_NAME)


def with_evidence(
    pages: DataFrame, options: Options = Options(), channels: list[str] | None = None
) -> DataFrame:
    """Add `evidence`, the valid addresses of the page, and drop nothing else.

    evidence: array<struct<email, channel_ord, pos>>, in channel and page order.
    """
    wanted = frozenset(channels or opt.CHANNEL_NAMES)
    stages = _extraction_stages(wanted, tuple(options.exclude_words))
    staged = pages
    for step in stages:
        staged = staged.withColumns(step)
    work = [name for step in stages for name in step if name != "evidence"]
    return staged.drop(*work)


@reuse
def _extraction_stages(wanted: frozenset, exclude_words: tuple) -> list[dict[str, Column]]:
    """Columns to add to `html`, step by step; each step reads earlier ones once computed."""
    html, core, markup = F.col("html"), F.col("_core"), F.col("_markup")
    at, dot = F.col("_at"), F.col("_dot")
    tests: dict[str, Column] = {
        "_at": _may_hold_address(html),
        "_dot": _may_spell_out(html) if wanted & {"text_spelled_out", "script_spelled_out"} else F.lit(False),
    }
    # spelled-out addresses may begin or end in the text of a link, and scripts may hold links as text
    whole = {"_core": F.when(at & ~dot, without_bare_links(html)).otherwise(html)}
    cores: dict[str, Column] = {}
    parts: dict[str, Column] = {}
    links: dict[str, Column] = {}
    lists: dict[str, Column] = {}

    if wanted - _TEXT_CHANNELS - _SCRIPT_CHANNELS:
        # whatever a page's markup holds without a blank, the page holds as well; links that were left out hold no mark
        cores["_protects"] = _may_protect(core)
        cores["_links"] = _holds(core, *_LINK_MARKS) | _may_encode(core)
        parts["_markup"] = F.when(at | F.col("_protects") | F.col("_links"), markup_of(core))
    if "protected_attr" in wanted:
        lists["protected_attr"] = F.when(
            F.col("_protects") & _may_protect(markup),
            F.transform(
                attribute_values(markup, r"[a-z][^\s/>]*+", "data-cfemail"), tx.decode_protected
            ),
        )
    if wanted & _LINK_CHANNELS:
        worth = F.col("_links") & (_holds(markup, *_LINK_MARKS) | _may_encode(markup))
        links["_hrefs"] = F.when(worth, attribute_values(markup, "a", "href", _LINK_MARKS))
        hrefs = F.col("_hrefs")
        lists["protected_link"] = F.transform(
            F.filter(hrefs, lambda h: F.contains(h, F.lit("/cdn-cgi/l/email-protection#"))),
            lambda h: tx.decode_protected(
                F.regexp_extract(h, r"/cdn-cgi/l/email-protection#([a-fA-F0-9]+)", 1)
            ),
        )
        lists["mailto"] = F.filter(hrefs, lambda h: F.startswith(h, F.lit("mailto:")))
    if "meta" in wanted:
        contents = F.array_join(attribute_values(markup, "meta", "content"), _GAP)
        lists["meta"] = F.when(
            at & _holds(markup, "<m", "<M"), tx.find_emails(tx.decode_numeric_entities(contents))
        )
    if wanted & _REGION_CHANNELS:
        parts["_region"] = F.when(at, rg.has_region(core))
        links["_hard"] = F.when(F.col("_region"), rg.needs_stack(markup))
    if wanted & _SCRIPT_CHANNELS:
        parts["_scripts"] = F.when(_holds(core, "<s", "<S"), script_text(html))
        scripts = F.col("_scripts")
        lists["script"] = F.when(at, tx.find_emails(scripts))
        lists["script_spelled_out"] = F.when(dot, tx.find_spelled_out(scripts))
        lists["script_base64"] = tx.find_base64(scripts)
    if wanted & _TEXT_CHANNELS:
        parts["_body"] = F.when(at | dot, body_text(core))
        body = F.col("_body")
        lists["text"] = F.when(at, tx.find_emails(body))
        lists["text_spelled_out"] = F.when(dot, tx.find_spelled_out(body))

    def numbered(ordinal: int, found: Column) -> Column:
        return F.transform(
            F.coalesce(found, F.array().cast("array<string>")),
            lambda raw, i: F.struct(
                raw.alias("raw"), F.lit(ordinal).alias("channel_ord"), i.alias("pos")
            ),
        )

    def sightings(names: list[str]) -> Column:
        """Valid addresses of some channels, in channel and page order."""
        found = F.concat(*[numbered(o, lists[name]) for o, name, _, _, _ in opt.CHANNELS if name in names])
        cleaned = F.transform(
            found, lambda e: e.withField("raw", tx.normalize_email(e["raw"]))
        ).cast(_EVIDENCE)
        return F.filter(cleaned, lambda e: tx.is_valid_email(e["email"], exclude_words))

    order = [name for name in opt.CHANNEL_NAMES if name in wanted]
    kinds = [name for name in order if name in _REGION_CHANNELS]
    if not kinds:
        return [step for step in (tests, whole, cores, parts, links, {"evidence": sightings(order)}) if step]

    # Rows that pass the function of the regions hold the text of those pages only that need it.
    hard, settled, offsets = F.col("_hard"), {}, {}
    first = order.index(kinds[0])
    for name, channels in (("_before", order[:first]), ("_after", order[first + len(kinds):])):
        if channels:
            settled[name] = sightings(channels)
    for kind in kinds:
        plain = F.when(F.col("_region") & ~hard, rg.plain_region(core, kind))
        settled[f"_{kind}"] = _region_emails(plain)
    settled["_stacked"] = F.when(hard, core)
    offsets["_offsets"] = rg.region_offsets(F.col("_stacked"))
    for kind in kinds:
        stacked = rg.stacked_region(F.col("_stacked"), F.col("_offsets"), kind)
        # two uses of a column keep its expression where it is
        lists[kind] = F.when(F.col("_stacked").isNotNull(), _region_emails(stacked)).when(
            F.size(F.col(f"_{kind}")) > 0, F.col(f"_{kind}")
        )
    joined = [
        F.when(F.size(F.col(name)) > 0, F.col(name)).otherwise(F.array().cast(_EVIDENCE))
        for name in ("_before", "_after") if name in settled
    ]
    joined.insert(1 if "_before" in settled else 0, sightings(kinds))
    return [tests, whole] + [step for step in (cores, parts, links, settled, offsets) if step] + [{"evidence": F.concat(*joined)}]


def _region_emails(inner: Column) -> Column:
    """Addresses of a region; a text without these characters has none."""
    return let(inner, lambda t: F.when(_holds(t, "@", "&"), tx.find_emails(tx.spaced_text(t))))


def _channel_value(ordinal: Column, index: int) -> Column:
    """Source type, obfuscation method or confidence of a channel number."""
    kind = "int" if index == 4 else "string"
    return F.element_at(F.array(*[F.lit(c[index]).cast(kind) for c in opt.CHANNELS]), ordinal)


def channel_source(ordinal: Column) -> Column:
    return _channel_value(ordinal, 2)


def channel_obfuscation(ordinal: Column) -> Column:
    return _channel_value(ordinal, 3)


def channel_confidence(ordinal: Column) -> Column:
    return _channel_value(ordinal, 4)


def explode_evidence(pages_with_evidence: DataFrame) -> DataFrame:
    """One row per sighting; pages without addresses leave no row."""
    kept = [c for c in pages_with_evidence.columns if c not in ("html", "evidence")]
    # the outer form keeps the optimiser from repeating the extraction in an inferred filter
    rows = pages_with_evidence.select(*kept, F.explode_outer("evidence").alias("e"))
    return rows.where("e.email is not null").select(*kept, "e.email", "e.channel_ord", "e.pos")


def describe_evidence(rows: DataFrame) -> DataFrame:
    """Spell out source, method, class and confidence of sightings."""
    source = channel_source(F.col("channel_ord"))
    obf = channel_obfuscation(F.col("channel_ord"))
    return rows.select(
        "*",
        source.alias("source_type"),
        obf.alias("obf_method"),
        channel_confidence(F.col("channel_ord")).alias("confidence"),
        tx.email_type(F.col("email")).alias("email_type"),
        ur.evidence_method(source, obf, F.col("url")).alias("discovery_method"),
    )


def extract_evidence(
    pages: DataFrame,
    options: Options = Options(),
    channels: list[str] | None = None,
    with_title: bool = False,
) -> DataFrame:
    """pages(page_id, url, html, ...) to evidence rows, all channels or the named ones.

    `with_title` adds the page's title to every row.
    """
    if with_title:
        pages = pages.withColumn("page_title", page_title(F.col("html")))
    return describe_evidence(explode_evidence(with_evidence(pages, options, channels)))


# A sighting's rank on its page as one long: higher confidence, then earlier
# channel, then earlier position. Longs keep the aggregation hash-based.
_POS_SPAN = 10**10


def sighting_order(channel_ord: Column, pos: Column) -> Column:
    return channel_ord.cast("bigint") * F.lit(_POS_SPAN) + pos.cast("bigint")


def dedupe_page_emails(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Best sighting of every address on every page, and the order of the first one.

    Rows need channel_ord and pos; `keys` name the page columns to keep.
    """
    keys = keys or [c for c in ("page_id", "url") if c in rows.columns]
    order = sighting_order(F.col("channel_ord"), F.col("pos"))
    rank = channel_confidence(F.col("channel_ord")).cast("bigint") * F.lit(100 * _POS_SPAN) + (
        F.lit(100 * _POS_SPAN - 1) - order
    )
    best = rows.groupBy(*keys, "email").agg(F.max(rank).alias("_best"), F.min(order).alias("first_order"))
    best_order = F.lit(100 * _POS_SPAN - 1) - F.col("_best") % F.lit(100 * _POS_SPAN)
    return best.select(
        *keys,
        "email",
        F.floor(best_order / F.lit(_POS_SPAN)).cast("int").alias("channel_ord"),
        "first_order",
    )
