"""Header and footer regions of a page.

Pages whose only regions are plain, unnested <header>/<footer> elements are cut
with one regular expression. Nested elements and matches on id or class need the
open-element stack of an HTML reader; those pages, and only those, go through an
Arrow-batched function that returns offsets, not text.
"""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

# Element groups of the HTML standard that decide where an element ends.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
FORMATTING = frozenset(
    "a abbr b big cite code em font i label mark nobr q s small span strike strong sub sup "
    "time tt u var".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
SIBLING_LIMIT = {
    "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"},
    "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"},
}
SCOPE_LIMIT = frozenset({"table", "td", "th", "caption", "template", "html"})

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|iframe|xmp|noembed|noframes|textarea|title)"
    r"(?P<rawattrs>(?=[\s/>])[^>]*)>(?P<body>.*?)(?:</(?P=raw)\s*>|\Z)"
    r"|</(?P<close>[a-z][^\s/>]*)[^>]*>"
    r"|<(?P<open>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=|[\"'])*+)>",
    re.I | re.S,
)
_ID_OR_CLASS = re.compile(
    r"""(?:^|[\s"'/])(?:id|class)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I
)

REGIONS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("at", T.IntegerType()),
            T.StructField("len", T.IntegerType()),
        ]
    )
)


def find_regions(html: str) -> list[tuple[str, int, int]]:
    """(kind, offset, length) of the outermost header and footer regions of one page."""
    found: list[tuple[str, int, int]] = []
    stack: list[tuple[str, list[str], int]] = []
    inside = {"header": 0, "footer": 0}

    def kinds_of(name: str, attrs: str) -> list[str]:
        if "header" not in attrs and "footer" not in attrs:
            return [name] if name in inside else []
        values = " ".join(_ID_OR_CLASS.findall(attrs))
        return [k for k in inside if k == name or k in values]

    def leave(end: int) -> None:
        _, kinds, start = stack.pop()
        for kind in kinds:
            inside[kind] -= 1
            if inside[kind] == 0:
                found.append((kind, start, end - start))

    def leave_to(depth: int, end: int) -> None:
        while len(stack) > depth:
            leave(end)

    def innermost(names, limit) -> int | None:
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in names:
                return depth
            if stack[depth][0] in limit:
                return None
        return None

    for tag in _TAG.finditer(html):
        at = tag.start()
        if tag["raw"]:
            # the body of a script or style that matches itself counts as text
            for kind in kinds_of(tag["raw"].lower(), tag["rawattrs"]):
                found.append((kind, tag.start("body"), len(tag["body"])))
        elif tag["close"]:
            name = tag["close"].lower()
            if name in FORMATTING:
                depth = len(stack) - 1
                while depth >= 0 and stack[depth][0] != name and stack[depth][0] in FORMATTING:
                    depth -= 1
                if depth >= 0 and stack[depth][0] == name:
                    leave_to(depth, at)
            else:
                depth = innermost({name}, SCOPE_LIMIT - {name} if name not in (
                    "table", "tr", "tbody", "thead", "tfoot") else {"template", "html"})
                if depth is not None:
                    leave_to(depth, at)
        elif tag["open"]:
            name, attrs = tag["open"].lower(), tag["attrs"]
            if name in VOID:
                continue
            if name in CLOSES_P:
                depth = innermost({"p"}, SCOPE_LIMIT)
                if depth is not None:
                    leave_to(depth, at)
            if name in SIBLINGS:
                depth = innermost(SIBLINGS[name], SIBLING_LIMIT[name])
                if depth is not None:
                    leave_to(depth, at)
            kinds = kinds_of(name, attrs)
            stack.append((name, kinds, tag.end()))
            for kind in kinds:
                inside[kind] += 1
    leave_to(0, len(html))
    return sorted(found, key=lambda region: region[1])


def _batch_offsets(html: pd.Series) -> pd.Series:
    return html.map(
        lambda h: None if h is None
        else [{"kind": k, "at": a, "len": n} for k, a, n in find_regions(h)]
    )


def region_offsets(html: Column) -> Column:
    """Regions of the page as array<struct<kind, at, len>>; null stays null."""
    # executors need not have this package installed
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return F.pandas_udf(_batch_offsets, REGIONS)(html)


def has_region(html: Column) -> Column:
    """Quick test for header or footer elements, ids or classes."""
    return (
        F.contains(html, F.lit("header"))
        | F.contains(html, F.lit("footer"))
        | html.rlike(r"<(?i:header|footer)\b")
    )


def needs_stack(markup: Column) -> Column:
    """The page has regions that a plain expression cannot cut exactly.

    `markup` is the page without comments and scripts. Words that merely look like an
    id or class send a page to the exact way too, which costs time but no result.
    """
    tokens = F.lower(
        F.array_join(F.regexp_extract_all(markup, F.lit(r"</?+(?=[hHfF])(?i:header|footer)\b"), F.lit(0)), "")
    )
    plain = tokens.rlike(r"\A(?:<header</header|<footer</footer)*+\z")
    return ~plain | markup.rlike(
        r"[hf](?:(?<=h)eader|(?<=f)ooter)(?<![</](?:header|footer))(?>[^<>\"']*)[>\"']"
    )


def plain_region(html: Column, kind: str) -> Column:
    """Inner HTML of the plain elements of one kind, joined by a space; null where none begins."""
    inner = F.regexp_extract_all(
        html, F.lit(rf"<(?i:{kind})\b(?>[^>]*)>((?>[^<]*)(?:<(?!/(?i:{kind})\b)(?>[^<]*))*+)</(?i:{kind})\b"), F.lit(1)
    )
    return F.when(F.contains(F.lower(html), F.lit(f"<{kind}")), F.array_join(inner, " "))


def stacked_region(html: Column, regions: Column, kind: str) -> Column:
    """Inner HTML of the regions of one kind, cut by offset, joined by a space."""
    return F.array_join(
        F.transform(
            F.filter(regions, lambda r: r["kind"] == kind),
            lambda r: F.substring(html, r["at"] + 1, r["len"]),
        ),
        " ",
    )
