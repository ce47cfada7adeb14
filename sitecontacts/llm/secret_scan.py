"""Secrets in texts: fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sitecontacts.llm.common import batches

# Fixed patterns: letters of a key name in either case, ASCII only.
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharacterClass:
    """Candidate strings are runs of these characters; a window of `width` is a secret from `bits` on."""

    name: str
    characters: str
    width: int
    bits: float


#: Bits are Shannon entropy per character over the counts of one window. Random strings of a
#: class lie above them in 96 of 100 windows of that width and more.
CLASSES = (
    CharacterClass("hex", "0-9A-Fa-f", 16, 2.8),
    CharacterClass("base64", "A-Za-z0-9+/_=-", 16, 3.25),
)

# Parts of a run, between delimiters, that are no secrets although they look random.
_PLAIN = re.compile(
    r"(?:[A-Z]?[a-z]{2,})+[0-9]{0,4}"  # words, also joined by capitals, with a short number behind
    r"|[A-Za-z]?[a-z]*[0-9]+|[A-Z]+[0-9]*"  # numbers, with a word before; capitals
    r"|(?i:.*(?:example|placeholder|changeme|dummy|lorem).*)"
)
#: The allow-list: universally unique ids, and plain parts of two characters and more. What it matches parts candidates.
_ALLOWED = re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9A-Za-z])|[0-9A-Za-z]{2,}")

_ENDS = "/+=_-"
_UNIT = 1 << 40


def dense_windows(run: str, width: int, bits: float) -> Iterator[tuple[int, int]]:
    """(start, end) of the merged windows of `width` characters with at least `bits` bits per character.

    The sum of c * log2(c) over the counts of a window is kept up to date while it slides:
    two counts change per step, so a run costs its length, whatever the width. The terms
    are whole numbers of 2 ** -40 bits, so that no error builds up along a run.
    """
    terms = [0] + [round(c * math.log2(c) * _UNIT) for c in range(1, width + 2)]
    counts: dict[str, int] = {}
    total, start, end = 0, None, 0
    limit = round(width * (math.log2(width) - bits) * _UNIT) + width
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += terms[c + 1] - terms[c]
        if i >= width:
            old = run[i - width]
            c = counts[old]
            counts[old] = c - 1
            total += terms[c - 1] - terms[c]
        if i >= width - 1 and total <= limit:
            if start is not None and i - width + 1 > end:
                yield start, end
                start = None
            if start is None:
                start = i - width + 1
            end = i + 1
    if start is not None:
        yield start, end


_RUNS = [(c, re.compile(f"(?<![{c.characters}])[{c.characters}]{{{c.width},}}")) for c in CLASSES]


def candidates(run: str, width: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches of a run, of `width` characters and more, that hold nothing the allow-list knows.

    Parts of a run end at / + = _ and -, which stretches neither begin nor end with. A part is allowed as a whole or not at all, and hides itself only.
    """
    cuts = [m.span() for m in _ALLOWED.finditer(run) if "-" in m[0] or _PLAIN.fullmatch(m[0])]
    for start, end in zip([0, *[b for _, b in cuts]], [*[a for a, _ in cuts], len(run)], strict=True):
        inner = run[start:end].rstrip(_ENDS)
        end = start + len(inner)
        start = end - len(inner.lstrip(_ENDS))
        if end - start >= width:
            yield start, end


def spans_of(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, entropy spans) of a whole text as (start, end, kind), sorted.

    An entropy span that lies inside a base span or an earlier entropy span is suppressed, and so
    is one that is plain as a whole; base spans always stay. Letters of one case alone, and strings
    of fewer than 16 characters, are left to the base patterns.
    """
    base = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    base += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    base += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    base.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    added: list[tuple[int, int, str]] = []
    for kind, pattern in _RUNS:
        for m in pattern.finditer(text):
            for low, high in candidates(m[0], kind.width):
                for start, end in dense_windows(m[0][low:high], kind.width, kind.bits):
                    if not _PLAIN.fullmatch(m[0][low + start: low + end]):
                        added.append((m.start() + low + start, m.start() + low + end, "entropy"))
    out: list[tuple[int, int, str]] = []
    covered = at = 0  # ends of base spans up to the start, of the last added one
    for span in sorted(set(added), key=lambda s: (s[0], -s[1])):
        while at < len(base) and base[at][0] <= span[0]:
            covered = max(covered, base[at][1])
            at += 1
        if span[1] > covered:
            out.append(span)
            covered = span[1]
    return base, out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def secret_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_assign, n_access, n_hex, n_entropy, base_sha256, spans.

    Offsets count code points, ends are exclusive; spans are listed by start, then kind.
    Null and empty texts have no spans (an empty string, and the hash of one). Repeated rows
    stay, a null key stays null, extra columns are left aside, an empty table gives no rows.
    """
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "text"):
            rows = []
            for body in frame["text"]:
                base, added = spans_of(body)
                n = [sum(s[2] == kind for s in base) for kind in KINDS[:3]]
                spans = sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))
                rows.append((*n, len(added), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])
            yield out.assign(id=frame["id"])

    shape = "id string, n_assign bigint, n_access bigint, n_hex bigint, n_entropy bigint, base_sha256 string, spans string"
    found = docs.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text")).mapInPandas(scan, shape)
    return found.select(F.col("id").cast(docs.schema[key].dataType).alias(key), *found.columns[1:])
