"""License notices in texts by patience alignment with templates."""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sitecontacts.llm.common import batches

# Public license notices and the grants of public licenses.
TEMPLATES: Mapping[str, str] = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-3.0": "Licensed under CC BY 3.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "reserved": "All rights reserved.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Apache-grant": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Apache-2.0-short": "under the Apache 2.0 license",
    "GPL-2.0-short": "GNU GPL v2",
    "GPL-3.0-short": "GNU GPL v3",
    "AGPL-3.0-title": "GNU Affero General Public License Version 3",
    "LGPL-3.0-title": "GNU Lesser General Public License Version 3",
    "CC-BY-SA-text": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-ND-text": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    **{f"{name}-id": f"under {name}" for name in ("CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0")},
    **{f"SPDX-{name}": f"SPDX-License-Identifier: {name}" for name in (
        "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
        "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "Unlicense",
    )},
}
#: Words that name a license and its version: a notice has all of them, and may then lack one other word.
NAMING: Mapping[str, str] = {
    "MIT": "MIT License", "Apache-2.0": "Apache 2.0", "GPL-3.0": "GNU General Public 3", "GPL-2.0": "GNU General Public 2",
    "CC-BY-3.0": "CC BY 3.0", "CC-BY-4.0": "CC BY 4.0", "CC-BY-SA-4.0": "CC BY-SA 4.0", "CC-BY-NC-4.0": "CC BY-NC 4.0", "CC-BY-ND-4.0": "CC BY-ND 4.0",
    "CC-BY-text": "Creative Commons Attribution 4.0", "GPL-grant": "GNU General Public", "LGPL-grant": "GNU Lesser General Public",
    "AGPL-grant": "GNU Affero General Public", "MPL-2.0": "Mozilla 2.0", "Unlicense": "unencumbered public domain",
    "Apache-2.0-short": "Apache 2.0", "GPL-2.0-short": "GNU GPL 2", "GPL-3.0-short": "GNU GPL 3", "AGPL-3.0-title": "GNU Affero General Public 3",
    "LGPL-3.0-title": "GNU Lesser General Public 3", "CC-BY-SA-text": "Creative Commons Attribution-ShareAlike 4.0",
    "CC-BY-ND-text": "Creative Commons Attribution-NoDerivatives 4.0",
    **{name: text for name, text in TEMPLATES.items() if name.startswith("SPDX-")},
    **{name: name.removesuffix("-id") for name in TEMPLATES if name.endswith("-id")},
}
# Words too common to point to a notice.
_COMMON = frozenset("a all and any are as at be by can for free from has in is it may not of on or other that the this to under use with without work you".split())
#: A notice is none where one of these stands up to three words before it, in the same sentence.
_NEGATED = re.compile(r"(?i)\b(?:not|never|no longer)\b[^.!?;\n]*\Z")
_VERSION = re.compile(r"v?([0-9]+)(?:\.0)?")
_WORD = re.compile(r"[^\W_](?:[\w.+/-]*[^\W_])?")


def tokens_of(text: str) -> list[str]:
    """Words in lower case, without the punctuation around them."""
    return _WORD.findall(text.lower())


def _plain(words: list[str]) -> list[str]:
    """Words with versions written alike: 3 for v3, 3.0 and v3.0."""
    return [m[1] if (m := _VERSION.fullmatch(w)) else w for w in words]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions of equal words, increasing in both lists.

    Equal ends are taken off first. Words that are unique on both sides of what remains are
    anchors; their longest increasing subsequence is kept and every gap is aligned alike.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {b[j]: j for j in range(b0, b1) if nb[b[j]] == 1 and na[b[j]] == 1}
        anchors = _increasing([(i, at[a[i]]) for i in range(a0, a1) if a[i] in at])
        if anchors:
            ends = [*anchors, (a1, b1)]
            todo.append((a0, anchors[0][0], b0, anchors[0][1]))
            for (i, j), (i2, j2) in zip(anchors, ends[1:], strict=True):
                out.append((i, j))
                todo.append((i + 1, i2, j + 1, j2))
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence whose second members increase."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(tails, j)
        back.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


class Scanner:
    """Templates prepared for scanning; `coverage` is the least share of a template's words.

    Templates with naming words need all of these, and may always lack one other word.
    """

    def __init__(self, templates: Mapping[str, str] = TEMPLATES, coverage: float = 0.9):
        self.coverage = coverage
        self.templates = [(name, words, marks) for name, text in templates.items() if (words := tokens_of(text)) and (marks := self._marks(words))]
        self.naming = {name: frozenset(_plain(tokens_of(NAMING[name]))) if templates[name] == TEMPLATES.get(name) and name in NAMING else frozenset() for name in templates}
        self.any_mark = frozenset().union(*[m for _, _, m in self.templates])

    @staticmethod
    def _marks(words: list[str]) -> dict[str, int]:
        return {w: i for i, w in reversed(list(enumerate(words))) if w not in _COMMON} or {w: i for i, w in enumerate(words)}

    def regions(self, text: list[str], words: list[str], marks: dict[str, int]) -> Iterator[tuple[int, int]]:
        """Stretches of a text around a template's marks; a new one begins after a gap or where the template starts over.

        A stretch is widened by the template's words before and after its outer marks and
        two more, but never onto a mark of the stretch next to it.
        """
        gap, first = 4 + len(words) // 2, min(marks.values())
        found: list[list[int]] = []  # first and last mark in the text, and in the template
        for i, w in enumerate(text):
            at = marks.get(w)
            if at is None:
                continue
            if not found or i - found[-1][1] > gap or at + len(words) / 2 < found[-1][3] or at == first <= found[-1][3]:
                found.append([i, i, at, at])
            else:
                found[-1][1], found[-1][3] = i, at
        for k, (start, last, head, tail) in enumerate(found):
            low = found[k - 1][1] + 1 if k else 0
            high = found[k + 1][0] if k + 1 < len(found) else len(text)
            yield max(low, start - head - 2), min(high, last + len(words) - tail + 2)

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, template, coverage) of every notice in a whole text, in code points, sorted.

        Of notices that overlap, the one with the most aligned words stays; ties go to
        the higher coverage, then to the earlier template.
        """
        words = tokens_of(text)
        there = self.any_mark.intersection(words)
        if not there:
            return []
        # lower case can change lengths, so offsets come from the text itself
        spans = [m.span() for m in _WORD.finditer(text)]
        if len(spans) != len(words):
            words = [text[a:b].lower() for a, b in spans]
        found = []
        for order, (name, template, marks) in enumerate(self.templates):
            naming, plain = self.naming[name], _plain(template)
            least = min(self.coverage * len(template), len(template) - bool(naming))
            if sum(m in there for m in marks) < len(marks) - (len(template) - least) - bool(naming):  # a version may be written otherwise
                continue
            for start, end in self.regions(words, template, marks):
                pairs = patience(_plain(words[start:end]), plain)
                if pairs and len(pairs) >= least and naming <= {plain[j] for _, j in pairs}:
                    at = start + pairs[0][0]
                    if _NEGATED.search(text[spans[max(at - 3, 0)][0]: spans[at][0]]):
                        continue
                    cover = len(pairs) / len(template)
                    found.append((-len(pairs), -cover, order, spans[start + pairs[0][0]][0], spans[start + pairs[-1][0]][1], name))
        out: list[tuple[int, int, str, float]] = []
        for _, cover, _, a, b, name in sorted(set(found)):
            at = bisect.bisect_left(out, (b,))
            if not (at and out[at - 1][1] > a):
                out.insert(at, (a, b, name, -cover))
        return out


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: Mapping[str, str] = TEMPLATES, coverage: float = 0.9) -> DataFrame:
    """One row per document: key, n_licenses, licenses (`name:start:end`, comma-joined), best_coverage.

    Every whole text is searched; null and empty texts have none (empty string, coverage 0).
    Repeated rows stay, a null key stays null, extra columns are left aside, an empty table gives no rows.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, coverage)
        for frame in batches(frames, "text"):
            found = [scanner.scan(body) for body in frame["text"]]
            yield pd.DataFrame({
                "id": frame["id"], "n_licenses": [len(f) for f in found],
                "licenses": [",".join(f"{name}:{a}:{b}" for a, b, name, _ in f) for f in found],
                "best_coverage": [max([c for *_, c in f], default=0.0) for f in found],
            })

    got = docs.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text")).mapInPandas(
        run, "id string, n_licenses bigint, licenses string, best_coverage double"
    )
    return got.select(F.col("id").cast(docs.schema[key].dataType).alias(key), "n_licenses", "licenses", "best_coverage")
