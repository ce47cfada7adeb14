"""Periodic runs of words, found by recompression: a run-length grammar answers exact extensions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sitecontacts.llm.common import batches

_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")
#: Candidates that are looked at together.
_CHUNK = 1 << 20


def _named(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """The same small number for equal keys, in order of first occurrence."""
    codes, found = pd.factorize(keys)
    return codes.astype(np.int64), len(found)


class Level:
    """One sequence of the grammar and how the next one, up, is made of it."""

    def __init__(self, symbols: np.ndarray, blocks: bool):
        self.symbols, self.blocks = symbols, blocks
        self.first = self.up = self.child = self.size = None  # set when the next level is made

    def group(self, starts: np.ndarray) -> None:
        """starts: which symbols begin a symbol of the next level."""
        self.first = starts
        self.up = np.cumsum(starts) - 1
        self.child = np.nonzero(starts)[0]
        self.size = np.diff(np.append(self.child, len(starts)))


class Grammar:
    """Run-length grammar of many sequences by alternate block and pair compression.

    Level 0 is the concatenated sequences, each followed by a barrier, a symbol of its own that is
    never compressed, so that no extension leaves its sequence. An even level groups maximal blocks
    of one symbol, named by symbol and length. An odd level pairs a symbol of the left half with
    a following one of the right half; a symbol's half is a bit of its hash, so equal
    neighbourhoods are parsed alike wherever they stand. Names are exact: equal symbols of a
    level are equal strings. Levels end when every sequence is one symbol. A word takes about 200
    bytes in all levels together.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        n_words, ends = int(words.max(initial=-1)) + 1, np.cumsum(lengths)
        spread = np.empty(len(words) + len(lengths), np.int64)
        barrier = ends + np.arange(len(lengths))
        inner = np.ones(len(spread), bool)
        inner[barrier] = False
        spread[inner] = words
        spread[barrier] = n_words + np.arange(len(lengths))
        self.starts = barrier - lengths  # of each sequence, on level 0
        self.levels = [Level(spread, True)]
        self.width = [np.ones(len(spread), np.int64)]
        # pairs take a quarter of the symbols on average; what is left at the top is walked one by one
        for rounds in range(6 * int(np.ceil(np.log2(max(2, lengths.max())))) + 16):
            if int(inner.sum()) <= int((lengths > 0).sum()):
                break
            level = self.levels[-1]
            s = level.symbols
            fixed = ~inner
            begins = np.ones(len(s), bool)
            if level.blocks:
                begins[1:] = s[1:] != s[:-1]
            else:
                half = ((s.astype(np.uint64) + np.uint64(1 + rounds)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(61)) & np.uint64(1) == 1
                begins[1:] = ~(half[1:] & ~half[:-1] & ~fixed[1:] & ~fixed[:-1])
            level.group(begins)
            at, size = level.child, level.size
            low = s[at]
            if level.blocks:
                extra = size
            else:
                extra = np.where(size == 2, s[np.minimum(at + 1, len(s) - 1)] + 1, 0)
            codes, _ = _named(low * np.int64(max(int(extra.max()), int(s.max()) + 1) + 1) + extra)
            self.levels.append(Level(codes, not level.blocks))
            self.width.append(np.add.reduceat(self.width[-1], at))
            inner = inner[at]

    def _equal(self, level: int, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
        s = self.levels[level].symbols
        return s[a - 1] == s[b - 1] if back else s[a] == s[b]

    def extend(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """Length of the longest equal strings that start at boundaries i < j, or end there if `back`.

        A boundary is the number of the symbol after it. Equal neighbourhoods are parsed alike, so
        a pair of boundaries climbs after a step or two; where the symbols differ it goes down
        again, level by level. A block that one side enters in its midst is passed in one step.
        """
        total = np.zeros(len(i), np.int64)
        live, a, b = np.arange(len(i)), i.copy(), j.copy()
        stopped: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        top = len(self.levels) - 1
        for lv in range(top + 1):
            level, width = self.levels[lv], self.width[lv]
            if lv == top:
                climbing = np.zeros(len(live), bool)
            else:
                climbing = np.ones(len(live), bool)
            rest = []
            if lv < top:
                # pairs of boundaries that the next level has too climb; others step over an equal symbol
                todo = np.arange(len(live))
                for _ in range(3):
                    both = level.first[a[todo]] & level.first[b[todo]]
                    todo = todo[~both]
                    if not len(todo):
                        break
                    x, y = a[todo], b[todo]
                    same = self._equal(lv, x, y, back)
                    halt = todo[~same]
                    climbing[halt] = False
                    todo, x, y = todo[same], x[same], y[same]
                    if level.blocks:
                        # how far each side's block goes on
                        p, q = (x - 1, y - 1) if back else (x, y)
                        if back:
                            left_x, left_y = x - level.child[level.up[p]], y - level.child[level.up[q]]
                        else:
                            left_x = level.child[level.up[p]] + level.size[level.up[p]] - x
                            left_y = level.child[level.up[q]] + level.size[level.up[q]] - y
                        d = np.minimum(left_x, left_y)
                    else:
                        d = np.ones(len(todo), np.int64)
                    total[live[todo]] += d * width[(x - 1) if back else x]
                    a[todo] += -d if back else d
                    b[todo] += -d if back else d
                else:
                    both = level.first[a[todo]] & level.first[b[todo]]
                    climbing[todo[~both]] = False
            down = ~climbing
            stopped.append((live[down], a[down], b[down]))
            live, a, b = live[climbing], a[climbing], b[climbing]
            if lv < top:
                a, b = level.up[a], level.up[b]
            if not len(live):
                break
        # downwards: at each level, step over what is still equal
        live = a = b = np.empty(0, np.int64)
        for lv in range(len(stopped) - 1, -1, -1):
            more = stopped[lv]
            live, a, b = (np.concatenate([o, n]) for o, n in zip((live, a, b), more, strict=True))
            width = self.width[lv]
            todo = np.arange(len(live))
            while len(todo):
                todo = todo[self._equal(lv, a[todo], b[todo], back)]
                at = a[todo] - 1 if back else a[todo]
                total[live[todo]] += width[at]
                a[todo] += -1 if back else 1
                b[todo] += -1 if back else 1
            if lv:
                a, b = self.levels[lv - 1].child[a], self.levels[lv - 1].child[b]
        return total


def _candidates(lengths: np.ndarray, least_n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sequence, grid point, period) of neighbouring grid points k p and (k + 1) p, for all periods p, in chunks."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] >= least_n]
    size = lengths[order]
    p, last = 1, int(size[0]) // 2 if len(size) else 0
    while p <= last:
        # as many periods as fit a chunk, each over the sequences of at least two periods
        periods, owners, counts, made = [], [], [], 0
        while p <= last and made < _CHUNK:
            n = int(np.searchsorted(-size, -2 * p, side="right"))
            c = (size[:n] - 1) // p
            periods.append(np.full(n, p))
            owners.append(order[:n])
            counts.append(c)
            made += int(c.sum())
            p += 1
        count, period, owner = np.concatenate(counts), np.concatenate(periods), np.concatenate(owners)
        ends = np.cumsum(count)
        for low in range(0, made, 2 * _CHUNK):  # one period of very long sequences is more than a chunk
            high = min(low + 2 * _CHUNK, made)
            i, j = np.searchsorted(ends, low, side="right"), np.searchsorted(ends, high, side="left") + 1
            inside = np.minimum(ends[i:j], high) - np.maximum(ends[i:j] - count[i:j], low)
            which = np.repeat(np.arange(i, i + len(inside)), inside)
            yield owner[which], (np.arange(low, high) - (ends - count)[which]) * period[which], period[which]


def find_runs(sequences: list[list[int]], least: int = 12) -> list[np.ndarray]:
    """Per sequence the runs (start, length, period) by start, then period.

    A run is a maximal stretch of smallest period q and length of at least max(least, 2 q). It
    holds two neighbouring points of the grid of q, whose extensions by the grammar to both sides
    give its ends. A multiple of q gives the same stretch again, of which the smallest stays.
    """
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    words = np.fromiter((w for s in sequences for w in s), np.int64, int(lengths.sum()))
    none = [np.empty((0, 3), np.int64)] * len(sequences)
    if not (lengths >= least).any():
        return none
    grammar = Grammar(words, lengths)
    bottom = grammar.levels[0].symbols
    found = []
    for owner, point, period in _candidates(lengths, least):
        i = grammar.starts[owner] + point
        hit = bottom[i] == bottom[i + period]  # the first step of an extension
        # the equal stretch has at least six words, so one of the neighbours is equal too
        owner, i, period = owner[hit], i[hit], period[hit]
        after = bottom[i + 1] == bottom[i + period + 1]
        before = (i > 0) & (bottom[i - 1] == bottom[i + period - 1])
        hit = after | before
        owner, i, period = owner[hit], i[hit], period[hit]
        right = grammar.extend(i, i + period)
        left = grammar.extend(i, i + period, back=True)
        length = left + right + period
        hit = length >= np.maximum(least, 2 * period)
        found.append(np.stack([owner, i - left - grammar.starts[owner], length, period], 1)[hit])
    runs = np.concatenate(found) if found else np.empty((0, 4), np.int64)
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :3] != runs[:-1, :3]).any(1)
    runs = runs[new]
    runs = runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]
    cuts = np.searchsorted(runs[:, 0], np.arange(1, len(sequences)))
    return [part[:, 1:] for part in np.split(runs, cuts)]


def planted_words(words: list[str], doc_id: str | None) -> list[str]:
    """The words of the query: every tenth document, by a checksum of its id, ends periodically."""
    if doc_id is None or not words:
        return words
    h, n = crc32(doc_id.encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _collapsed(words: list[str], runs: np.ndarray) -> str:
    """The words without those after the first period of a run."""
    if not len(runs):
        return " ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return " ".join(w for w, c in zip(words, np.cumsum(edge), strict=False) if c == 0)


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = out = len(self)
        return out


def run_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 12, planted: bool = False) -> DataFrame:
    """(key, runs, collapsed): the periodic runs of every whole text, and its words without their repeats.

    `runs` is an array of (start, length, period) by start, then period, in words from 0.
    `collapsed` drops every word that some run holds after its first period. Null, empty and
    short texts have no runs; a null text collapses to "". A text of n words has about n ln n
    candidates, looked at in chunks, so memory grows with the longest text only. Rows are
    independent: repeated rows, null keys and extra columns (left aside) do no harm, and an
    empty table gives no rows. With `planted`, words are changed as `planted_words` says (a
    null key changes nothing).
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "text", 2_000_000):
            numbers = _Numbers()
            words = [_WORD.findall(t) for t in frame["text"]]
            if planted:
                words = [planted_words(w, k) for w, k in zip(words, frame["id"], strict=True)]
            runs = find_runs([[numbers[w] for w in ws] for ws in words], least)
            listed = [[{"start": s, "length": n, "period": p} for s, n, p in r.tolist()] for r in runs]
            yield pd.DataFrame({"id": frame["id"], "runs": listed, "collapsed": [_collapsed(w, r) for w, r in zip(words, runs, strict=True)]})

    # ids travel as text, since pandas would turn a column with a missing id into floats
    source = docs.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    out = source.mapInPandas(run, "id string, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return out.select(F.col("id").cast(docs.schema[key].dataType).alias(key), "runs", "collapsed")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Digest per document: its number of runs, the longest one, and hashes of all runs and of the collapsed words."""
    df = run_rows(docs, planted=True)
    # the longest; among equals the one that starts first, then of the smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    df = df.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("b"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return df.select(
        "doc_id", "n_runs", (-F.col("b.s")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.p")).alias("period"),
        F.expr("1000 * b.length div -b.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
