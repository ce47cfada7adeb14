"""Token counts by a two-tier lookup of pre-token lengths, without shuffling pre-tokens."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sitecontacts.llm.common import batches, free_names

#: A pre-token is a run without ASCII white space: the vocabulary's splitter never crosses it and drops it.
#: Longer runs are encoded each time, so that no table or cache holds a long string.
_CACHED_BYTES = 64
#: Entries of one generation of a worker's cache; it keeps two.
_CACHE_ENTRIES = 400_000
#: The default vocabulary's splitter parts Latin letters from these marks after them, so that "word," is "word" and ",".
_MARKS = ".,;:!?"
#: How byte-level vocabularies spell bytes: printable Latin-1 as itself, the others in order from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTES = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def word_bpe() -> str:
    """Default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class RunCache(dict):
    """Tier two: what the tokenizer gives for a run, as UTF-8, kept per worker in bounded space.

    `value` turns the ids of a run into what is kept (a length, packed bytes), which must
    add up over the parts of a run. A file whose splitter joins letters with marks needs
    `marks` to be empty; one that keeps white space needs a splitter of its own. A look-up
    of a run that is not held encodes it; there are two generations of entries.
    """

    def __init__(self, path: str, value: Callable[[list[int]], Any], marks: str = _MARKS):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._value, self._marks, self._model = value, marks, self._tokenizer.model
        self.older: dict[bytes, Any] = {}

    def encode(self, run: str) -> Any:
        """Value of a run as the library gives it, special strings handled as its default."""
        return self._value(self._tokenizer.encode(run, add_special_tokens=False).ids)

    def _parted(self, run: str) -> Any:
        """Value of a run of Latin letters, marks after them aside; None for others.

        The default vocabulary is in lower case and its splitter parts letters from marks after
        them. Its steps before the merges leave small letters as they are, but for the spelling of
        their bytes, so these go straight to the merges. Small letters decide what a letter is:
        the capital I with a dot becomes two characters, of which the second is none.
        """
        core = run.rstrip(self._marks) if run[-1] in self._marks else run
        if not core.isalpha():
            return None
        if not core.isascii() and (max(core) >= "\u0250" or not core.lower().isalpha()):
            return None
        if core is not run:
            return self[core.encode()] + self[run[len(core):].encode()]
        if not run.islower():
            low = run.lower()
            return None if low == run else self[low.encode()]
        spelled = run if run.isascii() else run.encode().decode("latin-1").translate(_BYTES)
        return self._value([t.id for t in self._model.tokenize(spelled)])

    def __missing__(self, run: bytes) -> Any:
        got = self.older.get(run)
        if got is None:
            text = run.decode()
            got = self._parted(text) if self._marks else None
            if got is None:
                got = self.encode(text)
        if len(run) <= _CACHED_BYTES:
            if len(self) >= _CACHE_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[run] = got
        return got

    def values(self, text: str, first: dict[bytes, Any] | None = None) -> list[Any]:
        """Values of the runs of a text in order: from the first tier, else the cache, else the tokenizer."""
        runs = text.encode().split()  # bytes are split at ASCII white space only
        if first:
            get = first.get
            return [get(r) or self[r] for r in runs]
        return list(map(self.__getitem__, runs))


_CACHES: dict[tuple[str, str], RunCache] = {}


def worker_cache(path: str, kind: str, value: Callable[[list[int]], Any]) -> RunCache:
    """The cache of this Python worker, which outlives its tasks."""
    if (path, kind) not in _CACHES:
        _CACHES[path, kind] = RunCache(path, value, _MARKS if os.path.basename(path) == "word_bpe_49k.json" else "")
    return _CACHES[path, kind]


def frequent_runs(docs: DataFrame, text: str = "text", share: int = 16_384) -> DataFrame:
    """(run, n) of the runs that make at least 1 / `share` of some partition's runs.

    Every partition reads all its texts and keeps at most `share` counters: when there
    are eight times as many, the counts below the mean are let go (lossy counting). The
    shuffle carries at most `share` rows a partition, no matter how large the data.
    """
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()
        total = 0
        for frame in batches(frames, "text"):
            for body in frame["text"]:
                runs = body.encode().split()
                total += len(runs)
                seen.update(runs)
                if len(seen) > 8 * share:
                    least = sorted(seen.values())[-share]
                    seen = Counter({k: v for k, v in seen.items() if v > least})
        rows = [(k, v) for k, v in seen.items() if v * share >= total and len(k) <= _CACHED_BYTES]
        yield pd.DataFrame(rows, columns=["run", "n"]).astype({"n": "int64"})

    return (
        docs.select(F.col(text).cast("string").alias("text")).mapInPandas(count, "run binary, n bigint")
        .groupBy("run").agg(F.sum("n").alias("n"))
    )


def frequent_lengths(docs: DataFrame, text: str = "text", path: str | None = None, entries: int = 16_384) -> dict[bytes, int]:
    """Tier one: token counts of the `entries` most frequent runs, at most 64 bytes each (about 2 MB)."""
    rows = frequent_runs(docs, text).orderBy(F.desc("n"), "run").limit(entries).collect()
    cache = worker_cache(path or word_bpe(), "length", len)
    return {bytes(r.run): cache.encode(bytes(r.run).decode()) for r in rows}


def count_tokens(
    docs: DataFrame, text: str = "text", path: str | None = None, table: dict[bytes, int] | None = None, out: str = "n_tokens"
) -> DataFrame:
    """Add the number of tokens of every whole text.

    Null and empty texts have 0 tokens. Rows, also repeated ones, stay as they are; a
    taken name `out` is replaced. The table only saves work: any run outside it goes
    to the worker's cache and then to the tokenizer, so that counts never depend on it.
    """
    path = path or word_bpe()
    first = docs.sparkSession.sparkContext.broadcast(table if table is not None else frequent_lengths(docs, text, path))

    @F.pandas_udf("bigint")
    def lengths(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache, known = worker_cache(path, "length", len), first.value
        for part in parts:
            yield pd.Series([sum(cache.values(x, known)) if x else 0 for x in part], dtype="int64")

    return docs.withColumn(out, lengths(F.col(text).cast("string")))


def token_counts(docs: DataFrame, limit: int = 2048) -> DataFrame:
    """Digest per document: UTF-8 bytes, tokens and whether they exceed `limit`."""
    (n,) = free_names(docs, "n_tokens")
    return count_tokens(docs.select("doc_id", "text"), out=n).select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"),
        F.col(n).alias("n_tokens"), (F.col(n) > limit).alias("over_limit"),
    )
