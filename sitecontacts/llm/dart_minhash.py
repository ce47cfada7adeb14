"""Near-duplicate documents by DartMinHash signatures and banded joins."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sitecontacts.llm.common import batches
from sitecontacts.llm.components import components
from sitecontacts.plans.lineage import materialize

_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")
_CACHE_ENTRIES = 400_000
_A, _B, _G = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= _CACHE_ENTRIES:
            self.clear()
        out = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self[word] = out
        return out


def shingles(texts: list[str], hashes: dict[str, int], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of every run of `size` words, repeats included, in text order.

    A text of fewer words has one shingle of all its words; one without words has none.
    """
    words = [_WORD.findall(t) for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter((hashes[w] for ws in words for w in ws), np.uint64, int(lengths.sum()))
    owner = np.repeat(np.arange(len(words)), lengths)
    if len(h) >= size:
        x = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            x = _mix(x * _G + h[k: len(h) - size + 1 + k])
        whole = owner[: len(x)] == owner[size - 1:]
        owner, x = owner[: len(x)][whole], x[whole]
    else:
        owner, x = owner[:0], h[:0]
    short = np.nonzero((lengths > 0) & (lengths < size))[0]
    if len(short):
        starts = np.cumsum(lengths) - lengths
        folded = [reduce(lambda a, b: _mix(a * _G + b), h[starts[i]: starts[i] + lengths[i]].reshape(-1, 1)) for i in short]
        owner, x = np.concatenate([owner, short]), np.concatenate([x, np.concatenate(folded)])
    order = np.argsort(owner, kind="stable")
    return owner[order], x[order]


def dart_signatures(owner: np.ndarray, x: np.ndarray, n: int, k: int) -> np.ndarray:
    """An n by k matrix: per text and coordinate the id of its earliest dart. Every text must own a shingle.

    An element of weight w owns w unit cells; into each, darts fall as a Poisson process
    along the time axis, all derived from the element's hash. A text takes the darts of
    its cells up to a time that makes about k ln k + 2 k of them, and keeps the earliest
    per coordinate; where a coordinate got none, the time is doubled. Two texts agree in
    a coordinate with the probability of their weighted Jaccard similarity.
    """
    order = np.lexsort((x, owner))
    owner, x = owner[order], x[order]
    new = np.ones(len(x), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (x[1:] != x[:-1])
    at = np.arange(len(x))
    layer = at - np.maximum.accumulate(np.where(new, at, 0))
    cells = _mix(_mix(x) + layer.astype(np.uint64) * _G)
    weight = np.bincount(owner, minlength=n)
    out, todo = np.zeros((n, k), np.uint64), np.ones(n, bool)
    until = (k * np.log(k) + 2 * k) / np.maximum(weight, 1)
    while todo.any():
        live = todo[owner]
        doc, cell = owner[live], cells[live]
        time, step, found = np.zeros(len(doc)), 0, []
        while len(doc):
            step += 1
            u = _mix(cell + np.uint64(step * int(_A) & (2**64 - 1)))
            time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53)
            hit = time <= until[doc]
            doc, cell, time, u = doc[hit], cell[hit], time[hit], u[hit]
            found.append((doc, time, _mix(u ^ _G)))
        doc, time, dart = (np.concatenate(part) for part in zip(*found, strict=True))
        slot = doc * k + (dart % np.uint64(k)).astype(np.int64)
        late = np.lexsort((dart, time))[::-1]  # the last write to a slot is its earliest dart
        flat, full = out.reshape(-1), np.zeros(n * k, bool)
        flat[slot[late]] = dart[late]
        full[slot] = True
        todo &= ~full.reshape(n, k).all(axis=1)
        until = np.where(todo, until * 2, until)
    return out


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per text and band; keys of different bands differ."""
    n, k = signatures.shape
    parts = signatures.reshape(n, bands, k // bands)
    key = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64) * _G), (n, bands)).copy()
    for r in range(k // bands):
        key = _mix(key * _G + parts[:, :, r])
    return key.view(np.int64)


def _signed(docs: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """(id, hi, lo, keys) of every document with a word; hi and lo are a fingerprint of its words."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        hashes = _WordHashes()
        for frame in batches(frames, "text", 4_000_000):
            words = [" ".join(_WORD.findall(t)) for t in frame["text"]]
            keep = np.array([bool(w) for w in words], bool)
            if not keep.any():
                continue
            texts = [w for w in words if w]
            owner, x = shingles(texts, hashes, size)
            keys = band_keys(dart_signatures(owner, x, len(texts), bands * rows), bands)
            prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts), "<i8").reshape(-1, 2)
            yield pd.DataFrame({"id": frame["id"][keep].to_numpy(), "hi": prints[:, 0], "lo": prints[:, 1], "keys": list(keys)})

    return docs.mapInPandas(run, "id bigint, hi bigint, lo bigint, keys array<bigint>")


def multiset_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two multisets given as sorted arrays."""
    both = np.concatenate([a, b])
    values, inverse = np.unique(both, return_inverse=True)
    ca = np.bincount(inverse[: len(a)], minlength=len(values))
    cb = np.bincount(inverse[len(a):], minlength=len(values))
    shared = int(np.minimum(ca, cb).sum())
    return shared / (len(both) - shared) if len(both) else 0.0


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """Pairs (a, b) whose texts reach the similarity, computed on all their shingles."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, recent = _WordHashes(), (None, None)
        for frame in frames:
            hits = []
            for a, b, ta, tb in zip(frame["a"], frame["b"], frame["ta"], frame["tb"], strict=True):
                if recent[0] != tb:  # the rows of one pivot follow each other
                    recent = (tb, np.sort(shingles([tb], hashes, size)[1]))
                if multiset_jaccard(np.sort(shingles([ta], hashes, size)[1]), recent[1]) >= similarity:
                    hits.append((a, b))
            yield pd.DataFrame(hits, columns=["a", "b"]).astype("int64")

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInPandas(run, "a bigint, b bigint")


def _numbered(x: np.ndarray) -> np.ndarray:
    """Shingles of one text as a set: the k-th repeat of a shingle is an element of its own."""
    x = np.sort(x)
    at = np.arange(len(x))
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    layer = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(layer > 0, _mix(x + layer.astype(np.uint64) * _G), x).view(np.int64)


def _across(rows: DataFrame, groups: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """Links between members (id, key) of buckets that are not yet in one component.

    Two sets of similarity s share an element among the first n - ceil(s n) + 1 of each, in any order
    that all sets follow; here rare elements come first, so that members that are alike, but not
    enough, seldom meet. Only members of buckets with several components take part. An element's
    members of its largest component never meet each other, only the others do. Pairs of which one
    set is too small for the other, or that have too little left from a shared element on, are
    left out; the rest are checked on all elements.
    """
    rows = rows.join(groups.withColumnsRenamed({"node": "id"}), "id", "left").select(
        "id", "key", F.coalesce("component", "id").alias("c")
    )
    apart = rows.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("key")
    members = rows.join(apart, "key", "left_semi").select("id", "c").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for frame in frames:
            sets = [_numbered(shingles([t], hashes, size)[1]) for t in frame["text"]]
            yield pd.DataFrame({"id": frame["id"], "c": frame["c"], "s": sets})

    # the versions of an id that stands in several rows are sets of their own
    sets = materialize(texts.join(members, "id").select("id", "c", "text").mapInPandas(run, "id bigint, c bigint, s array<bigint>")).withColumn(
        "u", F.xxhash64("id", "s")
    )
    elements = sets.select("id", "u", "c", F.size("s").alias("n"), F.explode("s").alias("e"))
    several = elements.withColumn("f", F.count("*").over(Window.partitionBy("e"))).filter("f > 1")
    by_rarity = Window.partitionBy("u").orderBy("f", "e")
    # elements of one set alone come first in its order and never meet another
    alone = F.col("n") - F.count("*").over(Window.partitionBy("u"))
    first = several.select("u", "c", "n", "e", (alone + F.row_number().over(by_rarity)).alias("place"))
    first = materialize(first.filter(F.col("place") <= F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1))
    largest = first.groupBy("e", "c").agg(F.count("*").alias("m")).groupBy("e").agg(
        F.max(F.struct("m", "c")).alias("l"), F.count("*").alias("parts")
    ).filter("parts > 1").select("e", F.col("l.c").alias("main"))
    mixed = first.join(largest, "e")
    other = mixed.filter("c <> main").select("e", *[F.col(x).alias(f"{x}1") for x in ("u", "c", "n", "place")])
    small, large = F.least("n", "n1"), F.greatest("n", "n1")
    # at the first element that two sets share, all they can share comes from there on
    most = F.least(F.col("n") - F.col("place"), F.col("n1") - F.col("place1")) + 1
    needed = F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("n1")) - 1e-9
    fits = (F.col("c") != F.col("c1")) & (small >= F.lit(similarity) * large - 1e-9) & (most >= needed)
    pairs = mixed.join(other, "e").filter(fits).select(F.least("u", "u1").alias("a"), F.greatest("u", "u1").alias("b")).distinct()
    left, right = (sets.select(F.col("u").alias(x), F.col("id").alias(f"{x}_id"), F.col("s").alias(f"{x}_s")) for x in "ab")
    shared = F.size(F.array_intersect("a_s", "b_s"))
    alike = shared >= F.lit(similarity) * (F.size("a_s") + F.size("b_s") - shared) - 1e-9
    return pairs.join(left, "a").join(right, "b").filter(alike).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def near_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, size: int = 5,
    bands: int = 24, rows: int = 5,
) -> DataFrame:
    """(key, class_id) per row: class_id is the smallest key among the document's near copies and itself.

    Documents link when the multisets of their `size`-word shingles have a Jaccard similarity of
    at least `similarity`, checked on whole texts; a class is a connected component of links.
    A pair of exactly 0.8 meets in a band with probability above 0.9999 by default. Texts
    without words (null, empty, white space) link with nothing. Rows that share a key count as
    one document and each get its class, so they all stay or go together; rows with a null key
    are not compared and have a null class. Extra columns are left aside; an empty table gives
    no rows.

    Texts of equal words are one node. In every bucket, members are checked against the
    member that shares most buckets, so a group of copies costs a pair per member. Members
    still apart after that meet by the rarest elements of their sets, which loses no pair of a bucket.
    """
    source = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    signed = materialize(_signed(source.filter("id is not null"), bands, rows, size))
    nodes = signed.groupBy("hi", "lo").agg(F.min("id").alias("node"))
    named = materialize(signed.join(nodes, ["hi", "lo"]).select("id", "node", F.when(F.col("id") == F.col("node"), F.col("keys")).alias("keys")).distinct())
    spread = named.filter("keys is not null").select(F.col("id"), F.explode("keys").alias("key")).distinct()
    crowded = spread.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    multi = materialize(spread.join(crowded, "key"))
    central = multi.groupBy("id").agg(F.sum("n").alias("w"))
    pivots = multi.join(central, "id").groupBy("key").agg(F.max(F.struct("w", "id")).alias("p")).select("key", F.col("p.id").alias("b"))
    spokes = materialize(multi.join(pivots, "key").filter("id <> b").select("id", "key", "b"))
    pairs = spokes.select(F.col("id").alias("a"), "b").distinct()
    texts = materialize(source.join(central.select("id"), "id", "left_semi").distinct())
    links = materialize(_verified(pairs, texts, similarity, size))
    groups = components(links)
    # a bucket's pivot has met all its members, so only the others can still miss a link
    more = materialize(_across(spokes.select("id", "key"), groups, texts, similarity, size))
    if not more.isEmpty():
        groups = components(links.unionByName(more))
    classes = named.select("id", "node").join(groups, "node", "left").groupBy("id").agg(F.min(F.coalesce("component", "node")).alias("class_id"))
    out = docs.select(F.col(key).alias("id")).join(classes, "id", "left")
    return out.select(F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"))


def minhash_dedup(docs: DataFrame) -> DataFrame:
    """Digest per document: its class and whether it is the one that stays."""
    return near_documents(docs).withColumn("kept", F.col("doc_id") == F.col("class_id"))
