"""Repeated byte strings by longest-previous-factor arrays over the suffixes around shared anchors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sitecontacts.plans.lineage import materialize

_A, _B, _G = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
#: Bytes of a batch that are scanned together.
_SCAN = 1 << 20
#: A place is the byte number of an anchor, shifted, then how many bytes its context holds before it and from it on.
_REACH = 10
_ROW = "kind bigint, key bigint, ctx bigint, did bigint, tie bigint, place bigint"
_ROW_NAMES = ["kind", "key", "ctx", "did", "tie", "place"]
#: Kinds of rows: an anchor, one whose gram is very frequent, a context whose equal stands earlier.
_PLAIN, _HOT, _COPY = range(3)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _G)
#: Base of the context hash and its inverse modulo 2^64.
_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every gram of `size` bytes, a power of two."""
    h, n, c = _BYTE[data], 1, _BASE
    while n < size:
        h = h[:-n] * np.uint64(c) + h[n:]
        n, c = 2 * n, c * c % (1 << 64)
    return _mix(h)


def _sliding(x: np.ndarray, width: int, best: Callable) -> np.ndarray:
    """Least or greatest of every `width` neighbours."""
    n = 1
    while 2 * n <= width:
        x, n = best(x[:-n], x[n:]), 2 * n
    return x if n == width else best(x[: len(x) - (width - n)], x[width - n:])


def anchors(texts: list[bytes], match: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, byte number, bytes before, bytes from it on, gram hash, context hash) of all anchors.

    A gram is an anchor if its hash is the least of a string of `match` bytes around it. So
    every such string holds one, at the same place wherever it stands. The context of an anchor
    is what such strings can reach: `match - gram` bytes before it and `match` from it on.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    n, width = len(data), match - gram + 1
    if n < match:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    owner = np.repeat(np.arange(len(texts)), lengths)
    begin = np.cumsum(lengths) - lengths
    h = _grams(data, gram)
    crossing = owner[: len(h)] != owner[gram - 1:]
    least = _sliding(h, width, np.minimum)
    least[owner[: len(least)] != owner[match - 1:]] = 0
    edge = np.zeros(width - 1, np.uint64)
    at = np.nonzero((_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == h) & ~crossing & (h != 0))[0]
    who = owner[at]
    low = np.maximum(at - (width - 1), begin[who])
    high = np.minimum(at + match, (begin + lengths)[who])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_BASE, n), dtype=np.uint64)])
    ctx = (sums[high] - sums[low]) * _powers(_BACK, n)[low]
    ctx = _mix(ctx + _mix(((at - low) * 4096 + (high - at)).astype(np.uint64) + _G))
    return who, at - begin[who], at - low, high - at, h[at].view(np.int64), ctx.view(np.int64)


def _scans(frame: pd.DataFrame, match: int) -> Iterator[pd.DataFrame]:
    """Cut a batch into pieces of about `_SCAN` bytes; a longer text is a piece of its own."""
    size = frame["data"].map(len)
    frame, size = frame[size >= match], size[size >= match]
    for _, part in frame.groupby((size.cumsum() // _SCAN).to_numpy(), sort=True):
        yield part


def _anchor_rows(source: DataFrame, match: int, gram: int, hot: np.ndarray) -> DataFrame:
    """Anchors of all texts, those of equal contexts within a batch settled: the first stays, others are copies."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for part in _scans(frame, match):
                who, pos, before, after, key, ctx = anchors(part["data"].tolist(), match, gram)
                place = (pos << 2 * _REACH) + (before << _REACH) + after
                made.append((key, ctx, part["did"].to_numpy()[who], part["tie"].to_numpy()[who], place))
            if not made:
                continue
            key, ctx, did, tie, place = (np.concatenate(c) for c in zip(*made, strict=True))
            order = np.lexsort((place, tie, did, ctx, key))
            key, ctx, did, tie, place = (c[order] for c in (key, ctx, did, tie, place))
            first = _first_of(key, ctx)
            lead = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
            same = (did == did[lead]) & (tie == tie[lead]) & (place == place[lead])  # a repeated row
            kind = np.where(~first, _COPY, np.where(np.isin(key, hot), _HOT, _PLAIN))
            keep = first | ~same
            yield pd.DataFrame(dict(zip(_ROW_NAMES, (c[keep] for c in (kind, key, ctx, did, tie, place)), strict=True)))

    return source.mapInPandas(run, _ROW)


def _first_of(*columns: np.ndarray) -> np.ndarray:
    first = np.ones(len(columns[0]), bool)
    first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return first


def _frequent_grams(source: DataFrame, match: int, gram: int, share: int, sample: int) -> np.ndarray:
    """At most `share` gram hashes, those that make 1 / `share` of the anchors of about `sample` texts.

    They only decide which of two exact ways an anchor takes.
    """
    n = source.count()
    seen = _anchor_rows(source.sample(min(1.0, sample / max(n, 1)), seed=5), match, gram, np.empty(0, np.int64)).filter(f"kind <> {_COPY}")
    counts = materialize(seen.groupBy("key").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.filter((F.col("n") * share >= total) & (F.col("n") > 8)).select("key").collect()
    return np.sort(np.array([r.key for r in rows], np.int64))


def _settled_contexts(rows: DataFrame) -> DataFrame:
    """Of equal contexts the first stays; others are copies. First ones stay only where their gram has several.

    Rows meet by gram; those of frequent grams by gram and context, so that no task gets all of them.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # first contexts of the last gram, which may go on in the next batch
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            kind, key, ctx, did, tie, place = (frame[c].to_numpy() for c in _ROW_NAMES)
            anchor = kind != _COPY
            first = _first_of(kind, key, ctx)
            lead = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
            again = anchor & ~first & ~((did == did[lead]) & (tie == tie[lead]) & (place == place[lead]))
            yield frame[~anchor | again].assign(kind=_COPY)
            frame = frame[first & anchor].reset_index(drop=True)
            last = frame["key"] == (frame["key"].iloc[-1] if len(frame) else 0)
            held = frame[last & (frame["kind"] == _PLAIN)]
            yield _several(frame.drop(held.index))
        if held is not None:
            yield _several(held)

    where = F.when(F.col("kind") == _PLAIN, F.col("key")).when(F.col("kind") == _HOT, F.xxhash64("key", "ctx")).otherwise(F.xxhash64("did"))
    return rows.repartition(where).sortWithinPartitions(*_ROW_NAMES).mapInPandas(run, _ROW)


def _several(firsts: pd.DataFrame) -> pd.DataFrame:
    """First contexts of grams that have several, or whose number is not known here."""
    return firsts[(firsts["kind"] == _HOT) | firsts["key"].duplicated(keep=False)]


def _pos(place: Column) -> Column:
    return F.shiftright(place, 2 * _REACH)


def _before(place: Column) -> Column:
    return F.shiftright(place, _REACH).bitwiseAND((1 << _REACH) - 1)


def _after(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << _REACH) - 1))


def _contexts(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """(kind, key, did, tie, place, bytes) of the wanted anchors, cut out of the texts where they meet."""
    lists = wanted.groupBy("did", "tie").agg(F.collect_list(F.struct("kind", "key", "place")).alias("list"))
    cut = F.transform("list", lambda r: F.struct(
        r["kind"].alias("kind"), r["key"].alias("key"), r["place"].alias("place"),
        F.substring(F.col("data"), (_pos(r["place"]) - _before(r["place"]) + 1).cast("int"), (_before(r["place"]) + _after(r["place"])).cast("int")).alias("bytes"),
    ))
    cut = source.join(lists, ["did", "tie"]).select("did", "tie", cut.alias("cut"))
    return cut.select("did", "tie", F.inline("cut"))


def smaller_before(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Per entry the nearest earlier one of a smaller value, not before its `start`; -1 if there is none."""
    at = np.arange(len(values)) - 1
    todo = np.arange(len(values))
    while len(todo):
        todo = todo[at[todo] >= start[todo]]
        todo = todo[values[at[todo]] >= values[todo]]
        at[todo] = at[at[todo]]  # what lies between is not smaller than the entry jumped from
    return np.where(at >= start, at, -1)


def earlier_factors(rows: np.ndarray, groups: np.ndarray, order: np.ndarray, valid: np.ndarray, match: int) -> np.ndarray:
    """Where a string of `match` bytes that begins in column c of a row also stands in an earlier row of its group.

    rows: bytes around an anchor, which is in the same column of all rows. Suffix arrays of the rows
    of a group are made column by column from the right: sorting the order of the next column
    by one more byte. Neighbours that share `match` bytes form stretches of the suffix array, in which
    the longest previous factor of a row reaches `match` if the stretch holds a previous or a
    next smaller value of `order`, the rows' places in the corpus. `valid` tells which strings
    lie inside their text.
    """
    n, columns = valid.shape
    tail = rows[:, columns - 1:]
    tail = np.concatenate([tail, np.zeros((n, -tail.shape[1] % 8), np.uint8)], 1)
    words = np.ascontiguousarray(tail).view(">u8").astype(np.uint64)
    suffix = np.lexsort([*words.T[::-1], groups])
    coarse = groups.astype(np.int64) * 256
    found = np.zeros(valid.shape, bool)
    for c in range(columns - 1, -1, -1):
        if c < columns - 1:
            suffix = suffix[np.argsort(coarse[suffix] + rows[suffix, c], kind="stable")]
        s = suffix[valid[suffix, c]]
        if len(s) < 2:
            continue
        alike = groups[s[1:]] == groups[s[:-1]]
        alike[alike] = (rows[s[1:][alike], c: c + match] == rows[s[:-1][alike], c: c + match]).all(1)
        part = np.append(alike, False) | np.append(False, alike)  # rows of stretches of several
        first = np.append(True, ~alike)[part]
        s = s[part]
        if not len(s):
            continue
        at = np.arange(len(s))
        start = np.maximum.accumulate(np.where(first, at, 0))
        ends = np.append(at[first][1:], len(s)) - 1
        end = ends[np.cumsum(first) - 1]
        value = order[s]
        psv = smaller_before(value, start)
        nsv = smaller_before(value[::-1], (len(s) - 1 - end)[::-1])[::-1]
        found[s, c] = (psv >= 0) | (nsv >= 0)
    return found


def _plain_spans(contexts: DataFrame, match: int, gram: int) -> DataFrame:
    """(did, tie, start, end) of what stands earlier, over grams with a bounded share of all anchors."""
    width = match - gram + 1
    lead, total = width - 1, width - 1 + match

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        place = frame["place"].to_numpy()
        before, after = place >> _REACH & (1 << _REACH) - 1, place & (1 << _REACH) - 1
        rows = np.zeros((len(frame), total), np.uint8)
        flat = np.frombuffer(b"".join(frame["bytes"]), np.uint8)
        size = before + after
        row = np.repeat(np.arange(len(frame)), size)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lead - before, size)
        rows[row, column] = flat
        at = np.arange(width)
        valid = (at >= (lead - before)[:, None]) & (at + match <= (lead + after)[:, None])
        groups = np.cumsum(_first_of(frame["key"].to_numpy())) - 1
        order = np.cumsum(_first_of(*(frame[c].to_numpy() for c in ("key", "did", "tie", "place"))))
        found = earlier_factors(rows, groups, order, valid, match)
        hit = found.any(1)
        begin = (place >> 2 * _REACH) - lead
        # strings of one context overlap, so theirs is one span
        low, high = found.argmax(1), width - 1 - found[:, ::-1].argmax(1)
        return pd.DataFrame({"did": frame["did"], "tie": frame["tie"], "start": begin + low, "end": begin + high + match})[hit]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = frame["key"] == (frame["key"].iloc[-1] if len(frame) else 0)
            held = frame[last]
            if not last.all():
                yield one(frame[~last])
        if held is not None and len(held):
            yield one(held)

    dealt = contexts.repartition("key").sortWithinPartitions("key", "did", "tie", "place")
    return dealt.select("key", "did", "tie", "place", "bytes").mapInPandas(run, "did bigint, tie bigint, start bigint, end bigint")


def _hot_spans(contexts: DataFrame, match: int) -> DataFrame:
    """The same for frequent grams: equal strings meet by a hash of 128 bits, and partial minima find the first."""
    last = _before(F.col("place")) + _after(F.col("place")) - match
    begin = F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("i")
    strings = contexts.select("did", "tie", "place", "bytes", begin)
    string = F.substring(F.col("bytes"), F.col("i") + 1, F.lit(match))
    strings = materialize(strings.select(
        F.xxhash64(F.lit(1), string).alias("x"), F.xxhash64(F.lit(2), string).alias("y"),
        F.struct("did", "tie", (_pos(F.col("place")) - _before(F.col("place")) + F.col("i")).alias("start")).alias("at"),
    ))
    first = strings.groupBy("x", "y").agg(F.min("at").alias("one"), F.max("at").alias("other")).filter("one <> other").select("x", "y", "one")
    return strings.join(first, ["x", "y"]).filter("at <> one").select("at.did", "at.tie", "at.start", (F.col("at.start") + match).alias("end"))


def without_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", match: int = 100, gram: int = 32, share: int = 500, sample: int = 20_000
) -> DataFrame:
    """(key, data, kept, n_removed, n_spans): the bytes of every text without those of earlier strings.

    A byte goes if a string of `match` bytes that covers it also starts earlier: in a document of a
    smaller key, or in the same one. Strings are judged on the input. Null texts are empty. A null
    key is smaller than any; texts of one key, or of none, follow each other by a hash, and rows
    equal in key and text are one document, of which each row gets the result. `kept` may end
    in the midst of a character. Extra columns are left aside; an empty table gives no rows.

    Equal strings hold an anchor at the same place, so only contexts of anchors whose gram occurs
    several times can hold one. Hashes of whole contexts meet first: where an equal context stands
    earlier, all of it goes, and its bytes never travel. Contexts that differ but share
    a gram are cut out of the texts and searched by longest-previous-factor arrays. Grams of
    1 / `share` of all anchors take a way of their own, by string. No way loses a string.
    """
    id_ = F.col(key).cast("bigint")
    data = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    several = materialize(docs.groupBy(id_.alias("again")).agg(F.count("*").alias("n")).filter("n > 1 and again is not null").select("again"))
    source = docs.select(F.col(key).alias("id"), id_.alias("num"), data.alias("data")).join(several, F.col("num") == F.col("again"), "left").select(
        "id", F.coalesce("num", F.lit(-(2**63))).alias("did"),
        F.when(F.col("num").isNull() | F.col("again").isNotNull(), F.xxhash64("data")).otherwise(0).cast("bigint").alias("tie"), "data",
    )
    texts = source.select("did", "tie", "data")
    hot = _frequent_grams(texts, match, gram, share, sample)
    settled = materialize(_settled_contexts(_anchor_rows(texts, match, gram, hot)))
    contexts = materialize(_contexts(texts, settled.filter(f"kind <> {_COPY}")))
    copies = settled.filter(f"kind = {_COPY}").select(
        "did", "tie", (_pos(F.col("place")) - _before(F.col("place"))).alias("start"), (_pos(F.col("place")) + _after(F.col("place"))).alias("end")
    )
    spans = copies.unionByName(_plain_spans(contexts.filter(f"kind = {_PLAIN}"), match, gram))
    spans = spans.unionByName(_hot_spans(contexts.filter(f"kind = {_HOT}"), match))
    lists = spans.groupBy("did", "tie").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))

    @F.pandas_udf("struct<kept binary, n_removed bigint, n_spans bigint>")
    def cut(data: pd.Series, spans: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_cut(d, s) for d, s in zip(data, spans, strict=True)], columns=["kept", "n_removed", "n_spans"])

    places = lambda name: F.transform("spans", lambda s: s[name])
    joined = source.join(lists, ["did", "tie"], "left").select("id", "data", F.array(places("start"), places("end")).alias("spans"))
    done = joined.withColumn("c", cut("data", "spans"))
    return done.select(F.col("id").alias(key), "data", "c.kept", "c.n_removed", "c.n_spans")


def _cut(data: bytes, spans: list) -> tuple[bytes, int, int]:
    """What stays outside the union of sorted spans, how much goes and in how many runs."""
    if spans is None or spans[0] is None or not len(spans[0]):
        return data, 0, 0
    start, end = np.asarray(spans[0]), np.maximum.accumulate(np.asarray(spans[1]))
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    start, end = start[new], np.append(end[:-1][new[1:]], end[-1])
    kept = b"".join(data[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(data)], strict=True))
    return kept, int((end - start).sum()), len(start)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Digest per document: its bytes, what goes and a hash of what stays."""
    df = without_repeats(docs.select("doc_id", "text"))
    return df.select(
        "doc_id", F.octet_length("data").cast("bigint").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
