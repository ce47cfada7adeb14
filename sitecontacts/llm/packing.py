"""Packing documents into token windows in bounded space."""

from __future__ import annotations

import bisect
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sitecontacts.llm.common import batches
from sitecontacts.llm.token_counts import word_bpe, worker_cache
from sitecontacts.plans.lineage import materialize

_SIZE = 4  # bytes of a packed id
_PIECES = "doc_id string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


class Windows:
    """A fixed number of open windows; a piece is (doc_id, start, packed ids, doc_tokens)."""

    def __init__(self, capacity: int, n_open: int, max_pad: int):
        self.capacity, self.n_open, self.max_pad = capacity, n_open, max_pad
        self.open: list[tuple[int, int, list]] = []  # (free, serial, pieces), sorted by free
        self.serial = 0

    def add(self, piece: tuple) -> Iterator[list]:
        """Place a piece; yields the windows that are emitted for it."""
        doc, start, ids, total = piece
        while ids:
            n = len(ids) // _SIZE
            if n >= self.capacity:
                yield [(doc, start, ids[: self.capacity * _SIZE], total)]
                ids, start = ids[self.capacity * _SIZE:], start + self.capacity
                continue
            at = bisect.bisect_left(self.open, (n,))  # the least free space that holds it
            if at < len(self.open):
                free, serial, pieces = self.open.pop(at)
                pieces.append((doc, start, ids, total))
                if free == n:
                    yield pieces
                else:
                    bisect.insort(self.open, (free - n, serial, pieces))
                return
            if len(self.open) < self.n_open:
                self.serial += 1
                bisect.insort(self.open, (self.capacity - n, self.serial, [(doc, start, ids, total)]))
                return
            free, _, pieces = self.open.pop(0)  # none fits: the fullest goes, topped up if that saves padding
            if free > self.max_pad:
                pieces.append((doc, start, ids[: free * _SIZE], total))
                ids, start = ids[free * _SIZE:], start + free
            yield pieces


def _rows(pieces: list, sequence: int, with_ids: bool) -> list[tuple]:
    rows, offset = [], 0
    for doc, start, ids, total in pieces:
        n = len(ids) // _SIZE
        rows.append((doc, start, n, zlib.crc32(ids), total, sequence, offset, ids if with_ids else None))
        offset += n
    return rows


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({c: "int64" for c in names[1:7]})


def pack(
    docs: DataFrame, text: str = "text", path: str | None = None, capacity: int = 4096, end_id: int = 2,
    n_open: int = 16, max_pad: int = 16, merge_tokens: int = 1 << 20,
) -> DataFrame:
    """Pieces of documents in sequences of at most `capacity` ids, cut freely.

    Every task keeps `n_open` windows. A piece goes where it leaves the least space; when
    none fits, the fullest window is emitted, topped up with a cut of the piece if its gap
    exceeds `max_pad`. What is open at the end of a task is written with its ids and merged
    by about one task per `merge_tokens` leftover ids, each of which cuts its last, part-filled
    window into lengths that are powers of two, which need no padding.

    Null and empty texts have only the end id. Repeated rows are packed as often as they
    occur. An empty table gives no rows. Sequence ids are unique, not gapless.
    """
    path = path or word_bpe()
    source = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = worker_cache(path, "ids", _packed)
        end = np.asarray([end_id], "<u4").tobytes()
        windows, sequence, rows = Windows(capacity, n_open, max_pad), TaskContext.get().partitionId() << 32, []
        for frame in batches(frames, "text"):
            for doc, body in zip(frame["doc_id"], frame["text"], strict=True):
                ids = b"".join([*cache.values(body), end])
                for done in windows.add((doc, 0, ids, len(ids) // _SIZE)):
                    rows += _rows(done, sequence, False)
                    sequence += 1
                if len(rows) > 20_000:
                    yield _frame(rows)
                    rows = []
        for _, _, pieces in windows.open:
            rows += _rows(pieces, -1, True)
        yield _frame(rows)

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows, sequence, rows = Windows(capacity, n_open, 0), (1 << 62) | (TaskContext.get().partitionId() << 32), []
        for frame in frames:
            for piece in zip(frame["doc_id"], frame["start"], frame["ids"], frame["doc_tokens"], strict=True):
                for done in windows.add(piece):
                    rows += _rows(done, sequence, False)
                    sequence += 1
            if len(rows) > 20_000:
                yield _frame(rows)
                rows = []
        for done in _closed([p for _, _, pieces in windows.open for p in pieces], capacity):
            rows += _rows(done, sequence, False)
            sequence += 1
        yield _frame(rows)

    shape = f"{_PIECES}, ids binary"
    pieces = materialize(source.mapInPandas(first, shape))
    left = pieces.filter("sequence_id < 0")
    n = left.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    merged = (
        left.repartition(max(1, -(-n // merge_tokens)), F.xxhash64("doc_id", "start"))
        .sortWithinPartitions(F.desc("length"), "doc_id", "start").mapInPandas(merge, shape)
    )
    # ids travel as text, since pandas would turn a column with a missing id into floats
    return pieces.filter("sequence_id >= 0").unionByName(merged).drop("ids").withColumn("doc_id", F.col("doc_id").cast("bigint"))


def _closed(pieces: list, capacity: int) -> Iterator[list]:
    """Cut what is still open into full windows, then windows whose lengths are powers of two."""
    rest = sum(len(p[2]) for p in pieces) // _SIZE
    while rest:
        room = capacity if rest >= capacity else 1 << (rest.bit_length() - 1)
        rest -= room
        window = []
        while room:
            doc, start, ids, total = pieces.pop()
            window.append((doc, start, ids[: room * _SIZE], total))
            if len(ids) > room * _SIZE:
                pieces.append((doc, start + room, ids[room * _SIZE:], total))
            room -= len(window[-1][2]) // _SIZE
        yield window


def packing(docs: DataFrame) -> DataFrame:
    """Digest per piece, with the default vocabulary and windows of 4096 ids."""
    return pack(docs)
