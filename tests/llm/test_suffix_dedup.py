"""Repeated strings against a dictionary of all strings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitecontacts.llm import suffix_dedup as sd


def brute_kept(rows, match):
    """(doc_id, text) to (kept bytes, removed, runs), strings judged on the input."""
    seen, out = set(), {}
    for key, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - match + 1):
            if data[i: i + match] in seen:
                gone[i: i + match] = b"\1" * match
            seen.add(data[i: i + match])
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[key, text] = (bytes(x for x, g in zip(data, gone, strict=True) if not g), sum(gone), runs)
    return out


def _check(spark, rows, match, gram, **more):
    schema = "doc_id bigint, text string, did bigint, kind string, data string, spans int"
    df = spark.createDataFrame([(*r, 1, "k", "d", 2) for r in rows], schema).repartition(4)
    want = brute_kept(rows, match)
    got = sd.without_repeats(df, match=match, gram=gram, **more).collect()
    assert sorted((r.doc_id, bytes(r.kept), r.n_removed, r.n_spans) for r in got if r.doc_id is not None) == sorted(
        (k, *want[k, t]) for k, t in rows if k is not None
    )
    nulls = [(bytes(r.data), bytes(r.kept), r.n_removed, r.n_spans) for r in got if r.doc_id is None]
    assert sorted(nulls) == sorted(((t or "").encode(), *want[k, t]) for k, t in rows if k is None)


@pytest.mark.parametrize("share", [500, 3])
def test_equals_brute_force(spark, share):
    """With and without the way for frequent grams; negative ids, repeated rows, null, empty and short texts."""
    rng = random.Random(4)
    words = ["a", "b", "ab", "é", "xyz", "\n"]
    base = [" ".join(rng.choices(words, k=rng.choice([3, 20, 60]))) for _ in range(6)]
    rows = []
    for i in range(50):
        text = rng.choice(base)
        for _ in range(rng.randint(0, 3)):
            p = rng.randrange(len(text) + 1)
            text = text[:p] + rng.choice(words) + text[p:]
        rows.append((7 * i - 20, text + rng.choice(["", rng.choice(base)])))
    rows += [(5000, None), (5001, ""), rows[3], rows[3], (6000, "aa" * 200), (6001, "-" * 90)]
    _check(spark, rows, 16, 4, share=share)


def test_null_ids_come_first(spark):
    text = "the quick brown fox jumps over the lazy dog, again and again, until it is tired of it and sleeps " * 2
    _check(spark, [(1, "x" + text), (None, text), (None, text)], 32, 8)


def test_default_length(spark):
    passage = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(100))
    rows = [(1, "first " + passage + " one"), (2, "second " + passage[:99]), (3, passage), (4, passage[1:] + "!" + passage)]
    _check(spark, rows, 100, 32)


def test_repeated_id_with_other_text(spark):
    text = "once upon a time there was a fox that lived in a small wood by the sea"
    df = spark.createDataFrame([(1, text), (1, text + " shore"), (2, text)], "doc_id bigint, text string")
    rows = sd.without_repeats(df, match=16, gram=4).select("doc_id", F.col("data").cast("string").alias("t"), "n_removed").collect()
    removed = {(r.doc_id, r.t): r.n_removed for r in rows}
    assert removed[2, text] == len(text)
    # of the two texts of id 1 one comes first and keeps the string
    assert sorted(removed[1, t] for t in (text, text + " shore")) == [0, len(text)]


def test_empty_table(spark):
    assert sd.suffix_dedup(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_smaller_before():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 30, 200)
    start = (np.arange(200) // 20) * 20
    want = [next((j for j in range(i - 1, s - 1, -1) if values[j] < values[i]), -1) for i, s in enumerate(start)]
    assert sd.smaller_before(values, start).tolist() == want
