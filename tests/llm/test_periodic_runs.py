"""Periodic runs by the grammar against a scan of every period."""

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from sitecontacts.llm import periodic_runs as pr


def brute_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q) and i > s:
                found.setdefault((s, i - s + q), q)
            i += i == s
    return sorted((s, n, q) for (s, n), q in found.items())


def _random_sequence(rng):
    n, k = rng.choice([0, 1, 11, 12, 40, 150]), rng.choice([1, 2, 3, 30])
    s = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 2))
        s = s[:a] + [s[a + (i - a) % p] for i in range(a, n)]
    return s


@pytest.mark.parametrize("chunk", [16, 1 << 20])
def test_runs_equal_a_scan(monkeypatch, chunk):
    monkeypatch.setattr(pr, "_CHUNK", chunk)
    rng = random.Random(5)
    for _ in range(60):
        group = [_random_sequence(rng) for _ in range(rng.randint(1, 6))]
        assert [[tuple(r) for r in x.tolist()] for x in pr.find_runs(group)] == [brute_runs(s) for s in group]


def test_extensions_equal_a_scan():
    rng = random.Random(6)
    for k in (1, 2, 4):
        s = [rng.randrange(k) for _ in range(60)] + [0, 1, 1] * 20 + [0] * 30
        grammar = pr.Grammar(np.array(s), np.array([len(s)]))
        i, j = (x.ravel() for x in np.meshgrid(np.arange(0, len(s), 3), np.arange(len(s)), indexing="ij"))
        i, j = i[i < j], j[i < j]
        right, left = grammar.extend(i, j), grammar.extend(i[i > 0], j[i > 0], back=True)
        for a, b, n in zip(i, j, right, strict=True):
            assert n == next((x for x in range(len(s) - b) if s[a + x] != s[b + x]), len(s) - b)
        for a, b, n in zip(i[i > 0], j[i > 0], left, strict=True):
            assert n == next((x for x in range(a) if s[a - 1 - x] != s[b - 1 - x]), a)


def _brute_row(doc_id, text):
    words = pr._WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n and crc32(str(doc_id).encode()) % 10 == 0:
        g = crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    digests = ("".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone))
    return (doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2], *[sha256(d.encode()).hexdigest() for d in digests])


def test_query_equals_brute_force(spark):
    """Null, empty and long texts, null and repeated ids, clashing columns, an empty table."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 90)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (None, "a b " * 20), (None, None), (103, "é " * 30), (103, "é " * 30), (104, "x " * 3000 + "y z " * 900)]
    df = spark.createDataFrame([(*r, "t", 1, "c") for r in rows], "doc_id bigint, text string, id string, runs int, collapsed string").repartition(3)
    got = sorted((tuple(r) for r in pr.periodic_runs(df).collect()), key=str)
    assert got == sorted((_brute_row(*r) for r in rows), key=str)
    assert pr.periodic_runs(df.limit(0)).collect() == []
