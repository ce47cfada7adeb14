"""Merkle manifest against a plain tree."""

from hashlib import sha256
from zlib import crc32

import pytest

from sitecontacts.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, at int, block string, grp string, uid string, digest string"


def _hash(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _hash(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def _tree(leaves):
    """Root, and per leaf its (place, others) from the bottom up."""
    paths, level = [[] for _ in leaves], [(d, [i]) for i, d in enumerate(leaves)]
    while len(level) > 1:
        above = []
        for at in range(0, len(level), 3):
            run = level[at: at + 3]
            for k, (_, members) in enumerate(run):
                for m in members:
                    paths[m].append((k, [d for j, (d, _) in enumerate(run) if j != k]))
            above.append((_hash(*[d for d, _ in run]), [m for _, ms in run for m in ms]))
        level = above
    return level[0][0], paths


def brute_manifest(rows):
    """rows (doc_id, source, lang, n_chars, text) to the digest rows."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    parts = []
    for source in sources:
        mine = sorted((r for r in rows if r[1] == source), key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        parts.append((mine, *_tree([_leaf(r) for r in mine])))
    if not parts:
        return []
    root, top = _tree([sub for _, sub, _ in parts])
    out = []
    for (mine, sub, paths), upper in zip(parts, top, strict=True):
        for r, path in zip(mine, paths, strict=True):
            path = path + upper
            folded = _leaf(r)
            if r[0] is not None and crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                folded = _leaf((*r[:4], r[4].replace("\n", "")))
            for k, others in path:
                folded = _hash(*others[:k], folded, *others[k:])
            out.append((r[0], _leaf(r), sub, root, _hash(*[d for _, others in path for d in others]), folded, folded == root))
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r) for r in merkle.merkle_manifest(df).collect()), key=str)


@pytest.mark.parametrize("height", [1, 2, 8])
def test_equals_a_plain_tree(spark, monkeypatch, height):
    """Blocks of any height give the same tree; null ids, sources and texts, ties, repeats, clashing columns."""
    monkeypatch.setattr(merkle, "_HEIGHT", height)
    rows = [(i, f"line {i}\nnext" if i % 3 else "one line", "en", "big" if i % 3 else f"s{i % 4}", i) for i in range(40)]
    rows += [(None, "a\nb", None, None, None), (None, "a\nb", None, None, None), (7, None, "é", "big", 3), (7, "", "de", "big", 0), (3, "x\n\n", "de", "ünï", 1), (3, "x\n\n", "de", "ünï", 1)]
    df = spark.createDataFrame([(*r, 1, "b", "g", "u", "d") for r in rows], SCHEMA).repartition(3)
    want = brute_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows])
    got = _got(df)
    assert got == want
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_few_rows(spark):
    one = spark.createDataFrame([(1, "a", "en", "s", 1, 1, "", "", "", "")], SCHEMA)
    leaf = _leaf((1, "s", "en", 1, "a"))
    assert _got(one) == [(1, leaf, leaf, leaf, _hash(), leaf, True)]
    assert _got(one.limit(0)) == []


def test_witness_grows_with_each_sibling():
    tree = merkle.OpenTree(2)
    a, b, c, d = (bytes([i]) * 32 for i in range(4))
    tree.append(a)
    tree.append(b)
    assert tree.steps == [[], []]
    tree.append(c)
    assert [len(s) for s in tree.steps] == [1, 1, 1] and tree.steps[1][0] == bytes([1, 2]) + a + c
    tree.append(d)
    top = tree.finish()
    assert [len(s) for s in tree.steps] == [2, 2, 2, 2] and tree.steps[3][0] == bytes([0, 0])
    assert all(merkle.fold(x, b"".join(s)) == top for x, s in zip((a, b, c, d), tree.steps, strict=True))
