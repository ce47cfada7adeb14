"""Near-duplicate vectors and documents against brute force."""

import random

import numpy as np
import pytest

from sitecontacts.llm.components import components
from sitecontacts.llm.dart_minhash import _WordHashes, dart_signatures, minhash_dedup, multiset_jaccard, near_documents, shingles
from sitecontacts.llm.embedding_dedup import embedding_dedup, near_vectors, quantised, tile_links


def classes(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 1), (5, 4), (4, 9)], [(i, i + 1) for i in range(40)], [(99, i) for i in range(30)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert got == classes(nodes, [e for e in edges if e[0] != e[1]])


def vectors_of(seed=1, dims=24):
    r = np.random.default_rng(seed)
    base = r.normal(size=(30, dims))
    rows = [(base[i % 30] + r.normal(size=dims) * r.choice([0, 0.05, 0.12, 0.3])).astype("f4").tolist() for i in range(240)]
    rows += [rows[0]] * 60 + [[0.0] * dims, None, [], [float("nan")] * dims, [float("inf")] + rows[1][1:], [None, *rows[1][1:]]]
    rows += [[-0.0, *rows[2][1:]], [0.0, *rows[2][1:]], [x * 1e30 for x in rows[3]], rows[4][:5]]
    labels = [int(x) for x in r.choice([0, 0, 0, 1], size=len(rows))]
    labels[5] = None
    return [(i, v, label, "x") for i, (v, label) in enumerate(zip(rows, labels, strict=True))]


@pytest.mark.parametrize("block", [16, 1024])
def test_vectors_equal_brute_force(spark, block):
    rows = vectors_of()
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, n string").repartition(4)
    good = {}
    for i, v, label, _ in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v) / max(map(abs, v))
            good[i] = (label, x / np.linalg.norm(x))
    links = [(a, b) for a in good for b in good if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1])
             and good[a][1] @ good[b][1] >= 0.98]
    want, n = classes([r[0] for r in rows], links), dict.fromkeys((r[0] for r in rows), 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    got = near_vectors(frame, block=block).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (n[i], want[i]) for i in n} and len(got) == len(rows)


def test_error_bound_holds():
    r = np.random.default_rng(3)
    for dims in (3, 64, 1500):
        x, y = r.normal(size=(50, dims)), r.normal(size=(60, dims))
        y[:50] = x + r.normal(size=x.shape) * 0.2
        (x, y) = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
        (qx, sx, ex), (qy, sy, ey) = quantised(x), quantised(y)
        near = (qx.astype(float) @ qy.astype(float).T) * sx[:, None] * sy
        assert (abs(near - x @ y.T) <= ex[:, None] * (1 + ey) + ey + 1e-12).all()
        assert (tile_links(x, y, 0.9) == (x @ y.T >= 0.9)).all()


def test_no_vectors(spark):
    assert embedding_dedup(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).collect() == []


def prose(seed=5):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(1, 7))) for _ in range(400)]

    def edited(words, share):
        return [r.choice(vocabulary) if r.random() < share else w for w in words]

    texts = [None, "", "  \n", "one", "one", "a b c d", "a b  c\nd", "the " * 300, "the " * 320, "the " * 900]
    for _ in range(25):
        base = r.choices(vocabulary, k=r.choice([8, 40, 300]))
        texts.append(" ".join(base))
        texts += [" ".join(edited(base, share)) for share in (0, 0.01, 0.02, 0.03, 0.05, 0.2)]
    family = r.choices(vocabulary, k=200)
    texts += [" ".join(edited(family, 0.012)) for _ in range(120)]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("changed", [0, 6, 12])
def test_documents_equal_brute_force(spark, changed):
    """Also with a group of texts that are alike, most of them not enough, and share many buckets."""
    r = random.Random(changed)
    base = [f"w{k}" for k in range(200)]
    alike = [" ".join(f"x{r.randrange(10**6)}" if k in r.sample(range(200), changed // 3) else w for k, w in enumerate(base)) for _ in range(3 * changed)]
    texts = prose() + alike
    frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, keys string").repartition(4)
    hashes = _WordHashes()
    sets = {i: np.sort(shingles([t], hashes)[1]) for i, t in enumerate(texts) if t and t.split()}
    links = [(a, b) for a in sets for b in sets if a < b and multiset_jaccard(sets[a], sets[b]) >= 0.8]
    got = {r.doc_id: r.class_id for r in near_documents(frame).collect()}
    assert got == classes(range(len(texts)), links)


def test_signatures_estimate_weighted_similarity():
    x = np.arange(1, 200, dtype=np.uint64) << np.uint64(20)
    a = np.concatenate([x[:100], x[:100], x[100:150]])
    b = np.concatenate([x[:100], x[50:190]])
    owner = np.repeat([0, 1], [len(a), len(b)])
    s = dart_signatures(owner, np.concatenate([a, b]), 2, 4000)
    assert (s != 0).all()
    assert abs((s[0] == s[1]).mean() - multiset_jaccard(np.sort(a), np.sort(b))) < 0.03


def test_missing_ids_repeats_and_no_rows(spark):
    frame = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (2, "a b c"), (2, "a b c"), (9, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in minhash_dedup(frame).collect())
    assert got == [(0, 0), (2, 2), (2, 2), (4, 2), (9, 9)]
    assert minhash_dedup(frame.filter("false")).collect() == []
