"""Budgets and selection of the mixture against a plain loop."""

import hashlib
import random
from collections import defaultdict

import pytest

from sitecontacts.llm.mixing import WEIGHTS, mix


def share(budget, children, weight):
    """Water filling in whole tokens, in order of capacity per weight."""
    out, left = {}, sorted(children, key=lambda c: (children[c] / weight(c), c))
    while left:
        w = sum(map(weight, left))
        c = left[0]
        if children[c] * w <= budget * weight(c):
            out[c] = children[c]
            budget -= children[c]
            left.pop(0)
        else:
            return out | {c: budget * weight(c) // w for c in left}
    return out


def expected(rows, percent, epochs, seed=17):
    def domain(s):
        digits = "".join(c for c in (s or "")[3:] if c.isdigit())
        return f"d{int(digits) % 4}" if digits else "d3"

    leaves = defaultdict(list)
    for i, text, lang, source in rows:
        leaves[domain(source), lang or "", source or ""].append((i, len((text or "").split())))
    cap = {leaf: sum(n for _, n in d) * epochs for leaf, d in leaves.items()}

    def capacity(prefix):
        return sum(c for leaf, c in cap.items() if leaf[: len(prefix)] == prefix)

    budgets = {(): capacity(()) * percent // (100 * epochs)}
    for depth, name in enumerate(("domain", "lang", "source")):
        for prefix, budget in list(budgets.items()):
            if len(prefix) == depth:
                kids = {leaf[depth]: capacity(leaf[: depth + 1]) for leaf in cap if leaf[:depth] == prefix}
                for kid, b in share(budget, kids, lambda k, m=WEIGHTS[name]: m.get(k, 10)).items():
                    budgets[*prefix, kid] = b
    chosen = []
    for leaf, members in leaves.items():
        total = 0
        for epoch in range(epochs):
            groups = defaultdict(list)
            for i, n in members:
                groups[hashlib.md5(f"{seed}:{epoch}:{'' if i is None else i}".encode()).hexdigest()].append((i, n))
            for _, group in sorted(groups.items()):
                total += sum(n for _, n in group)
                if total <= budgets[leaf]:
                    chosen += [(i, epoch) for i, _ in group]
    return chosen, budgets


@pytest.mark.parametrize("percent, epochs", [(50, 1), (80, 1), (100, 1), (130, 2), (0, 1)])
def test_choice_equals_a_plain_loop(spark, percent, epochs):
    r = random.Random(percent)
    rows = [(i, r.choice([None, "", *["w " * r.randint(1, 60)] * 8]), r.choice(["en", "en", "de", "fr", None]),
             r.choice([*["src0"] * 8, "src1", "src2", "src3", "src4", "src17", "blog", None, ""])) for i in range(900)]
    rows += [rows[3], rows[3], (None, "a b", "en", "src1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr("*", "1 as domain", "'x' as n_tokens").repartition(3)
    got = mix(docs, percent, epochs=epochs)
    assert got.columns[:6] == docs.columns
    want, budgets = expected(rows, percent, epochs)
    key = lambda x: (-1 if x[0] is None else x[0], x[1])
    assert sorted(((r.doc_id, r.epoch) for r in got.select("doc_id", "epoch").collect()), key=key) == sorted(want, key=key)
    spent = sum(b for leaf, b in budgets.items() if len(leaf) == 3)
    assert spent <= budgets[()] and (percent > 100 or spent >= budgets[()] - 60)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    assert mix(docs).collect() == []
