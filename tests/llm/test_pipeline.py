"""The pipeline against brute-force versions of its stages."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sitecontacts.llm.dart_minhash import _WordHashes, multiset_jaccard, shingles
from sitecontacts.llm.quality_rules import POLICIES, ablations, ledger, quality_rules
from sitecontacts.llm.token_counts import word_bpe
from test_line_dedup import brute as brute_lines
from test_line_dedup import prose
from test_mixing import expected as brute_mix
from test_near_duplicates import classes

SPACE = " \t\n\x0b\x0c\r"


def measures(text):
    w = re.findall(f"[^{SPACE}]+", text or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {p for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
            len(lines), sum(c.isupper() for c in text or ""))


def failed(text):
    n, chars, symbols, dup, repeated, lines, upper = measures(text)
    tests = (n < 50, 100 * repeated > 50 * n, 10 * symbols > n, lines >= 4 and 100 * dup > 30 * lines, chars < 2 * n, chars > 14 * n, 100 * upper > 40 * chars)
    return {name for name, bad in zip(("few_words", "repeated_words", "many_symbols", "repeated_lines", "short_words", "long_words", "capitals"), tests, strict=True) if bad}


TEXTS = [
    None, "", " \n\t\x0b", "a b c", "a b c a b c", "a a a a", "a b a b a", "x\ny\nx\nx\n \n \n", "### |||| <> $ " * 30, "ABC DEF " * 40,
    "word\xa0joined   x", "é " * 70, "same line here\n" * 30, "x" * 100_000, " ".join(str(i % 7_000) for i in range(20_000)),
    " ".join(f"w{i}" for i in range(300)), "😀 b c " * 20,
]


def test_ledger_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "a b", 1)], "doc_id bigint, text string, n_words int").repartition(3)
    rows = {r.doc_id: r for r in quality_rules(docs).collect()}
    for i, t in enumerate(TEXTS):
        r, bad = rows[i], failed(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(t)[:5], i
        assert r.base_failed == bool(bad & {"few_words", "repeated_words"}) and r.kept == (not bad), (i, bad)
    assert len(rows) == len(TEXTS) + 1
    df, bits, names = ledger(docs)
    assert names["n_words"] == "_n_words" and df.columns[:3] == docs.columns
    got = {(r.policy, r.rule): (r.n_failed, r.n_rejected, r.n_only_this_rule) for r in ablations(df, bits).collect()}
    all_bad = [failed(t) for t in [*TEXTS, "a b"]]
    for policy, rules in POLICIES.items():
        for rule in rules:
            mine = [b & set(rules) for b in all_bad]
            assert got[policy, rule] == (sum(rule in b for b in all_bad), sum(bool(b) for b in mine), sum(b == {rule} for b in mine))


def test_ledger_of_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert quality_rules(docs).collect() == []
    df, bits, _ = ledger(docs)
    assert {r.n_failed for r in ablations(df, bits).collect()} == {0}


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    r = random.Random(4)
    rows = []
    for i, text in enumerate(prose()):
        text = text and "\n".join([text, " ".join("".join(r.choices("klmnopq", k=5)) for _ in range(30))] if i < 60 else [text])
        rows.append((i, text, r.choice(["en", "de", None]), r.choice(["src0", "src0", "src1", "src2", "src7", None]), 0))
    rows += [(i, f"### {t}", "en", "src0", 0) for i, t in enumerate(TEXTS, len(rows))]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_run_equals_brute_force(spark, folder):
    path, rows = folder
    rows = [r for r in rows if not failed(r[1])]
    texts = brute_lines([r[1] for r in rows])
    rows = [(r[0], t, *r[2:]) for r, t in zip(rows, texts, strict=True) if t == r[1] or t.strip(SPACE)]
    sets = {r[0]: np.sort(shingles([r[1]], _WordHashes())[1]) for r in rows}
    links = [(a, b) for a in sets for b in sets if a < b and multiset_jaccard(sets[a], sets[b]) >= 0.8]
    group = classes(sets, links)
    rows = [r for r in rows if group[r[0]] == r[0]]
    chosen = {i for i, _ in brute_mix([r[:4] for r in rows], 80, 1)[0]}
    assert 10 < len(chosen) < len(rows)
    tokenizer = Tokenizer.from_file(word_bpe())
    want = {r[0]: len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1 for r in rows if r[0] in chosen}
    got = defaultdict(int)
    for p in corpus_pipeline.run(spark, path).collect():
        got[p.doc_id] += p.length
    assert got == want


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder[0])
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
