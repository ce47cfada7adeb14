"""Token counts and packing against the tokenizer itself."""

import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from tokenizers import Tokenizer

from sitecontacts.llm.packing import pack
from sitecontacts.llm.token_counts import RunCache, count_tokens, frequent_lengths, token_counts, word_bpe

TEXTS = [
    None, "", " \n\t ", "The cat's hat, isn't it?", "a<|endoftext|>b <|startoftext|>", "ΟΔΟΣ Σ İstanbul ǅ ﬁ",
    "é ä ́ x y z", "x" * 20_000, "word " * 9_000, "日本語のテキスト 한국어 123 4567", "\x1c\x1d a\x85b",
    "word " * 9_000, "👍🏽 emoji‍ joined <|END|> !!!???", "tab\tnew\nline\r\x0b\x0cend",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(word_bpe())


def docs_of(spark, texts):
    rows = [(i, t, "n", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, N_tokens string, ids int").repartition(3)


def test_counts_equal_the_tokenizer(spark, tokenizer):
    rows = {r.doc_id: r for r in token_counts(docs_of(spark, TEXTS)).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit) == (n, len((text or "").encode()), n > 2048)


def test_latin_runs_equal_the_tokenizer(tokenizer):
    r = random.Random(5)
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    cache = RunCache(word_bpe(), list)
    for _ in range(3_000):
        run = "".join(r.choices(r.choice([letters, "abcdefghij", "aeéèçñüß", letters[:80]]), k=r.randint(1, 12))) + r.choice(["", "", ".", "!?", "'s", ",'t"])
        assert cache[run.encode()] == tokenizer.encode(run, add_special_tokens=False).ids, run


def test_marks_after_every_character(tokenizer):
    """All characters below U+0250 before all marks and pairs of marks: the parts add up to what the library gives."""
    cache = RunCache(word_bpe(), list)
    ends = [m for m in ".,;:!?"] + [a + b for a, b in product(".,;:!?", repeat=2)]
    for c in range(0x21, 0x250):
        for core in (chr(c), "a" + chr(c), chr(c) + "b"):
            if core.split() != [core]:
                continue
            for end in ends:
                run = core + end
                assert cache[run.encode()] == tokenizer.encode(run, add_special_tokens=False).ids, run
    for text in ("HEPSİ.", "EVİ, VE DEĞİL", "İ!", "İstanbul'da."):
        assert sum(cache.values(text), []) == tokenizer.encode(text, add_special_tokens=False).ids


def test_the_table_never_changes_a_count(spark):
    docs = docs_of(spark, TEXTS)
    table = frequent_lengths(docs)
    assert table[b"word"] == 1
    with_table = count_tokens(docs, table=table, out="n").select("doc_id", "n").collect()
    assert sorted(with_table) == sorted(count_tokens(docs, table={}, out="n").select("doc_id", "n").collect())


@pytest.mark.parametrize("capacity, n_open", [(64, 3), (4096, 16)])
def test_pieces_rebuild_every_document(spark, tokenizer, capacity, n_open):
    docs = docs_of(spark, TEXTS + [f"some words {i} " * (i % 37) for i in range(200)])
    pieces = pack(docs, capacity=capacity, n_open=n_open, merge_tokens=2_000).collect()
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    found, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        piece = ids[p.doc_id][p.start:p.start + p.length]
        assert p.doc_tokens == len(ids[p.doc_id]) and zlib.crc32(np.asarray(piece, "<u4").tobytes()) == p.ids_crc32
        found[p.doc_id].append((p.start, p.length))
        windows[p.sequence_id].append((p.offset, p.length))
    for doc, all_ids in ids.items():
        at = 0
        for start, length in sorted(found[doc]):
            assert start == at and length > 0
            at += length
        assert at == len(all_ids)
    padding = total = 0
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding <= 0.02 * total or capacity < 4096


def test_empty_table(spark):
    empty = docs_of(spark, TEXTS).filter("false")
    assert token_counts(empty).collect() == [] and pack(empty).collect() == []


def test_missing_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b")], "doc_id bigint, text string")
    lengths = defaultdict(int)
    for r in pack(docs).collect():
        lengths[r.doc_id] += r.length
    assert lengths == {None: 3, 3: 6}
