"""Recurring line templates on small tables."""

import collections
import itertools
import random
import re

from sitecontacts.llm.line_dedup import copy_groups, dedup_lines, line_arrays, line_dedup, with_words_left


def masked_lines(text):
    split = (re.split("[ \t\x0b\x0c\r\n]+", line) for line in (text or "").split("\n"))
    return [["<*>" if re.search("[0-9]", t) else t for t in w if t] for w in split]


def shingles(text):
    return {tuple(w[i: i + 5]) for w in masked_lines(text) if w for i in range(max(len(w) - 4, 1))}


def documents(texts, least=0.7):
    """One number for every text and its near copies, by comparing all pairs."""
    sets, number = [shingles(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and number[i] != number[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
            old, new = number[j], number[i]
            number = [new if n == old else n for n in number]
    return number


def brute(texts, depth=3, least=5, constant=0.6):
    found = collections.defaultdict(set)  # template -> documents
    held = collections.defaultdict(set)  # template -> lines
    for at, (text, doc) in enumerate(zip(texts, documents(texts))):
        for i, w in enumerate(masked_lines(text)):
            n, lead, rest = len(w), tuple(w[:depth]), w[depth:]
            if not n:
                continue
            parts = [tuple(rest[len(rest) * q // 4: len(rest) * (q + 1) // 4]) for q in range(4)]
            keys = [("line", n >= 50, tuple(w))]
            for kept in itertools.product([True, False], repeat=4):
                same = min(n, depth) + sum(len(p) for p, k in zip(parts, kept) if k)
                if not all(kept) and same >= constant * n and all(p or k for p, k in zip(parts, kept)):
                    keys.append(("parts", False, n, lead, tuple(p if k else None for p, k in zip(parts, kept))))
            if n - depth >= constant * n:
                keys.append(("rest", False, n, tuple(rest)))
            for key in keys:
                found[key].add(doc)
                held[key].add((at, i))
    drop = {x for key, docs in found.items() if len(docs) >= (2 if key[1] else least) for x in held[key]}
    return ["\n".join(x for i, x in enumerate(t.split("\n")) if (at, i) not in drop) if t else t for at, t in enumerate(texts)]


def prose(seed=2):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(1, 6))) for _ in range(300)]

    def line(n):
        return " ".join(r.choices(vocabulary, k=n))

    texts = [None, "", " \n\t", "only one line"]
    for i in range(60):
        lines = [line(r.randint(6, 25)) for _ in range(r.randint(2, 8))]
        if i % 2:
            lines.insert(r.randint(0, len(lines)), f"Page {r.randint(1, 99)} of {r.randint(100, 999)}")
        if i % 3 == 0:
            lines.insert(r.randint(0, len(lines)), f"Posted by the user {r.choice(vocabulary)} in the news section of this site today")
        if i % 4 == 0:
            lines.append("All rights reserved.")
        texts.append("\n".join(lines))
    copied = [line(20) for _ in range(6)]
    texts += ["\n".join(copied)] * 40
    for _ in range(40):
        near = list(copied)
        near[r.randrange(6)] += " " + r.choice(vocabulary)
        texts.append("\n".join(near))
    texts.append("\n".join([*copied, "All rights reserved."] * 3))
    return texts


def test_equals_brute_force(spark):
    texts = prose()
    frame = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)], "doc_id bigint, text string, n_lines string").repartition(4)
    df, n, dropped = dedup_lines(frame)
    got = {r.doc_id: r for r in df.collect()}
    assert (n, dropped) == ("_n_lines", "n_dropped") and got[5].n_lines == "y"
    want = brute(texts)
    assert [got[i].text for i in range(len(texts))] == want
    assert sum(w != t for w, t in zip(want, texts)) >= 40
    joined = "\n".join(w or "" for w in want)
    assert "All rights reserved." not in joined and "Page" not in joined and "Posted by" not in joined
    # copies and near copies are left whole
    assert all(got[i].text == texts[i] for i in range(64, len(texts) - 1))


def test_long_lines_many_lines_and_repeats(spark):
    long = "x" * 200_000 + "\n" + "\n".join(f"row {i}" for i in range(20_000))
    others = [f"{'abcdefg'[i]} start\nrow 7\n{'hijklmn'[i]} end" for i in range(7)]
    frame = spark.createDataFrame([(1, long), (1, long), (None, others[0]), *[(i, t) for i, t in enumerate(others)]], "doc_id bigint, text string")
    got = line_dedup(frame).collect()
    assert sorted(r.n_dropped for r in got) == [1] * 8 + [20_000] * 2
    assert {r.text for r in got if r.n_dropped > 1} == {"x" * 200_000}


def test_documents_left_without_words(spark):
    frame = spark.createDataFrame([(i, f"{'abcdefg'[i]} a\nSame line here\n{'abcdefg'[i]} b") for i in range(7)] + [(8, "Same line here"), (9, "")], "doc_id int, text string")
    df, _, dropped = dedup_lines(frame)
    assert sorted(r.doc_id for r in with_words_left(df, dropped).collect()) == [*range(7), 9]
    assert line_dedup(frame.filter("false")).collect() == []


def own_lines(r, n):
    return [" ".join("".join(r.choices("klmnopqrst", k=6)) for _ in range(12)) for _ in range(n)]


def test_blocks_edges_and_lines_of_large_copy_groups(spark):
    r = random.Random(5)
    block = ["Share this story with all friends", "Sign up for the daily letter", "Follow the editors on every channel"]
    header = ["The Daily Example of the town", "Home news sport weather and contact"]
    shared = "Read more stories like this one below"
    texts, want = ["\n".join(header[:1])], [""]
    for i in range(8):
        own = own_lines(r, 4)
        texts.append("\n".join([*header, *own[:2], *block, *own[2:], shared]))
        want.append("\n".join(own))
    copied = own_lines(r, 6)
    for i in range(60):
        near = list(copied)
        near[i % 6] += f" {r.choice('abcdefgh')}{r.choice('abcdefgh')}"
        texts.append("\n".join([*near, shared]))
        want.append("\n".join(near))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {x.doc_id: x.text for x in line_dedup(frame).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_a_leaf_holds_several_templates_and_other_lines(spark):
    r = random.Random(6)
    names = ["".join(r.choices("uvwxyz", k=5)) for _ in range(16)]
    texts, want = [], []
    for i, name in enumerate(names):
        own = own_lines(r, 3)
        ends = "for the evening edition of the town paper" if i % 2 else "at our office in the old harbour street"
        line = "Written by our quite another sentence about boats that sail away today" if i == 15 else f"Written by our {name} {ends}"
        texts.append("\n".join([own[0], line, *own[1:]]))
        want.append(texts[-1] if i == 15 else "\n".join(own))
    assert len({len(t.split("\n")[1].split()) for t in texts}) == 1
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {x.doc_id: x.text for x in line_dedup(frame).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_long_lines_recur_from_two_documents_on(spark):
    r = random.Random(7)
    passage = " ".join("".join(r.choices("ghijkl", k=5)) for _ in range(60))
    short, copied, texts = "Read all of this in the printed edition", own_lines(r, 5), []
    for _ in range(2):
        own = own_lines(r, 4)
        texts.append("\n".join([*own[:2], passage, short, *own[2:]]))
    kept = " ".join("".join(r.choices("mnopqr", k=5)) for _ in range(60))
    texts += ["\n".join([*copied, kept, x]) for x in ("the end", "no end yet")]  # near copies: one document
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {x.doc_id: x.text for x in line_dedup(frame).collect()}
    assert [got[i] for i in range(4)] == [t.replace(passage + "\n", "") for t in texts]


def test_boilerplate_that_outweighs_the_own_line(spark):
    r = random.Random(8)
    block = ["Share this story with all friends", "Sign up for the daily letter", "Follow the editors on every channel"]
    own = [own_lines(r, 1)[0] for _ in range(40)]
    frame = spark.createDataFrame([(i, "\n".join([*block, o])) for i, o in enumerate(own)], "doc_id bigint, text string").repartition(3)
    got = {x.doc_id: x for x in line_dedup(frame).collect()}
    assert [got[i].text for i in range(40)] == own and sum(x.n_dropped for x in got.values()) == 120


def test_leading_tokens_may_vary(spark):
    r = random.Random(9)
    texts, want = [], []
    for _ in range(40):
        names = ["".join(r.choices("uvwxyz", k=6)) for _ in range(2)]
        own = own_lines(r, 3)
        texts.append("\n".join([own[0], f"By {names[0]} {names[1]} staff writer of the daily paper", *own[1:]]))
        want.append("\n".join(own))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {x.doc_id: x.text for x in line_dedup(frame).collect()}
    assert [got[i] for i in range(40)] == want == brute(texts)


def test_recall_of_near_copy_groups(spark):
    """Pairs of one text with two words in a hundred changed, in long and in short lines, are one document."""
    r = random.Random(10)
    rows = []
    for i in range(300):
        words = ["".join(r.choices("abcdefghijklm", k=6)) for _ in range(400)]
        other = [w if r.random() > 0.02 else "changed" + "".join(r.choices("xyz", k=4)) for w in words]
        n = (10, 80, 400)[i % 3]
        rows += [(2 * i + k, "\n".join(" ".join(ws[j: j + n]) for j in range(0, 400, n))) for k, ws in enumerate((words, other))]
    arrays = line_arrays(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), "doc_id", "text", 3).cache()
    group = {x.node: x.component for x in copy_groups(arrays).collect()}
    h = {x.id: x.h for x in arrays.select("id", "h").collect()}
    pairs = [(2 * i, 2 * i + 1) for i in range(300) if len(shingles(rows[2 * i][1]) & shingles(rows[2 * i + 1][1])) >= 0.8 * len(shingles(rows[2 * i][1]) | shingles(rows[2 * i + 1][1]))]
    met = [h[a] == h[b] or h[a] in group and group[h[a]] == group.get(h[b]) for a, b in pairs]
    assert len(pairs) > 100 and sum(met) >= 0.97 * len(met)
    assert len(set(group.values())) == len({min(group[h[a]] for a in p if h[a] in group) for p in [(2 * i, 2 * i + 1) for i in range(300)] if any(h[a] in group for a in p)})


def test_odd_white_space_and_what_is_compiled(spark):
    """Blanks do not matter to a template, and sketches are sorted by compiled code: a generator runs uncompiled."""
    r = random.Random(11)
    kinds = ["All the news of the day", " All the news of the day", "All  the\tnews of the day ", "\tAll the news\x0b of \x0cthe day\r", "All the news of  the day"]
    words = " ".join("".join(r.choices("cdefgh", k=5)) for _ in range(30))
    texts, want = [None, "\n \n\t\r\n"], [None, "\n \n\t\r\n"]
    for i in range(10):
        own = own_lines(r, 3)
        varied = words.split(" ")
        varied[4 + i % 2] = f"{'abcdefghij'[i]}{i}x"
        texts.append("\n".join([own[0], kinds[i % 5], "", *own[1:], "  ".join(varied), f"{words} tail"]))
        want.append("\n".join([own[0], "", *own[1:]]))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {x.doc_id: x for x in line_dedup(frame).collect()}
    assert [got[i].text for i in range(len(texts))] == want == brute(texts)
    assert [got[i].n_lines for i in range(3)] == [1, 4, 7]
    plan = line_arrays(frame, "doc_id", "text", 3)._jdf.queryExecution().executedPlan().toString()
    generators = [x for x in re.split(r"\n(?=[ :+*(0-9)-]*\b[A-Z]\w+ )", plan) if re.match(r"[ :+*(0-9)-]*Generate", x)]
    assert generators and not any("sort_array" in x or "array_distinct" in x for x in generators)
