"""Quality rules as a ledger of failure bits and measurements."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sitecontacts.llm.common import free_names, has_word, settled, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Measurements of a text, in the order of the ledger's columns.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


@dataclass(frozen=True)
class Rule:
    """A test on measurements; `fails` is SQL over the columns of MEASURES."""

    name: str
    bit: int
    fails: str


#: Every rule has a bit for good; new rules take new bits, so that old ledgers stay readable.
RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", 2, "10 * n_symbols > n_words"),
    Rule("repeated_lines", 3, "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines"),
    Rule("short_words", 4, "word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 14 * n_words"),
    Rule("capitals", 6, "100 * n_upper > 40 * word_chars"),
)

#: Rules that a policy version enforces; the ledger does not change when a policy does.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "many_symbols", "repeated_lines"),
    "v2": ("few_words", "repeated_words", "many_symbols", "repeated_lines", "short_words", "long_words", "capitals"),
}


def mask_of(policy: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    """Bits of the named rules; an unknown name is an error."""
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[name] for name in dict.fromkeys(policy))


def measured(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """Add the measurements of every text; returns the frame and their column names.

    n_repeat_words counts the words that lie in a window of three words found at least
    twice in the same text. Packed hashes with positions are sorted as plain longs to
    find the windows that may repeat; only those are compared as strings, so a text
    costs n log n and hash collisions change nothing. Each step is a column of its own,
    since a lambda evaluates an inlined expression once per element.
    """
    w, packed, spots, n_bits = free_names(docs, "w", "packed", "spots", "n_bits")
    names = dict(zip(MEASURES, free_names(docs, *MEASURES), strict=True))
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), has_word)
    shared = {"w": w, "p": packed, "b": n_bits, "s": spots}

    def sql(template: str) -> Column:
        for k, v in shared.items():
            template = template.replace(f"${k}", f"`{v}`")
        return F.expr(template)

    df = docs.withColumns({
        w: words_of(F.col(text)),
        names["n_symbols"]: F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("bigint"),
        names["n_lines"]: F.size(lines).cast("bigint"),
        names["n_dup_lines"]: (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        names["n_upper"]: F.regexp_count(body, F.lit(r"\p{Lu}")).cast("bigint"),
    })
    df = df.withColumns({
        names["n_words"]: F.size(w).cast("bigint"),
        names["word_chars"]: F.length(F.array_join(w, "")).cast("bigint"),
        n_bits: sql("length(bin(size($w) + 1))"),
    })
    df = df.withColumn(packed, F.sort_array(sql(
        "transform($w, (x, i) -> shiftleft(shiftright(xxhash64(x, get($w, i + 1), get($w, i + 2)), $b), $b) | cast(i as bigint))"
    )))
    # windows whose shortened hash another one shares, as (words, position), sorted; the last two starts hold no window
    df = df.withColumn(spots, sql(
        "array_sort(filter(transform(filter($p, (x, j) -> "
        "shiftright(x, $b) = shiftright(get($p, j + 1), $b) or shiftright(x, $b) = shiftright(get($p, j - 1), $b)), "
        "x -> named_struct('t', concat_ws(' ', slice($w, cast(x & (shiftleft(1L, $b) - 1) as int) + 1, 3)), "
        "'i', cast(x & (shiftleft(1L, $b) - 1) as int))), x -> x.i < size($w) - 2))"
    ))
    df = df.withColumn(spots, F.sort_array(sql(
        "transform(filter($s, (x, j) -> x.t = get($s, j + 1).t or x.t = get($s, j - 1).t), x -> x.i)"
    )))
    covered = sql("aggregate(zip_with($s, slice($s, 2, size($s)), (a, b) -> least(3, coalesce(b - a, 3))), 0L, (t, x) -> t + x)")
    out = {names[c]: covered if c == "n_repeat_words" else F.col(names[c]) for c in MEASURES}
    return settled(df, docs.columns, **out), names


def ledger(
    docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, bits: str = "fail_bits"
) -> tuple[DataFrame, str, dict[str, str]]:
    """Evaluate every rule once; bit k of the added long is set where the rule with bit k fails.

    Returns the frame, the name of the bit column and the names of the measurement
    columns (names already taken get a leading underscore). Null and empty texts have
    all measurements 0. Rows are neither dropped nor merged; repeated rows stay.
    """
    df, names = measured(docs, text)
    (out,) = free_names(df, bits)
    flags = F.lit(0).cast("bigint")
    for rule in rules:
        test = F.expr(_renamed(rule.fails, names))
        flags = flags.bitwiseOR(F.when(test, F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("bigint"))
    return df.withColumn(out, flags), out, names


def _renamed(test: str, names: Mapping[str, str]) -> str:
    return " ".join(f"`{names[t]}`" if t in names else t for t in test.split())


def passes(bits: Column, policy: Sequence[str], rules: Sequence[Rule] = RULES) -> Column:
    """True where none of the policy's rules failed."""
    return bits.bitwiseAND(F.lit(mask_of(policy, rules)).cast("bigint")) == 0


def ablations(
    df: DataFrame, bits: str, policies: Mapping[str, Sequence[str]] = POLICIES, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """Per policy and rule: documents failing the rule, rejected by the policy, and by this rule alone.

    Documents are first counted per distinct bit pattern (at most 2 ** rules rows), so
    every policy and every "policy without this rule" is a bitwise test on a few counts.
    An empty table gives rows of zeros.
    """
    patterns = df.groupBy(F.col(bits).alias("bits")).agg(F.count("*").alias("n"))
    rows = [(v, r.name, mask_of(p, rules), 1 << r.bit) for v, p in policies.items() for r in rules if r.name in p]
    tests = df.sparkSession.createDataFrame(rows, "policy string, rule string, mask bigint, bit bigint")
    n = F.coalesce(F.col("n"), F.lit(0))
    failed = F.coalesce(F.col("bits"), F.lit(0)).cast("bigint")
    hit = failed.bitwiseAND(F.col("mask"))
    # every test row meets every pattern: both sides are bounded by the number of rules
    return (
        tests.join(F.broadcast(patterns), F.col("mask") >= 0, "left").groupBy("policy", "rule")
        .agg(
            F.sum(F.when(failed.bitwiseAND(F.col("bit")) != 0, n).otherwise(0)).alias("n_failed"),
            F.sum(F.when(hit != 0, n).otherwise(0)).alias("n_rejected"),
            F.sum(F.when(hit == F.col("bit"), n).otherwise(0)).alias("n_only_this_rule"),
        )
    )


def quality_rules(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """Digest per document: measurements, failure bits and the verdict of a policy version."""
    df, bits, m = ledger(docs.select("doc_id", "text"))
    base = ~passes(F.col(bits), POLICIES["base"])
    return df.select(
        "doc_id", *[F.col(m[c]).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base.alias("base_failed"), (~base & passes(F.col(bits), POLICIES[policy])).alias("kept"),
        F.col(bits).alias("fail_bits"),
    )
