"""Line dedup by a log-template tree; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitecontacts.llm.common import SPACE, free_names, has_word, settled
from sitecontacts.llm.components import components
from sitecontacts.plans.lineage import materialize

_TOKEN = f"[^{SPACE[1:]}"
#: A token that holds a digit is a variable field. It is tried at the start of a token only, and in one pass.
_FIELD = rf"(?<!{_TOKEN})[^0-9{SPACE[1:]}*+[0-9]{_TOKEN}*"
_SEGMENTS = 4
#: A masked line of so many words recurs from two different documents on.
_LONG = 50
#: Words of a shingle, shingle hashes in a document's sketch, and bands of two neighbouring ones each.
_SHINGLE, _SKETCH, _BANDS = 5, 128, 10


def _segments(w: Column, n: Column, depth: int, less: Column) -> list[Column]:
    """Hashes of the tokens after the leading ones as four runs of about equal length; null for an empty run.

    `w` stands for the tokens, by one number each, or by the shingles from each on: then a run has `less` of them.
    """
    rest = F.greatest(n - depth, F.lit(0))
    ends = [depth + F.floor(rest * q / _SEGMENTS).cast("int") for q in range(_SEGMENTS + 1)]
    return [F.when(b > a, F.xxhash64(F.slice(w, a + 1, b - a - less))) for a, b in zip(ends, ends[1:], strict=False)]


def _masked(line: Column) -> Column:
    """A line with its variable fields masked and one blank between tokens; most lines are that already."""
    odd = line.rlike("[0-9\\x09\\x0B-\\x0D]") | line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    return F.when(odd, F.trim(F.regexp_replace(F.regexp_replace(line, _FIELD, "<*>"), f"{SPACE}+", " "))).otherwise(line)


def _shingles(w: Column) -> Column:
    """Hash of each shingle; absent words add nothing to a hash, so a line of fewer words is hashed whole."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - _SHINGLE, F.lit(0)))
    return F.transform(starts, lambda i: F.xxhash64(F.get(w, i), *[F.get(w, i + k) for k in range(1, _SHINGLE)]))


def line_arrays(docs: DataFrame, key: str, text: str, depth: int) -> DataFrame:
    """One row per line with a word; a document's first one has a sketch of its shingles, and band keys of the sketch.

    The tree has fixed depth: a node per token count, then one per leading token, variable
    fields masked. `leaf` is the path; `whole` the masked line; s0 to s3 stand for the
    segments of its remaining tokens (null if empty). Shingles are five masked tokens of one
    line (a shorter line is one shingle); the sketch holds the smallest hashes of all of a
    document's shingles, and each band key is made of two neighbours in it.

    Only what needs a lambda is in the generator: Spark runs both uncompiled, but compiles
    the sorting and the rows of lines, which are made of the numbers of the tokens.
    """
    df = docs.select(F.col(key).alias("id"), F.xxhash64(F.lit(3), F.col(text)).alias("h"), F.col(text).alias("body")).filter(has_word(F.col("body")))
    made = F.transform(F.split("body", "\n"), lambda line, i: F.struct(i.alias("line"), _masked(line).alias("text")))

    # from so many tokens on, every segment has a shingle, and the shingles in it stand for its tokens
    long = depth + _SEGMENTS * _SHINGLE

    def hashed(p: Column) -> Column:
        # a single blank is cut at without a regular expression; the inner lambda keeps the words, so that they are cut once
        def each(w: Column) -> Column:
            n = F.size(w)
            tokens = F.when(n < long, F.transform(w, lambda x: F.xxhash64(x)))
            leaf = F.xxhash64(n, *[F.get(w, F.lit(k)) for k in range(depth)])
            return F.struct(p["line"].alias("line"), n.alias("n"), leaf.alias("leaf"), tokens.alias("w"), _shingles(w).alias("shingles"))

        return F.get(F.transform(F.array(F.split(p["text"], " ")), each), F.lit(0))

    df = settled(df, ["id", "h"], lines=F.transform(F.filter(made, lambda p: p["text"] != ""), hashed))
    df = df.withColumn("all", F.sort_array(F.flatten(F.col("lines.shingles"))))
    # mostly the first few hold enough different ones
    df = df.withColumn("few", F.array_distinct(F.slice("all", 1, 2 * _SKETCH)))
    enough = (F.size("few") >= _SKETCH) | (F.size("all") <= 2 * _SKETCH)
    df = df.withColumn("sketch", F.slice(F.when(enough, F.col("few")).otherwise(F.array_distinct("all")), 1, _SKETCH))
    first = F.slice("sketch", 1, F.greatest(F.least(F.size("sketch") - 1, F.lit(_BANDS)), F.lit(1)))
    df = df.withColumn("bands", F.transform(first, lambda x, i: F.xxhash64(x, F.get("sketch", i + 1))))
    df = df.select("id", "h", "sketch", "bands", F.posexplode("lines").alias("at", "p"))
    df = df.select("id", "h", "sketch", "bands", "at", "p.line", "p.n", "p.leaf", F.coalesce("p.w", "p.shingles").alias("w"))
    w, n = F.col("w"), F.col("n")
    less = F.when(n < long, F.lit(0)).otherwise(F.lit(_SHINGLE - 1))
    return df.select(
        "id", "h", "line", "n", "leaf", F.xxhash64(w).alias("whole"), *[s.alias(f"s{q}") for q, s in enumerate(_segments(w, n, depth, less))],
        *[F.when(F.col("at") == 0, F.col(c)).alias(c) for c in ("sketch", "bands")],
    )


def similarity(a: Column, b: Column) -> Column:
    """Share of common shingles among all of two documents, from their sketches.

    The smallest hashes of both together are a random choice of all their shingles. Where
    both sketches hold every shingle of their documents the share is exact.
    """
    both = F.array_union(a, b)
    whole = (F.size(a) < _SKETCH) & (F.size(b) < _SKETCH)
    seen = F.when(whole, both).otherwise(F.slice(F.sort_array(both), 1, _SKETCH))
    return F.size(F.array_intersect(F.array_intersect(a, b), seen)) / F.size(seen)


def copy_groups(arrays: DataFrame, least: float = 0.7) -> DataFrame:
    """(node, component) of texts, by hash, that are near copies of others; texts that are alone are left out.

    Texts that share a band meet the member of it that shares most bands. They are linked
    from a similarity of `least` on; it lies below 0.8 as sketches err by 0.04 (one sigma).
    Documents that share boilerplate only are below it unless that is most of their words.
    """
    arrays = arrays.filter(F.col("sketch").isNotNull())
    bands = arrays.select("h", F.explode("bands").alias("band")).distinct()
    crowded = bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    multi = materialize(bands.join(crowded, "band"))
    central = multi.groupBy("h").agg(F.sum("n").alias("w"))
    pivots = multi.join(central, "h").groupBy("band").agg(F.max(F.struct("w", "h")).alias("p")).select("band", F.col("p.h").alias("b"))
    pairs = multi.join(pivots, "band").filter("h <> b").select(F.col("h").alias("a"), "b").distinct()
    sketches = materialize(arrays.select("h", "sketch").join(central.select("h"), "h", "left_semi").dropDuplicates(["h"]))
    both = pairs.join(sketches.select(F.col("h").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("h").alias("b"), F.col("sketch").alias("sb")), "b")
    return components(both.filter(similarity(F.col("sa"), F.col("sb")) >= least).select("a", "b"))


def line_rows(arrays: DataFrame) -> DataFrame:
    """One row per line with a word."""
    return arrays.drop("sketch", "bands")


def with_document(lines: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds `doc`, which is the same for a text and its near copies."""
    df = lines.join(groups.withColumnsRenamed({"node": "h"}), "h", "left")
    return df.withColumn("doc", F.coalesce("component", "h")).drop("component")


def _least(n: str, min_contexts: int) -> Column:
    """Different documents from which on a line of n words recurs."""
    return F.when(F.col(n) >= _LONG, F.lit(min(2, min_contexts))).otherwise(F.lit(min_contexts))


def recurring_templates(lines: DataFrame, depth: int, min_contexts: int, constant: float) -> DataFrame:
    """(leaf, whole) of the masked lines that belong to a recurring template.

    A template recurs if it stands in at least `min_contexts` different documents, near
    copies counted once; two are enough for a whole line of 50 words. A template is a masked line or one with some of its segments
    generalised, where the others and the leading tokens make at least `constant` of its
    tokens. Every set of segments is tried, so a leaf holds any number of templates and other
    lines of the leaf do not matter.
    """
    segments = [f"s{q}" for q in range(_SEGMENTS)]
    by_line = materialize(lines.groupBy("leaf", "whole", "doc").agg(F.first("n").alias("n"), *[F.first(s).alias(s) for s in segments]))
    whole = by_line.groupBy("leaf", "whole").agg(F.count("*").alias("docs"), F.first("n").alias("n")).filter(F.col("docs") >= _least("n", min_contexts)).select("leaf", "whole")
    crowded = by_line.groupBy("leaf", "doc").agg(F.lit(1)).groupBy("leaf").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_contexts).select("leaf")

    rest = F.greatest(F.col("n") - depth, F.lit(0))
    ends = [F.floor(rest * q / _SEGMENTS) for q in range(_SEGMENTS + 1)]

    def general(kept: int) -> Column:
        """Key of the template that keeps the segments of a bit set; null if it keeps too little, or all there is."""
        same, open_ = F.least("n", F.lit(depth)), F.lit(True)
        for q, s in enumerate(segments):
            if kept >> q & 1:
                same = same + ends[q + 1] - ends[q]
            else:
                open_ = open_ & F.col(s).isNotNull()
        key = F.xxhash64(F.lit(kept), *[s for q, s in enumerate(segments) if kept >> q & 1])
        return F.when(open_ & (same >= F.lit(constant) * F.col("n")), key)

    keys = F.explode(F.array_compact(F.array(*[general(kept) for kept in range(2**_SEGMENTS - 1)])))
    tried = by_line.join(crowded, "leaf", "left_semi").select("leaf", "whole", "doc", keys.alias("key"))
    recurs = tried.groupBy("leaf", "key", "doc").agg(F.lit(1)).groupBy("leaf", "key").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_contexts)
    return whole.unionByName(tried.join(recurs.select("leaf", "key"), ["leaf", "key"], "left_semi").select("leaf", "whole")).distinct()


def open_lead_lines(lines: DataFrame, groups: DataFrame, depth: int, min_contexts: int, constant: float) -> DataFrame:
    """The lines below the wildcard child of every leading token: whatever these are, the rest recurs.

    Only where the remaining tokens alone make at least `constant` of a line. Any template
    that keeps some leading tokens and this rest is part of the one that keeps none.
    """
    ending = lines.filter(F.col("n") - depth >= F.lit(constant) * F.col("n"))
    ending = ending.select("id", "h", "line", F.xxhash64("n", *[f"s{q}" for q in range(_SEGMENTS)]).alias("rest"))
    seen = ending.groupBy("rest").agg(F.count("*").alias("c"), (F.min("h") < F.max("h")).alias("several"))
    ending = ending.join(seen.filter(F.col("several") & (F.col("c") >= min_contexts)).select("rest"), "rest", "left_semi")
    ending = materialize(with_document(ending, groups))
    recurs = ending.groupBy("rest", "doc").agg(F.lit(1)).groupBy("rest").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_contexts)
    return ending.join(recurs.select("rest"), "rest", "left_semi").select("id", "h", "line")


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = 3, min_contexts: int = 5, constant: float = 0.6
) -> tuple[DataFrame, str, str]:
    """Documents without their lines of recurring templates; adds the numbers of lines and of dropped lines.

    Returns the frame and the two names (taken names get a leading underscore). Kept lines
    stay as they were, with the line ends between them; a text that loses no line is
    unchanged, null stays null. Every occurrence of a recurring template goes. All other
    columns stay. Rows are told apart by key and text, so repeated rows, and null keys,
    lose the same lines. An empty table gives no rows.
    """
    lines_name, dropped_name, h, gone, ls, keep, fresh, id_, h_ = free_names(
        docs, "n_lines", "n_dropped", "h", "gone", "ls", "keep", "fresh", "drop_id", "drop_h"
    )
    arrays = materialize(line_arrays(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), key, text, depth))
    groups, lines = materialize(copy_groups(arrays)), line_rows(arrays)
    # a leaf of one text, or of too few lines, holds no recurring template
    leaves = lines.groupBy("leaf").agg(F.first("n").alias("n"), F.count("*").alias("c"), (F.min("h") < F.max("h")).alias("several"))
    crowded = lines.join(leaves.filter(F.col("several") & (F.col("c") >= _least("n", min_contexts))).select("leaf"), "leaf", "left_semi")
    crowded = materialize(with_document(crowded, groups))
    templates = recurring_templates(crowded, depth, min_contexts, constant)
    drops = crowded.join(templates, ["leaf", "whole"]).select("id", "h", "line").unionByName(open_lead_lines(lines, groups, depth, min_contexts, constant)).distinct()
    drops = drops.select(F.col("id").alias(id_), F.col("h").alias(h_), "line").groupBy(id_, h_).agg(F.collect_list("line").alias(gone))
    df = docs.withColumn(h, F.xxhash64(F.lit(3), F.col(text)))
    df = df.join(drops, F.col(f"`{key}`").eqNullSafe(F.col(id_)) & (F.col(h) == F.col(h_)), "left")
    df = df.withColumn(ls, F.when(F.col(gone).isNotNull(), F.split(F.col(text), "\n")))
    df = df.withColumn(keep, F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone))
    breaks = F.octet_length(F.col(text)) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    left = F.array_join(F.transform(keep, lambda i: F.get(F.col(ls), i)), "\n")
    df = settled(
        df, docs.columns, **{fresh: F.when(F.col(gone).isNull(), F.col(text)).otherwise(left),
                             lines_name: (1 + F.coalesce(breaks, F.lit(0))).cast("bigint"), dropped_name: F.coalesce(F.size(gone), F.lit(0)).cast("bigint")},
    )
    columns = [F.col(fresh).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return df.select(*columns, lines_name, dropped_name), lines_name, dropped_name


def with_words_left(df: DataFrame, dropped: str, text: str = "text") -> DataFrame:
    """Leave out documents that lost lines and have no word left."""
    return df.filter((F.col(dropped) == 0) | has_word(F.col(text)))


def line_dedup(docs: DataFrame) -> DataFrame:
    """Digest per document: the text that stays, its lines and dropped lines."""
    df, n, dropped = dedup_lines(docs.select("doc_id", "text"))
    return df.select("doc_id", "text", F.col(n).alias("n_lines"), F.col(dropped).alias("n_dropped"))
