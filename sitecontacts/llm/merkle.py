"""Merkle manifest of a dataset: per-document proofs from incrementally extended witnesses."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sitecontacts.plans.lineage import materialize

#: Children of a node.
_ARITY = 3
#: Levels that one task closes over a block of 3^8 neighbouring nodes.
_HEIGHT = 8
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


class OpenTree:
    """A tree that grows by appends on the right; every leaf carries the witness it has so far.

    Per level at most two closed nodes wait for a sibling. A node is (digest, first leaf, last
    leaf). When a run is full, or the tree ends, the witness of each leaf below is extended by
    the digests of the run's other nodes, and the run's digest is appended one level up.
    """

    def __init__(self, height: int):
        self.height = height
        self.open: list[list[tuple[bytes, int, int]]] = [[] for _ in range(height + 1)]
        self.steps: list[list[bytes]] = []

    def append(self, digest: bytes) -> None:
        at = len(self.steps)
        self.steps.append([])
        self._place(0, (digest, at, at + 1))

    def _place(self, level: int, node: tuple[bytes, int, int]) -> None:
        self.open[level].append(node)
        if level < self.height and len(self.open[level]) == _ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [d for d, _, _ in run]
        for k, (_, first, last) in enumerate(run):
            # a step: the place among the run's nodes, the number of the others, and these from left to right
            step = bytes([k, len(run) - 1]) + b"".join(digests[:k] + digests[k + 1:])
            for leaf in range(first, last):
                self.steps[leaf].append(step)
        self._place(level + 1, (_hashed(digests), run[0][1], run[-1][2]))

    def finish(self) -> bytes:
        """Close what is open up to the height; the digest at the top."""
        for level in range(self.height):
            if self.open[level]:
                self._close(level)
        return self.open[self.height][0][0]


def _hashed(digests: list[bytes]) -> bytes:
    """Digest of digests as hex text."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def _walk(steps: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place, other digests) from the leaf's run to the root's."""
    at = 0
    while at < len(steps):
        k, n = steps[at], steps[at + 1]
        yield k, [steps[at + 2 + 32 * i: at + 34 + 32 * i] for i in range(n)]
        at += 2 + 32 * n


def fold(leaf: bytes, steps: bytes) -> bytes:
    """The root that a leaf and its steps give."""
    for k, others in _walk(steps):
        leaf = _hashed([*others[:k], leaf, *others[k:]])
    return leaf


def proof(steps: bytes) -> str:
    """Hash of the siblings of all steps."""
    return _hashed([d for _, others in _walk(steps) for d in others]).hex()


def _positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Number the rows of every `grp` from 0 in `order`, and count them as `n`.

    Rows are dealt by ranges of group, order and a row number of their own, so a group of any
    size is spread over tasks; one count per group and range comes together.
    """
    own = materialize(df.withColumn("uid", F.monotonically_increasing_id()))
    keys = ["grp", *order, "uid"]
    dealt = own.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("uid")
    # numbers of rows in order: the task's number times 2^33, plus the row's number in the task
    dealt = materialize(dealt.withColumn("no", F.monotonically_increasing_id())).withColumn("part", F.shiftright("no", 33))
    counts = dealt.groupBy("grp", "part").agg(F.count("*").alias("c"), F.min("no").alias("first"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "grp", "part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("c").over(Window.partitionBy("grp")).alias("n"),
    )
    return dealt.join(offsets, ["grp", "part"]).withColumn("at", F.col("no") + F.col("shift")).drop("part", "no", "shift")


def _levels(n: Column) -> Column:
    """Levels that a block of a group of n nodes closes: to the top where they are few, else `_HEIGHT`."""
    out = F.lit(_HEIGHT)
    for h in range(_HEIGHT - 1, -1, -1):
        out = F.when(n <= _ARITY**h, h).otherwise(out)
    return out


def _blocks(nodes: DataFrame, **carried: str) -> DataFrame:
    """(grp, at, digest, n) to one row per node, with its steps inside its block and the block's root.

    `carried` names further columns that stay, with their types.
    """
    names = ["grp", "block", "at", "digest", *carried]

    def close(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tree, rows = None, None, []

        def done() -> pd.DataFrame:
            top = tree.finish()
            return pd.DataFrame(rows, columns=names).assign(steps=[b"".join(s) for s in tree.steps], top=top)

        for frame in frames:
            for height, row in zip(frame["height"], zip(*(frame[c] for c in names), strict=True), strict=True):
                if key != row[:2]:
                    if tree is not None:
                        yield done()
                    key, tree, rows = row[:2], OpenTree(height), []
                tree.append(row[3])
                rows.append(row)
        if tree is not None:
            yield done()

    dealt = nodes.withColumn("block", F.floor(F.col("at") / _ARITY**_HEIGHT).cast("bigint")).withColumn("height", _levels(F.col("n")))
    dealt = dealt.repartition("grp", "block").sortWithinPartitions("grp", "block", "at")
    kinds = "".join(f", {c} {kind}" for c, kind in carried.items())
    return dealt.select("height", *names).mapInPandas(close, f"grp string, block bigint, at bigint, digest binary{kinds}, steps binary, top binary")


def trees(nodes: DataFrame, **carried: str) -> tuple[DataFrame, DataFrame]:
    """Witnesses and roots of one tree per group over nodes (grp, at, digest, n).

    Blocks of neighbouring nodes are closed by single tasks. The roots of a group's blocks are
    then appended to further blocks of their own, until a group has one, and their steps
    extend the witnesses of what lies below. Returns (grp, digest, carried columns, steps) and
    (grp, root).
    """
    steps = tops = materialize(_blocks(nodes, **carried))
    while True:
        tops = tops.select("grp", F.col("block").alias("at"), F.col("top").alias("digest")).distinct()
        tops = tops.join(tops.groupBy("grp").agg(F.count("*").alias("n")), "grp")
        if tops.filter("n > 1").isEmpty():
            return steps.select("grp", "digest", *carried, "steps"), tops.select("grp", F.col("digest").alias("root"))
        # a group that is done has one node, which gets no step and stays as it is
        tops = materialize(_blocks(tops))
        upper = tops.select("grp", F.col("at").alias("block"), F.col("block").alias("up"), F.col("steps").alias("more"))
        steps = steps.join(upper, ["grp", "block"]).withColumns({"block": F.col("up"), "steps": F.concat("steps", "more")}).drop("up", "more")


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the fields: `-` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """Per document its leaf, its source's root, the root of all, its steps and a leaf to verify, in binary.

    Leaves of a source ascend by doc_id, null first. Rows of one doc_id ascend by leaf; rows that
    are equal in all five columns have equal leaves and follow each other, each with a proof of
    its own. A null source is a source of its own, first of all. Every third of three
    neighbouring nodes closes a run; a last run has fewer. An empty table gives no rows. Only
    the five named columns are read, so others may have any name. Texts are hashed where they
    are read, whole at any length, and never shuffled.

    `tampered` is the leaf after the text lost its line ends, for documents whose crc32 of the
    decimal id is even, else the leaf itself; a null id is never tampered with.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    fields = {c: F.col(c) for c in _FIELDS}
    # only texts that hold a line end change, so only those are hashed again
    bad = hit & F.contains(F.col("text"), F.lit("\n"))
    changed = leaf_digest(list((fields | {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}).values()))
    slim = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-")).alias("grp"), "doc_id",
        leaf_digest(list(fields.values())).alias("digest"), F.when(bad, changed).alias("changed"),
    )
    # ids travel as text, since pandas would turn a column with a missing id into floats
    leaves, subroots = trees(
        _positions(slim, ["doc_id", "digest"]).withColumn("doc_id", F.col("doc_id").cast("string")), doc_id="string", changed="binary"
    )
    top = _positions(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("digest")), ["name"])
    upper, root = trees(top, name="string")
    found = root.first()
    upper = materialize(upper.select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), F.col("steps").alias("more")))
    return leaves.join(upper, "grp").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("digest").alias("leaf"), F.coalesce("changed", "digest").alias("tampered"),
        "subroot", F.lit(None if found is None else bytes(found.root)).cast("binary").alias("root"), F.concat("steps", "more").alias("steps"),
    )


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """Digest per document: its proof, hashed, and whether its leaf, tampered with or not, still folds to the root."""
    @F.pandas_udf("struct<proof_sha256 string, folded_root string>")
    def check(leaf: pd.Series, steps: pd.Series) -> pd.DataFrame:
        folded = [fold(x, s).hex() for x, s in zip(leaf, steps, strict=True)]
        return pd.DataFrame({"proof_sha256": [proof(s) for s in steps], "folded_root": folded})

    df = manifest(docs).withColumn("f", check("tampered", "steps"))
    texts = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "root")}
    return df.select(
        "doc_id", *[v.alias(c) for c, v in texts.items()], "f.proof_sha256", "f.folded_root",
        (F.col("f.folded_root") == texts["root"]).alias("verified"),
    )
