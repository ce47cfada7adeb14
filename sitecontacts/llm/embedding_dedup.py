"""Near-duplicate vectors by quantised tile products with rigorous error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sitecontacts.llm.components import components
from sitecontacts.plans.lineage import materialize

_DIMS = 1024  # products of this many int8 values are exact in float32
_SURE = 1e-9  # far above the rounding of the double arithmetic below


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scale and the length of what the codes miss, per row of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    missed = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes.astype(np.int8), scale, missed


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix: cosine of rows of x and y in double precision >= threshold.

    With u = s q + e, u.v = s_u s_v q_u.q_v + e_u.(v - e_v) + u.e_v, so the integer product is
    off by at most |e_u| (1 + |e_v|) + |e_v|. Pairs beyond that bound on either side are
    decided; the others are computed in full.
    """
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    v = y / np.linalg.norm(y, axis=1, keepdims=True)
    (qu, su, eu), (qv, sv, ev) = quantised(u), quantised(v)
    near = np.zeros((len(u), len(v)))
    for at in range(0, u.shape[1], _DIMS):
        near += qu[:, at:at + _DIMS].astype(np.float32) @ qv[:, at:at + _DIMS].astype(np.float32).T
    near *= su[:, None]
    near *= sv[None, :]
    bound = eu[:, None] * (1 + ev[None, :]) + ev[None, :] + _SURE
    linked = near >= threshold + bound
    i, j = np.nonzero((near >= threshold - bound) & ~linked)
    for at in range(0, len(i), 65_536):
        p, q = i[at:at + 65_536], j[at:at + 65_536]
        linked[p, q] = np.einsum("nd,nd->n", u[p], v[q]) >= threshold
    return linked


def _forest(linked: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a tile's links: at most rows + cols - 1 edges join what the links join."""
    edges: list[tuple[int, int]] = []
    new_rows, new_cols = np.ones(len(rows), bool), np.ones(len(cols), bool)
    for start in range(len(rows)):
        if not new_rows[start]:
            continue
        new_rows[start], front = False, [start]
        while front:
            r = front.pop()
            for c in np.nonzero(linked[r] & new_cols)[0]:
                new_cols[c] = False
                edges.append((int(rows[r]), int(cols[c])))
                for k in np.nonzero(linked[:, c] & new_rows)[0]:
                    new_rows[k] = False
                    edges.append((int(rows[k]), int(cols[c])))
                    front.append(int(k))
    return edges


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    threshold: float = 0.98, block: int = 1024,
) -> DataFrame:
    """One row per vector: key, n_links, component_id.

    Vectors of one label and one dimension are compared, cosine in double precision.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows
    with a null label, have no links and are components of their own. Rows with equal
    labels and vectors are one class: its members link with each other and the class is
    compared once. Keys are unique; extra columns are left aside. An empty table gives no rows.

    Classes of a label are dealt into blocks of about `block` by hash. A tile of two blocks is
    a task's group, so a hot label becomes many groups of bounded size; its vectors travel once
    per block, and a tile returns counts and a spanning forest, never its pairs.
    """
    v = F.col("v")
    good = F.size(v) > 0
    good &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("l"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", F.coalesce(good & F.col("l").isNotNull(), F.lit(False)))
    # -0.0 and 0.0 are one value to a group
    bits = F.transform(v, lambda x: x + F.lit(0.0))
    grouped = rows.filter("ok").groupBy("l", bits.alias("v")).agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = materialize(grouped.withColumn("d", F.size("v")))
    blocks = classes.groupBy("l", "d").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("blocks"))
    dealt = classes.join(blocks, ["l", "d"]).withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    tiles = dealt.select("l", "d", "rep", "n", "v", "blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select(
        "l", "d", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "rep", "n", "v", "blk"
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        left = group[group["blk"] == i]
        right = group[group["blk"] == j]
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        x, y = (np.stack(g["v"].to_numpy()).astype(np.float64) for g in (left, right))
        x, y = (m / np.abs(m).max(axis=1, keepdims=True) for m in (x, y))  # no overflow of squares
        a, b = (g["rep"].to_numpy(np.int64) for g in (left, right))
        linked = tile_links(x, y, threshold)
        if i == j:
            np.fill_diagonal(linked, False)
        found = [(r, r, int(n)) for r, n in zip(a, linked @ right["n"].to_numpy(np.int64), strict=True) if n]
        if i != j:
            found += [(r, r, int(n)) for r, n in zip(b, linked.T @ left["n"].to_numpy(np.int64), strict=True) if n]
        found += [(p, q, 0) for p, q in _forest(linked, a, b)]
        return pd.DataFrame(found, columns=["a", "b", "n"]).astype("int64")

    found = materialize(tiles.groupBy("l", "d", "i", "j").applyInPandas(compare, "a bigint, b bigint, n bigint"))
    links = found.filter("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    groups = components(found.filter("a <> b")).withColumnsRenamed({"node": "rep"})
    per_class = (
        classes.join(links, "rep", "left").join(groups, "rep", "left")
        .select("l", "v", "n", "rep", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    joined = rows.withColumn("v", F.when(F.col("ok"), bits)).join(
        per_class.withColumnsRenamed({"l": "cl", "v": "cv"}), F.col("ok") & (F.col("l") == F.col("cl")) & (F.col("v") == F.col("cv")), "left"
    )
    return joined.select(
        F.col("id").alias(key), F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "id").cast("bigint").alias("component_id"),
    )


def embedding_dedup(vectors: DataFrame) -> DataFrame:
    """Digest per vector, with whether it is the one its component keeps."""
    return near_vectors(vectors).withColumn("kept", F.col("vec_id") == F.col("component_id"))
