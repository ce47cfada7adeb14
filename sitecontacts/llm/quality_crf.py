"""Document quality from line labels of a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sitecontacts.llm.common import batches

_SYMBOL = re.compile(r"[#*$%&|<>{}\[\]\\^~=+_@]")
_DIGIT = re.compile(r"[0-9]")
_STOP = re.compile(r"[.!?,;:]")
_UPPER = re.compile(r"[^\W\d_]")
#: Features of a line; each also stands for the line before and the line after.
FEATURES = ("symbols", "digits", "stops", "bangs", "capitals", "word_length", "distinct", "runs", "repeated", "short", "ends", "size")


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths) of the lines of a text; a text without words is one empty line."""
    rows, lengths, seen = [], [], set()
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        n, chars = len(words), len(line)
        letters = len(_UPPER.findall(line)) or 1
        distinct = len(set(words))
        upper = sum(map(str.isupper, line))
        runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
        rows.append((
            min(len(_SYMBOL.findall(line)) / n, 3.0), len(_DIGIT.findall(line)) / chars, min(len(_STOP.findall(line)) / n, 2.0),
            min(line.count("!") / n, 2.0), upper / letters, min(chars / n, 30.0) / 10, distinct / n, runs / n,
            float(line in seen), float(n < 4), float(line.rstrip()[-1] in ".!?"), np.log1p(n) / 5,
        ))
        seen.add(line)
        lengths.append(chars)
    if not rows:
        return np.zeros((1, len(FEATURES))), np.ones(1)
    return np.array(rows), np.array(lengths, float)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Features of a line, of the lines before and after it, whether there are such, and a constant."""
    none = np.zeros((1, x.shape[1]))
    edge = np.zeros((len(x), 2))
    edge[0, 0] = edge[-1, 1] = 1
    return np.hstack([x, np.vstack([none, x[:-1]]), np.vstack([x[1:], none]), edge, np.ones((len(x), 1))])


@dataclass
class Field:
    """Parameters: weights of a good line, and scores of (before, now) labels, 0 bad and 1 good."""

    weights: np.ndarray
    moves: np.ndarray

    def marginals(self, sequences: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """(P(good) per line of every sequence, expected number of label moves over all sequences)."""
        order = sorted(range(len(sequences)), key=lambda k: -len(sequences[k]))
        lengths = np.array([len(sequences[k]) for k in order])
        total, starts = int(lengths.sum()), np.cumsum(lengths) - lengths
        scores = np.zeros((total, 2))
        scores[:, 1] = np.concatenate([sequences[k] for k in order]) @ self.weights
        forward, backward, moved = np.zeros((total, 2)), np.zeros((total, 2)), np.zeros((2, 2))
        live = [int((lengths > t).sum()) for t in range(int(lengths[0]))]
        for t, n in enumerate(live):  # forward over all sequences that reach line t at once
            at = starts[:n] + t
            if t:
                forward[at] = np.logaddexp(forward[at - 1, 0, None] + self.moves[0], forward[at - 1, 1, None] + self.moves[1])
            forward[at] += scores[at]
        for t in range(len(live) - 2, -1, -1):
            at = starts[: live[t + 1]] + t
            ahead = scores[at + 1] + backward[at + 1]
            backward[at] = np.logaddexp(ahead[:, 0, None] + self.moves[:, 0], ahead[:, 1, None] + self.moves[:, 1])
        z = np.logaddexp.reduce(forward[starts + lengths - 1], axis=1)
        norm = np.repeat(z, lengths)
        good = np.exp(forward[:, 1] + backward[:, 1] - norm)
        inner = np.ones(total, bool)
        inner[starts] = False
        at = np.nonzero(inner)[0]
        if len(at):
            for p in (0, 1):
                for q in (0, 1):
                    moved[p, q] = np.exp(forward[at - 1, p] + self.moves[p, q] + scores[at, q] + backward[at, q] - norm[at]).sum()
        out: list[np.ndarray] = [np.empty(0)] * len(sequences)
        for k, s, n in zip(order, starts, lengths, strict=True):
            out[k] = good[s: s + n]
        return out, moved


def fit(sequences: list[np.ndarray], labels: list[int], steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum conditional likelihood by Adam; every line of a document carries its label.

    Documents of the rarer label count more, so that both labels weigh the same. Without
    any documents, or with one label only, the field is fitted all the same.
    """
    width = 3 * len(FEATURES) + 3
    field = Field(np.zeros(width), np.zeros((2, 2)))
    if not sequences:
        return field
    y = np.array(labels)
    parts = [[sequences[k] for k in np.nonzero(y == v)[0]] for v in (0, 1)]
    flat = np.zeros(width + 4)
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, steps + 1):
        slope = decay * flat
        for v, part in enumerate(parts):
            if not part:
                continue
            lines = sum(map(len, part))
            good, moved = field.marginals(part)
            slope[:width] += (np.concatenate(good) - v) @ np.concatenate(part) / lines
            seen = np.zeros((2, 2))
            seen[v, v] = lines - len(part)
            slope[width:] += ((moved - seen) / lines).ravel()
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        flat = flat - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        field = Field(flat[:width], flat[width:].reshape(2, 2))
    return field


def scores(texts: list[str], field: Field) -> list[float]:
    """Length-weighted mean of P(good) over the lines of every text."""
    if not texts:
        return []
    lines = [line_features(t) for t in texts]
    good, _ = field.marginals([with_neighbours(x) for x, _ in lines])
    return [float(np.clip(g @ n / n.sum(), 0, 1)) for g, (_, n) in zip(good, lines, strict=True)]


def fold(key: str = "doc_id", folds: int = 5) -> Column:
    """Fold of a document: crc32 of its id as text; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, max_lines: int = 500) -> Field:
    """Fit on a bounded sample: the `sample` labelled rows outside fold 0 that come first in a hashed order.

    Rows without a label or an id, and labels without a document, are left out; of several
    labels of an id the smallest counts. Drawn documents of more than `max_lines` lines are not
    used to fit. The driver gets line features of these rows only: twelve numbers for each of at
    most `sample` times `max_lines` lines. Every document is scored, whatever its length.
    """
    chosen = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0))
        .groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "text"):
            x = [line_features(t)[0] for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "quality": frame["quality"], "x": [m.ravel() for m in x]})

    # the sample is bounded by `sample` rows, so it is sent to every task
    rows = (
        docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
        .filter(F.size(F.split("text", "\n")) <= max_lines)
        .mapInPandas(features, "doc_id bigint, quality int, x array<double>").toPandas()
    )
    rows = rows.sort_values(["doc_id"], kind="stable").drop_duplicates("doc_id")
    sequences = [with_neighbours(np.asarray(x).reshape(-1, len(FEATURES))) for x in rows["x"]]
    return fit(sequences, [int(q > 0) for q in rows["quality"]])


def score_documents(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) per document: 0 to 1, higher where a good document is likelier.

    Null and empty texts are scored as one empty line. Repeated rows stay, a null key stays
    null, extra columns are left aside, an empty table gives no rows. Whole texts are read.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "text", 4_000_000):
            yield pd.DataFrame({"id": frame["id"], "score": scores(frame["text"].tolist(), field)}).astype({"score": "float64"})

    got = docs.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text")).mapInPandas(run, "id string, score double")
    return got.select(F.col("id").cast(docs.schema[key].dataType).alias(key), "score")


def quality_crf(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Digest per document: whether it was held out, its score and the predicted label."""
    return score_documents(docs, train(docs, labels)).select(
        "doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
