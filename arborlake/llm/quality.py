"""A quality classifier: regularised quadratic discriminant analysis of document statistics.

Every whole text becomes a vector of transformed statistics (logarithms, square roots of smoothed shares). Each class
has a mean and a covariance that is shrunk towards the pooled one and towards a multiple of the identity; its Cholesky
factor is made once and cached in the model. The score is the posterior of class 1: the difference of the two
log densities, from Mahalanobis distances by triangular solves, and the classes' shares.

The model is fitted on at most SAMPLE labelled rows (a documented bound); all rows are scored. Defined results: null
and empty texts are scored like any other, with all statistics at their smallest; without labelled rows of both
classes the score is the share of class 1 (0.5 without any); repeated rows and other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm import features
from arborlake.llm.training import held_in_labels, remainder
from arborlake.llm.shared import slices

SAMPLE = 12_000
SHRINK_POOLED, SHRINK_IDENTITY = 0.8, 0.1
THRESHOLD = 0.3

STATISTICS = (
    "log_words", "letters", "capitals", "digits", "punctuation", "symbols", "spaces", "wide", "mean_word", "spread_word",
    "shouted", "marked_ends", "stops", "commas", "repeated_lines", "repeated_words", "repeated_shingles", "short_words", "doubled_signs",
)


def statistics(texts: list[str]) -> np.ndarray:
    t = features.Texts(texts)
    kind, points = t.kind, t.points
    chars = t.total(np.ones(len(points), bool))
    letters = t.total(kind & features.LETTER != 0)
    sign = kind & features.SIGN != 0
    starts, ends, own = t.runs(kind & features.SPACE == 0)
    sizes = (ends - starts).astype(np.float64)
    words = t.per_text(own)
    total, squares = t.per_text(own, sizes), t.per_text(own, sizes * sizes)
    mean = total / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(squares / np.maximum(words, 1) - mean * mean, 0))
    if len(starts):
        capital = np.add.reduceat((kind & features.CAPITAL != 0).astype(np.int64), starts)
        letter = np.add.reduceat((kind & features.LETTER != 0).astype(np.int64), starts)
    else:
        capital = letter = np.empty(0, np.int64)
    shout = t.per_text(own, (capital == letter) & (letter > 1))
    last = points[ends - 1] if len(ends) else np.empty(0, np.uint32)
    sentence = np.isin(last, np.array([ord(c) for c in ".,;:!?"], dtype=np.uint32))
    marked = t.per_text(own, (sign[ends - 1] if len(ends) else np.empty(0, bool)) & ~sentence)
    value = features.hashes(points, starts, ends)
    three = own[2:] == own[:-2]
    shingles = (value[:-2] * np.uint64(3) + value[1:-1][: len(three)] * np.uint64(5) + value[2:] * np.uint64(7))[three]
    owner = own[2:][three]
    lines = t.runs(points != 0x0A)
    stop = np.isin(points, np.array([0x2E, 0x21, 0x3F], dtype=np.uint32))
    twice = np.concatenate(([False], sign[1:] & (points[1:] == points[:-1]))) & ~t.first[:-1] if len(points) else sign
    ascii_marks = np.isin(points, np.frombuffer(b"#$%&*<>{}[]|~^_=+\\/@", dtype=np.uint8).astype(np.uint32))

    def share(part: np.ndarray, whole: np.ndarray, prior: float) -> np.ndarray:
        return np.sqrt(part / (whole + prior))

    line_count, shingle_count = t.per_text(lines[2]), t.per_text(owner)
    return np.column_stack(
        [
            np.log1p(words),
            letters / np.maximum(chars, 1),
            share(t.total(kind & features.CAPITAL != 0), letters, 100),
            share(t.total(kind & features.DIGIT != 0), chars, 200),
            share(t.total(sign), chars, 200),
            share(t.total(ascii_marks), chars, 200),
            share(t.total(kind & features.SPACE != 0), chars, 50),
            share(t.total(points > 0x7F), chars, 200),
            (total + 5 * 20) / (words + 20),
            spread * np.sqrt(words / (words + 20)),
            share(shout, words, 30),
            share(marked, words, 30),
            share(t.total(stop), words, 30),
            share(t.total(points == 0x2C), words, 30),
            share(line_count - t.different(lines[2], features.hashes(points, lines[0], lines[1])), line_count, 8),
            share(words - t.different(own, value), words, 60),
            share(shingle_count - t.different(owner, shingles), shingle_count, 60),
            share(t.per_text(own, sizes <= 3), words, 30),
            share(t.total(twice), chars, 200),
        ]
    )


class Discriminant:
    """Means, shrunk covariances' Cholesky factors and log shares of two classes."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pooled: float = SHRINK_POOLED, identity: float = SHRINK_IDENTITY) -> None:
        self.share = float(y.mean()) if len(y) else 0.5
        self.fitted = len(set(y.tolist())) == 2 and min((y == 0).sum(), (y == 1).sum()) > 1
        if not self.fitted:
            return
        self.middle, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.middle) / self.scale
        own = [np.cov(z[y == c].T) for c in (0, 1)]
        both = sum(np.count_nonzero(y == c) * own[c] for c in (0, 1)) / len(y)
        self.classes = []
        for c in (0, 1):
            s = (1 - pooled) * own[c] + pooled * both
            s = (1 - identity) * s + identity * np.trace(s) / len(s) * np.eye(len(s))
            factor = np.linalg.cholesky(s)
            self.classes.append((z[y == c].mean(axis=0), np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        z = (x - self.middle) / self.scale
        log = [-0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) - size for mean, inverse, size in self.classes]
        odds = log[1] - log[0] + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [statistics(run) for run in features.pieces(batch.column(1).to_pylist())]
        x = np.concatenate(rows) if rows else np.empty((0, len(STATISTICS)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Discriminant:
    chosen = F.broadcast(held_in_labels(labels, "quality", rows))  # at most ``rows`` pairs of numbers
    texts = docs.join(chosen, F.col("doc_id") == F.col("l_id")).select("label", "text")
    found = texts.mapInArrow(_vectors, "label int, x array<double>").toArrow()
    x = np.array(found.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(STATISTICS))
    return Discriminant(x, np.array(found.column("label").to_pylist(), dtype=np.int64))


def score(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [model.score(statistics(texts)) for texts in features.pieces(batch.column(2).to_pylist())]
            s = np.concatenate(rows) if rows else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    return docs.select("doc_id", (remainder(5) == 0).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    narrow = docs.select("doc_id", "text")
    return score(narrow, fit(narrow, labels))
