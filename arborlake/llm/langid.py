"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are made small, everything else is one space, and n-grams of 1 to 3 characters are hashed into WIDTH buckets.
A document's vector has ``log(1 + count) * idf`` per bucket and length 1. Weights come from follow-the-regularised-
leader with an elastic net (L1 keeps them sparse); a temperature found on a fifth of the sample calibrates them.

The model is fitted on about SAMPLE documents, about equally many of each language, and on twice as many at most where
texts repeat (a documented bound). Every language is learned; more than LANGUAGES (a parameter, since weights are kept
for each) are an error and never cut. All rows are predicted, from whole texts. Defined results: ``und`` with score 0 for null texts, texts without a letter, and all
texts if no language is to be learned; ties go to the language that is first by code point; repeated rows and other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm import features
from arborlake.llm.training import remainder
from arborlake.llm.shared import slices

SAMPLE = 6_000
LANGUAGES = 1_000
WIDTH = 1 << 14
DOCUMENTS = 128
UNKNOWN = "und"


def buckets(texts: list[str]) -> Iterator[np.ndarray]:
    """For each text the bucket of each of its n-grams; no n-gram crosses texts."""
    t = features.Texts(texts)
    letter = t.kind & features.LETTER != 0
    symbol = np.where(letter, t.small, 0x20).astype(np.uint64)
    keep = letter | np.concatenate(([True], letter[:-1])) if len(letter) else letter  # of a run of other signs, the first
    keep |= t.first[:-1]
    places = np.flatnonzero(keep)
    symbol = symbol[places]
    own = np.searchsorted(t.bounds, places, side="right") - 1
    ends = np.searchsorted(places, t.bounds)
    gram, codes = np.zeros(len(symbol), dtype=np.uint64), []
    for n in (1, 2, 3):
        gram = gram * np.uint64(0x9E3779B97F4A7C15)
        gram[: len(symbol) - n + 1] += symbol[n - 1 :]
        code = ((gram * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(n * 0x165667B19E3779F9)) >> np.uint64(50)).astype(np.int64)
        whole = np.zeros(len(symbol), dtype=bool)
        whole[: len(symbol) - n + 1] = own[: len(symbol) - n + 1] == own[n - 1 :]
        codes.append(np.where(whole, code, -1))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        found = np.concatenate([c[a:b] for c in codes])
        yield found[found >= 0]


def has_letter(texts: list[str]) -> np.ndarray:
    t = features.Texts(texts)
    return t.total(t.kind & features.LETTER != 0) > 0


class Model:
    def __init__(self, names: list[str]) -> None:
        self.names = names
        self.weights = np.zeros((WIDTH, max(1, len(names))), dtype=np.float64)
        self.idf = np.ones(WIDTH)
        self.temperature = 1.0

    def vector(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = np.log1p(count) * self.idf[at]
        return x / max(1e-12, float(np.sqrt((x * x).sum())))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> Model:
        if not self.names:
            return self
        df = np.zeros(WIDTH)
        for at, _ in rows:
            df[at] += 1
        self.idf = np.log((1 + len(rows)) / (1 + df)) + 1
        held = np.arange(len(rows)) % 5 == 4
        classes = np.eye(len(self.names))
        z, n = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for _ in range(epochs):
            for i in np.flatnonzero(~held).tolist():
                at, count = rows[i]
                x = self.vector(at, count)
                w = self.weights[at]
                s = x @ w
                p = np.exp(s - s.max())
                g = np.outer(x, p / p.sum() - classes[y[i]])
                old = n[at]
                new = old + g * g
                moved = z[at] + g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
                n[at], z[at] = new, moved
                self.weights[at] = np.where(np.abs(moved) > l1, -(moved - np.sign(moved) * l1) / ((beta + np.sqrt(new)) / alpha + l2), 0.0)
        tested = np.flatnonzero(held).tolist()
        if tested:
            s = np.array([self.vector(*rows[i]) @ self.weights[rows[i][0]] for i in tested])
            loss = []
            ladder = np.geomspace(0.1, 5, 60)
            for temperature in ladder:
                v = s / temperature
                v -= v.max(axis=1, keepdims=True)
                loss.append(float((np.log(np.exp(v).sum(axis=1)) - v[np.arange(len(tested)), y[tested]]).mean()))
            self.temperature = float(ladder[int(np.argmin(loss))])
        return self

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for i in range(0, len(texts), DOCUMENTS):
            block = texts[i : i + DOCUMENTS]
            counts = np.zeros((len(block), WIDTH))
            for k, at in enumerate(buckets(block)):
                counts[k] = np.bincount(at, minlength=WIDTH)
            x = np.log1p(counts, out=counts)
            x *= self.idf
            length = np.sqrt(np.einsum("ij,ij->i", x, x))
            s = (x @ self.weights) / np.maximum(length, 1e-12)[:, None] / self.temperature
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            known = has_letter(block) & bool(self.names)
            best = p.argmax(axis=1)
            names += [self.names[j] if ok else UNKNOWN for j, ok in zip(best.tolist(), known.tolist())]
            scores.append(np.where(known, p.max(axis=1), 0.0))
        return names, np.concatenate(scores) if scores else np.empty(0)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        at, number = [], []
        for run in features.pieces(batch.column(2).to_pylist()):
            for found in buckets(run):
                count = np.bincount(found, minlength=WIDTH)
                some = np.flatnonzero(count)
                at.append(some.astype(np.int16))
                number.append(count[some].astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int16())), pa.array(number, pa.list_(pa.int32()))], names=["ord", "lang", "at", "number"])


def fit(docs: DataFrame, rows: int = SAMPLE, languages: int = LANGUAGES) -> Model:
    """``docs``: doc_id, text, lang. Only rows of remainders other than 2 with a lang and a letter are learned from."""
    usable = docs.where(F.col("lang").isNotNull() & (remainder(4) != 2) & F.col("text").rlike(r"\p{L}"))
    sizes = usable.groupBy("lang").count().orderBy("lang").limit(languages + 1).collect()
    if len(sizes) > languages:
        raise ValueError(f"more than {languages} values of lang: the parameter languages bounds what the model keeps")
    if not sizes:
        return Model([])
    each = rows / len(sizes)
    share = F.create_map([F.lit(v) for r in sizes for v in (r["lang"], min(1.0, each / r["count"]))])
    order = F.xxhash64(F.lit(5), "doc_id", "text")
    chance = F.pmod(order, F.lit(1_000_000)) / F.lit(1_000_000.0)
    chosen = usable.where(chance < F.element_at(share, F.col("lang"))).select(order.alias("ord"), "lang", "text")
    counted = chosen.mapInArrow(_counts, "ord long, lang string, at array<short>, number array<int>")
    found = counted.orderBy("ord", "lang").limit(2 * rows).toArrow()  # a bound whatever the copies in the data
    names = sorted(set(found.column("lang").to_pylist()))
    y = np.array([names.index(x) for x in found.column("lang").to_pylist()], dtype=np.int64)
    pairs = [(np.array(a, dtype=np.int64), np.array(n, dtype=np.float64)) for a, n in zip(found.column("at").to_pylist(), found.column("number").to_pylist())]
    return Model(names).fit(pairs, y)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, scores = [], [np.empty(0)]
            for texts in features.pieces(batch.column(2).to_pylist()):
                n, s = model.predict(texts)
                names += n
                scores.append(s)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(np.concatenate(scores))], names=["doc_id", "held_out", "lang_pred", "score"]
            )

    return docs.select("doc_id", (remainder(4) == 2).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op5(docs: DataFrame) -> DataFrame:
    return predict(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
