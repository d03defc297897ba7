"""A toxicity classifier: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: whole words and word beginnings (4 to 7 letters) that toxic training documents hold more
often than others, weighed by the share of toxic ones among the documents that hold them. Features of a whole text are the densities of lexicon hits, their nearness to words of the second
person, the shares of capitals and punctuation, and obfuscation rates (letters spelled out, digits or signs inside
words, stretched letters). Trees split on histogram bins of the features; a third part of the sample, which the
trees do not see, calibrates their sum with a monotone step function, interpolated.

Lexicon, trees and calibration are fitted on at most SAMPLE labelled rows (a documented bound), a third each; all rows
are scored. Defined results: null and empty texts are scored like any other, with no hits; without labelled rows of
both classes the score is the share of class 1 (0 without any); repeated rows and other columns play no part.
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

SAMPLE = 24_000
LEXICON = 3_000
MIN_DOCUMENTS = 5
MIN_SHARE = 0.25
STRONG = 0.7
BEGINNINGS = (4, 5, 6, 7)
NEAR = 5
THRESHOLD = 0.5
#: Words of the second person in English, German, French and Spanish.
SECOND_PERSON = "you your yours yourself du dich dir dein deine sie ihr euch tu te toi ton ta vous votre vos tú ti usted ustedes tus vosotros".split()

FEATURES = ("hits", "hit_density", "strong_hits", "strong_density", "second_weight", "different_hits", "strongest", "weight_density", "near_second_person", "second_person", "capitals", "shouted", "exclamations", "punctuation", "spelled_out", "mixed_words", "stretched", "log_words")


def words(t: features.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters: starts, ends and each run's text."""
    return t.runs(t.kind & features.LETTER != 0)


def units(t: features.Texts, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For each word its number, and those of its beginnings (0 where the word is no longer than that)."""
    out = [features.hashes(t.small, starts, ends)]
    for k in BEGINNINGS:
        long = ends - starts > k
        value = np.zeros(len(starts), dtype=np.uint64)
        value[long] = features.hashes(t.small, starts[long], starts[long] + k) ^ np.uint64(k * 0x1F123BB5159A55E5)
        out.append(value)
    return out


class Lexicon:
    """Sorted unit numbers with a weight each."""

    def __init__(self, numbers: np.ndarray, weights: np.ndarray) -> None:
        order = np.argsort(numbers)
        self.numbers, self.weights = numbers[order], weights[order]

    def weigh(self, values: list[np.ndarray]) -> np.ndarray:
        """The greatest weight of the units of each word, 0 without a hit."""
        best = np.zeros(len(values[0]))
        if len(self.numbers) == 0:
            return best
        for v in values:
            at = np.minimum(np.searchsorted(self.numbers, v), len(self.numbers) - 1)
            best = np.maximum(best, np.where(self.numbers[at] == v, self.weights[at], 0.0))
        return best


def vectors(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    t = features.Texts(texts)
    kind, points = t.kind, t.points
    starts, ends, own = words(t)
    values = units(t, starts, ends)
    weight = lexicon.weigh(values)
    hit = weight > 0
    person = np.isin(values[0], np.array([features.word_hash(w) for w in SECOND_PERSON], dtype=np.uint64))
    place = np.arange(len(own))
    last = np.maximum.accumulate(np.where(person, place, -NEAR - 1)) if len(own) else place
    following = np.minimum.accumulate(np.where(person, place, len(own) + NEAR + 1)[::-1])[::-1] if len(own) else place
    inside = lambda at: (at >= 0) & (at < len(own)) & (own[np.clip(at, 0, max(0, len(own) - 1))] == own) if len(own) else np.empty(0, bool)
    near = hit & (((place - last <= NEAR) & inside(last)) | ((following - place <= NEAR) & inside(following)))
    count = t.per_text(own)
    letters = t.total(kind & features.LETTER != 0)
    chars = np.diff(t.bounds).astype(np.float64)
    size = ends - starts
    capital = np.add.reduceat((kind & features.CAPITAL != 0).astype(np.int64), starts) if len(starts) else size
    single = size == 1
    spelled = np.concatenate(([False, False], single[2:] & single[1:-1] & single[:-2] & (own[2:] == own[:-2]))) if len(own) > 2 else np.zeros(len(own), bool)
    blank = t.runs(kind & features.SPACE == 0)
    if len(blank[0]):
        letter = np.add.reduceat((kind & features.LETTER != 0).astype(np.int64), blank[0])
        other = np.add.reduceat((kind & (features.DIGIT | features.SIGN) != 0).astype(np.int64), blank[0])
        tail = (kind[blank[1] - 1] & features.SIGN != 0).astype(np.int64)
        mixed = (letter > 1) & (other - tail > 0)
    else:
        mixed = np.empty(0, bool)
    same = np.zeros(len(points), bool)
    if len(points) > 2:
        same[2:] = (t.small[2:] == t.small[1:-1]) & (t.small[2:] == t.small[:-2]) & (kind[2:] & features.LETTER != 0) & ~t.first[2:-1] & ~t.first[1:-2]
    order = np.lexsort((-weight, own))  # each text's words, the heaviest first
    heads = np.searchsorted(own[order], np.arange(t.number))
    ranked = np.concatenate((weight[order], [0.0, 0.0]))
    strongest = np.where(count > 0, ranked[heads], 0.0)
    second = np.where(count > 1, ranked[np.minimum(heads + 1, len(ranked) - 1)], 0.0)
    hits, strong = t.per_text(own, hit), t.per_text(own, weight >= STRONG)
    return np.column_stack(
        [
            hits,
            hits / (count + 20),
            strong,
            strong / (count + 20),
            second,
            t.different(own[hit], values[0][hit]),
            strongest,
            t.per_text(own, weight) / (count + 20),
            t.per_text(own, near),
            t.per_text(own, person) / (count + 20),
            t.total(kind & features.CAPITAL != 0) / (letters + 20),
            t.per_text(own, (capital == size) & (size > 1)) / (count + 20),
            t.total(points == 0x21) / (count + 20),
            t.total(kind & features.SIGN != 0) / (chars + 100),
            t.per_text(own, spelled) / (count + 20),
            t.per_text(blank[2], mixed) / (count + 20),
            t.total(same) / (letters + 20),
            np.log1p(count),
        ]
    )


class Trees:
    """Gradient-boosted regression trees for the log loss, on histogram bins."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, least: int = 8, ridge: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c[c != c.min()] if (c != c.min()).any() else c, np.linspace(0, 1, self.bins))) for c in x.T]
        b = self.binned(x)
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        f = np.full(len(y), self.base)
        self.nodes = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            tree, leaf = self.grow(b, y - p, p * (1 - p))
            self.nodes.append(tree)
            f += leaf
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T)]).astype(np.int64)

    def grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[list, np.ndarray]:
        """The tree as a list of (feature, bin, left, right) or (value,); and the value of each row."""
        nodes: list = []
        out = np.zeros(len(g))
        wide = self.bins + 1

        def grow(rows: np.ndarray, depth: int) -> int:
            number = len(nodes)
            nodes.append(None)
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, -1, -1)
            if depth < self.depth and len(rows) >= 2 * self.least:
                for j in range(b.shape[1]):
                    at = b[rows, j]
                    gl = np.bincount(at, g[rows], wide).cumsum()[:-1]
                    hl = np.bincount(at, h[rows], wide).cumsum()[:-1]
                    nl = np.bincount(at, minlength=wide).cumsum()[:-1]
                    gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                    gain[(nl < self.least) | (len(rows) - nl < self.least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
            if best[1] < 0:
                value = self.rate * gs / (hs + self.ridge)
                nodes[number] = (value,)
                out[rows] = value
                return number
            left = b[rows, best[1]] <= best[2]
            a = grow(rows[left], depth + 1)
            c = grow(rows[~left], depth + 1)
            nodes[number] = (best[1], best[2], a, c)
            return number

        grow(np.arange(len(g)), 0)
        return nodes, out

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        f = np.full(len(x), self.base)
        for nodes in self.nodes:
            stack = [(0, np.arange(len(x)))]
            while stack:
                number, rows = stack.pop()
                node = nodes[number]
                if len(node) == 1:
                    f[rows] += node[0]
                else:
                    left = b[rows, node[0]] <= node[1]
                    stack += [(node[2], rows[left]), (node[3], rows[~left])]
        return f


def isotonic(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the monotone fit of y on f by pooling adjacent violators.

    Rows of one margin are one point before anything is pooled, so every margin has one value, the share of its rows
    if it violates nothing. Each pool keeps a twentieth of a success and a failure apart from 0 and 1.
    """
    points, place = np.unique(f, return_inverse=True)
    successes = np.bincount(place, y, len(points))
    rows = np.bincount(place, minlength=len(points))
    pools: list[list[float]] = []
    for v, s, n in zip(points.tolist(), successes.tolist(), rows.tolist()):
        pools.append([s, n, v, v])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, _, hi = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = hi
    at, value = [], []
    for s, n, lo, hi in pools:
        at += [lo, hi] if lo < hi else [lo]
        value += [(s + 0.05) / (n + 0.1)] * (2 if lo < hi else 1)
    return np.array(at), np.maximum.accumulate(np.array(value))


class Model:
    def __init__(self, lexicon: Lexicon, x: np.ndarray, y: np.ndarray, part: np.ndarray) -> None:
        self.lexicon = lexicon
        self.share = float(y.mean()) if len(y) else 0.0
        train = part == 0
        self.fitted = len(set(y[train].tolist())) == 2
        if self.fitted:
            self.trees = Trees().fit(x[train], y[train])
            held = ~train if len(set(y[~train].tolist())) == 2 else train
            self.knots = isotonic(self.trees.margin(x[held]), y[held])

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), self.share)
        return np.interp(self.trees.margin(vectors(texts, self.lexicon)), *self.knots)


def _unit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """unit, toxic, clean: how many texts of each class hold the unit."""
    for batch in slices(batches):
        labels = np.array(batch.column(0).to_pylist(), dtype=np.int64)
        at = 0
        for run in features.pieces(batch.column(1).to_pylist()):
            t = features.Texts(run)
            starts, ends, own = words(t)
            values = units(t, starts, ends)
            every, who = np.concatenate(values), np.tile(own, len(values))
            every, who = every[every != 0], who[every != 0]
            pair = np.unique(np.rec.fromarrays([every, who]))
            toxic = labels[at : at + len(run)][pair.f1] == 1
            unit, place = np.unique(pair.f0, return_inverse=True)
            yes = np.bincount(place, toxic, len(unit)).astype(np.int64)
            every_one = np.bincount(place, minlength=len(unit))
            yield pa.RecordBatch.from_arrays([pa.array(unit.view(np.int64)), pa.array(yes), pa.array(every_one - yes)], names=["unit", "toxic", "clean"])
            at += len(run)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    chosen = F.broadcast(held_in_labels(labels, "toxic", rows))  # at most ``rows`` pairs of numbers
    sample = docs.join(chosen, F.col("doc_id") == F.col("l_id")).select("label", F.pmod(F.xxhash64(F.lit(3), "l_id"), F.lit(3)).cast("int").alias("part"), "text")
    counts = sample.where("part = 2").select("label", "text").mapInArrow(_unit_counts, "unit long, toxic long, clean long")
    counts = counts.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    lean = F.col("toxic") / (F.col("toxic") + F.col("clean") + 1)
    gain = (F.col("toxic") - MIN_SHARE * (F.col("toxic") + F.col("clean"))) / F.sqrt(F.col("toxic") + F.col("clean"))
    known = counts.where((F.col("toxic") >= MIN_DOCUMENTS) & (lean >= MIN_SHARE)).withColumn("lean", lean)
    found = known.orderBy(F.desc(gain), "unit").limit(LEXICON).toPandas()
    weights = found["lean"].to_numpy(dtype=np.float64)
    lexicon = Lexicon(found["unit"].to_numpy(dtype=np.int64).view(np.uint64), weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [vectors(texts, lexicon) for texts in features.pieces(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r for v in x for r in v], pa.list_(pa.float64()))], names=["label", "part", "x"])

    seen = sample.where("part < 2").mapInArrow(run, "label int, part int, x array<double>").toArrow()
    x = np.array(seen.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    y, part = (np.array(seen.column(c).to_pylist(), dtype=np.int64) for c in ("label", "part"))
    order = np.lexsort((*x.T, y, part))  # the same model whatever the order of rows
    return Model(lexicon, x[order], y[order], part[order])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = [model.score(texts) for texts in features.pieces(batch.column(2).to_pylist())]
            s = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    return docs.select("doc_id", (remainder(5) == 0).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    narrow = docs.select("doc_id", "text")
    return score(narrow, fit(narrow, labels))


def not_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject; all columns stay. A model that saw one class only rejects nothing."""
    model = fit(docs.select("doc_id", "text"), labels)
    if not model.fitted:
        return docs
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = [model.score(texts) for texts in features.pieces(batch.column(at).to_pylist())]
            yield batch.filter(pa.array(np.concatenate(parts) < threshold if parts else np.empty(0, bool)))

    return docs.mapInArrow(run, docs.schema)
