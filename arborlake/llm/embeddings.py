"""Near-duplicate vectors: spherical k-means cells and blocked cosine products within them.

Equal vectors of a label are one class. For each label the classes are assigned to cells, the nearest of at most FANOUT
centroids, which spherical k-means finds on a bounded sample; cells that are home to more than 2 * CELL classes are
divided in the same way, level by level, so cells stay small however large a label is, and centroids are rows of a table
that meet their cell in groups of bounded size. A class also visits each earlier cell whose bisector with its own is within
``margin``: two unit vectors with cosine t or more are at most sqrt(2 - 2t) apart, and so are their projections on a
bisector's normal. With that margin no pair is missed at any level; it is the default (``exact``). A cell that division
does not make smaller (vectors that are all alike) is left. Cells above TILE classes are split into tiles, and tiles at
home meet one another and the visiting ones, so a task holds two tiles at most. Two classes meet once, in the earlier of
their home cells; visitors do not meet. Each group of tiles returns link counts and a spanning forest of its links,
never pairs. kept marks one representative of each component.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, vectors without a label and
vectors without vec_id link with nothing (component_id = vec_id, n_links 0; kept is true for the first of them with
that vec_id, as for all); vectors of unequal lengths do not link; repeated rows count as vectors of their own with the
same vec_id; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.components import connected_components
from arborlake.llm.shared import free, measured, written
from arborlake.llm.simhash import forest

THRESHOLD = 0.98
CELL = 2_000
TILE = 1_024
FANOUT = 32
GROUP_ROWS = 8_192
SAMPLE_PER_CENTROID = 64


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k unit centroids of unit vectors; the start is spread over the rows, which come in a fixed order."""
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ centre.T).argmax(axis=1)
        for c in range(k):
            total = x[own == c].sum(axis=0)
            norm = np.linalg.norm(total)
            if norm > 0:
                centre[c] = total / norm
    return centre


def unit(vectors: pa.ChunkedArray) -> np.ndarray:
    x = pc.list_flatten(vectors).to_numpy().astype(np.float64).reshape(len(vectors), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centres(key: tuple, table: pa.Table) -> pa.Table:
    """The centroids of one cell's sample, as one list."""
    order = np.argsort(table.column("class").to_numpy(), kind="stable")
    x = unit(table.column("vector"))[order]
    centre = spherical_kmeans(x, min(int(table.column("wanted")[0].as_py()), len(x)))
    label = table.column("label").slice(0, 1)
    return pa.table({"p_label": label, "p_size": pa.array([x.shape[1]], pa.int32()), "p_cell": table.column("cell").slice(0, 1), "centres": pa.array([centre.ravel().tolist()])})


PLACED = ["class", "label", "size", "cell", "home", "among", "copies", "vector"]


def _divide(margin: float, once: bool):
    """Some classes of a cell in their own part of it and in those they visit; with ``once``, classes at home visit earlier parts only."""

    def group(key: tuple, rows: pa.Table, centres: pa.Table) -> pa.Table:
        if centres.num_rows == 0 or rows.num_rows == 0:
            return rows.select(PLACED)
        c = np.array(centres.column("centres")[0].as_py()).reshape(-1, rows.column("size")[0].as_py())
        s = unit(rows.column("vector")) @ c.T
        own = s.argmax(axis=1)
        gap = s[np.arange(len(s)), own][:, None] - s
        apart = np.sqrt(np.maximum(2 - 2 * np.clip(c[own] @ c.T, -1, 1), 0))
        at_home = rows.column("home").to_numpy()
        near = gap <= margin * apart + 1e-9
        if once:
            near &= (np.arange(len(c))[None, :] <= own[:, None]) | ~at_home[:, None]
        at, part = np.nonzero(near)
        out = rows.take(pa.array(at))
        cell = out.column("cell").to_numpy() * FANOUT + part + 1
        home = at_home[at] & (part == own[at])
        values = {"cell": pa.array(cell.astype(np.int64)), "home": pa.array(home), "among": out.column("n")}
        return pa.table({c: values.get(c, out.column(c)) for c in PLACED})

    return group


def cells(classes: DataFrame, margin: float, once: bool = False) -> DataFrame:
    """class, label, size, cell, home, among, copies, vector: each class in its home cell and in those it visits.

    With ``once``, of two classes only that of the later home cell visits the other, so that they meet once.
    """
    kind, vector = (classes.schema[c].dataType.simpleString() for c in ("label", "vector"))
    schema = f"class long, label {kind}, size int, cell long, home boolean, among long, copies long, vector {vector}"
    start = classes.select("class", "label", F.size("vector").alias("size"), F.lit(0).cast("long").alias("cell"), F.lit(True).alias("home"), F.lit(None).cast("long").alias("among"), "copies", "vector")
    placed, least = start, 2  # every label with two classes is divided once
    while True:
        full = placed.groupBy(F.col("label").alias("f_label"), F.col("size").alias("f_size"), F.col("cell").alias("f_cell")).agg(F.count_if("home").alias("n"), F.count("*").alias("every"), F.min("among").alias("was"))
        full = full.where((F.col("n") >= least) & (F.col("was").isNull() | (F.col("n") < F.col("was") * 0.9)) & (F.col("f_cell") < (1 << 62) // FANOUT - 1))
        full = full.withColumn("wanted", F.greatest(F.lit(2), F.least(F.lit(FANOUT), F.ceil(F.col("n") / CELL))))
        full, seen = measured(full, "full", n=F.count("*"))
        if not seen["n"]:
            free(full)
            return placed
        same = (F.col("label") == F.col("f_label")) & (F.col("size") == F.col("f_size")) & (F.col("cell") == F.col("f_cell"))
        joined = placed.join(full, same, "left").select("class", "label", "size", "cell", "home", "among", "copies", "vector", "n", "every", "wanted")
        joined = written(joined, "joined")
        chance = F.pmod(F.xxhash64(F.lit(9), "class"), F.lit(1_000_000)) / F.lit(1_000_000.0)
        chosen = joined.where(F.col("home") & F.col("n").isNotNull() & (chance <= F.col("wanted") * SAMPLE_PER_CENTROID / F.col("n")))
        centres = chosen.groupBy("label", "size", "cell").applyInArrow(_centres, f"p_label {kind}, p_size int, p_cell long, centres array<double>")
        centres = written(centres, "centres")
        # groups of bounded size: a cell's classes are dealt, its centroids go to each part
        salts = F.ceil(F.col("every") / GROUP_ROWS)
        rows = joined.where(F.col("n").isNotNull()).withColumn("salt", F.pmod(F.xxhash64(F.lit(6), "class"), salts))
        keys = full.select("f_label", "f_size", "f_cell", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("p_salt"))
        parts = centres.join(keys, (F.col("p_label") == F.col("f_label")) & (F.col("p_size") == F.col("f_size")) & (F.col("p_cell") == F.col("f_cell")))
        parts = parts.select("p_label", "p_size", "p_cell", "p_salt", "centres")
        divided = rows.groupBy("label", "size", "cell", "salt").cogroup(parts.groupBy("p_label", "p_size", "p_cell", "p_salt")).applyInArrow(_divide(margin, once), schema)
        last, placed = placed, written(divided.union(joined.where(F.col("n").isNull()).select(*PLACED)), "cells")
        free(full, joined, centres, *([last] if last is not start else []))
        least = 2 * CELL + 1


GROUP = ["label", "size", "cell", "left", "right"]


def _products(threshold: float):
    def pairs(ids, copies, tile, x, left, right) -> Iterator[pa.RecordBatch]:
        a = np.flatnonzero(tile == left)
        b = a if left == right else np.flatnonzero(tile == right)
        i, j = np.nonzero(x[a] @ x[b].T >= threshold)
        i, j = a[i], b[j]
        once = i < j if left == right else np.ones(len(i), bool)
        i, j = i[once], j[once]
        if len(i) == 0:
            return
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order] = np.arange(len(ids))
        top = forest(len(ids), rank[i], rank[j])
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[some]), pa.array(ids[order][top[rank[some]]]), pa.array(links[some].astype(np.int64))], names=["a", "b", "links"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group may go on in the next batch."""
        key, parts = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if key is not None:
                t = pa.Table.from_batches(parts)
                ids, copies, tile = (t.column(c).to_numpy() for c in ("class", "copies", "tile"))
                if len(ids) > 1:
                    yield from pairs(ids, copies, tile, unit(t.column("vector")), key[3], key[4])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in GROUP]
            keys = list(zip(*columns))
            at = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[at]:
                    if keys[at] != key:
                        yield from done()
                        key, parts = keys[at], []
                    parts.append(batch.slice(at, i - at))
                    at = i
        yield from done()

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, margin: float | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding, label)."""
    narrow = vectors.select("vec_id", F.col("embedding").alias("vector"), "label")  # as stored; products are of doubles
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    finite = finite & F.exists("vector", lambda v: v != 0)
    sound = F.coalesce(finite & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("vector") > 0), F.lit(False))
    rows = narrow.withColumn("sound", sound)
    name = F.xxhash64("label", "vector")
    keyed = written(rows.select("vec_id", F.when(F.col("sound"), name).alias("class"), "label", F.when(F.col("sound"), F.col("vector")).alias("vector")), "vectors")
    classes = keyed.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("first")
    )
    classes = written(classes, "classes")
    placed = cells(classes, float(np.sqrt(2 - 2 * threshold)) if margin is None else margin, once=True)
    full = placed.groupBy(F.col("label").alias("c_label"), F.col("size").alias("c_size"), F.col("cell").alias("c_cell")).agg(
        F.ceil(F.count_if("home") / TILE).alias("homes"), F.ceil(F.count_if(~F.col("home")) / TILE).alias("visits")
    ).where("homes > 0")
    dealt = placed.join(full, (F.col("label") == F.col("c_label")) & (F.col("size") == F.col("c_size")) & (F.col("cell") == F.col("c_cell")))
    number = F.xxhash64(F.lit(4), "class")
    dealt = dealt.withColumn("tile", F.when(F.col("home"), F.pmod(number, "homes")).otherwise(F.col("homes") + F.pmod(number, F.greatest("visits", F.lit(1)))))
    others = F.col("homes") + F.when(F.col("home"), F.col("visits")).otherwise(0)
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)).alias("other"))
    dealt = dealt.select("class", "copies", "vector", "label", "size", "cell", "tile", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"))
    dealt = dealt.repartition(*GROUP).sortWithinPartitions(*GROUP)
    found = written(dealt.mapInArrow(_products(threshold), "a long, b long, links long"), "found")
    counts = found.groupBy(F.col("a").alias("n_class")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.select("a", "b"))
    named = classes.select("class", "first", "copies").join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class"))
    smallest = named.groupBy(F.col("root").alias("s_root")).agg(F.min("first").alias("component"))
    final = named.join(smallest, F.col("root") == F.col("s_root")).join(counts, F.col("class") == F.col("n_class"), "left")
    final = final.select(F.col("class").alias("f_class"), "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    # a table of its own, so that the join can split a vector with many copies; rows without a class have no part in it
    final = written(final, "final")
    linked = keyed.join(final, F.col("class") == F.col("f_class")).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = keyed.where("class is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)
