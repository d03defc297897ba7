"""SimHash near-duplicates: fingerprints, pivot distance tables and connected components.

Fingerprints are made once per text. Different fingerprints meet in buckets by equal bit blocks: of b blocks, two
fingerprints that differ in at most r bits share at least b - r, so each set of b - r blocks is a key (with b = r + 1,
every single block). b follows the number of fingerprints, so that buckets stay small. Inside a bucket a table of
Hamming distances to reference fingerprints is made. Distances to a reference of two fingerprints within r differ by r
at most (triangle inequality), so rows are sorted by the distance to the reference that spreads them most, and only
pairs within r there are made; they are discarded by their maximum difference over all references, and survivors are
verified. Buckets above TILE fingerprints are
split into tiles that meet pairwise, each pair of tiles in its own group. A bucket gives a spanning forest of its links,
never all pairs.

Defined results: null texts count as empty; texts without words have fingerprint zero and link with one another; equal
fingerprints are one class; a null doc_id gets the smallest doc_id of its component that is not null; repeated rows
are all returned; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.components import connected_components
from arborlake.llm.shared import measured, slices, text_key, written

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 512
BUCKET = 256
PIVOTS = 24


def references(count: int = PIVOTS, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, count, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The text's fingerprint, as a signed 64-bit integer; long texts are counted in pieces."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), (stops[shingle - 1 :] if len(words) >= shingle else stops[-1:]).tolist()
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for i in range(0, n, 1 << 16):
        hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(first[i : i + (1 << 16)], last[i : i + (1 << 16)])])
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fp for each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = pa.array([fingerprint(t.as_py()) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), prints], names=["doc_id", "text_key", "fp"])

    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, f"doc_id {kind}, text_key long, fp long")


def block_keys(count: int, radius: int = RADIUS) -> list[tuple[int, ...]]:
    """For each key its mask as a tuple of block numbers and the block bounds: enough shared bits for small buckets.

    Returns masks over 64 bits. Two values within ``radius`` bits agree on at least one mask.
    """
    masks: list[int] = []
    for blocks in range(radius + 1, radius + 5):
        bounds = [64 * i // blocks for i in range(blocks + 1)]
        part = [((1 << bounds[i + 1]) - 1) ^ ((1 << bounds[i]) - 1) for i in range(blocks)]
        keep = blocks - radius
        masks = [sum(part[i] for i in chosen) for chosen in combinations(range(blocks), keep)]
        if count <= BUCKET << (64 * keep // blocks):
            break
    return masks


def candidates(table: np.ndarray, a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a and b (None: of a alone) whose distances to the most spread reference differ by ``radius`` at most."""
    column = table[:, table.std(axis=0).argmax()].astype(np.int64)
    a = a[np.argsort(column[a], kind="stable")]
    if b is None:
        b, first = a, np.arange(1, len(a) + 1)
    else:
        b = b[np.argsort(column[b], kind="stable")]
        first = np.searchsorted(column[b], column[a] - radius, side="left")
    count = np.maximum(np.searchsorted(column[b], column[a] + radius, side="right") - first, 0)
    inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(a, count), b[np.repeat(first, count) + inside]


def _near(values: np.ndarray, tile: np.ndarray, left: int, right: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked pairs of one group: within a tile, or between two tiles."""
    table = np.bitwise_count(values[:, None] ^ references()[None, :]).astype(np.int8)
    i, j = candidates(table, np.flatnonzero(tile == left), None if left == right else np.flatnonzero(tile == right), radius)
    for k in range(table.shape[1]):
        if len(i) == 0:
            break
        column = table[:, k]
        ok = np.abs(column[i] - column[j]) <= radius
        i, j = i[ok], j[ok]
    ok = np.bitwise_count(values[i] ^ values[j]) <= radius
    return i[ok], j[ok]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it reaches by the links (i, j)."""
    top = np.arange(n)
    while len(i):
        a, b = top[i], top[j]
        ok = a != b
        if not ok.any():
            break
        i, j, a, b = i[ok], j[ok], a[ok], b[ok]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while (top[top] != top).any():
            top = top[top]
    return top


def _links(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def group(values: np.ndarray, tile: np.ndarray, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
        i, j = _near(values.view(np.uint64), tile, left, right, radius)
        top = forest(len(values), i, j)
        moved = np.flatnonzero(top != np.arange(len(values)))
        return values[moved], values[top[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group may go on in the next batch."""
        rest = None
        for batch in batches:
            new = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "key", "left", "right", "tile", "fp")])
            rest = new if rest is None else np.concatenate((rest, new))
            cuts = np.flatnonzero((rest[1:, :4] != rest[:-1, :4]).any(axis=1)) + 1
            if len(cuts):
                yield from pairs(rest[: cuts[-1]], cuts[:-1])
                rest = rest[cuts[-1] :]
        if rest is not None and len(rest):
            yield from pairs(rest, np.flatnonzero((rest[1:, :4] != rest[:-1, :4]).any(axis=1)) + 1)

    def pairs(rows: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        bounds = np.concatenate(([0], cuts, [len(rows)]))
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for p, q in zip(bounds[:-1], bounds[1:]):
            if q - p > 1:
                x, y = group(np.ascontiguousarray(rows[p:q, 5]), rows[p:q, 4], rows[p, 2], rows[p, 3])
                if len(x):
                    a.append(x)
                    b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=schema)

    return run


def fingerprint_links(values: DataFrame, count: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a, b: a spanning forest, bucket by bucket, of the links between the ``count`` different fingerprints in column fp."""
    masks = block_keys(count, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = values.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("mask", "key"))
    sizes = keyed.groupBy(F.col("mask").alias("s_mask"), F.col("key").alias("s_key")).agg(F.count("*").alias("n")).where("n > 1")
    joined = keyed.join(sizes, (F.col("mask") == F.col("s_mask")) & (F.col("key") == F.col("s_key")))
    tiles = F.ceil(F.col("n") / tile)
    dealt = joined.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64(F.lit(SEED), "fp"), F.col("tiles")))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
    dealt = dealt.select(F.col("mask").cast("long"), "key", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"), "tile", "fp")
    dealt = dealt.repartition("mask", "key", "left", "right").sortWithinPartitions("mask", "key", "left", "right")
    return dealt.mapInArrow(_links(radius), "a long, b long")


def rooted(docs: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_key, fp for each row, and fp, first, root for each fingerprint: the smallest doc_id on it and its component's root, never null."""
    prints = written(fingerprints(docs), "fingerprints")
    values, seen = measured(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "values", n=F.count("*"))
    roots = connected_components(fingerprint_links(values.select("fp"), seen["n"], radius))
    named = values.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # a table of its own, so that joins by fp or root can split one that holds much
    return prints, written(named, "named")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_key, fp, component_id for each row of ``docs`` (doc_id, text)."""
    prints, named = rooted(docs, radius)
    smallest = written(named.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    classes = named.select(F.col("fp").alias("c_fp"), F.col("root").alias("c_root")).join(
        smallest.withColumnRenamed("root", "s_root"), F.col("c_root") == F.col("s_root")
    )
    return prints.join(classes, F.col("fp") == F.col("c_fp")).select("doc_id", "text_key", "fp", "component_id")


def op7(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each component, whatever its ids: that of the smallest doc_id, null last, then of the smallest text key; all columns stay."""
    prints, named = rooted(docs, radius)
    found = prints.join(named.select(F.col("fp").alias("c_fp"), "root"), F.col("fp") == F.col("c_fp"))
    each = found.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("rows"))
    best = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "rows")).alias("best"))
    best, seen = measured(best.select(F.col("best.doc_id").alias("__s_id"), F.col("best.text_key").alias("key"), F.col("best.rows").alias("rows")), "kept", most=F.max("rows"))
    keyed = docs.withColumn("__s_key", text_key())
    kept = keyed.join(best.select("__s_id", "key"), F.col("doc_id").eqNullSafe(F.col("__s_id")) & (F.col("__s_key") == F.col("key")), "left_semi")
    if (seen["most"] or 0) > 1:
        kept = kept.dropDuplicates(["doc_id", "__s_key"])
    return kept.select(*docs.columns)
