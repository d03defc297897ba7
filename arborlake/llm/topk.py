"""Exact top-k inner products with an impact-ordered index, read score at a time.

Components are quantised to integers, ``floor(scale * x)``. Vectors are dealt into shards of about SHARD rows. Queries
are sent to every shard and streamed past its index in Arrow batches, so a task holds one index and one batch of
queries, however many there are. Beyond BLOCK queries shards are repeated, once for each BLOCK, so that one shard's
queries can be shared by tasks. What is sent grows with queries times shards, as exact search over all rows must.

A shard's index has for each dimension its vectors in segments of similar components (LEVELS equal steps between the
dimension's extremes). For a query, a segment's impact is the greatest product that a member can have there, less the
dimension's smallest possible product, so impacts are never negative. Segments are read by descending impact; each adds
its impact to its members' accumulators. With the impacts of the dimensions' next unread segments summed to R, no
vector can score above ``base + accumulator + R``. Reading stops only when that proves that at most RESCORE vectors can
reach the k-th best lower bound, or at the end; all possible members are then scored exactly from their components.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, as queries and as
candidates; so do rows without vec_id; vectors of unequal lengths are not compared; rows repeated with the same vec_id
and components count once, and rows with the query's vec_id never answer it; ties go to the smaller vec_id; scores
beyond 64 bits are computed with unbounded integers and count as the greatest or smallest 64-bit number; empty tables
give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.llm.shared import measured

SCALE = 1024
SHARD = 16_384
BLOCK = 65_536
LEVELS = 8
WIDE = float(1 << 62)
RESCORE = 256


class ImpactIndex:
    """Posting segments of one shard."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, levels: int = LEVELS) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.width = ids[order], x.shape[1]
        self.greatest = float(np.abs(x).max(initial=0))
        self.whole = x[order]
        if self.greatest >= WIDE:
            return  # every query is answered with unbounded integers
        self.x = self.whole.astype(np.int64)
        self.members: list[np.ndarray] = []
        dimension, low, high = [], [], []
        for d in range(self.x.shape[1]):
            v = self.x[:, d]
            by = np.argsort(v, kind="stable")
            span = max(1, int(v[by[-1]] - v[by[0]]))
            step = ((v[by] - v[by[0]]) * levels // (span + 1)).astype(np.int64)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(step)) + 1, [len(by)]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                self.members.append(by[a:b].astype(np.int32))
                dimension.append(d)
                low.append(v[by[a]])
                high.append(v[by[b - 1]])
        self.dimension, self.low, self.high = np.array(dimension), np.array(low), np.array(high)

    def search(self, q: np.ndarray, k: int, skip: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best (ties: smaller id), without the rows of id ``skip``."""
        n = len(self.ids)
        if max(self.greatest, 1) * max(float(np.abs(q).max(initial=0)), 1) * self.width >= WIDE:
            return self.search_wide(q, k, skip)
        q = q.astype(np.int64)
        weight = q[self.dimension]
        most = np.maximum(weight * self.low, weight * self.high)
        least = np.minimum(weight * self.low, weight * self.high)
        floor = np.full(self.width, np.iinfo(np.int64).max)
        np.minimum.at(floor, self.dimension, least)
        base = int(floor.sum())
        impact, slack = most - floor[self.dimension], most - least
        order = np.argsort(-impact, kind="stable")
        acc = np.zeros(n, dtype=np.int64)
        allowed = np.ones(n, dtype=bool) if skip is None else self.ids != skip
        want = min(k, int(allowed.sum()))
        if want == 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        # what may still come: each dimension's next unread impact, from the end of the order backwards
        ranked_dimension, ranked = self.dimension[order], impact[order]
        rest = np.zeros(len(order) + 1, dtype=np.int64)
        nearest = np.zeros(self.width, dtype=np.int64)
        for i in range(len(order) - 1, -1, -1):
            d = ranked_dimension[i]
            rest[i] = rest[i + 1] + ranked[i] - nearest[d]
            nearest[d] = ranked[i]
        loose = np.zeros(n, dtype=np.int64)
        checked = 0
        for i, s in enumerate(order.tolist()):
            at = self.members[s]
            acc[at] += impact[s]
            loose[at] += slack[s]
            # a look costs a pass over the shard, so looks are far apart
            if i - checked >= len(order) // 6 or i + 1 == len(order):
                checked = i
                lower = np.where(allowed, acc - loose, -1)
                bar = np.partition(lower, n - want)[n - want]
                possible = np.flatnonzero(allowed & (acc + rest[i + 1] >= bar))
                if len(possible) <= max(RESCORE, want) or i + 1 == len(order):
                    break
        score = self.x[possible] @ q
        best = np.lexsort((self.ids[possible], -score))[:k]
        return self.ids[possible][best], score[best]


    def search_wide(self, q: np.ndarray, k: int, skip: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The same where scores may leave 64 bits: all members, exactly."""
        ask = [int(v) for v in q]
        scores = [sum(a * int(b) for a, b in zip(ask, row)) for row in self.whole]
        score = np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in scores], dtype=np.int64)
        at = np.flatnonzero(self.ids != skip) if skip is not None else np.arange(len(self.ids))
        best = at[np.lexsort((self.ids[at], ~score[at]))][:k]
        return self.ids[best], score[best]


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """Whole numbers, as doubles: beyond 2^53 a double is whole already."""

    def one(v: Column) -> Column:
        scaled = F.lit(float(scale)) * v.cast("double")
        return F.when(F.abs(scaled) < float(1 << 53), F.floor(scaled).cast("double")).otherwise(scaled)

    return F.transform(vector, one)


GROUP = ["size", "shard", "block"]


def _search(k: int):
    """Rows come sorted by group, the members of its shard first; queries are answered batch by batch."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def stack(parts: list[pa.Array]) -> np.ndarray:
        flat = pa.chunked_array(parts).combine_chunks()
        return flat.flatten().to_numpy().reshape(len(flat), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, parts, index = None, [], [], None
        for batch in batches:
            columns = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*GROUP, "asked")])
            cuts = np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(columns)]):
                if a == b:
                    continue
                if tuple(columns[a, :3]) != key:
                    key, ids, parts, index = tuple(columns[a, :3]), [], [], None
                names, x = batch.column("vec_id").slice(a, b - a).to_numpy(), batch.column("x").slice(a, b - a)
                if not columns[a, 3]:
                    ids.append(names)
                    parts.append(x)
                    continue
                if index is None:
                    if not ids:
                        continue
                    index = ImpactIndex(np.concatenate(ids), stack(parts))
                    parts = []
                found = [(name, *index.search(q, k, name)) for name, q in zip(names.tolist(), stack([x]))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(names, [len(f[1]) for f in found])), *[pa.array(np.concatenate([f[c] for f in found])) for c in (1, 2)]], schema=schema
                )

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which ``queries`` is true, the k other rows of greatest inner product."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    sound = vectors.where(finite & (F.size("embedding") > 0) & F.col("vec_id").isNotNull())
    rows = sound.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("x"), F.coalesce(queries, F.lit(False)).alias("query"))
    rows, seen = measured(rows.dropDuplicates(["vec_id", "x"]), "quantised", rows=F.count("*"), queries=F.count_if("query"))
    shards, blocks = max(1, -(-seen["rows"] // SHARD)), max(1, -(-seen["queries"] // BLOCK))
    many = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64(F.lit(11), "vec_id", "x"), F.lit(n)).cast("int")
    members = rows.select(F.lit(False).alias("asked"), "vec_id", "x", F.size("x").alias("size"), deal(shards).alias("shard"), many(blocks).alias("block"))
    asked = rows.where("query").select(F.lit(True).alias("asked"), "vec_id", "x", F.size("x").alias("size"), many(shards).alias("shard"), deal(blocks).alias("block"))
    dealt = members.unionByName(asked).repartition(*GROUP).sortWithinPartitions(*GROUP, "asked")
    found = dealt.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
