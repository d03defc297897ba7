"""Mixing sources to target weights by a time-varying curriculum, in SQL functions only.

Every source has a weight schedule ``w(t) = W * (1 + a * (2t - 1))`` over training time t in [0, 1]. Its integral up
to t, ``W * (t + a * (t*t - t))``, is the source's cumulative demand; the document at cumulative demand share y trains
at the t that solves ``a*t*t + (1 - a)*t = y``. Documents are range-sorted by that position.

Demand: targets share all words by W and stop at ``max_repeats`` times their source's words; what is above is reshared
by weight. A source of S words and target T = k*S + f gives every document k whole repeats and the first f words of its
hash order once more, so the words taken sum to T (less a part of a word).

The cumulative words of a source are a two-level prefix sum: rows fall into buckets by a hash, buckets get offsets from
a window over bucket sums, and a window inside each bucket does the rest. No window holds a whole source's rows.

Defined results: a null text has size 0; empty tables give no rows; documents of size 0 are taken 0 times; sources are
ranked by code point with null last; repeated rows (equal source, doc_id and size) share one interval of the
cumulative words in equal parts; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.llm.shared import measured, text_key, written

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
WEIGHTS = 3
ROWS_PER_BUCKET = 2048


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: source, source_size, weight, slope, target. ``sizes``: source, size."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = by_source.withColumn("weight", ((rank - 1) % WEIGHTS + 1).cast("double"))
    cap = (F.lit(max_repeats) * F.col("source_size")).cast("double")
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    level = weighed.select("*", cap.alias("cap"), left.alias("left"))
    capped = F.col("left") * F.col("weight") > F.col("cap")
    share = F.max(F.when(~capped, F.col("left"))).over(everything)
    return level.select(
        "source", "source_size", "weight",
        ((F.lit(2) - F.col("weight")) / 2).alias("slope"),
        F.when(capped, F.col("cap")).otherwise(share * F.col("weight")).alias("target"),
    )


def training_time(demand: Column) -> Column:
    """The training time in [0, 1] at which the source's schedule has asked for ``demand`` words, rounded to 9 places."""
    y = demand / F.col("target")
    a = F.col("slope")
    root = F.sqrt((1 - a) * (1 - a) + 4 * a * y)
    return F.round(F.when(a == 0, y).otherwise((root - (1 - a)) / (2 * a)), 9)


def demand(docs: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """A row for each different (source, doc_id, size, text) with its number of copies and its source's target.

    start: words of the source before the row, in its hash order.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sizes, seen = measured(docs.select("doc_id", text_key().alias("text_key"), "source", size.alias("size")), "mix-sizes", n=F.count("*"))
    digits = 1
    while seen["n"] > ROWS_PER_BUCKET * 16**digits:
        digits += 1
    targets = written(source_targets(sizes, max_repeats), "mix-targets")
    ident = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    rows = written(
        sizes.groupBy("source", "doc_id", "size", "text_key").agg(F.count("*").alias("copies"))
        .withColumn("hash", F.md5(ident)).withColumn("bucket", F.substring("hash", 1, digits)),
        "mix-rows",
    )
    words = F.col("size") * F.col("copies")
    sums = rows.groupBy("source", "bucket").agg(F.sum(words).alias("words"))
    offset = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), F.coalesce(offset, F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("hash", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
    named = targets.withColumnRenamed("source", "t_source")
    joined = placed.join(named, F.col("source").eqNullSafe(F.col("t_source")))
    return joined.withColumn("start", F.col("offset") + F.col("inside")).select(
        "doc_id", "text_key", "size", "copies", "source", "source_size", "target", "slope", "hash", "start"
    )


def whole_repeats() -> Column:
    return F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")


def further_words(start: Column, words: Column) -> Column:
    """How many of the words from ``start`` on lie within what the target asks beyond whole repeats."""
    rest = F.col("target") - whole_repeats() * F.col("source_size")
    return F.floor(F.least(F.greatest(rest - start, F.lit(0.0)), words.cast("double"))).cast("long")


def mix(docs: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, hash, position for each row of ``docs``."""
    single = demand(docs, max_repeats).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    single = single.withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    spread = single.withColumn("taken", whole_repeats() * F.col("size") + further_words(F.col("start"), F.col("size")))
    at = F.when(F.col("taken") > 0, training_time(F.col("start")))
    return spread.withColumn("position", at).select("doc_id", "size", "source", "source_size", "target", "taken", "hash", "position")


def in_training_order(mixed: DataFrame) -> DataFrame:
    """The rows range-sorted by position; rows that the mix leaves out come first, by hash."""
    return mixed.repartitionByRange(F.col("position").asc_nulls_first(), F.col("hash")).sortWithinPartitions(
        F.col("position").asc_nulls_first(), "hash"
    )


def op8(docs: DataFrame) -> DataFrame:
    return in_training_order(mix(docs)).select("doc_id", "size", "source_size", "target", "taken", "position")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix in training order, with the columns of ``docs``.

    A document comes once for each whole repeat taken. A part of a repeat comes as the text's first words, as many as
    the mix takes, so that every source's words meet its target.
    """
    columns = docs.columns
    words = F.col("size") * F.col("copies")
    plan = demand(docs).withColumn("more", further_words(F.col("start"), words))
    whole = F.col("copies") * whole_repeats() + F.floor(F.col("more") / F.col("size"))
    plan = plan.where("size > 0").withColumn("part", F.col("more") % F.col("size")).withColumn("whole", whole)
    plan = plan.withColumn("instances", F.col("whole") + (F.col("part") > 0).cast("long")).where("instances > 0")
    once = F.col("start") + (F.col("instance") % F.col("copies")) * F.col("size")
    plan = plan.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("instances") - 1)).alias("instance"))
    plan = plan.withColumn("position", training_time(F.floor(F.col("instance") / F.col("copies")) * F.col("source_size") + once))
    plan = plan.select(
        F.struct("doc_id", "source", "text_key").alias("__m_row"), F.col("hash").alias("__m_hash"), F.col("position").alias("__m_at"),
        F.when((F.col("instance") == F.col("whole")), F.col("part")).alias("__m_part"), F.col("copies").alias("__m_copies"),
    )
    plan, seen = measured(plan, "mix-plan", most=F.max("__m_copies"))
    keyed = docs.withColumn("__m_key", text_key())
    if (seen["most"] or 0) > 1:  # a repeated row meets its plan once
        keyed = keyed.dropDuplicates(["doc_id", "source", "__m_key"])
    row = F.col("__m_row")
    joined = keyed.join(plan, F.col("doc_id").eqNullSafe(row["doc_id"]) & F.col("source").eqNullSafe(row["source"]) & (F.col("__m_key") == row["text_key"]))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("__m_part").cast("int")), "")
    cut = joined.withColumn("text", F.when(F.col("__m_part").isNull(), F.col("text")).otherwise(first))
    return cut.repartitionByRange("__m_at", "__m_hash").sortWithinPartitions("__m_at", "__m_hash").select(*columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s
), l AS (
  SELECT *, (3 * source_size)::DOUBLE AS cap,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0)::DOUBLE)
      / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS lft
  FROM w WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, (2 - weight) / 2 AS slope,
    CASE WHEN lft * weight > cap THEN cap ELSE max(CASE WHEN NOT lft * weight > cap THEN lft END) OVER () * weight END AS target
  FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '') || '/' || d.size::VARCHAR), d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS k FROM p
), g AS (
  SELECT doc_id, size, source_size, target, slope, start,
    (k * size + floor(least(greatest(target - k * source_size - start, 0), size)))::BIGINT AS taken
  FROM k
)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN round(CASE WHEN slope = 0 THEN start / target
    ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * (start / target)) - (1 - slope)) / (2 * slope) END, 9) + 0 END AS position
FROM g
"""
