"""Change-driven operators: what changed by content, streams of files and of change events."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlake.functions.paths import CODE_ENDINGS, DOCUMENT_ENDINGS, ending, is_skipped
from arborlake.graph import Graph
from arborlake.operators.filters import replace_sources
from arborlake.storage import measured, parts_for, shared_dir, written


def content_delta(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, hash, state: added, changed, same or removed. files: path, content; manifest: path, hash."""
    now = files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))
    old = manifest.select("path", F.col("hash").alias("old"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("hash").isNull(), "removed").when(F.col("hash") != F.col("old"), "changed").otherwise("same")
    return now.join(old, "path", "full").select("path", "hash", state.alias("state"))


def new_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose relative path the manifest does not have."""
    return files.join(manifest.select("relative_path"), "relative_path", "left_anti")


def watched(events: DataFrame) -> DataFrame:
    """Create, modify and remove events of tracked files outside skipped folders. events: ts, kind, path."""
    return events.where(F.col("kind").isin("create", "modify", "remove") & ending(F.col("path")).isin(CODE_ENDINGS + DOCUMENT_ENDINGS) & ~is_skipped(F.col("path")))


def quiet_batches(events: DataFrame, gap: str = "500 milliseconds", late: str = "1 minute") -> DataFrame:
    """first_ts, paths: runs of watched events that end where nothing comes for ``gap``. Works on streams and on tables."""
    if not events.isStreaming:
        return _batches_of_table(events, gap)
    runs = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"))
    return runs.agg(F.sort_array(F.collect_set("path")).alias("paths")).select(F.col("w.start").alias("first_ts"), "paths")


def _batches_of_table(events: DataFrame, gap: str, cells: int = 16_384) -> DataFrame:
    """The same without one task for all rows: a session window has no key to deal them by.

    What lies in one cell of time as wide as the gap is in one run, so a cell keeps each path once. Blocks of cells find
    their runs alone; one task passes starts on from block to block, with one row for each block of time.
    """
    spark = events.sparkSession
    wide = spark.sql("SELECT unix_micros(timestamp_micros(0) + CAST(:gap AS INTERVAL))", {"gap": gap}).first()[0]
    later = F.expr(f"CAST('{wide} microseconds' AS INTERVAL)")
    seen = events.groupBy(F.window("ts", f"{wide} microseconds").alias("w"), "path").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    seen, found = measured(seen.select(F.col("w.start").alias("cell"), "path", "first", "last"), "cells", rows=F.count(F.lit(1)))
    parts = parts_for(found["rows"])

    rows = seen.select(F.window("cell", f"{cells * wide} microseconds").alias("b"), "path", "first", "last").select(F.col("b.start").alias("block"), F.col("b.end").alias("next"), "path", "first", "last")
    order = Window.partitionBy("block").orderBy("first").rowsBetween(Window.unboundedPreceding, 0)
    before = F.max("last").over(Window.partitionBy("block").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.repartition(parts, "block").withColumn("start", F.when(F.col("first") >= before + later, F.col("first")))
    rows = rows.withColumn("start", F.max("start").over(order))  # null as long as the run may have begun before the block
    runs = written(rows.groupBy("block", "next", "start", "path").agg(F.min("first").alias("first"), F.max("last").alias("last")), "runs")

    blocks = runs.groupBy("block", "next").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("start").alias("start"))
    in_time = Window.orderBy("block")
    tied = (F.lag("next").over(in_time) == F.col("block")) & (F.col("first") < F.lag("last").over(in_time) + later)
    begun = F.when(F.coalesce(tied, F.lit(False)), F.lag("start").over(in_time)).otherwise(F.col("first"))
    begun = F.last(begun, ignorenulls=True).over(in_time.rowsBetween(Window.unboundedPreceding, 0))
    heads = written(blocks.select("block", begun.alias("begun")), "blocks")
    whole = runs.join(heads, "block").select(F.coalesce("start", "begun").alias("first_ts"), "path").repartition(parts, "first_ts")
    return whole.groupBy("first_ts").agg(F.sort_array(F.collect_set("path")).alias("paths"))


def rebuild(graph: Graph, changed: DataFrame, extract: Callable[[DataFrame], Graph]) -> Graph:
    """The graph with the rows of changed files replaced by what ``extract`` finds in them. changed: source_file, content."""
    new = extract(changed)
    return replace_sources(graph, changed, new.nodes, new.edges)


def stale(sources: DataFrame, built: DataFrame) -> DataFrame:
    """One row, stale: whether a source (modificationTime) is newer than what was built (built_at)."""
    newest = sources.agg(F.max("modificationTime").alias("newest"))
    return newest.join(F.broadcast(built.agg(F.max("built_at").alias("built")))).select(F.coalesce(F.col("newest") > F.col("built"), F.lit(False)).alias("stale"))


def change_events(old: Graph, new: Graph) -> DataFrame:
    """type, id, source, target, relation: what a reader of the old graph has to apply to have the new one."""
    none = F.lit(None).cast("string")

    def nodes(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
        return a.join(b.select("id"), "id", "left_anti").select(F.lit(kind).alias("type"), "id", none.alias("source"), none.alias("target"), none.alias("relation"))

    def edges(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
        keys = ["source", "target", "relation"]
        return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti").select(F.lit(kind).alias("type"), none.alias("id"), *keys)

    return nodes(new.nodes, old.nodes, "node_added").union(nodes(old.nodes, new.nodes, "node_removed")).union(edges(new.edges, old.edges, "edge_added")).union(edges(old.edges, new.edges, "edge_removed"))


def closed_days(log: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """Daily counts of days before today, and the rows of today that stay queued. log: ts, tool."""
    day = F.date_format("ts", "yyyy-MM-dd")
    done = log.where(day < today).groupBy(day.alias("day"), "tool").agg(F.count("*").alias("calls"))
    return done, log.where(day >= today)


def trimmed(queue: DataFrame, most_bytes: int) -> DataFrame:
    """The newest lines (ord, line) that fit into ``most_bytes``."""
    used = F.sum(F.octet_length("line") + 1).over(Window.orderBy(F.desc("ord")))
    return queue.orderBy(F.desc("ord")).limit(most_bytes).withColumn("used", used).where(F.col("used") <= most_bytes).drop("used")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table events as a stream of files."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if path.startswith("/") and os.path.isfile(path):
        return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return reader.parquet(path)


def hourly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hour, event_type, n, total from the stream of events, run until all files are read and returned as a table."""
    events = event_stream(spark, sf_dir)
    rolled = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    shaped = rolled.select(F.col("w.start").alias("hour"), "event_type", "n", "total")
    base = shared_dir(spark)
    name = f"rollup-{uuid.uuid4().hex}"
    out = f"{base}/{name}"
    run = (
        shaped.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/{name}-state")
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(shaped.schema).parquet(out)
