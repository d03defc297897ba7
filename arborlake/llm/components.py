"""Connected components of a link table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.shared import free, measured, written


def connected_components(links: DataFrame) -> DataFrame:
    """node, root for each node of ``links`` (columns a, b; null ends and loops are ignored). root: its component's smallest node.

    Each step joins links with the smallest neighbour of their ends; links are never gathered by node, so a hub is a
    skewed join and not a large group. The steps end when the links are stars around the smallest nodes.
    """
    ends = links.where("a is not null and b is not null and a != b")
    now = written(ends.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    mark = None
    while True:
        both = now.union(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        # a table of its own, so that the join below can split a hub
        least = written(both.groupBy(F.col("hi").alias("at")).agg(F.min(F.least("hi", "lo")).alias("to")), "least")
        large = both.join(least, F.col("hi") == F.col("at")).where("lo > hi and lo != to").select(F.col("lo").alias("hi"), F.col("to").alias("lo")).distinct()
        down = large.groupBy(F.col("hi").alias("at")).agg(F.min("lo").alias("to"))
        small = large.join(down, F.col("hi") == F.col("at")).where("lo != to").select(F.col("lo").alias("hi"), F.col("to").alias("lo"))
        links, last = F.struct("hi", "lo"), now
        now, seen = measured(small.union(down.select("at", "to")).distinct(), "links", n=F.count("*"), sum=F.sum(F.xxhash64(links).cast("decimal(38,0)")))
        free(last, least)
        if seen == mark or not seen["n"]:
            break
        mark = seen
    tops = now.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(tops)
