"""Unions, merges, duplicates and repairs of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlake.functions.text import is_rationale
from arborlake.graph import Graph
from arborlake.operators.joins import first_by
from arborlake.storage import parts_for, written

# Fixed value: how many of the most frequent ends may be dealt to all tasks.
MOST = 1000


def concatenated(a: Graph, b: Graph) -> Graph:
    return Graph(a.nodes.unionByName(b.nodes, True), a.edges.unionByName(b.edges, True), a.directed)


def merged(a: Graph, b: Graph, last_wins: bool = False) -> Graph:
    """One node for each id and one edge for each (source, target, relation): the first graph's, or the last's."""
    side = F.desc("__side") if last_wins else F.asc("__side")

    def both(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
        rows = x.withColumn("__side", F.lit(0)).unionByName(y.withColumn("__side", F.lit(1)), True)
        return first_by(rows, keys, [side, F.col("ord") if "ord" in rows.columns else F.lit(0)]).drop("__side")

    return Graph(both(a.nodes, b.nodes, ["id"]), both(a.edges, b.edges, ["source", "target", "relation"]), a.directed)


def recall(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, recall: 1 - |count(a) - count(b)| / max(count, 1) of a."""
    n = a.agg(F.count("*").alias("a")).join(F.broadcast(b.agg(F.count("*").alias("b"))))
    return n.select(F.greatest(F.lit(0.0), 1 - F.abs(F.col("a") - F.col("b")) / F.greatest("a", F.lit(1))).alias("recall"))


def label_map(nodes: DataFrame) -> DataFrame:
    """id, first_id: for each node the first node (by ord) with its label."""
    first = nodes.groupBy("label").agg(F.min_by("id", F.struct("ord", "id")).alias("first_id"))
    return nodes.select("id", "label").join(first, "label").select("id", "first_id")


def exact_duplicates(nodes: DataFrame) -> DataFrame:
    """id, first_id for each node that has the file and label of an earlier one."""
    first = nodes.groupBy("source_file", "label").agg(F.min_by("id", F.struct("ord", "id")).alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return nodes.join(first, ["source_file", "label"]).where("id != first_id").select("id", "first_id")


def with_one_node_per_label(graph: Graph) -> Graph:
    """Nodes merged by label, edges moved to the nodes that stay and each kept once."""
    names = label_map(graph.nodes)
    kept = graph.nodes.join(names.where("id = first_id").select("id"), "id", "left_semi")
    return Graph(kept, moved(graph.edges, names), graph.directed)


def moved(edges: DataFrame, names: DataFrame, each: int = 100_000) -> DataFrame:
    """Edges with their ends renamed by id -> first_id, one for each (source, target, relation).

    Tasks take about ``each`` edges, up to 200 tasks; a sketch of frequent ends only says what is dealt to all of them.
    """
    columns = edges.columns
    often = [F.expr(f"approx_top_k({end}, {MOST}, {32 * MOST})").alias(end) for end in ("source", "target")]
    edges = written(edges, "moved")
    top = edges.agg(F.count("*").alias("n"), *often).first()
    parts = parts_for(top["n"], each)
    names = written(names.where("id != first_id"), "names")
    for end in ("source", "target"):
        hubs = [x["item"] for x in top[end] if x["item"] is not None and x["count"] > top["n"] / parts / 2]
        edges = _renamed(edges, names, end, hubs, parts)
    return distinct_edges(edges.select(*columns))


def _renamed(edges: DataFrame, names: DataFrame, end: str, hubs: list[str], parts: int) -> DataFrame:
    """Edges with one end renamed; those of ``hubs`` are dealt to all tasks, to which the hub's name is copied."""
    left, right, keys = edges, names.select(F.col("id").alias(end), "first_id"), [end]
    if hubs:
        hub, keys = F.coalesce(F.col(end).isin(hubs), F.lit(False)), [end, "__part"]
        other = "target" if end == "source" else "source"
        left = left.withColumn("__part", F.when(hub, F.pmod(F.hash(other, "relation"), F.lit(parts))).otherwise(0))
        right = right.withColumn("__part", F.explode(F.when(hub, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    rows = left.repartition(parts, *keys).join(right.repartition(parts, *keys).hint("merge"), keys, "left")
    return rows.withColumn(end, F.coalesce("first_id", end)).select(*edges.columns)


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["source", "target", "relation"])


def prefixed(graph: Graph, tag: str, keep_details: bool = True) -> Graph:
    """Ids as tag::id, with the repository in the metadata. keep_details=False also forgets docstrings and contexts."""
    name = lambda c: F.concat(F.lit(f"{tag}::"), F.col(c))
    known = F.coalesce("metadata", F.create_map().cast("map<string,string>")) if "metadata" in graph.nodes.columns else F.create_map().cast("map<string,string>")
    extra = F.map_concat(F.map_filter(known, lambda k, v: ~k.isin("repo", "local_id")), F.create_map(F.lit("repo"), F.lit(tag), F.lit("local_id"), F.col("id")))
    nodes = graph.nodes.withColumns({"metadata": extra, "id": name("id")})
    edges = graph.edges.withColumns({"source": name("source"), "target": name("target")})
    if not keep_details:
        nodes = nodes.withColumn("docstring", F.lit(None).cast("string"))
        edges = edges.withColumn("context", F.lit(None).cast("string"))
    return Graph(nodes, edges, graph.directed)


def attached(hyperedges: DataFrame, new: DataFrame) -> DataFrame:
    """Hyperedges and those new ones whose id is not there yet."""
    return hyperedges.unionByName(new.join(hyperedges.select("id"), "id", "left_anti"), True)


def split_communities(nodes: DataFrame, most: int) -> DataFrame:
    """id, community, part: communities above ``most`` nodes in consecutive parts by ord."""
    place = F.row_number().over(Window.partitionBy("community").orderBy("ord")) - 1
    return nodes.where("community is not null").select("id", "community", F.floor(place / most).alias("part"))


def sanitised(graph: Graph, hyperedges: DataFrame | None = None) -> tuple[Graph, DataFrame | None]:
    """Without rationale and concept nodes: sentences among them join the rationale of the node they explain."""
    drop = graph.nodes.where(F.col("file_type").isin("rationale", "concept"))
    told = drop.where(is_rationale(F.col("label"))).select(F.col("id").alias("source"), "label")
    why = graph.edges.where(F.col("relation") == "rationale_for").join(told, "source").groupBy(F.col("target").alias("id"))
    why = why.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source", "label"))), lambda x: x["label"]), "\n\n").alias("why"))
    ids = drop.select(F.col("id").alias("gone")).distinct()
    nodes = graph.nodes.join(ids, F.col("id") == F.col("gone"), "left_anti").join(why, "id", "left")
    old = F.nullif("rationale", F.lit("")) if "rationale" in graph.nodes.columns else F.lit(None).cast("string")
    nodes = nodes.withColumn("rationale", F.when(F.col("why").isNull(), old).otherwise(F.concat_ws("\n\n", old, "why"))).drop("why")
    edges = graph.edges.join(ids, F.col("source") == F.col("gone"), "left_anti").join(ids, F.col("target") == F.col("gone"), "left_anti")
    if hyperedges is not None:
        rows = hyperedges.select("id", F.posexplode("nodes").alias("p", "member")).join(ids, F.col("member") == F.col("gone"), "left_anti")
        left = rows.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "member"))), lambda x: x["member"]).alias("nodes")).where(F.size("nodes") >= 2)
        hyperedges = hyperedges.drop("nodes").join(left, "id")
    return Graph(nodes, edges, graph.directed), hyperedges
