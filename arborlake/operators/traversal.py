"""Walks over the graph: breadth first, paths and impact. Frontiers are DataFrames; rounds end early when nothing is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.graph import Graph
from arborlake.operators.filters import degrees
from arborlake.storage import written

# Relations along which a change is felt.
IMPACT_RELATIONS = "calls references imports imports_from re_exports inherits extends implements uses mixes_in embeds".split()


def expanded(steps: DataFrame, seeds: DataFrame, depth: int, closed: DataFrame | None = None) -> DataFrame:
    """id, depth of everything within ``depth`` steps of the seeds (column id), at its smallest depth.

    steps: at, to. closed: ids that are reached but not walked on from, unless they are seeds.
    """
    seen = written(seeds.select("id", F.lit(0).alias("depth")).distinct(), "seen")
    frontier = seen.select("id")
    for d in range(1, depth + 1):
        if closed is not None and d > 1:
            frontier = frontier.join(closed.select(F.col("id").alias("c")), F.col("id") == F.col("c"), "left_anti")
        reached = steps.join(frontier, F.col("at") == F.col("id"), "left_semi").select(F.col("to").alias("id")).distinct()
        new = written(reached.join(seen.select("id"), "id", "left_anti").select("id", F.lit(d).alias("depth")), "seen")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        frontier = new.select("id")
    return seen


def hubs(graph: Graph, threshold: int) -> DataFrame:
    """Ids that a walk reaches but does not go on from."""
    return degrees(graph).where(F.col("degree") >= threshold).select("id")


def breadth_first(graph: Graph, seeds: DataFrame, depth: int, hub_threshold: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Reached nodes with their depth, and for each level every (at, to) that led to a new node."""
    seen = expanded(graph.steps(), seeds, depth, hubs(graph, hub_threshold) if hub_threshold else None)
    parents = seen.select(F.col("id").alias("at"), F.col("depth").alias("d"))
    if hub_threshold:
        stop = hubs(graph, hub_threshold).select(F.col("id").alias("h"))
        parents = parents.join(stop, (F.col("at") == F.col("h")) & (F.col("d") > 0), "left_anti")
    children = seen.select(F.col("id").alias("to"), F.col("depth").alias("e"))
    led = graph.steps().join(parents, "at").join(children, "to").where("e = d + 1").select("at", "to", "relation", F.col("e").alias("depth"))
    return seen, led


def neighbourhood(graph: Graph, node: str, depth: int = 1, offset: int = 0, limit: int | None = None) -> DataFrame:
    """id, label, depth around the node, without it, nearest first."""
    start = graph.nodes.where(F.col("id") == node).select("id")
    found = expanded(graph.steps(), start, depth).where("depth > 0").join(graph.nodes.select("id", "label", "ord"), "id").orderBy("depth", "ord").offset(offset)
    return (found.limit(limit) if limit else found).select("id", "label", "depth")


def named(nodes: DataFrame, name: str) -> DataFrame:
    """The first node whose label is the name or whose id holds it."""
    return nodes.where((F.lower("label") == name.lower()) | F.col("id").contains(name)).orderBy("ord").limit(1).select("id")


def blast_radius(graph: Graph, name: str, depth: int = 3) -> DataFrame:
    """id, depth of everything within reach of the first node of that name."""
    return expanded(graph.steps(), named(graph.nodes, name), depth).where("depth > 0")


def blast_radius_scored(graph: Graph, name: str, risk: DataFrame, depth: int = 3) -> DataFrame:
    return blast_radius(graph, name, depth).join(risk.select("id", "score", "tier"), "id").orderBy(F.desc("score"), "depth", "id")


def blast_radius_multi(graph: Graph, names: list[str], depth: int = 3) -> DataFrame:
    """id, depth from the nearest of several nodes, without them."""
    starts = named(graph.nodes, names[0])
    for n in names[1:]:
        starts = starts.union(named(graph.nodes, n))
    return expanded(graph.steps(), starts, depth).where("depth > 0")


def affected(graph: Graph, node: str, depth: int = 2, relations: list[str] | None = None) -> DataFrame:
    """id, depth, via: what depends on the node, walking edges backwards, with the first relation by name that reached it."""
    edges = graph.edges.where(F.col("relation").isin(relations or IMPACT_RELATIONS))
    back = edges.select(F.col("target").alias("at"), F.col("source").alias("to"), "relation")
    seen = expanded(back, graph.nodes.where(F.col("id") == node).select("id"), depth)
    a = seen.select(F.col("id").alias("at"), F.col("depth").alias("d"))
    b = seen.where("depth > 0").select(F.col("id").alias("to"), F.col("depth").alias("e"))
    return back.join(a, "at").join(b, "to").where("e = d + 1").groupBy(F.col("to").alias("id")).agg(F.first("e").alias("depth"), F.min("relation").alias("via"))


def shortest_paths(steps: DataFrame, start: str, target: str | None = None, most: int = 32) -> DataFrame:
    """id, hops, path (ids): one shortest path to each node within ``most`` hops, the least by parent id; up to the target if given."""
    spark = steps.sparkSession
    seen = spark.createDataFrame([(start, 0, [start])], "id string, hops int, path array<string>")
    frontier = seen
    for h in range(1, most + 1):
        reached = steps.join(frontier, F.col("at") == F.col("id")).groupBy("to").agg(F.min("path").alias("path"))
        new = reached.join(seen.select(F.col("id").alias("to")), "to", "left_anti")
        new = written(new.select(F.col("to").alias("id"), F.lit(h).alias("hops"), F.concat("path", F.array("to")).alias("path")), "paths")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        frontier = new
        if target is not None and not new.where(F.col("id") == target).isEmpty():
            break
    return seen.where(F.col("id") == target) if target is not None else seen


def weighted_distances(graph: Graph, start: str, target: str | None = None, rounds: int = 64) -> DataFrame:
    """id, distance, path: the least sum of weights from the start, relaxed until nothing gets shorter."""
    forward = graph.edges.select(F.col("source").alias("at"), F.col("target").alias("to"), "weight")
    steps = forward if graph.directed else forward.unionByName(graph.edges.select(F.col("target").alias("at"), F.col("source").alias("to"), "weight"))
    steps = steps.groupBy("at", "to").agg(F.min("weight").alias("weight"))
    best = graph.nodes.sparkSession.createDataFrame([(start, 0.0, [start])], "id string, distance double, path array<string>")
    changed = best
    for _ in range(rounds):
        tried = steps.join(changed, F.col("at") == F.col("id")).select(F.col("to").alias("id"), (F.col("distance") + F.col("weight")).alias("distance"), F.concat("path", F.array("to")).alias("path"))
        shortest = tried.groupBy("id").agg(F.min(F.struct("distance", "path")).alias("x")).select("id", F.col("x.distance").alias("new"), F.col("x.path").alias("new_path"))
        joined = shortest.join(best, "id", "left").where("distance is null or new < distance")
        changed = written(joined.select("id", F.col("new").alias("distance"), F.col("new_path").alias("path")), "distances")
        if changed.isEmpty():
            break
        best = written(best.join(changed.select("id"), "id", "left_anti").unionByName(changed), "distances")
    return best.where(F.col("id") == target) if target is not None else best


def simple_paths(graph: Graph, start: str, target: str, most_nodes: int = 5) -> DataFrame:
    """path: every directed way without a repeated node, of at most ``most_nodes`` nodes, that ends at the target."""
    edges = graph.edges.select(F.col("source").alias("at"), F.col("target").alias("to")).distinct()
    front = graph.nodes.where(F.col("id") == start).select(F.array("id").alias("path"))
    done = front.where(F.lit(start == target))
    for _ in range(most_nodes - 1):
        open_ = front.where(F.element_at("path", -1) != target)
        front = open_.join(edges, F.element_at("path", -1) == F.col("at")).where(~F.array_contains("path", F.col("to"))).select(F.concat("path", F.array("to")).alias("path"))
        done = done.unionByName(front.where(F.element_at("path", -1) == target))
    return done


def semantic_neighbourhood(graph: Graph, seeds: DataFrame, least: float = 0.7, depth: int = 2) -> DataFrame:
    """id, depth over edges of similarity, both ways."""
    from arborlake.operators.filters import semantic_edges

    return expanded(Graph(graph.nodes, semantic_edges(graph.edges, least)).steps(), seeds, depth)


def depth_first(graph: Graph, start: str, depth: int, hub_threshold: int | None = None) -> DataFrame:
    """place, id, depth in the order in which a stack visits nodes: neighbours by id, the last pushed first.

    A node keeps the depth at which it is first popped, so it can be deeper than its shortest way. The order of a stack
    is sequential: only the part of the graph within ``depth`` steps is handed to the one task that walks it.
    """
    reach = expanded(graph.steps(), graph.nodes.where(F.col("id") == start).select("id"), depth).select("id")
    edges = graph.steps().join(reach.select(F.col("id").alias("at")), "at", "left_semi").join(reach.select(F.col("id").alias("to")), "to", "left_semi").select("at", "to").distinct()
    stop = hubs(graph, hub_threshold).select(F.col("id").alias("at"), F.lit(None).cast("string").alias("to")) if hub_threshold else edges.limit(0)

    def walk(pdf):
        import pandas as pd

        closed = set(pdf["at"][pdf["to"].isna()])
        near: dict[str, list[str]] = {}
        for a, b in sorted(zip(pdf["at"][~pdf["to"].isna()], pdf["to"].dropna())):
            near.setdefault(a, []).append(b)
        order, seen, stack = [], set(), [(start, 0)]
        while stack:
            node, d = stack.pop()
            if node in seen or d > depth:
                continue
            seen.add(node)
            order.append((len(order), node, d))
            if node == start or node not in closed:
                stack += [(n, d + 1) for n in near.get(node, ())]
        return pd.DataFrame(order, columns=["place", "id", "depth"])

    return edges.union(stop).withColumn("all", F.lit(1)).groupBy("all").applyInPandas(walk, "place long, id string, depth long")


def tree_walk(graph: Graph, root: str, depth: int = 3) -> DataFrame:
    """path (ids): out edges from the root in pre-order, no node twice on a path."""
    edges = graph.edges.select(F.col("source").alias("at"), F.col("target").alias("to")).distinct()
    front = graph.nodes.where(F.col("id") == root).select(F.array("id").alias("path"))
    every = front
    for _ in range(depth):
        front = front.join(edges, F.element_at("path", -1) == F.col("at")).where(~F.array_contains("path", F.col("to"))).select(F.concat("path", F.array("to")).alias("path"))
        every = every.unionByName(front)
    return every.orderBy("path")


def render(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, degree: DataFrame, budget: int) -> DataFrame:
    """line, text: nodes, seeds first and then by degree, and edges, cut where three characters for each token of the budget end."""
    from pyspark.sql import Window

    first = F.when(F.col("s").isNotNull(), 0).otherwise(1)
    n = nodes.join(degree, "id", "left").join(seeds.select(F.col("id").alias("s")), F.col("id") == F.col("s"), "left").select(
        first.alias("a"), (-F.coalesce("degree", F.lit(0))).alias("b"), F.col("id").alias("c"), F.concat_ws(" ", F.lit("NODE"), "label", F.concat(F.lit("["), F.col("source_file"), F.lit("]"))).alias("text")
    )
    e = edges.select(F.lit(2).alias("a"), F.lit(0).cast("long").alias("b"), F.concat_ws("->", "source", "target", "relation").alias("c"), F.concat(F.lit("EDGE "), F.col("source"), F.lit(" --"), F.col("relation"), F.lit("--> "), F.col("target")).alias("text"))
    order = Window.orderBy("a", "b", "c")
    rows = n.unionByName(e).orderBy("a", "b", "c").limit(3 * budget)  # a line has one character at least
    rows = rows.select(F.row_number().over(order).alias("line"), "text", F.sum(F.length("text") + 1).over(order).alias("used"))
    return rows.where(F.col("used") <= 3 * budget).select("line", "text")


def hop_column(path: Column) -> Column:
    return F.size(path) - 1
