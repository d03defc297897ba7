"""The public tools: each a function from a graph (and the tool's arguments) to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.extract import structure
from arborlake.functions import text
from arborlake.graph import Graph
from arborlake.operators import aggregates, analytics, filters, joins, search, traversal
from arborlake.sources import files as sources
from arborlake.sources import graphs


def _terms(graph: Graph, question: str) -> list[str]:
    row = graph.nodes.sparkSession.createDataFrame([(question,)], "q string").select(text.query_terms(F.col("q")).alias("t")).first()
    return list(dict.fromkeys(row["t"]))


def query_graph(graph: Graph, question: str, depth: int = 2, budget: int = 2000, contexts: list[str] | None = None) -> DataFrame:
    """line, text: seeds by lexical score, what lies around them over edges of the asked contexts, as text within the budget."""
    names, _ = filters.resolved_contexts(question, contexts)
    part = filters.with_contexts(graph, names)
    seeds = search.seeds(search.lexical_scores(graph.nodes, _terms(graph, question) or [question.lower()]))
    threshold = aggregates.hub_threshold(part).first()["threshold"]
    seen, led = traversal.breadth_first(part, seeds.select("id"), depth, threshold)
    edges = led.select(F.col("at").alias("source"), F.col("to").alias("target"), "relation").distinct()
    return traversal.render(graph.nodes.join(seen.select("id"), "id", "left_semi"), edges, seeds, filters.degrees(graph), budget)


def get_node(graph: Graph, node: str) -> DataFrame:
    return graph.nodes.where(F.col("id") == node)


def get_neighbors(graph: Graph, node: str, depth: int = 1, offset: int = 0, limit: int = 50) -> DataFrame:
    return traversal.neighbourhood(graph, node, depth, offset, limit)


def get_community(graph: Graph, community: int, offset: int = 0, limit: int = 50) -> DataFrame:
    return filters.community_members(graph.nodes, community, offset, limit)


def god_nodes(graph: Graph, top: int = 10) -> DataFrame:
    return aggregates.god_nodes(graph, top)


def graph_stats(graph: Graph) -> DataFrame:
    return aggregates.counts(graph)


def shortest_path(graph: Graph, source: str, target: str, most: int = 32) -> DataFrame:
    return traversal.shortest_paths(graph.steps(), source, target, most)


def find_all_paths(graph: Graph, source: str, target: str, most_nodes: int = 5) -> DataFrame:
    return traversal.simple_paths(graph, source, target, most_nodes)


def weighted_path(graph: Graph, source: str, target: str, min_confidence: float = 0.0) -> DataFrame:
    """The least sum of weights over edges that are sure enough."""
    sure = graph.with_edges(graph.edges.where(text.confidence_score(F.col("confidence")) >= min_confidence))
    return traversal.weighted_distances(sure, source, target)


def community_bridges(graph: Graph, top: int = 20) -> DataFrame:
    return analytics.bridges(graph).orderBy("source", "target").limit(top)


def diff(old: Graph, new: Graph) -> DataFrame:
    """side, source, target, relation."""
    added = joins.edges_only_in(new.edges, old.edges).select(F.lit("added").alias("side"), "source", "target", "relation")
    return added.union(joins.edges_only_in(old.edges, new.edges).select(F.lit("removed").alias("side"), "source", "target", "relation"))


def pagerank(graph: Graph, top: int = 10, damping: float = 0.85, iterations: int = 100) -> DataFrame:
    return analytics.pagerank(graph, damping, iterations).orderBy(F.desc("rank"), "id").limit(top)


def detect_cycles(graph: Graph, most: int = 50) -> DataFrame:
    return analytics.cycles(graph).orderBy("component").limit(most)


def smart_summary(graph: Graph, level: str = "architecture", budget: int = 20) -> DataFrame:
    return aggregates.smart_summary(graph, level, budget)


def find_similar(graph: Graph, node: str, top: int = 10) -> DataFrame:
    return analytics.similar(analytics.structural_vectors(graph), node, top)


def query_vector(graph: Graph, question: str, vectors: DataFrame | None = None, query_vector: list[float] | None = None, top: int = 8) -> DataFrame:
    """line, text around the seeds of the hybrid ranking."""
    terms = _terms(graph, question) or [question.lower()]
    seeds = search.hybrid(graph, terms, vectors, query_vector, symbol=" " not in question and any(c.isupper() or c == "_" for c in question), top=top)
    seen, led = traversal.breadth_first(graph, seeds.select("id"), 2, aggregates.hub_threshold(graph).first()["threshold"])
    edges = led.select(F.col("at").alias("source"), F.col("to").alias("target"), "relation").distinct()
    return traversal.render(graph.nodes.join(seen.select("id"), "id", "left_semi"), edges, seeds, filters.degrees(graph), top * 200)


def blast_radius(graph: Graph, name: str, depth: int = 3) -> DataFrame:
    return traversal.blast_radius(graph, name, depth)


def blast_radius_scored(graph: Graph, name: str, depth: int = 3) -> DataFrame:
    return traversal.blast_radius_scored(graph, name, aggregates.node_risk(graph), depth)


def blast_radius_multi(graph: Graph, names: list[str], depth: int = 3) -> DataFrame:
    return traversal.blast_radius_multi(graph, names, depth)


def query_semantic(graph: Graph, question: str, least: float = 0.7) -> DataFrame:
    seeds = search.seeds(search.lexical_scores(graph.nodes, _terms(graph, question) or [question.lower()]), 5, 0.0)
    return traversal.semantic_neighbourhood(graph, seeds.select("id"), least)


def hierarchy(graph: Graph, node: str) -> DataFrame:
    return joins.hierarchy(graph, node)


def list_graphs(manifest: DataFrame) -> DataFrame:
    return manifest.orderBy("tag")


def module_summary(graph: Graph) -> DataFrame:
    return aggregates.module_summary(graph)


def outline(files: DataFrame, path: str) -> DataFrame:
    return structure.outline(files.where(F.col("path") == path))


def read(files: DataFrame, path: str, first: int = 1, last: int = 0) -> DataFrame:
    return structure.read_lines(sources.lines(files.where(F.col("path") == path)), path, first, last)


def read_method(files: DataFrame, path: str, name: str) -> DataFrame:
    return structure.read_method(files, path, name)


def read_with_callees(files: DataFrame, path: str, name: str) -> DataFrame:
    return structure.read_with_callees(files, path, name)


def find_callers(graph: Graph, label: str) -> DataFrame:
    return joins.find_callers(graph, label)


def find_usages(files: DataFrame, name: str) -> DataFrame:
    return joins.usages(sources.lines(files), name)


def context(graph: Graph, query: str) -> DataFrame:
    """side, id: the nodes that the query names, with their callers and callees."""
    row = graph.nodes.sparkSession.createDataFrame([(query,)], "q string").select(text.symbol_candidates(F.col("q")).alias("t")).first()
    names = row["t"]
    if max(map(len, names), default=0) >= 10:
        names = [n for n in names if len(n) >= 6]
    low = [n.lower() for n in names]
    own = graph.nodes.where(text.bare_label(F.col("label")).isin(low)).select(F.lit("match").alias("side"), "id")
    out = own
    for n in names:
        out = out.union(joins.callers_and_callees(graph, n))
    return out.distinct()


def resolve(graph: Graph, query: str, top: int = 3) -> DataFrame:
    """id, score, label, source_file: at least ten candidates, those with a location first."""
    best = search.adjusted(search.fused(search.bm25(search.node_texts(graph), _terms(graph, query) or [query.lower()]), most=max(10, top)), graph.nodes, _terms(graph, query))
    located = F.col("source_location").isNotNull() if "source_location" in graph.nodes.columns else F.lit(True)
    return best.join(graph.nodes, "id").orderBy(F.desc(located), F.desc("score"), "id").limit(top).select("id", "score", "label", "source_file")


def build(spark: SparkSession, root: str, ignore: list[str] | None = None) -> Graph:
    """The graph of the sources below a folder, with communities."""
    graph = structure.extracted(sources.scan(spark, root, ignore).where("file_type = 'code'").select(F.col("relative_path").alias("path"), "content"))
    found = analytics.detected_communities(graph)
    return Graph(graph.nodes.drop("community").join(found, "id", "left"), graph.edges, graph.directed)


def stats(log: DataFrame, now) -> DataFrame:
    return aggregates.tool_windows(log, now)


def affected(graph: Graph, name: str, depth: int = 2) -> DataFrame:
    seed = search.resolved_seed(graph.nodes, name).first()["id"]
    return traversal.affected(graph, seed, depth) if seed else traversal.affected(graph, "", depth)


def questions(graph: Graph) -> DataFrame:
    """question: three fixed ones, one more if there is a cycle, and one if there are several languages."""
    fixed = ["Which nodes are the most connected?", "Which connections are surprising?", "Which parts hold the graph together?"]
    spark = graph.nodes.sparkSession
    rows = spark.createDataFrame([(q,) for q in fixed], "question string")
    cycle = analytics.cycles(graph).limit(1).select(F.concat(F.lit("Why do these depend on each other: "), F.array_join(F.slice("members", 1, 5), ", ")).alias("question"))
    many = aggregates.language_histogram(graph.nodes).agg(F.count("*").alias("n")).where("n > 1").select(F.concat(F.lit("How do the "), F.col("n").cast("string"), F.lit(" languages work together?")).alias("question"))
    return rows.union(cycle).union(many)


def merge_into(merged: Graph, new: Graph, tag: str, manifest: DataFrame, source_hash: str, force: bool = False) -> tuple[Graph, bool]:
    return graphs.add_to_merged(merged, new, tag, manifest, source_hash, force)


TOOLS = {f.__name__: f for f in (
    query_graph, get_node, get_neighbors, get_community, god_nodes, graph_stats, shortest_path, find_all_paths, weighted_path, community_bridges, diff, pagerank, detect_cycles, smart_summary, find_similar, query_vector,
    blast_radius, blast_radius_scored, blast_radius_multi, query_semantic, hierarchy, list_graphs, module_summary, outline, read, read_method, read_with_callees, find_callers, find_usages, context, resolve, build, stats,
)}
