"""Checks of graphs, each giving rows of what is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.graph import Graph

# What a fragment may hold.
FILE_TYPES = ["code", "document", "paper", "image", "rationale", "concept"]
CONFIDENCES = ["EXTRACTED", "INFERRED", "AMBIGUOUS"]
ID_PATTERN = r"^[A-Za-z0-9._:-]{1,256}$"


def node_errors(nodes: DataFrame, file_types: list[str] | None = None) -> DataFrame:
    """id, problem: a field that is missing, or a file type out of the list."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in ("id", "label", "file_type", "source_file")]
    checks.append(F.when(F.col("file_type").isNotNull() & ~F.col("file_type").isin(file_types or FILE_TYPES), F.lit("unknown file_type")))
    return nodes.select("id", F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def edge_errors(graph: Graph) -> DataFrame:
    """source, target, problem: a missing field, an unknown confidence, an end that is no node."""
    ids = graph.nodes.select(F.col("id").alias("known")).where("known is not null").distinct()
    rows = graph.edges.join(ids.withColumnRenamed("known", "ks"), F.col("source") == F.col("ks"), "left").join(ids.withColumnRenamed("known", "kt"), F.col("target") == F.col("kt"), "left")
    checks = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in ("source", "target", "relation", "confidence")]
    checks.append(F.when(F.col("confidence").isNotNull() & ~F.col("confidence").isin(CONFIDENCES), F.lit("unknown confidence")))
    checks.append(F.when(F.col("source").isNotNull() & F.col("ks").isNull(), F.lit("dangling source")))
    checks.append(F.when(F.col("target").isNotNull() & F.col("kt").isNull(), F.lit("dangling target")))
    return rows.select("source", "target", F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def bad_ids(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("id").isNull() | ~F.col("id").rlike(ID_PATTERN)).select("id")


def fragment_errors(graph: Graph, hyperedges: DataFrame | None = None, most_nodes: int = 10_000, most_edges: int = 50_000, most_members: int = 50) -> DataFrame:
    """problem: caps on the numbers of nodes, edges and members that are exceeded, and ids that break the rule."""
    size = graph.nodes.agg((F.count("*") > most_nodes).alias("x")).where("x").select(F.lit("too many nodes").alias("problem"))
    size = size.union(graph.edges.agg((F.count("*") > most_edges).alias("x")).where("x").select(F.lit("too many edges")))
    size = size.union(bad_ids(graph.nodes).select(F.concat(F.lit("bad id "), F.coalesce("id", F.lit("null")))))
    if hyperedges is not None:
        size = size.union(hyperedges.where(F.size("nodes") > most_members).select(F.concat(F.lit("too many members in "), "id")))
    return size


def assert_valid(graph: Graph, file_types: list[str] | None = None) -> None:
    """Raises ValueError with the first hundred problems."""
    problems = node_errors(graph.nodes, file_types).select("id", "problem").union(edge_errors(graph).select("source", "problem")).limit(100).collect()
    if problems:
        raise ValueError("; ".join(f"{r[0]}: {r[1]}" for r in problems))


def repositories(nodes: DataFrame, empty_counts: bool = False) -> DataFrame:
    """One row, single: whether all nodes are of one repository; an empty name counts only if asked."""
    repo = F.col("repo") if empty_counts else F.nullif("repo", F.lit(""))
    return nodes.agg((F.countDistinct(repo) <= 1).alias("single"))


def suppressions(lines: DataFrame) -> DataFrame:
    """path, line: source lines that declare a set of what was seen, where parallel edges can be lost."""
    return lines.where(F.col("text").rlike(r"\b(seen|visited)\w*\s*(:[^=]*)?=\s*(set\(|HashSet|new Set|\{\})")).select("path", "line")


def parallel_edge_probes(graph: Graph) -> DataFrame:
    """probe, holds: what a keyed multigraph promises for these edges."""
    e = graph.edges.agg(
        F.count("*").alias("n"), F.countDistinct("source", "target").alias("pairs"), F.countDistinct("source", "target", "relation").alias("keys"),
        F.countDistinct(F.least("source", "target"), F.greatest("source", "target")).alias("unordered"),
    )
    probes = {"keys_within_edges": "keys <= n", "pairs_within_keys": "pairs <= keys", "unordered_within_pairs": "unordered <= pairs", "no_exact_repeat": "keys = n", "one_relation_per_pair": "pairs = keys", "no_mirrored_pair": "unordered = pairs"}
    return e.select(F.explode(F.array(*[F.struct(F.lit(k).alias("probe"), F.expr(v).alias("holds")) for k, v in probes.items()])).alias("x")).select("x.*")
