"""Joins between nodes, edges and other tables, named by what they answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.functions import text
from arborlake.functions.paths import suffix_match
from arborlake.graph import Graph
from arborlake.storage import shuffled, written

# Relations of callers and of type hierarchies.
CALLER_RELATIONS = ["calls", "uses", "invokes"]
HIERARCHY_RELATIONS = ["extends", "implements", "inherits"]


def neighbours(graph: Graph, node: str, relation: str | None = None, outgoing_only: bool = False) -> DataFrame:
    """id, label, relation, way: nodes at the other end of the node's edges; parallel edges stay, dangling ends go."""
    out = graph.edges.where(F.col("source") == node).select(F.col("target").alias("id"), "relation", F.lit("out").alias("way"))
    if not outgoing_only:
        out = out.unionByName(graph.edges.where((F.col("target") == node) & (F.col("source") != node)).select(F.col("source").alias("id"), "relation", F.lit("in").alias("way")))
    if relation:
        out = out.where(F.col("relation") == relation)
    return out.join(graph.nodes.select("id", "label"), "id").select("id", "label", "relation", "way")


def last_edge(graph: Graph, order: str = "ord") -> DataFrame:
    """u, v, relation: for each pair of ends, both ways if undirected, the last edge by ``order``."""
    rows = graph.edges.select(F.col("source").alias("u"), F.col("target").alias("v"), "relation", F.col(order).alias("o"))
    if not graph.directed:
        rows = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v"), "relation", "o"))
    return rows.groupBy("u", "v").agg(F.max_by("relation", F.struct("o", "relation")).alias("relation"))


def callers_and_callees(graph: Graph, label: str) -> DataFrame:
    """side, id: over calls edges, who calls a node of that label and whom it calls, less the nodes of the label."""
    entry = graph.nodes.where(F.lower("label") == label.lower()).select(F.col("id").alias("entry")).distinct()
    calls = graph.edges.where(F.col("relation") == "calls")
    callers = calls.join(entry, F.col("target") == F.col("entry"), "left_semi").select(F.lit("caller").alias("side"), F.col("source").alias("id"))
    callees = calls.join(entry, F.col("source") == F.col("entry"), "left_semi").select(F.lit("callee").alias("side"), F.col("target").alias("id"))
    return callers.union(callees).join(entry, F.col("id") == F.col("entry"), "left_anti").distinct()


def find_callers(graph: Graph, label: str, most: int = 5) -> DataFrame:
    """id, label, relation of nodes that call, use or invoke one of the first matches of the label."""
    hit = graph.nodes.where(F.lower("label").contains(label.lower())).orderBy((F.lower("label") != label.lower()), "ord").limit(most)
    edges = graph.edges.where(F.col("relation").isin(CALLER_RELATIONS)).join(F.broadcast(hit.select(F.col("id").alias("hit"))), F.col("target") == F.col("hit"), "left_semi")
    return edges.select(F.col("source").alias("id"), "relation").join(graph.nodes.select("id", "label"), "id").select("id", "label", "relation")


def usages(lines: DataFrame, name: str, most: int = 60) -> DataFrame:
    """Lines (path, line, text) that hold the name as a word."""
    return lines.where(F.col("text").rlike(rf"\b\Q{name}\E\b")).orderBy("path", "line").limit(most)


def hierarchy(graph: Graph, node: str) -> DataFrame:
    """side, id: the node's direct supertypes and subtypes."""
    edges = graph.edges.where(F.lower("relation").isin(HIERARCHY_RELATIONS))
    up = edges.where(F.col("source") == node).select(F.lit("super").alias("side"), F.col("target").alias("id"))
    return up.union(edges.where(F.col("target") == node).select(F.lit("sub").alias("side"), F.col("source").alias("id")))


def edges_only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges of a whose (source, target, relation) b does not have; repeats stay. added = only in new, removed = only in old."""
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("source", "target", "relation")]
    return a.alias("a").join(b.select("source", "target", "relation").alias("b"), on, "left_anti").select("a.source", "a.target", "a.relation")


def label_index(nodes: DataFrame) -> DataFrame:
    """name, ids: nodes by callable label."""
    return nodes.groupBy(text.callable_label(F.col("label")).alias("name")).agg(F.sort_array(F.collect_list("id")).alias("ids"))


def resolved_calls(calls: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target, relation, confidence: calls (caller, name) whose name is the label of exactly one node, new and not to themselves."""
    one = nodes.groupBy(text.callable_label(F.col("label")).alias("name")).agg(F.count("*").alias("n"), F.min("id").alias("target")).where("n = 1 and name != ''")
    found = calls.select(F.col("caller").alias("source"), text.callable_label(F.col("name")).alias("name")).join(one.select("name", "target"), "name").where("source != target")
    new = found.select("source", "target").distinct().join(edges.select("source", "target").distinct(), ["source", "target"], "left_anti")
    return new.select("source", "target", F.lit("calls").alias("relation"), F.lit("INFERRED").alias("confidence"))


def unique_or_local(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """file, symbol, id: the definition in the same file, else the only one anywhere, else null. definitions: file, symbol, id."""
    local = definitions.groupBy("file", "symbol").agg(F.min("id").alias("local"))
    anywhere = definitions.groupBy("symbol").agg(F.countDistinct("id").alias("n"), F.min("id").alias("only")).where("n = 1").select("symbol", "only")
    return references.join(local, ["file", "symbol"], "left").join(anywhere, "symbol", "left").select("file", "symbol", F.coalesce("local", "only").alias("id"))


def export_closure(exports: DataFrame, stars: DataFrame, rounds: int = 32) -> DataFrame:
    """module, name, origin, origin_name: where each exported name is declared, through named and star re-exports.

    exports: module, name, from_module (null: declared here), from_name. stars: module, from_module. Named exports go
    first; a chain ends at a declaration, after ``rounds`` steps or when it finds nothing, and a cycle finds nothing.
    """
    here = exports.where("from_module is null").select("module", "name", F.col("module").alias("origin"), F.col("name").alias("origin_name"))
    renamed = exports.where("from_module is not null")
    renamed = shuffled(written(renamed, "renamed"))
    known = last = written(here, "exports")
    for _ in range(rounds):
        # what was known a round before has found its names already
        k = shuffled(last).select(F.col("module").alias("from_module"), F.col("name").alias("from_name"), "origin", "origin_name")
        named = renamed.join(k, ["from_module", "from_name"]).select("module", "name", "origin", "origin_name")
        starred = stars.join(k, "from_module").select("module", F.col("from_name").alias("name"), "origin", "origin_name")
        new = named.select("*", F.lit(0).alias("rank")).union(starred.select("*", F.lit(1).alias("rank")))
        new = new.groupBy("module", "name").agg(F.min(F.struct("rank", "origin", "origin_name")).alias("x")).select("module", "name", "x.origin", "x.origin_name")
        last = written(new.join(shuffled(known), ["module", "name"], "left_anti"), "exports")
        if last.isEmpty():
            break
        known = known.unionByName(last)
    return known


def import_edges(imports: DataFrame, exports: DataFrame, relation: str = "uses") -> DataFrame:
    """source, target, relation: importers tied to the node that declares the imported name. imports: id, module, name; exports: module, name, id."""
    named = exports.select("module", "name", F.col("id").alias("target"))
    found = imports.select(F.col("id").alias("source"), "module", "name").join(named, ["module", "name"]).where("source != target")
    return found.select("source", "target").distinct().withColumn("relation", F.lit(relation))


def without_known_stubs(new: Graph, old: Graph) -> Graph:
    """The new graph without nodes of no file whose label the old graph has as such a node, and without their edges."""
    known = old.nodes.where(F.coalesce("source_file", F.lit("")) == "").select(F.col("label").alias("stub")).distinct()
    stubs = new.nodes.where(F.coalesce("source_file", F.lit("")) == "").join(known, F.col("label") == F.col("stub"), "left_semi").select(F.col("id").alias("gone")).distinct()
    edges = new.edges.join(stubs, F.col("source") == F.col("gone"), "left_anti").join(stubs, F.col("target") == F.col("gone"), "left_anti")
    return Graph(new.nodes.join(stubs, F.col("id") == F.col("gone"), "left_anti"), edges, new.directed)


def change_impact(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """nodes, communities, files: what lies in files that match a changed path (column path) by suffix; each file counts once.

    Two paths match if one ends with the other at a slash, so they share the last part: the join is on the file name.
    """
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    files = nodes.groupBy("source_file").agg(F.count("*").alias("n"), F.collect_set("community").alias("groups"))
    a = files.withColumn("name", name(F.col("source_file")))
    b = changed.select("path", name(F.col("path")).alias("name")).distinct()
    hit = a.join(b, "name").where(suffix_match(F.col("source_file"), F.col("path"))).dropDuplicates(["source_file"])
    return hit.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.size(F.array_distinct(F.flatten(F.collect_list("groups")))).alias("communities"), F.count("*").alias("files"))


def remapped_communities(new: DataFrame, old: DataFrame) -> DataFrame:
    """community, previous, shared: for each new community the old one with most nodes in common; ties to the smaller. new, old: id, community."""
    both = new.select("id", "community").join(old.select("id", F.col("community").alias("previous")), "id")
    shared = both.groupBy("community", "previous").agg(F.count("*").alias("shared"))
    return shared.groupBy("community").agg(F.max_by("previous", F.struct("shared", -F.col("previous"))).alias("previous"), F.max("shared").alias("shared"))


def cross_community(graph: Graph) -> DataFrame:
    """community, other, links: edges that leave each community, by the community at the other end."""
    own = graph.nodes.where("community is not null").select("id", "community")
    a = own.select(F.col("id").alias("source"), F.col("community").alias("ca"))
    b = own.select(F.col("id").alias("target"), F.col("community").alias("cb"))
    both = graph.edges.join(a, "source").join(b, "target").where("ca != cb")
    ways = F.explode(F.array(F.struct(F.col("ca").alias("community"), F.col("cb").alias("other")), F.struct(F.col("cb").alias("community"), F.col("ca").alias("other"))))
    return both.select(ways.alias("x")).groupBy("x.community", "x.other").agg(F.count("*").alias("links"))


def source_files(graph: Graph, label: str, most: int = 10) -> DataFrame:
    """id, source_file of the first matches of the label: their own file, else the first of a neighbour's."""
    hit = graph.nodes.where(F.lower("label").contains(label.lower())).orderBy("ord").limit(most).select("id", F.nullif("source_file", F.lit("")).alias("own"))
    files = graph.nodes.where("source_file != ''").select(F.col("id").alias("to"), F.col("source_file").alias("near"))
    near = graph.steps().join(F.broadcast(hit.select(F.col("id").alias("at"))), "at", "left_semi").join(files, "to").groupBy(F.col("at").alias("id")).agg(F.min("near").alias("near"))
    return hit.join(near, "id", "left").select("id", F.coalesce("own", "near").alias("source_file"))


def section_overview(graph: Graph, most: int = 12) -> DataFrame:
    """community, other, links, relation: edges between communities with their most frequent relation; the strongest first."""
    own = graph.nodes.where("community is not null").select("id", "community")
    a = own.select(F.col("id").alias("source"), F.col("community").alias("community"))
    b = own.select(F.col("id").alias("target"), F.col("community").alias("other"))
    n = graph.edges.join(a, "source").join(b, "target").where("community != other").groupBy("community", "other", "relation").agg(F.count("*").alias("n"))
    pairs = n.groupBy("community", "other").agg(F.sum("n").alias("links"), F.max_by("relation", F.struct("n", "relation")).alias("relation"))
    return pairs.orderBy(F.desc("links"), "community", "other").limit(most)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")
