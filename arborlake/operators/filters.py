"""Filters over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.graph import Graph

# Words in a question that hint at an edge context.
CONTEXT_HINTS = {
    "call": ["call", "calls", "called", "invoke", "invokes", "invoked"],
    "import": ["import", "imports", "imported", "module", "modules"],
    "field": ["field", "fields", "member", "members", "property", "properties"],
    "parameter_type": ["parameter", "parameters", "param", "params", "argument", "arguments"],
    "return_type": ["return", "returns", "returned"],
    "generic_arg": ["generic", "generics", "template", "templates"],
}
# Other names of a context in an explicit filter.
CONTEXT_ALIASES = {
    "parameter_type": ["param", "params", "parameter", "parameters", "argument", "arguments", "arg", "args"],
    "return_type": ["return", "returns", "returned"],
    "generic_arg": ["generic", "generics", "template", "templates"],
    "attribute": ["annotation", "annotations", "decorator", "decorators"],
    "call": ["calls", "called", "invoke", "invocation"],
    "field": ["fields", "property", "properties", "member", "members"],
    "import": ["imports", "imported", "module", "modules"],
    "export": ["exports", "exported"],
}
# Label endings of files.
FILE_ENDINGS = [".py", ".js", ".ts", ".rs", ".go", ".java", ".c", ".cpp", ".h"]
SOURCE_ENDINGS = [".py", ".js", ".ts", ".rs", ".go"]


def ends_with_any(column: Column, endings: list[str]) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | column.endswith(e)
    return out


def search_nodes(nodes: DataFrame, text: str, fields: tuple[str, ...] = ("label",), limit: int | None = None) -> DataFrame:
    """Nodes for which a field, in small letters, holds the text; in order of ord."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.lower(f).contains(text.lower())
    found = nodes.where(hit).orderBy("ord")
    return found.limit(limit) if limit else found


def keyword_edges(edges: DataFrame, keywords: str, budget: int = 5) -> DataFrame:
    """Edges of which source, target or relation holds one of the words, case and all; the first by source, target, relation."""
    hit = F.lit(False)
    for word in keywords.split():
        for f in ("source", "target", "relation"):
            hit = hit | F.col(f).contains(word)
    return edges.where(hit).orderBy("source", "target", "relation").limit(budget)


def context_names(filters: list[str]) -> list[str]:
    """Trimmed small-letter names in order, aliases resolved, each once."""
    known = {alias: name for name, aliases in CONTEXT_ALIASES.items() for alias in aliases}
    names = [known.get(f.strip().lower(), f.strip().lower()) for f in filters]
    return list(dict.fromkeys(n for n in names if n))


def inferred_contexts(question: str) -> list[str]:
    words = set("".join(c if c.isalnum() or c == "_" else " " for c in question.lower()).split())
    return [name for name, hints in CONTEXT_HINTS.items() if words & set(hints)]


def resolved_contexts(question: str, explicit: list[str] | None = None) -> tuple[list[str], str]:
    """The contexts to keep and where they come from: explicit, heuristic or none."""
    if explicit and (names := context_names(explicit)):
        return names, "explicit"
    found = inferred_contexts(question)
    return found, "heuristic" if found else "none"


def with_contexts(graph: Graph, contexts: list[str]) -> Graph:
    """Only edges of the contexts; an edge without a context matches none; no contexts keep all."""
    return graph.with_edges(graph.edges.where(F.col("context").isin(contexts))) if contexts else graph


def with_contexts_undirected(graph: Graph, contexts: list[str]) -> Graph:
    """The same with one edge for each unordered pair."""
    kept = with_contexts(graph, contexts).edges
    return graph.with_edges(kept.withColumns({"u": F.least("source", "target"), "v": F.greatest("source", "target")}).dropDuplicates(["u", "v"]).drop("u", "v"))


def resolvable_symbols(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("file_type") == "code") & (F.length("label") > 0) & ~ends_with_any(F.col("label"), FILE_ENDINGS[:7]))


def report_files(nodes: DataFrame) -> DataFrame:
    """Nodes whose label ends with () or starts with a dot."""
    return nodes.where(F.col("label").endswith("()") | F.col("label").startswith("."))


def inferred_edges(edges: DataFrame, source_files_only: bool = False) -> DataFrame:
    found = edges.where(F.col("confidence") == "INFERRED")
    return found.where(F.col("source_file").isNull() | ends_with_any(F.col("source_file"), SOURCE_ENDINGS)) if source_files_only else found


def degrees(graph: Graph) -> DataFrame:
    """id, degree: both ends of every edge count, so a loop counts twice."""
    return graph.edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def without_hubs(graph: Graph, max_degree: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes that are no hubs, edges between them, and the hubs with their degree."""
    hubs = degrees(graph).where(F.col("degree") > max_degree)
    ids = hubs.select(F.col("id").alias("hub"))
    nodes = graph.nodes.join(ids, F.col("id") == F.col("hub"), "left_anti")
    edges = graph.edges.join(ids, F.col("source") == F.col("hub"), "left_anti").join(ids, F.col("target") == F.col("hub"), "left_anti")
    return nodes, edges, hubs


def without_cross_language(graph: Graph) -> DataFrame:
    """Edges less the inferred ones whose ends differ in file type or language."""
    from arborlake.functions.paths import language_by_ending

    ends = graph.nodes.select("id", "file_type", language_by_ending(F.col("source_file")).alias("language"))
    a = ends.select(F.col("id").alias("source"), F.col("file_type").alias("a_type"), F.col("language").alias("a_language"))
    b = ends.select(F.col("id").alias("target"), F.col("file_type").alias("b_type"), F.col("language").alias("b_language"))
    both = graph.edges.join(a, "source", "left").join(b, "target", "left")
    differ = (F.col("a_type") != F.col("b_type")) | (F.col("a_language") != F.col("b_language"))
    drop = (F.col("confidence") == "INFERRED") & F.coalesce(differ, F.lit(False))
    return both.where(~drop).select(*graph.edges.columns)


def without_repo(graph: Graph, tag: str) -> Graph:
    """The graph without nodes of the repository, by id prefix or metadata, and their edges."""
    mark = F.col("id").startswith(f"{tag}::")
    if "metadata" in graph.nodes.columns:
        mark = mark | F.coalesce(F.element_at("metadata", F.lit("repo")) == tag, F.lit(False))
    gone = graph.nodes.where(mark).select(F.col("id").alias("gone"))
    edges = graph.edges.join(gone, F.col("source") == F.col("gone"), "left_anti").join(gone, F.col("target") == F.col("gone"), "left_anti")
    return Graph(graph.nodes.where(~mark), edges, graph.directed)


def replace_sources(graph: Graph, files: DataFrame, nodes: DataFrame, edges: DataFrame) -> Graph:
    """Rows of some source files (column source_file) replaced by new ones."""
    names = files.select("source_file").distinct()
    return Graph(
        graph.nodes.join(names, "source_file", "left_anti").select(*graph.nodes.columns).unionByName(nodes),
        graph.edges.join(names, "source_file", "left_anti").select(*graph.edges.columns).unionByName(edges),
        graph.directed,
    )


def without_node(graph: Graph, node: str) -> Graph:
    """Edges of the node stay and dangle."""
    return Graph(graph.nodes.where(F.col("id") != node), graph.edges, graph.directed)


def without_edge(graph: Graph, source: str, target: str, relation: str) -> Graph:
    return graph.with_edges(graph.edges.where(~((F.col("source") == source) & (F.col("target") == target) & (F.col("relation") == relation))))


def induced(graph: Graph, ids: DataFrame) -> Graph:
    """Nodes of the ids and edges with both ends among them."""
    own = ids.select(F.col("id").alias("own")).distinct()
    edges = graph.edges.join(own, F.col("source") == F.col("own"), "left_semi").join(own, F.col("target") == F.col("own"), "left_semi")
    return Graph(graph.nodes.join(own, F.col("id") == F.col("own"), "left_semi"), edges, graph.directed)


def community_members(nodes: DataFrame, community: int, offset: int = 0, limit: int | None = None) -> DataFrame:
    found = nodes.where(F.col("community") == community).orderBy("ord").offset(offset)
    return found.limit(limit) if limit is not None else found


def semantic_edges(edges: DataFrame, least: float = 0.7) -> DataFrame:
    """Edges of similarity with a confidence of at least ``least``; a confidence that is no number counts as 1."""
    return edges.where((F.col("relation") == "semantically_similar_to") & (F.coalesce(F.col("confidence").try_cast("double"), F.lit(1.0)) >= least))
