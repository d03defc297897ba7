"""Graphs written as text: every format is a DataFrame (path, part, place, text) of lines that tasks make on their own.

``write`` puts lines in order into one file for each path, part by part; nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.functions import text
from arborlake.graph import Graph
from arborlake.operators import aggregates, filters, joins


def _part(df: DataFrame, path: Column | str, part: int, place: Column, line: Column) -> DataFrame:
    return df.select((F.lit(path) if isinstance(path, str) else path).alias("path"), F.lit(part).alias("part"), place.cast("string").alias("place"), line.alias("text"))


def _constant(graph: Graph, path: str, part: int, *rows: str) -> DataFrame:
    return graph.nodes.sparkSession.createDataFrame([(path, part, f"{i:04d}", r) for i, r in enumerate(rows)], "path string, part int, place string, text string")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write(lines: DataFrame, folder: str) -> None:
    """One folder for each path, with its lines in order over the part files that Spark writes."""
    lines.repartitionByRange("path", "part", "place").sortWithinPartitions("path", "part", "place").select("path", F.col("text").alias("value")).write.partitionBy("path").mode("overwrite").text(folder)


def node_link(graph: Graph, path: str = "graph.json", keep_context: bool = True) -> DataFrame:
    """Node-link JSON with metadata flattened into the nodes and the confidence as a number beside its name."""
    meta = F.col("metadata") if "metadata" in graph.nodes.columns else F.create_map().cast("map<string,string>")
    own = F.create_map(*[x for c in ("id", "label", "file_type", "source_file") for x in (F.lit(c), F.coalesce(F.col(c), F.lit("")))], F.lit("community"), F.coalesce(F.col("community").cast("string"), F.lit("")))
    n = F.to_json(F.map_concat(F.map_filter(F.coalesce(meta, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("id", "label", "file_type", "source_file", "community")), own))
    context = [F.col("context")] if keep_context else []
    e = F.to_json(F.struct("source", "target", "relation", "confidence", text.confidence_score(F.col("confidence")).alias("confidence_score"), "weight", *context))
    comma = lambda c: F.concat(F.lit(","), c)
    return _all([
        _constant(graph, path, 0, '{"directed":true,"multigraph":false,"graph":{},"nodes":[null'), _part(graph.nodes, path, 1, F.col("id"), comma(n)), _constant(graph, path, 2, '],"links":[null'),
        _part(graph.edges, path, 3, F.concat_ws("\x00", "source", "target", "relation"), comma(e)), _constant(graph, path, 4, "]}"),
    ])


def cypher(graph: Graph, path: str = "graph.cypher") -> DataFrame:
    quoted = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("'"), F.lit("\\'"))
    n = F.concat(F.lit("CREATE (:Node {id: '"), quoted(F.col("id")), F.lit("', label: '"), quoted(F.col("label")), F.lit("', file_type: '"), quoted(F.col("file_type")), F.lit("'});"))
    relation = F.upper(F.regexp_replace("relation", r"[^A-Za-z0-9_]", "_"))
    e = F.concat(F.lit("MATCH (a:Node {id: '"), quoted(F.col("source")), F.lit("'}), (b:Node {id: '"), quoted(F.col("target")), F.lit("'}) CREATE (a)-[:"), relation, F.lit("]->(b);"))
    return _part(graph.nodes, path, 0, F.col("id"), n).unionByName(_part(graph.edges, path, 1, F.concat_ws("\x00", "source", "target", "relation"), e))


def graphml(graph: Graph, path: str = "graph.graphml") -> DataFrame:
    x = lambda c: text.html_escaped(F.coalesce(F.col(c), F.lit("")))
    n = F.concat(F.lit('<node id="'), x("id"), F.lit('"><data key="label">'), x("label"), F.lit('</data><data key="file_type">'), x("file_type"), F.lit("</data></node>"))
    e = F.concat(F.lit('<edge source="'), x("source"), F.lit('" target="'), x("target"), F.lit('"><data key="relation">'), x("relation"), F.lit("</data></edge>"))
    keys = [f'<key id="{k}" for="{w}" attr.name="{k}" attr.type="string"/>' for k, w in (("label", "node"), ("file_type", "node"), ("relation", "edge"))]
    return _all([
        _constant(graph, path, 0, '<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '<graph edgedefault="directed">'),
        _part(graph.nodes, path, 1, F.col("id"), n), _part(graph.edges, path, 2, F.concat_ws("\x00", "source", "target", "relation"), e), _constant(graph, path, 3, "</graph>", "</graphml>"),
    ])


def svg(graph: Graph, path: str = "graph.svg", size: int = 800, most: int = 2000) -> DataFrame:
    """The ``most`` most connected nodes on a circle with four letters each, and the edges between them."""
    top = graph.nodes.join(filters.degrees(graph), "id", "left").orderBy(F.desc_nulls_last("degree"), "ord").limit(most)
    turn = 2 * F.pi() * (F.row_number().over(Window.orderBy("id")) - 1) / F.count("*").over(Window.partitionBy())
    at = top.select("id", "label", F.round(size / 2 + size * 0.45 * F.cos(turn), 2).alias("x"), F.round(size / 2 + size * 0.45 * F.sin(turn), 2).alias("y"))
    n = F.format_string('<circle cx="%s" cy="%s" r="4"/><text x="%s" y="%s" font-size="8">%s</text>', F.col("x").cast("string"), F.col("y").cast("string"), F.col("x").cast("string"), F.col("y").cast("string"), text.html_escaped(F.substring("label", 1, 4)))
    ends = graph.edges.join(at.select(F.col("id").alias("source"), F.col("x").alias("ax"), F.col("y").alias("ay")), "source").join(at.select(F.col("id").alias("target"), F.col("x").alias("bx"), F.col("y").alias("by")), "target")
    e = F.format_string('<line x1="%s" y1="%s" x2="%s" y2="%s" stroke="#999"/>', *[F.col(c).cast("string") for c in ("ax", "ay", "bx", "by")])
    return _all([_constant(graph, path, 0, f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}">'), _part(ends, path, 1, F.concat_ws("\x00", "source", "target", "relation"), e), _part(at, path, 2, F.col("id"), n), _constant(graph, path, 3, "</svg>")])


def html_list(graph: Graph, path: str = "graph.html") -> DataFrame:
    n = F.concat(F.lit("<li>"), text.html_escaped(F.coalesce("label", F.lit(""))), F.lit(" ("), F.coalesce("file_type", F.lit("")), F.lit(")</li>"))
    return _all([_constant(graph, path, 0, "<!DOCTYPE html>", "<html><body><ul>"), _part(graph.nodes, path, 1, F.col("id"), n), _constant(graph, path, 2, "</ul></body></html>")])


def community_names(nodes: DataFrame) -> DataFrame:
    """community, name, file: a unique file name for each community, from its first labels."""
    labels = aggregates.top_labels(nodes, 1).select("community", F.coalesce(F.nullif("labels", F.lit("")), F.concat(F.lit("Community "), F.col("community").cast("string"))).alias("name"))
    slug = text.wiki_file_name(F.col("name"))
    place = F.row_number().over(Window.partitionBy(slug).orderBy("community"))
    return labels.withColumn("file", F.concat(F.when(place == 1, slug).otherwise(F.concat(slug, F.lit("_"), place.cast("string"))), F.lit(".md")))


def wiki(graph: Graph, members: int = 25) -> DataFrame:
    """index.md and an article for each community: its most connected members, links to others, how sure its edges are, its files."""
    names = community_names(graph.nodes)
    own = graph.nodes.where("community is not null").join(names, "community")
    degree = own.join(filters.degrees(graph), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "ord"))
    top = degree.withColumn("p", place).where(F.col("p") <= members)
    size = own.groupBy("community", "name", "file").agg(F.count("*").alias("n"))
    links = joins.cross_community(graph).join(names.select("community", "file"), "community").join(names.select(F.col("community").alias("other"), F.col("name").alias("other_name")), "other")
    links = links.withColumn("p", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("links"), "other"))).where("p <= 12")
    inner = graph.edges.join(own.select(F.col("id").alias("source"), "community", "file"), "source").groupBy("community", "file", "confidence").agg(F.count("*").alias("n"))
    share = inner.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("community")), 1))
    files = own.where("source_file != ''").groupBy("community", "file", "source_file").agg(F.count("*").alias("n")).withColumn("p", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "source_file"))).where("p <= 20")
    number = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    f = F.col("file")
    return _all([
        _constant(graph, "index.md", 0, "# Communities", ""), _part(size, "index.md", 1, F.lpad((10**11 - F.col("n")).cast("string"), 12, "0"), F.concat(F.lit("- [["), F.regexp_replace("file", r"\.md$", ""), F.lit("]] ("), F.col("n").cast("string"), F.lit(")"))),
        _part(size, f, 0, F.lit("0"), F.concat(F.lit("# "), F.col("name"), F.lit("\n\n"), F.col("n").cast("string"), F.lit(" nodes\n\n## Members"))), _part(top, f, 1, number("p"), F.concat(F.lit("- "), F.col("label"), F.lit(" ("), F.col("degree").cast("string"), F.lit(")"))),
        _part(links, f, 2, number("p"), F.concat(F.lit("- linked to "), F.col("other_name"), F.lit(": "), F.col("links").cast("string"))), _part(share, f, 3, F.col("confidence"), F.concat(F.lit("- "), F.col("confidence"), F.lit(": "), F.col("percent").cast("string"), F.lit("%"))),
        _part(files, f, 4, number("p"), F.concat(F.lit("- file "), F.col("source_file"))),
    ])


def god_article(graph: Graph, node: str, most: int = 20) -> DataFrame:
    """The neighbours of a node by relation, the most connected first."""
    near = joins.neighbours(graph, node).join(filters.degrees(graph), "id")
    rows = near.withColumn("p", F.row_number().over(Window.partitionBy("relation").orderBy(F.desc("degree"), "id"))).where(F.col("p") <= most)
    return _part(rows, text.wiki_file_name(F.lit(node)), 0, F.concat_ws(" ", "relation", F.lpad(F.col("p").cast("string"), 4, "0")), F.concat(F.lit("- "), F.col("relation"), F.lit(" "), F.col("label"), F.lit(" ("), F.col("degree").cast("string"), F.lit(")")))


def report(graph: Graph, path: str = "report.md") -> DataFrame:
    """Counts, how sure the edges are, hubs, communities, and nodes that nothing is known about."""
    total = graph.edges.count()
    shares = graph.edges.groupBy("confidence").agg(F.count("*").alias("n"))
    gods = aggregates.god_nodes(graph, 10).withColumn("p", F.row_number().over(Window.orderBy(F.desc("degree"), "id")))
    cohesion = aggregates.cohesion(graph)
    alone = graph.nodes.join(filters.degrees(graph), "id", "left_anti").orderBy("ord").limit(20)
    unsure = graph.edges.where("confidence = 'AMBIGUOUS'").orderBy("source", "target").limit(20)
    s = lambda c: F.col(c).cast("string")
    return _all([
        _constant(graph, path, 0, "# Graph report", "", f"{graph.nodes.count()} nodes, {total} edges", "", "## Confidence"), _part(shares, path, 1, F.col("confidence"), F.concat(F.lit("- "), F.col("confidence"), F.lit(": "), F.round(100 * F.col("n") / max(1, total), 1).cast("string"), F.lit("%"))),
        _constant(graph, path, 2, "", "## God nodes"), _part(gods, path, 3, F.lpad(s("p"), 4, "0"), F.concat(F.lit("- "), F.col("label"), F.lit(" ("), s("degree"), F.lit(")"))),
        _constant(graph, path, 4, "", "## Communities"), _part(cohesion, path, 5, F.lpad(s("community"), 12, "0"), F.concat(F.lit("- "), s("community"), F.lit(": "), s("size"), F.lit(" nodes, cohesion "), s("cohesion"))),
        _constant(graph, path, 6, "", "## Ambiguous edges"), _part(unsure, path, 7, F.concat_ws(" ", "source", "target"), F.concat(F.lit("- "), F.col("source"), F.lit(" -> "), F.col("target"))),
        _constant(graph, path, 8, "", "## Knowledge gaps"), _part(alone, path, 9, F.col("id"), F.concat(F.lit("- "), F.col("label"))),
    ])


def flowchart(graph: Graph, community: int, most_nodes: int = 40, most_edges: int = 60, path: str = "flow.mmd") -> DataFrame:
    """A community's first nodes and the best edges between them as a Mermaid flowchart."""
    nodes = filters.community_members(graph.nodes, community, 0, most_nodes)
    inner = filters.induced(graph, nodes).edges
    best = inner.withColumn("s", text.edge_score(F.col("confidence"), F.col("relation"))).orderBy(F.desc("s"), "source", "target").limit(most_edges)
    name = lambda c: text.stable_id(F.col(c))
    n = F.concat(F.lit("  "), name("id"), F.lit('["'), text.mermaid(F.col("label")), F.lit('"]'))
    e = F.concat(F.lit("  "), name("source"), F.lit(" -->|"), text.mermaid(F.col("relation")), F.lit("| "), name("target"))
    return _all([_constant(graph, path, 0, "flowchart LR"), _part(nodes, path, 1, F.col("id"), n), _part(best, path, 2, F.concat_ws(" ", F.format_string("%08.2f", 100 - F.col("s")), "source", "target"), e)])


def tree(nodes: DataFrame, most: int = 50) -> DataFrame:
    """folder, depth, name, kind, total: folders with their node counts, and each file's first symbols, private ones last, the rest as (+n more)."""
    folders = aggregates.directory_rollup(nodes.where("source_file != ''").select(F.col("source_file").alias("path"), F.lit(1).alias("n")))
    rows = folders.select("folder", "depth", F.element_at(F.split("folder", "/"), -1).alias("name"), F.lit("folder").alias("kind"), "total")
    p = F.row_number().over(Window.partitionBy("source_file").orderBy(F.col("label").startswith("_"), "label", "id"))
    n = F.count("*").over(Window.partitionBy("source_file"))
    leaf = nodes.where("source_file != ''").select(F.col("source_file").alias("folder"), (F.size(F.split("source_file", "/")) + 1).alias("depth"), "label", p.alias("p"), n.alias("n"))
    shown = leaf.where(F.col("p") <= most).select("folder", "depth", F.col("label").alias("name"), F.lit("symbol").alias("kind"), F.lit(1).cast("long").alias("total"))
    more = leaf.where((F.col("p") == 1) & (F.col("n") > most)).select("folder", "depth", F.concat(F.lit("(+"), (F.col("n") - most).cast("string"), F.lit(" more)")).alias("name"), F.lit("more").alias("kind"), (F.col("n") - most).alias("total"))
    return rows.unionByName(shown).unionByName(more)


def hyperedge_lines(hyperedges: DataFrame) -> DataFrame:
    return hyperedges.select(F.concat(F.lit("- "), F.coalesce("label", "id"), F.lit(": "), F.array_join("nodes", ", "), F.lit(" ["), F.coalesce("confidence", F.lit("")), F.lit("]")).alias("text"))


def note(question: str, answer: str, sources: DataFrame, path: str = "note.md") -> DataFrame:
    """A question, its answer and the nodes that it rests on."""
    spark = sources.sparkSession
    head = spark.createDataFrame([(path, 0, "0", f"# {question}\n\n{answer}\n\n## Sources")], "path string, part int, place string, text string")
    return head.unionByName(_part(sources, path, 1, F.col("id"), F.concat(F.lit("- "), F.col("id"))))
