"""Graphs as JSON files: tolerant reading, manifests, the merged graph of several repositories, symbol indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlake.functions import text
from arborlake.graph import Graph
from arborlake.operators import filters, joins, sets

ITEM = "map<string,string>"


def _first(row: Column, names: list[str]) -> Column:
    """The first of several keys that has a value that is not empty."""
    return F.coalesce(*[F.nullif(row[n], F.lit("")) for n in names])


def _items(document: Column, names: list[str]) -> Column:
    """The array of objects under the first of several keys, as maps of text; items that are no objects are left out."""
    lists = [F.from_json(F.get_json_object(document, f"$.{n}"), "array<string>") for n in names]
    return F.filter(F.transform(F.coalesce(*lists, F.array().cast("array<string>")), lambda x: F.from_json(x, ITEM)), lambda x: x.isNotNull())


def read_node_link(spark: SparkSession, path: str, directed: bool | None = None, confidence: str = "EXTRACTED", prefer: str = "links") -> Graph:
    """A node-link file: links or edges, other names of keys, missing fields with defaults; without a flag it is undirected."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("document"))
    keys = ["links", "edges"] if prefer == "links" else ["edges", "links"]
    n = whole.select(F.posexplode(_items(F.col("document"), ["nodes"])).alias("ord", "n"))
    ids = _first(F.col("n"), ["id", "node_id", "key", "name"])
    nodes = n.select(
        ids.alias("id"), F.coalesce(_first(F.col("n"), ["label", "name", "title"]), ids).alias("label"), F.coalesce(_first(F.col("n"), ["file_type", "type", "kind"]), F.lit("code")).alias("file_type"),
        F.coalesce(_first(F.col("n"), ["source_file", "file", "path"]), F.lit("")).alias("source_file"), F.col("n")["source_location"].alias("source_location"), F.col("n")["community"].try_cast("long").alias("community"),
        F.col("n")["rationale"].alias("rationale"), F.col("n")["docstring"].alias("docstring"), F.col("n").alias("metadata"), F.col("ord").cast("long").alias("ord"),
    ).where("id is not null")
    e = whole.select(F.posexplode(_items(F.col("document"), keys)).alias("ord", "e"))
    end = lambda names: F.coalesce(F.get_json_object(_first(F.col("e"), names), "$.id"), _first(F.col("e"), names))
    edges = e.select(
        end(["source", "from", "src"]).alias("source"), end(["target", "to", "dst"]).alias("target"), F.coalesce(_first(F.col("e"), ["relation", "type", "label"]), F.lit("related_to")).alias("relation"),
        F.coalesce(F.col("e")["confidence"], F.lit(confidence)).alias("confidence"), F.col("e")["source_file"].alias("source_file"), F.coalesce(F.col("e")["weight"].try_cast("double"), F.lit(1.0)).alias("weight"),
        F.nullif(F.col("e")["context"], F.lit("")).alias("context"), F.col("ord").cast("long").alias("ord"),
    ).where("source is not null and target is not null")
    if directed is None:
        flag = whole.select(F.get_json_object("document", "$.directed").alias("d")).first()
        directed = bool(flag and flag["d"] == "true")
    return Graph(nodes, edges, directed)


def read_hyperedges(spark: SparkSession, path: str) -> DataFrame:
    """id, label, nodes, relation, confidence, confidence_score, source_file."""
    whole = spark.read.text(path, wholetext=True)
    h = whole.select(F.explode(_items(F.col("value"), ["hyperedges"])).alias("h"))
    members = F.from_json(F.coalesce(F.col("h")["nodes"], F.col("h")["members"]), "array<string>")
    return h.select(
        F.col("h")["id"].alias("id"), F.col("h")["label"].alias("label"), members.alias("nodes"), F.col("h")["relation"].alias("relation"),
        F.col("h")["confidence"].alias("confidence"), F.col("h")["confidence_score"].try_cast("double").alias("confidence_score"), F.col("h")["source_file"].alias("source_file"),
    ).where("id is not null")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """tag, added_at, source_path, node_count, edge_count, source_hash; no rows if there is no file or it cannot be read."""
    schema = "tag string, added_at string, source_path string, node_count long, edge_count long, source_hash string"
    try:
        return spark.read.schema(schema).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def add_to_merged(merged: Graph, new: Graph, tag: str, manifest: DataFrame, source_hash: str, force: bool = False) -> tuple[Graph, bool]:
    """The merged graph with a repository's rows replaced; nothing changes if the manifest has the hash already."""
    if not force and not manifest.where((F.col("tag") == tag) & (F.col("source_hash") == source_hash)).isEmpty():
        return merged, False
    rest = filters.without_repo(merged, tag)
    return sets.concatenated(rest, joins.without_known_stubs(sets.prefixed(new, tag), rest)), True


def graph_hash(graph: Graph) -> DataFrame:
    """One row, hash: of all nodes and edges whatever their order."""
    n = graph.nodes.select(F.xxhash64("id", "label", "file_type", "source_file").alias("h"))
    e = graph.edges.select(F.xxhash64("source", "target", "relation").alias("h"))
    return n.union(e).agg(F.sha2(F.concat_ws(":", F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")), 256).alias("hash"))


def symbol_index(occurrences: DataFrame, relationships: DataFrame) -> Graph:
    """Nodes and edges of a symbol index. occurrences: file, symbol, display_name, kind, line; relationships: file, symbol, target, is_implementation, is_type_definition, is_definition, is_reference.

    Targets are found in the same file first, then anywhere if there is one only; others become stub nodes of no file.
    """
    suffix = lambda c: F.regexp_replace(F.element_at(F.split(c, "[#/.]"), -1), r"[^A-Za-z0-9_]", "")
    one = joins.first_by(occurrences, ["file", "symbol"], [F.col("line")])
    node_id = text.symbol_node_id(suffix(F.col("symbol")), F.col("file"), F.col("symbol"))
    own = one.select("file", "symbol", node_id.alias("id"), F.coalesce(F.nullif("display_name", F.lit("")), F.nullif(suffix(F.col("symbol")), F.lit("")), "symbol").alias("label"), "kind", "line")
    relation = F.expr("case when is_implementation then 'scip_impl' when is_type_definition then 'scip_typed' when is_definition then 'scip_def' when is_reference then 'scip_ref' end")
    wanted = relationships.select("file", "symbol", "target", relation.alias("relation")).where("relation is not null")
    found = joins.unique_or_local(wanted.select("file", F.col("target").alias("symbol")).distinct(), own).select("file", F.col("symbol").alias("target"), F.col("id").alias("found"))
    stub = text.symbol_node_id(suffix(F.col("target")), F.lit(""), F.col("target"))
    rows = wanted.join(own.select("file", "symbol", F.col("id").alias("source")), ["file", "symbol"]).join(found, ["file", "target"], "left")
    rows = rows.select("source", F.coalesce("found", stub).alias("to"), "relation", F.col("found").isNull().alias("is_stub"), F.col("target").alias("symbol"), "file")
    stubs = rows.where("is_stub").select(F.col("to").alias("id"), F.col("symbol").alias("label"), F.lit("code").alias("file_type"), F.lit("").alias("source_file"), F.lit(None).cast("string").alias("source_location")).distinct()
    nodes = own.select("id", "label", F.lit("code").alias("file_type"), F.col("file").alias("source_file"), F.concat(F.lit("L"), F.col("line") + 1).alias("source_location")).unionByName(stubs)
    nodes = nodes.withColumns({"community": F.lit(None).cast("long"), "ord": F.xxhash64("id")})
    edges = rows.select("source", F.col("to").alias("target"), "relation", F.lit("EXTRACTED").alias("confidence"), F.col("file").alias("source_file"), F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("context"), F.lit(0).cast("long").alias("ord"))
    return Graph(nodes, sets.distinct_edges(edges), True)


def web_pages(pages: DataFrame) -> DataFrame:
    """url, kind, name, markdown: pages (url, html) as documents with a front matter."""
    from arborlake.functions import paths

    head = F.concat(F.lit('---\nsource_url: "'), text.yaml_escaped(F.col("url")), F.lit('"\ntitle: "'), text.yaml_escaped(text.html_title(F.col("html"))), F.lit('"\n---\n\n'))
    rows = pages.where(paths.is_public_url(F.col("url"))).select("url", paths.url_kind(F.col("url")).alias("kind"), paths.safe_file_name(F.col("url"), ".md").alias("base"), F.concat(head, text.html_text(F.col("html"))).alias("markdown"))
    place = F.row_number().over(Window.partitionBy("base").orderBy("url"))
    unique = F.when(place == 1, F.col("base")).otherwise(F.concat(F.regexp_replace("base", r"\.md$", ""), F.lit("_"), place.cast("string"), F.lit(".md")))
    return rows.select("url", "kind", unique.alias("name"), "markdown")


def model_fragments(responses: DataFrame) -> DataFrame:
    """path, nodes, edges: what a language model answered as JSON, code fences removed; answers without either are left out. responses: path, answer."""
    clean = text.without_fences(F.col("answer"))
    nodes, edges = _items(clean, ["nodes"]), _items(clean, ["edges", "links"])
    mark = lambda items, more: F.transform(items, lambda x: F.map_concat(F.map_filter(x, lambda k, v: ~k.isin(*more)), F.create_map(*[F.lit(v) for kv in more.items() for v in kv])))
    rows = responses.select("path", mark(nodes, {"file_type": "llm"}).alias("nodes"), mark(edges, {"confidence": "high"}).alias("edges"))
    return rows.where((F.size("nodes") > 0) | (F.size("edges") > 0))
