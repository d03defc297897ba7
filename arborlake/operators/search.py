"""Lexical, BM25 and vector ranking of nodes and documents, and their fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.functions import paths, text
from arborlake.functions.vectors import cosine
from arborlake.graph import Graph
from arborlake.storage import written

# BM25 and reciprocal rank fusion.
K1, B, RRF = 1.2, 0.75, 60


def lexical_scores(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """id, score above 0: for each term 1000, 100 or 1 times its weight where the label is it, begins with it or holds it, and 0.5 where the file's path holds it.

    weight = ln(1 + N / (1 + df)), df: labels that hold the term. terms: those of a query, a few, so they are columns.
    """
    label = F.lower("label")
    stats = nodes.agg(F.count("*").alias("n"), *[F.count_if(label.contains(t)).alias(f"d{i}") for i, t in enumerate(terms)])
    rows = nodes.select("id", label.alias("label"), text.bare_label(F.col("label")).alias("bare"), F.lower("source_file").alias("file")).join(F.broadcast(stats))
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        w = F.log(1 + F.col("n") / (1 + F.col(f"d{i}")))
        own = F.when((F.col("label") == t) | (F.col("bare") == t), 1000 * w).when(F.col("label").startswith(t) | F.col("bare").startswith(t), 100 * w).when(F.col("label").contains(t), w).otherwise(0.0)
        score = score + own + F.when(F.col("file").contains(t), 0.5 * w).otherwise(0.0)
    return rows.select("id", F.round(score, 8).alias("score")).where("score > 0")


def postings(docs: DataFrame, id_: str = "id", body: str = "text") -> DataFrame:
    """id, term, tf, dl of documents."""
    words = docs.select(F.col(id_).alias("id"), text.search_tokens(F.col(body)).alias("words"))
    exploded = words.select("id", F.size("words").alias("dl"), F.explode("words").alias("term"))
    return exploded.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def node_texts(graph: Graph) -> DataFrame:
    """id, text: label, docstring, file and the labels of children through method and contains."""
    children = graph.edges.where(F.col("relation").isin("method", "contains")).join(graph.nodes.select(F.col("id").alias("target"), F.col("label").alias("child")), "target")
    lists = children.groupBy(F.col("source").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("child")), " ").alias("children"))
    doc = F.col("docstring") if "docstring" in graph.nodes.columns else F.lit(None).cast("string")
    return graph.nodes.join(lists, "id", "left").select("id", F.concat_ws(" ", "label", doc, "source_file", "children").alias("text"))


def bm25(docs: DataFrame, terms: list[str], id_: str = "id", body: str = "text") -> DataFrame:
    """id, score above 0 for the query terms; a term given twice counts twice. Only the terms' postings are made.

    idf = max(0, ln((N - df + 0.5) / (df + 0.5) + 1)); average length over all documents.
    """
    words = docs.select(F.col(id_).alias("id"), text.search_tokens(F.col(body)).alias("words"))
    weights = {t: terms.count(t) for t in terms}
    count = lambda term: F.size(F.filter("words", lambda w: w == term))
    counted = words.select("id", F.size("words").alias("dl"), *[count(t).alias(f"tf{i}") for i, t in enumerate(weights)])
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(weights))])
    rows = counted.join(F.broadcast(stats))
    score = F.lit(0.0)
    for i, times in enumerate(weights.values()):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.lit(0.0), F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1))
        score = score + times * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.select("id", F.round(score, 8).alias("score")).where("score > 0")


def dense(vectors: DataFrame, query: list[float], id_: str = "id", vector: str = "vector") -> DataFrame:
    """id, score: cosine with the query."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id_).alias("id"), F.round(cosine(F.col(vector), q), 8).alias("score"))


def ranked(scores: DataFrame, most: int | None = None) -> DataFrame:
    """id, place from 0 by descending score, ties by id. With ``most`` the list is cut before it is numbered; whole lists are numbered range by range."""
    order = [F.desc("score"), F.col("id")]
    if most:
        scores = scores.orderBy(*order).limit(most)
        return scores.select("id", (F.row_number().over(Window.orderBy(*order)) - 1).alias("place"))
    dealt = written(scores.select("id", "score").repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return dealt.withColumn("inside", inside).join(before, "range").select("id", (F.col("before") + F.col("inside")).alias("place"))


def fused(*lists: DataFrame, most: int | None = None) -> DataFrame:
    """id, score: the sum of 1 / (60 + place + 1) over the whole lists, or over their first ``most`` places."""
    rows = [ranked(x, most) for x in lists]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every.groupBy("id").agg(F.round(F.sum(1.0 / (RRF + F.col("place") + 1)), 10).alias("score"))


def adjusted(scores: DataFrame, nodes: DataFrame, terms: list[str]) -> DataFrame:
    """id, score: less for tests and examples, more for labels that are or hold a term, halved for each earlier node of the same file."""
    label = text.bare_label(F.col("label"))
    is_term, holds = F.lit(False), F.lit(False)
    for t in terms:
        is_term, holds = is_term | (label == t), holds | label.contains(t)
    earlier = F.row_number().over(Window.partitionBy("source_file").orderBy(F.desc("score"), "id")) - 1
    rows = scores.join(nodes.select("id", "label", "source_file"), "id").withColumn("earlier", earlier)
    factor = F.when(paths.is_test_or_example(F.col("source_file")), 0.05).otherwise(1.0) * F.when(is_term, 3.0).when(holds, 1.5).otherwise(1.0) * F.pow(F.lit(0.5), F.col("earlier"))
    return rows.select("id", F.round(F.col("score") * factor, 10).alias("score"))


def seeds(scores: DataFrame, most: int = 3, ratio: float = 0.2) -> DataFrame:
    """id, score, place: the best ``most``, up to the first below ``ratio`` of the top score."""
    best = scores.orderBy(F.desc("score"), "id").limit(most)
    order = Window.orderBy(F.desc("score"), "id")
    rows = best.select("id", "score", (F.row_number().over(order) - 1).alias("place"), F.first("score").over(order).alias("top"))
    return rows.where((F.col("place") == 0) | (F.col("score") >= F.col("top") * ratio)).drop("top")


def hybrid(graph: Graph, terms: list[str], vectors: DataFrame | None = None, query_vector: list[float] | None = None, symbol: bool = False, top: int = 3, ratio: float = 0.2) -> DataFrame:
    """Seeds by BM25 (twice for symbol queries) and cosine, fused, adjusted and cut."""
    lists = [bm25(node_texts(graph), terms)]
    if symbol:
        lists.append(lists[0])
    if vectors is not None and query_vector is not None:
        lists.append(dense(vectors, query_vector))
    return seeds(adjusted(fused(*lists), graph.nodes, terms), top, ratio)


def found_by_tier(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """id, label, tier: exact label, bare label or id (0), then label prefixes (1), then labels that hold the query (2)."""
    q = query.lower()
    tier = F.when((F.lower("label") == q) | (text.bare_label(F.col("label")) == q) | (F.lower("id") == q), 0).when(F.lower("label").startswith(q), 1).when(F.lower("label").contains(q), 2)
    return nodes.withColumn("tier", tier).where("tier is not null").orderBy("tier", "ord").limit(limit).select("id", "label", "tier")


def found_by_label(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """id, label, tier: exact labels by ord, then labels that hold the query, the shortest first."""
    q = query.lower()
    tier = F.when(F.lower("label") == q, 0).when(F.lower("label").contains(q), 1)
    found = nodes.withColumn("tier", tier).where("tier is not null").orderBy("tier", F.when(F.col("tier") == 1, F.length("label")).otherwise(0), "ord").limit(limit)
    return found.select("id", "label", "tier")


def store_search(nodes: DataFrame, query_tokens: list[str], limit: int = 10) -> DataFrame:
    """id, score: one for each hit of a token among the tokens of label and id, both counted."""
    tokens = F.concat(text.store_tokens(F.col("label")), text.store_tokens(F.col("id")))
    rows = nodes.select("id", F.explode(tokens).alias("token")).where(F.col("token").isin(query_tokens))
    return rows.groupBy("id").agg(F.count("*").cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def resolved_seed(nodes: DataFrame, name: str) -> DataFrame:
    """One row, id: the id itself, else the only node of that label, of that file, or whose label holds the name; else null."""
    n = name.lower()

    def only(condition: Column) -> Column:
        return F.when(F.count_if(condition) == 1, F.min(F.when(condition, F.col("id"))))

    own = F.min(F.when(F.col("id") == name, F.col("id")))
    return nodes.agg(F.coalesce(own, only(F.lower("label") == n), only(F.lower("source_file") == n), only(F.lower("label").contains(n))).alias("id"))
