"""Aggregations over graphs, documents and logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.functions import paths, text
from arborlake.graph import Graph
from arborlake.operators.filters import FILE_ENDINGS, degrees, ends_with_any
from arborlake.storage import measured, parts_for, shuffled

# Words in labels and files that raise a node's risk.
RISK_WORDS = "auth pay password token secret credit billing admin security encrypt hash key credential".split()


def god_nodes(graph: Graph, top: int = 10) -> DataFrame:
    """The most connected nodes, without files, bound methods and functions of degree one or less; ties by ord."""
    ranked = graph.nodes.join(degrees(graph), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    name = F.col("label")
    skip = ends_with_any(name, FILE_ENDINGS) | name.contains("().") | (name.startswith(".") & name.endswith("()")) | (name.endswith("()") & (F.col("degree") <= 1))
    return ranked.where(~skip).orderBy(F.desc("degree"), "ord").limit(top).select("id", "label", "degree")


def god_ids(graph: Graph, top: int = 10) -> DataFrame:
    """The ids of greatest degree, cut first and joined to nodes then; ties by id."""
    best = degrees(graph).orderBy(F.desc("degree"), "id").limit(top)
    return best.join(graph.nodes.select("id", "label"), "id").select("id", "label", "degree")


def god_nodes_all(graph: Graph, top: int = 10) -> DataFrame:
    """All nodes, those of degree 0 too; ties by id."""
    ranked = graph.nodes.join(degrees(graph), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return ranked.orderBy(F.desc("degree"), "id").limit(top).select("id", "label", "degree")


def counts(graph: Graph) -> DataFrame:
    """nodes, edges, communities."""
    n = graph.nodes.agg(F.count("*").alias("nodes"), F.countDistinct("community").alias("communities"))
    return n.join(F.broadcast(graph.edges.agg(F.count("*").alias("edges"))))


def counts_by(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.groupBy(key.cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "key", "n")


def detailed_stats(graph: Graph) -> DataFrame:
    """kind, key, n: nodes by file ending and by file type, edges by relation."""
    return counts_by(graph.nodes, paths.ending(F.col("source_file")), "ending").unionByName(counts_by(graph.nodes, F.col("file_type"), "file_type")).unionByName(counts_by(graph.edges, F.col("relation"), "relation"))


def language_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(paths.language_by_ending(F.col("source_file")).alias("language")).agg(F.count("*").alias("n"))


def communities(nodes: DataFrame) -> DataFrame:
    """community, members (ids in order of ord); nodes without one are left out."""
    return nodes.where("community is not null").groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("members"))


def cohesion(graph: Graph) -> DataFrame:
    """community, size, internal, cohesion: internal edges over possible pairs; 1 for single nodes; parallel edges count."""
    own = graph.nodes.where("community is not null").select("id", "community")
    size = own.groupBy("community").agg(F.count("*").alias("size"))
    a = own.select(F.col("id").alias("source"), F.col("community").alias("ca"))
    b = own.select(F.col("id").alias("target"), F.col("community").alias("cb"))
    internal = graph.edges.join(a, "source").join(b, "target").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("internal"))
    both = size.join(internal, "community", "left").withColumn("internal", F.coalesce("internal", F.lit(0)))
    value = F.when(F.col("size") <= 1, 1.0).otherwise(F.col("internal") / (F.col("size") * (F.col("size") - 1) / 2))
    return both.withColumn("cohesion", F.round(value, 8))


def module_summary(graph: Graph, top: int = 5) -> DataFrame:
    """kind, key, n: node and edge counts, the labels of greatest degree, the most frequent file types."""
    n = graph.nodes.agg(F.count("*").alias("n")).select(F.lit("count").alias("kind"), F.lit("nodes").alias("key"), "n")
    e = graph.edges.agg(F.count("*").alias("n")).select(F.lit("count").alias("kind"), F.lit("edges").alias("key"), "n")
    gods = god_nodes(graph, top).select(F.lit("god").alias("kind"), F.col("label").alias("key"), F.col("degree").alias("n"))
    types = counts_by(graph.nodes, F.col("file_type"), "file_type").orderBy(F.desc("n"), "key").limit(top)
    return n.unionByName(e).unionByName(gods).unionByName(types)


def smart_summary(graph: Graph, level: str = "architecture", budget: int = 20) -> DataFrame:
    """kind, key, n at one of three levels: detailed (the first nodes and edges), community (sizes), architecture (counts and gods)."""
    if level == "detailed":
        nodes = graph.nodes.orderBy("ord").limit(budget // 2).select(F.lit("node").alias("kind"), F.col("id").alias("key"), F.lit(1).cast("long").alias("n"))
        edges = graph.edges.orderBy("source", "target", "relation").limit(budget // 2)
        return nodes.unionByName(edges.select(F.lit("edge").alias("kind"), F.concat_ws("->", "source", "target").alias("key"), F.lit(1).cast("long").alias("n")))
    if level == "community":
        return counts_by(graph.nodes, F.col("community"), "community")
    return module_summary(graph)


def node_risk(graph: Graph) -> DataFrame:
    """id, hits, in_degree, untested, score, tier of every node.

    0.15 for each risk word in label and file, at most 0.4; 0.3 from ten incoming edges on, 0.15 from five; 0.2 if no
    neighbour lies in a file of tests; HIGH from 0.6, MEDIUM from 0.3.
    """
    hay = F.lower(F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("source_file", F.lit(""))))
    hits = F.lit(0)
    for word in RISK_WORDS:
        hits = hits + hay.contains(word).cast("int")
    tested = F.col("source_file").rlike("test|spec|Test").cast("int")
    own = graph.nodes.select("id", hits.alias("hits"), tested.alias("tested"))
    incoming = graph.edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("in_degree"))
    both = graph.edges.select(F.col("source").alias("id"), F.col("target").alias("other")).union(graph.edges.select("target", "source"))
    near = both.join(own.select(F.col("id").alias("other"), "tested"), "other").groupBy("id").agg(F.max("tested").alias("near_test"))
    joined = own.join(incoming, "id", "left").join(near, "id", "left")
    entries = F.coalesce("in_degree", F.lit(0))
    untested = F.coalesce("near_test", F.lit(0)) == 0
    score = F.least(F.lit(0.15) * F.col("hits"), F.lit(0.4)) + F.when(entries >= 10, 0.3).when(entries >= 5, 0.15).otherwise(0.0) + F.when(untested, 0.2).otherwise(0.0)
    rated = joined.select("id", "hits", entries.alias("in_degree"), untested.alias("untested"), F.round(F.least(score, F.lit(1.0)), 6).alias("score"))
    return rated.withColumn("tier", F.when(F.col("score") >= 0.6, "HIGH").when(F.col("score") >= 0.3, "MEDIUM").otherwise("LOW"))


def apply_risk(nodes: DataFrame, risk: DataFrame) -> DataFrame:
    """The score and tier of each node in its metadata."""
    rated = risk.select("id", F.create_map(F.lit("risk_score"), F.col("score").cast("string"), F.lit("risk_tier"), F.col("tier")).alias("risk"))
    known = F.coalesce("metadata", F.create_map().cast("map<string,string>")) if "metadata" in nodes.columns else F.create_map().cast("map<string,string>")
    return nodes.join(rated, "id", "left").withColumn("metadata", F.when(F.col("risk").isNull(), known).otherwise(F.map_concat(F.map_filter(known, lambda k, v: ~k.startswith("risk_")), "risk"))).drop("risk")


def churn_risk(graph: Graph, churn: DataFrame, bridges: DataFrame) -> DataFrame:
    """id, risk: commits that touch the file, times degree, times one more than the bridges of the node. churn: source_file, commits."""
    count = bridges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("bridges"))
    rows = graph.nodes.where("file_type = 'file'").join(churn, "source_file").join(degrees(graph), "id", "left").join(count, "id", "left")
    return rows.select("id", (F.col("commits") * F.coalesce("degree", F.lit(0)) * (1 + F.coalesce("bridges", F.lit(0)))).alias("risk"))


def edge_diagnostics(graph: Graph, each: int = 100_000) -> DataFrame:
    """One row: what is wrong or repeated among the edges, directed and undirected.

    Ends are looked up once each, edges only where some end is unknown. A pair and its reverse meet in one task, of
    about ``each`` edges up to 200 tasks.
    """
    e, seen = measured(graph.edges.select("source", "target", "relation"), "diagnosed", rows=F.count(F.lit(1)))
    parts = parts_for(seen["rows"], each)
    ends = e.repartition(parts, "source", "target").select(F.explode(F.array("source", "target")).alias("id"), F.lit(0).alias("known"))
    marks = ends.unionByName(graph.nodes.select("id", F.lit(1).alias("known"))).where("id != ''").groupBy("id").agg(F.max("known").alias("known"))
    unknown, found = measured(marks.where("known = 0").select("id"), "unknown", rows=F.count(F.lit(1)))
    lost = F.lit(False)
    if found["rows"]:
        for end in ("source", "target"):
            e = e.join(shuffled(unknown).select(F.col("id").alias(f"no_{end}")), F.col(end) == F.col(f"no_{end}"), "left")
        lost = F.col("no_source").isNotNull() | F.col("no_target").isNotNull()
    missing = F.col("source").isNull() | F.col("target").isNull() | (F.col("source") == "") | (F.col("target") == "")
    marked = e.select("source", "target", "relation", missing.alias("missing"), (~missing & lost).alias("dangling"), (~missing & ~lost).alias("valid"))
    own = marked.agg(
        F.count("*").alias("edges"), F.count_if("missing").alias("missing_ends"), F.count_if("dangling").alias("dangling"),
        F.count_if(F.col("valid") & (F.col("source") == F.col("target"))).alias("loops"), F.count_if("valid").alias("valid"),
    )
    ways = marked.where("valid").select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"), (F.col("source") > F.col("target")).alias("back"), "relation")
    kinds = ways.repartition(parts, "u", "v").groupBy("u", "v", "back", "relation").agg(F.count("*").alias("n"))
    told = F.col("relation").isNotNull()
    pairs = kinds.groupBy("u", "v").agg(
        F.sum("n").alias("n"), F.max((~F.col("back")).cast("int")).alias("there"), F.max(F.col("back").cast("int")).alias("back"),
        F.count_if(~F.col("back") & told).alias("a"), F.count_if(F.col("back") & told).alias("b"),
    )
    directed, variants = (F.col("there") + F.col("back")).cast("long"), ((F.col("a") > 1).cast("long") + (F.col("b") > 1).cast("long"))
    sums = pairs.agg(
        F.sum(directed).alias("pairs"), F.sum(F.col("n") - directed).alias("surplus"), F.sum(variants).alias("variants"),
        F.count("*").alias("undirected_pairs"), F.sum(F.col("n") - 1).alias("undirected_surplus"),
    )
    return own.join(F.broadcast(sums)).na.fill(0)


def variant_groups(edges: DataFrame, keys: list[str], field: str) -> DataFrame:
    """One row: how many groups have more than one value of the field."""
    return edges.groupBy(*keys).agg(F.countDistinct(field).alias("n")).agg(F.count_if(F.col("n") > 1).alias("groups"))


def diagnostics_report(graph: Graph) -> DataFrame:
    """line, text: the edge diagnostics as lines of a report, one for each figure, in their order."""
    found = edge_diagnostics(graph)
    lines = F.array(F.lit("edge diagnostics"), *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in found.columns])
    return found.select(F.posexplode(lines).alias("line", "text"))


def surplus(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows beyond the first of each group."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def tool_windows(log: DataFrame, now: Column) -> DataFrame:
    """One row: calls and saved tokens of the last day, the last week and all time. log: ts, tool, saved_chars."""
    age = now.cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")
    out = []
    for name, within in (("day", age <= 86400), ("week", age <= 7 * 86400), ("all", F.lit(True))):
        out += [F.count_if(within).alias(f"calls_{name}"), F.round(F.sum(F.when(within, F.col("saved_chars") / 4).otherwise(0.0)), 4).alias(f"saved_{name}")]
    return log.agg(*out)


def top_tools(log: DataFrame, top: int = 5) -> DataFrame:
    return log.groupBy("tool").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "tool").limit(top)


def usage_by_day(log: DataFrame) -> DataFrame:
    """day, tool, calls, errors, saved_chars."""
    return log.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "tool").agg(F.count("*").alias("calls"), F.count_if("error").alias("errors"), F.round(F.sum("saved_chars"), 4).alias("saved_chars"))


def token_reduction(corpus_words: DataFrame, questions: DataFrame) -> DataFrame:
    """corpus_tokens, query_tokens, ratio. corpus_words: words; questions: tokens, null if nothing matched."""
    corpus = corpus_words.agg(F.floor(F.sum("words") * 100 / 75).alias("corpus_tokens"))
    asked = questions.where("tokens is not null").agg(F.avg("tokens").alias("query_tokens"))
    return corpus.join(F.broadcast(asked)).withColumn("ratio", F.round(F.col("corpus_tokens") / F.col("query_tokens"), 1))


def idf(labels: DataFrame, terms: list[str]) -> DataFrame:
    """term, df, idf over labels that hold the term: ln(1 + N / (1 + df)). terms: those of a query, a few."""
    sums = labels.agg(F.count("*").alias("n"), *[F.count_if(F.lower("label").contains(t)).alias(f"t{i}") for i, t in enumerate(terms)])
    rows = sums.select("n", F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("df")) for i, t in enumerate(terms)])).alias("x"))
    return rows.select("x.term", "x.df", F.round(F.log(1 + F.col("n") / (1 + F.col("x.df"))), 8).alias("idf"))


def section_keywords(nodes: DataFrame, stop: list[str], top: int = 10) -> DataFrame:
    """community, word, n, place: the most frequent words of each community's labels; ties by word, last first."""
    words = nodes.select("community", F.explode(text.label_tokens(F.col("label"))).alias("word")).where(~F.col("word").isin(stop) & (F.length("word") > 2))
    counted = words.groupBy("community", "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), F.desc("word")))
    return counted.withColumn("place", place).where(F.col("place") <= top)


def sections(nodes: DataFrame, archetypes: DataFrame, least: int = 2) -> DataFrame:
    """community, section: the archetype (section, priority, keywords) whose words the community's labels hold most often, 'other' below ``least``."""
    words = nodes.select("community", F.explode(text.label_tokens(F.col("label"))).alias("word"))
    keys = archetypes.select("section", "priority", F.explode("keywords").alias("word"))
    scored = words.join(keys, "word").groupBy("community", "section", "priority").agg(F.count("*").alias("score")).where(F.col("score") >= least)
    best = scored.groupBy("community").agg(F.max_by("section", F.struct("score", -F.col("priority"))).alias("section"))
    return nodes.select("community").distinct().join(best, "community", "left").withColumn("section", F.coalesce("section", F.lit("other")))


def top_labels(nodes: DataFrame, n: int = 5) -> DataFrame:
    """community, labels: the first labels of each community by ord."""
    ranked = nodes.where("community is not null").withColumn("place", F.row_number().over(Window.partitionBy("community").orderBy("ord"))).where(F.col("place") <= n)
    return ranked.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]), ", ").alias("labels"))


def hub_threshold(graph: Graph, least: int = 50) -> DataFrame:
    """One row, threshold: the degree at place floor(0.99 n) of all nodes' ascending degrees, at least ``least``.

    The place is found in the counts by degree, so that no task sorts all nodes.
    """
    degree = graph.nodes.select("id").join(degrees(graph), "id", "left").select(F.coalesce("degree", F.lit(0)).alias("degree"))
    by = degree.groupBy("degree").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy())
    placed = by.select("degree", upto.alias("upto"), total.alias("total"))
    place = F.least(F.floor(F.col("total") * 0.99), F.col("total") - 1)
    return placed.where(F.col("upto") > place).agg(F.greatest(F.coalesce(F.min("degree"), F.lit(0)), F.lit(least)).cast("long").alias("threshold"))


def directory_rollup(files: DataFrame) -> DataFrame:
    """folder, depth, files, total: counts of every folder on the way to each file. files: path, n."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("folder")))
    rows = files.select("n", F.explode(prefixes).alias("p"))
    return rows.groupBy(F.col("p.folder").alias("folder"), F.col("p.depth").alias("depth")).agg(F.count("*").alias("files"), F.sum("n").alias("total"))


def packed(units: DataFrame, budget: int) -> DataFrame:
    """id, bin: units in order of (group, ord) put into bins of at most ``budget`` tokens each, a new bin where the next does not fit.

    Bins never cross groups (the parent folders), so a group is the unit of work; its sorted rows stream through one task.
    units: group, ord, id, tokens.
    """
    rows = units.select("group", "ord", "id", F.col("tokens").cast("long").alias("tokens")).repartition("group").sortWithinPartitions("group", "ord", "id", "tokens")
    rows = rows.select("group", F.col("id").cast("string").alias("id"), "tokens")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, bin_, used = object(), 0, 0
        for pdf in frames:
            bins = []
            for group, n in zip(pdf["group"].tolist(), pdf["tokens"].tolist()):
                if group != last:
                    last, bin_, used = group, 0, 0
                n = None if pd.isna(n) else int(n)
                if used is None or n is None:
                    used = None  # as a sum with null: all that follows stays in the bin
                elif used > 0 and used + n > budget:
                    bin_, used = bin_ + 1, n
                else:
                    used += n
                bins.append(bin_)
            yield pdf[["group", "id"]].assign(bin=bins)

    return rows.mapInPandas(fold, T.StructType([rows.schema["group"], rows.schema["id"], T.StructField("bin", T.LongType())]))


def merged_chunks(chunks: DataFrame) -> DataFrame:
    """One row: nodes and edges of all chunks in one list each, token counters summed."""
    return chunks.agg(F.flatten(F.collect_list("nodes")).alias("nodes"), F.flatten(F.collect_list("edges")).alias("edges"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
