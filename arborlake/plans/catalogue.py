"""The registered queries: each operator applied to the driver's tables, with the same answer in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions import paths, text, vectors
from arborlake.graph import EVENT_SQL, TRADE_SQL, Graph, event_graph, table, trade_graph
from arborlake.operators import aggregates, analytics, filters, joins, search, sets, traversal, validation
from arborlake.storage import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL. $T, $E: the trade and event graph's tables."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql.replace("$T", TRADE_SQL).replace("$E", EVENT_SQL).strip()
        return f

    return add


# ---- degree and counts

DEGREE = "deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM g_edges UNION ALL SELECT target FROM g_edges) GROUP BY id)"


@query(f"WITH $T, {DEGREE} SELECT id, label, coalesce(deg.degree, 0) AS degree FROM g_nodes LEFT JOIN deg USING (id) ORDER BY coalesce(deg.degree, 0) DESC, ord LIMIT 10")
def god_nodes_top10(spark, d):
    return aggregates.god_nodes(trade_graph(spark, d), 10)


@query(f"WITH $T, {DEGREE}, best AS (SELECT * FROM deg ORDER BY degree DESC, id LIMIT 10) SELECT id, label, degree FROM best JOIN g_nodes USING (id)")
def god_nodes_engine(spark, d):
    return aggregates.god_ids(trade_graph(spark, d), 10)


@query(f"WITH $T, {DEGREE} SELECT id, label, coalesce(deg.degree, 0) AS degree FROM g_nodes LEFT JOIN deg USING (id) ORDER BY coalesce(deg.degree, 0) DESC, id LIMIT 25")
def god_nodes_all(spark, d):
    return aggregates.god_nodes_all(trade_graph(spark, d), 25)


@query("WITH $T SELECT (SELECT count(*) FROM g_nodes) AS nodes, (SELECT count(DISTINCT community) FROM g_nodes) AS communities, (SELECT count(*) FROM g_edges) AS edges")
def graph_stats(spark, d):
    return aggregates.counts(trade_graph(spark, d))


@query("""WITH $T
SELECT 'ending' AS kind, lower(regexp_extract(source_file, '[^/](\\.[^./]*)$', 1)) AS key, count(*) AS n FROM g_nodes GROUP BY 2
UNION ALL SELECT 'file_type', file_type, count(*) FROM g_nodes GROUP BY 2 UNION ALL SELECT 'relation', relation, count(*) FROM g_edges GROUP BY 2""")
def detailed_stats(spark, d):
    return aggregates.detailed_stats(trade_graph(spark, d))


@query("""WITH $T SELECT CASE WHEN source_file LIKE '%.py' THEN 'Python' WHEN source_file LIKE '%.rs' THEN 'Rust' WHEN source_file LIKE '%.go' THEN 'Go' ELSE 'Other' END AS language, count(*) AS n FROM g_nodes GROUP BY 1""")
def language_histogram(spark, d):
    return aggregates.language_histogram(trade_graph(spark, d).nodes)


@query(f"""WITH $T, {DEGREE}, gods AS (SELECT label, degree FROM g_nodes JOIN deg USING (id) ORDER BY degree DESC, ord LIMIT 5),
types AS (SELECT file_type, count(*) AS n FROM g_nodes GROUP BY 1 ORDER BY n DESC, file_type LIMIT 5)
SELECT 'count' AS kind, 'nodes' AS key, count(*) AS n FROM g_nodes UNION ALL SELECT 'count', 'edges', count(*) FROM g_edges
UNION ALL SELECT 'god', label, degree FROM gods UNION ALL SELECT 'file_type', file_type, n FROM types""")
def module_summary(spark, d):
    return aggregates.module_summary(trade_graph(spark, d))


@query("WITH $T SELECT 'community' AS kind, community::VARCHAR AS key, count(*) AS n FROM g_nodes GROUP BY 2")
def smart_summary_community(spark, d):
    return aggregates.smart_summary(trade_graph(spark, d), "community")


@query("WITH $T SELECT community, id, label, ord FROM g_nodes WHERE community = 2 ORDER BY ord LIMIT 50 OFFSET 5")
def community_members_page(spark, d):
    return filters.community_members(trade_graph(spark, d).nodes, 2, 5, 50).select("community", "id", "label", "ord")


@query("""WITH $T, own AS (SELECT id, community FROM g_nodes WHERE community IS NOT NULL), s AS (SELECT community, count(*) AS size FROM own GROUP BY 1),
i AS (SELECT a.community, count(*) AS internal FROM g_edges JOIN own a ON source = a.id JOIN own b ON target = b.id WHERE a.community = b.community GROUP BY 1)
SELECT community, size, coalesce(internal, 0) AS internal, round(CASE WHEN size <= 1 THEN 1.0 ELSE coalesce(internal, 0) / (size * (size - 1) / 2) END, 8) AS cohesion FROM s LEFT JOIN i USING (community)""")
def community_cohesion(spark, d):
    return aggregates.cohesion(trade_graph(spark, d))


def _with_part_communities(g: Graph) -> Graph:
    """Parts belong to no community; for questions across communities they get one of five by their order."""
    return Graph(g.nodes.withColumn("community", F.coalesce("community", F.col("ord") % 5)), g.edges, g.directed)


PART_COMMUNITY = "c_nodes AS (SELECT id, label, ord, coalesce(community, ord % 5) AS community FROM g_nodes)"


@query(f"""WITH $T, {PART_COMMUNITY}, x AS (SELECT a.community AS ca, b.community AS cb FROM g_edges JOIN c_nodes a ON source = a.id JOIN c_nodes b ON target = b.id WHERE a.community <> b.community)
SELECT community, other, count(*) AS links FROM (SELECT ca AS community, cb AS other FROM x UNION ALL SELECT cb, ca FROM x) GROUP BY 1, 2""")
def cross_community_links(spark, d):
    return joins.cross_community(_with_part_communities(trade_graph(spark, d)))


@query(f"""WITH $T, {PART_COMMUNITY}, x AS (SELECT a.community, b.community AS other, relation, count(*) AS n FROM g_edges JOIN c_nodes a ON source = a.id JOIN c_nodes b ON target = b.id WHERE a.community <> b.community GROUP BY ALL)
SELECT community, other, sum(n)::BIGINT AS links, arg_max(relation, n) AS relation FROM x GROUP BY 1, 2 ORDER BY links DESC, community, other LIMIT 12""")
def section_overview_edges(spark, d):
    return joins.section_overview(_with_part_communities(trade_graph(spark, d)))


@query(f"""WITH $T, {DEGREE}, hubs AS (SELECT id FROM deg WHERE degree > 60)
SELECT (SELECT count(*) FROM g_nodes WHERE id NOT IN (SELECT id FROM hubs)) AS nodes, (SELECT count(*) FROM g_edges WHERE source NOT IN (SELECT id FROM hubs) AND target NOT IN (SELECT id FROM hubs)) AS edges,
(SELECT count(*) FROM hubs) AS hubs""")
def exclude_hubs(spark, d):
    nodes, edges, hubs = filters.without_hubs(trade_graph(spark, d), 60)
    n = nodes.agg(F.count("*").alias("nodes"))
    return n.join(edges.agg(F.count("*").alias("edges"))).join(hubs.agg(F.count("*").alias("hubs")))


@query(f"""WITH $T, {DEGREE}, a AS (SELECT coalesce(degree, 0) AS degree FROM g_nodes LEFT JOIN deg USING (id)), r AS (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS p, count(*) OVER () AS n FROM a)
SELECT greatest(degree, 50)::BIGINT AS threshold FROM r WHERE p = least(floor(n * 0.99)::BIGINT, n - 1)""")
def hub_threshold(spark, d):
    return aggregates.hub_threshold(trade_graph(spark, d))


# ---- filters and joins


@query("WITH $T, own AS (SELECT id FROM g_nodes WHERE community = 1) SELECT source, target, relation FROM g_edges WHERE source IN (SELECT id FROM own) AND target IN (SELECT id FROM own)")
def induced_subgraph(spark, d):
    g = trade_graph(spark, d)
    return filters.induced(g, g.nodes.where("community = 1").select("id")).edges.select("source", "target", "relation")


@query("WITH $T SELECT source, target, relation, context, confidence FROM g_edges WHERE context = 'call' AND confidence = 'INFERRED'")
def context_filtered_edges(spark, d):
    contexts, _ = filters.resolved_contexts("who calls this part")
    return filters.inferred_edges(filters.with_contexts(trade_graph(spark, d), contexts).edges).select("source", "target", "relation", "context", "confidence")


@query("WITH $T SELECT id, label FROM g_nodes WHERE lower(label) LIKE '%00001%' OR lower(id) LIKE '%00001%'")
def substring_search(spark, d):
    return filters.search_nodes(trade_graph(spark, d).nodes, "00001", ("label", "id")).select("id", "label")


@query("WITH $T SELECT source, target, relation FROM g_edges WHERE contains(source, 'nation') OR contains(target, 'nation') OR contains(relation, 'nation') ORDER BY 1, 2, 3 LIMIT 5")
def keyword_edges(spark, d):
    return filters.keyword_edges(trade_graph(spark, d).edges, "nation").select("source", "target", "relation")


@query("""WITH $T, e AS (SELECT id FROM g_nodes WHERE lower(label) = 'supplier#000000003')
SELECT DISTINCT side, id FROM (SELECT 'caller' AS side, source AS id FROM g_edges WHERE relation = 'calls' AND target IN (SELECT id FROM e)
UNION ALL SELECT 'callee', target FROM g_edges WHERE relation = 'calls' AND source IN (SELECT id FROM e)) WHERE id NOT IN (SELECT id FROM e)""")
def callers_callees(spark, d):
    return joins.callers_and_callees(trade_graph(spark, d), "Supplier#000000003")


@query("""WITH $T, hit AS (SELECT id FROM g_nodes WHERE contains(lower(label), 'ring') ORDER BY lower(label) <> 'ring', ord LIMIT 5)
SELECT id, label, relation FROM g_edges JOIN g_nodes ON source = id WHERE relation IN ('calls', 'uses', 'invokes') AND target IN (SELECT id FROM hit)""")
def find_callers(spark, d):
    return joins.find_callers(trade_graph(spark, d), "ring")


@query("WITH $T SELECT 'super' AS side, target AS id FROM g_edges WHERE relation = 'inherits' AND source = 'region:1' UNION ALL SELECT 'sub', source FROM g_edges WHERE relation = 'inherits' AND target = 'region:1'")
def hierarchy_one_hop(spark, d):
    return joins.hierarchy(trade_graph(spark, d), "region:1")


@query("""WITH RECURSIVE $T, c AS (SELECT target AS id, 1 AS depth FROM g_edges WHERE relation IN ('inherits', 'imports') AND source = 'customer:7'
UNION SELECT target, depth + 1 FROM c JOIN g_edges ON source = c.id WHERE relation IN ('inherits', 'imports')) SELECT id, min(depth)::INTEGER AS depth FROM c GROUP BY id""")
def hierarchy_closure(spark, d):
    g = trade_graph(spark, d)
    up = g.edges.where(F.col("relation").isin("inherits", "imports")).select(F.col("source").alias("at"), F.col("target").alias("to"))
    return traversal.expanded(up, g.nodes.where("id = 'customer:7'").select("id"), 8).where("depth > 0")


@query("WITH $T SELECT g_nodes.id, label, relation, way FROM (SELECT target AS id, relation, 'out' AS way FROM g_edges WHERE source = 'nation:3' UNION ALL SELECT source, relation, 'in' FROM g_edges WHERE target = 'nation:3') x JOIN g_nodes USING (id)")
def adjacent_nodes(spark, d):
    return joins.neighbours(trade_graph(spark, d), "nation:3")


def _snapshots(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Two states of the edges: without those whose target ends in 7, and without those whose target ends in 3."""
    return g.edges.where(~F.col("target").endswith("7")), g.edges.where(~F.col("target").endswith("3"))


DIFF = "WITH $T, old AS MATERIALIZED (SELECT * FROM g_edges WHERE target NOT LIKE '%7'), new AS MATERIALIZED (SELECT * FROM g_edges WHERE target NOT LIKE '%3') SELECT source, target, relation FROM {a} ANTI JOIN {b} USING (source, target, relation)"


@query(DIFF.format(a="new", b="old"))
def edge_diff_added(spark, d):
    old, new = _snapshots(trade_graph(spark, d))
    return joins.edges_only_in(new, old)


@query(DIFF.format(a="old", b="new"))
def edge_diff_removed(spark, d):
    old, new = _snapshots(trade_graph(spark, d))
    return joins.edges_only_in(old, new)


def _halves(spark, d) -> tuple[Graph, Graph]:
    """Two overlapping graphs: communities 0 to 2, and 2 to 4 with labels in capitals."""
    g = trade_graph(spark, d)
    a, b = g.nodes.where("community <= 2"), g.nodes.where("community >= 2").withColumn("label", F.upper("label"))
    return Graph(a, g.edges.where("relation = 'inherits'")), Graph(b, g.edges.where("relation != 'calls'"))


@query("WITH $T SELECT id, CASE WHEN community <= 2 THEN label ELSE upper(label) END AS label FROM g_nodes WHERE community IS NOT NULL")
def merge_first_wins(spark, d):
    return sets.merged(*_halves(spark, d)).nodes.select("id", "label")


@query("WITH $T SELECT id, CASE WHEN community < 2 THEN label ELSE upper(label) END AS label FROM g_nodes WHERE community IS NOT NULL")
def merge_last_wins(spark, d):
    return sets.merged(*_halves(spark, d), last_wins=True).nodes.select("id", "label")


@query("WITH $T SELECT source, target, relation FROM g_edges WHERE relation = 'inherits' UNION ALL SELECT source, target, relation FROM g_edges WHERE relation <> 'calls'")
def merge_concat(spark, d):
    return sets.concatenated(*_halves(spark, d)).edges.select("source", "target", "relation")


@query("WITH $T, f AS (SELECT label, arg_min(id, ord) AS first_id FROM g_nodes GROUP BY label) SELECT id, first_id FROM g_nodes JOIN f USING (label)")
def label_dedup_map(spark, d):
    return sets.label_map(trade_graph(spark, d).nodes)


@query("WITH $T, f AS (SELECT source_file, label, arg_min(id, ord) AS first_id FROM g_nodes GROUP BY 1, 2) SELECT id, first_id FROM g_nodes JOIN f USING (source_file, label) WHERE id <> first_id")
def exact_dedup(spark, d):
    return sets.exact_duplicates(trade_graph(spark, d).nodes)


@query("""WITH $T, f AS (SELECT label, arg_min(id, ord) AS first_id FROM g_nodes GROUP BY label), m AS (SELECT id, first_id FROM g_nodes JOIN f USING (label))
SELECT DISTINCT a.first_id AS source, b.first_id AS target, relation FROM g_edges JOIN m a ON source = a.id JOIN m b ON target = b.id""")
def label_dedup_edges(spark, d):
    return sets.with_one_node_per_label(trade_graph(spark, d)).edges.select("source", "target", "relation")


@query("WITH $T SELECT 'a::' || source AS source, 'a::' || target AS target FROM g_edges WHERE relation = 'inherits'")
def prefix_and_prune(spark, d):
    g = trade_graph(spark, d)
    small = Graph(g.nodes.where("file_type in ('module', 'class') and community is not null"), g.edges.where("relation = 'inherits'"))
    both = sets.concatenated(sets.prefixed(small, "a"), sets.prefixed(small, "b"))
    return filters.without_repo(both, "b").edges.select("source", "target")


@query("WITH $T SELECT id FROM g_nodes WHERE file_type IN ('class') AND community IS NOT NULL")
def external_stub_skip(spark, d):
    g = trade_graph(spark, d)
    stubs = g.nodes.where("file_type = 'module'").withColumn("source_file", F.lit(""))
    new = Graph(stubs.withColumn("id", F.concat(F.lit("x:"), "id")).unionByName(g.nodes.where("file_type = 'class' and community is not null")), g.edges.limit(0))
    return joins.without_known_stubs(new, Graph(stubs, g.edges.limit(0))).nodes.select("id")


@query("""WITH $T, one AS (SELECT lower(trim(label)) AS name, min(id) AS target FROM g_nodes GROUP BY 1 HAVING count(*) = 1)
SELECT DISTINCT c.id AS source, target, 'calls' AS relation, 'INFERRED' AS confidence FROM g_nodes c JOIN one ON one.name = 'supplier#' || lpad((c.ord % 10)::VARCHAR, 9, '0')
WHERE c.file_type = 'struct' AND c.id <> target AND NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.source = c.id AND e.target = one.target)""")
def cross_file_call_resolution(spark, d):
    g = trade_graph(spark, d)
    calls = g.nodes.where("file_type = 'struct'").select(F.col("id").alias("caller"), F.concat(F.lit("Supplier#"), F.lpad((F.col("ord") % 10).cast("string"), 9, "0")).alias("name"))
    return joins.resolved_calls(calls, g.nodes, g.edges)


@query("""WITH $T, f AS (SELECT source_file, count(*) AS n FROM g_nodes WHERE source_file IN ('crm/BUILDING.py', 'sup/3.go', 'sup/13.go') GROUP BY 1)
SELECT (SELECT sum(n) FROM f)::BIGINT AS nodes, (SELECT count(DISTINCT community) FROM g_nodes WHERE source_file IN (SELECT source_file FROM f))::INTEGER AS communities, (SELECT count(*) FROM f) AS files""")
def impact_by_changed_files(spark, d):
    changed = spark.createDataFrame([("home/crm/BUILDING.py",), ("3.go",), ("13.go",), ("sup/3.go",)], "path string")
    return joins.change_impact(trade_graph(spark, d).nodes, changed)


@query("""WITH $T, new AS (SELECT id, ord % 7 AS community FROM g_nodes WHERE community IS NOT NULL), x AS (SELECT n.community, o.community AS previous, count(*) AS shared FROM new n JOIN g_nodes o USING (id) GROUP BY 1, 2)
SELECT community, previous, shared FROM x QUALIFY row_number() OVER (PARTITION BY community ORDER BY shared DESC, previous) = 1""")
def community_remap(spark, d):
    old = trade_graph(spark, d).nodes.where("community is not null")
    return joins.remapped_communities(old.select("id", (F.col("ord") % 7).alias("community")), old)


@query("WITH $T SELECT id, community, floor((row_number() OVER (PARTITION BY community ORDER BY ord) - 1) / 100)::BIGINT AS part FROM g_nodes WHERE community IS NOT NULL")
def community_split(spark, d):
    return sets.split_communities(trade_graph(spark, d).nodes, 100)


@query("WITH $T, x AS (SELECT community, label, row_number() OVER (PARTITION BY community ORDER BY ord) AS p FROM g_nodes WHERE community IS NOT NULL QUALIFY p <= 5) SELECT community, string_agg(label, ', ' ORDER BY p) AS labels FROM x GROUP BY 1")
def community_top_labels(spark, d):
    return aggregates.top_labels(trade_graph(spark, d).nodes)


# ---- validation


@query("WITH $T SELECT source, target, 'dangling target' AS problem FROM g_edges WHERE target LIKE 'part:%'")
def dangling_edges(spark, d):
    g = trade_graph(spark, d)
    return validation.edge_errors(Graph(g.nodes.where("id not like 'part:%'"), g.edges.withColumn("confidence", F.lit("EXTRACTED"))))


@query("WITH $T SELECT id, 'unknown file_type' AS problem FROM g_nodes WHERE file_type = 'module' UNION ALL SELECT id, 'missing label' FROM g_nodes WHERE file_type = 'class' AND ord % 10 = 0")
def validate_rows(spark, d):
    nodes = trade_graph(spark, d).nodes.withColumn("label", F.when((F.col("file_type") == "class") & (F.col("ord") % 10 == 0), None).otherwise(F.col("label")))
    return validation.node_errors(nodes, ["class", "struct"])


@query("""WITH $E, p AS (SELECT count(*) AS n FROM e_edges), u AS (SELECT count(*) AS n FROM e_edges GROUP BY least(source, target), greatest(source, target))
SELECT (SELECT n FROM p) AS edges, 0::BIGINT AS missing_ends, 0::BIGINT AS dangling, (SELECT count(*) FROM e_edges WHERE source = target) AS loops, (SELECT n FROM p) AS valid, (SELECT n FROM p) AS pairs, 0::BIGINT AS surplus,
0::BIGINT AS variants, (SELECT count(*) FROM u) AS undirected_pairs, (SELECT sum(n - 1) FROM u)::BIGINT AS undirected_surplus""")
def edge_diagnostics(spark, d):
    return aggregates.edge_diagnostics(event_graph(spark, d))


@query("""WITH $T, hit AS (SELECT id, source_file, lower(label || ' ' || source_file) AS hay, regexp_matches(source_file, 'test|spec|Test') AS tested FROM g_nodes),
h AS (SELECT id, tested, (SELECT count(*) FROM (VALUES ('auth'), ('pay'), ('password'), ('token'), ('secret'), ('credit'), ('billing'), ('admin'), ('security'), ('encrypt'), ('hash'), ('key'), ('credential')) w(x) WHERE contains(hay, x)) AS hits FROM hit),
i AS (SELECT target AS id, count(*) AS in_degree FROM g_edges GROUP BY 1),
m AS (SELECT x.id, max(tested::INT) AS t FROM (SELECT source AS id, target AS other FROM g_edges UNION ALL SELECT target, source FROM g_edges) x JOIN h ON h.id = x.other GROUP BY 1),
s AS (SELECT h.id, hits::INTEGER AS hits, coalesce(in_degree, 0) AS in_degree, coalesce(t, 0) = 0 AS untested FROM h LEFT JOIN i USING (id) LEFT JOIN m USING (id)),
v AS (SELECT *, round(least(least(0.15 * hits, 0.4)::DOUBLE + CASE WHEN in_degree >= 10 THEN 0.3 WHEN in_degree >= 5 THEN 0.15 ELSE 0 END + CASE WHEN untested THEN 0.2 ELSE 0 END, 1.0), 6)::DOUBLE AS score FROM s)
SELECT *, CASE WHEN score >= 0.6 THEN 'HIGH' WHEN score >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM v""")
def node_risk_score(spark, d):
    return aggregates.node_risk(trade_graph(spark, d))


# ---- logs


def _tool_log(spark, d) -> DataFrame:
    return table(spark, d, "events").select("ts", F.col("event_type").alias("tool"), (F.col("event_type") == "error").alias("error"), (F.col("value") * 100).alias("saved_chars"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS tool, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, round(sum(value * 100), 4) AS saved_chars FROM events GROUP BY 1, 2")
def usage_day_tool(spark, d):
    return aggregates.usage_by_day(_tool_log(spark, d))


@query("SELECT event_type AS tool, count(*) AS calls FROM events GROUP BY 1 ORDER BY calls DESC, tool LIMIT 5")
def tool_usage_rollup(spark, d):
    return aggregates.top_tools(_tool_log(spark, d))


@query("""WITH n AS (SELECT max(ts) AS now FROM events), a AS (SELECT value * 100 / 4 AS v, epoch(now) - epoch(ts) AS age FROM events, n)
SELECT count(*) FILTER (age <= 86400) AS calls_day, round(sum(CASE WHEN age <= 86400 THEN v ELSE 0 END), 4) AS saved_day, count(*) FILTER (age <= 604800) AS calls_week,
round(sum(CASE WHEN age <= 604800 THEN v ELSE 0 END), 4) AS saved_week, count(*) AS calls_all, round(sum(v), 4) AS saved_all FROM a""")
def tool_usage_windows(spark, d):
    log = _tool_log(spark, d)
    now = log.agg(F.max("ts").alias("now"))
    return aggregates.tool_windows(log, F.lit(now.first()[0]))


@query("""WITH o AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 600000000 THEN 0 ELSE 1 END AS s FROM events),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT user_id, min(ts) AS first_ts, count(*) AS events FROM g GROUP BY user_id, g""")
def debounce_sessions(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "10 minutes")).agg(F.min("ts").alias("first_ts"), F.count("*").alias("events")).select("user_id", "first_ts", "events")


# ---- text and ranking


@query("SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: len(w) >= 2) AS tokens FROM documents")
def tokens_store(spark, d):
    return table(spark, d, "documents").select("doc_id", text.store_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_]+'))::INTEGER AS n, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')).len()::INTEGER AS different FROM documents")
def tokens_search(spark, d):
    words = text.search_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("different"))


TERMS = ["ring", "small", "bolt"]


@query("WITH $T, t AS (SELECT unnest(['ring', 'small', 'bolt']) AS term) SELECT term, (SELECT count(*) FROM g_nodes WHERE contains(lower(label), term)) AS df, round(ln(1 + (SELECT count(*) FROM g_nodes) / (1 + (SELECT count(*) FROM g_nodes WHERE contains(lower(label), term)))), 8) AS idf FROM t")
def idf_terms(spark, d):
    return aggregates.idf(trade_graph(spark, d).nodes, TERMS)


LEXICAL = """t AS (SELECT unnest(['ring', 'small', 'bolt']) AS term), w AS (SELECT term, ln(1 + (SELECT count(*) FROM g_nodes) / (1 + (SELECT count(*) FROM g_nodes WHERE contains(lower(label), term)))) AS w FROM t),
lexical AS (SELECT id, round(sum(CASE WHEN lower(label) = term THEN 1000 * w WHEN starts_with(lower(label), term) THEN 100 * w WHEN contains(lower(label), term) THEN w ELSE 0 END + CASE WHEN contains(lower(source_file), term) THEN 0.5 * w ELSE 0 END), 8) AS score FROM g_nodes, w GROUP BY id)"""


@query(f"WITH $T, {LEXICAL} SELECT id, score FROM lexical WHERE score > 0")
def lexical_score(spark, d):
    return search.lexical_scores(trade_graph(spark, d).nodes, TERMS)


BM25_TERMS = ["the", "tion", "and", "the"]
BM25_SQL = """b AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents), l AS (SELECT *, len(w) AS dl, avg(len(w)) OVER () AS avgdl, count(*) OVER () AS n FROM b),
q AS (SELECT * FROM (VALUES ('the', 2), ('tion', 1), ('and', 1)) v(term, times)), f AS (SELECT id, dl, avgdl, n, term, times, len(list_filter(w, lambda x: x = term)) AS tf FROM l, q),
i AS (SELECT *, greatest(0, ln((n - count(*) FILTER (tf > 0) OVER (PARTITION BY term) + 0.5) / (count(*) FILTER (tf > 0) OVER (PARTITION BY term) + 0.5) + 1)) AS idf FROM f),
bm AS (SELECT id, round(sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 8) AS score FROM i GROUP BY id)"""


@query(f"WITH {BM25_SQL} SELECT id, score FROM bm WHERE score > 0")
def bm25_score(spark, d):
    return search.bm25(table(spark, d, "documents"), BM25_TERMS, "doc_id", "text")


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 8) AS score FROM embeddings WHERE vec_id <> 0 ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 20")
def dense_cosine_topk(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return analytics.similar(e, 0, 20).select(F.col("id").alias("vec_id"), "score")


RRF_SQL = f"""{BM25_SQL}, c AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)), 8) AS score FROM embeddings),
r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS p FROM bm WHERE score > 0 UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS p FROM c),
fused AS (SELECT id, round(sum(1.0::DOUBLE / (60 + p + 1)), 10) AS score FROM r GROUP BY id)"""


def _fused(spark, d, most: int | None = None) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = [float(x) for x in e.where("vec_id = 3").first()["embedding"]]
    return search.fused(bm25_score(spark, d), search.dense(e, q, "vec_id", "embedding"), most=most)


@query(f"WITH {RRF_SQL} SELECT id, score FROM fused")
def rrf_fused(spark, d):
    return _fused(spark, d)


ADJUST_SQL = f"""{RRF_SQL}, n AS (SELECT doc_id AS id, substring(text, 1, 20) AS label, CASE WHEN doc_id % 9 = 0 THEN 'a/tests/' || source ELSE source END AS source_file FROM documents),
a AS (SELECT id, score, label, source_file, row_number() OVER (PARTITION BY source_file ORDER BY score DESC, id) - 1 AS k FROM fused JOIN n USING (id)),
adjusted AS (SELECT id, round(score * CASE WHEN contains(source_file, '/tests/') THEN 0.05 ELSE 1 END::DOUBLE * CASE WHEN contains(lower(label), 'the') OR contains(lower(label), 'tion') THEN 1.5 ELSE 1 END::DOUBLE * pow(0.5, k), 10) AS score FROM a)"""


def _adjusted(spark, d, most: int | None = None) -> DataFrame:
    docs = table(spark, d, "documents")
    file = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("a/tests/"), "source")).otherwise(F.col("source"))
    return search.adjusted(_fused(spark, d, most), docs.select(F.col("doc_id").alias("id"), F.substring("text", 1, 20).alias("label"), file.alias("source_file")), ["the", "tion"])


@query(f"WITH {ADJUST_SQL} SELECT id, score FROM adjusted")
def score_adjusted(spark, d):
    return _adjusted(spark, d)


@query(f"WITH {ADJUST_SQL}, t AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS place, max(score) OVER () AS top FROM adjusted QUALIFY place < 8) SELECT id, score, place::INTEGER AS place FROM t WHERE place = 0 OR score >= top * 0.2")
def seed_cut(spark, d):
    return search.seeds(_adjusted(spark, d), 8, 0.2)


@query("""WITH $T, t AS (SELECT id, label, ord, CASE WHEN lower(label) = 'small ring' THEN 0 WHEN starts_with(lower(label), 'small ring') THEN 1 WHEN contains(lower(label), 'small ring') THEN 2 END AS tier FROM g_nodes)
SELECT id, label, tier FROM t WHERE tier IS NOT NULL ORDER BY tier, ord LIMIT 20""")
def find_node_tiers(spark, d):
    return search.found_by_tier(trade_graph(spark, d).nodes, "small ring")


@query("""WITH $T, t AS (SELECT id, label, ord, CASE WHEN lower(label) = 'nation_1' THEN 0 WHEN contains(lower(label), 'nation_1') THEN 1 END AS tier FROM g_nodes)
SELECT id, label, tier FROM t WHERE tier IS NOT NULL ORDER BY tier, CASE WHEN tier = 1 THEN length(label) ELSE 0 END, ord LIMIT 20""")
def find_node_by_label(spark, d):
    return search.found_by_label(trade_graph(spark, d).nodes, "nation_1")


@query("WITH $T, x AS (SELECT id, unnest(list_filter(list_concat(regexp_split_to_array(lower(label), '[^a-z0-9]+'), regexp_split_to_array(lower(id), '[^a-z0-9]+')), lambda w: len(w) >= 2)) AS token FROM g_nodes) SELECT id, count(*)::DOUBLE AS score FROM x WHERE token IN ('nation', '12', 'region') GROUP BY id ORDER BY score DESC, id LIMIT 10")
def store_search(spark, d):
    return search.store_search(trade_graph(spark, d).nodes, ["nation", "12", "region"])


@query("WITH $T SELECT 'nation:7' AS id")
def seed_resolution(spark, d):
    return search.resolved_seed(trade_graph(spark, d).nodes, "nation_7")


@query("""WITH p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, jaro_winkler_similarity(lower(a.p_name), lower(b.p_name)) AS s FROM part a JOIN part b ON a.p_partkey < b.p_partkey WHERE jaro_similarity(lower(a.p_name), lower(b.p_name)) > 0.72)
SELECT a, b, round(s, 6) AS score FROM p""")
def jaro_winkler_pairs(spark, d):
    return _alike_parts(table(spark, d, "part"))


def _alike_parts(parts: DataFrame, chunk: int = 2000) -> DataFrame:
    """Names are compared once each; lists of at most ``chunk`` keys of two alike names then meet."""
    names = parts.groupBy(F.col("p_name").alias("p")).agg(F.count("*").alias("n"))
    names = written(names.where("p is not null"), "names")
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number stays: few bytes come in, many rows go out
    s = names.select("p").join(names.select(F.col("p").alias("q"))).repartition(tasks, "p", "q").withColumn("s", vectors.jaro_winkler("p", "q"))
    n = F.lit(0)
    for i in range(1, 5):
        n = n + (F.lower(F.substring("p", 1, i)) == F.lower(F.substring("q", 1, i))).cast("int")
    jaro = (F.col("s") - n * 0.1) / (1 - n * 0.1)
    s = written(s.where(jaro > 0.72).select("p", "q", F.round("s", 6).alias("score")), "alike")
    # parts of a name are dealt by a hash of their key, so that no list is long
    dealt = parts.select("p_partkey", F.col("p_name").alias("p")).join(names, "p").withColumn("tile", F.pmod(F.xxhash64("p_partkey"), F.ceil(F.col("n") * 2 / chunk)))
    lists = written(dealt.groupBy("p", "tile").agg(F.collect_list("p_partkey").alias("keys")), "keys")
    met = lists.select("p", F.col("tile").alias("x"), F.col("keys").alias("first")).join(s, "p").join(lists.select(F.col("p").alias("q"), F.col("tile").alias("y"), F.col("keys").alias("second")), "q")
    rows = met.repartition(tasks, "p", "x", "q", "y").select("score", "second", F.explode("first").alias("a")).select("score", "a", F.explode("second").alias("b"))
    return rows.where("a < b").select("a", "b", "score")


# ---- walks and structure


@query("""WITH RECURSIVE $T, s AS (SELECT source AS fr, target AS go FROM g_edges UNION ALL SELECT target, source FROM g_edges),
w AS (SELECT 'region:0' AS id, 0 AS depth UNION SELECT go, depth + 1 FROM w JOIN s ON fr = id WHERE depth < 2) SELECT id, label, min(depth)::INTEGER AS depth FROM w JOIN g_nodes USING (id) WHERE id <> 'region:0' GROUP BY 1, 2""")
def neighbors_depth2(spark, d):
    return traversal.neighbourhood(trade_graph(spark, d), "region:0", 2)


BLAST = """WITH RECURSIVE $T, s AS (SELECT source AS fr, target AS go FROM g_edges UNION ALL SELECT target, source FROM g_edges),
l1 AS (SELECT DISTINCT go AS id FROM s WHERE fr IN ({seeds})), l2 AS (SELECT DISTINCT go AS id FROM s WHERE fr IN (SELECT id FROM l1)), l3 AS (SELECT DISTINCT go AS id FROM s WHERE fr IN (SELECT id FROM l2)),
w AS (SELECT id, 1 AS depth FROM l1 UNION ALL SELECT id, 2 FROM l2 UNION ALL SELECT id, 3 FROM l3) SELECT id, min(depth)::INTEGER AS depth FROM w WHERE id NOT IN ({seeds}) GROUP BY id"""


@query(BLAST.format(seeds="'nation:4'"))
def blast_radius(spark, d):
    return traversal.blast_radius(trade_graph(spark, d), "NATION_4")


@query(BLAST.format(seeds="'nation:4', 'customer:11'"))
def blast_multi(spark, d):
    return traversal.blast_radius_multi(trade_graph(spark, d), ["NATION_4", "Customer#000000011"])


@query("""WITH $T, l1 AS (SELECT source AS id, min(relation) AS via FROM g_edges WHERE target = 'region:2' AND relation IN ('calls', 'imports', 'inherits') GROUP BY 1),
l2 AS (SELECT source AS id, min(relation) AS via FROM g_edges WHERE target IN (SELECT id FROM l1) AND relation IN ('calls', 'imports', 'inherits') GROUP BY 1)
SELECT id, 1::INTEGER AS depth, via FROM l1 UNION ALL SELECT id, 2, via FROM l2 WHERE id NOT IN (SELECT id FROM l1)""")
def affected_reverse(spark, d):
    return traversal.affected(trade_graph(spark, d), "region:2")


@query(f"""WITH $T, {DEGREE}, s AS (SELECT source AS fr, target AS go FROM g_edges UNION ALL SELECT target, source FROM g_edges), hub AS (SELECT id FROM deg WHERE degree >= 50),
l1 AS (SELECT DISTINCT go AS id FROM s WHERE fr = 'customer:5'), l2 AS (SELECT DISTINCT go AS id FROM s WHERE fr IN (SELECT id FROM l1 WHERE id NOT IN (SELECT id FROM hub))),
l3 AS (SELECT DISTINCT go AS id FROM s WHERE fr IN (SELECT id FROM l2 WHERE id NOT IN (SELECT id FROM hub) AND id NOT IN (SELECT id FROM l1) AND id <> 'customer:5')),
w AS (SELECT 'customer:5' AS id, 0 AS depth UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2 UNION ALL SELECT id, 3 FROM l3) SELECT id, min(depth)::INTEGER AS depth FROM w GROUP BY id""")
def bfs_hub_stop(spark, d):
    g = trade_graph(spark, d)
    return traversal.breadth_first(g, g.nodes.where("id = 'customer:5'").select("id"), 3, 50)[0]


@query("""WITH RECURSIVE $T, s AS (SELECT source AS fr, target AS go FROM g_edges UNION ALL SELECT target, source FROM g_edges),
l1 AS (SELECT DISTINCT go AS id FROM s WHERE fr = 'customer:1'), l2 AS (SELECT DISTINCT go AS id FROM s WHERE fr IN (SELECT id FROM l1)), l3 AS (SELECT DISTINCT go AS id FROM s WHERE fr IN (SELECT id FROM l2)), l4 AS (SELECT DISTINCT go AS id FROM s WHERE fr IN (SELECT id FROM l3)),
w AS (SELECT 'customer:1' AS id, 0 AS h UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2 UNION ALL SELECT id, 3 FROM l3 UNION ALL SELECT id, 4 FROM l4) SELECT id, min(h)::INTEGER AS hops FROM w WHERE id LIKE 'nation:%' OR id LIKE 'region:%' GROUP BY id""")
def shortest_hops(spark, d):
    found = traversal.shortest_paths(trade_graph(spark, d).steps(), "customer:1", most=4)
    return found.where("id like 'nation:%' or id like 'region:%'").select("id", "hops")


@query("""WITH RECURSIVE $T, w AS (SELECT 'customer:2' AS id, 0.0::DOUBLE AS distance UNION SELECT target, distance + weight FROM w JOIN g_edges ON source = id) SELECT id, min(distance) AS distance FROM w GROUP BY id""")
def weighted_distance(spark, d):
    g = trade_graph(spark, d)
    return traversal.weighted_distances(Graph(g.nodes, g.edges, True), "customer:2").select("id", "distance")


@query("""WITH RECURSIVE $E, p AS (SELECT ['view'] AS path UNION ALL SELECT list_append(path, target) FROM p JOIN e_edges ON source = path[-1] WHERE path[-1] <> 'purchase' AND NOT list_contains(path, target) AND len(path) < 5)
SELECT array_to_string(path, '>') AS path FROM p WHERE path[-1] = 'purchase'""")
def all_simple_paths(spark, d):
    return traversal.simple_paths(event_graph(spark, d), "view", "purchase", 5).select(F.array_join("path", ">").alias("path"))


@query("""WITH RECURSIVE $T, ids AS (SELECT DISTINCT id FROM (SELECT source AS id FROM g_edges UNION ALL SELECT target FROM g_edges)), n AS (SELECT count(*)::DOUBLE AS n FROM ids),
o AS (SELECT id, (SELECT count(*) FROM g_edges WHERE source = id) AS c FROM ids), p AS (SELECT DISTINCT source, target FROM g_edges),
r AS (SELECT id, 0 AS i, 1 / (SELECT n FROM n) AS rank FROM ids UNION ALL (
  SELECT id, i + 1, 0.15 / n.n + 0.85 * dangling / n.n + 0.85 * coalesce(got, 0) FROM
    (SELECT ids.id, x.i, x.dangling, g.got FROM ids, (SELECT max(i) AS i, coalesce(sum(rank) FILTER (c = 0), 0) AS dangling FROM r JOIN o USING (id)) x
     LEFT JOIN (SELECT target AS id, sum(rank / c) AS got FROM r JOIN o USING (id) JOIN p ON p.source = r.id GROUP BY target) g ON g.id = ids.id), n WHERE i < 20))
SELECT id, round(rank, 10) AS rank FROM r WHERE i = 20""")
def pagerank_20(spark, d):
    return analytics.pagerank(trade_graph(spark, d), 0.85, 20).select("id", F.round("rank", 10).alias("rank"))


@query("""WITH RECURSIVE $T, w AS (SELECT id, 0 AS level FROM g_nodes WHERE id NOT IN (SELECT target FROM g_edges) UNION SELECT target, level + 1 FROM w JOIN g_edges ON source = id) SELECT id, max(level)::INTEGER AS level FROM w GROUP BY id""")
def topo_levels(spark, d):
    return analytics.topological_levels(trade_graph(spark, d))


@query("""WITH RECURSIVE $E, s AS (SELECT source, target FROM e_edges UNION ALL SELECT 'a', 'view' UNION ALL SELECT 'purchase', 'b' UNION ALL SELECT 'b', 'c' UNION ALL SELECT 'c', 'b'), ids AS (SELECT DISTINCT source AS id FROM s UNION SELECT target FROM s),
w AS (SELECT id AS a, id AS b FROM ids UNION SELECT a, target FROM w JOIN s ON source = b) SELECT x.a AS id, min(x.b) AS component FROM w x JOIN w y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")
def strong_components(spark, d):
    g = event_graph(spark, d)
    more = spark.createDataFrame([("a", "view"), ("purchase", "b"), ("b", "c"), ("c", "b")], "source string, target string")
    edges = g.edges.select("source", "target").union(more)
    return analytics.strong_components(Graph(edges.select(F.explode(F.array("source", "target")).alias("id")), edges, True))


@query()
def bridges(spark, d):
    return analytics.bridges(trade_graph(spark, d))


@query()
def communities(spark, d):
    return analytics.detected_communities(trade_graph(spark, d))


@query("WITH $T SELECT id, 'region:' || community AS component FROM g_nodes WHERE community IS NOT NULL")
def weak_components(spark, d):
    g = trade_graph(spark, d)
    found = analytics.weak_components(Graph(g.nodes.where("community is not null"), g.edges.where("relation != 'calls'")))
    root = found.where("id like 'region:%'").select("component", F.col("id").alias("region"))
    return found.join(root, "component").select("id", F.col("region").alias("component"))


@query()
def node2vec_similar(spark, d):
    g = event_graph(spark, d)
    return analytics.similar(analytics.structural_vectors(g, 16, 4, 20, 5), "view", 4)


@query()
def fuzzy_dedup(spark, d):
    return analytics.fuzzy_duplicates(trade_graph(spark, d).nodes, 0.97)


# ---- sources


@query("""SELECT page_id, CASE WHEN contains(lower(url), 'twitter.com') OR contains(lower(url), 'x.com') THEN 'tweet' WHEN contains(lower(url), 'arxiv.org') THEN 'arxiv' WHEN contains(lower(url), 'github.com') THEN 'github'
WHEN contains(lower(url), 'youtube.com') OR contains(lower(url), 'youtu.be') THEN 'youtube' WHEN lower(url) LIKE '%.pdf' THEN 'pdf' ELSE 'webpage' END AS kind,
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^.*?://', ''), '[?#].*$', ''), '[^a-zA-Z0-9_\\-]', '_', 'g'), '^_+|_+$', '', 'g'), '_+', '_', 'g') AS name FROM pages""")
def url_type(spark, d):
    return table(spark, d, "pages").select("page_id", paths.url_kind(F.col("url")).alias("kind"), paths.safe_file_name(F.col("url")).alias("name"))


HTML = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'))"""


@query(f"SELECT page_id, md5(substring({HTML}, 1, 8000)) AS digest, length(substring({HTML}, 1, 8000)) AS n FROM pages")
def html_text_digest(spark, d):
    t = text.html_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.md5(t).alias("digest"), F.length(t).cast("long").alias("n"))


@query(r"""SELECT doc_id, (regexp_matches(t, '(?i)\barxiv\b')::INT + regexp_matches(t, '(?i)\bdoi\s*:')::INT + regexp_matches(t, '(?i)\babstract\b')::INT + regexp_matches(t, '(?i)\bproceedings\b')::INT + regexp_matches(t, '(?i)\bjournal\b')::INT
+ regexp_matches(t, '(?i)\bpreprint\b')::INT + regexp_matches(t, '\\cite\{')::INT + regexp_matches(t, '\[\d+\]')::INT + regexp_matches(t, '(?i)eq\.\s*\d+|equation\s+\d+')::INT + regexp_matches(t, '\d{4}\.\d{4,5}')::INT
+ regexp_matches(t, '(?i)\bwe propose\b')::INT + regexp_matches(t, '(?i)\bliterature\b')::INT)::INTEGER AS signs FROM (SELECT doc_id, substring(text, 1, 3000) AS t FROM documents)""")
def paper_signals(spark, d):
    return table(spark, d, "documents").select("doc_id", paths.paper_signs(F.col("text")).alias("signs"))


@query("""WITH f AS (SELECT regexp_replace(regexp_replace(url, '^.*?://', ''), '[?#].*$', '') AS path, length(html) AS n FROM pages), p AS (SELECT n, string_split(path, '/') AS parts FROM f),
x AS (SELECT n, unnest(range(1, len(parts) + 1)) AS depth, parts FROM p) SELECT array_to_string(parts[1:depth], '/') AS folder, depth::INTEGER AS depth, count(*) AS files, sum(n)::BIGINT AS total FROM x GROUP BY 1, 2""")
def path_tree_rollup(spark, d):
    clean = F.regexp_replace(F.regexp_replace("url", r"^.*?://", ""), r"[?#].*$", "")
    return aggregates.directory_rollup(table(spark, d, "pages").select(clean.alias("path"), F.length("html").cast("long").alias("n")))


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, greatest(1, octet_length(encode(text)) // 4) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
w AS (SELECT source, r, doc_id, 0 AS bin, t AS used FROM o WHERE r = 1 UNION ALL SELECT o.source, o.r, o.doc_id, CASE WHEN used > 0 AND used + t > 4000 THEN bin + 1 ELSE bin END, CASE WHEN used > 0 AND used + t > 4000 THEN t ELSE used + t END FROM w JOIN o ON o.source = w.source AND o.r = w.r + 1)
SELECT source, doc_id::VARCHAR AS id, bin::BIGINT AS bin FROM w""")
def token_packing(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("group"), F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), text.token_estimate(F.col("text")).alias("tokens"))
    return aggregates.packed(docs, 4000).withColumnRenamed("group", "source")


@query("SELECT doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN 'added' ELSE 'changed' END AS state FROM documents WHERE doc_id % 11 = 0 OR doc_id % 7 = 0")
def content_hash_delta(spark, d):
    from arborlake.streaming.changes import content_delta

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    old = docs.where("path % 11 != 0").select("path", F.sha2(F.when(F.col("path") % 7 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")), 256).alias("hash"))
    return content_delta(docs, old).where("state != 'same'").select("path", "state")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_rollup(spark, d):
    from arborlake.streaming.changes import hourly_rollup

    return hourly_rollup(spark, d)


@query(r"SELECT page_id, len(regexp_extract_all(html, '<h[1-6][^>]*>'))::INTEGER AS headings, len(regexp_extract_all(html, '<a [^>]*href='))::INTEGER AS links, len(regexp_extract_all(html, '<p>'))::INTEGER AS paragraphs FROM pages")
def page_outline(spark, d):
    count = lambda p: F.regexp_count("html", F.lit(p))
    return table(spark, d, "pages").select("page_id", count(r"<h[1-6][^>]*>").alias("headings"), count(r"<a [^>]*href=").alias("links"), count("<p>").alias("paragraphs"))


# ---- extraction, sinks and feeds


def _nation_sources(spark, d) -> DataFrame:
    """A Python file for each nation: a class of its region with one method."""
    k, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    body = F.concat(F.lit("import base\n\nclass Nation"), k, F.lit("(Region"), r, F.lit("):\n    def run_"), k, F.lit("(self):\n        return {\n            1: 2\n        }\n\ndef free_"), k, F.lit("():\n    pass\n"))
    return table(spark, d, "nation").select(F.concat(F.lit("src/n"), k, F.lit(".py")).alias("path"), body.alias("content"))


@query("""WITH n AS (SELECT n_nationkey::VARCHAR AS k, n_regionkey::VARCHAR AS r, 'src_n' || n_nationkey || '_py' AS f FROM nation)
SELECT f AS source, f || '_nation' || k AS target, 'contains' AS relation FROM n UNION ALL SELECT f, f || '_free_' || k, 'contains' FROM n UNION ALL SELECT f || '_nation' || k, f || '_run_' || k, 'method' FROM n
UNION ALL SELECT f || '_nation' || k, 'region' || r, 'inherits' FROM n UNION ALL SELECT f, 'base', 'imports' FROM n""")
def extract_python(spark, d):
    from arborlake.extract.structure import extracted

    return extracted(_nation_sources(spark, d), ["python"]).edges.select("source", "target", "relation")


@query("SELECT 'src/n' || n_nationkey || '.py' AS path, unnest([3, 4, 9]) AS line, unnest(['class', 'method', 'function']) AS kind, unnest(['Nation' || n_nationkey, 'run_' || n_nationkey, 'free_' || n_nationkey]) AS name FROM nation")
def outline_lines(spark, d):
    from arborlake.extract.structure import outline

    return outline(_nation_sources(spark, d), ["python"])


@query("SELECT 'src/n' || n_nationkey || '.py' AS path, 'run_' || n_nationkey AS name, 4 AS line, 7 AS \"end\" FROM nation")
def method_end_running_sum(spark, d):
    from arborlake.extract.structure import method_ranges, outline
    from arborlake.sources.files import lines

    files = _nation_sources(spark, d)
    return method_ranges(lines(files), outline(files, ["python"]).where("kind = 'method'").select("path", "name", "line"))


@query("""WITH $T SELECT 'CREATE (:Node {id: ''' || id || ''', label: ''' || label || ''', file_type: ''' || file_type || '''});' AS text FROM g_nodes
UNION ALL SELECT 'MATCH (a:Node {id: ''' || source || '''}), (b:Node {id: ''' || target || '''}) CREATE (a)-[:' || upper(relation) || ']->(b);' FROM g_edges""")
def cypher_lines(spark, d):
    from arborlake.sinks.writers import cypher

    return cypher(trade_graph(spark, d)).select("text")


@query("""WITH $T, p AS (SELECT string_split(source_file, '/') AS parts FROM g_nodes), x AS (SELECT unnest(range(1, len(parts) + 1)) AS depth, parts FROM p)
SELECT array_to_string(parts[1:depth], '/') AS folder, depth::INTEGER AS depth, parts[depth] AS name, count(*) AS total FROM x GROUP BY 1, 2, 3""")
def tree_folders(spark, d):
    from arborlake.sinks.writers import tree

    return tree(trade_graph(spark, d).nodes).where("kind = 'folder'").select("folder", "depth", "name", "total")


@query("""WITH $T, old AS (SELECT * FROM g_edges WHERE target NOT LIKE '%7'), new AS MATERIALIZED (SELECT * FROM g_edges WHERE target NOT LIKE '%3') SELECT 'edge_added' AS type, count(*) AS n FROM (SELECT source, target, relation FROM new EXCEPT SELECT source, target, relation FROM old)
UNION ALL SELECT 'edge_removed', count(*) FROM (SELECT source, target, relation FROM old EXCEPT SELECT source, target, relation FROM new) UNION ALL SELECT 'node_added', count(*) FROM g_nodes WHERE file_type = 'module'""")
def change_feed(spark, d):
    from arborlake.streaming.changes import change_events

    g = trade_graph(spark, d)
    old, new = _snapshots(g)
    return change_events(Graph(g.nodes.where("file_type != 'module'"), old), Graph(g.nodes, new)).groupBy("type").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT ts, event_id, event_type, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id)) < 30000000 THEN 0 ELSE 1 END AS s FROM events),
g AS (SELECT *, sum(s) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT min(ts) AS first_ts, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS paths FROM g GROUP BY g""")
def quiet_batches(spark, d):
    from arborlake.streaming.changes import quiet_batches as batches

    e = table(spark, d, "events").select("ts", F.col("event_type").alias("path"))
    return batches(e, "30 seconds").select("first_ts", F.array_join("paths", ",").alias("paths"))


@query("""WITH p AS (SELECT url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages WHERE regexp_matches(url, '(?i)^https?://[^/:?#]+') AND NOT regexp_matches(url, '(?i)^https?://(localhost|10\\.|127\\.|192\\.168\\.)'))
SELECT url, title FROM p""")
def page_titles(spark, d):
    pages = table(spark, d, "pages")
    return pages.where(paths.is_public_url(F.col("url"))).select("url", text.html_title(F.col("html")).alias("title"))


@query()
def web_documents(spark, d):
    from arborlake.sources.graphs import web_pages

    return web_pages(table(spark, d, "pages"))


@query()
def resolve_tool(spark, d):
    from arborlake.plans import tools

    return tools.resolve(trade_graph(spark, d), "small ring", 5)


@query()
def query_graph_tool(spark, d):
    from arborlake.plans import tools

    return tools.query_graph(trade_graph(spark, d), "which nation imports region", 1, 400)


@query()
def wiki_pages(spark, d):
    from arborlake.sinks.writers import wiki

    return wiki(_with_part_communities(trade_graph(spark, d)))


@query()
def label_embeddings(spark, d):
    g = trade_graph(spark, d)
    embed = vectors.label_vectors(32)
    return g.nodes.select("id", embed(text.label_tokens(F.col("label"))).alias("vector"))
