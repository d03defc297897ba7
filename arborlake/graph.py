"""The property graph: two DataFrames and a direction flag, and the views of the relational tables as graphs."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.storage import parts_for

NODE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("label", T.StringType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("source_location", T.StringType()),
        T.StructField("community", T.LongType()),
        T.StructField("rationale", T.StringType()),
        T.StructField("docstring", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ord", T.LongType()),
    ]
)
EDGE_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("target", T.StringType(), False),
        T.StructField("relation", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("context", T.StringType()),
        T.StructField("ord", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Graph:
    """nodes: id, label, file_type, source_file, community, ord at least; edges: source, target, relation, confidence, context, weight."""

    nodes: DataFrame
    edges: DataFrame
    directed: bool = False

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)

    def steps(self, reverse: bool = False) -> DataFrame:
        """at, to, relation: one row for each way an edge can be walked."""
        forward = self.edges.select(F.col("source").alias("at"), F.col("target").alias("to"), "relation")
        back = self.edges.select(F.col("target").alias("at"), F.col("source").alias("to"), "relation")
        if self.directed:
            return back if reverse else forward
        return forward.unionByName(back)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bytes(df: DataFrame) -> int:
    """The size of a table's files, as Spark knows it without a job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers, suppliers and parts as nodes; belonging and supply as edges."""
    region, nation, customer, supplier, part, lineitem = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "part", "lineitem"))
    home = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))

    def node(df: DataFrame, kind: str, key: str, label: str, file_type: str, source, community, rank: int) -> DataFrame:
        return df.select(
            F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.col(label).alias("label"), F.lit(file_type).alias("file_type"),
            source.alias("source_file"), community.cast("long").alias("community"), (F.lit(rank * 10**9) + F.col(key)).cast("long").alias("ord"),
        )

    at = lambda df, key: df.join(nation.select("n_nationkey", "n_regionkey"), F.col(key) == F.col("n_nationkey"))
    geo = F.concat(F.lit("geo/"), F.col("r_name"))
    nodes = [
        node(region, "region", "r_regionkey", "r_name", "module", geo, F.col("r_regionkey"), 0),
        node(home, "nation", "n_nationkey", "n_name", "class", geo, F.col("n_regionkey"), 1),
        node(at(customer, "c_nationkey"), "customer", "c_custkey", "c_name", "struct", F.concat(F.lit("crm/"), F.col("c_mktsegment"), F.lit(".py")), F.col("n_regionkey"), 2),
        node(at(supplier, "s_nationkey"), "supplier", "s_suppkey", "s_name", "struct", F.concat(F.lit("sup/"), F.col("s_nationkey").cast("string"), F.lit(".go")), F.col("n_regionkey"), 3),
        node(part, "part", "p_partkey", "p_name", "class", F.concat(F.lit("cat/"), F.col("p_brand"), F.lit(".rs")), F.lit(None), 4),
    ]

    def edge(df: DataFrame, a: str, ak: str, b: str, bk: str, relation: str) -> DataFrame:
        return df.select(
            F.concat(F.lit(f"{a}:"), F.col(ak).cast("string")).alias("source"), F.concat(F.lit(f"{b}:"), F.col(bk).cast("string")).alias("target"),
            F.lit(relation).alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(None).cast("string").alias("context"), F.lit(1.0).alias("weight"),
        )

    parts = parts_for(_bytes(lineitem), 2 << 20)  # a lineitem takes some 12 to 18 bytes
    supply = lineitem.repartition(parts, "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"), F.min("l_discount").alias("d"))
    calls = supply.select(
        F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target"),
        F.lit("calls").alias("relation"), F.when(F.col("d") < 0.05, "EXTRACTED").otherwise("INFERRED").alias("confidence"), F.lit("call").alias("context"), F.col("q").alias("weight"),
    )
    edges = [
        edge(nation, "nation", "n_nationkey", "region", "n_regionkey", "inherits"),
        edge(customer, "customer", "c_custkey", "nation", "c_nationkey", "imports"),
        edge(supplier, "supplier", "s_suppkey", "nation", "s_nationkey", "imports"),
        calls,
    ]
    every = nodes[0]
    for more in nodes[1:]:
        every = every.unionByName(more)
    links = edges[0]
    for more in edges[1:]:
        links = links.unionByName(more)
    return Graph(every, links)


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Event types as nodes; a user's next event as an edge, weighed by how often it comes."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = events.select(F.col("event_type").alias("source"), F.lead("event_type").over(order).alias("target")).where("target is not null")
    edges = pairs.groupBy("source", "target").agg(F.count("*").cast("double").alias("weight")).select(
        "source", "target", F.lit("next").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(None).cast("string").alias("context"), "weight"
    )
    nodes = events.select(F.col("event_type").alias("id")).distinct().select(
        "id", F.col("id").alias("label"), F.lit("code").alias("file_type"), F.lit("events").alias("source_file"), F.lit(None).cast("long").alias("community"), F.xxhash64("id").alias("ord")
    )
    return Graph(nodes, edges, directed=True)


#: The same graphs in SQL: names g_nodes, g_edges (trade) and e_edges (events).
TRADE_SQL = """
g_nodes AS (
  SELECT 'region:' || r_regionkey AS id, r_name AS label, 'module' AS file_type, 'geo/' || r_name AS source_file, r_regionkey::BIGINT AS community, r_regionkey::BIGINT AS ord FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'class', 'geo/' || r_name, n_regionkey, 1000000000 + n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'struct', 'crm/' || c_mktsegment || '.py', n_regionkey, 2000000000 + c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'struct', 'sup/' || s_nationkey || '.go', n_regionkey, 3000000000 + s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'class', 'cat/' || p_brand || '.rs', NULL, 4000000000 + p_partkey FROM part
), g_edges AS (
  SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'inherits' AS relation, 'EXTRACTED' AS confidence, NULL::VARCHAR AS context, 1.0::DOUBLE AS weight FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'imports', 'EXTRACTED', NULL, 1.0 FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'imports', 'EXTRACTED', NULL, 1.0 FROM supplier
  UNION ALL SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'calls', CASE WHEN min(l_discount) < 0.05 THEN 'EXTRACTED' ELSE 'INFERRED' END, 'call', sum(l_quantity)
    FROM lineitem GROUP BY l_suppkey, l_partkey
)"""
EVENT_SQL = """
e_edges AS (
  SELECT source, target, 'next' AS relation, count(*)::DOUBLE AS weight FROM (
    SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events
  ) WHERE target IS NOT NULL GROUP BY source, target
), e_nodes AS (SELECT DISTINCT event_type AS id FROM events)"""
