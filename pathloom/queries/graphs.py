"""Temporal graphs projected from the tables, in Spark and in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.operators.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str) -> Column:
    """Epoch seconds of a time without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} as timestamp_ntz))").cast("bigint")


def _id(prefix: str, column: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def _entities(rows: DataFrame, prefix: str, key: str, kind: str, score: str, dataset: str) -> DataFrame:
    zero = F.lit(0.0)
    return rows.select(_id(prefix, key).alias("id"), F.lit(kind).alias("entity_type"), F.col(score).cast("double").alias("score"), zero.alias("degree_score"), zero.alias("betweenness"), zero.alias("pagerank_score"), F.create_map().cast("map<string,string>").alias("metadata"), F.lit(dataset).alias("dataset_id"))


def _relations(rows: DataFrame, source: Column, dest: Column, kind: str, time: Column, seq: Column, dataset: str) -> DataFrame:
    return rows.select(source.alias("source_id"), dest.alias("dest_id"), F.lit(kind).alias("rel_type"), time.alias("timestamp"), F.create_map().cast("map<string,string>").alias("metadata"), F.lit(dataset).alias("dataset_id"), seq.cast("bigint").alias("seq"))


def order_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Users execute orders (processes), which write parts (files), connect to suppliers (hosts) and spawn the user's next order."""
    t = {x: table(spark, sf_dir, x) for x in ("customer", "orders", "lineitem", "part", "supplier")}
    entities = [
        _entities(t["customer"], "user", "c_custkey", "User", "c_acctbal", "sales"), _entities(t["orders"], "proc", "o_orderkey", "Process", "o_totalprice", "sales"),
        _entities(t["part"], "file", "p_partkey", "File", "p_retailprice", "stock"), _entities(t["supplier"], "host", "s_suppkey", "Host", "s_acctbal", "stock"),
    ]
    orders, lines = t["orders"], t["lineitem"]
    line = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 4
    proc, lproc = _id("proc", "o_orderkey"), _id("proc", "l_orderkey")
    later = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    spawns = orders.select("o_custkey", "o_orderkey", F.lead("o_orderkey").over(later).alias("next"), F.lead("o_orderdate").over(later).alias("at")).where("next is not null")
    relations = [
        _relations(orders, _id("user", "o_custkey"), proc, "Execute", seconds("o_orderdate"), F.col("o_orderkey") * 32, "sales"),
        _relations(lines, lproc, _id("file", "l_partkey"), "Write", seconds("l_shipdate"), line + 1, "stock"),
        _relations(lines, lproc, _id("host", "l_suppkey"), "Connect", seconds("l_shipdate"), line + 2, "stock"),
        _relations(spawns, proc, _id("proc", "next"), "Spawn", seconds("at"), F.col("o_orderkey") * 32 + 3, "sales"),
    ]
    return Graph(reduce(DataFrame.unionByName, entities), reduce(DataFrame.unionByName, relations))


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Users authenticate to event types (hosts), which connect to the number in the properties (an address); errors lead back to the user."""
    rows = table(spark, sf_dir, "events").select("event_id", seconds("ts").alias("t"), _id("user", "user_id").alias("u"), _id("evhost", "event_type").alias("h"), F.concat(F.lit("ip:"), F.get_json_object("props", "$.k")).alias("p"), "event_type")
    names = [("u", "User"), ("h", "Host"), ("p", "IP")]
    entities = [_entities(rows.select(c).distinct().withColumn("s", F.lit(0.0)).withColumnRenamed(c, "k"), "", "k", kind, "s", "web") for c, kind in names]
    entities = [e.withColumn("id", F.substring("id", 2, 1000)) for e in entities]
    key = F.col("event_id") * 4
    relations = [
        _relations(rows, F.col("u"), F.col("h"), "Auth", F.col("t"), key, "web"), _relations(rows, F.col("h"), F.col("p"), "Connect", F.col("t"), key + 1, "web"),
        _relations(rows.where("event_type = 'error'"), F.col("p"), F.col("u"), "Connect", F.col("t"), key + 2, "web"),
    ]
    return Graph(reduce(DataFrame.unionByName, entities), reduce(DataFrame.unionByName, relations))


ORDER_SQL = """
e AS (SELECT 'user:' || c_custkey AS id, 'User' AS entity_type, c_acctbal AS score, 'sales' AS dataset_id FROM customer
  UNION ALL SELECT 'proc:' || o_orderkey, 'Process', o_totalprice, 'sales' FROM orders
  UNION ALL SELECT 'file:' || p_partkey, 'File', p_retailprice, 'stock' FROM part
  UNION ALL SELECT 'host:' || s_suppkey, 'Host', s_acctbal, 'stock' FROM supplier),
r AS (SELECT 'user:' || o_custkey AS source_id, 'proc:' || o_orderkey AS dest_id, 'Execute' AS rel_type, (epoch_us(o_orderdate) // 1000000) AS "timestamp", 'sales' AS dataset_id, o_orderkey * 32 AS seq FROM orders
  UNION ALL SELECT 'proc:' || l_orderkey, 'file:' || l_partkey, 'Write', (epoch_us(l_shipdate) // 1000000), 'stock', (l_orderkey * 8 + l_linenumber) * 4 + 1 FROM lineitem
  UNION ALL SELECT 'proc:' || l_orderkey, 'host:' || l_suppkey, 'Connect', (epoch_us(l_shipdate) // 1000000), 'stock', (l_orderkey * 8 + l_linenumber) * 4 + 2 FROM lineitem
  UNION ALL SELECT 'proc:' || o_orderkey, 'proc:' || nxt, 'Spawn', (epoch_us(due) // 1000000), 'sales', o_orderkey * 32 + 3 FROM (
    SELECT o_orderkey, lead(o_orderkey) OVER w AS nxt, lead(o_orderdate) OVER w AS due FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE nxt IS NOT NULL)"""
EVENT_SQL = """
b AS (SELECT event_id, (epoch_us(ts) // 1000000) AS t, 'user:' || user_id AS u, 'evhost:' || event_type AS h, 'ip:' || (props ->> '$.k') AS p, event_type FROM events),
e AS (SELECT DISTINCT u AS id, 'User' AS entity_type, 0.0 AS score, 'web' AS dataset_id FROM b UNION ALL SELECT DISTINCT h, 'Host', 0.0, 'web' FROM b UNION ALL SELECT DISTINCT p, 'IP', 0.0, 'web' FROM b),
r AS (SELECT u AS source_id, h AS dest_id, 'Auth' AS rel_type, t AS "timestamp", event_id * 4 AS seq FROM b UNION ALL SELECT h, p, 'Connect', t, event_id * 4 + 1 FROM b
  UNION ALL SELECT p, u, 'Connect', t, event_id * 4 + 2 FROM b WHERE event_type = 'error')"""
