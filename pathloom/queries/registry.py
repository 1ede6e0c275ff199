"""Every query by name, and its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.times import event_log_seconds, generic_seconds
from pathloom.operators import anomaly, explore, scoring
from pathloom.operators import graph as graphs
from pathloom.operators import paths as ranking
from pathloom.operators.tensors import tensors
from pathloom.plans import hunt
from pathloom.plans.pattern import CATALOG, Hypothesis, parse
from pathloom.queries import rules
from pathloom.queries.graphs import EVENT_SQL, ORDER_SQL, event_graph, order_graph, seconds, table
from pathloom.schema import ANY
from pathloom.sources import cloud_triples, csv, generic_triples, mixed_lines, ndjson, read_logs, records_of, triples_of, windows_triples
from pathloom.sources.preview import profile, proposed_mapping
from pathloom.sources.provenance import cdm, streamspot, threat_labels
from pathloom.sources.records import spread
from pathloom.sources.siem import elastic_records, log_analytics_records
from pathloom.sources.triples import SLOTS
from pathloom.storage import shared_folder
from pathloom.streaming.ingest import GraphSink, stream_logs, windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

JANUARY_10 = (1704844800, 1704931199)  # 2024-01-10
FLAGSHIP = "User -[Execute]-> Process -[Write]-> File"
SPAWNED = "User -[Execute]-> Process -[Spawn]-> Process -[Write]-> File"
ROUND_TRIP = "User -[Auth]-> Host -[Connect]-> IP -[Connect]-> User {k=2}"


def query(sql: str | None = None, base: str | None = None):
    """Register a function under its name; base is the graph whose tables the SQL reads."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH {base}\n{sql}" if base else sql
        return f

    return put


def hunt_sql(pattern: str | Hypothesis, window: tuple[int, int] | None = None, more: str = "") -> str:
    """The self-join that a hunt stands for."""
    h = parse(pattern) if isinstance(pattern, str) else pattern
    n = len(h.steps)
    parts, where = ["r AS r1"], []
    for i, s in enumerate(h.steps, 1):
        if i > 1:
            parts.append(f"JOIN r AS r{i} ON r{i}.source_id = r{i - 1}.dest_id AND r{i}.\"timestamp\" >= r{i - 1}.\"timestamp\"")
        if s.relation != ANY:
            where.append(f"r{i}.rel_type = '{s.relation}'")
        if s.dest != ANY:
            parts.append(f"JOIN e AS e{i} ON e{i}.id = r{i}.dest_id AND e{i}.entity_type = '{s.dest}'")
        if window:
            where.append(f"r{i}.\"timestamp\" BETWEEN {window[0]} AND {window[1]}")
        visits = " + ".join(f"(r{i}.dest_id = {x})::INT" for x in ["r1.source_id", *(f"r{j}.dest_id" for j in range(1, i))])
        where.append(f"{visits} < {max(1, h.k)}")
    first = "" if h.steps[0].origin == ANY else f" AND e0.entity_type = '{h.steps[0].origin}'"
    parts.append(f"JOIN e AS e0 ON e0.id = r1.source_id{first}")
    columns = ["r1.source_id AS n0", *(f"r{i}.dest_id AS n{i}" for i in range(1, n + 1)), *(f"r{i}.\"timestamp\" AS t{i}" for i in range(1, n + 1))]
    return f"SELECT {', '.join(columns)} FROM {' '.join(parts)} WHERE {' AND '.join(where)} {more}"


def _paths(spark: SparkSession, sf_dir: str, pattern: str, window: tuple[int, int] | None = None, of=order_graph) -> DataFrame:
    g = of(spark, sf_dir)
    return hunt.paths(g.entities, g.relations, parse(pattern), window)


# Hunts


@query(hunt_sql(FLAGSHIP), ORDER_SQL)
def hunt_execute_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir, FLAGSHIP)


@query(hunt_sql(FLAGSHIP, (820454400, 852076800)), ORDER_SQL)
def hunt_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir, FLAGSHIP, (820454400, 852076800))


@query(hunt_sql("User -[*]-> *"), ORDER_SQL)
def hunt_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir, "User -[*]-> *")


@query(hunt_sql(SPAWNED), ORDER_SQL)
def hunt_spawned_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir, SPAWNED)


@query(hunt_sql("* -[Spawn]-> Process -[Spawn]-> Process -[Connect]-> Host"), ORDER_SQL)
def hunt_spawn_connect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir, "* -[Spawn]-> Process -[Spawn]-> Process -[Connect]-> Host")


@query(hunt_sql("User -[Auth]-> Host -[Connect]-> IP", JANUARY_10), EVENT_SQL)
def hunt_hub_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir, "User -[Auth]-> Host -[Connect]-> IP", JANUARY_10, event_graph)


@query(hunt_sql(ROUND_TRIP, (1704844800, 1704866400)), EVENT_SQL)
def hunt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir, ROUND_TRIP, (1704844800, 1704866400), event_graph)


@query(hunt_sql(FLAGSHIP, more="ORDER BY n0, n1, n2, t1, t2 LIMIT 500"), ORDER_SQL)
def hunt_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hunt.capped(_paths(spark, sf_dir, FLAGSHIP), 500, ordered=True)[0]


@query(" UNION ALL ".join(f"SELECT '{c.id}' AS catalog_id, count(*) AS n FROM ({hunt_sql(c.hypothesis())})" for c in CATALOG), ORDER_SQL)
def hunt_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = order_graph(spark, sf_dir)
    rows = [hunt.paths(g.entities, g.relations, c.hypothesis()).agg(F.count("*").alias("n")).select(F.lit(c.id).alias("catalog_id"), "n") for c in CATALOG]
    return reduce(DataFrame.unionAll, rows)


@query(hunt_sql("Process -[Spawn]-> Process -[Connect]-> Host"), ORDER_SQL)
def hunt_untyped_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = order_graph(spark, sf_dir)
    return hunt.untyped_walks(g.relations, g.entities, parse("Process -[Spawn]-> Process -[Connect]-> Host"))


@query(
    f"""SELECT 1::BIGINT AS level, count(*) AS examined, count(*) FILTER (rel_type <> 'Execute') AS rejected_relation, 0::BIGINT AS rejected_entity, 0::BIGINT AS rejected_time,
  count(*) FILTER (rel_type = 'Execute' AND "timestamp" NOT BETWEEN 820454400 AND 883612800) AS rejected_window, 0::BIGINT AS rejected_k, count(*) FILTER (rel_type = 'Execute' AND "timestamp" BETWEEN 820454400 AND 883612800) AS passed
FROM r WHERE source_id LIKE 'user:%'
UNION ALL SELECT 2, count(*), count(*) FILTER (b.rel_type <> 'Write'), 0, count(*) FILTER (b.rel_type = 'Write' AND b."timestamp" < a."timestamp"),
  count(*) FILTER (b.rel_type = 'Write' AND b."timestamp" >= a."timestamp" AND b."timestamp" NOT BETWEEN 820454400 AND 883612800), 0, count(*) FILTER (b.rel_type = 'Write' AND b."timestamp" >= a."timestamp" AND b."timestamp" BETWEEN 820454400 AND 883612800)
FROM ({hunt_sql("User -[Execute]-> Process", (820454400, 883612800)).replace("AS t1", 'AS "timestamp"')}) a JOIN r b ON a.n1 = b.source_id""",
    ORDER_SQL,
)
def hunt_instrumented(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = order_graph(spark, sf_dir)
    return hunt.instrumented(g.entities, g.relations, parse(FLAGSHIP), (820454400, 883612800))


# Lookups and exploration


@query("SELECT id, entity_type, round(score, 6) AS score, coalesce(n, 0)::BIGINT AS connections FROM (SELECT * FROM e WHERE contains(lower(id), 'oc:12') AND entity_type = 'Process' ORDER BY id LIMIT 50) LEFT JOIN (SELECT id AS i, count(*) AS n FROM (SELECT source_id AS id FROM r UNION ALL SELECT dest_id FROM r) GROUP BY 1) ON i = id", ORDER_SQL)
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explore.search(order_graph(spark, sf_dir), "OC:12", "Process", 50)
    return rows.select("id", "entity_type", F.round("score", 6).alias("score"), "connections")


@query("SELECT source_id, dest_id, rel_type, \"timestamp\" FROM r WHERE source_id = 'proc:7'", ORDER_SQL)
def outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.outgoing(order_graph(spark, sf_dir), "proc:7").select("source_id", "dest_id", "rel_type", "timestamp")


@query("SELECT source_id FROM r WHERE dest_id = 'file:5'", ORDER_SQL)
def sources_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.sources_of(order_graph(spark, sf_dir), "file:5")


@query("SELECT id FROM e WHERE entity_type = 'File' ORDER BY id LIMIT 25 OFFSET 50", ORDER_SQL)
def ids_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.ids_of_type(order_graph(spark, sf_dir), "File", 50, 25)


@query("SELECT source_id AS id FROM r WHERE rel_type = 'Connect' UNION SELECT dest_id FROM r WHERE rel_type = 'Connect'", ORDER_SQL)
def ids_by_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.ids_by_relation(order_graph(spark, sf_dir), "Connect")


@query("SELECT source_id, dest_id, rel_type, \"timestamp\", 'out' AS direction FROM r WHERE source_id = 'proc:7' UNION ALL SELECT source_id, dest_id, rel_type, \"timestamp\", 'in' FROM r WHERE dest_id = 'proc:7'", ORDER_SQL)
def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.events_of(order_graph(spark, sf_dir), "proc:7").select("source_id", "dest_id", "rel_type", "timestamp", "direction")


@query("SELECT r.source_id, r.dest_id, r.rel_type, r.\"timestamp\" FROM r WHERE source_id IN (SELECT id FROM e WHERE score > 400000 OR entity_type = 'File') AND dest_id IN (SELECT id FROM e WHERE score > 400000 OR entity_type = 'File')", ORDER_SQL)
def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = order_graph(spark, sf_dir)
    return explore.subgraph(g, g.entities.where("score > 400000 or entity_type = 'File'").select("id")).relations.select("source_id", "dest_id", "rel_type", "timestamp")


@query(
    """, n1 AS (SELECT DISTINCT id, 1 AS hop FROM (SELECT dest_id AS id FROM r WHERE source_id = 'user:1' UNION ALL SELECT source_id FROM r WHERE dest_id = 'user:1') ORDER BY id LIMIT 59),
n2 AS (SELECT DISTINCT id, 2 AS hop FROM (SELECT dest_id AS id FROM r WHERE source_id IN (SELECT id FROM n1) UNION ALL SELECT source_id FROM r WHERE dest_id IN (SELECT id FROM n1)) WHERE id <> 'user:1' AND id NOT IN (SELECT id FROM n1))
SELECT id, entity_type FROM e WHERE id = 'user:1' OR id IN (SELECT id FROM n1) OR id IN (SELECT id FROM n2 ORDER BY id LIMIT (SELECT 59 - count(*) FROM n1))""",
    ORDER_SQL,
)
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.neighbourhood(order_graph(spark, sf_dir), "user:1", 2, 60).entities.select("id", "entity_type")


@query("SELECT DISTINCT entity_type FROM e WHERE id IN (SELECT dest_id FROM r WHERE source_id = 'proc:7' UNION SELECT source_id FROM r WHERE dest_id = 'proc:7')", ORDER_SQL)
def neighbour_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.neighbour_types(order_graph(spark, sf_dir), "proc:7")


# Aggregates


@query("SELECT (SELECT count(*) FROM e) AS entities, (SELECT count(*) FROM r) AS relations", ORDER_SQL)
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.counts(order_graph(spark, sf_dir))


@query("SELECT entity_type, count(*) AS n FROM e GROUP BY 1", ORDER_SQL)
def entity_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.entity_type_counts(order_graph(spark, sf_dir))


@query("SELECT entity_type, count(*) AS n FROM e WHERE dataset_id = 'stock' GROUP BY 1", ORDER_SQL)
def entity_types_in_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.entity_type_counts(order_graph(spark, sf_dir), "stock")


@query('SELECT rel_type, "timestamp" - "timestamp" % 3600 AS hour, count(*) AS n FROM r GROUP BY 1, 2', EVENT_SQL)
def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.heatmap(event_graph(spark, sf_dir))


@query('SELECT entity_type, hour, n, min(lo) OVER w AS "first", max(hi) OVER w AS "last" FROM (SELECT entity_type, "timestamp" - "timestamp" % 3600 AS hour, count(*) AS n, min("timestamp") AS lo, max("timestamp") AS hi FROM r JOIN e ON id = source_id GROUP BY 1, 2) WINDOW w AS (PARTITION BY entity_type)', EVENT_SQL)
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.timeline(event_graph(spark, sf_dir))


@query("SELECT id, entity_type, round(score, 6) AS score FROM (SELECT * FROM e ORDER BY score DESC, id LIMIT 10) WHERE score > 0", ORDER_SQL)
def top_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.top_entities(order_graph(spark, sf_dir)).select("id", "entity_type", F.round("score", 6).alias("score"))


@query('SELECT (SELECT count(*) FROM e) AS entities, (SELECT count(*) FROM r) AS relations, min("timestamp") FILTER ("timestamp" <> 0) AS "first", max("timestamp") FILTER ("timestamp" <> 0) AS "last" FROM r', ORDER_SQL)
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.summary(order_graph(spark, sf_dir)).select("entities", "relations", "first", "last")


@query("SELECT 'proc:7' AS id, count(*) FILTER (d = 'in') AS in_degree, count(*) FILTER (d = 'out') AS out_degree, min(t) AS \"first\", max(t) AS \"last\", count(DISTINCT o) AS unique_neighbours FROM (SELECT dest_id AS o, \"timestamp\" AS t, 'out' AS d FROM r WHERE source_id = 'proc:7' UNION ALL SELECT source_id, \"timestamp\", 'in' FROM r WHERE dest_id = 'proc:7')", ORDER_SQL)
def node_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.node_details(order_graph(spark, sf_dir), "proc:7").select("id", "in_degree", "out_degree", "first", "last", "unique_neighbours")


@query("SELECT (SELECT count(*) FROM e) AS n, (SELECT count(DISTINCT entity_type) FROM e) AS entity_types, count(*) AS m, count(DISTINCT rel_type) AS relation_types, (SELECT max(c) FROM (SELECT count(*) AS c FROM r GROUP BY source_id)) AS max_out_degree, round(count(*) / (SELECT count(*) FROM e), 6) AS mean_out_degree FROM r", ORDER_SQL)
def graph_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.graph_parameters(order_graph(spark, sf_dir)).withColumn("mean_out_degree", F.round("mean_out_degree", 6))


CUTOFF = 1705708800
_COMPACT = f'g AS (SELECT source_id, dest_id, rel_type, count(*) AS n, min("timestamp") AS lo, max("timestamp") AS hi FROM r GROUP BY 1, 2, 3), o AS (SELECT * FROM g WHERE hi < {CUTOFF} AND n > 1)'


@query('SELECT r.source_id, r.dest_id, r.rel_type, r."timestamp", NULL::VARCHAR AS compacted_count FROM r ANTI JOIN o USING (source_id, dest_id, rel_type) UNION ALL SELECT source_id, dest_id, rel_type, lo, n::VARCHAR FROM o', f"{EVENT_SQL}, {_COMPACT}")
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _ = graphs.compact(event_graph(spark, sf_dir), CUTOFF)
    return g.relations.select("source_id", "dest_id", "rel_type", "timestamp", F.try_element_at("metadata", F.lit("compacted_count")).alias("compacted_count"))


@query("SELECT (SELECT count(*) FROM r) AS edges_before, (SELECT count(*) FROM r) - coalesce(sum(n - 1), 0)::BIGINT AS edges_after, coalesce(sum(n - 1), 0)::BIGINT AS edges_removed, count(*) AS groups_compacted FROM o", f"{EVENT_SQL}, {_COMPACT}")
def compaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.compact(event_graph(spark, sf_dir), CUTOFF)[1]


# Data sets


@query("SELECT source_id, dest_id, rel_type, \"timestamp\" FROM r WHERE dataset_id <> 'stock' AND source_id NOT IN (SELECT id FROM e WHERE dataset_id = 'stock') AND dest_id NOT IN (SELECT id FROM e WHERE dataset_id = 'stock')", ORDER_SQL)
def remove_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.remove_dataset(order_graph(spark, sf_dir), "stock")[0].relations.select("source_id", "dest_id", "rel_type", "timestamp")


@query("SELECT CASE WHEN dataset_id = 'stock' AND entity_type = 'File' THEN 'Artifact' ELSE entity_type END AS entity_type, count(*) AS n FROM e GROUP BY 1", ORDER_SQL)
def rename_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.entity_type_counts(graphs.rename_type(order_graph(spark, sf_dir), "stock", "File", "Artifact")[0])


@query("SELECT source_id, dest_id, rel_type FROM r WHERE source_id NOT IN (SELECT id FROM e WHERE score >= 500) OR dest_id NOT IN (SELECT id FROM e WHERE score >= 500)", ORDER_SQL)
def dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = order_graph(spark, sf_dir)
    return graphs.dangling(graphs.Graph(g.entities.where("score >= 500"), g.relations)).select("source_id", "dest_id", "rel_type")


# Scores

_DEGREE = "d AS (SELECT id, coalesce(n, 0)::DOUBLE AS n FROM e LEFT JOIN (SELECT x, count(*) AS n FROM (SELECT source_id AS x FROM r UNION ALL SELECT dest_id FROM r) GROUP BY 1) ON x = id)"


@query("SELECT id, round(n / (SELECT max(n) FROM d) * 100, 6) AS degree_score FROM d", f"{ORDER_SQL}, {_DEGREE}")
def degree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.degree_scores(order_graph(spark, sf_dir)).select("id", F.round("degree_score", 6).alias("degree_score"))


_RANK_ROUNDS, _DECAY = 3, 1e-8
_RANK = (
    f"c AS (SELECT count(*) AS n FROM e), w AS (SELECT source_id AS s, dest_id AS d, sum(exp(-{_DECAY} * greatest((SELECT max(\"timestamp\") FROM r) - \"timestamp\", 0))) AS w FROM r GROUP BY 1, 2), "
    "o AS (SELECT s, sum(w) AS total FROM w GROUP BY 1), k AS (SELECT w.s, w.d, w.w / o.total AS share FROM w JOIN o ON w.s = o.s), p0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM e, c)"
    + "".join(f", p{i} AS (SELECT p.id, 0.15 / n + 0.85 * coalesce(g.got, 0) + 0.85 * (SELECT coalesce(sum(r), 0) FROM p{i - 1} WHERE id NOT IN (SELECT s FROM o)) / n AS r FROM p{i - 1} p CROSS JOIN c LEFT JOIN (SELECT k.d, sum(k.share * q.r) AS got FROM k JOIN p{i - 1} q ON q.id = k.s GROUP BY 1) g ON g.d = p.id)" for i in range(1, _RANK_ROUNDS + 1))
)


@query(f"SELECT id, round(r / (SELECT max(r) FROM p{_RANK_ROUNDS}) * 100, 6) AS pagerank_score FROM p{_RANK_ROUNDS}", f"{ORDER_SQL}, {_RANK}")
def temporal_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.temporal_pagerank(order_graph(spark, sf_dir), _DECAY, rounds=_RANK_ROUNDS).select("id", F.round("pagerank_score", 6).alias("pagerank_score"))


@query()
def temporal_pagerank_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.temporal_pagerank(order_graph(spark, sf_dir), _DECAY).select("id", F.round("pagerank_score", 6).alias("pagerank_score"))


@query()
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.betweenness(order_graph(spark, sf_dir)).select("id", F.round("betweenness", 6).alias("betweenness"))


@query("SELECT id, round(CASE WHEN (SELECT max(t) FROM x) > 0 THEN t / (SELECT max(t) FROM x) * 100 ELSE 0 END, 6) AS score FROM x", f"{ORDER_SQL}, {_DEGREE}, x AS (SELECT d.id, 2.0 * n + 0.5 * score AS t FROM d JOIN e ON e.id = d.id)")
def composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = order_graph(spark, sf_dir)
    n = explore.degrees(g.relations).select("id", (F.col("in_degree") + F.col("out_degree")).cast("double").alias("n"))
    rows = g.entities.select("id", F.col("score").alias("pagerank_score"), F.lit(0.0).alias("betweenness")).join(n, "id", "left").select("id", F.coalesce("n", F.lit(0.0)).alias("degree_score"), "pagerank_score", "betweenness")
    return scoring.composite(rows, 2.0, 0.5, 0.0).select("id", F.round("score", 6).alias("score"))


_SEEN = """f AS (SELECT id, count(*) AS freq, coalesce(min(t) FILTER (t > 0), 0) AS first_seen FROM (SELECT source_id AS id, "timestamp" AS t FROM r UNION ALL SELECT dest_id, "timestamp" FROM r) GROUP BY 1),
pf AS (SELECT source_id, dest_id, count(*) AS freq FROM r GROUP BY 1, 2)"""
_CONC = """nt AS (SELECT x.id, entity_type, count(*) AS n FROM (SELECT source_id AS id, dest_id AS o FROM r UNION ALL SELECT dest_id, source_id FROM r) x JOIN e ON e.id = x.o GROUP BY 1, 2),
nc AS (SELECT e.id, coalesce(CASE WHEN k <= 1 THEN 1.0 ELSE greatest(least(1 - h / log2(k), 1.0), 0.0) END, 1.0) AS nc FROM e LEFT JOIN (SELECT id, count(*) AS k, -sum(n / tot * log2(n / tot)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY id) AS tot FROM nt) GROUP BY 1) q ON q.id = e.id)"""
_EST = """st AS (SELECT ln(max(freq)) AS le, min(first_seen) FILTER (first_seen > 0) AS t0, max(first_seen) FILTER (first_seen > 0) AS t1, (SELECT ln(max(freq)) FROM pf) AS lp FROM f),
ns AS (SELECT e.id, CASE WHEN le > 0 THEN greatest(least(1 - ln(coalesce(freq, 1)) / le, 1.0), 0.0) ELSE 0 END AS er, nc, CASE WHEN first_seen > 0 AND t1 > t0 THEN (first_seen - t0) / (t1 - t0) ELSE 0 END AS tn FROM e LEFT JOIN f ON f.id = e.id JOIN nc ON nc.id = e.id CROSS JOIN st),
ne AS (SELECT *, (0.25 * er + 0.25 * nc + 0.2 * tn) / 0.7 AS estimate FROM ns),
pe AS (SELECT source_id, dest_id, CASE WHEN lp > 0 THEN greatest(least(1 - ln(freq) / lp, 1.0), 0.0) ELSE 0 END AS rarity, CASE WHEN lp > 0 THEN greatest(least(1 - ln(freq) / lp, 1.0), 0.0) ELSE 0.5 END AS estimate FROM pf CROSS JOIN st)"""
_ALL = f"{EVENT_SQL}, {_SEEN}, {_CONC}, {_EST}"


@query("SELECT id, freq, first_seen FROM f", f"{EVENT_SQL}, {_SEEN}")
def entity_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.observe(event_graph(spark, sf_dir).relations).entities.select("id", "freq", "first_seen")


@query("SELECT source_id, dest_id, freq FROM pf", f"{EVENT_SQL}, {_SEEN}")
def pair_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves, observed apart and merged."""
    r = event_graph(spark, sf_dir).relations
    return anomaly.observe(r.where("seq % 8 < 4")).merge(anomaly.observe(r.where("seq % 8 >= 4"))).pairs


@query("SELECT id, round(nc, 6) AS nc FROM nc", f"{ORDER_SQL}, {_CONC}")
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.concentration(order_graph(spark, sf_dir)).select("id", F.round("nc", 6).alias("nc"))


@query("SELECT id, round(er, 6) AS er, round(nc, 6) AS nc, round(tn, 6) AS tn, round(estimate, 6) AS estimate FROM ne", _ALL)
def node_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = anomaly.finalize(event_graph(spark, sf_dir)).nodes
    return rows.select("id", *(F.round(c, 6).alias(c) for c in ("er", "nc", "tn", "estimate")))


@query("SELECT source_id, dest_id, round(estimate, 6) AS estimate FROM pe", _ALL)
def pair_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.finalize(event_graph(spark, sf_dir)).pairs.select("source_id", "dest_id", F.round("estimate", 6).alias("estimate"))


_DAY = hunt_sql("User -[Auth]-> Host -[Connect]-> IP", (1704844800, 1704880800))


@query(
    f"SELECT p.*, round((a0.estimate + a1.estimate / 2 + b1.estimate / 2 + a2.estimate / 2 + b2.estimate / 2) / 3, 6) AS anomaly FROM ({_DAY}) p JOIN ne a0 ON a0.id = n0 JOIN ne a1 ON a1.id = n1 JOIN ne a2 ON a2.id = n2 JOIN pe b1 ON b1.source_id = n0 AND b1.dest_id = n1 JOIN pe b2 ON b2.source_id = n1 AND b2.dest_id = n2 ORDER BY round(anomaly, 9) DESC, n0, n1, n2, t1, t2 LIMIT 50",
    _ALL,
)
def hunt_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = event_graph(spark, sf_dir)
    s = anomaly.finalize(g)
    return hunt.ranked_hunt(g.entities, g.relations, parse("User -[Auth]-> Host -[Connect]-> IP"), s.nodes, s.pairs, 50, (1704844800, 1704880800), digits=6)


@query(
    f"SELECT p.*, round((0.25 * (a0.er + a1.er + a2.er) / 3 + 0.3 * (b1.rarity + b2.rarity) / 2 + 0.25 * (a0.nc + a1.nc + a2.nc) / 3 + 0.2 * (a0.tn + a1.tn + a2.tn) / 3), 6) AS anomaly FROM ({_DAY}) p JOIN ne a0 ON a0.id = n0 JOIN ne a1 ON a1.id = n1 JOIN ne a2 ON a2.id = n2 JOIN pe b1 ON b1.source_id = n0 AND b1.dest_id = n1 JOIN pe b2 ON b2.source_id = n1 AND b2.dest_id = n2",
    _ALL,
)
def path_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = event_graph(spark, sf_dir)
    return anomaly.scored_hunt(g, parse("User -[Auth]-> Host -[Connect]-> IP"), anomaly.finalize(g), (1704844800, 1704880800), digits=6)


@query(
    f"""SELECT * FROM (SELECT p.*, greatest(a0.score, a1.score, a2.score) AS max_score, round(a0.score + a1.score + a2.score, 6) AS total_score, least(s1.lo, s2.lo) AS first_time, greatest(s1.hi, s2.hi) AS last_time, n0 || ' -> ' || n1 || ' -> ' || n2 AS chain
FROM ({hunt_sql(FLAGSHIP, (820454400, 823132800))}) p JOIN e a0 ON a0.id = n0 JOIN e a1 ON a1.id = n1 JOIN e a2 ON a2.id = n2
JOIN sp s1 ON s1.source_id = n0 AND s1.dest_id = n1 JOIN sp s2 ON s2.source_id = n1 AND s2.dest_id = n2) WHERE max_score >= 1000 ORDER BY max_score DESC, total_score DESC, n0, n1, n2, t1, t2 LIMIT 20 OFFSET 20""",
    f'{ORDER_SQL}, sp AS (SELECT source_id, dest_id, min("timestamp") FILTER ("timestamp" <> 0) AS lo, max("timestamp") FILTER ("timestamp" <> 0) AS hi FROM r GROUP BY 1, 2)',
)
def path_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = order_graph(spark, sf_dir)
    found = hunt.paths(g.entities, g.relations, parse(FLAGSHIP), (820454400, 823132800))
    rows = ranking.scored(found, g).withColumn("total_score", F.round("total_score", 6))
    return ranking.page(rows, 1, 20, 1000)[0].drop("anomaly")


@query("SELECT vec_id, round(1 - exp(embedding[1]) / (exp(embedding[1]) + exp(embedding[2]) + exp(embedding[3]) + exp(embedding[4]) + exp(embedding[5])), 6) AS threat FROM embeddings")
def threat_of_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(anomaly.threat_of_logits(logits), 6).alias("threat"))


@query()
def subgraph_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = event_graph(spark, sf_dir)
    rows = tensors(g, g.entities.where("entity_type = 'User'").select("id"), hops=2)
    return rows.select("id", F.size("features").alias("n"), F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


# Sources: the tables written as logs and parsed again


def _rendered(rows: DataFrame, text) -> DataFrame:
    return spread(rows.select(F.col("event_id").alias("rec"), text.alias("value")))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumns({"t": seconds("ts"), "k": F.get_json_object("props", "$.k")})


_TRIPLE = ("src_id", "src_type", "rel_type", "dst_id", "dst_type", "timestamp")
_B = "b AS (SELECT event_id, (epoch_us(ts) // 1000000) AS t, user_id, event_type, props ->> '$.k' AS k FROM events)"


@query("SELECT 'u' || user_id AS src_id, 'User' AS src_type, 'Execute' AS rel_type, event_type AS dst_id, 'Process' AS dst_type, t AS \"timestamp\" FROM b UNION ALL SELECT event_type, 'Process', 'DNS', 'd' || k, 'Domain', t FROM b", _B)
def parse_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.to_json(F.struct(F.concat(F.lit("u"), "user_id").alias("user"), F.col("event_type").alias("process"), F.concat(F.lit("d"), "k").alias("QueryName"), F.col("t").alias("time"), F.lit(True).alias("flag")))
    return generic_triples(mixed_lines(_rendered(_events(spark, sf_dir), text))).select(*_TRIPLE)


@query("SELECT '10.0.0.' || k AS src_id, 'IP' AS src_type, 'Connect' AS rel_type, '10.1.0.' || user_id AS dst_id, 'IP' AS dst_type, t AS \"timestamp\", '443' AS port FROM b", _B)
def parse_cef(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string("CEF:0|v|p|1|%s|n|5|src=10.0.0.%s dst=10.1.0.%s dpt=443 msg=a b c rt=%s", "event_type", "k", "user_id", "t")
    rows = generic_triples(mixed_lines(_rendered(_events(spark, sf_dir), text)))
    return rows.select(*_TRIPLE, F.element_at("dst_meta", "dest_port").alias("port"))


@query("SELECT 'u' || user_id AS src_id, 'User' AS src_type, 'Auth' AS rel_type, event_type AS dst_id, 'Host' AS dst_type, t AS \"timestamp\" FROM b", _B)
def parse_leef(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string("LEEF:1.0|v|p|1|%s|suser=u%s\tshost=%s\trt=%s", "event_type", "user_id", "event_type", "t")
    return generic_triples(mixed_lines(_rendered(_events(spark, sf_dir), text))).select(*_TRIPLE)


@query("SELECT 'u' || user_id AS src_id, 'User' AS src_type, 'Auth' AS rel_type, 'h, ' || event_type AS dst_id, 'Host' AS dst_type, t AS \"timestamp\" FROM b", _B)
def parse_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string('%s,u%s,"h, %s",', "t", "user_id", "event_type")
    return generic_triples(csv(_rendered(_events(spark, sf_dir), text), "timestamp,User,hostname,url"), nested=False).select(*_TRIPLE)


@query("SELECT '10.0.0.' || k AS src_id, 'IP' AS src_type, 'Connect' AS rel_type, '10.1.0.' || user_id AS dst_id, 'IP' AS dst_type, t AS \"timestamp\" FROM b", _B)
def parse_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.expr("date_format(timestampadd(SECOND, t, TIMESTAMP_NTZ'1970-01-01 00:00:00'), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")")
    text = F.format_string('{"source":{"ip":"10.0.0.%s"},"destination":{"ip":"10.1.0.%s"},"event":{"created":"%s"}}', "k", "user_id", stamp)
    return generic_triples(mixed_lines(_rendered(_events(spark, sf_dir), text))).select(*_TRIPLE)


@query("SELECT 'u' || user_id AS src_id, 'User' AS src_type, 'Execute' AS rel_type, event_type || '.exe' AS dst_id, 'Process' AS dst_type, k AS pid FROM b UNION ALL SELECT 'init.exe', 'Process', 'Spawn', event_type || '.exe', 'Process', k FROM b", _B)
def parse_process_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string('{"EventID":1,"UtcTime":"2024-01-10 00:00:00.123","User":"u%s","Image":"%s.exe","ParentImage":"init.exe","ProcessId":%s}', "user_id", "event_type", "k")
    rows = windows_triples(ndjson(_rendered(_events(spark, sf_dir), text)))
    return rows.select("src_id", "src_type", "rel_type", "dst_id", "dst_type", F.element_at("dst_meta", "pid").alias("pid"))


@query("SELECT 'u' || user_id AS src_id, 'User' AS src_type, 'Auth' AS rel_type, '10.0.0.' || k AS dst_id, 'IP' AS dst_type, CASE WHEN event_type = 'error' THEN 'Failure' ELSE 'Success' END AS status FROM b", _B)
def parse_signins(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string('{"Type":"SigninLogs","TimeGenerated":"2024-01-10T00:00:00Z","UserPrincipalName":"u%s","IPAddress":"10.0.0.%s","ResultType":"%s"}', "user_id", "k", F.when(F.col("event_type") == "error", "50126").otherwise("0"))
    rows = cloud_triples(ndjson(_rendered(_events(spark, sf_dir), text)))
    return rows.select("src_id", "src_type", "rel_type", "dst_id", "dst_type", F.element_at("rel_meta", "status").alias("status"))


@query("SELECT 'k' AS field, count(*) AS count, 'Metadata' AS role, min(props ->> '$.k') AS least FROM events")
def field_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile(ndjson(table(spark, sf_dir, "events").select(F.col("event_id").alias("rec"), F.col("props").alias("value"))))
    return rows.select("field", "count", "role", F.element_at("samples", 1).alias("least"))


def _merged(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("id"), F.create_map(F.lit("seen"), F.col("event_type")).alias("metadata"), F.col("event_id").alias("at"))
    return graphs.merged_metadata(rows, policy).select("id", F.element_at("metadata", "seen").alias("seen"))


@query("SELECT 'u' || user_id AS id, arg_min(event_type, event_id) AS seen FROM events GROUP BY 1")
def merge_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, graphs.FIRST)


@query("SELECT 'u' || user_id AS id, arg_max(event_type, event_id) AS seen FROM events GROUP BY 1")
def merge_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, graphs.LAST)


@query("SELECT 'u' || user_id AS id, string_agg(event_type, ', ' ORDER BY event_id) AS seen FROM events GROUP BY 1")
def merge_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, graphs.APPEND)


@query("SELECT id, arg_min(y, place) AS entity_type, count(*) AS occurrences FROM (SELECT 'u' || user_id AS id, 'User' AS y, event_id * 2 AS place FROM b UNION ALL SELECT event_type, 'Process', event_id * 2 + 1 FROM b) GROUP BY 1", _B)
def ingest_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.to_json(F.struct(F.concat(F.lit("u"), "user_id").alias("user"), F.col("event_type").alias("process"), F.col("t").alias("time")))
    g, _ = graphs.ingest(graphs.Graph.empty(spark), generic_triples(mixed_lines(_rendered(_events(spark, sf_dir), text))), "web")
    ends = g.relations.select(F.explode(F.array("source_id", "dest_id")).alias("id")).groupBy("id").agg(F.count("*").alias("occurrences"))
    return g.entities.join(ends, "id").select("id", "entity_type", "occurrences")


@query("SELECT event_id, t AS windows, t AS generic, 0::BIGINT AS broken FROM b", _B)
def parse_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    at = "timestampadd(SECOND, t, TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    spaced = F.expr(f"date_format({at}, 'yyyy-MM-dd HH:mm:ss.SSS')")
    offset = F.concat(F.expr(f"date_format({at} + INTERVAL 2 HOURS, \"yyyy-MM-dd'T'HH:mm:ss\")"), F.lit("+02:00"))
    return rows.select("event_id", event_log_seconds(spaced).alias("windows"), generic_seconds(offset).alias("generic"), event_log_seconds(F.col("event_type")).alias("broken"))


@query("SELECT 'Process' AS entity_type, count(DISTINCT event_type) AS n FROM b UNION ALL SELECT 'User', count(DISTINCT user_id) FROM b", _B)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines in files, folded in by a stream; the result is the graph's entity types."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
    text = F.to_json(F.struct(F.concat(F.lit("u"), "user_id").alias("user"), F.col("event_type").alias("process"), F.col("t").alias("time")))
    _rendered(_events(spark, sf_dir), text).select("value").repartition(2).write.text(f"{at}/in")
    sink = GraphSink(spark, f"{at}/graph")
    stream_logs(spark, f"{at}/in", sink, f"{at}/checkpoint").awaitTermination()
    return explore.entity_type_counts(sink.graph())


# Every parsing rule, mixed layouts, and lookups that no query above shows


_STAMP = "date_format(timestampadd(SECOND, t, TIMESTAMP_NTZ'1970-01-01 00:00:00'), 'yyyy-MM-dd HH:mm:ss.SSS')"
_ZULU = "date_format(timestampadd(SECOND, t, TIMESTAMP_NTZ'1970-01-01 00:00:00'), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"


def _line():
    """The number of a triple's record."""
    return F.shiftright("seq", SLOTS.bit_length() - 1)


def _cases(spark: SparkSession, sf_dir: str, cases: list[rules.Case], time: dict[str, str], **how) -> DataFrame:
    return spread(rules.rendered(_events(spark, sf_dir), cases, time, **how))


@query(rules.expected(rules.WINDOWS))
def rules_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All Windows event rules, flat records."""
    return rules.shown(windows_triples(ndjson(_cases(spark, sf_dir, rules.WINDOWS, {"UtcTime": _STAMP}))), _line())


@query(rules.expected(rules.WINDOWS))
def rules_windows_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events in the form that nests their fields in event_data."""
    nested = [rules.Case({f"event_data.{k}": v for k, v in c.strings.items()}, c.triples, {"event_id" if k == "EventID" else f"event_data.{k}": v for k, v in c.numbers.items()}) for c in rules.WINDOWS]
    return rules.shown(windows_triples(ndjson(_cases(spark, sf_dir, nested, {"@timestamp": _ZULU}, dotted=True))), _line())


@query(rules.expected(rules.WINDOWS))
def rules_rendered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as a tool renders binary event logs, by the reader for them."""
    rendered = []
    for c in rules.WINDOWS:
        strings = {f"Event.EventData.{k}": v for k, v in c.strings.items() if k != "Computer"} | {f"Event.System.{k}": v for k, v in c.strings.items() if k == "Computer"}
        rendered.append(rules.Case(strings, c.triples, {"Event.System.EventID" if k == "EventID" else f"Event.EventData.{k}": v for k, v in c.numbers.items()}))
    lines = _cases(spark, sf_dir, rendered, {"Event.System.TimeCreated.SystemTime": _ZULU}, dotted=True)
    return rules.shown(triples_of(records_of(lines, "evtx"), "evtx"), _line())


@query(rules.expected(rules.CLOUD))
def rules_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cloud tables, named by Type or told by their fields."""
    return rules.shown(cloud_triples(ndjson(_cases(spark, sf_dir, rules.CLOUD, {"TimeGenerated": _ZULU}))), _line())


@query(rules.expected(rules.GENERIC))
def rules_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.shown(generic_triples(mixed_lines(_cases(spark, sf_dir, rules.GENERIC, {"timestamp": _STAMP}))), _line())


@query(rules.expected(rules.NESTED))
def rules_nested_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.shown(generic_triples(mixed_lines(_cases(spark, sf_dir, rules.NESTED, {"event.created": _ZULU}, dotted=True))), _line())


_MIXED = [rules.Case({}, [rules.Triple(("User", rules.U), "Execute", ("Process", rules.E))]), rules.Case({}, [rules.Triple(("IP", rules.IP), "Connect", ("IP", rules.IP2), dst_meta={"dest_port": "'443'"})]), rules.Case({}, [rules.Triple(("User", rules.U), "Auth", ("Host", rules.HOST))]), rules.Case({}, [])]


@query(rules.expected(_MIXED))
def parse_mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON, CEF, LEEF and broken lines in one stream."""
    forms = [
        F.format_string('{"user":"u%s","process":"%s.exe","time":%s}', "user_id", "event_type", "t"), F.format_string("CEF:0|v|p|1|%s|n|5|src=10.0.0.%s dst=10.1.0.%s  dpt=443 msg=a  b c rt=%s", "event_type", "k", "user_id", "t"),
        F.format_string("LEEF:1.0|v|p|1|%s|suser=u%s\tshost=h%s\trt=%s", "event_type", "user_id", "user_id", "t"), F.format_string('{"user": "u%s", ', "user_id"),
    ]
    return rules.shown(generic_triples(mixed_lines(_rendered(_events(spark, sf_dir), rules._picked(forms)))), _line())


def _files(spark: SparkSession, rows: DataFrame, name: str) -> str:
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    rows.write.text(at)
    return at


@query(f"SELECT src_id, src_type, rel_type, dst_id, dst_type, \"timestamp\", metadata, count(*) AS n FROM ({rules.expected(rules.GENERIC)}) GROUP BY ALL")
def parse_json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are one JSON array each, found out and read as files."""
    lines = rules.rendered(_events(spark, sf_dir), rules.GENERIC, {"timestamp": _STAMP})
    arrays = lines.groupBy((F.col("rec") % 40).alias("file")).agg(F.array_join(F.array_sort(F.collect_list("value")), ",\n").alias("x")).select("file", F.concat(F.lit("["), "x", F.lit("]")).alias("value"))
    at = f"{shared_folder(spark)}/arrays-{uuid.uuid4().hex[:12]}"
    arrays.write.partitionBy("file").text(at)  # a folder for each array: tasks that get several rows still write one to a file
    rows = rules.shown(read_logs(spark, at), F.lit(0)).drop("event_id")
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


@query("SELECT id, arg_min(y, place) AS entity_type, count(*) AS occurrences FROM (SELECT 'u' || user_id AS id, 'User' AS y, event_id * 2 AS place FROM b UNION ALL SELECT event_type, 'Process', event_id * 2 + 1 FROM b) GROUP BY 1", _B)
def ingest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty files of lines, numbered as their splits are, read and merged."""
    text = F.to_json(F.struct(F.concat(F.lit("u"), "user_id").alias("user"), F.col("event_type").alias("process"), F.col("t").alias("time")))
    at = _files(spark, _events(spark, sf_dir).repartition(40).select(text.alias("value")), "lines")
    g, _ = graphs.ingest(graphs.Graph.empty(spark), read_logs(spark, at), "web")
    ends = g.relations.select(F.explode(F.array("source_id", "dest_id")).alias("id")).groupBy("id").agg(F.count("*").alias("occurrences"))
    return g.entities.join(ends, "id").select("id", "entity_type", "occurrences")


@query("SELECT 'u' || user_id AS src_id, 'User' AS src_type, 'Auth' AS rel_type, '10.0.0.' || k AS dst_id, 'IP' AS dst_type, t AS \"timestamp\" FROM b", _B)
def parse_log_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a log query service, a table of one row each."""
    text = F.format_string('{"tables":[{"name":"PrimaryResult","columns":[{"name":"TimeGenerated"},{"name":"UserPrincipalName"},{"name":"IPAddress"}],"rows":[["%s","u%s","10.0.0.%s"]]}]}', F.expr(_ZULU), "user_id", "k")
    return cloud_triples(log_analytics_records(_rendered(_events(spark, sf_dir), text))).select(*_TRIPLE)


@query("SELECT '10.0.0.' || k AS src_id, 'IP' AS src_type, 'Connect' AS rel_type, '10.1.0.' || user_id AS dst_id, 'IP' AS dst_type, t AS \"timestamp\" FROM b", _B)
def parse_search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a search service, a hit each."""
    text = F.format_string('{"hits":{"hits":[{"_id":"%s","_source":{"@timestamp":"%s","SourceIP":"10.0.0.%s","DestinationIP":"10.1.0.%s"},"sort":[1]}]}}', "event_id", F.expr(_ZULU), "k", "user_id")
    return cloud_triples(elastic_records(_rendered(_events(spark, sf_dir), text))).select(*_TRIPLE)


_FIRST_500 = "SELECT 'u' || user_id AS src_id, 'User' AS src_type, 'Execute' AS rel_type, event_type AS dst_id, 'Process' AS dst_type, t AS \"timestamp\" FROM (SELECT * FROM b ORDER BY event_id LIMIT 500)"


@query(_FIRST_500, _B)
def parse_first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preview: the first records of a source only."""
    text = F.to_json(F.struct(F.concat(F.lit("u"), "user_id").alias("user"), F.col("event_type").alias("process"), F.col("t").alias("time")))
    records = records_of(_rendered(_events(spark, sf_dir), text), "generic")
    return triples_of(records.orderBy("rec").limit(500), "generic").select(*_TRIPLE)


@query("SELECT * FROM (VALUES ('SrcIP', 'IP'), ('user', 'User'), ('DestinationPort', 'Skip'), ('colour', 'Skip'), ('QueryName', 'Domain'), ('@timestamp', 'Skip')) AS v(field, entity_type)")
def mapping_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proposed_mapping(spark, "generic", ["SrcIP", "user", "DestinationPort", "colour", "QueryName", "@timestamp"])


@query("SELECT rel_type, count(*) AS n, min(\"timestamp\") AS \"first\", sum(seq)::HUGEINT::VARCHAR AS numbers FROM r GROUP BY 1", ORDER_SQL)
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved by relation type and loaded strictly."""
    at = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex[:12]}"
    graphs.save(order_graph(spark, sf_dir), at)
    rows = graphs.load(spark, at).relations.groupBy("rel_type")
    return rows.agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.sum(F.col("seq").cast("decimal(38,0)")).cast("string").alias("numbers"))


_CDM = "com.bbn.tc.schema.avro.cdm18."


@query("SELECT 's' || user_id AS source_id, 'f' || k AS dest_id, 'Read' AS rel_type, t AS \"timestamp\" FROM b WHERE event_id % 3 = 0 UNION ALL SELECT 's' || user_id, 'g' || k, 'Connect', t FROM b WHERE event_id % 3 = 1 UNION ALL SELECT 's' || user_id, 'h' || k, 'Connect', t FROM b WHERE event_id % 3 = 1", _B)
def provenance_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance events with one object and with two; those of unheard kinds go."""
    def event(kind: str, objects: str, *columns) -> F.Column:
        return F.format_string('{"datum":{"' + _CDM + 'Event":{"type":"' + kind + '","timestampNanos":%s,"subject":{"' + _CDM + 'UUID":"s%s"},' + objects + "}}}", F.col("t") * 1_000_000_000 + 5, "user_id", *columns)

    forms = [event("EVENT_OPEN", '"predicateObject":"f%s"', "k"), event("EVENT_SENDMSG", '"predicateObject":{"UUID":"g%s"},"predicateObject2":"h%s"', "k", "k"), event("EVENT_UNHEARD", '"predicateObject":"f%s"', "k")]
    return cdm(_rendered(_events(spark, sf_dir), rules._picked(forms)))[1].select("source_id", "dest_id", "rel_type", "timestamp")


@query("SELECT user_id % 400 AS graph_id, (user_id % 400) || '_' || user_id AS source_id, 'a' AS source_type, (user_id % 400) || '_' || event_type AS dest_id, 'b' AS dest_type, 'e' AS edge_type, user_id % 400 BETWEEN 300 AND 399 AS attack FROM b", _B)
def provenance_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.concat_ws("\t", "user_id", F.lit("a"), "event_type", F.lit("b"), F.lit("e"), F.col("user_id") % 400).alias("value"))
    found = streamspot(spark, _files(spark, rows, "edges"))
    return found.select(F.col("graph_id").cast("bigint").alias("graph_id"), "source_id", "source_type", "dest_id", "dest_type", "edge_type", "attack")


@query("SELECT dataset_id, count(*) AS relations, count(DISTINCT source_id) AS sources FROM r GROUP BY 1", ORDER_SQL)
def strict_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of both data sets, then their relations, refused if an id came twice or an end were missing."""
    g, full = graphs.Graph.empty(spark), order_graph(spark, sf_dir)
    for tag in ("sales", "stock"):
        g = graphs.add_entities(g, full.entities.where(F.col("dataset_id") == tag))
    for tag in ("sales", "stock"):
        g = graphs.add_relations(g, full.relations.where(F.col("dataset_id") == tag))
    return g.relations.groupBy("dataset_id").agg(F.count("*").alias("relations"), F.count_distinct("source_id").alias("sources"))


@query("SELECT id, entity_type, dataset_id FROM e WHERE id = 'proc:7' UNION ALL SELECT dest_id, rel_type, dataset_id FROM r WHERE source_id = 'proc:7' AND rel_type = 'Write'", ORDER_SQL)
def entity_and_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = order_graph(spark, sf_dir)
    writes = explore.outgoing(g, "proc:7", "Write").select(F.col("dest_id").alias("id"), F.col("rel_type").alias("entity_type"), "dataset_id")
    return explore.entity(g, "proc:7").select("id", "entity_type", "dataset_id").unionByName(writes)


_NEAR = """, n1 AS (SELECT DISTINCT dest_id AS id FROM r JOIN e ON e.id = dest_id WHERE source_id = 'user:1' AND rel_type IN ('Execute', 'Write') AND entity_type IN ('Process', 'File') ORDER BY 1 LIMIT 39),
n2 AS (SELECT DISTINCT dest_id AS id FROM r JOIN e ON e.id = dest_id WHERE source_id IN (SELECT id FROM n1) AND rel_type IN ('Execute', 'Write') AND entity_type IN ('Process', 'File') AND dest_id NOT IN (SELECT id FROM n1)
  UNION SELECT DISTINCT source_id FROM r JOIN e ON e.id = source_id WHERE dest_id IN (SELECT id FROM n1) AND rel_type IN ('Execute', 'Write') AND entity_type IN ('Process', 'File') AND source_id NOT IN (SELECT id FROM n1))"""


@query(f"{_NEAR} SELECT id, entity_type FROM e WHERE id IN ('user:1', 'host:3') OR id IN (SELECT id FROM n1) OR id IN (SELECT id FROM n2 ORDER BY id LIMIT (SELECT 39 - count(*) FROM n1))", ORDER_SQL)
def neighbourhood_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By relation and entity types, with a pinned node that is not near."""
    return explore.neighbourhood(order_graph(spark, sf_dir), "user:1", 2, 40, ["Execute", "Write"], entity_types=["Process", "File"], pinned=["host:3"]).entities.select("id", "entity_type")


@query("SELECT 'type' AS part, entity_type AS name, count(*)::DOUBLE AS value FROM e GROUP BY 2 UNION ALL SELECT 'top', id, round(score, 6) FROM (SELECT * FROM e ORDER BY score DESC, id LIMIT 10)", ORDER_SQL)
def graph_summary_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = explore.summary(order_graph(spark, sf_dir))
    types = row.select(F.explode("types").alias("x")).select(F.lit("type").alias("part"), F.col("x.entity_type").alias("name"), F.col("x.n").cast("double").alias("value"))
    return types.unionByName(row.select(F.explode("top").alias("x")).select(F.lit("top").alias("part"), F.col("x.id").alias("name"), F.round("x.score", 6).alias("value")))


@query("SELECT entity_type AS kind, count(*) AS n FROM (SELECT dest_id AS o FROM r WHERE source_id = 'proc:7' UNION ALL SELECT source_id FROM r WHERE dest_id = 'proc:7') JOIN e ON id = o GROUP BY 1", ORDER_SQL)
def node_neighbour_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.node_details(order_graph(spark, sf_dir), "proc:7").select(F.explode("neighbour_types").alias("kind", "n"))


@query("SELECT source_id, dest_id, rel_type, n::VARCHAR AS compacted_count, hi::VARCHAR AS compacted_latest FROM o", f"{EVENT_SQL}, {_COMPACT}")
def compaction_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graphs.compact(event_graph(spark, sf_dir), CUTOFF)[0].relations.where(F.map_contains_key("metadata", "compacted_count"))
    return rows.select("source_id", "dest_id", "rel_type", *(F.element_at("metadata", x).alias(x) for x in ("compacted_count", "compacted_latest")))


@query("SELECT 'type' AS part, entity_type AS name, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'relation', rel_type, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'first', '', min(\"timestamp\") FROM r UNION ALL SELECT 'last', '', max(\"timestamp\") FROM r", ORDER_SQL)
def prompt_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = explore.context_statistics(order_graph(spark, sf_dir))
    rows = [parts["types"].select(F.lit("type").alias("part"), F.col("entity_type").alias("name"), "n"), parts["relations"].select(F.lit("relation").alias("part"), F.col("rel_type").alias("name"), "n")]
    rows += [parts["range"].select(F.lit(x).alias("part"), F.lit("").alias("name"), F.col(x).alias("n")) for x in ("first", "last")]
    return reduce(DataFrame.unionByName, rows)


@query("SELECT id, round(n / (SELECT max(n) FROM d) * 100, 6) AS degree_score, round(n / (SELECT max(n) FROM d) * 100, 6) AS score FROM d", f"{ORDER_SQL}, {_DEGREE}")
def written_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores put into the entities' own columns, and the composite of what is there."""
    g = order_graph(spark, sf_dir)
    full = scoring.with_scores(g, scoring.degree_scores(g))
    return scoring.composite(full.entities).select("id", F.round("degree_score", 6).alias("degree_score"), F.round("score", 6).alias("score"))


@query("SELECT id, round((0.25 * er + 0.25 * nc + 0.2 * tn + 0.3 * CASE WHEN id LIKE 'user:%' THEN 0.5 ELSE 0 END) / 1.0, 6) AS estimate FROM ne", _ALL)
def injected_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threat scores of a model, weighed into the estimates."""
    g = event_graph(spark, sf_dir)
    threats = g.entities.where("entity_type = 'User'").select("id", F.lit(0.5).alias("threat"))
    rows = anomaly.finalize(g, weights=anomaly.Weights(entity=0.25, pair=0.3, concentration=0.25, novelty=0.2, threat=0.3), threats=threats).nodes
    return rows.select("id", F.round("estimate", 6).alias("estimate"))


@query("""SELECT id, CASE WHEN id NOT IN (SELECT 'evhost:' || event_type FROM b) AND id NOT LIKE 'user:1%' THEN 'Benign' WHEN id LIKE 'user:%' THEN 'PrivilegeEscalation' ELSE 'C2Beacon' END AS label FROM e""", EVENT_SQL)
def threat_labels_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, and users whose number starts with 1, taken for malicious."""
    g = event_graph(spark, sf_dir)
    return threat_labels(g, g.entities.where("entity_type = 'Host' or id like 'user:1%'").select("id"))


@query("SELECT rel_type, hour, n FROM (SELECT rel_type, \"timestamp\" - \"timestamp\" % 3600 AS hour, count(*) AS n FROM r GROUP BY 1, 2) WHERE hour + 3600 <= (SELECT max(\"timestamp\") FROM r) - 3600", EVENT_SQL)
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of a stream of relations; hours that late relations may still change are not out yet."""
    at = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex[:12]}"
    rows = event_graph(spark, sf_dir).relations.select("rel_type", "timestamp")
    rows.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
    windowed_counts(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("rel_type string, hour bigint, n bigint").parquet(f"{at}/out")


def _market(spark: SparkSession, sf_dir: str) -> graphs.Graph:
    """Customers and suppliers by way of nations, regions and market segments."""
    ids, rows = [], []
    for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("region", "r_regionkey")):
        ids.append(table(spark, sf_dir, name).select(F.concat(F.lit(f"{name}:"), key).alias("id")))
    ids.append(table(spark, sf_dir, "customer").select(F.concat(F.lit("segment:"), "c_mktsegment").alias("id")).distinct())
    for name, key, other, to in (("customer", "c_custkey", "nation", "c_nationkey"), ("customer", "c_custkey", "segment", "c_mktsegment"), ("supplier", "s_suppkey", "nation", "s_nationkey"), ("nation", "n_nationkey", "region", "n_regionkey")):
        rows.append(table(spark, sf_dir, name).select(F.concat(F.lit(f"{name}:"), key).alias("source_id"), F.concat(F.lit(f"{other}:"), to).alias("dest_id")))
    return graphs.Graph(reduce(DataFrame.unionByName, ids), reduce(DataFrame.unionByName, rows))


_MARKET = """n AS MATERIALIZED (SELECT 'customer:' || c_custkey AS id FROM customer UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier UNION ALL SELECT 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'region:' || r_regionkey FROM region UNION ALL SELECT DISTINCT 'segment:' || c_mktsegment FROM customer),
q AS (SELECT 'customer:' || c_custkey AS a, 'nation:' || c_nationkey AS b FROM customer UNION ALL SELECT 'customer:' || c_custkey, 'segment:' || c_mktsegment FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation),
g AS MATERIALIZED (SELECT a, b FROM q UNION ALL SELECT b, a FROM q),
k AS (SELECT count(*) AS n FROM n), c AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM n),
l0 AS MATERIALIZED (SELECT id AS s, id AS v, 1.0::DOUBLE AS sigma FROM c, k WHERE place IN (SELECT i * n // least(n, 100) FROM range(100) AS t(i), k))"""
_DEPTH = 9
for _i in range(1, _DEPTH + 1):
    _known = " AND ".join(f"(s, b) NOT IN (SELECT (s, v) FROM l{_j})" for _j in range(max(0, _i - 2), _i))
    _MARKET += f", l{_i} AS MATERIALIZED (SELECT s, b AS v, sum(sigma) AS sigma FROM l{_i - 1} JOIN g ON a = v WHERE {_known} GROUP BY 1, 2)"
_MARKET += f", d{_DEPTH} AS MATERIALIZED (SELECT s, v, sigma, 0.0::DOUBLE AS delta FROM l{_DEPTH})"
for _i in range(_DEPTH - 1, -1, -1):
    _MARKET += f", d{_i} AS MATERIALIZED (SELECT u.s, u.v, u.sigma, u.sigma * coalesce(sum((1 + d.delta) / d.sigma), 0) AS delta FROM l{_i} u LEFT JOIN (SELECT s, a, sigma, delta FROM d{_i + 1} JOIN g ON b = v) d ON d.s = u.s AND d.a = u.v GROUP BY 1, 2, 3)"
_MARKET += ", x AS (SELECT id, coalesce(sum(delta), 0) AS part FROM n LEFT JOIN (" + " UNION ALL ".join(f"SELECT s, v, delta FROM d{_i} WHERE s <> v" for _i in range(_DEPTH + 1)) + ") ON v = id GROUP BY 1)"


@query("SELECT id, round(part / (SELECT max(part) FROM x) * 100, 6) AS betweenness FROM x", _MARKET)
def betweenness_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 100 sources of the whole market graph; nothing in it is further apart than the SQL goes."""
    return scoring.betweenness(_market(spark, sf_dir), 100).select("id", F.round("betweenness", 6).alias("betweenness"))


@query("SELECT id, round(part / (SELECT max(part) FROM x) * 100, 6) AS betweenness FROM x", _MARKET)
def betweenness_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by joins, as for graphs whose adjacency cannot be broadcast."""
    g = _market(spark, sf_dir)
    n = g.entities.count()
    sums = scoring._dependencies_by_level(g, n, min(n, 100))
    rows = g.entities.select("id").join(sums, "id", "left").select("id", F.coalesce("part", F.lit(0.0)).alias("betweenness"))
    return scoring.scaled(rows, "betweenness").select("id", F.round("betweenness", 6).alias("betweenness"))
