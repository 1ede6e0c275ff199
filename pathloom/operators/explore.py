"""Lookups, search, neighbourhoods and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.times import hour_of
from pathloom.operators.graph import Graph
from pathloom.schema import ANY, EntityNotFound


def entity(graph: Graph, id: str) -> DataFrame:
    return graph.entities.where(F.col("id") == id)


def outgoing(graph: Graph, id: str, rel_type: str | None = None) -> DataFrame:
    rows = graph.relations.where(F.col("source_id") == id)
    return rows.where(F.col("rel_type") == rel_type) if rel_type else rows


def sources_of(graph: Graph, id: str) -> DataFrame:
    """Source of each relation into id, one row for each relation."""
    return graph.relations.where(F.col("dest_id") == id).select("source_id")


def degrees(relations: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) in relations; one pass, a self-loop counts on both sides."""
    ends = F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dest_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"))))
    return relations.select(ends.alias("e")).groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def search(graph: Graph, query: str, entity_type: str | None = None, limit: int = 50) -> DataFrame:
    """(id, entity_type, score, connections) of ids that hold the query in any case, by id; an empty query takes all."""
    rows = graph.entities.where(F.contains(F.lower("id"), F.lit(query.lower())))
    if entity_type and entity_type != ANY:
        rows = rows.where(F.col("entity_type") == entity_type)
    top = rows.select("id", "entity_type", "score").orderBy("id").limit(limit)
    touching = graph.relations.select(F.explode(F.array("source_id", "dest_id")).alias("id")).join(top.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("connections"))
    return top.join(touching, "id", "left").select("id", "entity_type", "score", F.coalesce("connections", F.lit(0)).alias("connections"))


def ids_of_type(graph: Graph, entity_type: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    rows = graph.entities.where(F.col("entity_type") == entity_type).select("id").orderBy("id").offset(offset)
    return rows if limit is None else rows.limit(limit)


def ids_by_relation(graph: Graph, rel_type: str) -> DataFrame:
    """Distinct ends of relations of one type; `*` is no type and finds nothing."""
    return graph.relations.where(F.col("rel_type") == rel_type).select(F.explode(F.array("source_id", "dest_id")).alias("id")).distinct()


def subgraph(graph: Graph, ids: DataFrame) -> Graph:
    """Entities of a list (column id) and the relations among them."""
    ids = ids.select(F.col("id").alias("_id")).distinct()
    entities = graph.entities.join(ids, F.col("id") == F.col("_id"), "left_semi")
    relations = graph.relations.join(ids, F.col("source_id") == F.col("_id"), "left_semi").join(ids, F.col("dest_id") == F.col("_id"), "left_semi")
    return Graph(entities, relations)


def events_of(graph: Graph, id: str) -> DataFrame:
    """Relations out of and into a node by time; a self-loop stands in both."""
    out = graph.relations.where(F.col("source_id") == id).withColumn("direction", F.lit("out"))
    into = graph.relations.where(F.col("dest_id") == id).withColumn("direction", F.lit("in"))
    return out.unionByName(into).orderBy("timestamp", "seq", "direction")


def relation_filter(rel_types: list[str] | None = None, start: int | None = None, end: int | None = None) -> Column:
    parts = [F.lit(True)]
    if rel_types:
        parts.append(F.col("rel_type").isin(rel_types))
    if start is not None:
        parts.append(F.col("timestamp") >= start)
    if end is not None:
        parts.append(F.col("timestamp") <= end)
    return reduce(lambda a, b: a & b, parts)


def neighbourhood(graph: Graph, center: str, hops: int = 2, max_nodes: int = 50, rel_types: list[str] | None = None, start: int | None = None, end: int | None = None, entity_types: list[str] | None = None, min_score: float | None = None, pinned: list[str] | None = None, dedup: str = "compat") -> Graph:
    """Nodes within `hops` of the center in either direction, nearest first then by id, and relations met on the way.

    At most max_nodes nodes and 10 times as many relations; nodes of the last hop are
    not expanded. dedup "compat" keeps one relation of equal (source, dest, time),
    "full" tells types apart too. pinned ids join the result with their relations to it.
    """
    spark = graph.entities.sparkSession
    if graph.entities.where(F.col("id") == center).limit(1).count() == 0:
        raise EntityNotFound(center)
    edges = graph.relations.where(relation_filter(rel_types, start, end))
    allowed = graph.entities
    if entity_types:
        allowed = allowed.where(F.col("entity_type").isin(entity_types))
    if min_score is not None:
        allowed = allowed.where(F.col("score") >= min_score)
    seen = [(center, 0)]
    frontier, met = [center], None
    for hop in range(1, hops + 1):  # the frontier is bounded by max_nodes
        near = spark.createDataFrame([(x,) for x in frontier], "f string")
        out = edges.join(F.broadcast(near), F.col("source_id") == F.col("f"), "left_semi").withColumn("id", F.col("dest_id"))
        into = edges.join(F.broadcast(near), F.col("dest_id") == F.col("f"), "left_semi").withColumn("id", F.col("source_id"))
        touching = out.unionByName(into).join(allowed.select("id"), "id", "left_semi")
        met = touching.withColumn("hop", F.lit(hop)) if met is None else met.unionByName(touching.withColumn("hop", F.lit(hop)))
        room = max_nodes - len(seen)
        known = spark.createDataFrame(seen, "id string, h int").select("id")
        fresh = [r.id for r in touching.select("id").distinct().join(F.broadcast(known), "id", "left_anti").orderBy("id").limit(room).collect()] if room > 0 else []
        seen += [(x, hop) for x in fresh]
        frontier = fresh
        if not frontier:
            break
    if pinned:
        have = {x for x, _ in seen}
        seen += [(x, hops + 1) for x in dict.fromkeys(pinned) if x not in have]
        pins = spark.createDataFrame([(x,) for x in pinned], "f string")
        more = edges.join(F.broadcast(pins), F.col("source_id") == F.col("f"), "left_semi").unionByName(edges.join(F.broadcast(pins), F.col("dest_id") == F.col("f"), "left_semi"))
        more = more.withColumn("id", F.col("dest_id")).withColumn("hop", F.lit(hops + 1))
        met = more if met is None else met.unionByName(more)
    nodes = F.broadcast(spark.createDataFrame(seen, "id string, hop int"))
    entities = graph.entities.join(nodes.select("id"), "id", "left_semi").select(*graph.entities.columns)
    if met is None:
        return Graph(entities, graph.relations.limit(0))
    inside = met.drop("id").join(nodes.select(F.col("id").alias("a")), F.col("source_id") == F.col("a"), "left_semi").join(nodes.select(F.col("id").alias("b")), F.col("dest_id") == F.col("b"), "left_semi")
    keys = ["source_id", "dest_id", "timestamp"] + (["rel_type"] if dedup == "full" else [])
    rest = [c for c in graph.relations.columns if c not in keys]
    once = inside.groupBy(*keys).agg(F.min("hop").alias("hop"), F.min_by(F.struct(*rest), F.struct("hop", "seq")).alias("f"))
    rows = once.select(*keys, "hop", "f.*").orderBy("hop", "source_id", "dest_id", "timestamp", "seq").limit(10 * max_nodes)
    return Graph(entities, rows.select(*graph.relations.columns))


def neighbour_types(graph: Graph, id: str) -> DataFrame:
    """Distinct entity types next to a node, by name."""
    around = graph.relations.where(F.col("source_id") == id).select(F.col("dest_id").alias("id")).union(graph.relations.where(F.col("dest_id") == id).select("source_id"))
    return graph.entities.join(around, "id", "left_semi").select("entity_type").distinct().orderBy("entity_type")


def counts(graph: Graph) -> DataFrame:
    return graph.entities.agg(F.count("*").alias("entities")).crossJoin(graph.relations.agg(F.count("*").alias("relations")))


def entity_type_counts(graph: Graph, dataset_id: str | None = None) -> DataFrame:
    rows = graph.entities if dataset_id is None else graph.entities.where(F.col("dataset_id") == dataset_id)
    return rows.groupBy("entity_type").agg(F.count("*").alias("n")).orderBy("entity_type")


def heatmap(graph: Graph) -> DataFrame:
    """(rel_type, hour, n) of every hour with relations."""
    return graph.relations.groupBy("rel_type", hour_of(F.col("timestamp")).alias("hour")).agg(F.count("*").alias("n"))


def heatmap_rows(graph: Graph) -> DataFrame:
    """(rel_type, bins): the hours of each type in one array."""
    return heatmap(graph).groupBy("rel_type").agg(F.array_sort(F.collect_list(F.struct("hour", F.col("n").alias("count")))).alias("bins")).orderBy("rel_type")


def timeline(graph: Graph) -> DataFrame:
    """(entity_type, hour, n, first, last) by the type of the source; relations without a known source are left out."""
    typed = graph.relations.join(graph.entities.select(F.col("id").alias("source_id"), "entity_type"), "source_id")
    hours = typed.groupBy("entity_type", hour_of(F.col("timestamp")).alias("hour")).agg(F.count("*").alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    spans = hours.groupBy("entity_type").agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    return hours.drop("lo", "hi").join(spans, "entity_type")


def timeline_rows(graph: Graph) -> DataFrame:
    rows = timeline(graph).groupBy("entity_type", "first", "last")
    return rows.agg(F.array_sort(F.collect_list(F.struct("hour", F.col("n").alias("count")))).alias("bins")).orderBy("entity_type")


def summary(graph: Graph) -> DataFrame:
    """One row: counts, distribution of types by count, time range without unknown times, and the ten best-scored entities."""
    types = graph.entities.groupBy("entity_type").agg(F.count("*").alias("n"))
    types = types.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "entity_type", "n"))).alias("x")).select(F.transform("x", lambda r: F.struct(r["entity_type"].alias("entity_type"), r["n"].alias("n"))).alias("types"))
    known = F.when(F.col("timestamp") != 0, F.col("timestamp"))
    span = graph.relations.agg(F.min(known).alias("first"), F.max(known).alias("last"))
    return counts(graph).crossJoin(types).crossJoin(span).crossJoin(top_entities(graph).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "id", "score"))).alias("x")).select(F.transform("x", lambda r: F.struct(r["id"].alias("id"), r["score"].alias("score"))).alias("top")))


def top_entities(graph: Graph, n: int = 10) -> DataFrame:
    return graph.entities.orderBy(F.desc("score"), "id").limit(n).where("score > 0").select("id", "entity_type", "score")


def node_details(graph: Graph, id: str) -> DataFrame:
    """One row: scores, degrees, time range, neighbours, and how many relations lead to each neighbour type."""
    own = graph.entities.where(F.col("id") == id).select("id", "entity_type", "score", "degree_score", "betweenness", "pagerank_score", "metadata")
    out = graph.relations.where(F.col("source_id") == id).select(F.col("dest_id").alias("other"), "timestamp", F.lit("out").alias("d"))
    into = graph.relations.where(F.col("dest_id") == id).select(F.col("source_id").alias("other"), "timestamp", F.lit("in").alias("d"))
    around = out.unionAll(into)
    known = F.when(F.col("timestamp") != 0, F.col("timestamp"))
    totals = around.agg(F.count_if(F.col("d") == "in").alias("in_degree"), F.count_if(F.col("d") == "out").alias("out_degree"), F.min(known).alias("first"), F.max(known).alias("last"), F.count_distinct("other").alias("unique_neighbours"))
    kinds = around.join(graph.entities.select(F.col("id").alias("other"), F.col("entity_type").alias("kind")), "other").groupBy("kind").agg(F.count("*").alias("n"))
    kinds = kinds.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("neighbour_types"))
    return own.crossJoin(totals).crossJoin(kinds)


def graph_parameters(graph: Graph) -> DataFrame:
    """One row: nodes, relations, largest out-degree, relations a node, types of both."""
    out = graph.relations.groupBy("source_id").agg(F.count("*").alias("d"))
    left = graph.entities.agg(F.count("*").alias("n"), F.count_distinct("entity_type").alias("entity_types"))
    right = graph.relations.agg(F.count("*").alias("m"), F.count_distinct("rel_type").alias("relation_types"))
    most = out.agg(F.coalesce(F.max("d"), F.lit(0)).alias("max_out_degree"))
    return left.crossJoin(right).crossJoin(most).withColumn("mean_out_degree", F.when(F.col("n") > 0, F.col("m") / F.col("n")).otherwise(0.0))


def context_statistics(graph: Graph) -> dict[str, DataFrame]:
    """What a prompt says of a large subgraph: types, relations, the ten best-scored entities and the time range."""
    known = F.when(F.col("timestamp") != 0, F.col("timestamp"))
    return {
        "types": entity_type_counts(graph),
        "relations": graph.relations.groupBy("rel_type").agg(F.count("*").alias("n")).orderBy("rel_type"),
        "top": top_entities(graph),
        "range": graph.relations.agg(F.min(known).alias("first"), F.max(known).alias("last")),
    }
