"""Building the two tables: upsert with metadata policies, validation, datasets, snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.schema import ENTITY_DDL, RELATION_DDL, DuplicateEntity, EntityNotFound, GraphError

FIRST, LAST, APPEND = "first", "last", "append"


@dataclass(frozen=True)
class Graph:
    """Entities keyed by id, and relations (a directed multigraph). Immutable, as DataFrames are."""

    entities: DataFrame
    relations: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Graph:
        return Graph(spark.createDataFrame([], ENTITY_DDL), spark.createDataFrame([], RELATION_DDL))


def _blank(name: str, kind: str) -> Column:
    return (F.lit(0.0) if kind == "double" else F.lit(None).cast(kind)).alias(name)


def _occurrences(triples: DataFrame) -> DataFrame:
    """Both ends of every triple as (id, entity_type, metadata, at); sources come before destinations."""
    ends = F.explode(F.array(
        F.struct(F.col("src_id").alias("id"), F.col("src_type").alias("entity_type"), F.col("src_meta").alias("metadata"), (F.col("seq") * 2).alias("at")),
        F.struct(F.col("dst_id").alias("id"), F.col("dst_type").alias("entity_type"), F.col("dst_meta").alias("metadata"), (F.col("seq") * 2 + 1).alias("at")),
    ))
    return triples.select(ends.alias("o")).select("o.*")


def merged_metadata(rows: DataFrame, policy: str = FIRST) -> DataFrame:
    """(id, metadata) from (id, metadata, at): per key the first value, the last, or all joined by `, `."""
    each = rows.select("id", "at", F.explode("metadata").alias("key", "value"))
    if policy == APPEND:
        value = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), ", ")
    elif policy in (FIRST, LAST):
        value = (F.min_by if policy == FIRST else F.max_by)("value", "at")
    else:
        raise ValueError(f"unknown policy {policy!r}")
    keys = each.groupBy("id", "key").agg(value.alias("value"))
    return keys.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata"))


def ingest(graph: Graph, triples: DataFrame, dataset_id: str | None = None, policy: str = FIRST, renumber: bool = True) -> tuple[Graph, DataFrame]:
    """(graph with the triples, one row new_entities, new_relations).

    An id keeps the type and dataset it was first seen with; later occurrences only
    merge metadata. Every triple is a new relation: parallel ones are kept, numbered
    after those that are there (renumber) or as the triples are.
    """
    found = _occurrences(triples)
    old = graph.entities.select("id", F.lit(-1).cast("bigint").alias("at"), "entity_type", "metadata", "dataset_id")
    new = found.select("id", "at", "entity_type", "metadata", F.lit(dataset_id).cast("string").alias("dataset_id"))
    rows = old.unionByName(new)
    base = rows.groupBy("id").agg(F.min_by(F.struct("entity_type", "dataset_id"), "at").alias("f"), F.min("at").alias("first_at"))
    scores = graph.entities.select("id", "score", "degree_score", "betweenness", "pagerank_score")
    full = base.join(merged_metadata(rows.select("id", "at", "metadata"), policy), "id", "left").join(scores, "id", "left")
    zero = {x: F.coalesce(x, F.lit(0.0)) for x in ("score", "degree_score", "betweenness", "pagerank_score")}
    entities = full.select("id", "f.entity_type", *(c.alias(x) for x, c in zero.items()), F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), "f.dataset_id")
    start = F.lit(0) if not renumber or graph.relations.isEmpty() else graph.relations.agg(F.max("seq") + 1).first()[0]
    added = triples.select(F.col("src_id").alias("source_id"), F.col("dst_id").alias("dest_id"), "rel_type", "timestamp", F.col("rel_meta").alias("metadata"), F.lit(dataset_id).cast("string").alias("dataset_id"), (F.col("seq") + start).alias("seq"))
    counts = base.agg(F.count_if(F.col("first_at") >= 0).alias("new_entities")).crossJoin(triples.agg(F.count("*").alias("new_relations")))
    return Graph(entities, graph.relations.unionByName(added)), counts


def add_entities(graph: Graph, rows: DataFrame) -> Graph:
    """Strict: DuplicateEntity if an id is there already or comes twice."""
    ids = graph.entities.select("id").unionAll(rows.select("id")).groupBy("id").count().where("count > 1").limit(1).collect()
    if ids:
        raise DuplicateEntity(ids[0].id)
    return Graph(graph.entities.unionByName(rows, allowMissingColumns=True), graph.relations)


def dangling(graph: Graph) -> DataFrame:
    """Relations with an end that is no entity."""
    known = graph.entities.select("id")
    a = graph.relations.join(known, F.col("source_id") == F.col("id"), "left_anti")
    b = graph.relations.join(known, F.col("source_id") == F.col("id"), "left_semi").join(known, F.col("dest_id") == F.col("id"), "left_anti")
    return a.unionByName(b)


def add_relations(graph: Graph, rows: DataFrame) -> Graph:
    """Strict: EntityNotFound if an end is missing."""
    bad = dangling(Graph(graph.entities, rows)).limit(1).collect()
    if bad:
        raise EntityNotFound(f"{bad[0].source_id} -> {bad[0].dest_id}")
    return Graph(graph.entities, graph.relations.unionByName(rows, allowMissingColumns=True))


def save(graph: Graph, path: str) -> None:
    """A snapshot: relations in files by type, so that a step reads only its own."""
    graph.entities.write.mode("overwrite").parquet(f"{path}/entities")
    graph.relations.write.mode("overwrite").partitionBy("rel_type").parquet(f"{path}/relations")


def load(spark: SparkSession, path: str, strict: bool = True) -> Graph:
    graph = Graph(spark.read.schema(ENTITY_DDL).parquet(f"{path}/entities"), spark.read.schema(RELATION_DDL).parquet(f"{path}/relations").select(*(x.strip().split(" ")[0] for x in RELATION_DDL.replace("map<string,string>", "map").split(","))))
    if strict:
        if graph.entities.groupBy("id").count().where("count > 1").limit(1).count():
            raise DuplicateEntity("an id occurs twice")
        if dangling(graph).limit(1).count():
            raise EntityNotFound("a relation has an end that is no entity")
    return graph


def remove_dataset(graph: Graph, dataset_id: str) -> tuple[Graph, DataFrame]:
    """(graph without the dataset, one row entities, relations removed).

    Relations tagged with it go, and entities first seen in it with every relation
    that touches them; the count of relations holds the tagged ones.
    """
    tagged = F.col("dataset_id").eqNullSafe(dataset_id)
    gone = graph.entities.where(tagged).select(F.col("id").alias("gone"))
    kept = graph.relations.where(~tagged)
    kept = kept.join(gone, F.col("source_id") == F.col("gone"), "left_anti").join(gone, F.col("dest_id") == F.col("gone"), "left_anti")
    counts = graph.entities.agg(F.count_if(tagged).alias("entities")).crossJoin(graph.relations.agg(F.count_if(tagged).alias("relations")))
    return Graph(graph.entities.where(~tagged), kept), counts


def rename_type(graph: Graph, dataset_id: str, old: str, new: str) -> tuple[Graph, DataFrame]:
    """(graph in which entities of a dataset changed type, one row `renamed`)."""
    hit = F.col("dataset_id").eqNullSafe(dataset_id) & (F.col("entity_type") == old)
    out = graph.entities.withColumn("entity_type", F.when(hit, new).otherwise(F.col("entity_type")))
    return Graph(out, graph.relations), graph.entities.agg(F.count_if(hit).alias("renamed"))


def compact(graph: Graph, cutoff: int) -> tuple[Graph, DataFrame]:
    """(graph, one row edges_before, edges_after, edges_removed, groups_compacted).

    Parallel relations (same ends and type) become one where all are older than the
    cutoff: at their first time, with the metadata of the first and
    compacted_count and compacted_latest.
    """
    keys = ["source_id", "dest_id", "rel_type"]
    groups = graph.relations.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("latest"),
        F.min_by(F.struct("metadata", "dataset_id", "seq"), F.struct("timestamp", "seq")).alias("f"),
    )
    old = groups.where((F.col("latest") < cutoff) & (F.col("n") > 1))
    marks = F.create_map(F.lit("compacted_count"), F.col("n").cast("string"), F.lit("compacted_latest"), F.col("latest").cast("string"))
    own = F.map_filter(F.coalesce("f.metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("compacted_count", "compacted_latest"))
    merged = old.select(*keys, F.col("first").alias("timestamp"), F.map_concat(own, marks).alias("metadata"), F.col("f.dataset_id"), F.col("f.seq"))
    kept = graph.relations.join(old.select(*keys), keys, "left_anti").select(*merged.columns)
    before = graph.relations.agg(F.count("*").alias("edges_before"))
    less = old.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("edges_removed"), F.count("*").alias("groups_compacted"))
    stats = before.crossJoin(less).select("edges_before", (F.col("edges_before") - F.col("edges_removed")).alias("edges_after"), "edges_removed", "groups_compacted")
    return Graph(graph.entities, kept.unionByName(merged)), stats


__all__ = ["APPEND", "FIRST", "LAST", "Graph", "GraphError", "add_entities", "add_relations", "compact", "dangling", "ingest", "load", "merged_metadata", "remove_dataset", "rename_type", "save"]
