"""Provenance data sets: CDM 18 records and StreamSpot edges."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.anomaly import THREATS
from pathloom.operators.graph import Graph

PREFIX = "com.bbn.tc.schema.avro.cdm18."
# CDM node records and their entity types.
NODE_TYPES = {
    "Subject": "Process", "FileObject": "File", "NetFlowObject": "IP", "SrcSinkObject": "Service", "Principal": "User", "RegistryKeyObject": "Registry",
    "UnnamedPipeObject": "File", "MemoryObject": "File", "Host": "Host",
}
# CDM event types and their relation types.
EVENT_TYPES = {
    "EVENT_OPEN": "Read", "EVENT_READ": "Read", "EVENT_WRITE": "Write", "EVENT_CLOSE": "Write", "EVENT_EXECUTE": "Execute", "EVENT_FORK": "Execute", "EVENT_CLONE": "Execute",
    "EVENT_CONNECT": "Connect", "EVENT_ACCEPT": "Connect", "EVENT_SENDTO": "Connect", "EVENT_RECVFROM": "Connect", "EVENT_SENDMSG": "Connect", "EVENT_RECVMSG": "Connect",
    "EVENT_LOGIN": "Auth", "EVENT_MODIFY_FILE_ATTRIBUTES": "Write", "EVENT_RENAME": "Write", "EVENT_LINK": "Write", "EVENT_UNLINK": "Write", "EVENT_MMAP": "Read",
    "EVENT_OTHER": "Connect", "EVENT_CHECK_FILE_ATTRIBUTES": "Read", "EVENT_LSEEK": "Read", "EVENT_CHANGE_PRINCIPAL": "Auth", "EVENT_SIGNAL": "Execute",
}


def _field(path: str) -> Column:
    return F.get_json_object("value", f"$.datum{path}")


def _uuid(path: str) -> Column:
    """A bare id, or the one in an object around it."""
    whole = _field(path)
    inner = F.coalesce(*(F.get_json_object(whole, f"$['{x}']") for x in (f"{PREFIX}UUID", "UUID", "uuid")))
    return F.nullif(F.coalesce(inner, F.when(~whole.startswith("{"), whole)), F.lit(""))


def cdm(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes id, entity_type, name; edges source_id, dest_id, rel_type, timestamp, event_type) of CDM records, one JSON a line.

    A second object of an event makes a second edge. Times are seconds; an unknown event type is left out.
    """
    event = f"['{PREFIX}Event']"
    rows = lines.where(_field("").isNotNull()).withColumn("event", _field(event))
    kinds = [F.when(_field(f"['{PREFIX}{k}']").isNotNull(), F.struct(F.lit(v).alias("entity_type"), _uuid(f"['{PREFIX}{k}'].uuid").alias("id"), F.coalesce(F.nullif(_field(f"['{PREFIX}{k}'].properties.map.name"), F.lit("")), F.nullif(_field(f"['{PREFIX}{k}'].path"), F.lit(""))).alias("name"))) for k, v in NODE_TYPES.items()]
    nodes = rows.where("event is null").select(F.coalesce(*kinds).alias("n")).where("n is not null").select("n.id", "n.entity_type", F.coalesce("n.name", F.left("n.id", F.lit(12))).alias("name"))
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(EVENT_TYPES.items())))
    kind = _field(f"{event}.type")
    seconds = F.coalesce(F.when(_field(f"{event}.timestampNanos").rlike(r"^-?\d+$"), F.floor(_field(f"{event}.timestampNanos").try_cast("decimal(20,0)") / 1_000_000_000).cast("bigint")), F.lit(0).cast("bigint"))
    ends = F.explode(F.filter(F.array(_uuid(f"{event}.predicateObject"), _uuid(f"{event}.predicateObject2")), lambda x: x.isNotNull()))
    edges = rows.where("event is not null").select(_uuid(f"{event}.subject").alias("source_id"), ends.alias("dest_id"), F.try_element_at(table, kind).alias("rel_type"), seconds.alias("timestamp"), kind.alias("event_type"))
    return nodes, edges.where("source_id is not null and rel_type is not null")


def read_cdm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Plain or gzip files."""
    return cdm(spark.read.text(path))


def streamspot(spark: SparkSession, path: str, attacks: tuple[int, int] = (300, 399)) -> DataFrame:
    """(graph_id, source_id, source_type, dest_id, dest_type, edge_type, attack) of six tab-separated columns; ids carry their graph's."""
    rows = spark.read.csv(path, sep="\t", schema="s string, st string, d string, dt string, e string, g int")
    return rows.select(F.col("g").alias("graph_id"), F.concat_ws("_", "g", "s").alias("source_id"), F.col("st").alias("source_type"), F.concat_ws("_", "g", "d").alias("dest_id"), F.col("dt").alias("dest_type"), F.col("e").alias("edge_type"), F.col("g").between(*attacks).alias("attack"))


#: Names of the threat classes, as the model's logits have them.
CLASSES = THREATS


def threat_labels(graph: Graph, malicious: DataFrame) -> DataFrame:
    """(id, label) of every entity, by what known malicious ones (column id) do to their successors.

    A malicious user that authenticates escalates privileges; a malicious entity that
    executes processes moves laterally; one that connects, or reaches an address,
    beacons; any other exfiltrates. Entities that are not malicious are benign. Ids
    that are no entity give no row, repeated ids one.
    """
    bad = malicious.select("id").distinct().withColumn("bad", F.lit(True))
    nodes = graph.entities.select("id", "entity_type").join(bad, "id", "left")
    types = graph.entities.select(F.col("id").alias("dest_id"), F.col("entity_type").alias("dest_type"))
    steps = graph.relations.join(bad.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(types, "dest_id", "left")
    did = steps.groupBy(F.col("source_id").alias("id")).agg(
        F.bool_or(F.col("rel_type") == "Auth").alias("auth"), F.bool_or((F.col("rel_type") == "Execute") & (F.col("dest_type") == "Process")).alias("spawn"),
        F.bool_or((F.col("rel_type") == "Connect") | (F.col("dest_type") == "IP")).alias("net"),
    )
    benign, exfiltration, beacon, lateral, escalation = CLASSES
    label = F.when(F.col("bad").isNull(), benign).when(F.col("auth") & (F.col("entity_type") == "User"), escalation).when(F.col("spawn"), lateral).when(F.col("net"), beacon).otherwise(exfiltration)
    return nodes.join(did, "id", "left").select("id", label.alias("label"))


def balanced(rows: DataFrame, label: str = "label", times: int = 5, least: int = 1000, seed: int = 42) -> DataFrame:
    """All rows of classes other than Benign, and of Benign max(times * those, least) drawn at random."""
    other = rows.where(F.col(label) != "Benign")
    return other.unionByName(rows.where(F.col(label) == "Benign").orderBy(F.rand(seed)).limit(max(times * other.count(), least)))


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight) of every class: inverse counts, of at least 1, that add up to the number of classes; absent ones have n 0."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(x,) for x in CLASSES], f"`{label}` string")
    sizes = names.join(rows.groupBy(label).agg(F.count("*").alias("n")), label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))
    parts = sizes.withColumn("part", 1 / F.greatest("n", F.lit(1)))
    total = parts.agg(F.sum("part").alias("total"))  # one row
    return parts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("part") / F.col("total") * len(CLASSES)).alias("weight"))
