"""What an ingest would make of a file's fields, before it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.functions.fields import canonical_field, canonical_type, suggested_type
from pathloom.sources.records import scalar_fields

# Fields of the two event formats and the entity types proposed for them.
SYSMON_FIELDS: list[tuple[str, str]] = [
    ("EventID", "Skip"), ("UtcTime", "Skip"), ("User", "User"), ("Image", "Process"), ("CommandLine", "Skip"), ("ProcessId", "Skip"), ("ParentImage", "Process"),
    ("ParentProcessId", "Skip"), ("Computer", "Host"), ("SourceIp", "Skip"), ("SourcePort", "Skip"), ("DestinationIp", "IP"), ("DestinationPort", "Skip"),
    ("DestinationHostname", "Skip"), ("Protocol", "Skip"), ("TargetFilename", "File"), ("Hashes", "Skip"), ("QueryName", "Domain"), ("QueryResults", "Skip"), ("QueryType", "Skip"),
]
SENTINEL_FIELDS: list[tuple[str, str]] = [
    ("Type", "Skip"), ("TimeGenerated", "Skip"), ("Timestamp", "Skip"), ("EventID", "Skip"), ("Computer", "Host"), ("TargetUserName", "User"), ("Account", "User"), ("IpAddress", "Skip"),
    ("SubjectUserName", "User"), ("NewProcessName", "Process"), ("Process", "Process"), ("CommandLine", "Skip"), ("ParentProcessName", "Process"), ("ProcessName", "Process"),
    ("ObjectName", "File"), ("UserPrincipalName", "User"), ("UserDisplayName", "User"), ("IPAddress", "IP"), ("AppDisplayName", "Skip"), ("DeviceName", "Host"), ("FileName", "Process"),
    ("FolderPath", "File"), ("InitiatingProcessFileName", "Process"), ("InitiatingProcessFolderPath", "Process"), ("InitiatingProcessAccountName", "User"),
    ("InitiatingProcessParentFileName", "Process"), ("RemoteIP", "IP"), ("RemoteUrl", "Skip"), ("SourceIP", "IP"), ("DestinationIP", "IP"), ("DestinationPort", "Skip"), ("AccountName", "User"),
]


def proposed_mapping(spark: SparkSession, format: str, names: list[str] | None = None) -> DataFrame:
    """(field, entity_type) in order: fixed lists for sysmon and sentinel, by name for other formats."""
    fixed = {"sysmon": SYSMON_FIELDS, "sentinel": SENTINEL_FIELDS}.get(format)
    if fixed:
        return spark.createDataFrame([(i, *x) for i, x in enumerate(fixed)], "at int, field string, entity_type string").orderBy("at").drop("at")
    rows = spark.createDataFrame(list(enumerate(names or [])), "at int, field string")
    return rows.withColumn("entity_type", canonical_type(canonical_field(F.col("field")))).orderBy("at").drop("at")


def profile(records: DataFrame, samples: int = 5) -> DataFrame:
    """(field, count, samples, canonical, role, entity_type) of record fields, nodes first, then by name.

    Strings that are not empty, numbers and booleans count. Fields with a canonical
    name are Node, others Metadata; the entity type is what the name suggests.
    """
    flags = F.map_filter("texts", lambda k, v: F.element_at("kinds", k) == "BOOLEAN")
    each = records.select(F.explode(F.concat(scalar_fields(F.col("kinds"), F.col("texts")), F.map_entries(flags))).alias("e")).select(F.col("e.key").alias("field"), F.col("e.value").alias("value"))
    seen = each.groupBy("field", "value").agg(F.count("*").alias("n"))  # distinct values first, so that no list grows with the rows
    order = Window.partitionBy("field").orderBy("value")  # each task keeps a field's first values before they meet
    first = seen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= samples)
    firsts = first.groupBy("field").agg(F.sort_array(F.collect_list("value")).alias("samples"))
    name = canonical_field(F.col("field"))
    role = F.when(name.isNotNull(), "Node").otherwise("Metadata")
    out = seen.groupBy("field").agg(F.sum("n").alias("count")).join(firsts, "field", "left").withColumns({"canonical": name, "role": role, "entity_type": suggested_type(F.col("field"))})
    return out.orderBy(F.desc("role"), "field")
