"""Log sources: text to records, records to triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathloom.sources.cloud import TABLES, cloud_triples
from pathloom.sources.generic import configured_triples, generic_triples
from pathloom.sources.records import csv, json_array, lines_of, mixed_lines, ndjson, read_json, read_lines
from pathloom.sources.windows import rendered_event_records, windows_triples

FORMATS = ("sysmon", "sentinel", "generic", "csv", "evtx")
#: Characters that detection looks at.
HEAD = 8192


def detect(head: str) -> str:
    """Format of a text by its beginning: JSON is sysmon, sentinel or generic by its marks, all else csv."""
    start = head[:HEAD].lstrip("﻿ \t\r\n")
    if start[:1] not in ("[", "{"):
        return "csv"
    if ("EventID" in start or "event_id" in start) and any(x in start for x in ("UtcTime", "Sysmon", "Security-Auditing", "event_data")):
        return "sysmon"
    if '"Type"' in start and any(x in start for x in TABLES):
        return "sentinel"
    return "generic"


def records_of(lines: DataFrame, format: str, whole: DataFrame | None = None) -> DataFrame:
    """Records of (rec, value) lines; `whole` holds the same text in one piece and is read instead if it is a JSON array."""
    if format == "csv":
        return csv(lines)
    if whole is not None:
        return json_array(whole)
    return mixed_lines(lines) if format == "generic" else ndjson(lines)


def triples_of(records: DataFrame, format: str) -> DataFrame:
    if format == "sysmon":
        return windows_triples(records)
    if format == "sentinel":
        return cloud_triples(records)
    if format == "evtx":
        return windows_triples(rendered_event_records(records))
    return generic_triples(records)


def parse_text(spark: SparkSession, text: str, format: str = "auto", limit: int | None = None) -> DataFrame:
    """Triples of a text in hand; limit takes the first records only (preview)."""
    format = detect(text) if format == "auto" else format
    whole = spark.createDataFrame([(0, text)], "rec bigint, value string") if text.lstrip().startswith("[") and format != "csv" else None
    records = records_of(lines_of(spark, text), format, whole)
    return triples_of(records.orderBy("rec").limit(limit) if limit else records, format)


def read_logs(spark: SparkSession, path: str, format: str = "auto") -> DataFrame:
    """Triples of log files. One format and one layout (JSON array or lines) for all files of the path."""
    starts = spark.read.text(path).where("_metadata.file_block_start = 0")  # a later block of a split file would not show a file's beginning
    head = "\n".join(r.value for r in starts.select("value").limit(64).collect())[:HEAD]
    format = detect(head) if format == "auto" else format
    if format != "csv" and head.lstrip("﻿ \t\r\n").startswith("["):
        return triples_of(read_json(spark, path, array=True), format)
    return triples_of(records_of(read_lines(spark, path), format), format)


__all__ = ["FORMATS", "configured_triples", "detect", "parse_text", "read_logs", "records_of", "triples_of"]
