"""Query services as sources: Log Analytics and Elasticsearch replies, and a paging reader over either.

The reply normalisers are DataFrame operations and work on stored replies; the
reader fetches pages with a cursor through a function that does the request, so
that authentication and transport stay with the caller.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pathloom.sources.records import element_of, field_maps

#: Rows that a query asks for unless told otherwise.
TAKE, SIZE = 10_000, 1000
#: A page stands for a partition in the numbers of its records, so that any number of pages has room.
_FILE = 33


def log_analytics_query(table: str = "SecurityEvent", hours: int = 24, take: int = TAKE) -> str:
    return f"{table} | where TimeGenerated > ago({hours}h) | order by TimeGenerated asc | take {take}"


def log_analytics_records(replies: DataFrame) -> DataFrame:
    """Records of replies (rec, value): `tables[].columns[]` name the cells of `rows[][]`."""
    tables = F.explode(F.from_json(F.get_json_object("value", "$.tables"), "array<struct<columns:array<struct<name:string>>,rows:array<array<variant>>>>"))
    rows = replies.select("rec", tables.alias("t")).select("rec", F.col("t.columns.name").alias("names"), F.posexplode("t.rows").alias("at", "cells"))
    full = F.filter(F.arrays_zip("names", "cells"), lambda x: x["names"].isNotNull())
    kinds = F.map_from_entries(F.transform(full, lambda x: F.struct(x["names"].alias("key"), F.coalesce(F.schema_of_variant(x["cells"]), F.lit("VOID")).alias("value"))))
    texts = F.map_from_entries(F.transform(full, lambda x: F.struct(x["names"].alias("key"), x["cells"].cast("string").alias("value"))))
    return rows.select(element_of(F.col("rec"), F.col("at")).alias("rec"), F.to_json("names").alias("raw"), kinds.alias("kinds"), texts.alias("texts"))


def next_query_start(records: DataFrame) -> str | None:
    """The latest TimeGenerated, from which a next query would go on."""
    return records.agg(F.max(F.try_element_at("texts", F.lit("TimeGenerated")))).first()[0]


def elastic_request(query: str = "*", size: int = SIZE, after: list | None = None) -> dict:
    body = {"size": size, "query": {"query_string": {"query": query}}, "sort": [{"@timestamp": "asc"}, {"_id": "asc"}]}
    return body | ({"search_after": after} if after else {})


def elastic_records(replies: DataFrame) -> DataFrame:
    """Records of replies (rec, value): each hit's `_source`, with `@timestamp` as TimeGenerated where there is none."""
    hits = F.posexplode(F.from_json(F.get_json_object("value", "$.hits.hits"), "array<string>"))
    rows = replies.select("rec", hits.alias("at", "hit")).select("rec", "at", F.get_json_object("hit", "$._source").alias("raw"))
    kinds, texts = field_maps(F.col("raw"))
    rows = rows.select(element_of(F.col("rec"), F.col("at")).alias("rec"), "raw", kinds.alias("kinds"), texts.alias("texts")).where("kinds is not null")
    time = F.map_contains_key("kinds", "@timestamp") & ~F.map_contains_key("kinds", "TimeGenerated")

    def timed(column: str):
        return F.when(time, F.map_concat(column, F.create_map(F.lit("TimeGenerated"), F.element_at(column, F.lit("@timestamp"))))).otherwise(F.col(column))

    return rows.select("rec", "raw", timed("kinds").alias("kinds"), timed("texts").alias("texts"))


def elastic_cursor(reply: str) -> list | None:
    """Sort values of the last hit, for search_after."""
    hits = json.loads(reply).get("hits", {}).get("hits", [])
    return hits[-1].get("sort") if hits else None


def paging_source(name: str, fetch: Callable[[object], tuple[str, object]], start: object = None, pages: int | None = None) -> type[DataSource]:
    """A DataSource of replies (rec, value). fetch(cursor) gives (reply, next cursor); None ends, `start` begins.

    A reader that has had `pages` pages while there are more raises an error: what it
    gives is whole or nothing. Register it with spark.dataSource.register() and read
    format(name).
    """

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition(0)]  # a cursor is one sequence

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            cursor = start
            for number in count():
                if number == pages:
                    raise ValueError(f"more than {pages} pages")
                reply, cursor = fetch(cursor)
                yield number << _FILE, reply
                if cursor is None:
                    return

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "rec bigint, value string"

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Source


def read_pages(spark: SparkSession, name: str, fetch: Callable[[object], tuple[str, object]], start: object = None, pages: int | None = None) -> DataFrame:
    spark.dataSource.register(paging_source(name, fetch, start, pages))
    return spark.read.format(name).load()
