"""Triples as struct columns, and how records become rows of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.schema import TRIPLE_DDL

#: Triples that one record may give.
SLOTS = 64


def meta(**values: Column) -> Column:
    """A metadata map without the null values."""
    if not values:
        return F.create_map().cast("map<string,string>")
    full = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string"))))
    return F.map_filter(full, lambda k, v: v.isNotNull())


def triple(src: tuple[str | Column, Column], relation: str | Column, dst: tuple[str | Column, Column], when: Column | None = None, src_meta: Column | None = None, rel_meta: Column | None = None, dst_meta: Column | None = None) -> Column:
    """(type, id) -[relation]-> (type, id); null where an id is missing or `when` does not hold."""

    def column(x: str | Column) -> Column:
        return F.lit(x) if isinstance(x, str) else x

    empty = meta()
    made = F.struct(
        src[1].alias("src_id"), column(src[0]).alias("src_type"), (empty if src_meta is None else src_meta).alias("src_meta"), column(relation).alias("rel_type"),
        (empty if rel_meta is None else rel_meta).alias("rel_meta"), dst[1].alias("dst_id"), column(dst[0]).alias("dst_type"), (empty if dst_meta is None else dst_meta).alias("dst_meta"),
    )
    guard = src[1].isNotNull() & dst[1].isNotNull()
    return F.when(guard if when is None else guard & when, made)


def explode_triples(records: DataFrame, found: Column, timestamp: Column) -> DataFrame:
    """Rows of TRIPLE_DDL from an array column of triples; seq orders them as records and rules do."""
    kept = F.filter(found, lambda t: t.isNotNull())
    rows = records.select("rec", timestamp.alias("timestamp"), F.posexplode(kept).alias("at", "t"))
    names = [x.strip().split(" ")[0] for x in TRIPLE_DDL.replace("map<string,string>", "map").split(",")]
    place = {"timestamp": F.col("timestamp"), "seq": F.col("rec") * SLOTS + F.col("at")}
    return rows.select(*(place.get(x, F.col(f"t.{x}")).alias(x) for x in names))
