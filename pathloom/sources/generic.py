"""Any flat or nested records as triples, by what their field names mean."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.fields import ALIASES, CANONICAL, canonical_field, promoted_relation
from pathloom.functions.times import generic_seconds
from pathloom.sources.records import scalar_fields
from pathloom.sources.triples import explode_triples, meta, triple

# Nested fields of the Elastic schema and the canonical field each one fills; the first that is there fills it.
NESTED: list[tuple[str, str]] = [
    ("source.ip", "source_ip"), ("source.address", "source_ip"), ("destination.ip", "target_ip"), ("destination.address", "target_ip"), ("user.name", "source_user"),
    ("user.target.name", "target_user"), ("process.name", "source_process"), ("process.executable", "source_process"), ("process.parent.name", "parent_process"),
    ("process.parent.executable", "parent_process"), ("process.command_line", "command_line"), ("file.path", "target_file"), ("dns.question.name", "target_domain"),
    ("url.original", "target_url"), ("registry.path", "target_registry"), ("host.name", "source_host"), ("host.hostname", "source_host"), ("source.port", "source_port"),
    ("destination.port", "target_port"), ("network.protocol", "protocol"), ("@timestamp", "timestamp"), ("event.created", "timestamp"),
]


def nested_fields(raw: Column, kinds: Column) -> Column:
    """Canonical fields that nested objects fill, as a map; fields that are there already win."""
    by_name: dict[str, list[str]] = {}
    for path, name in NESTED:
        by_name.setdefault(name, []).append(path)
    values = {}
    for name, paths in by_name.items():
        got = F.coalesce(*(F.coalesce(F.get_json_object(raw, f"$['{p}']"), F.get_json_object(raw, f"$.{p}") if "@" not in p else F.lit(None)) for p in paths))
        values[name] = F.when(~F.map_contains_key(kinds, name), got)
    return meta(**values)


def normalized(records: DataFrame, nested: bool = True) -> DataFrame:
    """One column for each canonical field: its first spelling in byte order of names; of times the last, 0 if it cannot be read.

    Strings that are not empty and numbers as written count. nested also reads nested objects.
    """
    kinds, texts = F.col("kinds"), F.col("texts")
    if nested:
        more = F.when(F.exists(F.map_values("kinds"), lambda k: k.startswith("OBJECT")), nested_fields(F.col("raw"), kinds)).otherwise(meta())
        more = F.map_filter(more, lambda k, v: ~F.map_contains_key(kinds, k) & (v != ""))
        records = records.withColumn("more", more)
        records = records.withColumns({"kinds": F.map_concat("kinds", F.transform_values("more", lambda k, v: F.lit("STRING"))), "texts": F.map_concat("texts", "more")}).drop("more")
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(CANONICAL.items())))
    pairs = F.transform(scalar_fields(kinds, texts), lambda e: F.struct(F.try_element_at(table, F.lower(e["key"])).alias("c"), e["value"].alias("v")))
    rows = records.withColumn("pairs", F.filter(pairs, lambda p: p["c"].isNotNull()))

    def pick(name: str, place: int) -> Column:
        return F.try_element_at(F.filter("pairs", lambda p: p["c"] == name), F.lit(place))["v"]

    rows = rows.withColumns({name: pick(name, 1) for name in ALIASES if name != "timestamp"} | {"timestamp": generic_seconds(pick("timestamp", -1))})
    return rows.drop("pairs")


def rules() -> list[Column]:
    """Triples that canonical fields imply, in order; the last three stand in for a record that gives no other."""
    c = F.col
    user, process, host = ("User", c("source_user")), ("Process", c("source_process")), ("Host", c("source_host"))
    source_ip, target_ip, target_user = ("IP", c("source_ip")), ("IP", c("target_ip")), ("User", c("target_user"))
    no_process, no_host, no_user = c("source_process").isNull(), c("source_host").isNull(), c("source_user").isNull()
    command, port, protocol = meta(cmdline=c("command_line")), meta(dest_port=c("target_port")), meta(protocol=c("protocol"))
    return [
        triple(("Process", c("parent_process")), "Spawn", process, dst_meta=command),
        triple(user, "Execute", process, dst_meta=command),
        triple(host, "Connect", target_ip, rel_meta=protocol, dst_meta=port),
        triple(source_ip, "Connect", target_ip, no_host, src_meta=meta(source_port=c("source_port")), rel_meta=protocol, dst_meta=port),
        triple(user, "Auth", host, no_process),
        triple(target_user, "Auth", host, no_process & no_user),
        triple(process, "Write", ("File", c("target_file"))),
        triple(process, "DNS", ("Domain", c("target_domain"))),
        triple(process, "Connect", ("URL", c("target_url"))),
        triple(process, "Modify", ("Registry", c("target_registry"))),
        triple(user, "Auth", target_ip, no_process & no_host),
    ]


def _found() -> Column:
    full = F.filter(F.array(*rules()), lambda t: t.isNotNull())
    alone = [("Host", "source_host", "Connect"), ("Process", "source_process", "Execute"), ("User", "source_user", "Auth")]
    loop = F.coalesce(*(triple((kind, F.col(x)), relation, (kind, F.col(x))) for kind, x, relation in alone))
    return F.when(F.size(full) > 0, full).otherwise(F.array(loop))


def generic_triples(records: DataFrame, nested: bool = True) -> DataFrame:
    return explode_triples(normalized(records, nested), _found(), F.col("timestamp"))


def configured_triples(records: DataFrame, roles: dict[str, tuple[str, str | None]], nested: bool = True) -> DataFrame:
    """generic_triples() and, for unknown fields of role Node, one from the record's anchor to `field:value`.

    roles maps a field to (role, entity type); roles Metadata and Ignore change
    nothing. The anchor is the first of process, user, host, source and target address.
    """
    nodes = {k: kind or "Other" for k, (role, kind) in roles.items() if role == "Node"}
    rows = normalized(records, nested)
    found = F.filter(_found(), lambda t: t.isNotNull())
    if nodes:
        table = F.create_map(*(F.lit(x) for x in chain.from_iterable(nodes.items())))
        order = [("Process", "source_process"), ("User", "source_user"), ("Host", "source_host"), ("IP", "source_ip"), ("IP", "target_ip")]
        anchor = F.coalesce(*(F.col(x) for _, x in order))
        anchor_type = F.coalesce(*(F.when(F.col(x).isNotNull(), kind) for kind, x in order))
        marked = F.filter(scalar_fields(F.col("kinds"), F.col("texts")), lambda e: F.map_contains_key(table, e["key"]) & canonical_field(e["key"]).isNull())

        def promote(e: Column) -> Column:
            kind = F.element_at(table, e["key"])
            return triple((anchor_type, anchor), promoted_relation(kind), (kind, F.concat_ws(":", e["key"], e["value"])))

        found = F.concat(found, F.transform(marked, promote))
    return explode_triples(rows, found, F.col("timestamp"))
