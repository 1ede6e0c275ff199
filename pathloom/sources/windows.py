"""Sysmon, Windows Security and PowerShell events as triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.fields import account
from pathloom.functions.times import event_log_seconds
from pathloom.sources.records import field_maps, text_of, unsigned_of, whole_of
from pathloom.sources.triples import explode_triples, meta, triple

UNKNOWN_HOST = "unknown-host"


def flattened(records: DataFrame) -> DataFrame:
    """Records with a numeric `event`; fields of a nested `event_data` object cover those of the top level.

    A nested record without `Computer` takes computer_name, Hostname or host_name.
    """
    nested = F.try_element_at("kinds", F.lit("event_data")).startswith("OBJECT")
    inner_kinds, inner_texts = field_maps(F.when(nested, F.try_element_at("texts", F.lit("event_data"))))
    event = F.coalesce(whole_of("EventID"), whole_of("event_id")).try_cast("bigint")
    rows = records.withColumn("event", event).where("event is not null").withColumn("ik", inner_kinds).withColumn("it", inner_texts)

    def overlay(outer: str, inner: str) -> Column:
        own = F.map_filter(F.col(outer), lambda k, v: (k != "event_data") & ~F.map_contains_key(F.col(inner), k))
        return F.when(F.col(inner).isNull(), F.col(outer)).otherwise(F.map_concat(own, F.col(inner)))

    rows = rows.withColumns({"kinds": overlay("kinds", "ik"), "texts": overlay("texts", "it")})
    name = F.coalesce(*(F.when(F.map_contains_key("kinds", x), F.lit(x)) for x in ("computer_name", "Hostname", "host_name")))
    lacks = F.col("ik").isNotNull() & ~F.map_contains_key("kinds", "Computer") & name.isNotNull()

    def named(column: str) -> Column:
        return F.when(lacks, F.map_concat(column, F.create_map(F.lit("Computer"), F.element_at(column, name)))).otherwise(F.col(column))

    return rows.withColumns({"kinds": named("kinds"), "texts": named("texts")}).drop("ik", "it")


def rules() -> dict[tuple[int, ...], list[Column]]:
    """Triples of each event id, in order."""
    f, n = text_of, unsigned_of
    host = F.coalesce(f("Computer"), f("Hostname"), F.lit(UNKNOWN_HOST))
    image, target = ("Process", f("Image")), ("File", f("TargetFilename"))
    source_image, target_image = ("Process", f("SourceImage")), ("Process", f("TargetImage"))
    dest_ip = ("IP", f("DestinationIp"))
    dest_meta = meta(dest_port=f("DestinationPort"), hostname=f("DestinationHostname"), protocol=f("Protocol"))
    child_meta = meta(pid=n("ProcessId"), cmdline=f("CommandLine"), computer=f("Computer"))
    created = ("Process", f("NewProcessName"))
    created_meta = meta(cmdline=f("CommandLine"), computer=F.coalesce(f("Computer"), f("Hostname")))
    subject = ("User", account(f("SubjectDomainName"), f("SubjectUserName")))
    share = F.when(f("RelativeTargetName").isNotNull(), F.concat(f("ShareName"), F.lit("\\"), f("RelativeTargetName"))).otherwise(f("ShareName"))
    registry_or_file = F.when(f("ObjectType") == "Key", "Registry").otherwise("File")
    failed = F.when(F.col("event") == 4625, "false")
    return {
        (1,): [
            triple(("User", f("User")), "Execute", image, dst_meta=child_meta),
            triple(("Process", f("ParentImage")), "Spawn", image, src_meta=meta(pid=n("ParentProcessId")), dst_meta=child_meta),
        ],
        (2,): [triple(image, "Modify", target, rel_meta=meta(creation_utc_time=f("CreationUtcTime"), previous_creation_utc_time=f("PreviousCreationUtcTime")))],
        (3,): [
            triple(("Host", F.coalesce(f("Computer"), f("Hostname"), f("SourceHostname"), F.lit(UNKNOWN_HOST))), "Connect", dest_ip, src_meta=meta(source_ip=f("SourceIp"), source_port=f("SourcePort")), rel_meta=meta(image=f("Image")), dst_meta=dest_meta),
            triple(image, "Connect", dest_ip, dst_meta=dest_meta),
        ],
        (5,): [triple(image, "Delete", ("Host", host), src_meta=meta(pid=n("ProcessId")))],
        (7,): [triple(image, "Read", ("File", f("ImageLoaded")), dst_meta=meta(signed=f("Signed"), signature_status=f("SignatureStatus"), hashes=f("Hashes")))],
        (8,): [triple(source_image, "Execute", target_image, rel_meta=meta(start_address=f("StartAddress"), new_thread_id=f("NewThreadId"), start_module=f("StartModule")))],
        (9,): [triple(image, "Read", ("File", f("Device")))],
        (10,): [triple(source_image, "Read", target_image, rel_meta=meta(granted_access=f("GrantedAccess"), call_trace=f("CallTrace")))],
        (11,): [triple(image, "Write", target, dst_meta=meta(hashes=f("Hashes")))],
        (12, 13): [triple(image, "Modify", ("Registry", f("TargetObject")), rel_meta=meta(event_type=f("EventType"), details=f("Details")))],
        (15,): [triple(image, "Write", target, dst_meta=meta(hash=f("Hash")))],
        (17,): [triple(image, "Write", ("File", f("PipeName")))],
        (18,): [triple(image, "Connect", ("File", f("PipeName")))],
        (22,): [triple(image, "DNS", ("Domain", f("QueryName")), dst_meta=meta(query_results=f("QueryResults"), query_type=f("QueryType")))],
        (23,): [triple(image, "Delete", target, dst_meta=meta(hashes=f("Hashes"), is_executable=f("IsExecutable")))],
        (4624, 4625): [
            triple(("User", account(f("TargetDomainName"), f("TargetUserName"))), "Auth", ("Host", host), rel_meta=meta(logon_type=F.coalesce(f("LogonType"), n("LogonType")), ip_address=F.nullif(f("IpAddress"), F.lit("-")), success=failed))
        ],
        (4688,): [
            triple(subject, "Execute", created, dst_meta=created_meta),
            triple(("Process", f("ParentProcessName")), "Spawn", created, dst_meta=created_meta),
        ],
        (4689,): [triple(("Process", f("ProcessName")), "Delete", ("Host", host))],
        (4663,): [triple(("Process", f("ProcessName")), "Read", (registry_or_file, f("ObjectName")))],
        (5145,): [triple(subject, "Read", ("File", share), dst_meta=meta(ip_address=f("IpAddress")))],
        (5156,): [triple(("Process", f("Application")), "Connect", ("IP", f("DestAddress")), rel_meta=meta(source_address=f("SourceAddress")), dst_meta=meta(dest_port=f("DestPort"), source_port=f("SourcePort"), protocol=f("Protocol")))],
        (4104,): [triple(("Host", host), "Execute", ("Process", F.lit("powershell.exe")), dst_meta=meta(script_preview=F.substring(f("ScriptBlockText"), 1, 200), script_block_id=f("ScriptBlockId")))],
    }


def windows_triples(records: DataFrame) -> DataFrame:
    """Triples of Sysmon and Windows event records; other records give none.

    Time is the first of UtcTime, EventTime and @timestamp that is not empty; if that
    one cannot be read it is 0.
    """
    found = None
    for events, made in rules().items():
        own = F.array(*made)
        found = F.when(F.col("event").isin(*events), own) if found is None else found.when(F.col("event").isin(*events), own)
    time = F.coalesce(text_of("UtcTime"), text_of("EventTime"), text_of("@timestamp"))
    return explode_triples(flattened(records), found, event_log_seconds(time))


def rendered_event_records(records: DataFrame) -> DataFrame:
    """Records of binary event logs that a tool has rendered to nested JSON, in the flat Sysmon form.

    `Event.System` gives EventID (a number, a numeric text or an object with `#text`),
    Computer and TimeCreated; `Event.EventData` (or UserData) gives the rest.
    """
    raw = F.col("raw")
    system, data = (F.coalesce(*(F.get_json_object(raw, f"$.{top}{part}") for top in ("Event.", "") for part in parts)) for parts in (("System",), ("EventData", "UserData")))
    event = F.coalesce(F.get_json_object(system, "$.EventID.#text"), F.get_json_object(system, "$.EventID['#text']"), F.get_json_object(system, "$.EventID"))
    time = F.coalesce(F.get_json_object(system, "$.TimeCreated['#attributes'].SystemTime"), F.get_json_object(system, "$.TimeCreated.SystemTime"))
    inner_kinds, inner_texts = field_maps(data)
    clock = F.regexp_replace(time, r"(\.\d+)?\+00:00$", "Z")
    added = {"EventID": event.try_cast("bigint").cast("string"), "Computer": F.get_json_object(system, "$.Computer"), "UtcTime": clock}
    kinds = meta(**{k: F.when(v.isNotNull(), "BIGINT" if k == "EventID" else "STRING") for k, v in added.items()})
    rows = records.where(event.try_cast("bigint").isNotNull())
    rest = [F.map_filter(F.coalesce(x, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*added)) for x in (inner_kinds, inner_texts)]
    return rows.select("rec", "raw", F.map_concat(rest[0], kinds).alias("kinds"), F.map_concat(rest[1], meta(**added)).alias("texts"))
