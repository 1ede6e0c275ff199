"""Every parsing rule as a query: events written as logs of a format and parsed again.

A case is the fields of a log line and the triples that the line must give. Fields
and triples are SQL expressions over the events (event_id, t, user_id, event_type, k)
that Spark and DuckDB read alike; event number modulo the number of cases picks the
case, so that all events take part. The SQL is the union of the expected triples.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = "b AS (SELECT event_id, (epoch_us(ts) // 1000000) AS t, user_id, event_type, props ->> '$.k' AS k FROM events)"
U, V, E, K, IP, IP2 = "'u' || user_id", "'v' || user_id", "event_type || '.exe'", "k", "'10.0.0.' || k", "'10.1.0.' || user_id"
HOST, FILE = "'h' || user_id", "'/tmp/' || event_type"


@dataclass(frozen=True)
class Triple:
    """(type, expression) of both ends, the relation, and metadata by end or relation."""

    src: tuple[str, str]
    relation: str
    dst: tuple[str, str]
    src_meta: dict[str, str] = field(default_factory=dict)
    rel_meta: dict[str, str] = field(default_factory=dict)
    dst_meta: dict[str, str] = field(default_factory=dict)
    when: str = "true"


@dataclass(frozen=True)
class Case:
    """strings and numbers are fields; a dot in a name nests it."""

    strings: dict[str, str]
    triples: list[Triple]
    numbers: dict[str, str] = field(default_factory=dict)


def _told(meta: dict[str, str]) -> str:
    return " || ',' || ".join(f"'{k}=' || {v}" for k, v in sorted(meta.items())) if meta else "''"


def expected(cases: list[Case], time: str = "t") -> str:
    """The union of all cases' triples."""
    parts = []
    for i, case in enumerate(cases):
        for t in case.triples:
            parts.append(
                f"SELECT event_id, {t.src[1]} AS src_id, '{t.src[0]}' AS src_type, '{t.relation}' AS rel_type, {t.dst[1]} AS dst_id, '{t.dst[0]}' AS dst_type, {time} AS \"timestamp\", "
                f"{_told(t.src_meta)} || '|' || {_told(t.rel_meta)} || '|' || {_told(t.dst_meta)} AS metadata FROM b WHERE event_id % {len(cases)} = {i} AND {t.when}"
            )
    return f"WITH {BASE}\n" + "\nUNION ALL ".join(parts)


def _struct(entries: list[tuple[str, str]], dotted: bool) -> str:
    """named_struct(...) of (name, expression), nested by the dots of names."""
    tree: dict = {}
    for name, value in entries:
        at = tree
        *path, last = name.split(".") if dotted else [name]
        for part in path:
            at = at.setdefault(part, {})
        at[last] = value

    def build(node: dict) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {build(v) if isinstance(v, dict) else v}" for k, v in node.items()) + ")"

    return build(tree)


def rendered(events: DataFrame, cases: list[Case], time: dict[str, str], dotted: bool = False, wrap: Callable[[str], str] = lambda x: x) -> DataFrame:
    """(rec, value): each event as a JSON object of its case; time fields come with every one."""
    texts = []
    for case in cases:
        entries = [*((k, f"cast({v} as string)") for k, v in (case.strings | time).items()), *((k, f"cast({v} as bigint)") for k, v in case.numbers.items())]
        texts.append(F.expr(wrap(f"to_json({_struct(entries, dotted)})")))
    return events.select(F.col("event_id").alias("rec"), _picked(texts).alias("value"))


def _picked(texts: list[Column]) -> Column:
    out = None
    for i, text in enumerate(texts):
        here = F.col("event_id") % len(texts) == i
        out = F.when(here, text) if out is None else out.when(here, text)
    return out


def shown(triples: DataFrame, number: Column) -> DataFrame:
    """Triples with their event's number and metadata as text."""

    def told(column: str) -> Column:
        return F.array_join(F.array_sort(F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")

    return triples.select(number.alias("event_id"), "src_id", "src_type", "rel_type", "dst_id", "dst_type", "timestamp", F.concat_ws("|", told("src_meta"), told("rel_meta"), told("dst_meta")).alias("metadata"))


_CHILD = {"pid": K, "cmdline": "'run ' || k", "computer": HOST}
_DEST = {"dest_port": "'443'", "hostname": "'x' || k", "protocol": "'tcp'"}
#: Events of Sysmon, Windows Security and PowerShell.
WINDOWS = [
    Case({"User": U, "Image": E, "ParentImage": "'init.exe'", "CommandLine": "'run ' || k", "Computer": HOST}, [Triple(("User", U), "Execute", ("Process", E), dst_meta=_CHILD), Triple(("Process", "'init.exe'"), "Spawn", ("Process", E), {"pid": "'7'"}, {}, _CHILD)], {"EventID": "1", "ProcessId": K, "ParentProcessId": "7"}),
    Case({"Image": E, "TargetFilename": FILE, "CreationUtcTime": "'c'", "PreviousCreationUtcTime": "'p'"}, [Triple(("Process", E), "Modify", ("File", FILE), rel_meta={"creation_utc_time": "'c'", "previous_creation_utc_time": "'p'"})], {"EventID": "2"}),
    Case({"Image": E, "Computer": HOST, "SourceIp": IP2, "SourcePort": "'99'", "DestinationIp": IP, "DestinationPort": "'443'", "DestinationHostname": "'x' || k", "Protocol": "'tcp'"}, [Triple(("Host", HOST), "Connect", ("IP", IP), {"source_ip": IP2, "source_port": "'99'"}, {"image": E}, _DEST), Triple(("Process", E), "Connect", ("IP", IP), dst_meta=_DEST)], {"EventID": "3"}),
    Case({"Image": E, "Hostname": HOST}, [Triple(("Process", E), "Delete", ("Host", HOST), {"pid": K})], {"EventID": "5", "ProcessId": K}),
    Case({"Image": E, "ImageLoaded": FILE, "Signed": "'true'", "SignatureStatus": "'Valid'", "Hashes": "'SHA1=' || k"}, [Triple(("Process", E), "Read", ("File", FILE), dst_meta={"signed": "'true'", "signature_status": "'Valid'", "hashes": "'SHA1=' || k"})], {"EventID": "7"}),
    Case({"SourceImage": E, "TargetImage": "'lsass.exe'", "StartAddress": "'0x' || k", "NewThreadId": K, "StartModule": "'m'"}, [Triple(("Process", E), "Execute", ("Process", "'lsass.exe'"), rel_meta={"start_address": "'0x' || k", "new_thread_id": K, "start_module": "'m'"})], {"EventID": "8"}),
    Case({"Image": E, "Device": "'disk' || k"}, [Triple(("Process", E), "Read", ("File", "'disk' || k"))], {"EventID": "9"}),
    Case({"SourceImage": E, "TargetImage": "'lsass.exe'", "GrantedAccess": "'0x1f'", "CallTrace": "'t' || k"}, [Triple(("Process", E), "Read", ("Process", "'lsass.exe'"), rel_meta={"granted_access": "'0x1f'", "call_trace": "'t' || k"})], {"EventID": "10"}),
    Case({"Image": E, "TargetFilename": FILE, "Hashes": "'h' || k"}, [Triple(("Process", E), "Write", ("File", FILE), dst_meta={"hashes": "'h' || k"})], {"EventID": "11"}),
    Case({"Image": E, "TargetObject": "'HKLM:' || k", "EventType": "'CreateKey'", "Details": "'d' || k"}, [Triple(("Process", E), "Modify", ("Registry", "'HKLM:' || k"), rel_meta={"event_type": "'CreateKey'", "details": "'d' || k"})], {"EventID": "12 + event_id % 2"}),
    Case({"Image": E, "TargetFilename": FILE, "Hash": "'h' || k"}, [Triple(("Process", E), "Write", ("File", FILE), dst_meta={"hash": "'h' || k"})], {"EventID": "15"}),
    Case({"Image": E, "PipeName": "'pipe' || k"}, [Triple(("Process", E), "Write", ("File", "'pipe' || k"))], {"EventID": "17"}),
    Case({"Image": E, "PipeName": "'pipe' || k"}, [Triple(("Process", E), "Connect", ("File", "'pipe' || k"))], {"EventID": "18"}),
    Case({"Image": E, "QueryName": "'d' || k", "QueryResults": IP, "QueryType": "'A'"}, [Triple(("Process", E), "DNS", ("Domain", "'d' || k"), dst_meta={"query_results": IP, "query_type": "'A'"})], {"EventID": "22"}),
    Case({"Image": E, "TargetFilename": FILE, "Hashes": "'h' || k", "IsExecutable": "'true'"}, [Triple(("Process", E), "Delete", ("File", FILE), dst_meta={"hashes": "'h' || k", "is_executable": "'true'"})], {"EventID": "23"}),
    Case({"TargetDomainName": "'dom'", "TargetUserName": U, "Computer": HOST, "LogonType": K, "IpAddress": IP}, [Triple(("User", "'dom\\' || " + U), "Auth", ("Host", HOST), rel_meta={"logon_type": K, "ip_address": IP})], {"EventID": "4624"}),
    Case({"TargetUserName": U, "IpAddress": "'-'"}, [Triple(("User", U), "Auth", ("Host", "'unknown-host'"), rel_meta={"logon_type": K, "success": "'false'"})], {"EventID": "4625", "LogonType": K}),
    Case({"SubjectDomainName": "'dom'", "SubjectUserName": U, "NewProcessName": E, "ParentProcessName": "'init.exe'", "CommandLine": "'run ' || k", "Computer": HOST}, [Triple(("User", "'dom\\' || " + U), "Execute", ("Process", E), dst_meta={"cmdline": "'run ' || k", "computer": HOST}), Triple(("Process", "'init.exe'"), "Spawn", ("Process", E), dst_meta={"cmdline": "'run ' || k", "computer": HOST})], {"EventID": "4688"}),
    Case({"ProcessName": E, "Computer": HOST}, [Triple(("Process", E), "Delete", ("Host", HOST))], {"EventID": "4689"}),
    Case({"ProcessName": E, "ObjectName": FILE, "ObjectType": "case when k = '1' then 'Key' else 'File' end"}, [Triple(("Process", E), "Read", ("Registry", FILE), when="k = '1'"), Triple(("Process", E), "Read", ("File", FILE), when="k <> '1'")], {"EventID": "4663"}),
    Case({"SubjectUserName": U, "ShareName": "'share'", "RelativeTargetName": "'f' || k", "IpAddress": IP}, [Triple(("User", U), "Read", ("File", "'share\\f' || k"), dst_meta={"ip_address": IP})], {"EventID": "5145"}),
    Case({"Application": E, "SourceAddress": IP2, "DestAddress": IP, "DestPort": "'443'", "SourcePort": "'99'", "Protocol": "'6'"}, [Triple(("Process", E), "Connect", ("IP", IP), rel_meta={"source_address": IP2}, dst_meta={"dest_port": "'443'", "source_port": "'99'", "protocol": "'6'"})], {"EventID": "5156"}),
    Case({"Computer": HOST, "ScriptBlockText": "repeat('ab' || k, 150)", "ScriptBlockId": K}, [Triple(("Host", HOST), "Execute", ("Process", "'powershell.exe'"), dst_meta={"script_preview": "substring(repeat('ab' || k, 150), 1, 200)", "script_block_id": K})], {"EventID": "4104"}),
    Case({"Image": E, "User": U}, [], {"EventID": "255"}),
]
#: Records of the cloud tables, by name and by what their fields tell.
CLOUD = [
    Case({"Type": "'SecurityEvent'", "TargetUserName": U, "Computer": HOST, "IpAddress": IP}, [Triple(("User", U), "Auth", ("Host", HOST), rel_meta={"event_id": "'4624'", "status": "'Success'", "logon_type": K}, dst_meta={"source_ip": IP})], {"EventID": "4624", "LogonType": K}),
    Case({"Account": U, "Computer": HOST, "EventID": "'4625'"}, [Triple(("User", U), "Auth", ("Host", HOST), rel_meta={"event_id": "'4625'", "status": "'Failure'"})]),
    Case({"Type": "'SecurityEvent'", "SubjectUserName": U, "NewProcessName": E, "ParentProcessName": "'init.exe'", "NewProcessId": "'0x' || k", "Computer": HOST}, [Triple(("User", U), "Execute", ("Process", E), dst_meta={"pid": "'0x' || k", "computer": HOST}), Triple(("Process", "'init.exe'"), "Execute", ("Process", E), dst_meta={"pid": "'0x' || k", "computer": HOST})], {"EventID": "4688"}),
    Case({"Type": "'SecurityEvent'", "ProcessName": E, "ObjectName": FILE}, [Triple(("Process", E), "Read", ("File", FILE))], {"EventID": "4663"}),
    Case({"UserPrincipalName": U, "IPAddress": IP, "AppDisplayName": "'app'", "Location": "'CH'"}, [Triple(("User", U), "Auth", ("IP", IP), rel_meta={"status": "case when k = '0' then 'Success' else 'Failure' end", "app": "'app'"}, dst_meta={"app": "'app'", "location": "'CH'"})], {"ResultType": K}),
    Case({"Type": "'DeviceProcessEvents'", "AccountName": U, "FileName": "'x.exe'", "FolderPath": E, "InitiatingProcessFileName": "'init.exe'", "DeviceName": HOST, "SHA256": K, "ProcessCommandLine": "'run'"}, [Triple(("User", U), "Execute", ("Process", E), dst_meta={"cmdline": "'run'", "device": HOST, "sha256": K}), Triple(("Process", "'init.exe'"), "Execute", ("Process", E), dst_meta={"cmdline": "'run'", "device": HOST, "sha256": K})]),
    Case({"DeviceName": HOST, "RemoteIP": IP, "RemoteUrl": "'url' || k", "Protocol": "'Tcp'", "ActionType": "'ConnectionSuccess'"}, [Triple(("Host", HOST), "Connect", ("IP", IP), rel_meta={"action": "'ConnectionSuccess'", "local_port": "'99'"}, dst_meta={"remote_port": K, "url": "'url' || k", "protocol": "'Tcp'"})], {"RemotePort": K, "LocalPort": "99"}),
    Case({"InitiatingProcessFileName": E, "FileName": "'f'", "FolderPath": FILE, "ActionType": "'FileCreated'", "SHA256": K}, [Triple(("Process", E), "Write", ("File", FILE), dst_meta={"sha256": K})]),
    Case({"Type": "'DeviceFileEvents'", "InitiatingProcessFileName": E, "FileName": FILE, "ActionType": "'FileRead'"}, [Triple(("Process", E), "Read", ("File", FILE))]),
    Case({"SourceIP": IP2, "DestinationIP": IP, "DeviceVendor": "'vendor'", "Activity": "'deny'", "Protocol": "'udp'"}, [Triple(("IP", IP2), "Connect", ("IP", IP), rel_meta={"vendor": "'vendor'", "action": "'deny'", "protocol": "'udp'"}, dst_meta={"dest_port": K})], {"DestinationPort": K}),
    Case({"Type": "'Unheard'", "UserPrincipalName": U, "IPAddress": IP}, []),
]
#: What canonical fields of any record imply.
GENERIC = [
    Case({"ParentImage": "'init.exe'", "Image": E, "CommandLine": "'run'"}, [Triple(("Process", "'init.exe'"), "Spawn", ("Process", E), dst_meta={"cmdline": "'run'"})]),
    Case({"user": U, "process": E}, [Triple(("User", U), "Execute", ("Process", E))]),
    Case({"hostname": HOST, "dst_ip": IP, "protocol": "'tcp'"}, [Triple(("Host", HOST), "Connect", ("IP", IP), rel_meta={"protocol": "'tcp'"}, dst_meta={"dest_port": "'443'"})], {"dst_port": "443"}),
    Case({"src_ip": IP2, "dst_ip": IP, "src_port": "'99'"}, [Triple(("IP", IP2), "Connect", ("IP", IP), {"source_port": "'99'"})]),
    Case({"user": U, "hostname": HOST}, [Triple(("User", U), "Auth", ("Host", HOST))]),
    Case({"TargetUserName": V, "hostname": HOST}, [Triple(("User", V), "Auth", ("Host", HOST))]),
    Case({"process": E, "TargetFilename": FILE}, [Triple(("Process", E), "Write", ("File", FILE))]),
    Case({"process": E, "QueryName": "'d' || k"}, [Triple(("Process", E), "DNS", ("Domain", "'d' || k"))]),
    Case({"process": E, "url": "'http://x/' || k"}, [Triple(("Process", E), "Connect", ("URL", "'http://x/' || k"))]),
    Case({"process": E, "TargetObject": "'HKLM:' || k"}, [Triple(("Process", E), "Modify", ("Registry", "'HKLM:' || k"))]),
    Case({"user": U, "dst_ip": IP}, [Triple(("User", U), "Auth", ("IP", IP))]),
    Case({"hostname": HOST}, [Triple(("Host", HOST), "Connect", ("Host", HOST))]),
    Case({"process": E}, [Triple(("Process", E), "Execute", ("Process", E))]),
    Case({"user": U}, [Triple(("User", U), "Auth", ("User", U))]),
    Case({"colour": U}, []),
]
#: Nested fields of the Elastic schema.
NESTED = [
    Case({"source.ip": IP2, "destination.ip": IP, "network.protocol": "'tcp'"}, [Triple(("IP", IP2), "Connect", ("IP", IP), {"source_port": "'99'"}, {"protocol": "'tcp'"}, {"dest_port": "'443'"})], {"source.port": "99", "destination.port": "443"}),
    Case({"source.address": IP2, "destination.address": IP}, [Triple(("IP", IP2), "Connect", ("IP", IP))]),
    Case({"user.name": U, "process.name": E, "process.command_line": "'run ' || k"}, [Triple(("User", U), "Execute", ("Process", E), dst_meta={"cmdline": "'run ' || k"})]),
    Case({"process.executable": E, "process.parent.name": "'init.exe'"}, [Triple(("Process", "'init.exe'"), "Spawn", ("Process", E))]),
    Case({"process.executable": E, "process.parent.executable": "'init'", "file.path": FILE}, [Triple(("Process", "'init'"), "Spawn", ("Process", E)), Triple(("Process", E), "Write", ("File", FILE))]),
    Case({"process.name": E, "dns.question.name": "'d' || k"}, [Triple(("Process", E), "DNS", ("Domain", "'d' || k"))]),
    Case({"process.name": E, "url.original": "'http://x/' || k"}, [Triple(("Process", E), "Connect", ("URL", "'http://x/' || k"))]),
    Case({"process.name": E, "registry.path": "'HKLM:' || k"}, [Triple(("Process", E), "Modify", ("Registry", "'HKLM:' || k"))]),
    Case({"user.target.name": V, "host.name": HOST}, [Triple(("User", V), "Auth", ("Host", HOST))]),
    Case({"user.name": U, "host.hostname": HOST}, [Triple(("User", U), "Auth", ("Host", HOST))]),
]
