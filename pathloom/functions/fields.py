"""Names of log fields: canonical names, entity types they suggest, relations and labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of each canonical field, compared in lower case.
ALIASES: dict[str, list[str]] = {
    "timestamp": ["timestamp", "utctime", "timegenerated", "eventtime", "time", "date", "datetime", "@timestamp", "event_time", "log_time", "rt", "devicecustomdate1"],
    "source_user": ["user", "username", "src_user", "source_user", "account_name", "subjectusername", "accountname", "userprincipalname", "initiatingprocessaccountname", "actor", "caller", "suser", "suid"],
    "target_user": ["target_user", "targetusername", "dst_user", "dest_user", "targetaccountname", "duser", "duid"],
    "source_ip": ["sourceip", "src_ip", "source_ip", "srcip", "ipaddress", "clientip", "client_ip", "callerip", "caller_ip", "src_addr", "sourceaddress", "src"],
    "target_ip": ["destinationip", "dst_ip", "dest_ip", "target_ip", "dstip", "remoteip", "remote_ip", "dst_addr", "destinationaddress", "server_ip", "dst"],
    "source_host": ["computer", "hostname", "devicename", "source_host", "src_host", "host", "machine", "workstation", "device_name", "agent_hostname", "dhost", "shost", "dvchost"],
    "source_process": ["image", "process_name", "newprocessname", "filename", "source_process", "process", "exe", "executable", "initiatingprocessfilename", "sproc"],
    "parent_process": ["parentimage", "parent_process", "parentprocessname", "initiatingprocessparentfilename", "parent_exe", "ppid_name", "dproc"],
    "command_line": ["commandline", "command_line", "cmdline", "processcommandline", "cmd", "command", "initiatingprocesscommandline"],
    "target_file": ["targetfilename", "objectname", "file_path", "filepath", "folderpath", "target_file", "dest_file", "file", "path", "fname"],
    "target_domain": ["queryname", "domain", "dns_query", "target_domain", "dest_domain", "query", "dnsquery", "requested_domain"],
    "target_url": ["url", "target_url", "remoteurl", "request_url", "uri", "dest_url", "http_url", "request", "requesturl"],
    "target_registry": ["registry_path", "registry_key", "targetobject", "target_registry", "registrykey", "registryvaluename"],
    "protocol": ["protocol", "proto", "transport", "network_protocol"],
    "source_port": ["sourceport", "src_port", "source_port", "sport", "localport", "local_port", "spt"],
    "target_port": ["destinationport", "dst_port", "dest_port", "target_port", "dport", "remoteport", "remote_port", "server_port", "dpt"],
}
# Entity types of canonical fields; the others are skipped.
CANONICAL_TYPES = {
    "source_user": "User", "target_user": "User", "source_ip": "IP", "target_ip": "IP", "source_host": "Host", "source_process": "Process",
    "parent_process": "Process", "target_file": "File", "target_domain": "Domain", "target_url": "URL", "target_registry": "Registry",
}
# Parts of a field name that suggest an entity type; the first that occurs decides.
SUGGESTIONS: list[tuple[str, list[str]]] = [
    ("IP", ["ip", "addr", "address"]),
    ("Host", ["host", "computer", "machine", "device", "workstation"]),
    ("User", ["user", "account", "actor", "principal", "caller"]),
    ("Process", ["process", "image", "exe", "pid", "cmdline", "commandline", "command"]),
    ("File", ["file", "path", "folder", "filename"]),
    ("Domain", ["domain", "dns", "query", "fqdn"]),
    ("URL", ["url", "uri"]),
    ("Registry", ["registry", "regkey"]),
    ("IP", ["port"]),
    ("Service", ["service"]),
]
# Relation from an event's anchor to an entity of each type; others are connected to.
PROMOTED_RELATIONS = {"File": "Write", "Domain": "DNS", "IP": "Connect", "URL": "Connect", "Registry": "Modify", "Process": "Execute", "User": "Auth", "Host": "Connect", "Service": "Connect"}
#: Canonical name of each spelling.
CANONICAL = {alias: name for name, spellings in ALIASES.items() for alias in spellings}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items()))), key)


def canonical_field(name: Column) -> Column:
    """Canonical name of a field, or null."""
    return _lookup(CANONICAL, F.lower(name))


def canonical_type(canonical: Column) -> Column:
    """Entity type of a canonical field; `Skip` for what only describes."""
    return F.coalesce(_lookup(CANONICAL_TYPES, canonical), F.lit("Skip"))


def suggested_type(name: Column) -> Column:
    """Entity type that a field's name suggests, or null."""
    lower, out = F.lower(name), F.lit(None).cast("string")
    for kind, parts in reversed(SUGGESTIONS):
        out = F.when(lower.rlike("|".join(parts)), kind).otherwise(out)
    return out


def promoted_relation(kind: Column) -> Column:
    return F.coalesce(_lookup(PROMOTED_RELATIONS, kind), F.lit("Connect"))


def account(domain: Column, user: Column) -> Column:
    """`DOMAIN\\user`; the user alone where the domain is missing or `-`."""
    return F.when(domain != "-", F.concat(domain, F.lit("\\"), user)).otherwise(user)


def label(node: Column) -> Column:
    """What follows the last backslash; without one, the last 20 characters."""
    return F.when(F.contains(node, F.lit("\\")), F.substring_index(node, "\\", -1)).otherwise(F.right(node, F.lit(20)))
