"""Microsoft Sentinel tables as triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.times import cloud_seconds
from pathloom.sources.records import either_of, present, text_of, whole_of
from pathloom.sources.triples import explode_triples, meta, triple

TABLES = ("SecurityEvent", "SigninLogs", "DeviceProcessEvents", "DeviceNetworkEvents", "DeviceFileEvents", "CommonSecurityLog")


def table_of() -> Column:
    """The table of a record: its `Type`, or what its fields tell, in fixed priority."""
    named = text_of("Type")
    devices = present("InitiatingProcessFileName") & present("FileName") & present("FolderPath")
    guessed = (
        F.when(present("EventID") & present("Computer"), "SecurityEvent")
        .when(present("UserPrincipalName") | present("AppDisplayName") | (present("IPAddress") & present("ResultType")), "SigninLogs")
        .when(devices & F.contains(text_of("ActionType"), F.lit("File")), "DeviceFileEvents")
        .when(devices, "DeviceProcessEvents")
        .when(present("RemoteIP") | present("RemotePort"), "DeviceNetworkEvents")
        .when(present("SourceIP") & present("DestinationIP"), "CommonSecurityLog")
    )
    return F.when(named.isin(*TABLES), named).when(named.isNull(), guessed)


def rules() -> dict[str, list[Column]]:
    """Triples of each table, in order."""
    f, n = text_of, either_of
    event = F.col("event")
    user = F.coalesce(f("SubjectUserName"), f("Account"))
    child = ("Process", F.coalesce(f("NewProcessName"), f("Process")))
    child_meta = meta(pid=n("NewProcessId"), cmdline=f("CommandLine"), computer=f("Computer"))
    path = ("Process", F.when(f("FileName").isNotNull(), F.coalesce(f("FolderPath"), f("FileName"))))
    path_meta = meta(cmdline=f("ProcessCommandLine"), device=f("DeviceName"), sha256=f("SHA256"))
    initiating = ("Process", F.when(f("InitiatingProcessFileName").isNotNull(), F.coalesce(f("InitiatingProcessFolderPath"), f("InitiatingProcessFileName"))))
    action = F.when(F.contains(f("ActionType"), F.lit("Read")), "Read").otherwise("Write")
    return {
        "SecurityEvent": [
            triple(
                ("User", F.coalesce(f("TargetUserName"), f("Account"))), "Auth", ("Host", f("Computer")), event.isin(4624, 4625), dst_meta=meta(source_ip=f("IpAddress")),
                rel_meta=meta(event_id=event, status=F.when(event == 4624, "Success").otherwise("Failure"), logon_type=n("LogonType")),
            ),
            triple(("User", user), "Execute", child, event == 4688, dst_meta=child_meta),
            triple(("Process", f("ParentProcessName")), "Execute", child, event == 4688, dst_meta=child_meta),
            triple(("Process", f("ProcessName")), "Read", ("File", f("ObjectName")), event == 4663),
        ],
        "SigninLogs": [
            triple(
                ("User", F.coalesce(f("UserPrincipalName"), f("UserDisplayName"))), "Auth", ("IP", f("IPAddress")), dst_meta=meta(app=f("AppDisplayName"), location=F.coalesce(f("Location"), f("LocationDetails"))),
                rel_meta=meta(status=F.when(n("ResultType") == "0", "Success").when(n("ResultType").isNotNull(), "Failure"), app=f("AppDisplayName")),
            )
        ],
        "DeviceProcessEvents": [
            triple(("User", F.coalesce(f("AccountName"), f("InitiatingProcessAccountName"))), "Execute", path, dst_meta=path_meta),
            triple(initiating, "Execute", path, dst_meta=path_meta),
        ],
        "DeviceNetworkEvents": [
            triple(("Host", f("DeviceName")), "Connect", ("IP", f("RemoteIP")), dst_meta=meta(remote_port=n("RemotePort"), url=f("RemoteUrl"), protocol=f("Protocol")), rel_meta=meta(action=f("ActionType"), local_port=n("LocalPort")))
        ],
        "DeviceFileEvents": [triple(initiating, action, ("File", path[1]), dst_meta=meta(sha256=f("SHA256")))],
        "CommonSecurityLog": [
            triple(("IP", f("SourceIP")), "Connect", ("IP", f("DestinationIP")), dst_meta=meta(dest_port=n("DestinationPort")), rel_meta=meta(vendor=f("DeviceVendor"), action=F.coalesce(f("DeviceAction"), f("Activity")), protocol=f("Protocol")))
        ],
    }


def cloud_triples(records: DataFrame) -> DataFrame:
    """Triples of Sentinel records; a numeric or textual EventID is read alike, time is TimeGenerated or Timestamp."""
    event = F.coalesce(whole_of("EventID"), text_of("EventID")).try_cast("bigint")
    rows = records.withColumns({"event": event, "table": table_of()})
    found = None
    for table, made in rules().items():
        own, here = F.array(*made), F.col("table") == table
        found = F.when(here, own) if found is None else found.when(here, own)
    return explode_triples(rows, found, cloud_seconds(F.coalesce(text_of("TimeGenerated"), text_of("Timestamp"))))
