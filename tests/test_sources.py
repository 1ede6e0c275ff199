import json

import pytest

from pathloom.operators import graph as graphs
from pathloom.operators.tensors import INPUT, around, tensors
from pathloom.operators.generators import as_graph
from pathloom.sources import configured_triples, detect, parse_text
from pathloom.sources.preview import profile, proposed_mapping
from pathloom.sources.provenance import CLASSES, cdm, class_weights, threat_labels
from pathloom.sources.records import lines_of, mixed_lines, ndjson
from pathloom.sources.siem import elastic_cursor, elastic_records, log_analytics_records, next_query_start, read_pages
from pathloom.sources.windows import rendered_event_records
from pathloom.streaming import ingest as streaming
from pathloom.streaming.ingest import GraphSink, stream_logs
from pathloom.workspace import Session, Workspace, drop_dataset


def short(triples):
    return [(r.src_type, r.src_id, r.rel_type, r.dst_type, r.dst_id) for r in triples.orderBy("seq").collect()]


WINDOWS = [
    ({"EventID": 1, "User": "u", "Image": "i", "ParentImage": "p"}, [("User", "u", "Execute", "Process", "i"), ("Process", "p", "Spawn", "Process", "i")]),
    ({"EventID": 2, "Image": "i", "TargetFilename": "f"}, [("Process", "i", "Modify", "File", "f")]),
    ({"EventID": 3, "Image": "i", "DestinationIp": "1.1.1.1"}, [("Host", "unknown-host", "Connect", "IP", "1.1.1.1"), ("Process", "i", "Connect", "IP", "1.1.1.1")]),
    ({"EventID": 5, "Image": "i", "Computer": "c"}, [("Process", "i", "Delete", "Host", "c")]),
    ({"EventID": 7, "Image": "i", "ImageLoaded": "l"}, [("Process", "i", "Read", "File", "l")]),
    ({"EventID": 8, "SourceImage": "s", "TargetImage": "t"}, [("Process", "s", "Execute", "Process", "t")]),
    ({"EventID": 9, "Image": "i", "Device": "d"}, [("Process", "i", "Read", "File", "d")]),
    ({"EventID": 10, "SourceImage": "s", "TargetImage": "t"}, [("Process", "s", "Read", "Process", "t")]),
    ({"EventID": 11, "Image": "i", "TargetFilename": "f"}, [("Process", "i", "Write", "File", "f")]),
    ({"EventID": 13, "Image": "i", "TargetObject": "k"}, [("Process", "i", "Modify", "Registry", "k")]),
    ({"EventID": 15, "Image": "i", "TargetFilename": "f"}, [("Process", "i", "Write", "File", "f")]),
    ({"EventID": 17, "Image": "i", "PipeName": "n"}, [("Process", "i", "Write", "File", "n")]),
    ({"EventID": 18, "Image": "i", "PipeName": "n"}, [("Process", "i", "Connect", "File", "n")]),
    ({"EventID": 22, "Image": "i", "QueryName": "q"}, [("Process", "i", "DNS", "Domain", "q")]),
    ({"EventID": 23, "Image": "i", "TargetFilename": "f"}, [("Process", "i", "Delete", "File", "f")]),
    ({"EventID": 4625, "TargetUserName": "u", "TargetDomainName": "D", "Computer": "c"}, [("User", "D\\u", "Auth", "Host", "c")]),
    ({"EventID": 4624, "TargetUserName": "u", "TargetDomainName": "-"}, [("User", "u", "Auth", "Host", "unknown-host")]),
    ({"EventID": 4688, "NewProcessName": "n", "SubjectUserName": "u", "ParentProcessName": "p"}, [("User", "u", "Execute", "Process", "n"), ("Process", "p", "Spawn", "Process", "n")]),
    ({"EventID": 4689, "ProcessName": "p", "Hostname": "h"}, [("Process", "p", "Delete", "Host", "h")]),
    ({"EventID": 4663, "ProcessName": "p", "ObjectName": "o", "ObjectType": "Key"}, [("Process", "p", "Read", "Registry", "o")]),
    ({"EventID": 5145, "SubjectUserName": "u", "ShareName": "s", "RelativeTargetName": "t"}, [("User", "u", "Read", "File", "s\\t")]),
    ({"EventID": 5156, "Application": "a", "DestAddress": "9.9.9.9"}, [("Process", "a", "Connect", "IP", "9.9.9.9")]),
    ({"EventID": 4104, "Computer": "c"}, [("Host", "c", "Execute", "Process", "powershell.exe")]),
    ({"event_id": 1, "computer_name": "w", "event_data": {"User": "u", "Image": "i"}}, [("User", "u", "Execute", "Process", "i")]),
    ({"EventID": "1", "User": "u", "Image": "i"}, []),
    ({"EventID": 99, "Image": "i"}, []),
]


def test_windows_events(spark):
    text = "\n".join(json.dumps(e) for e, _ in WINDOWS) + "\nnot json\n"
    assert short(parse_text(spark, text, "sysmon")) == [t for _, made in WINDOWS for t in made]


def test_array_equals_lines(spark):
    events = [e for e, _ in WINDOWS]
    lines = short(parse_text(spark, "\n".join(map(json.dumps, events)), "sysmon"))
    assert short(parse_text(spark, json.dumps(events), "sysmon")) == lines


def test_only_strings_are_text_and_numbers_are_pids(spark):
    e = {"EventID": 1, "User": "u", "Image": "i", "ProcessId": 7, "CommandLine": "x", "UtcTime": "2024-06-15 12:00:00.123"}
    r = parse_text(spark, json.dumps(e), "sysmon").first()
    assert r.dst_meta == {"pid": "7", "cmdline": "x"} and r.timestamp == 1718452800
    e = {"EventID": 3, "DestinationIp": "1.1.1.1", "DestinationPort": 443, "UtcTime": "soon"}
    r = parse_text(spark, json.dumps(e), "sysmon").first()
    assert r.dst_meta == {} and r.timestamp == 0


CLOUD = [
    ({"Type": "SecurityEvent", "EventID": "4624", "Account": "a", "Computer": "c"}, [("User", "a", "Auth", "Host", "c")]),
    ({"EventID": 4688, "Computer": "c", "NewProcessName": "n", "SubjectUserName": "u", "ParentProcessName": "p"}, [("User", "u", "Execute", "Process", "n"), ("Process", "p", "Execute", "Process", "n")]),
    ({"Type": "SecurityEvent", "EventID": 4663, "ProcessName": "p", "ObjectName": "o"}, [("Process", "p", "Read", "File", "o")]),
    ({"UserPrincipalName": "u", "IPAddress": "1.2.3.4", "ResultType": 0}, [("User", "u", "Auth", "IP", "1.2.3.4")]),
    ({"InitiatingProcessFileName": "i", "FileName": "f", "FolderPath": "d", "AccountName": "a"}, [("User", "a", "Execute", "Process", "d"), ("Process", "i", "Execute", "Process", "d")]),
    ({"InitiatingProcessFileName": "i", "FileName": "f", "FolderPath": "d", "ActionType": "FileRead"}, [("Process", "i", "Read", "File", "d")]),
    ({"DeviceName": "d", "RemoteIP": "8.8.8.8", "RemotePort": 53}, [("Host", "d", "Connect", "IP", "8.8.8.8")]),
    ({"SourceIP": "1.1.1.1", "DestinationIP": "2.2.2.2"}, [("IP", "1.1.1.1", "Connect", "IP", "2.2.2.2")]),
    ({"Type": "Heartbeat", "SourceIP": "1.1.1.1", "DestinationIP": "2.2.2.2"}, []),
]


def test_cloud_tables(spark):
    assert short(parse_text(spark, "\n".join(json.dumps(e) for e, _ in CLOUD), "sentinel")) == [t for _, made in CLOUD for t in made]


GENERIC = [
    ({"user": "u", "process": "p", "parent_process": "q", "file": "f"}, [("Process", "q", "Spawn", "Process", "p"), ("User", "u", "Execute", "Process", "p"), ("Process", "p", "Write", "File", "f")]),
    ({"host": "h", "dst_ip": "2.2.2.2", "src_ip": "1.1.1.1"}, [("Host", "h", "Connect", "IP", "2.2.2.2")]),
    ({"dst_ip": "2.2.2.2", "src_ip": "1.1.1.1"}, [("IP", "1.1.1.1", "Connect", "IP", "2.2.2.2")]),
    ({"user": "u", "host": "h"}, [("User", "u", "Auth", "Host", "h")]),
    ({"TargetUserName": "t", "Computer": "h"}, [("User", "t", "Auth", "Host", "h")]),
    ({"user": "u", "dst_ip": "2.2.2.2"}, [("User", "u", "Auth", "IP", "2.2.2.2")]),
    ({"host": "h"}, [("Host", "h", "Connect", "Host", "h")]),
    ({"process": "p", "url": "http://x", "query": "d", "registry_key": "k"}, [("Process", "p", "DNS", "Domain", "d"), ("Process", "p", "Connect", "URL", "http://x"), ("Process", "p", "Modify", "Registry", "k")]),
    ({"username": "second", "User": "first", "host": "h"}, [("User", "first", "Auth", "Host", "h")]),
    ({"unknown": 1}, []),
]


def test_generic_rules(spark):
    assert short(parse_text(spark, "\n".join(json.dumps(e) for e, _ in GENERIC), "generic")) == [t for _, made in GENERIC for t in made]


def test_csv(spark):
    text = 'timestamp,src_ip,dst_ip,User,hostname\n2024-01-01 00:00:00,1.1.1.1, 2.2.2.2 ,,"h, ""x"""\n\n1700000000,3.3.3.3,4.4.4.4\n'
    rows = parse_text(spark, text).orderBy("seq").collect()
    assert [(r.src_id, r.dst_id, r.timestamp) for r in rows] == [('h, "x"', "2.2.2.2", 1704067200), ("3.3.3.3", "4.4.4.4", 1700000000)]


def test_cef_keeps_words_of_a_value(spark):
    records = mixed_lines(lines_of(spark, "CEF:0|v|p|1|2|n|5|src=1.1.1.1 msg=a long tale dst=2.2.2.2\nLEEF:1|a|b|c|d|usrName=x\tsrc=3.3.3.3"))
    texts = [r.texts for r in records.orderBy("rec").collect()]
    assert texts == [{"src": "1.1.1.1", "msg": "a long tale", "dst": "2.2.2.2"}, {"usrName": "x", "src": "3.3.3.3"}]


def test_numbers_as_written(spark):
    rows = parse_text(spark, '{"src_ip":"1.1.1.1","dst_ip":"2.2.2.2","dst_port":1.0}', "generic").first()
    assert rows.dst_meta == {"dest_port": "1.0"}


@pytest.mark.parametrize(
    ("head", "format"),
    [('[{"EventID":1,"UtcTime":"x"}]', "sysmon"), ('{"event_id":1,"event_data":{}}', "sysmon"), ('{"Type":"SigninLogs"}', "sentinel"), ('{"a":1}', "generic"), ("a,b\n1,2", "csv"), ("CEF:0|a", "csv")],
)
def test_detection(head, format):
    assert detect(head) == format


def test_promoted_fields(spark):
    records = mixed_lines(lines_of(spark, '{"process":"p","ticket":"T1","note":"n"}'))
    assert short(configured_triples(records, {"ticket": ("Node", "Service"), "note": ("Metadata", None)}))[-1] == ("Process", "p", "Connect", "Service", "ticket:T1")


def test_merge_policies(spark):
    text = "\n".join(json.dumps({"EventID": 3, "Computer": "c", "DestinationIp": "1.1.1.1", "DestinationPort": p}) for p in ("80", "443"))
    triples = parse_text(spark, text, "sysmon")
    for policy, port in ((graphs.FIRST, "80"), (graphs.LAST, "443"), (graphs.APPEND, "80, 443")):
        g, counts = graphs.ingest(graphs.Graph.empty(spark), triples, "d", policy)
        assert tuple(counts.first()) == (2, 2)
        assert g.entities.where("id = '1.1.1.1'").first().metadata["dest_port"] == port
        again, counts = graphs.ingest(g, triples, "e", policy)
        assert tuple(counts.first()) == (0, 2) and {r.dataset_id for r in again.entities.collect()} == {"d"}


def test_first_type_stays(spark):
    g, _ = graphs.ingest(graphs.Graph.empty(spark), parse_text(spark, '{"user":"x","host":"y"}\n{"user":"y","host":"x"}', "generic"))
    assert {r.id: r.entity_type for r in g.entities.collect()} == {"x": "User", "y": "Host"}


def test_profile_and_mapping(spark):
    rows = profile(ndjson(lines_of(spark, '{"user":"a","blob":"z","ok":true}\n{"user":"b","src_device":"d"}'))).collect()
    assert [(r.field, r["count"], r.role, r.entity_type) for r in rows] == [("user", 2, "Node", "User"), ("blob", 1, "Metadata", None), ("ok", 1, "Metadata", None), ("src_device", 1, "Metadata", "Host")]
    assert proposed_mapping(spark, "sysmon").count() == 20 and proposed_mapping(spark, "sentinel").count() == 32
    assert [tuple(r) for r in proposed_mapping(spark, "csv", ["User", "action"]).collect()] == [("User", "User"), ("action", "Skip")]


def test_query_service_replies(spark):
    reply = json.dumps({"tables": [{"columns": [{"name": "Type"}, {"name": "TimeGenerated"}, {"name": "SourceIP"}, {"name": "DestinationIP"}], "rows": [["CommonSecurityLog", "2024-01-01T00:00:00Z", "1.1.1.1", "2.2.2.2"]]}]})
    records = log_analytics_records(spark.createDataFrame([(0, reply)], "rec bigint, value string"))
    assert records.first().texts["SourceIP"] == "1.1.1.1" and next_query_start(records) == "2024-01-01T00:00:00Z"
    hits = json.dumps({"hits": {"hits": [{"_source": {"@timestamp": "2024-01-01T00:00:00Z", "SourceIP": "1.1.1.1"}, "sort": [1, "a"]}]}})
    row = elastic_records(spark.createDataFrame([(0, hits)], "rec bigint, value string")).first()
    assert row.texts["TimeGenerated"] == "2024-01-01T00:00:00Z" and elastic_cursor(hits) == [1, "a"]


def test_paging_source(spark):
    def fetch(cursor):
        at = cursor or 0
        return f'{{"page":{at}}}', at + 1 if at < 2 else None

    assert [r.value for r in read_pages(spark, "pages_for_test", fetch).orderBy("rec").collect()] == ['{"page":0}', '{"page":1}', '{"page":2}']


def test_rendered_event_logs(spark):
    e = {"Event": {"System": {"EventID": {"#text": 1}, "Computer": "c", "TimeCreated": {"#attributes": {"SystemTime": "2024-01-01T00:00:00.5Z"}}}, "EventData": {"User": "u", "Image": "i"}}}
    row = rendered_event_records(ndjson(lines_of(spark, json.dumps(e)))).first()
    assert row.texts["EventID"] == "1" and row.texts["Computer"] == "c" and row.texts["Image"] == "i"
    assert short(parse_text(spark, json.dumps(e), "evtx")) == [("User", "u", "Execute", "Process", "i")]


def test_provenance(spark):
    p = "com.bbn.tc.schema.avro.cdm18."
    lines = [{"datum": {f"{p}Subject": {"uuid": "S", "properties": {"map": {"name": "sh"}}}}}, {"datum": {f"{p}Event": {"type": "EVENT_READ", "subject": {f"{p}UUID": "S"}, "predicateObject": "F", "predicateObject2": "G", "timestampNanos": 5_000_000_000}}}]
    nodes, edges = cdm(spark.createDataFrame([(json.dumps(x),) for x in lines], "value string"))
    assert [tuple(r) for r in nodes.collect()] == [("S", "Process", "sh")]
    assert sorted(tuple(r)[:4] for r in edges.collect()) == [("S", "F", "Read", 5), ("S", "G", "Read", 5)]
    w = {r.label: (r.n, r.weight) for r in class_weights(spark.createDataFrame([("Benign",)] * 3 + [("C2Beacon",)], "label string")).collect()}
    rare = (1, 5 / (1 / 3 + 4))  # absent classes weigh as much as a class of one row
    assert w.keys() == set(CLASSES) and w["Benign"] == (3, pytest.approx(rare[1] / 3)) and w["C2Beacon"] == (1, pytest.approx(rare[1]))
    assert w["Exfiltration"] == (0, pytest.approx(rare[1])) and sum(x for _, x in w.values()) == pytest.approx(5)


def test_threat_labels(spark):
    edges = [("u", "h", "Auth"), ("u", "p", "Execute"), ("p", "q", "Execute"), ("q", "i", "Read"), ("f", "p", "Read"), ("b", "i", "Connect"), ("v", "h", "Auth")]
    g = as_graph(spark, [("u", "User"), ("v", "User"), ("h", "Host"), ("p", "Process"), ("q", "Process"), ("b", "Process"), ("f", "File"), ("i", "IP")], [(*e, 1) for e in edges])
    bad = spark.createDataFrame([(x,) for x in ("u", "p", "q", "b", "f", "u", "nobody")], "id string")
    assert {r.id: r.label for r in threat_labels(g, bad).collect()} == {
        "u": "PrivilegeEscalation", "p": "LateralMovement", "q": "C2Beacon", "b": "C2Beacon", "f": "Exfiltration", "v": "Benign", "h": "Benign", "i": "Benign",
    }


def test_tensors(spark):
    g = as_graph(spark, [("i", "IP"), ("h", "Host"), ("u", "User"), ("p", "Process")], [("i", "h", "Connect", 100), ("h", "u", "Auth", 200), ("u", "p", "Execute", 300)])
    one = g.entities.where("id = 'h'").select("id")
    assert [r.id for r in around(g, one, 2).orderBy("place").collect()] == ["h", "u", "i", "p"]
    x = tensors(g, one, hops=2).first().features
    assert len(x) == INPUT and x[1] == 1.0 and x[15] == 1.0
    adjacent = [(i, j) for i in range(4) for j in range(4) if x[512 + 32 * i + j]]
    assert adjacent == [(0, 1), (1, 3), (2, 0)]


@pytest.mark.parametrize("least", [100_000, 5])
def test_stream_equals_batch(spark, tmp_path, monkeypatch, least):
    """With all batches apart, and with whole graphs written on the way and old ones deleted."""
    monkeypatch.setattr(streaming, "LEAST", least)
    rows = [{"user": f"u{i % 3}", "process": f"p{i % 2}", "time": 100 + i} for i in range(12)]
    (tmp_path / "in").mkdir()
    for k in range(6):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, rows[2 * k : 2 * k + 2])))
    sink, seen = GraphSink(spark, f"file://{tmp_path}/graph"), []
    stream_logs(spark, f"file://{tmp_path}/in", sink, f"file://{tmp_path}/check", on_progress=lambda *x: seen.append(x)).awaitTermination()
    batch, _ = graphs.ingest(graphs.Graph.empty(spark), parse_text(spark, "\n".join(map(json.dumps, rows)), "generic"))
    g = sink.graph()
    assert {r.id for r in g.entities.collect()} == {r.id for r in batch.entities.collect()}
    assert g.relations.count() == batch.relations.count() == 12 and len(seen) == 6
    assert sum(x[1] for x in seen) == 5 and sorted(r.seq for r in g.relations.collect()) == sorted({r.seq for r in g.relations.collect()}) and len(list((tmp_path / "graph").glob("w=*"))) == (0 if least > 12 else 2)
    assert {r.id: r.freq for r in sink.observations().entities.collect()} == {"u0": 4, "u1": 4, "u2": 4, "p0": 6, "p1": 6}


def test_workspace(spark, tmp_path):
    g, _ = graphs.ingest(graphs.Graph.empty(spark), parse_text(spark, '{"user":"x","host":"y"}', "generic"), "d")
    session, work = Session("one"), Workspace(spark, f"file://{tmp_path}/w")
    session.pin("x")
    session.note("look", "x", "k")
    work.save(session, g)
    assert work.sessions() == {session.id: "one"}
    again, back = work.open(session.id)
    assert again == session and back.entities.count() == 2
    left = drop_dataset(again, back, "d")
    assert left.entities.count() == 0 and not again.pinned and not again.notes
