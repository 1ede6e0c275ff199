"""Queries whose results or sizes once changed with the number of partitions or the size of hubs."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from pathloom import storage
from pathloom.operators import anomaly, scoring
from pathloom.operators.graph import Graph
from pathloom.operators.tensors import among, around
from pathloom.plans import hunt
from pathloom.plans.pattern import parse
from pathloom.queries import registry
from pathloom.queries.graphs import event_graph

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return c


def _expected(duck, name, columns):
    out = duck.execute(registry.SQL[name])
    names = [d[0] for d in out.description]
    return Counter(tuple(r[names.index(c)] for c in columns) for r in out.fetchall())


def test_json_arrays_of_several_partitions(spark, duck):
    """Rows of several partitions meet in one writing task: each array is a file of its own."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        df = registry.QUERIES["parse_json_arrays"](spark, SF)
        got = Counter(tuple(r) for r in df.collect())
    finally:
        spark.conf.set(key, before)
    assert got == _expected(duck, "parse_json_arrays", df.columns)


@pytest.mark.parametrize("pattern", ["User -[Auth]-> Host", "User -[Auth]-> Host -[Connect]-> IP", "User -[Auth]-> Host -[Connect]-> IP -[Connect]-> User {k=2}"])
@pytest.mark.parametrize("few", [hunt.FEW, 0])
def test_node_paths_stand_for_all_paths(spark, monkeypatch, pattern, few):
    """Ranked and scored from node paths as from all paths, with broadcast relations and without."""
    monkeypatch.setattr(hunt, "FEW", few)
    g, h = event_graph(spark, SF), parse(pattern)
    s = anomaly.finalize(g)
    window = (1704844800, 1705276800)
    found = hunt.paths(g.entities, g.relations, h, window)
    columns = found.columns
    want = Counter((*r[:-1], round(r.anomaly, 9)) for r in anomaly.path_scores(found, s).select(*columns, "anomaly").collect())
    got = Counter((*r[:-1], round(r.anomaly, 9)) for r in anomaly.scored_hunt(g, h, s, window).select(*columns, "anomaly").collect())
    assert got == want and want
    best = [tuple(r) for r in hunt.ranked(found, s.nodes, s.pairs, 30).select(*columns, "anomaly").collect()]
    assert [tuple(r) for r in hunt.ranked_hunt(g.entities, g.relations, h, s.nodes, s.pairs, 30, window).select(*columns, "anomaly").collect()] == best


def test_windowed_hunt_is_dealt_out(spark, tmp_path):
    """Five hosts as join keys do not leave the paths of a window to as many tasks."""
    rows = spark.range(3000).selectExpr("id as event_id", "timestamp'2024-01-10 00:00:00' + make_interval(0,0,0,0,0,0,id) as ts", "id % 50 as user_id", "'view' as event_type", "'{\"k\": 1}' as props")
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/events.parquet")
    found = registry.QUERIES["hunt_hub_window"](spark, f"file://{tmp_path}")
    sizes = [r.n for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3000 * 3001 // 2
    assert max(sizes) < sum(sizes) / 8


def test_tensors_meet_no_neighbours_of_hubs_for_each_center(spark, tmp_path):
    """600 users around one host: rows that a center takes do not grow with the users."""
    n = 600
    entities = spark.range(n).selectExpr("concat('u', id) as id", "'User' as entity_type").unionByName(spark.createDataFrame([("h", "Host")], "id string, entity_type string"))
    relations = spark.range(n).selectExpr("concat('u', id) as source_id", "'h' as dest_id", "id as seq").unionByName(spark.createDataFrame([("h", "h", 10_000), ("u3", "u3", 10_001), ("h", "u1", 10_002)], "source_id string, dest_id string, seq bigint"))
    g = Graph(entities, relations)
    centers = entities.where("entity_type = 'User'").select("id")
    members = around(g, centers)
    found = {}
    for r in members.collect():
        found.setdefault(r.center, {})[r.id] = r.place
    for c in ("u0", "u1", "u40", "u599"):
        rest = [f"u{i}" for i in (*range(40), *range(40, n)) if f"u{i}" != c]
        # The host's own relation out to u1 comes first, then those into it by number; itself has its place already.
        rest = [x for x in ("u1",) if x != c] + [x for x in rest if x != "u1"]
        assert found[c] == {x: i for i, x in enumerate([c, "h", *rest][:32])}
    edges = {}
    for r in among(relations, members).collect():
        edges.setdefault(r.center, []).append((r.p, r.q))
    for c in ("u0", "u3", "u599"):
        at = found[c]
        want = {(at[a], at[b]) for a, b in [*((x, "h") for x in at), ("u3", "u3"), ("h", "u1")] if a in at and b in at}
        assert sorted(edges[c]) == sorted(want)
    df = among(relations, members)
    df.collect()
    sizes = _rows_of_joins(df._jdf.queryExecution().executedPlan())
    assert sizes and max(sizes) < n * 100


def _rows_of_joins(plan):
    """Rows out of every join of a plan that has run."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return _rows_of_joins(plan.executedPlan())
    if plan.nodeName().endswith("QueryStage"):
        return _rows_of_joins(plan.plan())
    metrics = plan.metrics()
    own = [metrics.apply("numOutputRows").value()] if "Join" in plan.nodeName() and metrics.contains("numOutputRows") else []
    kids = plan.children()
    return own + [x for i in range(kids.size()) for x in _rows_of_joins(kids.apply(i))]


@pytest.mark.parametrize("component, own_runs", [(10**6, 64), (10**6, 3), (20, 64), (0, 64)])
def test_betweenness_by_components(spark, monkeypatch, component, own_runs):
    """Components in tasks, level by level, and both, as over a broadcast adjacency; relations without an entity count nowhere."""
    rng = random.Random(5)
    names = [f"v{i}" for i in range(60)]
    pairs = [(f"v{a}", f"v{b}") for a, b in ((rng.randrange(20), rng.randrange(20)) for _ in range(45))] + [(f"v{20 + rng.randrange(8)}", f"v{20 + rng.randrange(8)}") for _ in range(14)]
    pairs += [(f"v{i}", f"v{i + 1}") for i in range(30, 36)] + [("v30", "none"), ("none", "v20"), ("v40", "v41"), ("v40", "v41")]
    g = Graph(spark.createDataFrame([(x,) for x in names], "id string"), spark.createDataFrame(pairs, "source_id string, dest_id string").repartition(5))
    want = {r.id: r.betweenness for r in scoring.betweenness(g, 40).collect()}
    by_level = scoring._dependencies_by_level
    levels = []
    monkeypatch.setattr(scoring, "ADJACENCY_LIMIT", 8 * len(names))
    monkeypatch.setattr(scoring, "COMPONENT_LIMIT", component, raising=False)
    monkeypatch.setattr(scoring, "SOURCES", own_runs, raising=False)
    monkeypatch.setattr(scoring, "_dependencies_by_level", lambda *a: levels.append(1) or by_level(*a))
    got = {r.id: r.betweenness for r in scoring.betweenness(g, 40).collect()}
    assert got == pytest.approx(want) and max(want.values()) == 100
    assert len(levels) == (component < 10**6)


@pytest.mark.parametrize("task", [10**6, 20, 0])
def test_betweenness_keeps_disk_bounded(spark, monkeypatch, task):
    """Components in shared tasks and large ones in a task of each executor, none level by level; written relations take few bytes and are gone at the end."""
    rng = random.Random(6)
    names = [f"v{i:03d}" for i in range(400)]
    pairs = [(rng.choice(names[:150]), rng.choice(names[:150])) for _ in range(4000)] + [(f"v{150 + rng.randrange(100)}", f"v{150 + rng.randrange(100)}") for _ in range(120)]
    pairs += [(f"v{i}", f"v{i + 1}") for i in range(260, 300)] + [(f"v{i}", f"v{i + 1}") for i in range(310, 390, 2)]
    g = Graph(spark.createDataFrame([(x,) for x in names], "id string"), spark.createDataFrame(pairs, "source_id string, dest_id string").repartition(2))
    want = {r.id: r.betweenness for r in scoring.betweenness(g, 90).collect()}

    def level(*a):
        raise AssertionError("level by level")

    size = {}

    def delete(spark, path, run=storage.delete):
        size[path] = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).selectExpr("coalesce(sum(length), 0)").first()[0]
        run(spark, path)

    monkeypatch.setattr(scoring, "ADJACENCY_LIMIT", 8 * len(names))
    monkeypatch.setattr(scoring, "COMPONENT_LIMIT", 10**6)
    monkeypatch.setattr(scoring, "TASK", task, raising=False)
    monkeypatch.setattr(scoring, "BIN", 150, raising=False)
    monkeypatch.setattr(scoring, "_dependencies_by_level", level)
    monkeypatch.setattr(scoring, "delete", delete, raising=False)
    with storage.recorded() as written:
        got = {r.id: r.betweenness for r in scoring.betweenness(g, 90).collect()}
    assert got == pytest.approx(want) and max(want.values()) == 100
    assert set(written) == set(size)
    assert sum(v for k, v in size.items() if "edges" in k) < 5 * len(pairs)
