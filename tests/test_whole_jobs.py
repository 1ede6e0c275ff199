"""Queries that once took a part of their tables, against brute force over all of it."""

import random
from collections import Counter, defaultdict
from math import exp

import pytest

from pathloom.plans import hunt
from pathloom.queries import registry
from pathloom.queries.graphs import event_graph, order_graph

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """5,000 events, of which one user has half; some users come late only."""
    rng = random.Random(3)
    rows = [(i, 0 if rng.random() < 0.5 else rng.randrange(1, 20) + 20 * (i >= 3000), rng.choice(["view", "click", "error"])) for i in range(5000)]
    at = f"file://{tmp_path_factory.mktemp('events')}"
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string").repartition(5).write.parquet(f"{at}/events.parquet")
    return at, rows


@pytest.mark.parametrize("name", ["first", "last", "append"])
def test_merge_takes_all_events(spark, events, name):
    at, rows = events
    seen = {}
    for _, user, kind in sorted(rows):
        seen.setdefault(f"u{user}", []).append(kind)
    pick = {"first": lambda x: x[0], "last": lambda x: x[-1], "append": ", ".join}[name]
    got = {r.id: r.seen for r in registry.QUERIES[f"merge_{name}"](spark, at).collect()}
    assert got == {k: pick(v) for k, v in seen.items()}


def test_betweenness_takes_the_whole_graph(spark):
    g = order_graph(spark, SF)
    ids = sorted(r.id for r in g.entities.select("id").collect())
    near = defaultdict(list)
    for r in g.relations.select("source_id", "dest_id").collect():
        near[r.source_id].append(r.dest_id)
        near[r.dest_id].append(r.source_id)
    total = dict.fromkeys(ids, 0.0)
    for source in sorted({ids[i * len(ids) // 500] for i in range(500)}):
        far, paths, order = {source: 0}, defaultdict(float, {source: 1.0}), [source]
        for v in order:
            for w in near[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    order.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
        given = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for w in near[v]:
                if far[w] == far[v] + 1:
                    given[v] += paths[v] / paths[w] * (1 + given[w])
            if v != source:
                total[v] += given[v]
    got = {r.id: r.betweenness for r in registry.QUERIES["betweenness"](spark, SF).collect()}
    most = max(total.values())
    assert got == pytest.approx({k: v / most * 100 for k, v in total.items()}, abs=2e-6)


def test_untyped_walks_take_all_relations(spark, monkeypatch):
    walk, seen = hunt.untyped_walks, []
    monkeypatch.setattr(hunt, "untyped_walks", lambda relations, *a: seen.append(relations) or walk(relations, *a))
    registry.QUERIES["hunt_untyped_walks"](spark, SF)
    assert {r.rel_type for r in seen[0].select("rel_type").distinct().collect()} == {"Execute", "Write", "Connect", "Spawn"}


def test_tensors_take_all_relations(spark):
    g = event_graph(spark, SF)
    kind = {r.id: r.entity_type for r in g.entities.select("id", "entity_type").collect()}
    relations = [(r.source_id, r.dest_id, r.seq) for r in g.relations.select("source_id", "dest_id", "seq").collect()]
    out, into, first = Counter(r[0] for r in relations), Counter(r[1] for r in relations), defaultdict(dict)
    for a, b, seq in relations:
        for x, y, way in ((a, b, 0), (b, a, 1)):
            first[x][y] = min(first[x].get(y, (way, seq)), (way, seq))
    pairs = {(a, b) for a, b, _ in relations}
    got = {r.id: r.total for r in registry.QUERIES["subgraph_tensors"](spark, SF).collect()}
    assert set(got) == {i for i, k in kind.items() if k == "User"}
    for center in sorted(got)[:20]:
        members, frontier = [center], [center]
        for _ in range(2):
            met = {}
            for v in frontier:
                for w, o in first[v].items():
                    if w not in members:
                        met[w] = min(met.get(w, (members.index(v), o)), (members.index(v), o))
            frontier = sorted(met, key=lambda w: (met[w], w))[: 32 - len(members)]
            members += frontier
        total = 1 + sum((kind[v] in {"User", "Host", "IP"}) + min(out[v] / 32, 1) + min(into[v] / 32, 1) + min((out[v] + into[v]) / 64, 1) for v in members)
        assert got[center] == pytest.approx(total + sum((a, b) in pairs for a in members for b in members), abs=1e-3)


def test_settled_pagerank(spark):
    g = order_graph(spark, SF)
    ids = [r.id for r in g.entities.select("id").collect()]
    relations = [(r.source_id, r.dest_id, r.timestamp) for r in g.relations.select("source_id", "dest_id", "timestamp").collect()]
    now = max(r[2] for r in relations)
    weight = defaultdict(Counter)
    for a, b, t in relations:
        weight[a][b] += exp(-1e-8 * (now - t))
    total = {a: sum(w.values()) for a, w in weight.items()}
    n = len(ids)
    rank = dict.fromkeys(ids, 1 / n)
    for _ in range(200):
        lost = sum(r for i, r in rank.items() if i not in total)
        new = dict.fromkeys(ids, 0.15 / n + 0.85 * lost / n)
        for a, w in weight.items():
            for b, x in w.items():
                new[b] += 0.85 * rank[a] * x / total[a]
        rank = new
    most = max(rank.values())
    got = {r.id: r.pagerank_score for r in registry.QUERIES["temporal_pagerank_settled"](spark, SF).collect()}
    assert got == pytest.approx({k: v / most * 100 for k, v in rank.items()}, abs=1e-2)
