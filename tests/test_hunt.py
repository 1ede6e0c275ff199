import random

import pytest

from pathloom.operators import anomaly, explore, scoring
from pathloom.operators import graph as graphs
from pathloom.operators import paths as ranking
from pathloom.operators.generators import as_graph, barabasi_albert, erdos_renyi
from pathloom.plans import hunt
from pathloom.plans.pattern import lateral_movement, parse, spawn_chain
from pathloom.schema import DuplicateEntity, EntityNotFound


def brute(nodes, edges, h, window=None):
    """Depth-first search with the same rules."""
    kinds, out = dict(nodes), []

    def go(path, times, i):
        if i == len(h.steps):
            out.append((*path, *times))
            return
        s = h.steps[i]
        for a, b, r, t in edges:
            fits = a == path[-1] and s.relation in ("*", r) and s.dest in ("*", kinds.get(b)) and (not times or t >= times[-1])
            if fits and (window is None or window[0] <= t <= window[1]) and path.count(b) < max(1, h.k):
                go([*path, b], [*times, t], i + 1)

    for n, kind in nodes:
        if h.steps[0].origin in ("*", kind):
            go([n], [], 0)
    return sorted(out)


def found(spark, nodes, edges, text, window=None):
    g = as_graph(spark, nodes, edges)
    h = parse(text) if isinstance(text, str) else text
    return sorted(tuple(r) for r in hunt.paths(g.entities, g.relations, h, window).collect())


CHAIN = ([("ip", "IP"), ("host", "Host"), ("user", "User"), ("proc", "Process"), ("file", "File")], [("ip", "host", "Connect", 100), ("host", "user", "Auth", 200), ("user", "proc", "Execute", 300), ("proc", "file", "Write", 400)])


def test_chain_and_windows(spark):
    four = "IP -[Connect]-> Host -[Auth]-> User -[Execute]-> Process -[Write]-> File"
    assert len(found(spark, *CHAIN, four)) == 1
    assert len(found(spark, *CHAIN, "IP -[Connect]-> Host -[Auth]-> User", (50, 250))) == 1
    assert not found(spark, *CHAIN, "IP -[Connect]-> Host -[Auth]-> User", (150, 250))
    assert not found(spark, *CHAIN, four, (50, 350))


def test_causality_and_ties(spark):
    nodes = CHAIN[0][:3]
    assert not found(spark, nodes, [("ip", "host", "Connect", 500), ("host", "user", "Auth", 200)], "IP -[Connect]-> Host -[Auth]-> User")
    assert len(found(spark, nodes, [("ip", "host", "Connect", 100), ("host", "user", "Auth", 100)], "IP -[Connect]-> Host -[Auth]-> User")) == 1


def test_parallel_relations_are_paths_of_their_own(spark):
    nodes = CHAIN[0][:2]
    assert len(found(spark, nodes, [("ip", "host", "Connect", 1), ("ip", "host", "Connect", 1)], "IP -[Connect]-> Host")) == 2


def test_cycles_need_k(spark):
    nodes, edges = [("p", "Process"), ("f", "File")], [("p", "f", "Write", 100), ("f", "p", "Execute", 200), ("p", "f", "Write", 300), ("f", "p", "Execute", 400)]
    two = "Process -[Write]-> File -[Execute]-> Process"
    assert not found(spark, nodes, edges[:2], two)
    assert len(found(spark, nodes, edges[:2], two + " {k=2}")) == 1
    assert len(found(spark, nodes, edges, "Process -[Write]-> File -[Execute]-> Process -[Write]-> File -[Execute]-> Process {k=3}")) == 1


def test_dangling_ends_do_not_match(spark):
    assert not found(spark, [("ip", "IP")], [("ip", "gone", "Connect", 1)], "IP -[Connect]-> Host")
    assert not found(spark, [("h", "Host")], [("gone", "h", "Connect", 1)], "* -[Connect]-> Host")


@pytest.mark.parametrize("text", ["* -[*]-> *", "User -[*]-> * -[*]-> * {k=2}", "Process -[Spawn]-> *", "* -[*]-> Host -[*]-> * -[*]-> *"])
def test_random_graphs_against_brute_force(spark, text):
    for seed in (1, 2):
        nodes, edges = erdos_renyi(12, 0.12, 0, 50, seed)
        for window in (None, (10, 40)):
            assert found(spark, nodes, edges, text, window) == brute(nodes, edges, parse(text), window)


def test_builders_against_brute_force(spark):
    nodes, edges = barabasi_albert(40, 3, 0, 1000, 7)
    for h in (lateral_movement(3), spawn_chain(2)):
        assert found(spark, nodes, edges, h) == brute(nodes, edges, h)


def test_pruned_equals_untyped_and_instrumented(spark):
    nodes, edges = erdos_renyi(25, 0.15, 0, 100, 3)
    g, h = as_graph(spark, nodes, edges), parse("* -[Read]-> * -[*]-> Process")
    rows = sorted(tuple(r) for r in hunt.paths(g.entities, g.relations, h).collect())
    assert rows == sorted(tuple(r) for r in hunt.untyped_walks(g.relations, g.entities, h).collect())
    levels = hunt.instrumented(g.entities, g.relations, h).orderBy("level").collect()
    assert levels[-1].passed == len(rows)
    assert all(r.examined == sum(r[c] for c in hunt.COUNTERS) for r in levels)


def test_cap_tells_truncation(spark):
    nodes = [(f"u{i}", "User") for i in range(100)] + [(f"h{i}", "Host") for i in range(100)]
    g = as_graph(spark, nodes, [(f"u{i}", f"h{i}", "Auth", 1000 + i) for i in range(100)])
    h = parse("User -[Auth]-> Host")
    rows, truncated = hunt.hunt(g.entities, g.relations, h)
    assert rows.count() == 100 and not truncated
    rows, truncated = hunt.hunt(g.entities, g.relations, h, cap=10)
    assert rows.count() == 10 and truncated


def triangle(spark):
    return as_graph(spark, [("A", "IP"), ("B", "Host"), ("C", "Process")], [("A", "B", "Connect", 1000), ("B", "C", "Execute", 2000)])


def test_anomaly_of_a_triangle(spark):
    g = triangle(spark)
    p = hunt.paths(g.entities, g.relations, parse("IP -[Connect]-> Host -[Execute]-> Process"))
    r = anomaly.path_scores(p, anomaly.finalize(g)).first()
    assert (round(r.er, 6), r.pair_rarity, round(r.nc, 6), round(r.tn, 6)) == (round(2 / 3, 6), 0.0, round(2 / 3, 6), round(1 / 3, 6))


def test_rare_pair(spark):
    g = as_graph(spark, [("A", "IP"), ("B", "Host"), ("C", "Process")], [("A", "B", "Connect", i) for i in range(5)] + [("B", "C", "Execute", 9)])
    pairs = {(r.source_id, r.dest_id): r.rarity for r in anomaly.finalize(g).pairs.collect()}
    assert pairs[("B", "C")] == 1.0 and pairs[("A", "B")] == 0.0


def test_ranked_is_best_first(spark):
    nodes, edges = erdos_renyi(20, 0.2, 1, 100, 5)
    g = as_graph(spark, nodes, edges)
    s = anomaly.finalize(g)
    p = hunt.paths(g.entities, g.relations, parse("* -[*]-> * -[*]-> *"))
    top = [r.anomaly for r in hunt.ranked(p, s.nodes, s.pairs, 15).collect()]
    full = sorted((r.anomaly for r in hunt.ranked(p, s.nodes, s.pairs, 10**6).collect()), reverse=True)
    assert top == full[:15]


def test_paging(spark):
    g = triangle(spark)
    p = hunt.paths(g.entities, g.relations, parse("* -[*]-> *"))
    rows, n = ranking.page(ranking.scored(p, g, anomaly.finalize(g)), 0, 1)
    assert n == 2 and rows.count() == 1
    assert ranking.shown(p, 1) == (None, 2)


def test_compaction(spark):
    nodes = [("A", "IP"), ("B", "Host")]
    old = as_graph(spark, nodes, [("A", "B", "Connect", t) for t in (100, 200, 300)])
    g, stats = graphs.compact(old, 1000)
    assert tuple(stats.first()) == (3, 1, 2, 1)
    row = g.relations.first()
    assert row.timestamp == 100 and row.metadata == {"compacted_count": "3", "compacted_latest": "300"}
    mixed = as_graph(spark, nodes, [("A", "B", "Connect", t) for t in (100, 200, 5000)])
    assert tuple(graphs.compact(mixed, 1000)[1].first()) == (3, 3, 0, 0)


def test_strict_inserts(spark):
    g = triangle(spark)
    with pytest.raises(DuplicateEntity):
        graphs.add_entities(g, g.entities.limit(1))
    bad = as_graph(spark, [], [("A", "nobody", "Connect", 1)]).relations
    with pytest.raises(EntityNotFound):
        graphs.add_relations(g, bad)


def test_snapshot_round_trip(spark, tmp_path):
    g = triangle(spark)
    graphs.save(g, f"file://{tmp_path}/g")
    back = graphs.load(spark, f"file://{tmp_path}/g")
    assert sorted(r.id for r in back.entities.collect()) == ["A", "B", "C"]
    assert {(r.source_id, r.dest_id, r.rel_type, r.timestamp) for r in back.relations.collect()} == {("A", "B", "Connect", 1000), ("B", "C", "Execute", 2000)}


def test_pagerank(spark):
    star = as_graph(spark, [("c", "Host"), *((f"l{i}", "IP") for i in range(5))], [(f"l{i}", "c", "Connect", 1000) for i in range(5)])
    ranks = {r.id: r.pagerank_score for r in scoring.temporal_pagerank(star, 0.0).collect()}
    assert ranks["c"] == 100.0
    decay = as_graph(spark, [("a", "IP"), ("b", "IP"), ("c", "IP")], [("a", "b", "Connect", 100), ("a", "c", "Connect", 10000)])
    ranks = {r.id: r.pagerank_score for r in scoring.temporal_pagerank(decay, 0.01).collect()}
    assert ranks["c"] > ranks["b"]


def test_betweenness_by_level_equals_by_task(spark, monkeypatch):
    """Parallel relations, self-loops, parts that do not meet, and every number of sources."""
    rng = random.Random(4)
    names = [f"n{i:02d}" for i in range(30)]
    g = as_graph(spark, [(x, "Host") for x in names], [(rng.choice(names[:25]), rng.choice(names[:25]), "Connect", 1) for _ in range(45)])
    for samples in (None, 1, 7):
        monkeypatch.setattr(scoring, "ADJACENCY_LIMIT", 1 << 30)
        want = {r.id: r.betweenness for r in scoring.betweenness(g, samples).collect()}
        monkeypatch.setattr(scoring, "ADJACENCY_LIMIT", 0)
        assert {r.id: r.betweenness for r in scoring.betweenness(g, samples).collect()} == pytest.approx(want)


def test_betweenness(spark):
    chain = as_graph(spark, [(x, "Host") for x in "abc"], [("a", "b", "Connect", 1), ("b", "c", "Connect", 2)])
    assert {r.id: r.betweenness for r in scoring.betweenness(chain).collect()} == {"a": 0.0, "b": 100.0, "c": 0.0}


def test_neighbourhood_stops_at_max_nodes(spark):
    g = as_graph(spark, [("c", "Host"), *((f"l{i}", "IP") for i in range(30))], [(f"l{i}", "c", "Connect", i) for i in range(30)])
    near = explore.neighbourhood(g, "c", 2, 10)
    assert near.entities.count() == 10 and near.relations.count() == 9
    with pytest.raises(EntityNotFound):
        explore.neighbourhood(g, "nobody")


def test_adaptive_scores(spark):
    nodes, edges = erdos_renyi(15, 0.2, 1, 100, 9)
    g = scoring.score_adaptive(as_graph(spark, nodes, edges))
    scores = [r.score for r in g.entities.collect()]
    assert max(scores) == 100.0 and len(scores) == 15
