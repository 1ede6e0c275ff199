"""Hunts: a pattern of L steps is a chain of L equi-joins on the last node.

Each step scans relations once, with its relation type, time window and
destination type in the scan; time order along the path and the bound on repeated
nodes are residual predicates of the join, so nothing is filtered after the fact.
Columns stay scalar (n0..nL, t1..tL) and Catalyst picks the join, but for relations
that a window leaves few of: those are broadcast and paths dealt out evenly, since a
few hubs as keys would leave the work to as many tasks.

Where only the nodes of a path matter (scores), node_paths() joins pairs instead of
relations, and times come in when that is done.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.plans.pattern import Hypothesis
from pathloom.schema import ANY

#: Paths that a hunt returns unless told otherwise.
CAP = 10_000
#: Relations of a window that are broadcast to a join; beyond, both sides are shuffled.
FEW = 500_000


def _edges(relations: DataFrame, entities: DataFrame | None, relation: str, dest: str, window: tuple[int, int] | None, step: int, seq: bool) -> DataFrame:
    """Relations that a step may use, as src, n{step}, t{step}."""
    rows = relations
    if relation != ANY:
        rows = rows.where(F.col("rel_type") == relation)
    if window:
        rows = rows.where(F.col("timestamp").between(*window))
    more = [F.col("seq").alias(f"e{step}")] if seq else []
    rows = rows.select(F.col("source_id").alias(f"s{step}"), F.col("dest_id").alias(f"n{step}"), F.col("timestamp").alias(f"t{step}"), *more)
    if dest != ANY:
        typed = entities.where(F.col("entity_type") == dest).select(F.col("id").alias(f"n{step}"))
        rows = rows.join(typed, f"n{step}", "left_semi")
    return rows


def visits_below(node: Column, earlier: list[Column], k: int) -> Column:
    """node occurs fewer than k times among earlier ones."""
    if k == 1:
        return reduce(lambda a, b: a & b, (node != e for e in earlier))
    return reduce(lambda a, b: a + b, ((node == e).cast("int") for e in earlier)) < k


def _few(relations: DataFrame, window: tuple[int, int] | None) -> bool:
    """Whether the relations of a window may be broadcast: one count of at most FEW + 1."""
    return window is not None and relations.where(F.col("timestamp").between(*window)).limit(FEW + 1).count() <= FEW


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt out evenly, to some tasks for each core."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def paths(entities: DataFrame, relations: DataFrame, hypothesis: Hypothesis, window: tuple[int, int] | None = None, with_edges: bool = False) -> DataFrame:
    """All paths: n0..nL and t1..tL, one row for each combination of relations.

    Relations whose destination is no entity never match a typed step, and one whose
    source is no entity never starts a path. with_edges adds e1..eL, the relations' seq.
    """
    hypothesis.validate()
    k = max(1, hypothesis.k)
    starts = entities if hypothesis.steps[0].origin == ANY else entities.where(F.col("entity_type") == hypothesis.steps[0].origin)
    few = len(hypothesis.steps) > 1 and _few(relations, window)
    out = None
    for i, step in enumerate(hypothesis.steps, 1):
        edges = _edges(relations, entities, step.relation, step.dest, window, i, with_edges)
        node = F.col(f"n{i}")
        if out is None:
            first = edges.join(starts.select(F.col("id").alias("s1")), "s1", "left_semi")
            out = first.withColumnRenamed("s1", "n0").where(visits_below(node, [F.col("n0")], k))
            out = _dealt(out) if few else out
        else:
            fits = (F.col(f"n{i - 1}") == F.col(f"s{i}")) & (F.col(f"t{i}") >= F.col(f"t{i - 1}")) & visits_below(node, [F.col(f"n{j}") for j in range(i)], k)
            out = out.join(F.broadcast(edges) if few else edges, fits).drop(f"s{i}")
    n = len(hypothesis.steps)
    return out.select(*(f"n{i}" for i in range(n + 1)), *(f"t{i}" for i in range(1, n + 1)), *(f"e{i}" for i in range(1, n + 1) if with_edges))


def as_arrays(found: DataFrame) -> DataFrame:
    """n0..nL as one array column `path`."""
    n = sum(c.startswith("n") and c[1:].isdigit() for c in found.columns)
    return found.select(F.array(*(f"n{i}" for i in range(n))).alias("path"))


def capped(found: DataFrame, cap: int = CAP, ordered: bool = False) -> tuple[DataFrame, bool]:
    """(at most cap paths, whether the cap was reached). ordered takes the first ones by their columns, which repeats."""
    rows = found.orderBy(*found.columns).limit(cap) if ordered else found.limit(cap)
    return rows, found.limit(cap).count() == cap


def hunt(entities: DataFrame, relations: DataFrame, hypothesis: Hypothesis, window: tuple[int, int] | None = None, cap: int | None = CAP) -> tuple[DataFrame, bool]:
    """(paths, truncated) of a hypothesis; without a cap all paths."""
    found = paths(entities, relations, hypothesis, window)
    return (found, False) if cap is None else capped(found, cap)


def ranked(found: DataFrame, nodes: DataFrame, pairs: DataFrame, top: int) -> DataFrame:
    """The top paths by mean anomaly, best first, with a column `anomaly`.

    nodes has (id, estimate), pairs (source_id, dest_id, estimate). The mean is
    (node(n0) + sum of (node(ni) + pair(ni-1, ni)) / 2) / (L + 1); what has no
    estimate counts 0.5. Ties go to the smaller path. Top-k keeps k rows a task.
    """
    n = sum(c.startswith("n") and c[1:].isdigit() for c in found.columns)
    rows, total = found, F.lit(0.0)
    for i in range(n):
        rows = rows.join(nodes.select(F.col("id").alias(f"n{i}"), F.col("estimate").alias(f"a{i}")), f"n{i}", "left")
        total = total + F.coalesce(f"a{i}", F.lit(0.5)) * (1.0 if i == 0 else 0.5)
        if i:
            rows = rows.join(pairs.select(F.col("source_id").alias(f"n{i - 1}"), F.col("dest_id").alias(f"n{i}"), F.col("estimate").alias(f"b{i}")), [f"n{i - 1}", f"n{i}"], "left")
            total = total + F.coalesce(f"b{i}", F.lit(0.5)) * 0.5
    names = [f"n{i}" for i in range(n)]
    times = [c for c in found.columns if c not in names]
    return rows.select(*names, *times, (total / n).alias("anomaly")).orderBy(F.desc("anomaly"), *names, *times).limit(top)


def node_paths(entities: DataFrame, relations: DataFrame, hypothesis: Hypothesis, window: tuple[int, int] | None = None, nodes: DataFrame | None = None, pairs: DataFrame | None = None, times: bool = False) -> DataFrame:
    """The different n0..nL of paths(), each once, with columns of nodes (id, x: as x0..xL) and of pairs (source_id, dest_id, x: as x1..xL), null where they have no row.

    Parallel relations are one pair with its times, so a row stands for any number of
    paths. The earliest arrival tells whether there is one. times adds ts1..tsL, the
    pairs' times in order, for with_times().
    """
    hypothesis.validate()
    k, n = max(1, hypothesis.k), len(hypothesis.steps)
    starts = entities if hypothesis.steps[0].origin == ANY else entities.where(F.col("entity_type") == hypothesis.steps[0].origin)
    few = _few(relations, window)
    out = None
    for i, step in enumerate(hypothesis.steps, 1):
        edges = _edges(relations, entities, step.relation, step.dest, window, i, False)
        ways = [F.array_sort(F.collect_list(f"t{i}")).alias(f"ts{i}")] if times or 1 < i < n else []
        edges = edges.groupBy(f"s{i}", f"n{i}").agg(F.min(f"t{i}").alias(f"lo{i}"), F.max(f"t{i}").alias(f"hi{i}"), *ways)
        if pairs is not None:
            own = pairs.select(F.col("source_id").alias(f"s{i}"), F.col("dest_id").alias(f"n{i}"), *(F.col(c).alias(f"{c}{i}") for c in pairs.columns if c not in ("source_id", "dest_id")))
            edges = edges.join(own, [f"s{i}", f"n{i}"], "left")
        if i == 1:
            out = edges.join(starts.select(F.col("id").alias("s1")), "s1", "left_semi").withColumnRenamed("s1", "n0").where(visits_below(F.col("n1"), [F.col("n0")], k))
            out = _facts(out, nodes, 0).withColumn("arrival", F.col("lo1"))
            out = _dealt(_facts(out, nodes, 1)) if few else _facts(out, nodes, 1)
            continue
        edges = _facts(edges, nodes, i)
        fits = (F.col(f"n{i - 1}") == F.col(f"s{i}")) & (F.col(f"hi{i}") >= F.col("arrival")) & visits_below(F.col(f"n{i}"), [F.col(f"n{j}") for j in range(i)], k)
        out = out.join(F.broadcast(edges) if few else edges, fits).drop(f"s{i}")
        if i < n:
            out = out.withColumn("arrival", F.array_min(F.filter(f"ts{i}", lambda t: t >= F.col("arrival"))))
    drop = ["arrival", *(f"{x}{i}" for i in range(1, n + 1) for x in ("lo", "hi", *(() if times else ("ts",))))]
    names = [f"n{i}" for i in range(n + 1)]
    return out.select(*names, *(c for c in out.columns if c not in drop and c not in names))


def _facts(rows: DataFrame, nodes: DataFrame | None, i: int) -> DataFrame:
    """rows with the columns of nodes for n{i}."""
    if nodes is None:
        return rows
    return rows.join(nodes.select(F.col("id").alias(f"n{i}"), *(F.col(c).alias(f"{c}{i}") for c in nodes.columns if c != "id")), f"n{i}", "left")


def with_times(rows: DataFrame) -> DataFrame:
    """rows of node_paths(times=True), one for each combination of relations: t1..tL instead of ts1..tsL."""
    n = sum(c.startswith("ts") and c[2:].isdigit() for c in rows.columns)
    for i in range(1, n + 1):
        before = F.col(f"t{i - 1}") if i > 1 else None
        fit = F.col("ts1") if before is None else F.filter(f"ts{i}", _not_before(before))
        rows = rows.select(*(c for c in rows.columns if c != f"ts{i}"), F.explode(fit).alias(f"t{i}"))
    return rows


def _not_before(time: Column) -> Callable[[Column], Column]:
    return lambda t: t >= time


def ranked_hunt(entities: DataFrame, relations: DataFrame, hypothesis: Hypothesis, nodes: DataFrame, pairs: DataFrame, top: int, window: tuple[int, int] | None = None, digits: int | None = None) -> DataFrame:
    """ranked() of paths() without all paths: every path of the same nodes scores the same, so the best `top` node paths hold the best `top` paths.

    digits rounds the scores before they are put in order.
    """
    n = len(hypothesis.steps) + 1
    rows = node_paths(entities, relations, hypothesis, window, nodes.select("id", F.col("estimate").alias("a")), pairs.select("source_id", "dest_id", F.col("estimate").alias("b")))
    total = F.lit(0.0)
    for i in range(n):
        total = total + F.coalesce(f"a{i}", F.lit(0.5)) * (1.0 if i == 0 else 0.5)
        if i:
            total = total + F.coalesce(f"b{i}", F.lit(0.5)) * 0.5
    score = total / n if digits is None else F.round(total / n, digits)
    names, times = [f"n{i}" for i in range(n)], [f"t{i}" for i in range(1, n)]
    out = F.broadcast(rows.select(*names, score.alias("anomaly")).orderBy(F.desc("anomaly"), *names).limit(top))
    for i, step in enumerate(hypothesis.steps, 1):
        edges = _edges(relations, entities, step.relation, step.dest, window, i, False).withColumnRenamed(f"n{i}", f"d{i}")
        fits = (F.col(f"n{i - 1}") == F.col(f"s{i}")) & (F.col(f"n{i}") == F.col(f"d{i}"))
        out = edges.join(out, fits if i == 1 else fits & (F.col(f"t{i}") >= F.col(f"t{i - 1}"))).drop(f"s{i}", f"d{i}")
    return out.select(*names, *times, "anomaly").orderBy(F.desc("anomaly"), *names, *times).limit(top)


def untyped_walks(relations: DataFrame, entities: DataFrame, hypothesis: Hypothesis) -> DataFrame:
    """The baseline: all simple walks of the length first, then the pattern; no pruning, no window, k = 1."""
    hypothesis.validate()
    rows = None
    for i in range(1, len(hypothesis.steps) + 1):
        edges = relations.select(F.col("source_id").alias(f"s{i}"), F.col("dest_id").alias(f"n{i}"), F.col("timestamp").alias(f"t{i}"), F.col("rel_type").alias(f"r{i}"))
        if rows is None:
            rows = edges.withColumnRenamed("s1", "n0").where("n0 <> n1")
        else:
            rows = rows.join(edges, (F.col(f"s{i}") == F.col(f"n{i - 1}")) & visits_below(F.col(f"n{i}"), [F.col(f"n{j}") for j in range(i)], 1)).drop(f"s{i}")
    for i in range(len(hypothesis.steps) + 1):
        rows = rows.join(entities.select(F.col("id").alias(f"n{i}"), F.col("entity_type").alias(f"y{i}")), f"n{i}")
    for i, step in enumerate(hypothesis.steps, 1):
        if i > 1:
            rows = rows.where(F.col(f"t{i}") >= F.col(f"t{i - 1}"))
        for column, wanted in ((f"r{i}", step.relation), (f"y{i}", step.dest), ("y0", hypothesis.steps[0].origin)):
            if wanted != ANY:
                rows = rows.where(F.col(column) == wanted)
    n = len(hypothesis.steps)
    return rows.select(*(f"n{i}" for i in range(n + 1)), *(f"t{i}" for i in range(1, n + 1)))


COUNTERS = ("rejected_relation", "rejected_entity", "rejected_time", "rejected_window", "rejected_k", "passed")


def instrumented(entities: DataFrame, relations: DataFrame, hypothesis: Hypothesis, window: tuple[int, int] | None = None) -> DataFrame:
    """One row for each level: relations examined from its frontier, and the first reason that rejected each.

    The order of reasons is relation type, destination type, time order, window, repeats.
    """
    hypothesis.validate()
    k = max(1, hypothesis.k)
    types = entities.select(F.col("id").alias("to"), F.col("entity_type").alias("to_type"))
    starts = entities if hypothesis.steps[0].origin == ANY else entities.where(F.col("entity_type") == hypothesis.steps[0].origin)
    frontier = starts.select(F.col("id").alias("n0"))
    levels = []
    for i, step in enumerate(hypothesis.steps, 1):
        edges = relations.select(F.col("source_id").alias("from"), F.col("dest_id").alias("to"), F.col("timestamp").alias(f"t{i}"), "rel_type")
        seen = frontier.join(edges, F.col(f"n{i - 1}") == F.col("from")).join(types, "to", "left")
        reason = F.lit("passed")
        reason = F.when(~visits_below(F.col("to"), [F.col(f"n{j}") for j in range(i)], k), "rejected_k").otherwise(reason)
        if window:
            reason = F.when(~F.col(f"t{i}").between(*window), "rejected_window").otherwise(reason)
        if i > 1:
            reason = F.when(F.col(f"t{i}") < F.col(f"t{i - 1}"), "rejected_time").otherwise(reason)
        if step.dest != ANY:
            reason = F.when(~F.col("to_type").eqNullSafe(step.dest), "rejected_entity").otherwise(reason)
        if step.relation != ANY:
            reason = F.when(F.col("rel_type") != step.relation, "rejected_relation").otherwise(reason)
        seen = seen.withColumn("reason", reason)
        levels.append(seen.agg(F.lit(i).cast("bigint").alias("level"), F.count("*").alias("examined"), *(F.count_if(F.col("reason") == c).alias(c) for c in COUNTERS)))
        frontier = seen.where("reason = 'passed'").drop("from", "rel_type", "to_type", "reason").withColumnRenamed("to", f"n{i}")
    return reduce(DataFrame.unionAll, levels)
