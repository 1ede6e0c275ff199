"""Anomaly scores: rarity of entities and pairs, concentration of neighbourhoods, novelty in time, and a model's threat.

All observations are counts and minima, so they merge: tables of new relations can
be added to older ones and finished again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.graph import Graph
from pathloom.plans import hunt
from pathloom.plans.pattern import Hypothesis

#: Scores of a node that a path takes the mean of.
_PARTS = ("er", "nc", "tn", "threat")


@dataclass(frozen=True)
class Weights:
    entity: float = 0.25
    pair: float = 0.30
    concentration: float = 0.25
    novelty: float = 0.20
    threat: float = 0.0


@dataclass(frozen=True)
class Observations:
    """entities (id, freq, first_seen) and pairs (source_id, dest_id, freq)."""

    entities: DataFrame
    pairs: DataFrame

    def merge(self, other: Observations) -> Observations:
        positive = F.when(F.col("first_seen") > 0, F.col("first_seen"))
        entities = self.entities.unionByName(other.entities).groupBy("id").agg(F.sum("freq").alias("freq"), F.coalesce(F.min(positive), F.lit(0).cast("bigint")).alias("first_seen"))
        pairs = self.pairs.unionByName(other.pairs).groupBy("source_id", "dest_id").agg(F.sum("freq").alias("freq"))
        return Observations(entities, pairs)


def observe(relations: DataFrame) -> Observations:
    """An entity counts once for each end of a relation; first_seen is its earliest positive time, 0 if none."""
    ends = relations.select(F.explode(F.array("source_id", "dest_id")).alias("id"), F.when(F.col("timestamp") > 0, F.col("timestamp")).alias("t"))
    entities = ends.groupBy("id").agg(F.count("*").alias("freq"), F.coalesce(F.min("t"), F.lit(0).cast("bigint")).alias("first_seen"))
    return Observations(entities, relations.groupBy("source_id", "dest_id").agg(F.count("*").alias("freq")))


def concentration(graph: Graph) -> DataFrame:
    """(id, nc): 1 - entropy of neighbour types over its largest possible value; 1 with one type or none."""
    both = F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.col("dest_id").alias("other")), F.struct(F.col("dest_id").alias("id"), F.col("source_id").alias("other"))))
    around = graph.relations.select(both.alias("e")).select("e.*")
    typed = around.join(graph.entities.select(F.col("id").alias("other"), "entity_type"), "other").groupBy("id", "entity_type").agg(F.count("*").alias("n"))
    # The entropy is log2(total) - sum(n * log2 n) / total, so one aggregation is enough.
    sums = typed.groupBy("id").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("s"), F.count("*").alias("kinds"))
    entropy = F.log2("total") - F.col("s") / F.col("total")
    nc = F.when(F.col("kinds") <= 1, 1.0).otherwise(clamp(1 - entropy / F.log2("kinds")))
    return graph.entities.select("id").join(sums, "id", "left").select("id", F.coalesce(nc, F.lit(1.0)).alias("nc"))


def clamp(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def statistics(seen: Observations) -> DataFrame:
    """One row: ln of the largest frequencies, and the range of positive first times."""
    t = F.when(F.col("first_seen") > 0, F.col("first_seen"))
    left = seen.entities.agg(F.coalesce(F.ln(F.max("freq")), F.lit(0.0)).alias("ln_entity"), F.min(t).alias("t_min"), F.max(t).alias("t_max"))
    return left.crossJoin(seen.pairs.agg(F.coalesce(F.ln(F.max("freq")), F.lit(0.0)).alias("ln_pair")))


@dataclass(frozen=True)
class Scorer:
    """Finished scores: nodes (id, er, nc, tn, threat, estimate) and pairs (source_id, dest_id, rarity, estimate)."""

    nodes: DataFrame
    pairs: DataFrame
    weights: Weights


def finalize(graph: Graph, seen: Observations | None = None, weights: Weights = Weights(), threats: DataFrame | None = None) -> Scorer:
    """Scores of every entity and observed pair.

    er and rarity are 1 - ln(freq) / ln(largest), 0 where that is not above 0; tn is
    the place of first_seen in its range, 0 where there is none. The node estimate
    renormalises the weights without the pair's; the pair estimate is 0.5 where no
    pair repeats. threats (id, threat) come from a model, 0 for others.
    """
    seen = observe(graph.relations) if seen is None else seen
    stats = F.broadcast(statistics(seen))  # one row
    rows = graph.entities.select("id").join(seen.entities, "id", "left").join(concentration(graph), "id", "left").crossJoin(stats)
    freq = F.coalesce("freq", F.lit(1))
    er = F.when(F.col("ln_entity") > 0, clamp(1 - F.ln(freq) / F.col("ln_entity"))).otherwise(0.0)
    span = F.col("t_max") - F.col("t_min")
    tn = F.when((F.col("first_seen") > 0) & (span > 0), clamp((F.col("first_seen") - F.col("t_min")) / span)).otherwise(0.0)
    rows = rows.select("id", er.alias("er"), F.coalesce("nc", F.lit(1.0)).alias("nc"), tn.alias("tn"))
    rows = rows.withColumn("threat", F.lit(0.0)) if threats is None else rows.join(threats.select("id", "threat"), "id", "left").withColumn("threat", clamp(F.coalesce("threat", F.lit(0.0))))
    w = weights
    total = w.entity + w.concentration + w.novelty + w.threat
    mean = (w.entity * F.col("er") + w.concentration * F.col("nc") + w.novelty * F.col("tn") + w.threat * F.col("threat")) / total if total > 0 else F.lit(0.0)
    nodes = rows.withColumn("estimate", clamp(mean))
    rare = clamp(1 - F.ln("freq") / F.col("ln_pair"))
    pairs = seen.pairs.crossJoin(stats).select("source_id", "dest_id", F.when(F.col("ln_pair") > 0, rare).otherwise(0.0).alias("rarity"), F.when(F.col("ln_pair") > 0, rare).otherwise(0.5).alias("estimate"))
    return Scorer(nodes, pairs, weights)


def path_scores(found: DataFrame, scorer: Scorer) -> DataFrame:
    """found (n0..nL, ...) with er, pair_rarity, nc, tn, threat (means over the path, within 0 and 1) and their weighted mean `anomaly`."""
    n = sum(c.startswith("n") and c[1:].isdigit() for c in found.columns)
    rows = found
    for i in range(n):
        rows = rows.join(scorer.nodes.select(F.col("id").alias(f"n{i}"), *(F.col(p).alias(f"_{p}{i}") for p in _PARTS)), f"n{i}", "left")
        if i:
            rows = rows.join(scorer.pairs.select(F.col("source_id").alias(f"n{i - 1}"), F.col("dest_id").alias(f"n{i}"), F.col("rarity").alias(f"_rarity{i}")), [f"n{i - 1}", f"n{i}"], "left")
    return _weighed(rows, found.columns, n, scorer.weights)


def _weighed(rows: DataFrame, keep: list[str], n: int, w: Weights) -> DataFrame:
    """keep, the means over n nodes of _er0.., _rarity1.. and so on, and `anomaly`."""

    def mean(part: str, first: int, missing: float) -> Column:
        return clamp(sum((F.coalesce(f"_{part}{i}", F.lit(missing)) for i in range(first, n)), F.lit(0.0)) / max(1, n - first))

    out = rows.select(*keep, mean("er", 0, 0.0).alias("er"), mean("rarity", 1, 1.0).alias("pair_rarity"), mean("nc", 0, 1.0).alias("nc"), mean("tn", 0, 0.0).alias("tn"), mean("threat", 0, 0.0).alias("threat"))
    total = w.entity + w.pair + w.concentration + w.novelty + w.threat
    score = (w.entity * F.col("er") + w.pair * F.col("pair_rarity") + w.concentration * F.col("nc") + w.novelty * F.col("tn") + w.threat * F.col("threat")) / total if total > 0 else F.lit(0.0)
    return out.withColumn("anomaly", score)


def scored_hunt(graph: Graph, hypothesis: Hypothesis, scorer: Scorer, window: tuple[int, int] | None = None, digits: int | None = None) -> DataFrame:
    """(n0..nL, t1..tL, anomaly) of all paths of a hunt: path_scores() of paths(), scored once for each path of nodes, before times multiply it.

    digits rounds the scores.
    """
    n = len(hypothesis.steps) + 1
    nodes = scorer.nodes.select("id", *(F.col(p).alias(f"_{p}") for p in _PARTS))
    pairs = scorer.pairs.select("source_id", "dest_id", F.col("rarity").alias("_rarity"))
    rows = hunt.node_paths(graph.entities, graph.relations, hypothesis, window, nodes, pairs, times=True)
    names, times = [f"n{i}" for i in range(n)], [f"ts{i}" for i in range(1, n)]
    rows = _weighed(rows, [*names, *times], n, scorer.weights).select(*names, *times, (F.col("anomaly") if digits is None else F.round("anomaly", digits)).alias("anomaly"))
    return hunt.with_times(rows).select(*names, *(f"t{i}" for i in range(1, n)), "anomaly")


def threat_of_logits(logits: Column) -> Column:
    """1 - softmax(logits)[0] of an array of class logits, the first of which is benign."""
    most = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x - most))
    return 1 - F.element_at(weights, 1) / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)


# Classes of the threat model in the order of its logits.
THREATS = ["Benign", "Exfiltration", "C2Beacon", "LateralMovement", "PrivilegeEscalation"]
