"""Ranking and paging of found paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.fields import label
from pathloom.operators.anomaly import Scorer, path_scores
from pathloom.operators.graph import Graph

#: Paths that a hunt shows at once; of more only the count is told and pages are asked for.
INLINE, PAGE = 100, 20


def nodes_in(found: DataFrame) -> list[str]:
    return sorted((c for c in found.columns if c.startswith("n") and c[1:].isdigit()), key=lambda c: int(c[1:]))


def chain(names: list[str]) -> Column:
    return F.concat_ws(" -> ", *(label(F.col(c)) for c in names))


def scored(found: DataFrame, graph: Graph, scorer: Scorer | None = None) -> DataFrame:
    """found with max_score, total_score, anomaly (0 without a scorer), first and last time, and chain.

    The times are those of all relations between neighbouring nodes, without unknown
    ones; 0 where there is none.
    """
    names = nodes_in(found)
    rows = found
    for c in names:
        rows = rows.join(graph.entities.select(F.col("id").alias(c), F.col("score").alias(f"_s{c}")), c, "left")
    scores = [F.coalesce(f"_s{c}", F.lit(0.0)) for c in names]
    known = F.when(F.col("timestamp") != 0, F.col("timestamp"))
    spans = graph.relations.groupBy("source_id", "dest_id").agg(F.min(known).alias("lo"), F.max(known).alias("hi"))
    for a, b in zip(names, names[1:], strict=False):
        rows = rows.join(spans.select(F.col("source_id").alias(a), F.col("dest_id").alias(b), F.col("lo").alias(f"_lo{b}"), F.col("hi").alias(f"_hi{b}")), [a, b], "left")
    lows, highs = [F.col(f"_lo{b}") for b in names[1:]], [F.col(f"_hi{b}") for b in names[1:]]
    first = F.least(*lows) if len(lows) > 1 else lows[0]
    last = F.greatest(*highs) if len(highs) > 1 else highs[0]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    rows = rows.select(*found.columns, best.alias("max_score"), sum(scores, F.lit(0.0)).alias("total_score"), F.coalesce(first, F.lit(0)).alias("first_time"), F.coalesce(last, F.lit(0)).alias("last_time"), chain(names).alias("chain"))
    if scorer is None:
        return rows.withColumn("anomaly", F.lit(0.0))
    return path_scores(rows, scorer).drop("er", "pair_rarity", "nc", "tn", "threat")


def page(rows: DataFrame, number: int = 0, size: int = PAGE, min_score: float | None = None) -> tuple[DataFrame, int]:
    """(page of scored paths by anomaly, largest and total score, how many paths pass min_score)."""
    if min_score is not None:
        rows = rows.where(F.col("max_score") >= min_score)
    names = nodes_in(rows)
    rest = [c for c in rows.columns if c.startswith("t") and c[1:].isdigit()]
    order = [F.desc("anomaly"), F.desc("max_score"), F.desc("total_score"), *names, *rest]
    return rows.orderBy(*order).offset(number * size).limit(size), rows.count()


def shown(found: DataFrame, inline: int = INLINE) -> tuple[DataFrame | None, int]:
    """(paths if there are at most `inline`, their number)."""
    n = found.count()
    return (found if n <= inline else None), n
