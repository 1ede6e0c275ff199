"""Subgraph tensors around nodes, and a threat model over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.operators.anomaly import threat_of_logits
from pathloom.operators.explore import degrees
from pathloom.operators.graph import Graph
from pathloom.schema import ENTITY_TYPES
from pathloom.storage import settle

#: Nodes of a tensor and numbers of a node; 32 * 16 features and 32 * 32 adjacency make 1536.
NODES, WIDTH = 32, 16
INPUT = NODES * WIDTH + NODES * NODES


def around(graph: Graph, centers: DataFrame, hops: int = 2, limit: int = NODES) -> DataFrame:
    """(center, id, place): the first `limit` nodes by breadth, out before in, then in order of relations.

    Each hop is one join of the frontier, cut to `limit` nodes a center before the next.
    Of a node's neighbours only the first 2 * `limit` can be among them, as no more
    than `limit` of these have a place already: a hub gives no more rows than that.
    These neighbours and each hop are written out, as several joins read them.
    """
    centers = centers.select(F.col("id").alias("center"))
    out = graph.relations.select(F.col("source_id").alias("a"), F.col("dest_id").alias("b"), F.lit(0).alias("way"), "seq")
    both = out.unionByName(graph.relations.select(F.col("dest_id").alias("a"), F.col("source_id").alias("b"), F.lit(1).alias("way"), "seq"))
    both = both.join(graph.entities.select(F.col("id").alias("b")), "b", "left_semi").groupBy("a", "b").agg(F.min(F.struct("way", "seq")).alias("o"))
    nearest = Window.partitionBy("a").orderBy("o", "b")
    both = both.withColumn("i", F.row_number().over(nearest)).where(F.col("i") <= 2 * limit).drop("i")
    both = settle(both, "nearest")
    seen = centers.select("center", F.col("center").alias("id"), F.lit(0).alias("place"))
    frontier = seen
    for _ in range(hops):
        met = frontier.join(both, F.col("id") == F.col("a")).groupBy("center", "b").agg(F.min(F.struct("place", "o")).alias("o"))
        fresh = met.join(seen.select("center", F.col("id").alias("b")), ["center", "b"], "left_anti")
        # The first `limit` of a center: each task keeps no more before they meet.
        first = Window.partitionBy("center").orderBy("o", "b")
        ranked = fresh.withColumn("i", F.row_number().over(first)).where(F.col("i") <= limit)
        have = seen.groupBy("center").agg(F.count("*").cast("int").alias("n"))
        place = F.col("n") + F.col("i") - 1
        frontier = settle(ranked.join(have, "center").where(place < limit).select("center", F.col("b").alias("id"), place.alias("place")), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def among(relations: DataFrame, members: DataFrame) -> DataFrame:
    """(center, p, q): the places of both ends of every different relation between members (center, id, place) of a center.

    A pair of nodes is looked up from the one with fewer neighbours, so that a hub's
    neighbours are not met once for each center that the hub is a member of.
    """
    ends = relations.select(F.least("source_id", "dest_id").alias("a"), F.greatest("source_id", "dest_id").alias("b"), (F.col("source_id") <= F.col("dest_id")).alias("up"))
    pairs = ends.groupBy("a", "b").agg(F.max("up").alias("up"), F.max(~F.col("up")).alias("down"))
    both = F.explode(F.array(F.struct(F.col("a").alias("id")), F.struct(F.col("b").alias("id"))))
    size = pairs.select(both.alias("e")).groupBy("e.id").agg(F.count("*").alias("n"))
    for x in ("a", "b"):
        pairs = pairs.join(size.select(F.col("id").alias(x), F.col("n").alias(f"n{x}")), x)
    turn = F.col("na") > F.col("nb")
    pairs = pairs.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("few"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("many"), F.when(turn, F.col("down")).otherwise(F.col("up")).alias("there"), F.when(turn, F.col("up")).otherwise(F.col("down")).alias("back"))
    x, y = (members.select("center", F.col("id").alias(i), F.col("place").alias(p)) for i, p in (("few", "p"), ("many", "q")))
    met = x.join(pairs, "few").join(y, ["center", "many"])
    ways = F.array(F.struct("there", F.col("p"), F.col("q")), F.struct(F.col("back").alias("there"), F.col("q").alias("p"), F.col("p").alias("q")))
    return met.select("center", F.inline(ways)).where("there").select("center", "p", "q")


def tensors(graph: Graph, centers: DataFrame, estimates: DataFrame | None = None, hops: int = 2) -> DataFrame:
    """(id, features array<float> of 1536) for each center.

    A node has its type one-hot (9), out and in degree in 32nds and their sum in
    64ths, its anomaly estimate twice, and whether it is the center; all at most 1.
    The directed adjacency of the nodes follows; missing nodes are 0.
    """
    members = around(graph, centers, hops)
    facts = graph.entities.select("id", "entity_type").join(degrees(graph.relations), "id", "left").fillna(0, ["in_degree", "out_degree"])
    facts = facts.withColumn("estimate", F.lit(0.0)) if estimates is None else facts.join(estimates.select("id", "estimate"), "id", "left").fillna(0.5, ["estimate"])
    nodes = members.join(facts, "id").groupBy("center").agg(F.array_sort(F.collect_list(F.struct("place", "entity_type", "out_degree", "in_degree", "estimate"))).alias("nodes"))
    inside = among(graph.relations, members).groupBy("center").agg(F.collect_list(F.struct("p", "q")).alias("edges"))
    rows = nodes.join(inside, "center", "left").select("center", "nodes", F.coalesce("edges", F.array().cast("array<struct<p:int,q:int>>")).alias("edges"))

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = {x: i for i, x in enumerate(ENTITY_TYPES)}
        for frame in frames:
            made = []
            for nodes_, edges in zip(frame["nodes"], frame["edges"], strict=True):
                x, adjacent = np.zeros((NODES, WIDTH), np.float32), np.zeros((NODES, NODES), np.float32)
                for r in nodes_:
                    i = r["place"]
                    if r["entity_type"] in kinds:
                        x[i, kinds[r["entity_type"]]] = 1
                    x[i, 9:12] = r["out_degree"] / 32, r["in_degree"] / 32, r["estimate"]
                    x[i, 13:16] = r["estimate"], (r["out_degree"] + r["in_degree"]) / 64, float(i == 0)
                for e in edges:
                    adjacent[e["p"], e["q"]] = 1
                made.append(np.minimum(np.concatenate([x.ravel(), adjacent.ravel()]), 1))
            yield pd.DataFrame({"id": frame["center"], "features": made})

    return rows.mapInPandas(build, "id string, features array<float>")


def infer(features: DataFrame, model: bytes) -> DataFrame:
    """(id, logits, threat_class, threat) by an ONNX model of one input of 1536 floats and 5 logits.

    A worker loads the model once; rows that it cannot score have threat 0.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import onnxruntime

        session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
        name, shape = session.get_inputs()[0].name, session.get_inputs()[0].shape
        for frame in frames:
            x = np.stack(frame["features"].to_list()).astype(np.float32) if len(frame) else np.zeros((0, INPUT), np.float32)
            try:
                if shape and shape[0] == 1:
                    logits = np.concatenate([session.run(None, {name: row[None]})[0] for row in x]) if len(x) else np.zeros((0, 5))
                else:
                    logits = session.run(None, {name: x})[0]
            except Exception:  # a model that refuses the input scores nothing
                logits = np.full((len(x), 5), np.nan)
            yield pd.DataFrame({"id": frame["id"], "logits": [r.astype(float).tolist() for r in logits]})

    rows = features.mapInPandas(run, "id string, logits array<double>")
    broken = F.exists("logits", lambda v: F.isnan(v))
    best = F.array_position("logits", F.array_max("logits")).cast("int") - 1
    return rows.select("id", "logits", F.when(~broken, best).alias("threat_class"), F.when(broken, 0.0).otherwise(threat_of_logits(F.col("logits"))).alias("threat"))
