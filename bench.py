"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores. Each query runs to the
end of its plan through the no-op sink, once to warm up and once timed; hunts also
run on random graphs of the sizes that the baseline names.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from pathloom.operators.generators import as_graph, barabasi_albert, erdos_renyi
from pathloom.plans.hunt import paths
from pathloom.plans.pattern import lateral_movement, spawn_chain
from pathloom.queries import registry

HEADLINE = [
    "hunt_execute_write", "hunt_in_window", "hunt_wildcards", "hunt_spawned_write", "hunt_hub_window", "hunt_round_trip", "hunt_capped", "hunt_ranked", "path_page", "search", "neighbourhood",
    "subgraph", "entity_type_counts", "heatmap", "timeline", "compaction", "degree_scores", "concentration", "node_estimates", "temporal_pagerank", "parse_json_lines", "parse_cef", "parse_csv",
    "parse_process_events", "merge_first", "merge_append",
]


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        run = lambda q=registry.QUERIES[name]: q(spark, sf_dir).write.format("noop").mode("overwrite").save()
        try:
            run()
            seconds[name] = timed(run)
        except Exception as e:
            print(f"{name}: {e}", file=sys.stderr)
    for n in (100, 500, 1000):
        for label, made, pattern in (("er", erdos_renyi(n, 10 / n, seed=42), lateral_movement(3)), ("ba", barabasi_albert(n, 3, seed=42), spawn_chain(3))):
            g = as_graph(spark, *made)
            run = lambda g=g, h=pattern: paths(g.entities, g.relations, h).count()
            run()
            seconds[f"hunt_{label}_{n}"] = timed(run)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rate = round(events / seconds["parse_json_lines"]) if "parse_json_lines" in seconds else None
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rpartition("sf")[2], "events_per_s": rate}))
    spark.stop()


if __name__ == "__main__":
    main()
