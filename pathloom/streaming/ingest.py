"""Log files that arrive over time, folded into a stored graph batch by batch.

A batch is stored as what it adds: its triples, numbered after all earlier ones, and
its observations. The graph is the last whole one with the later batches merged in;
a new whole one is written when the additions have grown as large as it is, so that
the work of all batches together stays in proportion to their rows. A batch is
written under its number before its mark: one that runs twice leaves the same graph.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pathloom.operators.anomaly import Observations, observe
from pathloom.operators.graph import FIRST, Graph, ingest, load, save
from pathloom.schema import TRIPLE_DDL
from pathloom.sources import records_of, triples_of
from pathloom.sources.records import densely_numbered

Progress = Callable[[int, int, int], None]
#: Relations of batches from which a whole graph is written though the last one is smaller.
LEAST = 100_000


class GraphSink:
    """Batches and whole versions of a graph and its observations below a folder."""

    def __init__(self, spark: SparkSession, path: str, dataset_id: str | None = None, policy: str = FIRST, keep: int = 2):
        self.spark, self.path, self.dataset_id, self.policy, self.keep = spark, path.rstrip("/"), dataset_id, policy, keep
        self.fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _marks(self, kind: str) -> list[tuple[int, dict]]:
        """(number, mark) of what is written whole, in order."""
        if not self.fs.exists(self.fs_path(self.path)):
            return []
        names = [x.getPath().getName() for x in self.fs.listStatus(self.fs_path(self.path))]
        numbers = sorted(int(x[2:]) for x in names if x.startswith(f"{kind}=") and x[2:].isdigit() and self.fs.exists(self.fs_path(f"{self.path}/{x}/_DONE")))
        return [(n, json.loads(self._read(f"{self.path}/{kind}={n}/_DONE") or "{}")) for n in numbers]

    def _read(self, path: str) -> str:
        stream = self.fs.open(self.fs_path(path))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _mark(self, path: str, mark: dict) -> None:
        out = self.fs.create(self.fs_path(f"{path}/_DONE"), True)
        out.write(bytearray(json.dumps(mark).encode()))
        out.close()

    def versions(self) -> list[int]:
        """Numbers of the batches that are in."""
        return [n for n, _ in self._marks("b")]

    def _later(self) -> tuple[int | None, list[tuple[int, dict]]]:
        whole = [n for n, _ in self._marks("w")]
        last = whole[-1] if whole else None
        return last, [(n, m) for n, m in self._marks("b") if last is None or n > last]

    def _triples(self, batches: list[tuple[int, dict]]) -> DataFrame:
        rows = [self.spark.read.schema(TRIPLE_DDL).parquet(f"{self.path}/b={n}/triples") for n, _ in batches]
        return reduce(DataFrame.unionByName, rows)

    def graph(self) -> Graph:
        last, later = self._later()
        base = Graph.empty(self.spark) if last is None else load(self.spark, f"{self.path}/w={last}", strict=False)
        if not later:
            return base
        return ingest(base, self._triples(later), self.dataset_id, self.policy, renumber=False)[0]

    def observations(self) -> Observations:
        last, later = self._later()
        parts = [f"{self.path}/b={n}" for n, _ in later] + ([] if last is None else [f"{self.path}/w={last}"])
        if not parts:
            return observe(Graph.empty(self.spark).relations)
        found = [Observations(self.spark.read.parquet(f"{at}/seen"), self.spark.read.parquet(f"{at}/pairs")) for at in parts]
        return reduce(lambda a, b: a.merge(b), found)

    def write(self, triples: DataFrame, batch: int, on_progress: Progress | None = None) -> None:
        """Add a batch; triples are numbered from 0, densely or nearly so."""
        marks = self._marks("b")
        if any(n == batch for n, _ in marks):
            return
        at = f"{self.path}/b={batch}"
        start = max((m["next"] for n, m in marks if n < batch), default=0)
        triples.withColumn("seq", F.col("seq") + start).write.mode("overwrite").parquet(f"{at}/triples")
        rows = self.spark.read.schema(TRIPLE_DDL).parquet(f"{at}/triples")
        new = observe(rows.select(F.col("src_id").alias("source_id"), F.col("dst_id").alias("dest_id"), "timestamp"))
        new.entities.write.mode("overwrite").parquet(f"{at}/seen")
        new.pairs.write.mode("overwrite").parquet(f"{at}/pairs")
        n, most = rows.agg(F.count("*"), F.max("seq")).first()
        known = self.graph().entities.select("id") if on_progress else None
        self._mark(at, {"rows": n, "next": start if most is None else most + 1})
        if on_progress:
            ends = rows.select(F.explode(F.array("src_id", "dst_id")).alias("id")).distinct()
            on_progress(batch, ends.join(known, "id", "left_anti").count(), n)
        self._settle()

    def _settle(self) -> None:
        """A whole graph in place of the batches, once they are as large as the last one."""
        wholes = self._marks("w")
        last, later = self._later()
        if not later or sum(m["rows"] for _, m in later) < max(LEAST, wholes[-1][1]["rows"] if wholes else 0):
            return
        at, graph, seen = f"{self.path}/w={later[-1][0]}", self.graph(), self.observations()
        save(graph, at)
        seen.entities.write.mode("overwrite").parquet(f"{at}/seen")
        seen.pairs.write.mode("overwrite").parquet(f"{at}/pairs")
        self._mark(at, {"rows": sum(m["rows"] for _, m in later) + (wholes[-1][1]["rows"] if wholes else 0)})
        # The last `keep` whole graphs stay, and the batches after the oldest of them; of others only the marks.
        numbers = [n for n, _ in wholes] + [later[-1][0]]
        for n in numbers[: -self.keep]:
            self.fs.delete(self.fs_path(f"{self.path}/w={n}"), True)
        for n in self.versions():
            if n <= numbers[-self.keep :][0]:
                for part in ("triples", "seen", "pairs"):
                    self.fs.delete(self.fs_path(f"{self.path}/b={n}/{part}"), True)


def stream_logs(spark: SparkSession, source: str, sink: GraphSink, checkpoint: str, format: str = "generic", files_per_batch: int = 1, on_progress: Progress | None = None) -> StreamingQuery:
    """Fold the files of a folder into the sink and stop when all that are there are in; run again for later ones."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(source)

    def fold(batch: DataFrame, number: int) -> None:
        sink.write(triples_of(records_of(densely_numbered(batch), format), format), number, on_progress)

    return lines.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(relations: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """(rel_type, hour, n) of a stream of relations, each window once it can no longer change."""
    timed = relations.withColumn("at", F.timestamp_seconds("timestamp")).withWatermark("at", late)
    return timed.groupBy("rel_type", F.window("at", width)).agg(F.count("*").alias("n")).select("rel_type", F.unix_seconds("window.start").alias("hour"), "n")
