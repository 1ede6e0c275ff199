"""Hunting sessions: a stored graph with pinned nodes, notes and data sets beside it."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from pathloom.operators.graph import Graph, load, remove_dataset, save


@dataclass
class Session:
    name: str
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    pinned: list[str] = field(default_factory=list)
    notes: dict[str, dict[str, str | None]] = field(default_factory=dict)
    datasets: dict[str, str] = field(default_factory=dict)

    def pin(self, node: str) -> None:
        if node not in self.pinned:
            self.pinned.append(node)

    def unpin(self, node: str) -> None:
        self.pinned = [x for x in self.pinned if x != node]

    def note(self, text: str, node: str | None = None, key: str | None = None) -> str:
        key = key or uuid.uuid4().hex
        self.notes[key] = {"text": text, "node": node}
        return key

    def drop_note(self, key: str) -> None:
        self.notes.pop(key, None)


class Workspace:
    """Sessions below a folder that Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, session: Session, graph: Graph) -> None:
        save(graph, f"{self.path}/{session.id}")
        row = self.spark.createDataFrame([(session.id, session.name, json.dumps(asdict(session)))], "id string, name string, body string")
        row.coalesce(1).write.mode("overwrite").json(f"{self.path}/{session.id}/session")

    def sessions(self) -> dict[str, str]:
        """Names by id, from the small session files alone."""
        rows = self.spark.read.schema("id string, name string").json(f"{self.path}/*/session")
        return {r.id: r.name for r in rows.collect()}

    def open(self, id: str) -> tuple[Session, Graph]:
        body = self.spark.read.schema("body string").json(f"{self.path}/{id}/session").first().body
        return Session(**json.loads(body)), load(self.spark, f"{self.path}/{id}")


def drop_dataset(session: Session, graph: Graph, dataset_id: str) -> Graph:
    """Remove a data set with the pins and notes of the entities that go."""
    left, _ = remove_dataset(graph, dataset_id)
    named = [*session.pinned, *(n["node"] for n in session.notes.values() if n["node"])]
    if named:
        wanted = graph.entities.sparkSession.createDataFrame([(x,) for x in set(named)], "id string")
        still = {r.id for r in left.entities.join(wanted, "id", "left_semi").select("id").collect()}
        session.pinned = [x for x in session.pinned if x in still]
        session.notes = {k: n for k, n in session.notes.items() if n["node"] is None or n["node"] in still}
    session.datasets.pop(dataset_id, None)
    return left
