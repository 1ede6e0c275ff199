"""The two graph tables, the triple that parsers produce, and names that are fixed."""

from __future__ import annotations

# Entity and relation type names. Entity types are open, relation types closed.
ENTITY_TYPES = ["IP", "Host", "User", "Process", "File", "Domain", "Registry", "URL", "Service"]
RELATION_TYPES = ["Auth", "Connect", "Execute", "Read", "Write", "DNS", "Modify", "Spawn", "Delete"]
ANY = "*"

ENTITY_DDL = "id string, entity_type string, score double, degree_score double, betweenness double, pagerank_score double, metadata map<string,string>, dataset_id string"
RELATION_DDL = "source_id string, dest_id string, rel_type string, timestamp bigint, metadata map<string,string>, dataset_id string, seq bigint"
TRIPLE_DDL = "src_id string, src_type string, src_meta map<string,string>, rel_type string, timestamp bigint, rel_meta map<string,string>, dst_id string, dst_type string, dst_meta map<string,string>, seq bigint"


class GraphError(Exception):
    """Base of the errors below."""


class EntityNotFound(GraphError):
    pass


class DuplicateEntity(GraphError):
    pass


class InvalidHypothesis(GraphError):
    pass


def relation_type(name: str) -> str:
    """The relation type of that name, `*` included; ValueError if there is none."""
    if name != ANY and name not in RELATION_TYPES:
        raise ValueError(f"unknown relation type {name!r}")
    return name


def entity_type(name: str, strict: bool = False) -> str:
    """Any non-empty name is an entity type; strict takes only the fixed ones and `*`."""
    if not name or (strict and name != ANY and name not in ENTITY_TYPES):
        raise ValueError(f"unknown entity type {name!r}")
    return name
