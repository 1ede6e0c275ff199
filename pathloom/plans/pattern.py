"""Hypotheses: typed arrow chains such as ``User -[Execute]-> Process -[Write]-> File {k=1}``."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace

from pathloom.schema import ANY, InvalidHypothesis, entity_type, relation_type


class PatternError(InvalidHypothesis):
    """A pattern that cannot be read; position is the byte where reading stopped."""

    def __init__(self, message: str, position: int):
        super().__init__(f"{message} at {position}")
        self.position = position


@dataclass(frozen=True)
class Step:
    origin: str
    relation: str
    dest: str


@dataclass(frozen=True)
class Hypothesis:
    steps: tuple[Step, ...]
    name: str = "pattern"
    k: int = 1

    def validate(self) -> Hypothesis:
        """Itself; InvalidHypothesis if it has no step or neighbouring types differ without a wildcard."""
        if not self.steps:
            raise InvalidHypothesis("a hypothesis needs a step")
        for i, (a, b) in enumerate(zip(self.steps, self.steps[1:], strict=False)):
            if a.dest != b.origin and ANY not in (a.dest, b.origin):
                raise InvalidHypothesis(f"step {i + 1} ends in {a.dest}, step {i + 2} begins in {b.origin}")
        return self

    def __str__(self) -> str:
        text = self.steps[0].origin if self.steps else ""
        text += "".join(f" -[{s.relation}]-> {s.dest}" for s in self.steps)
        return text + (f" {{k={self.k}}}" if self.k > 1 else "")

    def to_json(self) -> str:
        return json.dumps({
            "name": self.name,
            "steps": [{"origin_type": s.origin, "relation_type": s.relation, "dest_type": s.dest} for s in self.steps],
            "k_simplicity": self.k,
        })

    @staticmethod
    def from_json(text: str) -> Hypothesis:
        """k_simplicity may be missing and is 1 then."""
        raw = json.loads(text)
        steps = tuple(Step(entity_type(s["origin_type"]), relation_type(s["relation_type"]), entity_type(s["dest_type"])) for s in raw["steps"])
        return Hypothesis(steps, raw.get("name", "pattern"), int(raw.get("k_simplicity", 1)))


_NAME = re.compile(r"\*|[A-Za-z_][A-Za-z0-9_]*")
_SPACE = re.compile(r"\s*")
_NUMBER = re.compile(r"[0-9]+")


def parse(text: str, name: str = "pattern", strict: bool = False) -> Hypothesis:
    """Read ``T ( -[R]-> T )+ [ {k=N} ]``; what follows the closing brace is left aside."""
    at = 0

    def skip() -> None:
        nonlocal at
        at = _SPACE.match(text, at).end()

    def fail(message: str):
        raise PatternError(message, len(text[:at].encode()))

    def token(pattern: re.Pattern, what: str) -> str:
        nonlocal at
        skip()
        found = pattern.match(text, at)
        if not found:
            fail(f"expected {what}")
        at = found.end()
        return found[0]

    def literal(mark: str) -> None:
        nonlocal at
        skip()
        if not text.startswith(mark, at):
            fail(f"expected {mark!r}")
        at += len(mark)

    def checked(check, pattern: re.Pattern, what: str) -> str:
        nonlocal at
        skip()
        start = at
        found = token(pattern, what)
        try:
            return check(found)
        except ValueError as e:
            at = start
            fail(str(e))

    def node() -> str:
        return checked(lambda x: entity_type(x, strict), _NAME, "an entity type")

    here = node()
    steps, k = [], 1
    while True:
        skip()
        if at == len(text) or text[at] == "{":
            break
        literal("-[")
        relation = checked(relation_type, _NAME, "a relation type")
        literal("]->")
        there = node()
        steps.append(Step(here, relation, there))
        here = there
    if at < len(text):
        for mark in ("{", "k", "="):
            literal(mark)
        k = int(token(_NUMBER, "a number"))
        literal("}")
        if k < 1:
            fail("k must be 1 or more")
    if not steps:
        fail("expected '-['")
    return Hypothesis(tuple(steps), name, k).validate()


def find_pattern(text: str) -> str | None:
    """The first line of free text that holds a pattern that parses, made plain.

    Unicode arrows and dashes, zero-width characters, escaped underscores and code
    marks go; a line that looks like a pattern but is none is passed over.
    """
    for line in text.splitlines():
        line = re.sub(r"[\u200b-\u200d\u2060\ufeff]", "", line).replace("\\_", "_")
        line = re.sub(r"[→⟶]", "->", re.sub(r"[–—−]", "-", line)).strip().strip("`").strip()
        line = re.sub(r"\]\s*-?-?>", "]->", re.sub(r"-+\s*\[", "-[", line))
        found = re.search(r"(\*|[A-Za-z_]\w*)(\s*-\[\s*[\w*]+\s*\]->\s*(\*|[A-Za-z_]\w*))+(\s*\{\s*k\s*=\s*\d+\s*\})?", line)
        if found:
            try:
                parse(found[0])
            except (InvalidHypothesis, ValueError):
                continue
            return found[0]
    return None


@dataclass(frozen=True)
class CatalogEntry:
    id: str
    name: str
    technique: str
    pattern: str
    k: int = 1

    def hypothesis(self, k: int | None = None) -> Hypothesis:
        return replace(parse(self.pattern, self.name), k=k or self.k)


# Ids, titles, ATT&CK techniques and patterns of the shipped hypotheses.
CATALOG = [
    CatalogEntry("cat-001", "Valid Accounts — Lateral Auth", "T1078", "User -[Auth]-> Host -[Execute]-> Process"),
    CatalogEntry("cat-002", "PowerShell Execution", "T1059.001", "User -[Execute]-> Process -[Spawn]-> Process -[Write]-> File"),
    CatalogEntry("cat-003", "RDP Lateral Movement", "T1021.001", "IP -[Connect]-> Host -[Auth]-> User -[Execute]-> Process"),
    CatalogEntry("cat-004", "Credential Dumping", "T1003", "User -[Execute]-> Process -[Read]-> File"),
    CatalogEntry("cat-005", "Application Layer Protocol — C2", "T1071", "Process -[DNS]-> Domain -[Connect]-> IP"),
    CatalogEntry("cat-006", "Service Execution", "T1569.002", "User -[Execute]-> Process -[Modify]-> Service"),
    CatalogEntry("cat-007", "Scheduled Task", "T1053.005", "Process -[Write]-> File -[Execute]-> Process"),
    CatalogEntry("cat-008", "Process Injection", "T1055", "Process -[Spawn]-> Process -[Write]-> File"),
    CatalogEntry("cat-009", "DNS Exfiltration", "T1048.003", "User -[Execute]-> Process -[DNS]-> Domain"),
    CatalogEntry("cat-010", "Malware Drop and Execute", "T1204.002", "Process -[Write]-> File -[Execute]-> Process"),
    CatalogEntry("cat-011", "Registry Persistence", "T1547.001", "Process -[Modify]-> Registry -[Execute]-> Process"),
    CatalogEntry("cat-012", "Multi-stage Lateral Movement", "T1021", "User -[Auth]-> Host -[Execute]-> Process -[Write]-> File"),
    CatalogEntry("cat-013", "C2 Callback Loop", "T1071", "Process -[DNS]-> Domain -[Connect]-> IP -[Connect]-> Process {k=2}", 2),
    CatalogEntry("cat-014", "Persistence Cycle", "T1547.001", "Process -[Modify]-> Registry -[Execute]-> Process {k=2}", 2),
    CatalogEntry("cat-015", "Lateral Movement with Return", "T1021", "Host -[Auth]-> User -[Execute]-> Process -[Connect]-> Host {k=2}", 2),
    CatalogEntry("cat-016", "Fileless Loop (Process re-exec)", "T1059", "Process -[Spawn]-> Process -[Execute]-> Process {k=2}", 2),
]


def spawn_chain(length: int) -> Hypothesis:
    """A user executes a process, processes spawn each other, the last of `length` steps writes a file."""
    middle = (Step("Process", "Spawn", "Process"),) * max(0, length - 2)
    steps = (Step("User", "Execute", "Process"), *middle, Step("Process", "Write", "File"))
    return Hypothesis(steps[: max(0, length)] if length < 2 else steps, f"spawn_chain_L{length}")


def lateral_movement(length: int) -> Hypothesis:
    """The first `length` steps, five at most, of a movement from an address to a re-read file."""
    chain = ["IP", "Connect", "Host", "Auth", "User", "Execute", "Process", "Write", "File", "Read", "Process"]
    steps = tuple(Step(*chain[2 * i : 2 * i + 3]) for i in range(min(length, 5)))
    return Hypothesis(steps, f"lateral_L{length}")
