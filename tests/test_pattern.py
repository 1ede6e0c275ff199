import pytest
from hypothesis import given
from hypothesis import strategies as st

from pathloom.plans.pattern import CATALOG, Hypothesis, PatternError, Step, find_pattern, lateral_movement, parse, spawn_chain
from pathloom.schema import ENTITY_TYPES, RELATION_TYPES, InvalidHypothesis


def test_reads_steps_and_k():
    h = parse("User -[Execute]-> Process -[Write]-> File {k=3}")
    assert h.steps == (Step("User", "Execute", "Process"), Step("Process", "Write", "File"))
    assert h.k == 3


def test_text_after_the_brace_is_left_aside():
    assert parse("User-[Auth]->Host{ k = 2 } and so on").k == 2


@pytest.mark.parametrize(("text", "at"), [("", 0), ("User", 4), ("User -[Auth]-> ", 15), ("User -[Nope]-> Host", 7), ("User -> Host", 5), ("User -[Auth]-> Host {k=0}", 25)])
def test_errors_tell_where(text, at):
    with pytest.raises(PatternError) as e:
        parse(text)
    assert e.value.position == at


def test_custom_types_unless_strict():
    assert parse("Foo -[Auth]-> Host").steps[0].origin == "Foo"
    with pytest.raises(PatternError):
        parse("Foo -[Auth]-> Host", strict=True)


def test_neighbouring_types_must_meet():
    with pytest.raises(InvalidHypothesis):
        Hypothesis((Step("User", "Auth", "Host"), Step("Process", "Write", "File"))).validate()
    Hypothesis((Step("User", "Auth", "*"), Step("Process", "Write", "File"))).validate()
    with pytest.raises(InvalidHypothesis):
        Hypothesis(()).validate()


@given(st.lists(st.sampled_from([*ENTITY_TYPES, "*"]), min_size=2, max_size=6), st.data(), st.integers(1, 5))
def test_formatting_round_trips(nodes, data, k):
    steps = tuple(Step(a, data.draw(st.sampled_from([*RELATION_TYPES, "*"])), b) for a, b in zip(nodes, nodes[1:], strict=False))
    h = Hypothesis(steps, "pattern", k)
    assert parse(str(h)) == h
    assert Hypothesis.from_json(h.to_json()) == h


def test_json_without_k():
    assert Hypothesis.from_json('{"name":"x","steps":[{"origin_type":"User","relation_type":"Auth","dest_type":"Host"}]}').k == 1


def test_catalog():
    assert len(CATALOG) == 16
    assert sum(c.hypothesis().k == 2 for c in CATALOG) == 4
    assert CATALOG[0].hypothesis(k=4).k == 4


def test_builders():
    assert str(spawn_chain(3)) == "User -[Execute]-> Process -[Spawn]-> Process -[Write]-> File"
    assert len(spawn_chain(1).steps) == 1 and not spawn_chain(0).steps
    assert str(lateral_movement(3)) == "IP -[Connect]-> Host -[Auth]-> User -[Execute]-> Process"
    assert len(lateral_movement(9).steps) == 5


def test_pattern_in_free_text():
    assert find_pattern("Try this:\n`User —[Auth]→ Host -[Connect]-> IP {k=2}` now") == "User -[Auth]-> Host -[Connect]-> IP {k=2}"
    assert find_pattern("nothing here") is None
