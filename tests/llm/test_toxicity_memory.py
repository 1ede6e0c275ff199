"""Bounds of what a worker holds and does while it looks for neighbours."""

import numpy as np
import pyarrow as pa
import pytest

from pathloom.llm import toxicity


@pytest.mark.parametrize("meetings", [1, 40, 10**6])
def test_nearest_in_parts_of_bounded_size(monkeypatch, meetings):
    """Documents go on together only while their terms meet few blocks; neighbours stay the same."""
    rng = np.random.default_rng(2)
    texts = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 40, rng.integers(0, 30))) for _ in range(300)])
    terms = toxicity._terms(texts)
    counts = toxicity.term_counts(texts, terms)
    index = toxicity.build(terms, counts, (np.arange(300) % 3 == 0).astype(np.int64), np.arange(300), np.full(sum(map(len, terms)), 9), 300)
    want = index.nearest(*index.vectors(counts))
    held, step = [], toxicity.Index._nearest

    def watched(self, bounds, dim, weight, *rest):
        held.append((len(bounds) - 1, int((self.by_dim[dim + 1] - self.by_dim[dim]).sum())))
        return step(self, bounds, dim, weight, *rest)

    monkeypatch.setattr(toxicity, "MEETINGS", meetings, raising=False)
    monkeypatch.setattr(toxicity.Index, "_nearest", watched)
    got = index.nearest(*index.vectors(counts))
    assert all(np.array_equal(x, y) for x, y in zip(got, want, strict=True))
    assert sum(n for n, _ in held) == 300 and all(n == 1 or met <= meetings for n, met in held)


def _word(kind: str, k: int) -> str:
    return kind + chr(97 + k // 26) + chr(97 + k % 26)


def test_postings_of_frequent_terms_are_not_expanded(monkeypatch):
    """Words that most examples hold cost one matrix product; neighbours are those of whole vectors, ties by place."""
    rng = np.random.default_rng(6)
    said = [" ".join([_word("b", x) for x in rng.integers(0, 60, 40)] + [_word("f", x) for x in rng.integers(0, 900, 2)]) for _ in range(500)]
    texts, asked = pa.array(said + said[:100] + ["", _word("f", 1)]), pa.array([*said[50:150], "", "unheard of", _word("f", 2), _word("b", 3)])
    terms = toxicity._terms(texts)
    width, y = sum(map(len, terms)), (np.arange(602) % 3 == 0).astype(np.int64)
    counts, asks = toxicity.term_counts(texts, terms), toxicity.term_counts(asked, terms)
    index = toxicity.build(terms, counts, y, np.arange(602), np.bincount(counts[1], minlength=width), 602)
    work, gather = [], toxicity.gather
    monkeypatch.setattr(toxicity, "gather", lambda starts, lengths: work.append(int(lengths.sum())) or gather(starts, lengths))
    index.nearest(*index.vectors(asks))  # makes the matrix
    work.clear()
    who, sims = index.nearest(*index.vectors(asks))
    assert sum(work) < np.bincount(counts[1], minlength=width)[asks[1]].sum() / 4

    def plain(counts):
        full, (bounds, dim, weight) = np.zeros((counts[3], width)), index.vectors(counts)
        full[np.repeat(np.arange(counts[3]), np.diff(bounds)), dim] = weight
        return full

    cosine = np.round((plain(asks) @ plain(counts).T)[:, index.ids], 9)
    assert np.array_equal(np.round(sims, 9), -np.sort(-cosine, axis=1)[:, :15])
    assert np.array_equal(who, np.argsort(-cosine, axis=1, kind="stable")[:, :15])


@pytest.mark.parametrize("examples", [1, 5, 70])
def test_fewer_examples_than_neighbours(examples):
    texts = pa.array([f"same {_word('b', i)} {_word('f', i // 2)}" for i in range(examples)])
    terms = toxicity._terms(texts)
    index = toxicity.build(terms, toxicity.term_counts(texts, terms), np.arange(examples) % 2, np.arange(examples), np.ones(sum(map(len, terms)), np.int64), examples)
    score, evidence = index.score(pa.array(["same " + _word("b", 1), "unheard of", ""]))
    assert np.isfinite(score).all() and [len(x) for x in evidence] == [min(15, examples), 0, 0]
