"""Fits that once took a part of the corpus."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from pathloom.llm import licenses, pu_quality


def test_quality_learns_from_all_unlabelled_text(spark, monkeypatch):
    monkeypatch.setattr(pu_quality, "SAMPLE", 50)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "And", "of!", "#", "stone"]) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    labels = [(i, i % 2) for i in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "with no id")], "doc_id bigint, text string")
    net = pu_quality.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    trusted = [r.doc_id for r in pu_quality.learn_rows(spark.createDataFrame(labels, "doc_id bigint, quality int"), "quality", pu_quality.FOLDS, pu_quality.HELD).where("y = 1").collect()]
    rest = [*texts[60:], "with no id"]
    seen = [set(t.lower().split()) for t in [*texts, "with no id"]]
    for word in ("the", "stone", "with"):  # one word a bucket here
        _, at = pu_quality.buckets(pu_quality.coded_words(pa.array([word])))
        assert net.evidence.every[at[0]] == sum(word in s for s in seen) and net.evidence.positive[at[0]] == sum(word in seen[i] for i in trusted)
    x = np.concatenate([pu_quality.features(pa.array([texts[i] for i in trusted]), net.evidence, np.ones(len(trusted), bool)), pu_quality.features(pa.array(rest), net.evidence)])
    assert net.mean == pytest.approx(x.mean(0)) and net.scale == pytest.approx(x.std(0) + 1e-3)


@pytest.mark.parametrize("labels", [[], [(0, 1), (1, 1), (2, 0)], [(0, 0)]])
def test_quality_keeps_all_where_nothing_is_to_learn(spark, labels):
    docs = spark.createDataFrame([(0, "a b"), (1, "c"), (2, "#")], "doc_id bigint, text string")
    net = pu_quality.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    assert pu_quality.with_quality(docs, net).count() == 3


def test_word_features_leave_the_own_text_out():
    texts = ["good words", "good", "bad"]
    words = pu_quality.coded_words(pa.array(texts))
    doc, at = pu_quality.buckets(words)
    positive, every = np.zeros(1 << pu_quality.BITS), np.zeros(1 << pu_quality.BITS)
    counts = {"good": (90, 99), "words": (3, 19), "bad": (1, 199)}  # among 100 positives, and in 998 texts
    assert len(at) == len(doc) == 4
    for word, (p, n) in counts.items():
        _, own = pu_quality.buckets(pu_quality.coded_words(pa.array([word.upper()])))
        positive[own], every[own] = p, n
    mean, unlike = pu_quality.word_features(words, pu_quality.Evidence(positive, every, 100, 998), np.asarray([True, True, False]))
    good, bad = np.log(90 / (9.9 + 1)), np.log(2 / 21)  # of `good` without the text's own; chance explains `words`
    assert mean == pytest.approx([good / 2, good, bad]) and unlike.tolist() == [0, 0, 1]


def test_risk_and_its_gradient():
    """One plain step from the start follows the numerical gradient of the non-negative risk."""
    rng = np.random.default_rng(5)
    p, u, prior = rng.normal(1, 1, (40, 3)), rng.normal(0, 1, (60, 3)), 0.4
    net = pu_quality._start(np.zeros(3), np.ones(3))

    def risk(params):
        z = [np.tanh(x @ params[0] + params[1]) @ params[2] + params[3][0] for x in (p, u)]
        positive, negative, unlabelled = np.logaddexp(0, -z[0]).mean(), np.logaddexp(0, z[0]).mean(), np.logaddexp(0, z[1]).mean()
        assert unlabelled - prior * negative > 0
        return prior * positive + unlabelled - prior * negative + 0.5e-4 * sum((w**2).sum() for w in (params[0], params[2]))

    flat = [net.w1, net.b1, net.w2, net.b2]
    slope = []
    for w in flat:
        d = np.zeros_like(w)
        for i in np.ndindex(w.shape):
            for sign in (1, -1):
                moved = [x.copy() for x in flat]
                moved[[x is w for x in flat].index(True)][i] += sign * 1e-5
                d[i] += sign * risk(moved) / 2e-5
        slope.append(d)
    slopes, mix = pu_quality.risk_slopes(prior, len(p), len(u))
    after = pu_quality._descend(net, p, u, slopes, mix, lambda x: x, 1)  # Adam's first step has the gradient's sign
    for w, new, d in zip(flat, (after.w1, after.b1, after.w2, after.b2), slope, strict=True):
        assert np.allclose(w - new, pu_quality.RATE * d / (np.abs(d) + 1e-8), atol=1e-4)


def test_training_in_one_process():
    rng = np.random.default_rng(2)
    p, u = rng.normal(1, 1, (300, 9)), rng.normal(0, 1, (500, 9))
    whole = pu_quality.train((p, np.arange(300) % 2 == 0), (u, np.arange(500) % 2 == 0), rounds=40)
    assert 0.05 <= whole.prior <= 0.98 and pu_quality._sigmoid(whole.logits(p)).mean() > pu_quality._sigmoid(whole.logits(u)).mean()


def test_licences_beyond_the_short_ones(spark):
    at = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    found = [f for f in names if (at / f).exists()]
    if not found:
        pytest.skip("no licence texts here")
    docs = spark.createDataFrame([(i, (at / f).read_text()) for i, f in enumerate(found)], "doc_id bigint, text string")
    assert {r.doc_id: r.license for r in licenses.scan(docs).collect()} == {i: names[f] for i, f in enumerate(found)}


def test_notices_of_a_caller_need_no_certain_word(spark):
    docs = spark.createDataFrame([(1, "Some text.\nDedicated to the public domain.\nMore."), (2, "Dedicated to the public")], "doc_id bigint, text string")
    rows = licenses.scan(docs, notices=[("PD", "Dedicated to the public domain")]).collect()
    assert {r.doc_id: (r.notices, r.n_notices) for r in rows} == {1: ("PD", 1), 2: ("", 0)}
