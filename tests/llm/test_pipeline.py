"""The pipeline, stage by stage, against brute force, and on odd tables."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_documents import groups, removed
from tokenizers import Tokenizer

import corpus_pipeline
from pathloom import storage
from pathloom.llm import pu_quality, toxicity, weak_rules

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def corpus(seed=11):
    """Clean, toxic and bad texts with copies, near copies and shared passages; some without id or text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(60)]
    rows, labels = [], []
    for i in range(500):
        toxic, bad = rng.random() < 0.15, rng.random() < 0.15
        w = [word() for _ in range(rng.randint(60, 110))]
        if i % 9 == 0:
            w[20:20] = passage
        if toxic:
            for _ in range(6):
                w[rng.randrange(len(w))] = rng.choice(["vile", "foul", "rotten"])
        rows.append((i, " ".join(x + "###" if bad and rng.random() < 0.6 else x for x in w) + "."))
        if i % 2:
            labels.append((i, int(not bad), int(toxic)))
    for i in range(0, 60, 4):  # copies, and copies with a word changed
        rows.append((600 + i, rows[i][1]))
        rows.append((601 + i, " ".join([*rows[i][1].split()[:-1], "changed"])))
    rows += [(None, rows[3][1]), (None, "a text without id " * 5), (None, "a text without id " * 5), (None, "another one, like none"), (None, None), (700, None), (701, ""), (702, " \n")]
    return rows, labels


def stored(spark, folder, rows, labels):
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_every_stage(spark, tmp_path):
    rows, labels = corpus()
    sf = stored(spark, tmp_path / "sf", rows, labels)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {i: (q, t) for i, q, t in labels}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, sf)
        assert name == "packing" or out.schema == docs.schema
        out.write.parquet(f"{tmp_path}/{name}")
        docs, was = spark.read.schema(out.schema).parquet(f"{tmp_path}/{name}"), [(r.doc_id, r.text) for r in before]
        if name in ("toxicity", "quality"):
            kept, told = pairs(docs), 1 - (name == "quality")
            assert set(map(repr, kept)) <= set(map(repr, was)) and (not told or all(r in kept for r in was if not (r[1] or "").split()))
            right = [(truth[i][told] == 1) == ((i, t) in kept) for i, t in was if i in truth]
            assert (1 - np.mean(right) if told else np.mean(right)) > 0.95
        elif name == "near_dedup":
            named = [r for r in was if r[0] is not None]
            nameless = list(dict.fromkeys(t for i, t in was if i is None))
            full = named + [(10**6 + n, t) for n, t in enumerate(sorted(nameless, key=repr))]
            top = {i for i, _, c, k in groups(full, 5) if k}
            assert 0 < len(top) < len(full) and [r for r in pairs(docs) if r[0] is not None] == sorted(((i, t) for i, t in named if i in top), key=repr)
            assert sorted((t for i, t in pairs(docs) if i is None), key=repr) == sorted((t for i, t in full if i >= 10**6 and i in top), key=repr)
        elif name == "substring_dedup":
            want = [(i, t if len(k) == n else " ".join(k)) for (i, t), (_, n, k) in zip(was, removed(was), strict=True)]
            assert pairs(docs) == sorted(want, key=repr) and sum(a != b for a, b in zip(was, want, strict=True)) > 20
        else:
            lib, bins, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), defaultdict(list), []
            for i, t in was:
                ids = np.asarray([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
                assert len(ids) <= 1024
                want.append((i, 0, 0, len(ids), zlib.crc32(ids)))
            got = docs.collect()
            assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
            for r in got:
                bins[r.sequence_id].append((r.offset, r.length))
            for b in bins.values():
                b.sort()
                assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 1024
            assert len(bins) <= 1.06 * sum(r.length for r in got) / 1024 + 2


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, None), (2, ""), (2, ""), (None, " ")]])
def test_odd_tables(spark, tmp_path, rows):
    sf = stored(spark, tmp_path / "sf", rows, [])
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(((r.doc_id, r.length) for r in got), key=repr) == sorted(((i, 1 + (t == " ")) for i, t in rows), key=repr)


def test_other_results_outlive_a_run(spark, tmp_path):
    """A run deletes only what its own stages wrote."""
    sf = stored(spark, tmp_path / "sf", [(1, "one two three"), (2, "four")], [])
    lazy = weak_rules.judged(spark.read.parquet(f"{sf}/documents.parquet"))
    with storage.recorded() as paths:
        corpus_pipeline.run(spark, sf).count()
    left = [p for p in paths if spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
    assert lazy.count() == 2 and any("stage-packing" in p for p in left) and not any("signed" in p or "kmers" in p for p in left)


def test_scores_of_stages_are_those_of_the_queries(spark, tmp_path):
    rows, labels = corpus(3)
    sf = stored(spark, tmp_path / "sf", rows, labels)
    docs, told = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    toxic = toxicity.scored(docs, toxicity.fit(docs, told)).where("score < 0.5").select(F.nullif("doc_id", F.lit(2**63 - 1)).alias("doc_id"))
    assert sorted((r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf).select("doc_id").collect()), key=repr) == sorted((r.doc_id for r in toxic.collect()), key=repr)
    good = pu_quality.scored(docs, pu_quality.fit(docs, told)).where("score >= 0.7")
    assert corpus_pipeline.drop_low_quality(spark, docs, sf).count() == good.count()
