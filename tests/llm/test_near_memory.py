"""Bounds of what workers hold and of what is written while near duplicates are found."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pathloom import storage
from pathloom.llm import minhash
from tests.llm.test_documents import groups


def _block(n: int, size: int, changed: int):
    """A block whose members have `size` hashes, up to `changed` of them their own; a quarter stands in both roles."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, size, dtype=np.uint64)
    sets = [np.unique(np.r_[base[: size - k], rng.integers(0, 2**64, k, dtype=np.uint64)]) for k in rng.integers(0, changed, n)]
    fine = minhash.odd_sketches(minhash.minhashes(sets, minhash.FINE_SAMPLES), minhash.FINE_BITS)
    rows = [(i, i, role, 7, fine[i].tobytes(), sets[i].tobytes()) for i in range(n) for role in ((0, 1) if 4 * i < n else (1,))]
    return sets, pa.table(dict(zip(("rep", "component", "role", "block", "fine", "shingles"), zip(*rows, strict=True), strict=True)))


def test_forest_holds_no_second_copy_of_long_sets():
    """Sets of long documents are read where they lie: at most half as much is taken besides."""
    sets, table = _block(160, 40_000, 12_000)
    raw = table.column("shingles").nbytes
    tracemalloc.start()
    found = minhash._forest(table, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert raw > 60_000_000 and peak < raw / 2
    root = list(range(len(sets)))

    def join(links):
        own = list(root)
        for a, b in links:
            x, y = own[a], own[b]
            own = [x if r == y else r for r in own]
        return Counter(frozenset(i for i in root if own[i] == r) for r in set(own))

    alike = [(i, j) for i in range(40) for j in range(160) if i != j and 100 * (both := len(np.intersect1d(sets[i], sets[j], assume_unique=True))) >= 80 * (len(sets[i]) + len(sets[j]) - both)]
    assert len(alike) > 1000 and join(found) == join(alike)


def test_large_blocks_are_cut(spark, monkeypatch):
    """Parts of a block hold a bounded number of bytes, and who met before meets in one of them."""
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 40_000)
    rng = random.Random(1)
    rows = [(rep, role, block, rng.randint(500, 1500)) for block, (few, all_) in enumerate([(30, 200), (3, 10), (200, 2), (0, 300), (300, 0)]) for role, n in ((0, few), (1, all_)) for rep in range(1000 * role, 1000 * role + n)]
    whole = spark.createDataFrame(rows, "rep bigint, role int, block bigint, bytes bigint")
    cut = minhash._cut(whole).toPandas()
    met = lambda x: Counter((a, b) for _, part in x.groupby("block") for a in part.rep[part.role == 0] for b in part.rep[part.role == 1])
    assert met(cut) == met(whole.toPandas())
    both = {b for b, part in cut.groupby("block") if part.role.nunique() == 2}
    held = cut[cut.block.isin(both)].groupby("block").bytes.sum()
    assert len(both) > 10 and held.max() < 2 * 40_000


def test_near_groups_with_cut_blocks(spark, monkeypatch):
    """Cut blocks give the same groups, and small sets of links are united without being written anew."""
    rng = random.Random(3)
    base = [str(rng.random()) for _ in range(90)]
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 7)):
            t[rng.randrange(90)] = str(rng.random())
        rows.append((i, " ".join(t)))
    parts = []
    cut = minhash._cut
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 3_000)
    monkeypatch.setattr(minhash, "_cut", lambda left: parts.append((left.select("block").distinct().count(), (out := cut(left)).select("block").distinct().count())) or out)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    with storage.recorded() as paths:
        got = minhash.near_groups(docs, size=4)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == groups(rows)
    assert parts and parts[0][1] > parts[0][0]
    assert not [p for p in paths if "pathloom-edges" in p]
    for path in paths:
        storage.delete(spark, path)


def test_bytes_of_full_sets(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a"), (3, " "), (4, "a b c d " * 400)], "doc_id bigint, text string")
    told = {r.rep: r.bytes for r in minhash.fine_sketches(docs, 4).collect()}
    assert told == {r.rep: r.n for r in minhash.full_sets(docs, 4).select("rep", F.octet_length("shingles").alias("n")).where("n > 0").collect()}
