"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network under the
non-negative unbiased risk: the loss of negatives is what unlabelled text shows
beyond the share of positives in it, and is never let below zero. That share,
the class prior, is estimated first: a plain classifier of positives against
unlabelled text ranks both, and the prior is the smallest ratio of the upper
tails of unlabelled and positive scores, with a bound for their chance.

A text's features are shares of marks, lines and repeats, and its words: how much
commoner its hashed words are among the trusted positives than in the whole corpus,
which one pass counts. A trusted positive is measured without its own counts, as a
text that the classifier has not seen.

All unlabelled text counts: its features are dealt over tasks of one barrier
stage, which add up their gradients and tails in each round and keep equal
networks.
"""

from __future__ import annotations

import pickle
import socket
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from multiprocessing.connection import Client, Connection, Listener

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import BarrierTaskContext, SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import arrow_map, coded_words, distinct, keyed, learn_rows, light, settle, starts_of, text_slices
from pathloom.llm.weak_rules import measure

#: Trusted positives that the fit takes, chosen by hash of their id: its documented bound. Unlabelled text has none.
SAMPLE = 6000
#: Rows whose gradients are taken at a time.
CHUNK = 8192
HIDDEN, ROUNDS, RATE = 12, 600, 0.02
FOLDS, HELD = 4, 2
THRESHOLD = 0.7
FEATURES = ("symbols", "dup_lines", "repeats", "capitals", "exclaims", "sentences", "word_length", "log_words", "log_lines", "word_evidence", "unlike_words")
#: Buckets of hashed words, as a power of two, and deviations from which a word's count tells something.
BITS, CHANCE = 16, 4


@dataclass
class Evidence:
    """Documents that hold a word of each bucket: trusted positives, and all."""

    positive: np.ndarray
    every: np.ndarray
    positives: int
    documents: int


_LETTER = np.random.default_rng(16).integers(0, 2**64, 256, np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_buckets(vocab: pa.Array) -> np.ndarray:
    """A bucket of each string: a polynomial of its bytes, which needs no loop over strings."""
    sizes = pc.binary_length(vocab).to_numpy(zero_copy_only=False).astype(np.int64)
    at = starts_of(sizes)
    data = np.frombuffer(b"".join(vocab.cast(pa.binary()).to_pylist()), np.uint8)
    power = np.cumprod(np.full(max(1, int(sizes.max(initial=0))), _ODD))
    place = np.arange(len(data)) - np.repeat(at[:-1], sizes)
    total = np.zeros(len(sizes), np.uint64)
    some = sizes > 0
    if some.any():
        total[some] = np.add.reduceat(_LETTER[data] * power[place], at[:-1][some])
    total = (total ^ (total >> np.uint64(32))) * _ODD
    return (total >> np.uint64(64 - BITS)).astype(np.int64)


def buckets(words: tuple[np.ndarray, np.ndarray, pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of the distinct words of each document, lower case."""
    codes, counts, vocab = words
    own = word_buckets(pc.utf8_lower(vocab))
    key = distinct(np.repeat(np.arange(len(counts)), counts) << BITS | own[codes])
    return key >> BITS, key & (1 << BITS) - 1


def word_features(words: tuple[np.ndarray, np.ndarray, pa.Array], evidence: Evidence, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean log ratio of a text's words among positives to what the corpus lets expect, and the share of words that are far rarer there.

    A word whose count chance explains (CHANCE deviations) tells nothing, so that rare
    words add no noise. own: which texts are trusted positives themselves; their own
    counts are left out.
    """
    n = len(words[1])
    doc, bucket = buckets(words)
    less = np.zeros(n, np.int64) if own is None else own.astype(np.int64)
    seen = evidence.positive[bucket] - less[doc]
    hoped = (evidence.positives - less[doc]) * (evidence.every[bucket] + 1) / (evidence.documents + 2)
    ratio = np.where(np.abs(seen - hoped) > CHANCE * np.sqrt(hoped + 1), np.log((seen + 1) / (hoped + 1)), 0)
    sizes = np.maximum(np.bincount(doc, minlength=n), 1)
    return np.clip(np.bincount(doc, ratio, minlength=n) / sizes, -3, 3), np.bincount(doc, ratio < -1, minlength=n) / sizes


def features(texts: pa.Array, evidence: Evidence | None = None, own: np.ndarray | None = None) -> np.ndarray:
    """One row of FEATURES for each whole text; a null has no words, and without evidence words tell nothing."""
    words = coded_words(texts)
    m = {k: v.astype(float) for k, v in measure(texts, words).items()}
    n = np.maximum(m["n_words"], 1)
    lines = np.maximum(m["n_lines"], 1)
    told = (np.zeros(len(n)), np.zeros(len(n))) if evidence is None else word_features(words, evidence, own)
    return np.stack([
        np.minimum(m["n_symbols"] / n, 2), m["n_dup_lines"] / lines, m["n_repeat_words"] / n, m["n_capitals"] / n, m["n_exclaims"] / n,
        np.minimum(m["n_stops"] / n, 0.5), np.minimum(m["word_chars"] / n, 20) / 10, np.log1p(m["n_words"]) / 10, np.log1p(m["n_lines"]) / 10, *told,
    ], axis=1)


@dataclass
class Network:
    """Standardised features, one tanh layer, one logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    prior: float
    evidence: Evidence | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def score(self, texts: pa.Array) -> np.ndarray:
        return _sigmoid(self.logits(features(texts, self.evidence)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _start(mean: np.ndarray, scale: np.ndarray, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    return Network(mean, scale, rng.normal(0, 0.6, (len(mean), HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1), 0.5)


#: Adds up an array over all tasks; one process alone has its own.
Total = Callable[[np.ndarray], np.ndarray]


def _moments(parts: list[np.ndarray], total: Total) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale over the parts of all tasks."""
    width = parts[0].shape[1]
    got = total(np.r_[sum(len(p) for p in parts), sum((p.sum(0) for p in parts), np.zeros(width))])
    mean = got[1:] / got[0]
    return mean, np.sqrt(total(sum((((p - mean) ** 2).sum(0) for p in parts), np.zeros(width))) / got[0]) + 1e-3


def _descend(net: Network, positive: np.ndarray, unlabelled: np.ndarray, slopes, mix, total: Total, rounds: int) -> Network:
    """Adam. slopes(is positive, logits) gives columns of gradients and of losses of rows; mix turns their sums over all tasks into one gradient."""
    parts = [((x[i : i + CHUNK] - net.mean) / net.scale, own) for own, x in ((True, positive), (False, unlabelled)) for i in range(0, len(x), CHUNK)]
    params = [net.w1, net.b1, net.w2, net.b2]
    shapes = [p.shape for p in params]
    ends = np.cumsum([p.size for p in params])
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, rounds + 1):
        sums = np.zeros((2, 2, ends[-1] + 1))  # kind, gradient, numbers and the loss
        for z, own in parts:
            h = np.tanh(z @ params[0] + params[1])
            grads, loss = slopes(own, h @ params[2] + params[3][0])
            sums[int(own), 0, -1] += loss.sum()
            for j, g in enumerate(grads):
                back = np.outer(g, params[2]) * (1 - h * h)
                sums[int(own), j, :-1] += np.concatenate([(z.T @ back).ravel(), back.sum(0), h.T @ g, [g.sum()]])
        flat = mix(total(sums))
        grads = [x.reshape(shape) for x, shape in zip(np.split(flat, ends[:-1]), shapes, strict=True)]
        for i in (0, 2):
            grads[i] = grads[i] + 1e-4 * params[i]
        for i, d in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * d
            second[i] = 0.999 * second[i] + 0.001 * d * d
            params[i] = params[i] - RATE * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return Network(net.mean, net.scale, *params, net.prior)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, total: Total = lambda x: x, every: np.ndarray | None = None) -> float:
    """Share of positives in unlabelled text from scores of both: the smallest ratio of upper tails.

    With total, the arrays are a task's own and `every` has the positive scores of all.
    """
    every = positive if every is None else every
    sizes = total(np.asarray([len(positive), len(unlabelled)], float))
    if not sizes.all():
        return 0.5
    cuts = np.unique(np.quantile(every, np.linspace(0, 0.99, 100)))
    tails = total(np.stack([len(x) - np.searchsorted(np.sort(x), cuts) for x in (positive, unlabelled)]).astype(float))
    p, u = tails[0] / sizes[0], tails[1] / sizes[1]
    slack = np.sqrt(np.log(4 / delta) / (2 * sizes[1])) + np.sqrt(np.log(4 / delta) / (2 * sizes[0]))
    ok = p > 0
    best = np.argmin((u[ok] + slack) / p[ok])
    return float(np.clip(u[ok][best] / p[ok][best], 0.05, 0.98))


def _unseen_scores(positive: tuple[np.ndarray, np.ndarray], unlabelled: tuple[np.ndarray, np.ndarray], total: Total, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of both, each (rows, half), by a plain classifier of the other half, so that the tails are not those of rows it learned by heart."""
    out = np.zeros(len(positive[0])), np.zeros(len(unlabelled[0]))
    for flip in (False, True):
        p, u = (x[half ^ flip] for x, half in (positive, unlabelled))
        n = total(np.asarray([len(p), len(u)], float))
        if not n.all():
            continue

        def slopes(own: bool, z: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
            return [_sigmoid(z) - own], np.zeros(0)

        def mix(sums: np.ndarray, n=n) -> np.ndarray:
            return 0.5 / n[0] * sums[1, 0, :-1] + 0.5 / n[1] * sums[0, 0, :-1]

        plain = _descend(_start(*_moments([p, u], total)), p, u, slopes, mix, total, rounds)
        for scores, (rows, half) in zip(out, (positive, unlabelled), strict=True):
            scores[~(half ^ flip)] = plain.logits(rows[~(half ^ flip)])
    return out


def _keep_all() -> Network:
    """Where there is nothing to learn from every text scores 1."""
    net = _start(np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    net.w2[:], net.b2[:] = 0, 40
    return net


def risk_slopes(prior: float, positives: float, unlabelled: float):
    """The functions of _descend() for the non-negative risk: prior * R(positive as 1) + max(0, R(unlabelled as 0) - prior * R(positive as 0))."""

    def slopes(own: bool, z: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        s = _sigmoid(z)
        return [s, np.ones_like(s)] if own else [s], np.logaddexp(0, z)  # logistic loss as a negative

    def mix(sums: np.ndarray) -> np.ndarray:
        own, other = sums[1, 0] * prior / positives, sums[0, 0] / unlabelled
        if other[-1] - own[-1] >= 0:
            return (other - sums[1, 1] * prior / positives)[:-1]
        return (own - other)[:-1]  # the negatives' risk is over-fitted: climb back

    return slopes, mix


def train(positive: tuple[np.ndarray, np.ndarray], unlabelled: tuple[np.ndarray, np.ndarray], total: Total = lambda x: x, gather: Total = lambda x: x, rounds: int = ROUNDS) -> Network:
    """The network of least non-negative risk; without rows of either kind it keeps every text.

    Both are (rows, half) of this task; total adds up, and gather joins, arrays of all tasks.
    """
    np_, nu = total(np.asarray([len(positive[0]), len(unlabelled[0])], float))
    if not np_ or not nu:
        return _keep_all()
    seen = _unseen_scores(positive, unlabelled, total, rounds // 4)
    prior = class_prior(*seen, total=total, every=gather(seen[0]))

    slopes, mix = risk_slopes(prior, np_, nu)
    net = _descend(_start(*_moments([positive[0], unlabelled[0]], total)), positive[0], unlabelled[0], slopes, mix, total, rounds)
    net.prior = prior
    return net


def _slots(sc: SparkContext) -> int:
    """Tasks that a barrier stage may have."""
    jsc = sc._jsc.sc()
    return max(1, min(sc.defaultParallelism, jsc.maxNumConcurrentTasks(jsc.resourceProfileManager().defaultResourceProfile())))


def _exchange(task: BarrierTaskContext, secret: bytes) -> Callable[..., np.ndarray]:
    """A function that joins the flat arrays of all tasks, in order of tasks, for each of them; by way of task 0, as Spark's own gathering takes a second."""
    me, infos = task.partitionId(), task.getTaskInfos()
    server = Listener(("", 0), backlog=len(infos), authkey=secret) if me == 0 else None
    port = task.allGather(str(server.address[1]) if server else "")[0]
    peers: dict[int, Connection] = {}
    if server:
        for _ in infos[1:]:
            peer = server.accept()
            peers[peer.recv()] = peer
        server.close()
    else:
        peers[0] = Client((infos[0].address.rsplit(":", 1)[0], int(port)), authkey=secret)
        peers[0].send(me)

    for peer in peers.values():  # small messages go out at once
        with socket.fromfd(peer.fileno(), socket.AF_INET, socket.SOCK_STREAM) as s:
            s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def every(own: np.ndarray, join: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
        own = np.ascontiguousarray(own, float).ravel()
        if me:
            peers[0].send(own)
            return peers[0].recv()
        out = join([own, *(peers[i].recv() for i in range(1, len(infos)))])
        for peer in peers.values():
            peer.send(out)
        return out

    return every


def gather_evidence(docs: DataFrame, trusted: list[int]) -> Evidence:
    """Document counts of word buckets over all of docs (keyed), and over rows of the trusted ids."""
    ids = np.asarray(trusted, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        light()
        seen, rows = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for part in text_slices(batch):
                own = np.isin(part.column("doc_id").to_numpy(), ids)
                doc, bucket = buckets(coded_words(part.column("text")))
                seen[0] += np.bincount(bucket[own[doc]], minlength=1 << BITS)
                seen[1] += np.bincount(bucket, minlength=1 << BITS)
                rows += [own.sum(), len(own)]
        some = np.flatnonzero(seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some]), *(pa.array(np.r_[rows[i], seen[i][some]]) for i in (0, 1))], ["bucket", "p", "n"])

    got = docs.mapInArrow(run, "bucket bigint, p bigint, n bigint").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).toArrow()  # a row for each bucket
    at, p, n = (got.column(c).to_numpy() for c in ("bucket", "p", "n"))
    counts = np.zeros((2, (1 << BITS) + 1))
    counts[0, at], counts[1, at] = p, n  # bucket -1, the last place, has the rows
    return Evidence(counts[0, :-1], counts[1, :-1], int(counts[0, -1]), int(counts[1, -1]))


def fit(docs: DataFrame, labelled: DataFrame, sample: int | None = None) -> Network:
    """Trusted positives are rows labelled 1 outside the held-out fold; unlabelled are all rows of docs without a label.

    At most `sample` (SAMPLE) trusted positives are taken, by hash of their id. Null
    ids are unlabelled; repeated rows count each; labels of no document, and labels 0,
    only keep their rows out of the unlabelled ones. Without rows of either kind, as
    in an empty table, the network keeps every text.
    """
    spark = docs.sparkSession
    trusted = learn_rows(labelled, "quality", FOLDS, HELD).where("y = 1 and doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample or SAMPLE).select(F.col("doc_id").alias("m"))
    ids = sorted(r.m for r in trusted.collect())
    marked = labelled.select(F.col("doc_id").alias("m")).where("m is not null").distinct()
    shape = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])
    evidence = gather_evidence(keyed(docs), ids)
    shared, known = spark.sparkContext.broadcast(evidence), np.asarray(ids, np.int64)  # two numbers a bucket

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"doc_id": batch.column("doc_id"), "x": list(features(batch.column("text"), shared.value, np.isin(batch.column("doc_id").to_numpy(), known)))}

    trusted = spark.createDataFrame([(i,) for i in ids], "m bigint")
    marks = marked.join(trusted.withColumn("y", F.lit(1)), "m", "left").select("m", F.coalesce("y", F.lit(-1)).alias("y"))
    measured = settle(arrow_map(keyed(docs), shape, step), "features")
    rows = measured.join(marks, F.col("doc_id") == F.col("m"), "left").select(F.coalesce("y", F.lit(0)).alias("y"), (F.xxhash64("doc_id") % 2 == 0).alias("half"), "x").where("y >= 0")

    secret = uuid.uuid4().bytes

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                table = np.column_stack([b.column("y").to_numpy(), b.column("half").to_numpy(zero_copy_only=False), b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)])
                yield pa.RecordBatch.from_arrays([pa.array([table.astype(float).tobytes()], pa.binary())], ["rows"])

    def run(packed: Iterator) -> Iterator[bytes]:
        light()
        table = np.concatenate([np.zeros((0, 2 + len(FEATURES))), *(np.frombuffer(r.rows).reshape(-1, 2 + len(FEATURES)) for r in packed)])
        y, half, x = table[:, 0], table[:, 1] == 1, table[:, 2:]
        task = BarrierTaskContext.get()
        every = _exchange(task, secret)
        net = train((x[y == 1], half[y == 1]), (x[y == 0], half[y == 0]), lambda v: every(v, sum).reshape(np.shape(v)), lambda v: every(v, np.concatenate))
        if task.partitionId() == 0:
            yield pickle.dumps(net)

    # Tasks without rows must take part in the rounds too, which only RDDs see to.
    found = rows.repartition(_slots(spark.sparkContext)).mapInArrow(pack, "rows binary").rdd.barrier().mapPartitions(run).collect()  # one network
    net = pickle.loads(found[0]) if found else _keep_all()  # an empty plan has no tasks
    net.evidence = evidence
    return net


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of every document.

    Columns doc_id and text are read. Null and empty texts are scored as texts
    without words; texts of any length count whole; repeated rows repeat; an empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # numbers of a network, and two of each bucket

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"doc_id": batch.column("doc_id"), "score": shared.value.score(batch.column("text"))}

    return arrow_map(keyed(docs), _SCORED, step)


def with_quality(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs that score the threshold or more; all columns stay as they are.

    Null ids, repeated rows and null, empty or very long texts are judged as scored()
    does; an empty table gives an empty result. The text is read from column `text`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        light()
        for batch in batches:
            for part in text_slices(batch):
                yield part.filter(pa.array(shared.value.score(part.column("text")) >= threshold))

    return docs.mapInArrow(run, docs.schema)
