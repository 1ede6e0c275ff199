"""Vector best-fit packing of token documents into sequences.

A piece has three demands: tokens, one document, and attention cost (length
squared). Bins have a capacity of each. Pieces are taken longest first; each
goes to the feasible bin that the rule prefers: the largest weighted dot product
of demand and residual, or the smallest weighted residual norm after placing.

Only lengths decide, so the plan is made on the histogram of lengths (at most
`capacity` rows for any corpus): bins of equal residual form one class, and a
step places many pieces of one length into the bins of one class. Pieces then
find their place by their rank within their length, which per-task counts give
without gathering any length in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.llm import bytebpe
from pathloom.llm.common import arrow_map, ddl, keyed, settle, starts_of, text_slices, unkeyed

_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int64()), ("k", pa.int64())])
_PLACED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: only the first may be shorter than capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((a, capacity) for a in range(first, n, capacity))]


def plan(histogram: dict[int, int], capacity: int = 1024, documents: int | None = None, attention: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.01, 0.01)) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length its runs (first rank, first bin, offset, count), in order of rank.

    documents and attention are the other two capacities; None stands for the
    largest that `capacity` tokens can ask for. A piece whose attention cost
    alone is over the capacity cannot be placed and raises ValueError.
    """
    documents = documents or capacity
    attention = attention or capacity * capacity
    scale = np.asarray(weights) / np.asarray([capacity, documents, attention], float) ** (1 if rule == "dot" else 2)
    # Bin classes by (residual tokens, documents, attention): bin ranges (first, count).
    classes: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    states: list[tuple[int, int, int]] = []
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    bins = 0
    for length in sorted(histogram, reverse=True):
        left, rank, cost = histogram[length], 0, length * length
        if length > capacity or cost > attention:
            raise ValueError(f"a piece of {length} ids exceeds a bin")
        out = runs.setdefault(length, [])
        while left:
            feasible = [s for s in states[bisect.bisect_left(states, (length, 0, 0)) :] if s[1] >= 1 and s[2] >= cost]
            if feasible:
                r = np.asarray(feasible, float)
                demand = np.asarray([length, 1, cost], float)
                score = -(r * demand * scale / np.asarray([capacity, documents, attention])).sum(1) if rule == "dot" else (((r - demand) ** 2) * scale).sum(1)
                state = feasible[int(np.argmin(score))]
            else:  # new bins, one piece each
                per = max(1, min(capacity // length, documents, attention // cost)) if length else documents
                state = (capacity, documents, attention)
                fresh = -(-left // per)
                classes[state] = [(bins, fresh)]
                bisect.insort(states, state)
                bins += fresh
            ranges = classes[state]
            first, count = ranges.pop()
            take = min(count, left)
            if take < count:
                ranges.append((first + take, count - take))
            if not ranges:
                del classes[state]
                states.remove(state)
            out.append((rank, first, capacity - state[0], take))
            rank, left = rank + take, left - take
            after = (state[0] - length, state[1] - 1, state[2] - cost)
            if after not in classes:
                classes[after] = []
                bisect.insort(states, after)
            classes[after].append((first, take))
    return runs


def pieces_of(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and the place (task, k) of the piece among those of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task, seen = bytebpe.encoder(vocabulary), TaskContext.get().partitionId(), {}
        end = np.asarray([end_id], "<u4")
        for batch in batches:
            for part in text_slices(batch, limit=bytebpe.SLICE):
                ids, counts = bpe.encode(part.column("text"))
                bounds = starts_of(counts)
                rows = []
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    own = np.concatenate((ids[bounds[i] : bounds[i + 1]], end))
                    for p, (start, length) in enumerate(cut(len(own), capacity)):
                        k = seen.get(length, 0)
                        seen[length] = k + 1
                        rows.append((doc, p, start, length, zlib.crc32(own[start : start + length]), task, k))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=_PIECE)

    return keyed(docs).mapInArrow(run, ddl(_PIECE))


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, capacity: int = 1024, documents: int | None = None, attention: int | None = None, rule: str = "norm") -> DataFrame:
    """Each piece of each document with its sequence and offset.

    docs has columns doc_id and text; others are left aside. Null and empty texts
    are their end id alone. Texts of any length are encoded whole; documents of
    more than `capacity` ids are cut. Null ids stay null; repeated rows are packed
    each. An empty table gives an empty result.
    """
    pieces = settle(pieces_of(docs, vocabulary, end_id, capacity), "pieces")
    counts = pieces.groupBy("length", "task").agg((F.max("k") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = settle(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint")), "bases")
    runs = plan({r.length: r.n for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity, documents, attention, rule)  # at most `capacity` rows
    arrays = {length: tuple(np.asarray(x, np.int64) for x in zip(*r, strict=True)) for length, r in runs.items()}

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        length, rank = (batch.column(x).to_numpy() for x in ("length", "rank"))
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for own in np.unique(length):
            at = np.flatnonzero(length == own)
            first, bin_, place, _ = arrays[int(own)]
            run = np.searchsorted(first, rank[at], "right") - 1
            sequence[at] = bin_[run] + rank[at] - first[run]
            offset[at] = place[run]
        yield {x: batch.column(x) for x in _PLACED.names[:5]} | {"sequence_id": sequence, "offset": offset}

    ranked = pieces.join(bases.select("length", "task", "base"), ["length", "task"]).withColumn("rank", F.col("base") + F.col("k"))
    return arrow_map(ranked, _PLACED, step, None).select(unkeyed(), *_PLACED.names[1:])
