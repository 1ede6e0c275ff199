"""Toxicity by nearest labelled examples.

Documents and labelled examples are TF-IDF vectors over all terms of the examples:
words, and the beginnings of longer ones. A term's weight is its IDF over the whole
corpus times how well it tells the classes of the examples apart, which never is
zero; a plain IDF finds half of the toxic texts (see the README). The examples lie in
an inverted index whose postings are cut in blocks, each with its largest weight; the
terms that many examples hold lie in a matrix, too, and one product with it, in single
precision, stands for their postings. A slice of documents bounds its cosines by both,
visits blocks by falling bound, all documents at a time, and a document stops when no
further block can reach its k-th neighbour. What single precision leaves in doubt is
summed again from the exact weights: exactly the nearest by cosine. Their votes,
weighted by distance and by class share, are calibrated on the examples themselves,
each left out in turn.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import arrow_map, coded_words, gather, heavy, keyed, learn_rows, light, settle, starts_of, text_slices

#: Documented bounds of the fit: labelled rows that the index may hold of each class (toxic, other), and bytes of their texts.
EXAMPLES, EXAMPLE_BYTES = (700, 1300), 50_000
NEIGHBOURS, BLOCK = 15, 64
#: Letters of the word beginnings that are terms besides whole words.
BEGINNINGS = (6,)
#: Weight of a term that tells nothing.
LEAST = 0.01
#: Terms that are held by at least this share of the examples, and how many of them at most, lie in a matrix besides the postings.
SHARE, OFTEN = 0.025, 1024
#: Documents whose cosines are found at a time, postings expanded at a time, and blocks that the terms of these documents meet (one document may meet more).
DOCS, POSTINGS, MEETINGS = 512, 1_000_000, 1_000_000
#: Learn from rows whose crc32(doc_id) mod FOLDS is not HELD.
FOLDS, HELD = 5, 0


def _spellings(vocab: pa.Array) -> list[pa.Array]:
    """The word and its beginnings, or null, of each spelling; beginnings are shorter than their word."""
    words = pc.replace_substring_regex(pc.utf8_lower(vocab), r"^\PL+|\PL+$", "")
    size = pc.utf8_length(words)
    null = pa.scalar(None, words.type)
    return [pc.if_else(pc.greater(size, 0), words, null), *(pc.if_else(pc.greater(size, k), pc.utf8_slice_codeunits(words, 0, k), null) for k in BEGINNINGS)]


#: Rows of (document, dimension, count), sorted, as arrays, and the number of documents.
Counts = tuple[np.ndarray, np.ndarray, np.ndarray, int]


@dataclass
class Index:
    """Examples in blocks of BLOCK; dimensions are the terms of each kind: words, then beginnings by length."""

    terms: list[pa.Array]
    weight: np.ndarray
    y: np.ndarray
    ids: np.ndarray
    #: Postings by dimension and example; their blocks by dimension, each with its largest weight and first posting.
    example: np.ndarray
    value: np.ndarray
    block: np.ndarray
    most: np.ndarray
    first: np.ndarray
    by_dim: np.ndarray
    odds: float = 1.0  # of toxic among all labels over that among the examples
    slope: float = 1.0
    shift: float = 0.0

    @property
    def blocks(self) -> int:
        return -(-max(1, len(self.y)) // BLOCK)

    def vectors(self, counts: Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bounds, dimension, weight) of unit vectors."""
        doc, dim, n, docs = counts
        weight = (1 + np.log(n)) * self.weight[dim]
        norm = np.sqrt(np.bincount(doc, weight * weight, minlength=docs))
        return starts_of(np.bincount(doc, minlength=docs)), dim, weight / np.where(norm > 0, norm, 1)[doc]

    def nearest(self, bounds: np.ndarray, dim: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(example, cosine), each (documents, k), best first; ties go to the earlier example.

        without: an example that each document may not have. A missing neighbour has cosine -1.
        """
        docs = len(bounds) - 1
        who, sims = np.zeros((docs, k), np.int64), np.full((docs, k), -1.0)
        met = starts_of(self.by_dim[dim + 1] - self.by_dim[dim])[bounds]
        b = 0
        while b < docs:
            a, most = b, int(np.searchsorted(met, met[b] + MEETINGS, side="right")) - 1
            b = min(max(a + 1, most), a + DOCS, docs)
            at = slice(bounds[a], bounds[b])
            who[a:b], sims[a:b] = self._nearest(bounds[a : b + 1] - bounds[a], dim[at], weight[at], k, None if without is None else without[a:b])
        return who, sims

    def _nearest(self, bounds: np.ndarray, dim: np.ndarray, weight: np.ndarray, k: int, without: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        docs, blocks, n = len(bounds) - 1, self.blocks, len(self.y)
        row, columns, single = self._often
        doc = np.repeat(np.arange(docs), np.diff(bounds))
        often = np.flatnonzero(row[dim] >= 0)
        own_row, own_weight, own = row[dim[often]], weight[often], starts_of(np.bincount(doc[often], minlength=docs))
        # Terms of many examples: all their products at once, in single precision; these bound the blocks, too.
        asks = np.zeros((docs, single.shape[1]), np.float32)
        asks[doc[often], own_row] = own_weight
        near = (asks @ single.T).reshape(docs, blocks, BLOCK)
        slack = 2 * (single.shape[1] + 4) * float(np.finfo(np.float32).eps) + 1e-9  # of two such sums of at most 1
        # The other terms of every document meet the blocks that hold them.
        few = np.flatnonzero(row[dim] < 0)
        sizes = self.by_dim[dim[few] + 1] - self.by_dim[dim[few]]
        entry = gather(self.by_dim[dim[few]], sizes)
        asked = np.repeat(weight[few], sizes)
        doc = np.repeat(doc[few], sizes)
        cell = doc * blocks + self.block[entry]
        bound = np.bincount(cell, asked * self.most[entry], minlength=docs * blocks).reshape(docs, blocks) + near.max(2)
        order = np.argsort(-bound, axis=1, kind="stable")
        falling = np.take_along_axis(bound, order, 1)
        rest, cosines = np.zeros((docs, blocks * BLOCK)), np.full((docs, blocks * BLOCK), -1.0)
        take, open_, done, step = min(k, blocks * BLOCK), np.arange(docs), 0, 2
        while done < blocks and len(open_):
            visit = np.zeros((docs, blocks), bool)
            visit[open_[:, None], order[open_, done : done + step]] = True
            self._add(rest, doc, asked, entry, np.flatnonzero(visit.ravel()[cell]))
            at = np.nonzero(visit)
            cosines.reshape(near.shape)[at] = rest.reshape(near.shape)[at] + near[at]
            cosines[:, n:] = -1
            if without is not None:
                cosines[np.arange(docs), without] = -1
            done, step = done + step, 2 * step
            if done < blocks:
                worst = -np.partition(-cosines[open_], take - 1, axis=1)[:, take - 1] if take == k else np.full(len(open_), -1.0)
                open_ = open_[falling[open_, done] >= worst - slack]
        # Whatever single precision leaves in doubt is told by the exact sums.
        worst = -np.partition(-cosines, take - 1, axis=1)[:, take - 1]
        likely = (cosines >= worst[:, None] - slack) & (cosines >= 0)
        idle = np.flatnonzero(worst <= slack)  # of the examples that share no term, the first k are enough
        likely[idle] &= (cosines[idle] > 0) | (np.cumsum(cosines[idle] == 0, axis=1) <= k)
        at, example = np.nonzero(likely)
        exact = np.round(rest[at, example] + _products(at, example, own, own_row, own_weight, columns), 12)
        best = np.lexsort((example, -exact, at))
        heads = starts_of(np.bincount(at, minlength=docs))
        rank = np.arange(len(best)) - heads[at]
        best, rank = best[rank < k], rank[rank < k]
        who, sims = np.zeros((docs, k), np.int64), np.full((docs, k), -1.0)
        who[at[best], rank], sims[at[best], rank] = example[best], exact[best]
        return who, sims

    @cached_property
    def _often(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The OFTEN terms of the most examples, each held by a share of SHARE at least: (row of each dimension or -1, weights by example and row, the same in single precision)."""
        held = np.diff(self.first[self.by_dim])
        most = np.argsort(-held, kind="stable")[:OFTEN]
        dims = np.sort(most[held[most] >= max(1, SHARE * len(self.y))])
        row = np.full(len(held), -1)
        row[dims] = np.arange(len(dims))
        columns = np.zeros((self.blocks * BLOCK, len(dims)))
        posting = gather(self.first[self.by_dim[dims]], held[dims])
        columns[self.example[posting], np.repeat(np.arange(len(dims)), held[dims])] = self.value[posting]
        return row, columns, columns.astype(np.float32)

    def _add(self, cosines: np.ndarray, doc: np.ndarray, asked: np.ndarray, entry: np.ndarray, chosen: np.ndarray) -> None:
        """The products of the chosen (document, term, block), POSTINGS at a time; a document's cosine adds up in order of terms."""
        width = cosines.shape[1]
        sizes = self.first[entry[chosen] + 1] - self.first[entry[chosen]]
        ends = np.cumsum(sizes)
        # Cut between documents, so that each cosine is one sum.
        heads = np.flatnonzero(np.r_[True, np.diff(doc[chosen]) > 0]) if len(chosen) else np.zeros(0, np.int64)
        before = np.r_[0, ends][heads]
        lots = np.flatnonzero(np.r_[True, np.diff(before // POSTINGS) > 0]) if len(heads) else heads
        cuts = [*heads[lots].tolist(), len(chosen)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = chosen[a:b]
            size = sizes[a:b]
            posting = gather(self.first[entry[own]], size)
            low, high = int(doc[own[0]]), int(doc[own[-1]]) + 1
            key = np.repeat((doc[own] - low) * width, size) + self.example[posting]
            got = np.bincount(key, np.repeat(asked[own], size) * self.value[posting], minlength=(high - low) * width).reshape(high - low, width)
            part = cosines[low:high]
            np.copyto(part, got, where=got > 0)

    def votes(self, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Log odds of toxic by weighted votes of neighbours that share a term; half a vote for either side."""
        who, sims = found
        w = np.where(sims > 0, 1 / (0.02 + 1 - np.minimum(sims, 1)), 0)
        y = self.y[who] if len(self.y) else np.zeros(who.shape)
        scale = np.maximum(w.sum(1), 1e-9)
        yes, no = (w * y).sum(1) / scale * self.odds, (w * (1 - y)).sum(1) / scale
        edge = 0.5 / NEIGHBOURS
        return np.log((yes + edge * self.odds) / (no + edge))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling of left-out votes x of examples labelled y, weighted to the labels' class shares."""
        if len(set(y.tolist())) < 2:
            self.slope, self.shift = 0.0, (2.0 if len(y) and y[0] else -2.0)
            return
        w = np.where(y == 1, self.odds, 1.0)
        t, p = y * 0.998 + 0.001, np.asarray([1.0, 0.0])
        a = np.stack([x, np.ones(len(x))], 1)
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(a @ p, -50, 50)))
            grad = a.T @ (w * (t - q)) - 1e-3 * p
            hess = (a * (w * q * (1 - q))[:, None]).T @ a + 1e-3 * np.eye(2)
            step = np.linalg.solve(hess, grad)
            p = p + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = float(p[0]), float(p[1])

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
        """Calibrated scores, and the ids of each text's nearest examples that share a term with it."""
        found = self.nearest(*self.vectors(term_counts(texts, self.terms)))
        score = 1 / (1 + np.exp(-np.clip(self.slope * self.votes(found) + self.shift, -50, 50)))
        return score, [self.ids[w[s > 0]] for w, s in zip(*found, strict=True)]


def _products(doc: np.ndarray, example: np.ndarray, bounds: np.ndarray, row: np.ndarray, weight: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """For each pair of a document and an example the sum over the document's terms (row, weight), in their order, POSTINGS at a time."""
    sizes = np.diff(bounds)[doc]
    before = starts_of(sizes)
    cuts = [*np.flatnonzero(np.diff(before[:-1] // POSTINGS, prepend=-1)).tolist(), len(doc)]
    sums = np.zeros(len(doc))
    for a, b in zip(cuts, cuts[1:], strict=False):
        term = gather(bounds[doc[a:b]], sizes[a:b])
        sums[a:b] = np.bincount(np.repeat(np.arange(b - a), sizes[a:b]), weight[term] * columns[np.repeat(example[a:b], sizes[a:b]), row[term]], minlength=b - a)
    return sums


def term_counts(texts: pa.Array, terms: list[pa.Array]) -> Counts:
    codes, sizes, vocab = coded_words(texts)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    bases = starts_of(np.asarray([len(x) for x in terms]))
    width, keys = max(1, int(bases[-1])), []
    for spelt, known, base in zip(_spellings(vocab), terms, bases.tolist(), strict=False):
        where = pc.index_in(spelt, value_set=known, skip_nulls=True).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
        own = np.flatnonzero(where >= 0)
        keys.append(doc[own] * width + where[own] + base)
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return key // width, key % width, n, len(sizes)


def _terms(texts: pa.Array) -> list[pa.Array]:
    """All words and beginnings of texts."""
    vocab = coded_words(texts)[2]
    return [pc.unique(x.drop_null()).sort() for x in _spellings(vocab)]


def build(terms: list[pa.Array], counts: Counts, y: np.ndarray, ids: np.ndarray, frequency: np.ndarray, corpus: int, odds: float = 1.0) -> Index:
    """The index of examples with these term counts and labels, and document frequencies of all terms in `corpus` documents."""
    doc, dim, n, _ = counts
    width = sum(map(len, terms))
    n1 = max(1, int(y.sum()))
    n0 = max(1, len(y) - int(y.sum()))
    toxic = np.bincount(dim[y[doc] == 1], minlength=width) / n1
    other = np.bincount(dim[y[doc] == 0], minlength=width) / n0
    mean = (toxic + other) / 2
    tells = np.abs(toxic - other) / np.sqrt(mean * (1 - mean) + 1e-3) + LEAST
    idf = np.log((1 + corpus) / (1 + frequency)) + 1
    none = np.zeros(0, np.int64)
    index = Index(terms, idf * tells, y, ids, none, none, none, none, none, none, odds)
    bounds, dim, weight = index.vectors(counts)
    # Examples whose heaviest terms are alike stand side by side, which makes blocks with tight bounds.
    top = np.full(len(y), -1)
    if len(dim):
        heavy_first = np.lexsort((dim, -weight, doc))
        full = np.flatnonzero(np.diff(bounds))
        top[full] = dim[heavy_first[bounds[full]]]
    place = np.empty(len(y), np.int64)
    order = np.lexsort((ids, top, y))
    place[order] = np.arange(len(y))
    index.y, index.ids = y[order], ids[order]
    example = place[doc]
    by = np.lexsort((example, dim))
    dim, example, weight = dim[by], example[by], weight[by]
    block = example // BLOCK
    first = np.flatnonzero(np.r_[True, (np.diff(dim) != 0) | (np.diff(block) != 0)]) if len(dim) else none
    index.example, index.value = example.astype(np.int32), weight
    index.block, index.first = block[first].astype(np.int32), np.r_[first, len(dim)]
    index.most = np.maximum.reduceat(weight, first) if len(first) else np.zeros(0)
    index.by_dim = np.searchsorted(dim[first], np.arange(width + 1))
    return index


def fit(docs: DataFrame, labelled: DataFrame) -> Index:
    """An index from labelled rows of docs outside the held-out fold.

    At most EXAMPLES rows of each class with texts of at most EXAMPLE_BYTES, by hash
    of their id, are indexed with all their terms; document frequencies are those of
    all of docs. Rows labelled twice count with each label; null ids and labels, and
    labels of no document, are left aside.
    """
    spark, base = docs.sparkSession, keyed(docs)
    rows = learn_rows(labelled, "toxic", FOLDS, HELD).where("doc_id is not null")
    totals = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    there = base.where(F.octet_length(F.coalesce("text", F.lit(""))) <= EXAMPLE_BYTES).select("doc_id")
    rows = rows.join(there, "doc_id", "left_semi")
    chosen = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, EXAMPLES[0]), (0, EXAMPLES[1]))]
    wanted = settle(chosen[0].unionAll(chosen[1]), "chosen")
    small = base.where(F.octet_length(F.coalesce("text", F.lit(""))) <= EXAMPLE_BYTES)
    examples = settle(small.join(F.broadcast(wanted), "doc_id").dropDuplicates(["doc_id", "y"]).repartition(16, "doc_id"), "examples")  # at most sum(EXAMPLES) ids, a text each
    table = examples.toArrow().combine_chunks()
    texts = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
    y, ids = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "doc_id"))
    terms = _terms(texts)
    width = sum(map(len, terms))
    shared = spark.sparkContext.broadcast(terms)  # bounded by EXAMPLES and EXAMPLE_BYTES

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        light()
        total = np.zeros(width + 1, np.int64)
        for batch in batches:
            for part in text_slices(batch):
                _, dim, _, n = term_counts(part.column("text"), shared.value)
                total[:width] += np.bincount(dim, minlength=width)
                total[width] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["dim", "n"])

    got = base.select("text").mapInArrow(frequencies, "dim bigint, n bigint").groupBy("dim").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the examples
    shared.unpersist()
    frequency = np.zeros(width + 1, np.int64)
    frequency[got.column("dim").to_numpy()] = got.column("n").to_numpy()
    n1, n0 = int(y.sum()), len(y) - int(y.sum())
    odds = (totals[1] / totals[0]) / (n1 / n0) if n1 and n0 else 1.0
    index = build(terms, term_counts(texts, terms), y, ids, frequency[:width], int(frequency[width]), odds)

    left, name = spark.sparkContext.broadcast(index), uuid.uuid4().hex

    def left_out(batch: pa.RecordBatch) -> Iterator[dict]:
        own = _here(left, name)
        at = {(i, label): k for k, (i, label) in enumerate(zip(own.ids.tolist(), own.y.tolist(), strict=True))}
        without = np.asarray([at[i, label] for i, label in zip(batch.column("doc_id").to_pylist(), batch.column("y").to_pylist(), strict=True)], np.int64)
        found = own.nearest(*own.vectors(term_counts(batch.column("text"), own.terms)), without=without)
        yield {"x": own.votes(found), "y": batch.column("y")}

    votes = arrow_map(examples, pa.schema([("x", pa.float64()), ("y", pa.int32())]), left_out, keeps=True).toArrow()  # at most sum(EXAMPLES) rows
    left.unpersist()
    order = np.lexsort((votes.column("x").to_numpy(), votes.column("y").to_numpy()))  # sums in one order whatever the tasks' order
    index.calibrate(votes.column("x").to_numpy()[order], votes.column("y").to_numpy()[order].astype(np.int64))
    return index


def _here(shared, name: str) -> Index:
    """The worker's own index, unpacked once."""
    return heavy(f"toxicity {name}", lambda: shared.value)


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("evidence", pa.list_(pa.int64()))])


def scored(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, score and evidence (ids of the nearest examples) of every document.

    Columns doc_id and text are read, others left aside. Null, empty and word-less
    texts, and texts that share no term with an example, have no neighbour and score
    as the labels' class share says. Repeated rows repeat; an empty table gives an
    empty result. Without labels of both classes the score is constant.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(index), uuid.uuid4().hex  # bounded by EXAMPLES and EXAMPLE_BYTES

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        score, evidence = _here(shared, name).score(batch.column("text"))
        yield {"doc_id": batch.column("doc_id"), "score": score, "evidence": evidence}

    return arrow_map(keyed(docs), _SCORED, step, keeps=True)


def without_toxic(docs: DataFrame, index: Index, threshold: float = 0.5) -> DataFrame:
    """Rows of docs that score below the threshold; all columns stay as they are.

    Null ids, repeated rows and null, empty or very long texts are judged as scored()
    does; an empty table gives an empty result. The text is read from column `text`.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(index), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                score, _ = _here(shared, name).score(part.column("text"))
                yield part.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
