"""Substring deduplication by super-k-mer partitioning.

A window is 50 consecutive words. Its minimiser is the smallest hash of its
16-word grams, so equal windows have equal minimisers; consecutive windows of one
minimiser form a super-k-mer and travel as one packed string. Only super-k-mers
whose minimiser occurs in several documents leave their document. Equal strings
collapse before the shuffle; each bucket of minimisers sorts its windows by their
words, and every window learns the smallest doc_id that it starts in. Strings of a
minimiser with very many windows are partitioned again by minimisers of another
order, and these buckets are sorted alike. Texts come back to their windows by
string id, not by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import arrow_map, coded_words, ddl, keyed, light, partitions, settle, starts_of, text_slices, tokens_of, unkeyed, word_hashes

WINDOW, GRAM = 50, 16
#: Windows that a super-k-mer spans at most, and that one bucket sorts at once (more of one minimiser are partitioned again).
SPAN, BUCKET = 256, 10_000
_MINI = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("mini", pa.int64())])
_KMER = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("mini", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64()), ("packed", pa.binary())])
_VERDICT = pa.schema([("s0", pa.int64()), ("s1", pa.int64()), ("mins", pa.list_(pa.int64()))])
_PART = pa.schema([("s0", pa.int64()), ("s1", pa.int64()), ("at", pa.int64()), ("p0", pa.int64()), ("p1", pa.int64()), ("mini", pa.int64()), ("packed", pa.binary()), ("low", pa.int64())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def super_kmers(texts: pa.Array, window: int = WINDOW, gram: int = GRAM, span: int = SPAN, order: int = 0) -> tuple[np.ndarray, ...]:
    """(text, first word, windows, minimiser) of each super-k-mer of each text; each order of grams has minimisers of its own."""
    codes, counts, vocab = coded_words(texts)
    if len(codes) < window:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    grams = word_hashes(vocab)[codes]
    odd = np.uint64(0x9E3779B97F4A7C15)
    width = 1
    while width < gram:  # doubling: a gram is two overlapping shorter ones
        step = min(width, gram - width)
        grams = (grams[: len(grams) - step] ^ (grams[: len(grams) - step] >> np.uint64(29))) * odd + grams[step:]
        width += step
    low = grams ^ (grams >> np.uint64(32)) ^ np.uint64(order * 0xD6E8FEB86659FD93 % 2**64)
    low = low * odd
    reach, width = window - gram + 1, 1
    while width < reach:  # sliding minimum by doubling
        step = min(width, reach - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    bounds = starts_of(counts)
    doc = np.repeat(np.arange(len(counts)), counts)[: len(low)]
    at = np.flatnonzero(np.arange(len(low)) + window <= bounds[1:][doc])
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    value = low[at].view(np.int64)
    first = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])])
    size = np.diff(np.r_[first, len(at)])
    parts = -(-size // span)
    offset = np.arange(parts.sum()) - np.repeat(starts_of(parts)[:-1], parts)
    first, size = np.repeat(first, parts) + offset * span, np.minimum(np.repeat(size, parts) - offset * span, span)
    return doc[at[first]], at[first] - bounds[doc[at[first]]], size, value[first]


def _with_key(docs: DataFrame) -> DataFrame:
    """rk tells rows of one doc_id with different texts apart."""
    return keyed(docs).withColumn("rk", F.xxhash64("text"))


def covered(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, rk, windows): first words of the windows of each row that also start in a smaller doc_id."""
    spark, base = docs.sparkSession, _with_key(docs)

    def minis(batch: pa.RecordBatch) -> Iterator[dict]:
        doc, _, _, mini = super_kmers(batch.column("text"), window, gram)
        pair = np.unique(np.rec.fromarrays([doc, mini]))
        own = pa.array(pair.f0)
        yield {x: batch.column(x).take(own) for x in ("doc_id", "rk")} | {"mini": pair.f1}

    seen = settle(arrow_map(base, _MINI, minis), "minimisers")
    shared = seen.groupBy("mini").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("mini")
    wanted = seen.join(settle(shared, "shared"), "mini").groupBy("doc_id", "rk").agg(F.collect_set("mini").alias("minis"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        light()
        sent: set[bytes] = set()
        for batch in batches:
            for part in text_slices(batch):
                doc, pos, n, mini = super_kmers(part.column("text"), window, gram)
                lists = part.column("minis")
                owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                asked = np.rec.fromarrays([owner, lists.flatten().to_numpy(zero_copy_only=False)])
                keep = np.isin(np.rec.fromarrays([doc, mini]), asked)
                doc, pos, n, mini = (x[keep] for x in (doc, pos, n, mini))
                packed, ids, last, words = [], [], -1, []
                for d, p, k in zip(doc.tolist(), pos.tolist(), n.tolist(), strict=True):
                    if d != last:
                        last, words = d, tokens_of(part.column("text")[d].as_py())
                    text = b" ".join(words[p : p + k + window - 1])
                    digest = xxhash.xxh3_128_digest(text)
                    packed.append(None if digest in sent else text)
                    ids.append(digest)
                    sent.add(digest)
                if len(sent) > 200_000:
                    sent.clear()
                two = np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2)
                own = pa.array(doc)
                columns = [part.column("doc_id").take(own), part.column("rk").take(own), pos, n, mini, two[:, 0], two[:, 1], packed]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _KMER, strict=True)], schema=_KMER)

    asked = base.join(wanted, ["doc_id", "rk"]).select("doc_id", "rk", "text", "minis")
    kmers = settle(asked.mapInArrow(emit, ddl(_KMER)), "kmers")
    strings = kmers.groupBy("s0", "s1").agg(F.max("packed").alias("packed"), F.first("mini").alias("mini"), F.first("n").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    strings = settle(strings, "strings")
    weight = strings.groupBy("mini").agg(F.sum("n").alias("n"))
    hot = settle(weight.where(F.col("n") > BUCKET).select("mini"), "hot")
    total = strings.agg(F.sum("n")).first()[0] or 0
    buckets = max(4 * partitions(spark), -(-total // BUCKET))

    def sort_windows(table: pa.Table) -> pa.Table:
        low = table.column("low").to_numpy()
        lists = pa.array([x.split(b" ") for x in table.column("packed").to_pylist()], pa.list_(pa.binary()))
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32)
        n = sizes - window + 1
        owner = np.repeat(np.arange(len(n)), n)
        first = np.repeat(starts_of(sizes)[:-1] - starts_of(n)[:-1], n) + np.arange(n.sum())
        rows = np.lib.stride_tricks.sliding_window_view(codes, window)[first] if len(first) else np.zeros((0, window), np.int32)
        keys = np.ascontiguousarray(rows).view(np.dtype((np.void, 4 * window))).ravel()
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        group = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
        least = np.full(int(group[-1]) + 1 if len(group) else 0, 2**63 - 1)
        np.minimum.at(least, group, low[owner[order]])
        mins = np.empty(len(order), np.int64)
        mins[order] = least[group]
        lists = pa.ListArray.from_arrays(pa.array(starts_of(n), pa.int32()), pa.array(mins))
        return pa.table([table.column("s0"), table.column("s1"), lists], schema=_VERDICT)

    def again(batch: pa.RecordBatch) -> Iterator[dict]:
        """Parts of strings by minimisers of another order, of which equal windows have the same."""
        texts = batch.column("packed")
        own, pos, n, mini = super_kmers(texts.cast(pa.string()), window, gram, order=1)
        words, last, packed = [], -1, []
        for d, p, k in zip(own.tolist(), pos.tolist(), n.tolist(), strict=True):
            if d != last:
                last, words = d, texts[d].as_py().split(b" ")
            packed.append(b" ".join(words[p : p + k + window - 1]))
        at = pa.array(own)
        two = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, packed)), np.int64).reshape(-1, 2)
        yield {x: batch.column(x).take(at) for x in ("s0", "s1", "low")} | {"at": pos, "p0": two[:, 0], "p1": two[:, 1], "mini": mini ^ batch.column("mini").to_numpy()[own], "packed": packed}

    def sorted_(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.pmod(F.xxhash64("mini"), F.lit(buckets)).alias("bucket")).applyInArrow(sort_windows, ddl(_VERDICT))

    given = strings.select("s0", "s1", "mini", "packed", "low")
    plain = sorted_(given.join(hot, "mini", "left_anti"))
    # Strings that share a passage share its parts, which collapse as strings did.
    parts = settle(arrow_map(given.join(hot, "mini"), _PART, again, "packed"), "parts")
    once = parts.groupBy(F.col("p0").alias("s0"), F.col("p1").alias("s1")).agg(F.first("mini").alias("mini"), F.max("packed").alias("packed"), F.min("low").alias("low"))
    told = sorted_(once).select(F.col("s0").alias("p0"), F.col("s1").alias("p1"), "mins")
    whole = parts.select("s0", "s1", "at", "p0", "p1").join(told, ["p0", "p1"]).groupBy("s0", "s1").agg(F.sort_array(F.collect_list(F.struct("at", "mins"))).alias("x")).select("s0", "s1", F.flatten("x.mins").alias("mins"))
    verdicts = settle(plain.union(whole).join(strings.select("s0", "s1", "high"), ["s0", "s1"]).where(F.array_min("mins") < F.col("high")).drop("high"), "verdicts")
    hits = kmers.select("doc_id", "rk", "pos", "s0", "s1").join(verdicts, ["s0", "s1"])
    at = F.filter(F.transform("mins", lambda x, i: F.when(x < F.col("doc_id"), F.col("pos") + i)), lambda x: x.isNotNull())
    return hits.select("doc_id", "rk", at.alias("at")).where(F.size("at") > 0).groupBy("doc_id", "rk").agg(F.flatten(F.collect_list("at")).alias("windows"))


def kept_words(words: list[bytes], windows: np.ndarray, window: int = WINDOW) -> list[bytes]:
    """Words that no covered window holds."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, windows, 1)
    np.add.at(edge, windows + window, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def _windows_at(batch: pa.RecordBatch, i: int) -> np.ndarray | None:
    cell = batch.column("windows")[i]
    return cell.values.to_numpy(zero_copy_only=False) if cell.is_valid else None


def removal_digest(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words of every document.

    Columns doc_id and text are read, others left aside. Null and empty texts have no
    words; texts of any length count whole. Rows of one doc_id never remove each
    other's words; null ids sort last, so every other document wins over them.
    Repeated rows repeat in the result; an empty table gives an empty one.
    """

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        total, removed, digest = [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            words = tokens_of(text)
            at = _windows_at(batch, i)
            kept = words if at is None else kept_words(words, at, window)
            total.append(len(words))
            removed.append(len(words) - len(kept))
            digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield {"doc_id": batch.column("doc_id"), "n_words": total, "n_removed": removed, "kept_sha256": digest}

    rows = _with_key(docs).join(covered(docs, window, gram), ["doc_id", "rk"], "left").select("doc_id", "text", "windows")
    return arrow_map(rows, _DIGEST, step).select(unkeyed(), *_DIGEST.names[1:])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with repeated passages cut out of `text`; all columns, in their order and types.

    A text that loses nothing stays as it is; of others the kept words are joined
    by one space, and a column n_chars, where there is one, follows. Null and empty
    texts stay; null ids sort last; rows of one id never cut each other; repeated
    rows repeat; an empty table gives an empty result.
    """
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            fields = [pc.struct_field(row, i) for i in range(len(names))]
            texts = fields[names.index("text")].to_pylist()
            changed = {}
            for i in np.flatnonzero(batch.column("windows").is_valid().to_numpy(zero_copy_only=False)).tolist():
                changed[i] = b" ".join(kept_words(tokens_of(texts[i]), _windows_at(batch, i), window)).decode()
            if changed:
                texts = [changed.get(i, x) for i, x in enumerate(texts)]
                fields[names.index("text")] = pa.array(texts, fields[names.index("text")].type)
                if "n_chars" in names:
                    at = names.index("n_chars")
                    old = fields[at].to_pylist()
                    fields[at] = pa.array([len(changed[i]) if i in changed else x for i, x in enumerate(old)], fields[at].type)
            yield pa.RecordBatch.from_arrays(fields, names=names)

    rows = docs.select(F.struct(*(F.col(f"`{x}`") for x in names)).alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1)).alias("doc_id"), F.xxhash64("text").alias("rk"))
    return rows.join(covered(docs, window, gram), ["doc_id", "rk"], "left").select("row", "windows").mapInArrow(run, schema)


