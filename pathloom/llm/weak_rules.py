"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over
the counts of vote patterns (at most 3^rules rows for any corpus) estimates how
each rule votes on good and on bad documents; the posterior of good replaces
all-must-pass filtering.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import arrow_map, coded, coded_words, distinct, keyed, settle, unkeyed

RULES = ("symbols", "dup_lines", "repeats", "word_length", "capitals", "length", "exclaim", "sentences")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = pa.schema([("doc_id", pa.int64()), *((x, pa.int64()) for x in _COUNTS), ("n_lines", pa.int64()), ("n_capitals", pa.int64()), ("n_exclaims", pa.int64()), ("n_stops", pa.int64())])
SYMBOLS = "[#*$%&|<>]"


def repeated_words(codes: np.ndarray, counts: np.ndarray, n_codes: int) -> np.ndarray:
    """Words of each document in three-word windows that it holds twice or more."""
    doc = np.repeat(np.arange(len(counts)), counts)
    if len(codes) < 3:
        return np.zeros(len(counts), np.int64)
    a, b, c = (codes[i : len(codes) - 2 + i].astype(np.int64) for i in range(3))
    inside = doc[:-2] == doc[2:]
    if n_codes < 1 << 21:
        key = a << 42 | b << 21 | c
    else:
        pair = np.unique(a * n_codes + b, return_inverse=True)[1]
        key = np.unique(pair * n_codes + c, return_inverse=True)[1]
    at = np.flatnonzero(inside)
    order = at[np.lexsort((key[at], doc[at]))]
    same = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    twice = np.r_[False, same] | np.r_[same, False] if len(order) else np.zeros(0, bool)
    marked = np.zeros(len(codes), bool)
    hit = order[twice]
    for i in range(3):
        marked[hit + i] = True
    return np.bincount(doc[marked], minlength=len(counts))


def line_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines that hold a word, and those of them that equal an earlier line, of each text."""
    codes, counts, vocab = coded(pc.split_pattern(texts.fill_null(""), "\n"))
    worded = pc.match_substring_regex(vocab, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(counts)), counts)
    keep = worded[codes]
    key = distinct(doc[keep].astype(np.int64) * max(1, len(vocab)) + codes[keep])
    lines = np.bincount(doc[keep], minlength=len(counts))
    return lines, lines - np.bincount(key // max(1, len(vocab)), minlength=len(counts))


def measure(texts: pa.Array, words: tuple[np.ndarray, np.ndarray, pa.Array] | None = None) -> dict[str, np.ndarray]:
    """The counts of each whole text; a null has no words. words: coded_words(texts), where it is at hand."""
    codes, counts, vocab = words or coded_words(texts)
    doc = np.repeat(np.arange(len(counts)), counts)

    def total(values) -> np.ndarray:
        each = values.to_numpy(zero_copy_only=False).astype(np.int64)
        return np.bincount(doc, each[codes], minlength=len(counts)).astype(np.int64)

    lines, dups = line_counts(texts)
    letters = pc.utf8_length(pc.replace_substring_regex(vocab, r"\PL", ""))
    capitals = pc.and_(pc.greater(letters, 1), pc.equal(pc.utf8_upper(vocab), vocab))
    return {
        "n_words": counts,
        "word_chars": total(pc.utf8_length(vocab)),
        "n_symbols": total(pc.count_substring_regex(vocab, SYMBOLS)),
        "n_dup_lines": dups,
        "n_repeat_words": repeated_words(codes, counts, len(vocab)),
        "n_lines": lines,
        "n_capitals": total(capitals),
        "n_exclaims": total(pc.match_substring(vocab, "!!")),
        "n_stops": total(pc.match_substring_regex(vocab, r"[.?!。？！]$")),
    }


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every document."""

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"doc_id": batch.column("doc_id")} | measure(batch.column("text"))

    return arrow_map(keyed(docs), _SCHEMA, step)


def votes() -> dict[str, F.Column]:
    """Each rule's vote as a column over measured()."""
    n = F.col("n_words")

    def share(part: str, bad: int, good: int, whole=n):
        """Bad above `bad` hundredths of the whole, good up to `good`."""
        return F.when(whole == 0, 0).when(100 * F.col(part) > bad * whole, -1).when(100 * F.col(part) <= good * whole, 1).otherwise(0)

    chars = F.col("word_chars")
    return {
        "symbols": share("n_symbols", 15, 4),
        "dup_lines": F.when(F.col("n_lines") < 3, 0).otherwise(share("n_dup_lines", 30, 5, F.col("n_lines"))),
        "repeats": share("n_repeat_words", 30, 10),
        "word_length": F.when(n == 0, 0).when((chars > 14 * n) | (chars < 2 * n), -1).when((chars >= 3 * n) & (chars <= 9 * n), 1).otherwise(0),
        "capitals": share("n_capitals", 30, 6),
        "length": F.when(n < 20, -1).when(n >= 100, 1).otherwise(0),
        "exclaim": share("n_exclaims", 20, 2),
        "sentences": F.when(n < 50, 0).when(100 * F.col("n_stops") >= n, 1).when(F.col("n_stops") == 0, -1).otherwise(0),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, prior: float = 0.8, strength: float = 2.0) -> dict[tuple[int, ...], float]:
    """Posterior of good by vote pattern.

    Starts from rules that are right three times of four where they vote, with
    Dirichlet counts of that shape (`strength`), which also break the symmetry
    between good and bad.
    """
    if not patterns:
        return {}
    v = np.asarray([p for p, _ in patterns]) + 1  # 0 bad, 1 abstain, 2 good
    w = np.asarray([c for _, c in patterns], float)
    hot = np.eye(3)[v]  # patterns, rules, vote
    belief = np.stack([np.asarray([0.6, 0.2, 0.2]), np.asarray([0.2, 0.2, 0.6])])  # class bad, good
    table = np.repeat(belief[:, None, :], v.shape[1], axis=1)
    post = np.zeros(len(w))
    for _ in range(rounds):
        logs = np.einsum("prv,crv->pc", hot, np.log(table)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))
        if np.abs(new - post).max() < 1e-10:
            break
        post = new
        mass = np.stack([w * (1 - post), w * post])
        table = np.einsum("cp,prv->crv", mass, hot) + strength * belief[:, None, :]
        table /= table.sum(2, keepdims=True)
        prior = float(np.clip((mass[1].sum() + 4) / (w.sum() + 5), 1e-3, 1 - 1e-3))
    return {p: float(x) for (p, _), x in zip(patterns, post, strict=True)}


def judged(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, counts, base_failed, posterior and kept of every document.

    Null and empty texts have no words: they fail the base rules. Repeated rows
    are judged each; null ids stay null, texts of any length count whole, an empty
    table gives an empty result; other columns are left aside.
    """
    rows = settle(measured(docs).select("*", *(v.cast("int").alias(f"v_{k}") for k, v in votes().items())), "rules")
    code = sum(((F.col(f"v_{k}") + 1) * 3**i for i, k in enumerate(RULES)), F.lit(0)).cast("int")
    rows = rows.withColumn("pattern", code)
    seen = rows.groupBy("pattern").count().collect()  # at most 3^8 rows
    post = estimate([(tuple(r.pattern // 3**i % 3 - 1 for i in range(len(RULES))), r["count"]) for r in sorted(seen)])
    table = [(sum((x + 1) * 3**i for i, x in enumerate(p)), y) for p, y in post.items()]
    verdicts = docs.sparkSession.createDataFrame(table, "pattern int, posterior double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.join(F.broadcast(verdicts), "pattern", "left").select(unkeyed(), *_COUNTS, failed.alias("base_failed"), (~failed & (F.col("posterior") >= threshold)).alias("kept"), "posterior")


