"""The registered queries opN_<name>: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import audio, frames, licenses, minhash, packing, pu_quality, sentpiece, substring, toxicity, weak_rules
from pathloom.llm.common import documents, held_out, labels, unkeyed

def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(documents(spark, sf_dir), size=4)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digest(documents(spark, sf_dir))


def op3_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.text_media(documents(spark, sf_dir))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.token_index(documents(spark, sf_dir))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentpiece.piece_digest(documents(spark, sf_dir))


def _judged(scores: DataFrame, folds: int, held: int, threshold: float, *more: str) -> DataFrame:
    rows = scores.select(unkeyed(), "score", *more)
    return rows.select("doc_id", held_out(folds, held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *more)


def op6_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    index = toxicity.fit(docs, labels(spark, sf_dir))
    return _judged(toxicity.scored(docs, index), toxicity.FOLDS, toxicity.HELD, 0.5, "evidence")


def op7_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op8_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.judged(documents(spark, sf_dir))


def op9_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = pu_quality.fit(docs, labels(spark, sf_dir))
    return _judged(pu_quality.scored(docs, net), pu_quality.FOLDS, pu_quality.HELD, pu_quality.THRESHOLD)


def op10_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_WORD = r"'[^\x20\x09-\x0D]+'"
#: op1 in DuckDB: shared shingles count intersections, and links are followed to their ends.
NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS x FROM w),
e AS MATERIALIZED (SELECT doc_id, unnest(x) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= 80 * (len(sa.x) + len(sb.x) - n)),
both_ways AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.v, b FROM r JOIN both_ways ON a = c)
SELECT s.doc_id, len(x)::BIGINT AS n_shingles, min(c) AS component_id, min(c) = s.doc_id AS kept FROM s JOIN r ON v = s.doc_id GROUP BY s.doc_id, x"""
#: op2 in DuckDB: every window as text, the smallest document of each, and words that no such window covers.
REPEATS_SQL = f"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
x AS MATERIALIZED (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50),
y AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS t FROM x),
h AS (SELECT y.doc_id, i FROM y JOIN (SELECT t, min(doc_id) AS low FROM y GROUP BY 1) m ON y.t = m.t WHERE low < y.doc_id),
o AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
c AS (SELECT o.doc_id, o.i, word, max(CASE WHEN h.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY o.doc_id ORDER BY o.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM o LEFT JOIN h ON h.doc_id = o.doc_id AND h.i = o.i),
k AS (SELECT doc_id, sum(gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS t FROM c GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": NEAR_SQL, "op2_substring_dedup": REPEATS_SQL, "op7_license_digests": licenses.oracle()}
