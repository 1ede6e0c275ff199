"""From raw documents to packed sequences: STAGES in order, each on all that its predecessor kept."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import common, minhash, packing, pu_quality, substring, toxicity
from pathloom.storage import delete, fresh_path, recorded

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: No stage order gives the model-scored rows in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


#: What the last stage of a thread's run wrote on its way.
_written: dict[tuple[int, str, str], list[str]] = {}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 by their nearest labelled examples.

    Null ids and repeated rows are judged each; null, empty and word-less texts have
    no neighbour and stay; an empty table stays empty.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, common.labels(spark, sf_dir)))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier scores 0.7 or more.

    Null ids are unlabelled; repeated rows are judged each; null and empty texts are
    texts without words; an empty table stays empty.
    """
    return pu_quality.with_quality(docs, pu_quality.fit(docs, common.labels(spark, sf_dir)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, by five-word shingles: that of the smallest id.

    Rows of one id are one document and stay or go together. A row without id is a
    document of its own by its text, after all real ids; of equal ones the first
    stays. Texts without words (null, empty) are like no other and stay; an empty
    table stays empty.
    """
    own = F.when(F.col("doc_id").isNull(), F.lit(1 << 62) + F.xxhash64("text").bitwiseAND((1 << 61) - 1)).otherwise(F.col("doc_id"))
    rows = docs.withColumn("__own_id", own)
    kept = minhash.near_groups(rows.select(F.col("__own_id").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    rows = rows.join(kept, rows["__own_id"] == kept["__kept_id"], "left_semi")
    named, nameless = rows.where("doc_id is not null"), rows.where("doc_id is null")
    return named.unionByName(nameless.dropDuplicates(["__own_id"])).drop("__own_id")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a smaller id has.

    Null ids come after all others; rows of one id never cut each other; null and
    empty texts and repeated rows stay; an empty table stays empty.
    """
    return substring.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences.

    A null or empty text is its end id alone; rows without id and repeated rows are
    packed each; an empty table gives no piece.
    """
    return packing.pack(docs)


def _tidy(place: int, stage: Stage) -> Stage:
    """What the stage before wrote on its way goes, as its result is stored by then; other results of the session stay."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        run_ = (threading.get_ident(), spark.sparkContext.applicationId, sf_dir)
        before = _written.pop(run_, [])
        if place and before and not any(path.rpartition("/")[2] in f for f in docs.inputFiles() for path in before):
            for path in before:
                delete(spark, path)
        with recorded() as paths:
            out = stage(spark, docs, sf_dir)
        _written[run_] = paths
        return out

    return run_stage


_PLAIN: list[tuple[str, Stage]] = [("toxicity", drop_toxic), ("quality", drop_low_quality), ("near_dedup", drop_near_duplicates), ("substring_dedup", cut_repeats), ("packing", pack)]
STAGES: list[tuple[str, Stage]] = [(name, _tidy(place, stage)) for place, (name, stage) in enumerate(_PLAIN)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each result is written as Parquet and read again."""
    docs = common.documents(spark, sf_dir)
    before = None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = fresh_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
