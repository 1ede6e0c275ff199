"""Tables written out on the way: lineage ends there, and a lost executor costs no recomputation.

What is written stays until its caller deletes it, since results that have not run
yet may read it: recorded() tells a caller what a call has written.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_recording: ContextVar[tuple[list[str], ...]] = ContextVar("recording", default=())


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set; else a temporary folder on a local master and one in the warehouse on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="pathloom-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
            base = f"file://{base}"
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_pathloom"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that are taken while the context lasts, for delete() once every result that reads them is stored elsewhere."""
    paths: list[str] = []
    token = _recording.set((*_recording.get(), paths))
    try:
        yield paths
    finally:
        _recording.reset(token)


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/pathloom-{label}-{uuid.uuid4().hex[:12]}"
    for paths in _recording.get():
        paths.append(path)
    return path


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
