"""Shared plumbing: keyed tables, Arrow mapping, word splitting; settled tables come from pathloom.storage."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.storage import delete, fresh_path, recorded, settle, shared_folder

#: Stands for a null id while an operator runs: it sorts after every real id.
NULL_ID = 2**63 - 1
#: UTF-8 bytes of text that one vectorised step holds at a time.
SLICE_BYTES = 4_000_000

_DDL = {
    pa.int64(): "bigint",
    pa.int32(): "int",
    pa.float64(): "double",
    pa.float32(): "float",
    pa.string(): "string",
    pa.binary(): "binary",
    pa.bool_(): "boolean",
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): null ids become NULL_ID, null texts stay null."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
    )


def unkeyed(name: str = "doc_id"):
    """The column with NULL_ID turned back to null."""
    return F.nullif(F.col(name), F.lit(NULL_ID).cast("bigint")).alias(name)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ddl(schema: pa.Schema) -> str:
    def one(kind: pa.DataType) -> str:
        return f"array<{one(kind.value_type)}>" if pa.types.is_list(kind) else _DDL[kind]

    return ", ".join(f"`{f.name}` {one(f.type)}" for f in schema)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about `limit` bytes; a longer text stands alone."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


_heavy: dict[str, object] = {}


def heavy(name: str, make: Callable[[], object]):
    """A worker's large state (caches, indexes), made once and kept between tasks; asking for another one frees it."""
    if name not in _heavy:
        light()
        _heavy[name] = make()
    return _heavy[name]


def light() -> None:
    """Frees what other operators left in this worker, and gives the memory back to the system."""
    _heavy.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, schema: pa.Schema, step: Callable[[pa.RecordBatch], Iterable[dict]], column: str | None = "text", keeps: bool = False) -> DataFrame:
    """mapInArrow where step turns a slice of rows into dicts of columns; keeps: step asks for a heavy() state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            light()
        for batch in batches:
            for part in text_slices(batch, column) if column else [batch]:
                for out in step(part):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type, from_pandas=False) for f in schema], schema=schema)

    return df.mapInArrow(run, ddl(schema))


def coded(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of all strings of all lists in order, the number in each list (a null has none), and the strings by code."""
    counts = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    return flat.indices.to_numpy(zero_copy_only=False), counts, flat.dictionary


def coded_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words [^\\x20\\x09-\\x0D]+ of each text as codes; see coded(). lower: A-Z only."""
    codes, counts, vocab = coded(pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts))
    empty = pc.index(vocab, pa.scalar("", vocab.type)).as_py()
    if empty >= 0:  # before and after white space at an end
        full = codes != empty
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[full], minlength=len(counts)).astype(np.int64)
        codes = codes[full]
    return codes, counts, vocab


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Where each list begins in the flat array; one more for the end."""
    return np.concatenate(([0], np.cumsum(counts)))


def word_hashes(vocab: pa.Array) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocab.cast(pa.binary()).to_pylist()), np.uint64, len(vocab))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; numpy's own takes a hash table for integers, which is several times slower than a sort."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... start + length - 1 of each piece, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def tokens_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8: bytes.split() splits on exactly these bytes."""
    return text.encode().split() if text else []


def learn_rows(labelled: DataFrame, column: str, modulus: int, held: int) -> DataFrame:
    """(doc_id, y) of rows that may be learned from: crc32(doc_id as text) mod modulus is not held."""
    return labelled.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != held).where(F.col(column).isNotNull()).select("doc_id", F.col(column).cast("int").alias("y")).distinct()


def held_out(modulus: int, held: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held, F.lit(False))
