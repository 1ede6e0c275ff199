"""Token shards: independent zstandard frames, a document directory and a trailing seek table.

Layout of a shard:
  data frames       each holds the ids of whole documents as little-endian uint32,
                    is compressed on its own and carries zstandard's checksum;
  skippable frame   0x184D2A5D: zstandard of int64 arrays doc_id, number of ids, frame;
  skippable frame   0x184D2A5E, the seek table of the public seekable format:
                    per frame compressed size, size and the low 32 bits of xxh64
                    of the content, then number of frames, descriptor 0x80 and
                    the magic number 0x8F92EAB1.
A reader takes the last bytes, then the directory, then only the frames of the
documents that are asked for.
"""

from __future__ import annotations

import contextlib
import io
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import bytebpe
from pathloom.llm.common import arrow_map, ddl, fresh_path, gather, keyed, partitions, settle, starts_of, text_slices, unkeyed

#: Ids after which a frame is closed; a longer document has a frame of its own.
FRAME_IDS = 65_536
#: Text bytes of a shard, and frames that a task reads back: neither grows with the input.
SHARD_BYTES, READ_FRAMES = 512_000_000, 64
DIRECTORY, SEEK, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1


class ShardWriter:
    """Appends documents to a binary file object."""

    def __init__(self, out, level: int = 3):
        self.out, self.level = out, level
        self.waiting: list[bytes] = []
        self.size = 0
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.counts: list[int] = []
        self.frame_of: list[int] = []

    def add(self, doc_id: int, packed: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(packed) // 4)
        self.frame_of.append(len(self.frames))
        self.waiting.append(packed)
        self.size += len(packed)
        if self.size >= 4 * FRAME_IDS:
            self._close_frame()

    def _close_frame(self) -> None:
        if not self.waiting:
            return
        data = b"".join(self.waiting)
        packed = zstandard.ZstdCompressor(level=self.level, write_checksum=True, write_content_size=True).compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.waiting, self.size = [], 0

    def close(self) -> None:
        self._close_frame()
        table = np.asarray([self.ids, self.counts, self.frame_of], "<i8").tobytes()
        packed = zstandard.ZstdCompressor(level=self.level).compress(table)
        self.out.write(struct.pack("<II", DIRECTORY, len(packed)) + packed)
        seek = b"".join(struct.pack("<III", *x) for x in self.frames)
        self.out.write(struct.pack("<II", SEEK, len(seek) + 9) + seek + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE))


class ShardReader:
    """Reads documents of a shard from a seekable file object or bytes."""

    def __init__(self, source):
        self.file = io.BytesIO(source) if isinstance(source, bytes | bytearray | memoryview) else source
        end = self.file.seek(0, 2)
        self.file.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("not a token shard: no seek table at its end")
        at = end - 9 - 12 * n - 8
        self.file.seek(at)
        kind, size = struct.unpack("<II", self.file.read(8))
        if kind != SEEK or size != 12 * n + 9:
            raise ValueError("the seek table is damaged")
        self.frames = np.frombuffer(self.file.read(12 * n), "<u4").reshape(n, 3)
        self.at = starts_of(self.frames[:, 0].astype(np.int64))
        self.file.seek(int(self.at[-1]))
        kind, size = struct.unpack("<II", self.file.read(8))
        if kind != DIRECTORY:
            raise ValueError("the document directory is damaged")
        table = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.file.read(size)), "<i8").reshape(3, -1)
        self.doc_ids, self.counts, self.frame_of = table
        self.starts = starts_of(self.counts)[:-1]
        self.frame_starts = starts_of(self.frames[:, 1].astype(np.int64)) // 4
        self.order = np.argsort(self.doc_ids, kind="stable")

    def frame(self, k: int) -> np.ndarray:
        size, full, check = (int(x) for x in self.frames[k])
        self.file.seek(int(self.at[k]))
        data = zstandard.ZstdDecompressor().decompress(self.file.read(size), max_output_size=full)
        if len(data) != full or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(data, "<u4")

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the shard; only its frame is decompressed."""
        k = int(self.frame_of[i])
        a = int(self.starts[i] - self.frame_starts[k])
        return self.frame(k)[a : a + int(self.counts[i])]

    def of(self, doc_id: int) -> list[np.ndarray]:
        """Ids of every document of that doc_id."""
        ranked = self.doc_ids[self.order]
        a, b = np.searchsorted(ranked, [doc_id, doc_id + 1])
        return [self.document(int(i)) for i in self.order[a:b]]

    def between(self, first: int, last: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, start in the shard, ids) of the documents in frames first to last - 1."""
        a, b = np.searchsorted(self.frame_of, [first, last])
        at, ids = -1, None
        for i in range(int(a), int(b)):
            k = int(self.frame_of[i])
            if k != at:
                at, ids = k, self.frame(k)
            begin = int(self.starts[i] - self.frame_starts[k])
            yield int(self.doc_ids[i]), int(self.starts[i]), ids[begin : begin + int(self.counts[i])]

    def __iter__(self) -> Iterator[tuple[int, int, np.ndarray]]:
        return self.between(0, len(self.frames))


def _at(uri: str) -> str:
    return f"file://{uri}" if uri.startswith("/") else uri


def _name(uri: str, shard: int) -> str:
    return f"{uri}/shard-{shard:05d}.zst"


@contextlib.contextmanager
def open_shard(uri: str) -> Iterator[ShardReader]:
    """A reader that fetches only the parts of the file that it needs."""
    fs, path = pafs.FileSystem.from_uri(_at(uri))
    with fs.open_input_file(path) as f:
        yield ShardReader(f)


def write_file(uri: str, chunks: Iterable[bytes], attempt: str) -> None:
    """Write under a name of this attempt, then move: a task that runs twice leaves one whole file."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(f"{path}.{attempt}") as out:
        for x in chunks:
            out.write(x)
    fs.move(f"{path}.{attempt}", path)


_SHARD = pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_frames", pa.int64())])
_DOC = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])


def write_shards(docs: DataFrame, uri: str, vocabulary: str | None = None, end_id: int = 0, level: int = 3) -> list[tuple[int, int, int, int]]:
    """Write the ids of all texts in ascending order of doc_id to uri/shard-NNNNN.zst.

    docs has columns doc_id and text; others are left aside. One range partition of
    about SHARD_BYTES makes one shard. Null and empty texts hold the end id alone;
    null ids come last; rows of one id follow each other in the order of their texts
    and may be dealt over several shards by how these begin; repeated rows stay
    repeated. A text longer than a frame has a frame of its own. An empty table
    writes no shard.
    Returns (shard, documents, ids, frames) in order: one row for each shard.
    """
    uri, spark = _at(uri), docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, bpe, out = task.partitionId(), bytebpe.encoder(vocabulary), io.BytesIO()
        writer, end = ShardWriter(out, level), np.asarray([end_id], "<u4").tobytes()

        def pieces() -> Iterator[bytes]:
            for batch in batches:
                for part in text_slices(batch, limit=bytebpe.SLICE):
                    ids, counts = bpe.encode(part.column("text"))
                    data, bounds = memoryview(ids).cast("B"), (4 * starts_of(counts)).tolist()
                    for i, doc in enumerate(part.column("doc_id").to_pylist()):
                        writer.add(doc, bytes(data[bounds[i] : bounds[i + 1]]) + end)
                    yield out.getvalue()
                    out.seek(0)
                    out.truncate()
            writer.close()
            yield out.getvalue()

        first = next(whole := pieces(), b"")
        if writer.ids:
            write_file(_name(uri, shard), (x for part in ([first], whole) for x in part), f"{task.stageId()}-{task.taskAttemptId()}")
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (shard, len(writer.ids), sum(writer.counts), len(writer.frames))], schema=_SHARD)

    base = keyed(docs).withColumn("tie", F.substring("text", 1, 64))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = base.repartitionByRange(max(partitions(spark), -(-size // SHARD_BYTES)), "doc_id", "tie").sortWithinPartitions("doc_id", "text")
    rows = settle(ordered.mapInArrow(run, ddl(_SHARD)), "shards").orderBy("shard").collect()
    return [(r.shard, r.n_docs, r.n_tokens, r.n_frames) for r in rows]


def read_shards(spark: SparkSession, uri: str, shards: list[tuple[int, int, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the bytes of the files, READ_FRAMES frames at a time.

    shards is what write_shards() returned; an empty list gives an empty result.
    Null ids are common.NULL_ID, texts without words have their end id, repeated
    rows and documents of any length come as they were written.
    """
    if not shards:
        return spark.createDataFrame([], ddl(_DOC))
    uri, bases = _at(uri), starts_of(np.asarray([x[2] for x in shards])).tolist()
    known = spark.createDataFrame([(shard, base, frames) for (shard, _, _, frames), base in zip(shards, bases, strict=False)], "shard bigint, base bigint, frames bigint")

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for shard, base, first, last in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            with open_shard(_name(uri, shard)) as reader:
                rows = [(doc, base + start, len(ids), zlib.crc32(ids)) for doc, start, ids in reader.between(first, last)]
            yield dict(zip(_DOC.names, map(list, zip(*rows, strict=True)), strict=True))

    lots = known.select("shard", "base", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("frames") - 1, F.lit(READ_FRAMES).cast("bigint"))).alias("first"), "frames")
    parts = lots.select("shard", "base", "first", F.least(F.col("first") + READ_FRAMES, "frames").alias("last"))
    return arrow_map(parts.repartition(max(1, min(sum(-(-x[3] // READ_FRAMES) for x in shards), 4 * partitions(spark))), "shard", "first"), _DOC, step, None)


def read_documents(spark: SparkSession, uri: str, shards: list[tuple[int, int, int, int]], wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents whose doc_id is in `wanted`; only their frames are decompressed.

    wanted may be of any size and is dealt out over the shards by the range of ids
    that each directory tells. Null ids are not looked up; ids that no shard has
    give no row, repeated ids one row for each document that was written.
    """
    if not shards:
        return spark.createDataFrame([], ddl(_IDS))
    uri = _at(uri)

    def limits(batch: pa.RecordBatch) -> Iterator[dict]:
        for shard in batch.column("shard").to_pylist():
            with open_shard(_name(uri, shard)) as reader:
                yield {"shard": [shard], "low": [int(reader.doc_ids.min())], "high": [int(reader.doc_ids.max())]}

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, asked in zip(batch.column("shard").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                with open_shard(_name(uri, shard)) as reader:
                    for doc in sorted(asked):
                        for ids in reader.of(doc):
                            yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], schema=_IDS)

    span = pa.schema([("shard", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
    names = spark.createDataFrame([(x[0],) for x in shards], "shard bigint").repartition(max(1, min(len(shards), partitions(spark))), "shard")
    spans = sorted((r.low, r.high, r.shard) for r in arrow_map(names, span, limits, None).collect())  # a row for each shard
    lows, highs, names_ = (np.asarray(x, np.int64) for x in zip(*spans, strict=True))

    def deal(batch: pa.RecordBatch) -> Iterator[dict]:
        doc = batch.column("doc_id").to_numpy()
        first = np.searchsorted(highs, doc, "left")
        size = np.maximum(np.searchsorted(lows, doc, "right") - first, 0)
        yield {"doc_id": np.repeat(doc, size), "shard": names_[gather(first, size)]}

    # Requests of a shard go in lots: none meets in one row whatever its number.
    asked = wanted.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
    dealt = arrow_map(asked, pa.schema([("doc_id", pa.int64()), ("shard", pa.int64())]), deal, None)
    lots = dealt.groupBy("shard", F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("lot")).agg(F.collect_list("doc_id").alias("asked"))
    return lots.select("shard", "asked").mapInArrow(fetch, ddl(_IDS))


def token_index(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, uri: str | None = None) -> DataFrame:
    """Write all documents to shards, read the shards back: (doc_id, start, n_tokens, ids_crc32)."""
    uri = uri or fresh_path(docs.sparkSession, "tokens")
    shards = write_shards(docs, uri, vocabulary, end_id)
    return read_shards(docs.sparkSession, uri, shards).select(unkeyed(), *(F.col(x) for x in _DOC.names[1:]))
