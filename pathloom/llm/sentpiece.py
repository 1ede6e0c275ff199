"""SentencePiece BPE encoding and decoding with numpy.

Encoding cuts texts before runs of the space mark (no piece crosses from another
symbol into the mark; the model is checked for that), encodes each distinct
chunk once by vectorised merge rounds (see merges), and gathers ids by chunk.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pathloom.llm.common import arrow_map, coded, gather, heavy, keyed, starts_of, unkeyed
from pathloom.llm.merges import PairTable

MARK = "▁"
#: Distinct chunks that a worker keeps.
CACHE = 400_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def codec(path: str | None = None) -> SentencePieceCodec:
    """The worker's codec for a model file; made once."""
    path = path or default_path()
    return heavy(f"pieces {path}", lambda: SentencePieceCodec(path))


class SentencePieceCodec:
    """A BPE model with identity normalisation, a dummy prefix and byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not train.byte_fallback or train.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with identity normalisation, dummy prefix and byte fallback")
        pieces = [(p.piece, p.score, p.type) for p in model.pieces]
        if any(kind in (USER, UNUSED) for _, _, kind in pieces) or any(kind == NORMAL and re.search(f"[^{MARK}]{MARK}", text) for text, _, kind in pieces):
            raise ValueError("pieces that are user-defined, unused, or cross into the space mark")
        self.end_id = next(i for i, (text, _, kind) in enumerate(pieces) if kind == CONTROL and text == "</s>")
        self.unknown = next(i for i, x in enumerate(pieces) if x[2] == UNKNOWN)
        self.texts = [text for text, _, _ in pieces]
        self.kinds = [kind for _, _, kind in pieces]
        self.byte_ids = {int(text[1:-1], 16): i for i, (text, _, kind) in enumerate(pieces) if kind == BYTE}
        symbols = {text: i for i, (text, _, kind) in enumerate(pieces) if kind == NORMAL}
        n = len(pieces)
        for text in list(symbols):  # characters that only occur inside pieces
            for c in text:
                symbols.setdefault(c, n + len(symbols))
        # Rank of a piece: equal scores share one.
        order = {s: r for r, s in enumerate(sorted({score for _, score, kind in pieces if kind == NORMAL}, reverse=True))}
        pairs: tuple[list[int], ...] = ([], [], [], [])
        for i, (text, score, kind) in enumerate(pieces):
            if kind == NORMAL:
                for k in range(1, len(text)):
                    a, b = symbols.get(text[:k]), symbols.get(text[k:])
                    if a is not None and b is not None:
                        for column, x in zip(pairs, (a, b, order[score], i), strict=True):
                            column.append(x)
        self.symbols, self.size = symbols, n
        self.table = PairTable(*pairs)
        self.cache: dict[str, bytes] = {}

    def merge(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk as little-endian uint32."""
        if not chunks:
            return []
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.repeat(np.arange(len(chunks)), np.fromiter(map(len, chunks), np.int64, len(chunks)))
        distinct, inverse = np.unique(points, return_inverse=True)
        strange = -2 - distinct.astype(np.int64)  # a character without a symbol never merges
        known = np.asarray([self.symbols.get(chr(c), s) for c, s in zip(distinct.tolist(), strange.tolist(), strict=True)], np.int64)
        return self._ids(*self.table.merge(known[inverse], owner), len(chunks))

    def _ids(self, owner: np.ndarray, symbol: np.ndarray, n: int) -> list[bytes]:
        """Symbols without an id become the ids of their UTF-8 bytes."""
        counts = np.ones(len(symbol), np.int64)
        odd = np.flatnonzero((symbol < 0) | (symbol >= self.size))
        ids = symbol.astype("<u4")
        if len(odd):
            names = {v: k for k, v in self.symbols.items() if v >= self.size}
            spelt = []
            for s in symbol[odd].tolist():
                raw = (chr(-2 - s) if s < 0 else names[s]).encode("utf-8", "replace")
                spelt.append(np.asarray([self.byte_ids[b] for b in raw], "<u4"))
            counts[odd] = [len(x) for x in spelt]
            ids = np.repeat(ids, counts)
            places = starts_of(counts)[:-1][odd]
            for place, x in zip(places.tolist(), spelt, strict=True):
                ids[place : place + len(x)] = x
            owner = np.repeat(owner, counts)
        bounds = 4 * starts_of(np.bincount(owner, minlength=n))
        data = ids.astype("<u4").tobytes()
        return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _cached(self, chunks: list[str]) -> list[bytes]:
        cache = self.cache
        new = [x for x in dict.fromkeys(chunks) if x not in cache]
        if len(cache) + len(new) > CACHE:  # what this call needs stays
            self.cache = cache = {x: cache[x] for x in chunks if x in cache}
        cache.update(zip(new, self.merge(new), strict=True))
        return [cache[x] for x in chunks]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another as <u4, number of ids of each text); a null is empty. No end id."""
        texts = texts.fill_null("")
        plain = texts.to_pylist()
        odd = {i: _CHUNK.findall(MARK + x.replace(" ", MARK)) for i, x in enumerate(plain) if "  " in x or x[-1:] == " " or x[:1] == " " or MARK in x}
        if odd:
            mask = np.zeros(len(plain), bool)
            mask[list(odd)] = True
            texts = pc.if_else(pa.array(mask), "", texts)
        codes, counts, vocab = coded(pc.split_pattern(texts, " "))
        words = vocab.to_pylist()
        extra = list(dict.fromkeys(x for part in odd.values() for x in part))
        packed = self._cached([MARK + x for x in words] + extra)
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        sizes_of_empty = [i for i, x in enumerate(words) if not x]
        sizes[sizes_of_empty] = 0  # only of an empty text
        pool, begins = np.frombuffer(b"".join(packed), "<u4"), starts_of(np.fromiter(map(len, packed), np.int64, len(packed)) // 4)[:-1]
        lengths = sizes[codes]
        ids = pool[gather(begins[codes], lengths)]
        each = np.add.reduceat(lengths, starts_of(counts)[:-1]) if len(counts) else np.zeros(0, np.int64)
        if not odd:
            return ids, each
        number = {x: len(words) + i for i, x in enumerate(extra)}
        bounds, parts = starts_of(each), []
        for i in range(len(plain)):
            if i in odd:
                own = np.asarray([number[x] for x in odd[i]], np.int64)
                parts.append(pool[gather(begins[own], sizes[own])])
            else:
                parts.append(ids[bounds[i] : bounds[i + 1]])
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids as the library's decode() gives it.

        Control ids are silent, runs of byte ids are read as UTF-8 with U+FFFD for
        each byte that cannot be, marks become spaces, and the dummy prefix of the
        first piece goes.
        """
        out: list[str] = []
        start = True
        for is_byte, run in groupby(ids.tolist() if isinstance(ids, np.ndarray) else ids, lambda i: self.kinds[i] == BYTE):
            if is_byte:
                out.append(_utf8(bytes(int(self.texts[i][1:-1], 16) for i in run)))
                start = False
                continue
            for i in run:
                kind, text = self.kinds[i], self.texts[i]
                if kind == CONTROL:
                    continue
                if kind == UNKNOWN:
                    out.append(" ⁇ ")
                    start = False
                    continue
                if start and text[0] == MARK:
                    text = text[1:]
                start = False
                out.append(text.replace(MARK, " "))
        return "".join(out)

    def decode_many(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """decode() of each text: pieces are looked up by one take, rare kinds go one by one."""
        if not hasattr(self, "_spelt"):
            usual = np.asarray([kind == NORMAL for kind in self.kinds])
            self._usual, self._spelt = usual, pa.array([x.replace(MARK, " ") if k == NORMAL else "" for x, k in zip(self.texts, self.kinds, strict=True)])
        bounds = starts_of(counts)
        plain = self._usual[ids] | (ids == self.end_id)
        rare = np.flatnonzero(np.bincount(np.repeat(np.arange(len(counts)), counts)[~plain], minlength=len(counts)))
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), self._spelt.take(pa.array(ids)))
        out = [x[1:] if x[:1] == " " else x for x in pc.binary_join(lists, "").to_pylist()]
        for i in rare.tolist():
            out[i] = self.decode(ids[bounds[i] : bounds[i + 1]])
        return out


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _with_end(model: SentencePieceCodec, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids with an end id after each text, number of ids of each text)."""
    ids, counts = model.encode(texts)
    counts = counts + 1
    bounds = starts_of(counts)
    full = np.full(bounds[-1], model.end_id, "<u4")
    own = np.ones(len(full), bool)
    own[bounds[1:] - 1] = False
    full[own] = ids
    return full, counts


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (an end id last) of every document.

    Columns doc_id and text are read, others left aside. Null and empty texts have
    the end id alone; null ids stay null; texts of any length are encoded whole;
    repeated rows repeat; an empty table gives an empty result.
    """

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, counts = _with_end(codec(path), batch.column("text"))
        yield {"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(starts_of(counts), pa.int32()), pa.array(ids.astype(np.int32)))}

    return arrow_map(keyed(docs), _IDS, step, keeps=True).select(unkeyed(), "ids")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids), as the library's decode() gives it.

    A null list gives a null text and an empty one an empty text; null ids of
    documents stay null; repeated rows repeat; an empty table gives an empty result.
    """
    shape = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        lists = batch.column("ids")
        counts = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        texts = codec(path).decode_many(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), counts)
        yield {"doc_id": batch.column("doc_id"), "text": pc.if_else(lists.is_valid(), pa.array(texts, pa.string()), None)}

    return arrow_map(rows.select(rows["doc_id"].cast("bigint").alias("doc_id"), rows["ids"].cast("array<int>").alias("ids")), shape, step, None, keeps=True)


def piece_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids of encoded(), and of their decoding; odd rows as there."""

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        model = codec(path)
        full, counts = _with_end(model, batch.column("text"))
        decimal = [str(i) for i in range(model.size)]
        spelt, bounds = full.tolist(), starts_of(counts).tolist()
        yield {
            "doc_id": batch.column("doc_id"),
            "n_tokens": counts,
            "ids_sha256": [hashlib.sha256(" ".join(map(decimal.__getitem__, spelt[a:b])).encode()).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)],
            "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in model.decode_many(full, counts)],
        }

    return arrow_map(keyed(docs), _DIGEST, step, keeps=True).select(unkeyed(), *_DIGEST.names[1:])


def _utf8(data: bytes) -> str:
    """Decoded; each byte that no character claims is one U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[i : i + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            size = 1
        i += min(size, len(data) - i) or 1
    return "".join(out)
