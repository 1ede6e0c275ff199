"""Byte-level BPE ids of whole texts, equal to those of the tokenizers library, by arrays.

Texts are cut into pieces as the vocabulary's pattern cuts them: letters, digits or
other marks, each with one space before it, contractions, and white space. The cuts
follow from the class of each character and its neighbours, so numpy finds them for
a whole slice; the class of a character is asked of the library itself. Distinct
pieces merge by vectorised rounds, ids of known ones stay in the worker, and ids of
texts are gathered. Texts that spell a special token go to the library whole, as do
vocabularies of other kinds and pieces beyond LONG bytes, whose rounds would be many.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pathloom.llm.common import gather, heavy, starts_of
from pathloom.llm.merges import PairTable

#: Distinct pieces that a worker keeps: the younger half stays when they are more.
CACHE = 600_000
#: UTF-8 bytes that one call should hold: more repeat more of their pieces.
SLICE = 4_000_000
#: Bytes of a piece beyond which the library merges it.
LONG = 1024
_OTHER, _LETTER, _NUMBER, _SPACE, _ASK = range(5)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str | None = None) -> ByteBpe:
    """The worker's encoder for a vocabulary file; made once."""
    path = path or default_path()
    return heavy(f"bytes {path}", lambda: ByteBpe(path))


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Pieces:
    """Distinct pieces, and the ids of each."""

    def __init__(self, known: pa.Array | None = None, sizes: np.ndarray | None = None, pool: np.ndarray | None = None):
        self.known = pa.array([], pa.binary()) if known is None else known
        self.sizes = np.zeros(0, np.int64) if sizes is None else sizes
        self.pool = np.zeros(0, "<u4") if pool is None else pool
        self.starts = starts_of(self.sizes)[:-1]

    def added(self, more: Pieces) -> Pieces:
        return Pieces(pa.concat_arrays([self.known, more.known]), np.r_[self.sizes, more.sizes], np.r_[self.pool, more.pool])

    def younger(self) -> Pieces:
        half = len(self.sizes) // 2
        return Pieces(pa.concat_arrays([self.known.slice(half)]), self.sizes[half:], self.pool[self.starts[half] :] if half < len(self.sizes) else self.pool[:0])


class ByteBpe:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [re.escape(x.content) for x in self.library.get_added_tokens_decoder().values()]
        self.special = "|".join(added)
        with open(path, "rb") as f:
            form = json.load(f)
        model, cutter = form["model"], form.get("pre_tokenizer") or {}
        usual = model["type"] == "BPE" and not form.get("normalizer") and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        self.usual = usual and cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
        self.pieces = Pieces()
        if not self.usual:
            return
        vocabulary = model["vocab"]
        self.byte_id = np.asarray([vocabulary.get(x, -1) for x in _byte_letters()], np.int64)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        self.table = PairTable([vocabulary[a] for a, _ in pairs], [vocabulary[b] for _, b in pairs], list(range(len(pairs))), [vocabulary[a + b] for a, b in pairs])
        self.usual = bool((self.byte_id >= 0).all())
        self.classes = np.full(0x110000, _ASK, np.uint8)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids, "<u4") for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _class(self, point: int) -> int:
        """As the library's pattern has it: characters of one class stay in one piece."""
        if 0xD800 <= point < 0xE000:
            return _OTHER
        cut = self.library.pre_tokenizer.pre_tokenize_str
        for mark, kind in (("a", _LETTER), ("1", _NUMBER), ("!", _OTHER)):
            if len(cut(mark + chr(point))) == 1:
                return kind
        return _SPACE

    def cuts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Byte offsets at which pieces of the texts data[bounds[i] : bounds[i + 1]] begin."""
        if not len(data):
            return np.zeros(0, np.int32)
        wide = data >= 0x80
        at = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32) if wide.any() else None
        first = data if at is None else data[at]
        point = first.astype(np.int32)
        for low, high, size in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3), (0xF0, 0x100, 4)) if at is not None else ():
            own = np.flatnonzero((first >= low) & (first < high))
            value = (first[own] & (0x7F >> size)).astype(np.int32)
            for k in range(1, size):
                value = value << 6 | (data[at[own] + k] & 0x3F)
            point[own] = value
        kind = self.classes[point]
        if (ask := kind == _ASK).any():
            for p in np.unique(point[ask]).tolist():
                self.classes[p] = self._class(p)
            kind = self.classes[point]
        n = len(kind)
        edges = bounds[np.flatnonzero(np.diff(bounds))]
        begins = edges if at is None else np.searchsorted(at, edges)
        fresh = np.zeros(n + 1, bool)  # first character of a text; one more for the end
        fresh[begins] = fresh[n] = True
        space = kind == _SPACE
        start = fresh[:n].copy()
        # A class begins; after a blank the blank has begun it.
        start[1:] |= (kind[1:] != kind[:-1]) & (space[1:] | (point[:-1] != 0x20))
        # Of a run of white space before something else the last one stands apart.
        last = space.copy()
        last[:-1] &= ~space[1:]
        start |= last & ~fresh[1:]
        # Contractions after something else than a blank or a mark: they end where letters go on.
        quote = np.flatnonzero((point == 0x27) & start)
        if len(quote):
            padded = np.concatenate((point, np.zeros(3, np.int32)))
            closed = np.concatenate((fresh, np.ones(3, bool)))
            one, two = padded[quote + 1], padded[quote + 2]
            is_open = ~closed[quote + 1]
            short = is_open & np.isin(one, [ord(c) for c in "stmd"])
            pair = is_open & ~closed[quote + 2] & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            for hit, size in ((short, 2), (pair, 3)):
                start[quote[hit] + 1] = False
                ends = quote[hit] + size
                start[ends[ends < n]] = True
        found = np.flatnonzero(start).astype(np.int32)
        return found if at is None else at[found]

    def _merged(self, new: pa.Array) -> Pieces:
        """Ids of distinct pieces."""
        sizes = pc.binary_length(new).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.frombuffer(new.buffers()[1], np.int32)[new.offset : new.offset + len(new) + 1]
        data = np.frombuffer(new.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        owner = np.repeat(np.arange(len(new), dtype=np.int32), sizes)
        long = np.flatnonzero(sizes > LONG)
        symbol = self.byte_id[data]
        if len(long):
            short = ~np.isin(owner, long)
            owner, symbol = owner[short], symbol[short]
        owner, symbol = self.table.merge(symbol, owner)
        counts, pool = np.bincount(owner, minlength=len(new)), symbol.astype("<u4")
        if not len(long):
            return Pieces(new, counts, pool)
        begins = starts_of(counts)
        parts = [pool[begins[i] : begins[i + 1]] for i in range(len(new))]
        # A piece of one class that stands alone is one piece again, but may not be text by itself.
        for i in long.tolist():
            raw = new[i].as_py()
            parts[i] = self._library([raw.decode()])[0]
        return Pieces(new, np.fromiter(map(len, parts), np.int64, len(parts)), np.concatenate(parts))

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        if bounds[0] == bounds[-1]:
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        cuts = self.cuts(data, bounds)
        spans = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, np.int32(len(data)))), pa.py_buffer(data)])
        coded = spans.dictionary_encode()
        codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        kept = self.pieces
        where = pc.index_in(words, value_set=kept.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(where < 0)
        if len(new):
            merged = self._merged(words.take(pa.array(new)))
            where[new] = len(kept.sizes) + np.arange(len(new))
            kept = kept.added(merged)
            self.pieces = kept if len(kept.sizes) <= CACHE else kept.younger()
        own = where[codes]
        lengths = kept.sizes[own]
        ids = kept.pool[gather(kept.starts[own], lengths)]
        ends = starts_of(lengths)[np.searchsorted(cuts, bounds)]
        return ids, np.diff(ends)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another as <u4, number of ids of each text); a null is empty."""
        texts = texts.cast(pa.string()).fill_null("")
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        odd = np.flatnonzero(pc.match_substring_regex(texts, self.special).to_numpy(zero_copy_only=False)) if self.special else np.zeros(0, np.int64)
        if not self.usual:
            odd = np.arange(len(texts))
        if not len(odd):
            return self._plain(texts)
        mask = np.zeros(len(texts), bool)
        mask[odd] = True
        ids, each = self._plain(pc.if_else(pa.array(mask), "", texts)) if self.usual else (np.zeros(0, "<u4"), np.zeros(len(texts), np.int64))
        whole = dict(zip(odd.tolist(), self._library(texts.take(pa.array(odd)).to_pylist()), strict=True))
        bounds = starts_of(each)
        parts = [whole[i] if i in whole else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
