"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV, decoded to resampled PCM.

Companded samples expand through 256-entry tables made by rule; ADPCM blocks are
independent, so one numpy step decodes the same nibble of every block of a batch of
files; resampling is a polyphase windowed sinc, and its PCM is stored as 16-bit
files. Stored and read forms are whole RIFF/WAVE files in binary columns.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import arrow_map, keyed, starts_of, unkeyed

PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 0x11
#: Bits of a sample in each format, and the highest rate that is believed.
BITS, MOST_RATE = {PCM: 16, ALAW: 8, MULAW: 8, ADPCM: 4}, 768_000
#: The query's payload unit and ADPCM block size.
UNIT = 192
# Fixed values of IMA ADPCM: index changes by nibble magnitude, and step sizes.
INDEX_CHANGE = [-1, -1, -1, -1, 2, 4, 6, 8]
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, low = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(exponent == 0, low, low + 0x100 << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """Change of the predictor, and next index * 16, by index * 16 + nibble."""
    index, nibble = np.divmod(np.arange(89 * 16), 16)
    step = np.asarray(STEPS)[index]
    change = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
    after = np.clip(index + np.asarray(INDEX_CHANGE)[nibble & 7], 0, 88)
    return np.where(nibble & 8, -change, change).astype(np.int32), (after * 16).astype(np.int32)


MULAW_TABLE, ALAW_TABLE = _mulaw_table(), _alaw_table()
_CHANGE, _NEXT = _adpcm_tables()


def wav(kind: int, data: bytes, rate: int = 8000, block: int = 1, samples: int | None = None) -> bytes:
    """A mono WAVE file around encoded data."""
    bits = BITS[kind]
    block = 2 if kind == PCM else block
    per_block = 2 * (block - 4) + 1 if kind == ADPCM else 1
    samples = samples if samples is not None else len(data) // block * per_block
    extra = struct.pack("<HH", 2, per_block) if kind == ADPCM else b"" if kind == PCM else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", kind, 1, rate, rate * block // per_block, block, bits) + extra
    fact = b"" if kind == PCM else struct.pack("<4sII", b"fact", 4, samples)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(form)) + form + fact + struct.pack("<4sI", b"data", len(data)) + data + b"\0" * (len(data) & 1)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def parse_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """(format, rate, block size, data) of a mono WAVE file in one of the four formats; ValueError if it isn't one."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            if size < 16 or at + 24 > len(media):
                raise ValueError("a format chunk that is too short")
            kind, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if channels != 1 or bits != BITS.get(kind):
                raise ValueError("only mono of the four formats")
            if not 0 < rate <= MOST_RATE or (kind == ADPCM and block <= 4):
                raise ValueError("a rate or block size that no file has")
            form = kind, rate, block
        elif name == b"data":
            if form is None or at + 8 + size > len(media):
                break
            return *form, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no whole data chunk")


def decode_adpcm(data: np.ndarray, block: int) -> np.ndarray:
    """int16 samples (blocks, 2 * (block - 4) + 1) of whole IMA ADPCM mono blocks."""
    blocks = data.reshape(-1, block)
    predictor = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
    state = np.minimum(blocks[:, 2], 88).astype(np.int32) * 16
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * (block - 4) + 1, len(blocks)), np.int16)
    out[0] = predictor
    for i, column in enumerate(body):
        for half, nibble in enumerate((column & 15, column >> 4)):
            code = state + nibble
            predictor = np.clip(predictor + _CHANGE[code], -32768, 32767)
            state = _NEXT[code]
            out[2 * i + half + 1] = predictor
    return out.T


@lru_cache(maxsize=16)
def _phases(up: int, down: int, half: int = 8) -> list[np.ndarray]:
    """The taps of each output phase of a Hann-windowed sinc."""
    cut = 1 / max(up, down)
    reach = half * max(up, down)
    t = np.arange(-reach, reach + 1)
    h = np.sinc(t * cut) * cut * (0.5 + 0.5 * np.cos(np.pi * t / (reach + 1))) * up
    return [np.ascontiguousarray(h[p::up]) for p in range(up)]


def resample(pcm: np.ndarray, rate: int, target: int) -> np.ndarray:
    """int16 samples at another rate."""
    if rate == target or not len(pcm):
        return pcm
    g = math.gcd(rate, target)
    up, down = target // g, rate // g
    phases = _phases(up, down)
    reach = 8 * max(up, down)
    n = -(-len(pcm) * up // down)
    at = np.arange(n) * down + reach
    out, x = np.empty(n), pcm.astype(float)
    for p in range(up):
        mine = np.flatnonzero(at % up == p)
        full = np.convolve(x, phases[p])
        where = at[mine] // up
        out[mine] = np.where(where < len(full), full[np.minimum(where, len(full) - 1)], 0)
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def to_pcm(media: bytes) -> tuple[int, np.ndarray]:
    """(rate, int16 samples) of a WAVE file of any of the four formats; ValueError if it isn't one."""
    found = decode_many([media])[0]
    if found is None:
        raise ValueError("not a mono WAVE file in one of the four formats")
    return found


def decode_many(files: list[bytes | None]) -> list[tuple[int, np.ndarray] | None]:
    """to_pcm() of each file, or None; files of one format and block size are decoded together."""
    out: list[tuple[int, np.ndarray] | None] = [None] * len(files)
    alike: dict[tuple[int, int], list[tuple[int, int, np.ndarray]]] = {}
    for i, media in enumerate(files):
        if media is None:
            continue
        try:
            kind, rate, block, data = parse_wav(media)
        except (ValueError, struct.error):
            continue
        unit = block if kind == ADPCM else 2 if kind == PCM else 1
        alike.setdefault((kind, unit), []).append((i, rate, np.frombuffer(data, np.uint8)[: len(data) // unit * unit]))
    for (kind, unit), found in alike.items():
        flat = np.concatenate([x for _, _, x in found])
        if kind == ADPCM:
            pcm, per = decode_adpcm(flat, unit).reshape(-1), 2 * (unit - 4) + 1
        elif kind == PCM:
            pcm, per = flat.view("<i2").astype(np.int16), 1
        else:
            pcm, per = (MULAW_TABLE if kind == MULAW else ALAW_TABLE)[flat], 1
        cuts = starts_of(np.fromiter((len(x) // unit * per for _, _, x in found), np.int64, len(found)))
        for (i, rate, _), a, b in zip(found, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out[i] = rate, pcm[a:b]
    return out


def resampled_files(decoded: list[tuple[int, np.ndarray] | None], target: int) -> list[bytes | None]:
    """16-bit WAVE files at the target rate."""
    return [None if x is None else wav(PCM, resample(x[1], x[0], target).astype("<i2").tobytes(), target) for x in decoded]


def store_pcm(df: DataFrame, media: str = "media", target: int = 16000, out: str = "pcm") -> DataFrame:
    """df with a binary column `out`: the audio of `media` as a 16-bit WAVE file at the target rate.

    Null, empty, malformed or unreadable media give null; audio without samples gives
    a file without samples. Files of any length are converted whole. All columns
    stay; a column named `out` is replaced. Repeated rows repeat, an empty table
    gives an empty result.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def convert(files):
        import pandas as pd

        return pd.Series(resampled_files(decode_many([None if x is None else bytes(x) for x in files]), target), files.index, object)

    return df.withColumn(out, convert(F.col(media)))


#: Stored forms of a text: column, format and block size.
FORMS = (("mulaw", MULAW, 1), ("alaw", ALAW, 1), ("adpcm", ADPCM, UNIT))


def payload(raw: bytes) -> bytes:
    """Filled with spaces to a positive multiple of UNIT bytes."""
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def telephony(docs: DataFrame, rate: int = 8000) -> DataFrame:
    """doc_id and the WAVE files mulaw, alaw and adpcm that hold each text's payload: as samples, or as ADPCM blocks of UNIT bytes.

    Columns doc_id and text are read, others left aside. Null and empty texts are a
    payload of spaces; texts of any length are stored whole. Repeated rows repeat, an
    empty table gives an empty result.
    """
    shape = pa.schema([("doc_id", pa.int64()), *((name, pa.binary()) for name, _, _ in FORMS)])

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        full = [payload(x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()]
        yield {"doc_id": batch.column("doc_id")} | {name: [wav(kind, x, rate, block) for x in full] for name, kind, block in FORMS}

    return arrow_map(keyed(docs), shape, step).select(unkeyed(), *shape.names[1:])


_MEDIA = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("alaw_sha256", pa.string()), ("adpcm_sha256", pa.string()), ("pcm_bytes", pa.int64()), ("pcm_sha256", pa.string()),
])


def _level(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> list[int]:
    """Root mean square of each run of samples."""
    return np.sqrt(np.add.reduceat(np.square(flat.astype(np.int64)), at) // n).astype(np.int64).tolist()


def text_media(docs: DataFrame, rate: int = 8000, target: int = 16000) -> DataFrame:
    """Texts as telephony audio: stored in each of the three forms, read back, decoded, resampled and measured.

    The payload is the UTF-8 text (null: empty) filled with spaces to a positive
    multiple of 192 bytes. Each form is a file of its own (see telephony), which is
    parsed and decoded by what its header says, and whose samples are stored again as
    16-bit PCM at the target rate. media_* tell of the mu-law file and pcm_* of its
    PCM file; the feature string holds the root mean square of each form, peak and
    zero crossings of the mu-law samples, and the crc of each form's PCM file.
    Repeated rows give repeated results, an empty table an empty one; other columns
    are left aside, and texts of any length count whole.
    """

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        raw = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        full = [payload(x) for x in raw]
        stored, levels, files = {}, [], {}
        for name, kind, block in FORMS:
            stored[name] = [wav(kind, x, rate, block) for x in full]
            decoded = decode_many(stored[name])
            sizes = np.fromiter((len(x) for _, x in decoded), np.int64, len(decoded))
            begin, flat = starts_of(sizes)[:-1], np.concatenate([x for _, x in decoded])
            levels.append(_level(flat, begin, sizes))
            files[name] = resampled_files(decoded, target)
            if kind == MULAW:
                peak = np.maximum.reduceat(np.abs(flat.astype(np.int32)), begin).tolist()
                cross = np.r_[False, (flat[1:] < 0) != (flat[:-1] < 0)]
                cross[begin] = False
                crossings = np.add.reduceat(cross.astype(np.int64), begin).tolist()
        read = [parse_wav(x)[3] for x in stored["mulaw"]]
        told = {name: [hashlib.sha256(x).hexdigest() for x in own] for name, own in stored.items()}
        crc = [[zlib.crc32(x) for x in own] for own in files.values()]
        yield {
            "doc_id": batch.column("doc_id"),
            "n_bytes": [len(x) for x in raw],
            "payload_bytes": [len(x) for x in read],
            "payload_sha256": [hashlib.sha256(x).hexdigest() for x in read],
            "tail_crc32": [zlib.crc32(x[-16:]) for x in read],
            "media_bytes": [len(x) for x in stored["mulaw"]],
            "media_sha256": told["mulaw"],
            "feature": [f"mulaw={m};alaw={a};adpcm={d};peak={p};crossings={z};pcm{target}={x:08x},{y:08x},{w:08x}" for m, a, d, p, z, x, y, w in zip(*levels, peak, crossings, *crc, strict=True)],
            "alaw_sha256": told["alaw"],
            "adpcm_sha256": told["adpcm"],
            "pcm_bytes": [len(x) for x in files["mulaw"]],
            "pcm_sha256": [hashlib.sha256(x).hexdigest() for x in files["mulaw"]],
        }

    return arrow_map(keyed(docs), _MEDIA, step).select(unkeyed(), *_MEDIA.names[1:])
