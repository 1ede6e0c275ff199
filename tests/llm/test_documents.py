"""Every operator against a brute-force version, with the odd cases in the table."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pathloom.llm import audio, bytebpe, common, frames, licenses, minhash, packing, pu_quality, queries, sentpiece, substring, toxicity, weak_rules

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept string, rk string, windows string, rep string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=5):
    """Texts with copies, near copies in chains, shared passages, and odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passage = [word() for _ in range(70)]
    base = [word() for _ in range(120)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, "one two three"), (None, "one two three"), (None, "alone here"), (7, "x " * 300)]
    for i in range(10, 40):  # each differs from the last in a word: ends of the chain are far apart
        base = list(base)
        base[rng.randrange(len(base))] = word()
        rows.append((i, " ".join(base)))
    for i in range(40, 70):
        text = [word() for _ in range(rng.randint(0, 150))]
        at = rng.randint(0, len(text))
        rows.append((i, " ".join(text[:at] + passage * (i % 3 > 0) + text[at:])))
    rows += [(70, rows[-1][1]), (70, rows[-1][1]), (70, rows[-1][1]), (71, rows[12][1].upper()), (72, " ".join(word() for _ in range(30_000)))]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.0, "k", "r", "w", "p") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t, lower=False):
    t = t or ""
    return WORD.findall(t.translate({c: c + 32 for c in range(65, 91)}) if lower else t)


def sets_of(rows, size=4):
    out = {}
    for i, t in rows:
        w = words(t, True)
        out.setdefault(i, set()).update({tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set())
    return out


def groups(rows, size=4):
    key = lambda i: 2**63 - 1 if i is None else i
    each = [(key(i), s) for i, t in rows for s in [sets_of([(i, t)], size)[i]]]
    parent = {i: i for i, _ in each}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(each):
        for j, b in each[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    back = lambda x: None if x == 2**63 - 1 else x
    return sorted(((back(i), len(s), back(root(i)), root(i) == i) for i, s in each), key=repr)


def test_near_groups(docs, rows, empty):
    got = sorted((tuple(r) for r in minhash.near_groups(docs, size=4).collect()), key=repr)
    assert got == groups(rows)
    assert sorted((tuple(r) for r in minhash.near_groups(docs).collect()), key=repr) == groups(rows, 5)
    assert minhash.near_groups(empty).count() == 0


@pytest.mark.parametrize("limits", [{}, {"LARGE": 5}, {"LARGE": 5, "PARTNERS": 1, "LOCAL_LINKS": 3, "MINOR_BLOCK": 4, "BLOCK": 8, "GROUP_BYTES": 500}])
def test_near_groups_by_each_route(spark, monkeypatch, limits):
    """A group whose members are often too far from a hub."""
    rng = random.Random(3)
    base = [str(rng.random()) for _ in range(90)]
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 7)):
            t[rng.randrange(90)] = str(rng.random())
        rows.append((i, " ".join(t)))
    for k, v in limits.items():
        monkeypatch.setattr(minhash, k, v)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((tuple(r) for r in minhash.near_groups(docs, size=4).collect()), key=repr) == groups(rows)


def test_blocks_give_away_a_forest():
    """However many pairs of a block are links, fewer links than members leave it."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.r_[rng.permutation(base)[: 400 - n], rng.integers(0, 2**63, n).astype(np.uint64)]) for n in rng.integers(0, 60, 50)]
    fine = minhash.odd_sketches(minhash.minhashes(sets, minhash.FINE_SAMPLES), minhash.FINE_BITS)
    rows = [(i, i, role, 7, fine[i].tobytes(), sets[i].tobytes()) for i in range(50) for role in ((0, 1) if i < 30 else (1,))]
    table = pa.table(dict(zip(("rep", "component", "role", "block", "fine", "shingles"), zip(*rows, strict=True), strict=True)))
    links = minhash._forest(table, 80)
    alike = {(j, i) for i in range(50) for j in range(i + 1, 50) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert len(alike) > 300 and set(links) <= alike and len(links) < 50
    hopeful = minhash._hopeful(table)
    assert all(hopeful[k] for k, r in enumerate(rows) if r[2] == 0 and any(r[0] in pair for pair in alike))


def test_odd_sketches_estimate():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64))
    for share in (0.95, 0.8):
        n = round(len(a) * 2 * share / (1 + share))
        b = np.unique(np.r_[a[:n], rng.integers(0, 2**63, len(a) - n).astype(np.uint64)])
        x, y = minhash.odd_sketches(minhash.minhashes([a, b], 1024), 2048).view(np.uint64)
        assert abs(minhash.estimate(int(np.bitwise_count(x ^ y).sum()), 1024, 2048) - share) < 0.05


def removed(rows):
    low = {}
    key = lambda i: 2**63 - 1 if i is None else i
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            low[k] = min(low.get(k, key(i)), key(i))
    out = []
    for i, t in rows:
        w = words(t)
        hit = [False] * len(w)
        for p in range(len(w) - 49):
            if low[tuple(w[p : p + 50])] < key(i):
                hit[p : p + 50] = [True] * 50
        out.append((i, len(w), [x for x, h in zip(w, hit, strict=True) if not h]))
    return out


@pytest.mark.parametrize("bucket", [substring.BUCKET, 3])
def test_substrings(docs, rows, empty, monkeypatch, bucket):
    monkeypatch.setattr(substring, "BUCKET", bucket)
    want = sorted(((i, n, n - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, n, k in removed(rows)), key=repr)
    assert sorted((tuple(r) for r in substring.removal_digest(docs).collect()), key=repr) == want
    assert sum(x[2] for x in want) > 1000
    assert substring.removal_digest(empty).count() == 0


def test_substrings_cut_out(docs, rows):
    got = substring.remove_repeats(docs)
    assert got.schema == docs.schema
    want = sorted(((i, t if len(k) == n else " ".join(k)) for (i, t), (_, n, k) in zip(rows, removed(rows), strict=True)), key=repr)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == want
    assert all(r.n_chars == len(r.text or "") for r in got.collect())


def test_audio(docs, rows, empty):
    got = {r.n_bytes: r for r in audio.text_media(docs).collect()}
    for _, t in rows:
        raw = (t or "").encode()
        full = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        r = got[len(raw)]
        assert r.payload_bytes == len(full)
        if sum(len((x or "").encode()) == len(raw) for _, x in rows) == 1:
            assert r.payload_sha256 == hashlib.sha256(full).hexdigest() and r.tail_crc32 == zlib.crc32(full[-16:])
            assert r.media_sha256 == hashlib.sha256(audio.wav(audio.MULAW, full)).hexdigest()
    assert audio.text_media(empty).count() == 0


def scalar_adpcm(data):
    out = []
    for block in [data[i : i + 192] for i in range(0, len(data), 192)]:
        p, i = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        out.append(p)
        for b in block[4:]:
            for n in (b & 15, b >> 4):
                s = audio.STEPS[i]
                d = (s >> 3) + (s if n & 4 else 0) + (s >> 1 if n & 2 else 0) + (s >> 2 if n & 1 else 0)
                p = max(-32768, min(32767, p - d if n & 8 else p + d))
                i = max(0, min(88, i + audio.INDEX_CHANGE[n & 7]))
                out.append(p)
    return out


def test_audio_features_by_sample(spark):
    """The feature string against loops over single samples, and the stored columns."""
    texts = ["", "a", "Hello, telephone world! " * 9, "é" * 200, "\x00\x7f" * 300]
    small = spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in audio.text_media(small).collect()}
    kept = {r.doc_id: r for r in audio.store_pcm(audio.telephony(small), "adpcm").collect()}
    for i, t in [*enumerate(texts), (9, "")]:
        full = t.encode().ljust(max(192, -(-len(t.encode()) // 192) * 192))
        forms = [[int(audio.MULAW_TABLE[b]) for b in full], [int(audio.ALAW_TABLE[b]) for b in full], scalar_adpcm(full)]
        rms = [int(np.sqrt(sum(x * x for x in f) // len(f))) for f in forms]
        mu = forms[0]
        files = [audio.wav(audio.PCM, audio.resample(np.asarray(f, np.int16), 8000, 16000).astype("<i2").tobytes(), 16000) for f in forms]
        want = f"mulaw={rms[0]};alaw={rms[1]};adpcm={rms[2]};peak={max(map(abs, mu))};crossings={sum((a < 0) != (b < 0) for a, b in zip(mu, mu[1:]))};pcm16000=" + ",".join(f"{zlib.crc32(f):08x}" for f in files)
        assert got[i].feature == want and got[i].pcm_sha256 == hashlib.sha256(files[0]).hexdigest()
        assert bytes(kept[i].pcm) == files[2] and audio.parse_wav(bytes(kept[i].alaw))[::3] == (audio.ALAW, full)
        assert got[i].adpcm_sha256 == hashlib.sha256(bytes(kept[i].adpcm)).hexdigest()


def test_malformed_media_give_null(spark):
    ok = audio.wav(audio.ADPCM, bytes(384), block=192)
    at = ok.index(b"fmt ") + 8
    edit = lambda where, size, value: ok[: at + where] + value.to_bytes(size, "little") + ok[at + where + size :]
    bad = [edit(12, 2, 0), edit(12, 2, 2), edit(12, 2, 4), edit(4, 4, 0), edit(4, 4, 2**32 - 1), edit(2, 2, 2), edit(0, 2, 99), edit(14, 2, 7), ok[:30], ok[:-100], b"", b"RIFF", b"RIFF\0\0\0\0WAVEfmt \2\0\0\0\1\0", None]
    rows = audio.store_pcm(spark.createDataFrame([(i, f, "x") for i, f in enumerate([ok, *bad, audio.wav(audio.MULAW, b"")])], "id int, media binary, pcm string")).orderBy("id").collect()
    assert rows[0].pcm is not None and [r.pcm for r in rows[1:-1]] == [None] * len(bad)
    assert len(audio.to_pcm(bytes(rows[-1].pcm))[1]) == 0
    assert audio.store_pcm(spark.createDataFrame([], "media binary, id int")).columns == ["media", "id", "pcm"] and audio.store_pcm(spark.createDataFrame([], "media binary")).count() == 0


def test_companding_tables():
    assert audio.MULAW_TABLE[[0x00, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert audio.ALAW_TABLE[[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]


def test_adpcm_against_scalar():
    data = np.random.default_rng(2).integers(0, 256, 192 * 5).astype(np.uint8)
    out = audio.decode_adpcm(data, 192)
    for block, got in zip(data.reshape(-1, 192), out, strict=True):
        p, i = int.from_bytes(bytes(block[:2]), "little", signed=True), min(int(block[2]), 88)
        want = [p]
        for b in block[4:]:
            for n in (int(b) & 15, int(b) >> 4):
                s = audio.STEPS[i]
                d = (s >> 3) + (s >> 2) * (n & 1) + (s >> 1) * (n >> 1 & 1) + s * (n >> 2 & 1)
                p = max(-32768, min(32767, p - d if n & 8 else p + d))
                i = max(0, min(88, i + audio.INDEX_CHANGE[n & 7]))
                want.append(p)
        assert got.tolist() == want


def test_pcm_column(spark):
    tone = (np.sin(np.arange(800) / 8) * 9000).astype("<i2")
    files = [audio.wav(audio.PCM, tone.tobytes()), audio.wav(audio.MULAW, bytes(range(256)) * 2), audio.wav(audio.ADPCM, bytes(384), block=192), b"junk", None]
    rows = audio.store_pcm(spark.createDataFrame([(i, f) for i, f in enumerate(files)], "id int, media binary")).orderBy("id").collect()
    rate, pcm = audio.to_pcm(bytes(rows[0].pcm))
    assert rate == 16000 and len(pcm) == 1600 and np.abs(pcm[::2][20:-20].astype(int) - tone[20:-20]).max() < 200
    assert len(audio.to_pcm(bytes(rows[1].pcm))[1]) == 1024 and rows[3].pcm is None and rows[4].pcm is None


ODD = [" ", "  ", "\n", "\t", "\x00", "\xa0", "\x1c", "a", "don't", "é", "12", "!?", "日本", "𠀀", "</s>", "<0x0A>", "<|endoftext|>", " \n", "\r\n", "'s", "’", "▁", "▁▁", "the", "aaaa", "=====", "he he", "�", "Word,", "end.\nNext"]


@pytest.fixture(scope="module")
def texts(rows):
    rng = random.Random(4)
    return [t for _, t in rows] + ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["a" * 3000, "=-" * 2000]


def split(ids, counts):
    at = np.concatenate(([0], np.cumsum(counts)))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


def test_byte_bpe_equals_the_library(texts):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [x.ids for x in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    bpe = bytebpe.ByteBpe(bytebpe.default_path())
    assert split(*bpe.encode(pa.array(texts))) == want
    assert split(*bpe.encode(pa.array(texts[::-1]))) == want[::-1]


def test_sentencepiece_equals_the_library(texts):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = lib.encode([t or "" for t in texts], num_threads=1)
    codec = sentpiece.SentencePieceCodec(sentpiece.default_path())
    ids, counts = codec.encode(pa.array(texts))
    assert split(ids, counts) == want
    assert codec.decode_many(ids, counts) == [lib.decode(x) for x in want]
    rng = random.Random(5)
    some = [[rng.randrange(1, 400) if rng.random() < 0.7 else rng.randrange(1, 32000) for _ in range(rng.randint(0, 9))] for _ in range(3000)]
    assert [codec.decode(x) for x in some] == [lib.decode(x) for x in some]


@pytest.mark.parametrize("limits", [{}, {"SHARD_BYTES": 20_000, "FRAME_IDS": 500, "READ_FRAMES": 2}])
def test_token_shards(spark, docs, rows, empty, tmp_path, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(frames, k, v)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.asarray([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    got = frames.token_index(docs, uri=f"file://{tmp_path}/t")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    assert frames.token_index(empty, uri=f"file://{tmp_path}/e").count() == 0
    shards = frames.write_shards(docs, f"file://{tmp_path}/d")
    asked = spark.createDataFrame([(5,), (72,), (70,), (70,), (None,), (999,)], "doc_id int")
    found = sorted((r.doc_id, list(r.ids)) for r in frames.read_documents(spark, f"file://{tmp_path}/d", shards, asked).collect())
    assert found == sorted((i, [*lib.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows if i in (5, 72, 70))
    assert frames.read_documents(spark, "nowhere", [], asked).count() == 0 and sum(x[1] for x in shards) == len(rows)
    path = sorted((tmp_path / "t").glob("shard-*.zst"))[0]
    with path.open("rb") as f:
        reader = frames.ShardReader(f)
        i = int(np.argmax(reader.counts))
        assert zlib.crc32(reader.document(i)) in {x[3] for x in want}
    broken = bytearray(path.read_bytes())
    broken[10] ^= 255
    with pytest.raises(Exception):  # noqa: B017
        list(frames.ShardReader(bytes(broken)))
    assert not list((tmp_path / "t").glob("*.zst.*"))


def test_packing(docs, rows, empty):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs).collect()
    want, bins = [], defaultdict(list)
    for i, t in rows:
        ids = np.asarray([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(i, p, s, n, zlib.crc32(ids[s : s + n])) for p, (s, n) in enumerate(packing.cut(len(ids), 1024))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 1024
    assert len(bins) <= -(-sum(r.length for r in got) // 1024) + 2
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_keeps_every_capacity(rule):
    rng = random.Random(6)
    h = Counter(rng.randint(1, 100) for _ in range(5000))
    runs = packing.plan(h, 100, documents=3, attention=6000, rule=rule) if max(h) ** 2 <= 6000 else packing.plan({k: v for k, v in h.items() if k <= 77}, 100, 3, 6000, rule)
    load = defaultdict(list)
    for n, parts in runs.items():
        at = 0
        for first, bin_, offset, count in parts:
            assert first == at
            at += count
            for b in range(bin_, bin_ + count):
                assert sum(load[b]) == offset
                load[b].append(n)
    assert all(sum(x) <= 100 and len(x) <= 3 and sum(n * n for n in x) <= 6000 for x in load.values())
    with pytest.raises(ValueError):
        packing.plan({90: 1}, 100, attention=8000)


def base_counts(t):
    w, seen, dups = words(t), set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = [False] * len(w)
    for p, g in enumerate(zip(w, w[1:], w[2:], strict=False)):
        if c[g] > 1:
            hit[p : p + 3] = [True] * 3
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dups, sum(hit)


def test_weak_rules(spark, docs, rows, empty):
    got = weak_rules.judged(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=repr) == sorted(((i, *base_counts(t)) for i, t in rows), key=repr)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    odd = ["a b\na b\n\n \na b", "## x\n## x", "a a a a", "x\ty z x\ty z"]
    got = weak_rules.judged(spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [tuple(r)[1:6] for r in got] == [base_counts(t) for t in odd]
    assert weak_rules.judged(empty).count() == 0


def test_expectation_maximisation_finds_the_better_rule():
    rng = random.Random(8)
    seen = Counter()
    for _ in range(4000):
        y = rng.random() < 0.7
        seen[tuple((1 if (rng.random() < p) == y else -1) if rng.random() < 0.9 else 0 for p in (0.95, 0.9, 0.6))] += 1
    post = weak_rules.estimate(sorted(seen.items()))
    assert post[(1, 1, -1)] > 0.9 and post[(-1, -1, 1)] < 0.1 and post[(1, 1, 1)] > post[(-1, 1, 1)]


def test_licenses(spark, docs, empty):
    mit = next(t for name, t in licenses.TEXTS if name == "MIT")
    texts = ["Copyright (c) 2020 Someone\n\n" + mit.replace("sublicense", "sub-license").upper(), mit.replace(". ", ".\n   "), mit + " more", "x\nReleased under the MIT licence!\nLicensed under CC BY-NC 4.0\ny", None, ""]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r.license for r in got] == ["MIT", "MIT", None, None, None, None]
    assert [(r.notices, r.n_notices) for r in got] == [("", 0)] * 3 + [("CC-BY-NC-4.0,MIT", 2)] + [("", 0)] * 2
    assert got[4].digest is None
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty).count() == 0


@pytest.mark.parametrize("step", [1, 7, 512])
def test_nearest_examples_are_exact(monkeypatch, step):
    """Scores, votes and neighbours against plain vectors over all terms."""
    monkeypatch.setattr(toxicity, "DOCS", step)
    monkeypatch.setattr(toxicity, "POSTINGS", 50)
    rng = np.random.default_rng(9)
    word = lambda k: "abcdefgh"[k % 8] * (3 + k % 3) + "xyz"[k % 3] + chr(97 + k % 26) + chr(97 + k // 26)
    texts = [" ".join(word(k) for k in rng.integers(0, 80, rng.integers(0, 40))) for _ in range(300)] + ["", "nothing known"]
    y = rng.integers(0, 2, 302)
    terms = toxicity._terms(pa.array(texts[:300]))
    names = [(k, t) for k, part in enumerate(terms) for t in part.to_pylist()]
    spelt = lambda t: Counter(x for w in t.split() for x in [(0, w), *((k + 1, w[:n]) for k, n in enumerate(toxicity.BEGINNINGS) if len(w) > n)])
    counts = [Counter({x: n for x, n in spelt(t).items() if x in set(names)}) for t in texts]
    frequency = np.asarray([sum(x in c for c in counts) for x in names])
    index = toxicity.build(terms, toxicity.term_counts(pa.array(texts), terms), y, np.arange(302), frequency, 302, 0.5)
    toxic, other = (np.asarray([sum(x in c for c, z in zip(counts, y, strict=True) if z == v) / (y == v).sum() for x in names]) for v in (1, 0))
    mean = (toxic + other) / 2
    weight = (np.log(303 / (1 + frequency)) + 1) * (np.abs(toxic - other) / np.sqrt(mean * (1 - mean) + 1e-3) + toxicity.LEAST)
    full = np.asarray([[(1 + np.log(c[x])) * w if c[x] else 0.0 for x, w in zip(names, weight, strict=True)] for c in counts])
    norm = np.sqrt((full**2).sum(1, keepdims=True))
    full /= np.where(norm > 0, norm, 1)
    cosine = (full @ full.T)[:, index.ids]  # in the index's order
    without = np.argsort(index.ids)
    for leave in (None, without):
        who, sims = index.nearest(*index.vectors(toxicity.term_counts(pa.array(texts), terms)), k=11, without=leave)
        want = np.round(cosine, 12)
        if leave is not None:
            want[np.arange(302), leave] = -1
        best = -np.sort(-want, axis=1)[:, :11]
        assert np.allclose(sims, best, atol=1e-9) and np.allclose(np.take_along_axis(want, who, 1), best, atol=1e-9)
        votes = index.votes((who, sims))
        for i in range(302):
            w = [1 / (1.02 - min(s, 1)) if s > 0 else 0 for s in sims[i]]
            share = sum(a * index.y[j] for a, j in zip(w, who[i], strict=True)) / max(sum(w), 1e-9)
            rest = sum(a * (1 - index.y[j]) for a, j in zip(w, who[i], strict=True)) / max(sum(w), 1e-9)
            edge = 0.5 / toxicity.NEIGHBOURS
            assert votes[i] == pytest.approx(np.log((share * 0.5 + edge * 0.5) / (rest + edge)))
    index.calibrate(votes, index.y[without])
    z = np.clip(index.slope * votes + index.shift, -50, 50)
    p = 1 / (1 + np.exp(-z))
    w = np.where(index.y[without] == 1, 0.5, 1)
    t = index.y[without] * 0.998 + 0.001
    assert abs((w * (t - p)).sum() - 1e-3 * index.shift) < 1e-6  # the calibration's slope of the log loss is zero


@pytest.fixture(scope="module")
def judged(spark):
    """Half-labelled texts: poison words make toxic ones, marks make bad ones."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, labels = [], []
    for i in range(1200):
        toxic, bad = rng.random() < 0.2, rng.random() < 0.2
        w = [word() for _ in range(rng.randint(60, 120))]
        if toxic:
            for _ in range(6):
                w[rng.randrange(len(w))] = rng.choice(["vile", "foul", "rotten"])
        rows.append((i, " ".join(x + "###" if bad and rng.random() < 0.6 else x for x in w) + "."))
        if i % 2:
            labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), labels


def test_toxicity(spark, judged, docs, empty):
    texts, labelled, labels = judged
    index = toxicity.fit(texts, labelled)
    score = {r.doc_id: r.score for r in toxicity.scored(texts, index).collect()}
    held = [(score[i], t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == bool(t) for s, t in held) / len(held) > 0.97
    odd = toxicity.scored(docs, index).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.without_toxic(docs, index).schema == docs.schema
    assert toxicity.scored(empty, index).count() == 0
    blind = toxicity.fit(empty, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r.score < 0.5 for r in toxicity.scored(docs, blind).collect()} == {True}


def test_quality(spark, judged, docs, empty):
    texts, labelled, labels = judged
    net = pu_quality.fit(texts, labelled)
    assert 0.65 < net.prior < 0.95
    score = {r.doc_id: r.score for r in pu_quality.scored(texts, net).collect()}
    held = [(score[i], q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((s >= 0.7) == bool(q) for s, q in held) / len(held) > 0.95
    assert pu_quality.with_quality(docs, net).schema == docs.schema
    assert pu_quality.scored(empty, net).count() == 0
    assert pu_quality.scored(docs, pu_quality.fit(empty, spark.createDataFrame([], "doc_id bigint, quality int"))).count() == docs.count()


def test_prior_of_a_mixture():
    rng = np.random.default_rng(11)
    p, u = rng.normal(2, 1, 5000), np.r_[rng.normal(2, 1, 3500), rng.normal(-2, 1, 1500)]
    assert abs(pu_quality.class_prior(p, u) - 0.7) < 0.05


def test_pipeline(spark, judged, tmp_path):
    import corpus_pipeline

    texts, labelled, _ = judged
    full = texts.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    copies = full.where("doc_id < 100").withColumn("doc_id", F.col("doc_id") + 5000)
    at = f"file://{tmp_path}"
    full.unionByName(copies).write.parquet(f"{at}/documents.parquet")
    labelled.write.parquet(f"{at}/labels.parquet")
    docs = common.documents(spark, at)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == full.columns
        path = f"{at}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.where("doc_id >= 5000").count() == 0 and docs.count() > 500
    packed = corpus_pipeline.run(spark, at)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_sentencepiece_columns(spark, docs, rows, empty):
    """Null ids, null and empty texts, repeated rows, clashing columns and long texts, against the library."""
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = [[*lib.encode(t or ""), 2] for _, t in rows]
    got = sentpiece.encoded(docs)
    assert sorted(((r.doc_id, list(r.ids)) for r in got.collect()), key=repr) == sorted(((i, x) for (i, _), x in zip(rows, ids, strict=True)), key=repr)
    back = sentpiece.decoded(got)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=repr) == sorted(((i, lib.decode(x)) for (i, _), x in zip(rows, ids, strict=True)), key=repr)
    want = [(i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(lib.decode(x).encode()).hexdigest()) for (i, _), x in zip(rows, ids, strict=True)]
    assert sorted((tuple(r) for r in sentpiece.piece_digest(docs).collect()), key=repr) == sorted(want, key=repr)
    assert [x.count() for x in (sentpiece.encoded(empty), sentpiece.piece_digest(empty), sentpiece.decoded(sentpiece.encoded(empty)))] == [0, 0, 0]
    odd = spark.createDataFrame([(1, None), (None, []), (3, [2])], "doc_id int, ids array<int>")
    assert sorted(((r.doc_id, r.text) for r in sentpiece.decoded(odd).collect()), key=repr) == sorted([(1, None), (None, ""), (3, "")], key=repr)


def test_posterior_and_verdict(spark, docs, rows):
    """Votes by loops over the counts, expectation-maximisation document by document, and the verdict."""
    got = weak_rules.judged(docs).collect()
    measured = weak_rules.measured(docs).collect()

    def votes(m):
        n, share = m.n_words, lambda part, bad, good, whole: 0 if whole == 0 else -1 if 100 * part > bad * whole else 1 if 100 * part <= good * whole else 0
        return (
            share(m.n_symbols, 15, 4, n), 0 if m.n_lines < 3 else share(m.n_dup_lines, 30, 5, m.n_lines), share(m.n_repeat_words, 30, 10, n),
            0 if n == 0 else -1 if m.word_chars > 14 * n or m.word_chars < 2 * n else 1 if 3 * n <= m.word_chars <= 9 * n else 0, share(m.n_capitals, 30, 6, n),
            -1 if n < 20 else 1 if n >= 100 else 0, share(m.n_exclaims, 20, 2, n), 0 if n < 50 else 1 if 100 * m.n_stops >= n else -1 if m.n_stops == 0 else 0,
        )

    each = [votes(m) for m in measured]
    prior, post = 0.8, [0.0] * len(each)
    start = [{-1: 0.6, 0: 0.2, 1: 0.2}, {-1: 0.2, 0: 0.2, 1: 0.6}]
    table = [[dict(start[c]) for _ in range(8)] for c in (0, 1)]
    for _ in range(200):
        new = []
        for v in each:
            bad, good = (np.log(q) + sum(np.log(table[c][r][x]) for r, x in enumerate(v)) for c, q in ((0, 1 - prior), (1, prior)))
            new.append(1 / (1 + np.exp(bad - good)))
        if max(abs(a - b) for a, b in zip(new, post, strict=True)) < 1e-10:
            break
        post = new
        for c in (0, 1):
            for r in range(8):
                mass = {x: sum((p if c else 1 - p) for v, p in zip(each, post, strict=True) if v[r] == x) + 2 * start[c][x] for x in (-1, 0, 1)}
                table[c][r] = {x: m / sum(mass.values()) for x, m in mass.items()}
        prior = min(max((sum(post) + 4) / (len(post) + 5), 1e-3), 1 - 1e-3)
    want = sorted(((m.n_words, m.word_chars, p) for m, p in zip(measured, post, strict=True)))
    assert [x[2] for x in sorted((r.n_words, r.word_chars, r.posterior) for r in got)] == pytest.approx([x[2] for x in want], abs=1e-6)
    assert all(r.kept == (not r.base_failed and r.posterior >= 0.5) for r in got) and len(set(each)) > 5 and min(post) < 0.1 < 0.9 < max(post)


def test_sql_of_near_and_repeated_texts(spark):
    """op1 and op2 against their SQL over a whole table."""
    import duckdb

    sf, duck = "/root/testdata/sf0.001", duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for name in ("op1_near_dedup", "op2_substring_dedup"):
        df, out = queries.queries()[name](spark, sf), duck.execute(queries.oracle_sql()[name])
        names = [d[0] for d in out.description]
        assert names == df.columns and sorted(map(tuple, df.collect())) == sorted(out.fetchall())


def test_recall_of_near_duplicates(spark):
    """Every row whose id is divisible by 100 against all rows, by brute force: no link is lost."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = {i: s for i, t in rows for s in [sets_of([(i, t)], 5)[i]]}
    component = {r.doc_id: r.component_id for r in minhash.near_groups(docs).collect()}
    links = [(a, b) for a in sets if a % 100 == 0 and sets[a] for b in sets if b != a and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert len(links) >= 2 and all(component[a] == component[b] for a, b in links)


def test_queries_carry_the_contract(spark):
    sf = "/root/testdata/sf0.001"
    want = {
        "op1_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"], "op8_weak_supervision": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op3_telephony_audio": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"], "op2_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op4_token_shards": ["doc_id", "start", "n_tokens", "ids_crc32"], "op5_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op6_toxic_neighbours": ["doc_id", "held_out", "score", "predicted"], "op9_positive_unlabelled": ["doc_id", "held_out", "score", "predicted"],
        "op10_vector_best_fit": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    }
    for name, columns in want.items():
        assert queries.queries()[name](spark, sf).columns[: len(columns)] == columns
