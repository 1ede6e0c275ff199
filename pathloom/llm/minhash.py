"""Near-duplicate groups: banded MinHash candidates, odd sketches, exact confirmation.

Texts with equal shingle sets form a class and one document stands for it.
Banded MinHash keys gather representatives in buckets. In each bucket a hub is
compared with every other member, never all pairs: a pair is estimated from odd
sketches (parity bitmaps of the MinHash samples, whose XOR population count
tells how many samples differ) and, where 0.8 is within reach, confirmed on the
full shingle sets. In large buckets that still span several components, members
outside the main one try a few more of its members. What is apart then is compared
in blocks: finer sketches tell which members may link to another component at all,
and the full sets of these meet in their block, which gives away a spanning forest
of the links that it finds, never its pairs. So no bucket, however large, meets in
one task, and no candidate pair of different components that may reach the
threshold goes unexamined.

Any link at the threshold is a candidate unless all 25 bands of 5 samples
differ: under 5 in 100,000 at a similarity of exactly 0.8, under 1 in a million
at 0.85.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import arrow_map, coded_words, ddl, distinct, keyed, partitions, settle, starts_of, unkeyed, word_hashes

SAMPLES, BANDS, ROWS = 128, 25, 5
#: Bits of an odd sketch, in four 64-bit words.
BITS = 256
#: XOR population count beyond which a pair is given up: at a similarity of 0.8 the mean is 42 and five deviations end here.
FAR = 80
#: Samples, bits and count of the finer sketches that block comparisons take: at 0.8 the mean is 675, five deviations end at 815 (0.75).
FINE_SAMPLES, FINE_BITS, FINE_FAR = 2048, 4096, 815
#: Members of a bucket from which it gets a second round of hubs, and hubs of that round.
LARGE, PARTNERS = 1000, 8
#: Members of a block (of smaller components, of all), bytes that a task groups at once, bytes of full sets from which a block is cut.
MINOR_BLOCK, BLOCK, GROUP_BYTES, BLOCK_BYTES = 256, 1024, 16_000_000, 64_000_000
#: Hashes that are compared at once, and bits of a hash that tell where it is marked.
AT_ONCE, MARKS = 500_000, 20
#: Links that one task may unite; more are contracted over the cluster first.
LOCAL_LINKS = 200_000
_SIGN = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("c0", pa.int64()), ("c1", pa.int64()), ("bands", pa.list_(pa.int64())), *((f"s{i}", pa.int64()) for i in range(4))])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _randoms(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_MULTIPLY, _ADD, _SALT = _randoms(FINE_SAMPLES, 1) | np.uint64(1), _randoms(FINE_SAMPLES, 2), _randoms(FINE_SAMPLES, 3)
#: XOR masks below 2^62: hubs of different bands differ, and min() over masked ids finds them.
_MASKS = [int(x >> np.uint64(2)) for x in _randoms(4, 4)]


def shingle_sets(texts: pa.Array, size: int = 4) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles; fewer words than `size` are one shingle."""
    codes, counts, vocab = coded_words(texts, lower=True)
    hashes = word_hashes(vocab)[codes]
    bounds = starts_of(counts)
    rolled = hashes.copy()
    for i in range(1, size):
        rolled = _mix(rolled[: len(hashes) - i]) + hashes[i:] if len(hashes) > i else rolled[:0]
    out = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        if b - a >= size:
            out.append(distinct(_mix(rolled[a : b - size + 1])))
        elif b > a:
            whole = hashes[a : a + 1]
            for i in range(a + 1, b):
                whole = _mix(whole) + hashes[i : i + 1]
            out.append(_mix(whole + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhashes(sets: list[np.ndarray], samples: int = SAMPLES) -> np.ndarray:
    """(sets, samples) minima; sets must not be empty."""
    flat, begin = np.concatenate(sets), starts_of(np.fromiter(map(len, sets), np.int64, len(sets)))[:-1]
    out = np.empty((samples, len(sets)), np.uint64)
    for i in range(samples):
        out[i] = np.minimum.reduceat((flat ^ _ADD[i]) * _MULTIPLY[i] >> np.uint64(20), begin)
    return out.T


def odd_sketches(samples: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(sets, bits / 64) int64: each sample flips one bit."""
    bit = (_mix(samples + _SALT[: samples.shape[1]]) >> np.uint64(48)).astype(np.int64) % bits
    flips = np.bincount((np.arange(len(samples))[:, None] * bits + bit).ravel(), minlength=len(samples) * bits)
    return np.packbits((flips & 1).astype(np.uint8).reshape(len(samples), bits), axis=1).view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """(sets, BANDS) int64."""
    part = samples[:, : BANDS * ROWS].reshape(len(samples), BANDS, ROWS)
    key = np.broadcast_to(_SALT[:BANDS], part.shape[:2]).copy()
    for i in range(ROWS):
        key = _mix(key) + part[:, :, i]
    return _mix(key).view(np.int64)


def estimate(distance: np.ndarray | int, samples: int = SAMPLES, bits: int = BITS) -> np.ndarray:
    """Similarity that an XOR population count tells."""
    return 1 + np.log(np.maximum(1 - 2 * np.asarray(distance) / bits, 1e-9)) * bits / (4 * samples)


def sign(docs: DataFrame, size: int = 4) -> DataFrame:
    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        sets = shingle_sets(batch.column("text"), size)
        full = [i for i, x in enumerate(sets) if len(x)]
        bands: list = [[]] * len(sets)
        sketch = np.zeros((len(sets), 4), np.int64)
        if full:
            samples = minhashes([sets[i] for i in full])
            sketch[full] = odd_sketches(samples)
            for i, x in zip(full, band_keys(samples), strict=True):
                bands[i] = x
        digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), np.int64).reshape(-1, 2)
        yield {"doc_id": batch.column("doc_id"), "n_shingles": [len(x) for x in sets], "c0": digest[:, 0], "c1": digest[:, 1], "bands": bands} | {f"s{i}": sketch[:, i] for i in range(4)}

    return arrow_map(docs, _SIGN, step)


def fine_sketches(texts: DataFrame, size: int = 4) -> DataFrame:
    """(rep, fine, bytes) of documents (doc_id, text) that have words; bytes: of the full set."""
    shape = pa.schema([("rep", pa.int64()), ("fine", pa.binary()), ("bytes", pa.int64())])

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        sets = shingle_sets(batch.column("text"), size)
        full = [i for i, x in enumerate(sets) if len(x)]
        for a in range(0, len(full), 256):  # a document's samples take 16 KB
            own = full[a : a + 256]
            sketch = odd_sketches(minhashes([sets[i] for i in own], FINE_SAMPLES), FINE_BITS)
            yield {"rep": batch.column("doc_id").take(pa.array(own)), "fine": [x.tobytes() for x in sketch], "bytes": [sets[i].nbytes for i in own]}

    return arrow_map(texts, shape, step).dropDuplicates(["rep"])


def full_sets(texts: DataFrame, size: int = 4) -> DataFrame:
    """(rep, shingles) of documents (doc_id, text): the whole set as 64-bit hashes."""
    shape = pa.schema([("rep", pa.int64()), ("shingles", pa.binary())])

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"rep": batch.column("doc_id"), "shingles": [x.tobytes() for x in shingle_sets(batch.column("text"), size)]}

    return arrow_map(texts, shape, step).dropDuplicates(["rep"])


def confirm(pairs: DataFrame, texts: DataFrame, threshold: int, size: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach threshold hundredths; b, the hub, may stand in very many."""

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        n = batch.num_rows
        sets = shingle_sets(pa.concat_arrays([batch.column("text"), batch.column("text_b")]), size)
        links = []
        for i in range(n):
            common = len(np.intersect1d(sets[i], sets[n + i], assume_unique=True))
            if 100 * common >= threshold * (len(sets[i]) + len(sets[n + i]) - common):
                links.append(i)
        yield {x: batch.column(x).take(pa.array(links, pa.int64())) for x in ("a", "b")}

    both = pairs.join(texts.withColumnRenamed("doc_id", "a"), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return arrow_map(both.select("a", "b", "text", "text_b"), _LINK, step).distinct()


def _unite(links: DataFrame) -> DataFrame:
    """(v, component) of at most LOCAL_LINKS links, by union-find in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in list(parent)], pa.int64())], names=["v", "component"])

    return links.select("a", "b").coalesce(1).mapInArrow(run, "v bigint, component bigint")


def components(links: DataFrame) -> DataFrame:
    """(v, component) for every end of a link: the smallest id that it reaches. links, a written table, are read again and again.

    Beyond LOCAL_LINKS links, rounds contract them: every node points to its smallest
    neighbour, pointers are followed, and links are rewritten to what their ends
    point to. What is left is united in one task.
    """
    edges = links.select("a", "b").where("a != b")
    reached = None
    while edges.count() > LOCAL_LINKS:
        both = edges.union(edges.select("b", "a"))
        point = settle(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("to")), "point")
        onward = point.select(F.col("a").alias("to"), F.col("to").alias("next"))
        point = settle(point.join(onward, "to", "left").select("a", F.coalesce("next", "to").alias("to")), "point")
        step = point.select(F.col("a").alias("v"), F.col("to").alias("component"))
        reached = step if reached is None else settle(_onto(reached, step), "reached")
        left, right = point.select("a", F.col("to").alias("x")), point.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = settle(edges.join(left, "a").join(right, "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    last = settle(_unite(edges), "united")
    return last if reached is None else settle(_onto(reached, last), "reached")


def _onto(reached: DataFrame, step: DataFrame) -> DataFrame:
    """Components led on by a later step; ends that the step does not know stay."""
    onward = step.select(F.col("v").alias("component"), F.col("component").alias("next"))
    return reached.join(onward, "component", "left").select("v", F.coalesce("next", "component").alias("component"))


def _apart(prefix_a: str, prefix_b: str) -> F.Column:
    return sum((F.bit_count(F.col(f"{prefix_a}{i}").bitwiseXOR(F.col(f"{prefix_b}{i}"))) for i in range(BITS // 64)), F.lit(0))


def _hubs(rows: DataFrame) -> DataFrame:
    """(key, hub) of buckets with two members or more."""
    mask = F.element_at(F.array(*(F.lit(x) for x in _MASKS)), F.col("pos") % len(_MASKS) + 1)
    masked = rows.select("key", "pos", F.col("rep").bitwiseXOR(mask).alias("m"))
    return masked.groupBy("key", "pos").agg(F.min("m").alias("m"), F.max("m").alias("other")).where("m != other").select("key", F.col("m").bitwiseXOR(mask).alias("hub"))


def _hub_pairs(met: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b): every member (rep) with its bucket's hub, where the sketches allow a link."""
    met = met.where("rep != hub")
    once = met.groupBy(F.least("rep", "hub").alias("lo"), F.greatest("rep", "hub").alias("hi")).agg(F.max("hub").alias("b")).select((F.col("lo") + (F.col("hi") - F.col("b"))).alias("a"), "b")
    return near(once, sketches)


def near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs that odd sketches do not rule out."""
    a = sketches.select(F.col("rep").alias("a"), *(F.col(f"s{i}").alias(f"p{i}") for i in range(4)))
    b = sketches.select(F.col("rep").alias("b"), *(F.col(f"s{i}").alias(f"q{i}") for i in range(4)))
    return pairs.join(a, "a").join(b, "b").where(_apart("p", "q") <= FAR).select("a", "b")


def _blocks(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of smaller components, rows of all, components, sketches) of each block in a table, and where its rows are."""
    block, role, component = (table.column(c).to_numpy() for c in ("block", "role", "component"))
    fine = np.frombuffer(b"".join(table.column("fine").to_pylist()), np.uint64).reshape(len(block), -1)
    order = np.argsort(block, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
        few, all_ = part[role[part] == 0], part[role[part] == 1]
        if len(few) and len(all_):
            yield few, all_, component, fine, part


def _allowed(x: int, others: np.ndarray, fine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, distance) of others that the sketches allow to be linked with x, nearest first."""
    far = np.bitwise_count(fine[others] ^ fine[x]).sum(1, dtype=np.int64)
    near_ = np.flatnonzero(far <= FINE_FAR)
    near_ = near_[np.argsort(far[near_], kind="stable")]
    return others[near_], far[near_]


def _hopeful(table: pa.Table) -> np.ndarray:
    """Which rows of a table of blocks may link to another component."""
    hit = np.zeros(table.num_rows, bool)
    for few, all_, component, fine, _ in _blocks(table):
        for x in few.tolist():
            near_, _ = _allowed(x, all_[component[all_] != component[x]], fine)
            hit[x] |= len(near_) > 0
            hit[near_] = True
    return hit


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - MARKS)).view(np.int64)


def _reach(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether two sets reach threshold hundredths."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= threshold * (len(x) + len(y) - common)


def _cut(left: DataFrame) -> DataFrame:
    """Members of blocks (role, block, bytes): blocks of more than BLOCK_BYTES are cut, so that each member still meets the same ones, each in one part."""
    of_role = lambda role: F.sum(F.when(F.col("role") == role, F.col("bytes")).otherwise(0))
    parts = lambda role: F.ceil(2 * of_role(role) / BLOCK_BYTES).cast("int")
    large = left.groupBy("block").agg(F.sum("bytes").alias("all_bytes"), parts(0).alias("ni"), parts(1).alias("nj")).where(F.col("all_bytes") > BLOCK_BYTES)
    large = large.where("ni > 0 and nj > 0").select(F.col("block").alias("whole"), "ni", "nj")
    i, j = (F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int") for salt, n in ((3, "ni"), (4, "nj")))
    of = lambda n, place: F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda k: F.xxhash64("block", *place(k)))
    places = F.when(F.col("whole").isNull(), F.array("block")).when(F.col("role") == 0, of("nj", lambda k: (i, k))).otherwise(of("ni", lambda k: (k, j)))
    return left.join(F.broadcast(large), F.col("block") == F.col("whole"), "left").withColumn("block", F.explode(places)).drop("whole", "ni", "nj")


def _forest(table: pa.Table, threshold: int) -> list[tuple[int, int]]:
    """Links (larger, smaller id) that join components in the blocks of a table: of each block at most its members less one.

    Sets are read where they lie. Marks of a member's hashes count what others share
    with it, or a few more; who may reach the threshold by that is compared in full.
    """
    rep = table.column("rep").to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    at = np.zeros(len(rep), np.int64)  # place of a row in its block
    mark = np.zeros(1 << MARKS, bool)
    out = []
    for few, all_, component, fine, part in _blocks(table):
        at[part] = np.arange(len(part))
        names, root = np.unique(component[part], return_inverse=True)
        del names
        for x in few.tolist():
            others = all_[root[at[all_]] != root[at[x]]]
            near_, _ = _allowed(x, others, fine)
            if not len(near_):
                continue
            mark[_slots(sets[x])] = True
            for some in np.split(near_, np.flatnonzero(np.diff(np.cumsum(sizes[near_]) // AT_ONCE)) + 1):
                size = sizes[some]
                hits = mark[_slots(np.concatenate([sets[y] for y in some.tolist()]))]
                both = np.add.reduceat(hits, starts_of(size)[:-1], dtype=np.int64)
                for y in some[100 * both >= threshold * (sizes[x] + size - both)].tolist():
                    mine, other = root[at[x]], root[at[y]]
                    if mine != other and _reach(sets[x], sets[y], threshold):
                        out.append((max(rep[x], rep[y]), min(rep[x], rep[y])))
                        root[root == other] = mine
            mark[_slots(sets[x])] = False
    return out


def _fewer(df: DataFrame) -> DataFrame:
    """In a quarter of the partitions: for a row of each bucket, written out, files need not be as many as tasks."""
    return df.coalesce(max(1, partitions(df.sparkSession) // 4))


def _block_links(rows: DataFrame, texts: DataFrame, threshold: int, size: int) -> DataFrame:
    """Links (a, b) between components that share a bucket: its smaller components against all, in blocks.

    Blocks of a bucket are dealt out over tasks, so no bucket meets in one. What
    leaves them is linear in their members: first the members that sketches give a
    chance, then, where their full sets are not too large for one task, else in
    parts of the block, a spanning forest of the links that the full sets confirm.
    """
    spark = rows.sparkSession
    each = rows.groupBy("key", "component").count()
    keys = each.groupBy("key").agg(F.max_by("component", "count").alias("main"), F.sum("count").alias("n"), F.max("count").alias("most"))
    keys = settle(_fewer(keys).select("key", "main", F.ceil((F.col("n") - F.col("most")) / MINOR_BLOCK).cast("int").alias("ni"), F.ceil(F.col("n") / BLOCK).cast("int").alias("nj"), (F.col("n") * F.ceil((F.col("n") - F.col("most")) / MINOR_BLOCK) + (F.col("n") - F.col("most")) * F.ceil(F.col("n") / BLOCK)).alias("sent")), "buckets")
    i, j = (F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int") for salt, n in ((1, "ni"), (2, "nj")))  # int as the sequence below: hashes tell types apart
    of = lambda role, own, other, n: F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda k: F.struct(F.lit(role).alias("role"), F.xxhash64("key", *((own, k) if role == 0 else (k, own))).alias("block")))
    places = F.when(F.col("component") != F.col("main"), F.concat(of(0, i, j, "nj"), of(1, j, i, "ni"))).otherwise(of(1, j, i, "ni"))
    dealt = rows.join(keys, "key").select("rep", "component", F.explode(places).alias("p")).select("rep", "component", "p.role", "p.block")
    open_texts = texts.join(rows.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    fine = settle(fine_sketches(open_texts, size), "fine")

    def grouped(df: DataFrame, bytes_: int, run, shape: pa.Schema) -> DataFrame:
        groups = max(4 * partitions(spark), -(-bytes_ // GROUP_BYTES))
        return df.groupBy(F.pmod("block", F.lit(groups)).alias("g")).applyInArrow(run, ddl(shape))

    member = pa.schema([("rep", pa.int64()), ("component", pa.int64()), ("role", pa.int32()), ("block", pa.int64()), ("bytes", pa.int64())])

    def hopeful(table: pa.Table) -> pa.Table:
        return table.select(member.names).filter(pa.array(_hopeful(table))).cast(member)

    def forest(table: pa.Table) -> pa.Table:
        found = _forest(table, threshold)
        return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=_LINK)

    sent = keys.agg(F.sum("sent")).first()[0] or 0
    left = settle(grouped(dealt.join(fine, "rep"), sent * FINE_BITS // 8, hopeful, member), "hopeful")
    sets = settle(full_sets(open_texts.join(left.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), size), "sets")
    left = _cut(left)
    total = left.agg(F.sum(F.col("bytes") + FINE_BITS // 8)).first()[0] or 0
    return grouped(left.drop("bytes").join(sets, "rep").join(fine.drop("bytes"), "rep"), total, forest, _LINK).distinct()


def _more_hub_pairs(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b): in large buckets, members outside the main component with PARTNERS members of it, where the sketches allow a link."""
    each = rows.groupBy("key", "component").count()
    keys = each.groupBy("key").agg(F.max_by("component", "count").alias("main"), F.sum("count").alias("n")).where(F.col("n") >= LARGE)
    at = rows.join(keys.select("key", "main"), "key")
    chosen = F.array(*(F.min_by("rep", F.xxhash64("rep", F.lit(salt))) for salt in range(PARTNERS)))
    hubs = at.where("component = main").groupBy("key").agg(chosen.alias("hubs"))
    pairs = at.where("component != main").join(hubs, "key").select(F.col("rep").alias("a"), F.explode(F.array_distinct("hubs")).alias("b"))
    return near(pairs.distinct(), sketches)


def near_groups(docs: DataFrame, threshold: int = 80, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Columns doc_id and text are read, others left aside. A document without words
    (null, empty, white space) has an empty set and is alone. Rows of one doc_id are
    one document, each with its own row in the result; null ids are one document
    that sorts last. Texts of any length count whole. An empty table gives an empty
    result.
    """
    base = keyed(docs)
    signed = settle(sign(base, size), "signed")
    full = signed.where("n_shingles > 0")
    classes = settle(full.groupBy("c0", "c1").agg(F.min("doc_id").alias("rep")), "classes")
    # An id with different texts ties their classes together.
    twofold = full.groupBy("doc_id").agg(F.min(F.struct("c0", "c1")).alias("x"), F.max(F.struct("c0", "c1")).alias("y")).where("x <> y").select("doc_id")
    tied = full.join(twofold, "doc_id", "left_semi").join(classes, ["c0", "c1"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    reps = settle(full.join(classes, ["c0", "c1"]).where("doc_id = rep").drop("c0", "c1", "doc_id", "n_shingles"), "reps")
    sketches = reps.select("rep", "s0", "s1", "s2", "s3")
    banded = reps.select("rep", F.posexplode("bands").alias("pos", "key"))
    # Only members of buckets that hold two documents or more go on, and only their texts.
    rows = settle(banded.join(_hubs(banded), "key"), "members")
    texts = settle(base.join(rows.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "texts")

    def apart(members: DataFrame, comps: DataFrame) -> DataFrame:
        """Members of buckets that span several components; two members have met their hub."""
        at = members.select("rep", "key").join(comps.withColumnRenamed("v", "rep"), "rep", "left").select("rep", "key", F.coalesce("component", "rep").alias("component"))
        each = at.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.count("*").alias("parts"))
        return settle(at.join(settle(_fewer(each.where((F.col("parts") > 1) & (F.col("n") > 2)).select("key")), "open"), "key"), "apart")

    links = settle(confirm(_hub_pairs(rows, sketches), texts, threshold, size), "links").union(settle(tied, "tied"))
    comps = components(links)
    rows = apart(rows, comps)
    for more in (lambda: confirm(_more_hub_pairs(rows, sketches), texts, threshold, size), lambda: _block_links(rows, texts, threshold, size)):
        if rows.isEmpty():
            break
        found = settle(more(), "links")
        if not found.isEmpty():
            links = links.union(found)
            comps = components(links)
            rows = apart(rows, comps)
    group = classes.join(comps, classes.rep == comps.v, "left").select("c0", "c1", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "c0", "c1").join(settle(group, "groups"), ["c0", "c1"], "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select(unkeyed(), "n_shingles", F.nullif(own, F.lit(2**63 - 1)).alias("component_id"), (own == F.col("doc_id")).alias("kept"))
