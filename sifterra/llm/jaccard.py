"""N-gram Jaccard join with PartEnum signatures (similarity 0.8 of 5-word shingle sets).

Sets whose sizes fall in one band (u/2, u], plus those of the band below that are within
a factor 1.25 of u, meet in one instance.  Two such sets a, b with Jaccard >= 0.8 differ
in at most (|a| + |b|) / 9 <= |a| / 4 elements.  The feature domain (64-bit shingle
hashes) is split by hash into n1 = 0.4 u + 3 partitions; by the pigeonhole principle,
among any floor(|a| / 4) + 1 non-empty partitions of a one has the same content in b.
A signature is the content of a partition.  All sets take their partitions in one
common order, so it is enough that each set emits its first floor(|a| / 4) + 1 of
them: the set whose list ends earlier in that order has an agreeing one that the other
emits too.  (This is PartEnum with one level of partitions; a second level would only
add signatures here.)  The order puts signatures made of frequent shingles last; which
shingles are frequent comes from a bounded sample and affects speed, never results.
A set with too few non-empty partitions emits all it has and again under the next of
``SEEDS`` partitionings, and after the last one a signature of its band.

Candidates are checked exactly.  Small groups with a common signature give all their
pairs; larger ones give a star to one member, and what the star has not united is
screened further in tasks of bounded size.  Before sets are compared, parity sketches
(a bit for each of about 2 |a| hash buckets) bound their difference from below, which
rejects most candidates.  Sets are identified by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifterra.llm.columns import blocks, text_bytes, trimmed
from sifterra.operators.components import connected_components
from sifterra.storage import discard, materialize, partitions

WORDS = 5
SEEDS = 6
#: Groups up to this size give all pairs; a task of the large groups holds so many sets.
SMALL_GROUP, GROUP_BLOCK = 40, 2048
#: Rounds of large groups that pass only so many nearest sets of each set.
NEAREST, NEAREST_ROUNDS = 2, 2
#: The sample that says which shingles are frequent: texts, and texts a shingle is in.
SAMPLE_TEXTS, SAMPLE_HITS = 2000, 3
#: Rows of ``documents`` for each bucket of signatures.
ROWS_PER_BUCKET = 3000

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_PLACE = _RANDOM.integers(1, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    if size not in _POWERS:
        ones = [np.full(size, b, np.uint64) for b in (_BASE, _INVERSE)]
        for x in ones:
            x[0] = 1
        _POWERS.clear()
        _POWERS[size] = tuple(np.multiply.accumulate(x) for x in ones)
    return _POWERS[size]


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of texts raw[at[i]:at[i + 1]], and each text's first word."""
    word = ~_SPACE[raw]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    inner = at[1:-1][at[1:-1] < len(raw)]
    begin[inner] = word[inner]  # a text starts a word of its own
    starts = np.flatnonzero(begin)
    ends_of = np.zeros(len(raw) + 1, bool)
    ends_of[1:] = word
    ends_of[1:-1] &= ~word[1:] | begin[1:]
    ends = np.flatnonzero(ends_of)
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    h = _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, at)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending: (values, offsets).

    Words are lower-cased in A-Z and split at space and 0x09-0x0D.  Fewer than WORDS words
    make one shingle of the whole sequence; none make an empty set.
    """
    raw, at = text_bytes(column)
    values, sizes = [], []
    for lo, hi in blocks(at):
        h, first = word_hashes(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        n = np.diff(first)
        if len(h) >= WORDS:
            rolled = h[: len(h) - WORDS + 1] * _PLACE[0]
            for k in range(1, WORDS):
                rolled = rolled + h[k : len(h) - WORDS + 1 + k] * _PLACE[k]
            rolled = _mix(rolled)
        for a, k in zip(first.tolist(), n.tolist(), strict=False):
            if k >= WORDS:
                s = np.sort(rolled[a : a + k - WORDS + 1])
                if len(s) > 1:
                    keep = np.empty(len(s), bool)
                    keep[0] = True
                    np.not_equal(s[1:], s[:-1], out=keep[1:])
                    s = s[keep]
            elif k:
                s = _mix(np.array([(h[a : a + k] * _PLACE[:k]).sum() + np.uint64(k)], np.uint64))
            else:
                s = h[:0]
            values.append(s)
            sizes.append(len(s))
    return (np.concatenate(values) if values else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def set_keys(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit key of each set; 0 for the empty one."""
    n = np.diff(at)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_mix(values ^ _BASE), dtype=np.uint64)])
    key = _mix((total[at[1:]] - total[at[:-1]]) + n.astype(np.uint64) * _INVERSE)
    return np.where(n > 0, np.maximum(key, 1), 0).astype(np.uint64)


def parity_sketch(s: np.ndarray) -> bytes:
    """One bit for each of about 2 |s| hash buckets: the parity of its elements.

    The number of bits in which the sketches of two sets differ is at most the number of
    elements in which the sets do."""
    width = 1 << max(6, (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """Lower bound of the elements in which two sets differ; the longer sketch is folded."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _instances(size: int) -> list[int]:
    """Upper bounds u of the bands where a set of this size takes part."""
    u = 1 << (size - 1).bit_length()
    return [u, 2 * u] if 5 * size > 4 * u else [u]


def signatures(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """PartEnum signatures of one set (sorted distinct hashes)."""
    size = len(s)
    need = size // 4 + 1
    if size < 4:  # a different set of similarity 0.8 has at least 4 or 5 elements
        return s[:0]
    rare = None
    out = []
    for u in _instances(size):
        n1 = int(0.4 * u) + 3
        for seed in range(SEEDS + 1):
            tag = np.uint64(u * 64 + seed)
            if seed == SEEDS:
                out.append(_mix(np.array([tag], np.uint64)))
                break
            mixed = _mix(s + _mix(np.array([tag], np.uint64)))
            cell = ((mixed >> np.uint64(32)) * np.uint64(n1)) >> np.uint64(32)
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            new = np.empty(size, bool)
            new[0] = True
            np.not_equal(cell[1:], cell[:-1], out=new[1:])
            heads = np.flatnonzero(new)
            content = _mix(np.add.reduceat(mixed[order], heads) + cell[heads] * _BASE + tag)
            if len(heads) <= need:
                out.append(content)
            else:
                if rare is None and len(frequent):
                    spot = np.searchsorted(frequent, s)
                    rare = frequent[np.minimum(spot, len(frequent) - 1)] != s
                # the common order: signatures with a rare shingle first, then by hash
                late = ~np.logical_or.reduceat(rare[order], heads) if rare is not None else np.zeros(len(heads), bool)
                rank = (content >> np.uint64(1)) | (late.astype(np.uint64) << np.uint64(63))
                out.append(content[np.argpartition(rank, need - 1)[:need]])
            if len(heads) >= need:
                break
    return np.concatenate(out)


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles of at least SAMPLE_HITS of SAMPLE_TEXTS sampled texts (bounded): the texts are
    read by executors, the driver gets hashes."""
    texts = docs.where(F.octet_length("text") < 100_000).select("text").limit(SAMPLE_TEXTS * 4).orderBy(F.xxhash64("text")).limit(SAMPLE_TEXTS)
    each = shingle_arrays(texts).select(F.explode("shingles").alias("s")).groupBy("s").count().where(F.col("count") >= SAMPLE_HITS)
    return np.sort(each.select("s").toArrow()["s"].combine_chunks().to_numpy().view(np.uint64))


_MADE = "kind int, bucket int, a long, b long, c long, h long, sigs binary, keys binary"
_NAMES = ["kind", "bucket", "a", "b", "c", "h", "sigs", "keys"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
_DOC, _SIG, _PAIR, _MEMBER = 0, 1, 2, 3


def _rows(n: int, **given) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(given[k], t) if k in given else pa.nulls(n, t) for k, t in zip(_NAMES, _TYPES, strict=True)], _NAMES)


def _emit(frequent, n_buckets: int, flush_at: int = 1 << 19):
    """Map side: a row for each document, and signatures of distinct sets by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, keys, count = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, keys, count
            sig = np.concatenate(held)
            key = np.repeat(np.array(keys, np.uint64), [len(x) for x in held])
            bucket = (sig % np.uint64(n_buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            sig, key, bucket = sig[order], key[order], bucket[order]
            cut = np.flatnonzero(np.diff(bucket)) + 1
            at = [0, *cut.tolist(), len(sig)]
            held, keys, count = [], [], 0
            return _rows(len(at) - 1, kind=np.full(len(at) - 1, _SIG, np.int32), bucket=bucket[at[:-1]], sigs=[sig[i:j].tobytes() for i, j in zip(at, at[1:])], keys=[key[i:j].tobytes() for i, j in zip(at, at[1:])])

        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                values, at = shingle_sets(part.column(1))
                key = set_keys(values, at)
                doc = part.column(0)
                salt = (_mix(key + np.arange(lo, lo + len(key)).astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int32)
                yield _rows(len(key), kind=np.full(len(key), _DOC, np.int32), bucket=salt, a=doc, b=np.diff(at), c=key.view(np.int64), h=part.column(2), sigs=[parity_sketch(values[i:j]) for i, j in zip(at[:-1], at[1:])])
                for i, k in enumerate(key.tolist()):
                    if k and k not in seen:
                        seen.add(k)
                        sig = signatures(values[at[i] : at[i + 1]], frequent.value)
                        if len(sig):
                            held.append(sig)
                            keys.append(k)
                            count += len(sig)
                if count >= flush_at:
                    yield flush()
        if count:
            yield flush()

    return run


def _collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: pairs of small groups, stars and members of large ones."""
    sigs, keys = [], []
    for batch in batches:
        kind = batch.column(0).to_numpy()
        mine = batch.filter(pa.array(kind == _DOC))
        if len(mine):
            yield mine
        for s, k in zip(batch.column(6), batch.column(7), strict=True):
            if k.is_valid:
                sigs.append(np.frombuffer(s.as_py(), np.uint64))
                keys.append(np.frombuffer(k.as_py(), np.uint64))
    if not sigs:
        return
    sig, key = np.concatenate(sigs), np.concatenate(keys)
    del sigs, keys
    order = np.argsort(sig)
    sig, key = sig[order], key[order]
    same = sig[1:] == sig[:-1]
    near = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    sig, key = sig[near], key[near]
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    if not len(sig):
        return
    fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])])
    sig, key = sig[fresh], key[fresh]
    head = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(head, len(sig)))
    left, right, member = [], [], []
    for g in range(2, SMALL_GROUP + 1):
        at = head[size == g]
        for i in range(g):
            for j in range(i + 1, g):
                left.append(key[at + i])
                right.append(key[at + j])
    large = size > SMALL_GROUP
    for h, g in zip(head[large].tolist(), size[large].tolist(), strict=True):
        left.append(np.full(g - 1, key[h]))
        right.append(key[h + 1 : h + g])
        member.append(np.arange(h, h + g))
    a, b = np.concatenate([*left, sig[:0]]), np.concatenate([*right, sig[:0]])
    if len(a):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        a, b = a[fresh].view(np.int64), b[fresh].view(np.int64)
        for lo in range(0, len(a), 50_000):
            n = len(a[lo : lo + 50_000])
            yield _rows(n, kind=np.full(n, _PAIR, np.int32), a=a[lo : lo + n], b=b[lo : lo + n])
    if member:
        m = np.concatenate(member)
        for lo in range(0, len(m), 50_000):
            at = m[lo : lo + 50_000]
            yield _rows(len(at), kind=np.full(len(at), _MEMBER, np.int32), a=sig[at].view(np.int64), b=key[at].view(np.int64))


def _linked(inter, na, nb):
    return 100 * inter >= 80 * (na + nb - inter)


def _screen(nearest: int):
    """Pairs of different components in one block of a large group (or between two blocks of
    it) whose sketches leave them a chance; if ``nearest``, of each set only so many with the
    least bounds.  Rows: (task, set_key, n, comp, sketch), sorted by task."""

    def pairs(members: list) -> tuple[np.ndarray, np.ndarray]:
        width = min(len(m[3]) for m in members)
        rows = []
        for m in members:
            x = np.frombuffer(m[3], np.uint8)
            while len(x) > width:
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            rows.append(x)
        sketch = np.stack(rows)
        key, n, comp = (np.array([m[k] for m in members], np.int64) for k in range(3))
        left, right = [], []
        for i in range(len(members)):
            other = np.flatnonzero(comp != comp[i]) if nearest else np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
            differ = np.maximum(np.bitwise_count(sketch[other] ^ sketch[i]).sum(1, dtype=np.int64), np.abs(n[other] - n[i]))
            fit = 9 * differ <= n[other] + n[i]
            near, differ = other[fit], differ[fit]
            if nearest and len(near) > nearest:
                near = near[np.argpartition(differ, nearest - 1)[:nearest]]
            left.append(np.full(len(near), key[i]))
            right.append(key[near])
        return np.concatenate(left), np.concatenate(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, members = None, []

        def solve() -> Iterator[pa.RecordBatch]:
            if len(members) > 1:
                a, b = pairs(members)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            for t, *m in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if t != task:
                    yield from solve()
                    task, members = t, []
                members.append(m)
        yield from solve()

    return run


def shingle_arrays(docs: DataFrame) -> DataFrame:
    """(set_key, n, shingles) of each row of (doc_id, text); the array is sorted as unsigned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                values, at = shingle_sets(batch.slice(lo, 1024).column(0))
                key = set_keys(values, at).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))], ["set_key", "n", "shingles"])

    return docs.select("text").mapInArrow(trimmed(run), "set_key long, n long, shingles array<long>")


#: Candidate ids (8 bytes each) up to this number are broadcast, more are joined.
MAX_BROADCAST_IDS = 500_000


def _sets_of(docs: DataFrame, info: DataFrame, wanted: DataFrame) -> DataFrame:
    """Shingle arrays that hold those of the sets in ``wanted`` (set_key), read again from
    one document of each (or, where ids are null, from those rows); others may be among
    them, and where ids are repeated a set may come twice."""
    ids = materialize(info.join(wanted, "set_key", "left_semi").select("doc_id").distinct(), "ids")
    n = ids.count()
    found = docs.join(F.broadcast(ids) if n <= MAX_BROADCAST_IDS else ids, "doc_id", "left_semi")
    if ids.where("doc_id is null").limit(1).count():
        found = found.unionAll(docs.where("doc_id is null"))
    return shingle_arrays(found)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, na, nb, sketch of a, sketch of b): at least how much the sets differ."""
    for batch in batches:
        na, nb = (batch.column(i).to_numpy() for i in (2, 3))
        by_sketch = np.array([least_difference(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5), strict=True)], np.int64)
        differ = np.maximum(by_sketch, np.abs(na - nb)) if len(na) else by_sketch
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(differ)], ["a", "b", "na", "nb", "differ"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pivot, block, set_key, shingles) sorted so that the pivot's own set comes first
    in its block: intersection of each of the others with it."""
    place, pivot = None, None
    for batch in batches:
        a, b, na, nb, inter = [], [], [], [], []
        for p, k, m, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            own = s.values.to_numpy().view(np.uint64)
            if (p, k) != place:
                place, pivot = (p, k), own
            if m != p:
                spot = np.minimum(np.searchsorted(pivot, own), len(pivot) - 1)
                a.append(p)
                b.append(m)
                na.append(len(pivot))
                nb.append(len(own))
                inter.append(int((pivot[spot] == own).sum()))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, na, nb, inter)], ["a", "b", "na", "nb", "i"])


def _checked(spark: SparkSession, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, i) of each pair: sizes and intersection.  The sets of the second ends go
    to the first end's task; a first end of many pairs is split in blocks."""
    split = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP_BLOCK).alias("k"))
    blocked = pairs.join(split, "a").select(F.col("a").alias("pivot"), F.pmod(F.xxhash64("b"), F.col("k")).alias("block"), F.col("b").alias("set_key"))
    own = blocked.select("pivot", "block").distinct().withColumn("set_key", F.col("pivot"))
    members = blocked.unionAll(own)
    rows = members.join(sets.select("set_key", "shingles"), "set_key").withColumn("__other", F.col("pivot") != F.col("set_key"))
    rows = rows.repartition(partitions(spark), "pivot", "block").sortWithinPartitions("pivot", "block", "__other")
    return rows.select("pivot", "block", "set_key", "shingles").mapInArrow(trimmed(_compare), "a long, b long, na long, nb long, i long")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    Rows link when 100 * |intersection| >= 80 * |union| of their 5-word shingle sets;
    component_id is the smallest doc_id that can be reached, the own one included.  Only
    doc_id and text are read.  A null or empty text, or one of white space, has an empty
    set, links with nothing and is its own component.  A null doc_id is never a
    component_id (null where there is no other), though its text links others.  Repeated
    rows give repeated results.  An empty table gives an empty one.
    """
    rows, of_set = _components(docs)
    lows = of_set.groupBy("comp").agg(F.min("least.doc_id").alias("component_id"))
    # written, so that adaptive execution can split the rows of a frequent set in the join
    named = materialize(of_set.join(lows, "comp").select("key", "component_id"), "components")
    out = rows.join(named, "key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("key") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, key, h) of ``docs``, h the hash of the text, and one row (key,
    comp, least) for each set that is not empty: its component and, of its rows, the least
    (doc_id is null, doc_id, h)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = docs.count()
    buckets = partitions(spark, -(-n // ROWS_PER_BUCKET))
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs))
    emitted = docs.withColumn("h", F.xxhash64("text")).mapInArrow(trimmed(_emit(frequent, buckets)), _MADE)
    made = materialize(emitted.repartition(buckets, "bucket").mapInArrow(trimmed(_collide), _MADE), "signatures")
    frequent.destroy()
    rows = made.where(F.col("kind") == _DOC).select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("key"), "h")
    pairs = materialize(made.where(F.col("kind") == _PAIR).select("a", "b").distinct(), "pairs")
    members = made.where(F.col("kind") == _MEMBER).select(F.col("a").alias("sig"), F.col("b").alias("set_key"))
    wanted = pairs.select(F.col("a").alias("set_key")).unionAll(pairs.select(F.col("b").alias("set_key"))).distinct()
    info = made.where(F.col("kind") == _DOC).select(F.col("a").alias("doc_id"), F.col("b").alias("n"), F.col("c").alias("set_key"), F.col("sigs").alias("sketch"))
    # copies are counted together before the join, so that a frequent set is no hot key
    info = info.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("sketch").alias("sketch"))
    info = materialize(info.join(wanted, "set_key", "left_semi"), "info")
    x = info.select(F.col("set_key").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    y = info.select(F.col("set_key").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "ka", "kb")
    bounded = materialize(both.mapInArrow(trimmed(_bounded), "a long, b long, na long, nb long, differ long"), "bounded")
    discard(pairs)
    near = bounded.where("9 * differ <= na + nb").select("a", "b")
    wanted = near.select(F.col("a").alias("set_key")).unionAll(near.select(F.col("b").alias("set_key"))).distinct()
    links = materialize(_links(_checked(spark, near, _sets_of(docs, info, wanted))), "links")
    discard(bounded)
    comp = materialize(connected_components(links), "labels")
    discard(links)
    if members.limit(1).count():
        comp = _large_groups(docs, info, members, comp)
    of_row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    least = rows.where("key <> 0").groupBy("key").agg(F.min(of_row).alias("least"))
    of_set = least.join(comp, least["key"] == comp["node"], "left").select("key", F.coalesce("component", "key").alias("comp"), "least")
    return rows, materialize(of_set, "sets")


def _united(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, component) after further links: only the labels' own components are
    searched again."""
    ends = links
    for end in ("src", "dst"):
        label = comp.select(F.col("node").alias(end), F.col("component").alias("__c"))
        ends = ends.join(label, end, "left").withColumn(end, F.coalesce("__c", end)).drop("__c")
    moved = connected_components(ends).select(F.col("node").alias("component"), F.col("component").alias("__to"))
    kept = comp.join(moved, "component", "left").select("node", F.coalesce("__to", "component").alias("component"))
    new = moved.join(comp, moved["component"] == comp["node"], "left_anti").select(F.col("component").alias("node"), F.col("__to").alias("component"))
    out = materialize(kept.unionAll(new), "labels")
    discard(comp)
    return out


def _large_groups(docs: DataFrame, info: DataFrame, members: DataFrame, comp: DataFrame) -> DataFrame:
    """Labels ``comp`` after the links of the large groups that the stars have not found.

    Groups within one component are done.  In the others sets of different components are
    screened by their sketches, in tasks of two blocks at most, and what passes is compared
    like other candidates.  The first rounds pass only the ``NEAREST`` sets of each set, in
    its largest group, which unites most of what belongs together with a few rows for each
    set; the last round passes all pairs of what are then different components.
    """
    spark = members.sparkSession
    for nearest in (*[NEAREST] * NEAREST_ROUNDS, 0):
        named = members.join(comp, members["set_key"] == comp["node"], "left").select("sig", "set_key", F.coalesce("component", "set_key").alias("comp"))
        # groups with the same members are screened once
        prints = named.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("set_key").cast("decimal(38,0)")).alias("sum"), F.sum(F.xxhash64(F.lit(7), "set_key").cast("decimal(38,0)")).alias("sum2"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
        once = prints.groupBy("size", "sum", "sum2").agg(F.min("sig").alias("sig")).select("sig", "size")
        rows = materialize(named.join(once, "sig"), "groups")
        if not rows.limit(1).count():
            discard(rows)
            break
        some = rows
        if nearest:
            some = rows.groupBy("set_key").agg(F.max_by(F.struct("sig", "comp", "size"), F.struct("size", "sig")).alias("x")).select("x.sig", "set_key", "x.comp", "x.size")
        n_blocks = F.ceil(F.col("size") / GROUP_BLOCK).cast("int")
        # a set goes to each pair of blocks that has its own
        own = F.pmod(F.xxhash64("set_key"), n_blocks).cast("int")
        dealt = some.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
        dealt = dealt.select(F.xxhash64("sig", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "set_key", "comp")
        tasks = dealt.join(info.select("set_key", "n", "sketch"), "set_key").repartition(partitions(spark), "task").sortWithinPartitions("task")
        near = materialize(tasks.select("task", "set_key", "n", "comp", "sketch").mapInArrow(trimmed(_screen(nearest)), "a long, b long").distinct(), "screened")
        discard(rows)
        wanted = near.select(F.col("a").alias("set_key")).unionAll(near.select(F.col("b").alias("set_key"))).distinct()
        links = materialize(_links(_checked(spark, near, _sets_of(docs, info, wanted))), "links")
        discard(near)
        comp = _united(comp, links)
        discard(links)
    return comp


def _links(checked: DataFrame) -> DataFrame:
    return checked.where(_linked(F.col("i"), F.col("na"), F.col("nb"))).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, that represent their component: of each one row, that
    of the smallest doc_id (null ids last; of equal ids the one of the least text hash).

    Rows whose text has no words link with nothing and all stay.  Of rows that agree in id
    and text the one whose other columns come first as JSON stays.
    """
    rows, of_set = _components(docs)
    first = of_set.groupBy("comp").agg(F.min("least").alias("x")).select(F.col("x.doc_id").alias("__id"), F.col("x.h").alias("__h"))
    same = rows.where("key <> 0").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("__n"))
    first = materialize(first.join(same, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__h") == F.col("h"))).select("__id", "__h", "__n"), "kept")
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    wordless = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    mine = F.col("id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__h"))
    kept = named.where(~wordless).join(first, mine).select("row", "id", "__h", "__n")
    out = kept.where("__n = 1").select("row").unionAll(named.where(wordless).select("row"))
    if first.where("__n > 1").limit(1).count():
        repeated = kept.where("__n > 1").groupBy("id", "__h").agg(F.min_by("row", F.to_json("row")).alias("row"))
        out = out.unionAll(repeated.select("row"))
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns])
