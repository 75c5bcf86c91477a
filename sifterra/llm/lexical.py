"""Ranked lexical search by Block-Max WAND over a sharded index.

Documents are indexed in shards, each by one task, so postings are never shuffled by term.
A term's postings in a shard, ascending by document, are cut into blocks of fixed size;
gaps and frequencies are compressed, and a block's header keeps its first and last
document and its maximum impact.  The index is a Parquet table with a row for each shard
and term, so a search reads the rows of its terms alone.

A search looks at headers first.  Between two neighbouring block boundaries of a query's
terms no pointer changes its block, so the maxima of the blocks that the shallow pointers
stand on add up to one bound for the whole range of documents.  Ranges below the threshold
are jumped over; the pivot ranges that remain are taken highest bound first, and only
blocks that reach into them are decompressed.  Each raises the threshold for the ranges,
shards and partitions' parts that follow.  Scores are whole numbers and bounds are never
below them, so the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sifterra.llm.columns import blocks, text_bytes, trimmed
from sifterra.storage import discard, materialize, partitions

#: Postings of a block; bytes of text of a shard; bytes of a text that are split at once.
POSTINGS, SHARD_BYTES, SLICE = 128, 16 << 20, 4 << 20
#: Items (and terms of items) that are searched for at once; documents of the first pivot ranges
#: (each round takes twice as many) and of the last.
ITEMS, ITEM_TERMS, FIRST_PIVOT, PIVOT = 1024, 200_000, 64, 8192
#: Bytes of terms stay (A-Z lower-cased), all others separate.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_IN_TERM = np.frombuffer(TERM_BYTES, np.uint8) != 0x20
INDEX = "shard long, term binary, df long, heads binary, body binary"


def terms(raw: bytes) -> list[bytes]:
    """All terms of a UTF-8 text, in order."""
    return raw.translate(TERM_BYTES).split()


def sliced(raw: bytes, most: int = SLICE) -> Iterator[list[bytes]]:
    """The terms of a text, from slices that end where a term ends."""
    clean, lo = raw.translate(TERM_BYTES), 0
    while lo < len(clean):
        hi = len(clean) if len(clean) - lo <= most else clean.find(b" ", lo + most)
        hi = len(clean) if hi < 0 else hi
        yield clean[lo:hi].split()
        lo = hi


@dataclass(frozen=True)
class Corpus:
    """N documents with terms, L terms in all."""

    n: int
    length: int

    def norm(self, n: int) -> int:
        return 100 - 90 + (90 * n * self.n) // self.length

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.n + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)


def corpus(docs: DataFrame) -> Corpus:
    """Counts over whole texts; each block of rows is added up before it leaves its task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = length = 0
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            for lo, hi in blocks(offsets):
                inside = _IN_TERM[raw[offsets[lo] : offsets[hi]]]
                at = offsets[lo : hi + 1] - offsets[lo]
                starts = inside.copy()
                starts[1:] &= ~inside[:-1]
                first = at[:-1][at[:-1] < at[1:]]
                starts[first] = inside[first]
                each = np.diff(np.concatenate([[0], np.cumsum(starts)])[at])
                n, length = n + int((each > 0).sum()), length + int(each.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([length], pa.int64())], ["n", "length"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(trimmed(count), "n long, length long").agg(F.sum("n"), F.sum("length")).first()
    return Corpus(found[0] or 0, found[1] or 0)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each value): 7 bits a byte, low ones first, the last byte below 128."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, int(values.max(initial=0)).bit_length(), 7):
        size += values >= 1 << bits
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        out[ends[some] - size[some] + k] = (values[some] >> 7 * k & 0x7F) | np.where(size[some] > k + 1, 0x80, 0)
    return out, ends


def unpacked(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 0x80)
    if len(ends) == len(raw):
        return raw.astype(np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size, out = ends - starts + 1, np.zeros(len(ends), np.int64)
    for k in range(int(size.max())):
        some = np.flatnonzero(size > k)
        out[some] |= (raw[starts[some] + k].astype(np.int64) & 0x7F) << 7 * k
    return out


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Values of a binary column that lie one after the other in ``data``."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


class ShardBuilder:
    """Terms of documents as they come; ``rows`` has the shard's part of the index."""

    def __init__(self, corpus: Corpus, postings: int = POSTINGS) -> None:
        self.corpus, self.postings = corpus, postings
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.parts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        known, n = self.vocabulary, 0
        for words in sliced(raw):
            for w in set(words).difference(known):
                known[w] = len(known)
            self.parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            n += len(words)
        if n:
            self.ids.append(doc_id)
            self.sizes.append(n)
        self.bytes += len(raw)

    def rows(self, shard: int) -> pa.RecordBatch:
        """A row with doc_ids, norms and nulls under the null term, then one for each term.

        Documents are numbered by doc_id, so equal scores rank by number within a shard.
        """
        none = np.array([x is None for x in self.ids], bool)
        ids = np.array([x or 0 for x in self.ids], np.int64)
        order = np.lexsort((ids, none))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        norms = np.array([self.corpus.norm(self.sizes[i]) for i in order], np.int64)
        words = sorted(self.vocabulary)
        place = np.empty(len(words), np.int64)
        place[[self.vocabulary[w] for w in words]] = np.arange(len(words))
        key = place[np.concatenate(self.parts)] << 32 | np.repeat(number, self.sizes)
        self.parts = []
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tf = np.diff(np.append(first, len(key)))
        key = key[first]
        term, doc = key >> 32, key & 0xFFFFFFFF
        start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))  # of each term
        df = np.diff(np.append(start, len(term)))
        cut = np.flatnonzero((np.arange(len(term)) - np.repeat(start, df)) % self.postings == 0)  # of each block
        last = np.append(cut[1:], len(term)) - 1
        gap = np.diff(doc, prepend=0)
        gap[cut] = 0
        body, ends = packed(np.stack([gap, tf], 1).ravel())
        ends = ends[1::2]
        term_ends = ends[start + df - 1]
        before = np.concatenate([[0], term_ends[:-1]])
        heads = np.stack([doc[cut], doc[last], np.maximum.reduceat(impact(tf, norms[doc]), cut), ends[last] - before[term[cut]]], 1).astype("<i4")
        n_blocks = (df + self.postings - 1) // self.postings
        of_docs = np.concatenate([norms.view(np.uint8), none[order].view(np.uint8)])
        columns = [
            pa.array([shard] * (1 + len(words)), pa.int64()),
            pa.array([None, *words], pa.binary()),
            pa.array(np.append(len(order), df), pa.int64()),
            _binary(np.concatenate([ids[order].view(np.uint8), heads.view(np.uint8).ravel()]), 8 * len(ids) + np.append(0, 16 * np.cumsum(n_blocks))),
            _binary(np.concatenate([of_docs, body]), len(of_docs) + np.append(0, term_ends)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["shard", "term", "df", "heads", "body"])


def build_index(docs: DataFrame, counts: Corpus, shard_bytes: int = SHARD_BYTES, postings: int = POSTINGS) -> DataFrame:
    """The index (``INDEX``) of all documents that have a term; only doc_id and text are read."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = TaskContext.get().partitionId(), 0
        shard = ShardBuilder(counts, postings)
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                shard.add(doc_id, raw[offsets[i] : offsets[i + 1]].tobytes())
                if shard.bytes >= shard_bytes:
                    if shard.ids:
                        yield shard.rows(at << 32 | n)
                    shard, n = ShardBuilder(counts, postings), n + 1
        if shard.ids:
            yield shard.rows(at << 32 | n)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(build), INDEX)


class Shard:
    """The rows of one shard that a search has read: headers at hand, bodies compressed."""

    def __init__(self, rows: list[tuple[bytes | None, int, bytes, bytes]], postings: int = POSTINGS) -> None:
        self.decoded = 0  # blocks that were decompressed
        heads, bodies, self.range, at, offset, counts = [], [], {}, 0, 0, []
        for term, df, head, body in rows:
            if term is None:
                self.ids = np.frombuffer(head, np.int64)
                self.norms, self.none = np.frombuffer(body[: 8 * df], np.int64), np.frombuffer(body[8 * df :], bool)
                continue
            h = np.frombuffer(head, "<i4").reshape(-1, 4).astype(np.int64)
            ends = h[:, 3] + offset
            heads.append(np.column_stack([h[:, :3], np.concatenate([[offset], ends[:-1]]), ends]))
            counts.append(np.minimum(postings, df - postings * np.arange(len(h))))
            self.range[term] = (at, at + len(h))
            bodies.append(body)
            at, offset = at + len(h), offset + len(body)
        self.first, self.last, self.top, self.lo, self.hi = (np.concatenate(heads) if heads else np.zeros((0, 5), np.int64)).T
        self.size = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.raw = np.frombuffer(b"".join(bodies), np.uint8)

    def postings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, frequencies) of the given blocks, one after the other."""
        self.decoded += len(which)
        span = self.hi[which] - self.lo[which]
        at = np.repeat(self.lo[which] - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
        values = unpacked(self.raw[at])
        gaps, size = np.cumsum(values[0::2]), self.size[which]
        begin = np.cumsum(size) - size
        return gaps + np.repeat(self.first[which] - gaps[begin], size), values[1::2]


class Best:
    """The best rows of one item so far, and the score that a further row must reach."""

    def __init__(self, k: int) -> None:
        self.k, self.rows, self.threshold = k, [], 1

    def add(self, found: Iterable[tuple[int, bool, int]]) -> None:
        """Rows are (score, whether the doc_id is null, doc_id)."""
        self.rows = sorted([*self.rows, *found], key=lambda r: (-r[0], r[1], r[2]))[: self.k]
        if len(self.rows) == self.k:
            self.threshold = self.rows[-1][0]


def search_shard(shard: Shard, query: dict[bytes, int], best: Best) -> None:
    """Add the shard's best documents for a query's weights to ``best``."""
    mine = [(*shard.range[t], w) for t, w in query.items() if t in shard.range]
    if not mine:
        return
    block = np.concatenate([np.arange(lo, hi) for lo, hi, _ in mine])
    weight = np.repeat([w for _, _, w in mine], [hi - lo for lo, hi, _ in mine])
    first, last, top = shard.first[block], shard.last[block], shard.top[block] * weight
    # shallow pointers: between two boundaries all stand still, and their blocks' maxima add up
    edges, where = np.unique(np.concatenate([first, last + 1]), return_inverse=True)
    step = np.zeros(len(edges), np.int64)
    np.add.at(step, where, np.concatenate([top, -top]))
    bound = np.cumsum(step)[:-1]
    open_ = np.flatnonzero(bound >= best.threshold)
    open_ = open_[np.argsort(-bound[open_], kind="stable")]
    pivot = FIRST_PIVOT
    while len(open_):
        docs = np.cumsum(edges[open_ + 1] - edges[open_])
        taken = open_[: int(np.searchsorted(docs, pivot, "left")) + 1]
        pivot = min(2 * pivot, PIVOT)
        _score(shard, np.sort(taken), edges, block, weight, first, last, best)
        open_ = open_[len(taken) :]
        open_ = open_[: int(np.searchsorted(-bound[open_], -best.threshold, "right"))]


def _score(shard: Shard, ranges: np.ndarray, edges: np.ndarray, block: np.ndarray, weight: np.ndarray, first: np.ndarray, last: np.ndarray, best: Best) -> None:
    """Move the pointers into the ranges: whole scores of all their documents."""
    wanted = np.zeros(len(shard.ids) + 1, np.int64)
    np.add.at(wanted, edges[ranges], 1)
    np.add.at(wanted, edges[ranges + 1], -1)
    inside = np.cumsum(wanted)[:-1] > 0
    so_far = np.concatenate([[0], np.cumsum(inside)])
    need = np.flatnonzero(so_far[last + 1] > so_far[first])
    doc, tf = shard.postings(block[need])
    w = np.repeat(weight[need], shard.size[block[need]])
    here = inside[doc]
    doc, tf, w = doc[here], tf[here], w[here]
    score = np.zeros(len(shard.ids), np.int64)
    np.add.at(score, doc, w * impact(tf, shard.norms[doc]))
    good = np.flatnonzero(score >= best.threshold)
    if len(good) > best.k:  # numbers ascend with doc_ids, so the first of equal scores stay
        good = good[np.argsort(-score[good], kind="stable")[: best.k]]
    best.add(zip(score[good].tolist(), shard.none[good].tolist(), shard.ids[good].tolist(), strict=True))


def _item_blocks(items: DataFrame) -> Iterator[dict[int | None, set[bytes]]]:
    """Items with their distinct terms, so many at once as the driver may hold."""
    block: dict[int | None, set[bytes]] = {}
    held = 0
    for item_id, text in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id").toLocalIterator():
        if item_id not in block and (len(block) >= ITEMS or held >= ITEM_TERMS):
            yield block
            block, held = {}, 0
        mine = block.setdefault(item_id, set())
        held -= len(mine)
        mine.update(terms((text or "").encode()))
        held += len(mine)
    if block:
        yield block


def _search(index: DataFrame, counts: Corpus, items: dict[int | None, set[bytes]], k: int, postings: int) -> DataFrame:
    """(item_id, doc_id, score): the best k of each item in each partition of shards."""
    spark = index.sparkSession
    asked = sorted(set().union(*items.values()))
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in asked], "term binary"))
    found = index.join(wanted, "term", "left_semi")
    weights = {bytes(r.term): counts.weight(r.df) for r in found.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    queries = {item: {t: weights[t] for t in mine if t in weights} for item, mine in items.items()}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: Best(k) for item in queries}
        current, rows = None, []

        def close() -> None:
            if rows:
                shard = Shard(rows, postings)
                for item, query in queries.items():
                    search_shard(shard, query, best[item])

        for batch in batches:
            for shard, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if shard != current:
                    close()
                    current, rows = shard, []
                rows.append(row)
        close()
        out = [(item, None if none else doc_id, score) for item, b in best.items() for score, none, doc_id in b.rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["item_id", "doc_id", "score"])

    rows = found.unionByName(index.where("term is null")).select("shard", "term", "df", "heads", "body")
    rows = rows.repartition(partitions(spark), "shard").sortWithinPartitions("shard", "term")
    return rows.mapInArrow(trimmed(search), "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, shard_bytes: int = SHARD_BYTES, postings: int = POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0.

    ``docs`` gives doc_id and text, ``items`` item_id and text; no other column is read.
    Equal scores rank by ascending doc_id, a null one last; rows that repeat a doc_id are
    documents of their own.  Rows of one item_id (null is one too) are one item with the
    terms of all.  A null or empty text has no term: such a document is in no count and no
    result, such an item has no rows.  Empty tables give an empty result.

    Items are taken in blocks of ``ITEMS`` against all documents; only a block of them
    stands in the driver.  A shard takes the memory of ``SHARD_BYTES`` of text, or of one
    longer text.
    """
    spark = docs.sparkSession
    schema = "item_id long, rank int, doc_id long, score long"
    counts = corpus(docs)
    out = spark.createDataFrame([], schema)
    if not counts.n:
        return out
    index = materialize(build_index(docs, counts, shard_bytes, postings), "index")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    for block in _item_blocks(items):
        ranked = _search(index, counts, block, k, postings).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = out.unionByName(materialize(ranked.select("item_id", "rank", "doc_id", "score"), "ranked"))
    discard(index)
    return out
