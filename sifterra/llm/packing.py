"""Best-fit packing by minimum bin slack.

Documents become token ids (plus an end id) and are cut into pieces of at most
``CAPACITY`` tokens; only longer documents are cut, and their first piece takes the
remainder.  What decides a packing is the number of pieces of each length, at most
``CAPACITY`` counters, so the driver packs that histogram: for each bin, a bitset
subset-sum dynamic program over the lengths that are left finds the fullest feasible
combination with the longest piece, which is then removed, as often as the counters
allow.  Bins that get the same combination form a run; pieces find their bin by their
rank among the pieces of their length.

Ranks come from two levels: a row number within (length, bucket of a hash of the id),
and sums over buckets.  No length, however frequent, is gathered in one task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sifterra.llm.columns import trimmed
from sifterra.storage import materialize, partitions

CAPACITY = 1024
END_ID = 2
#: Distinct space-separated units whose ids a Python worker keeps.
CACHE_UNITS = 300_000
#: Texts on which rank file and ``tokenizers`` file must agree before the former is used.
PROBES = ("It's 2,000 km; isn't it?", " naïve café\n\n\tdef f(x):  return x**2", "Ωμέγα 漢字かな  한국어 ١٢٣ 🙂👍🏽", "aaaaaaaaaaaaaaaaaaaaaaaaa https://x.org/?a=b&c=%20 ---- ====")


class UnitTokenizer:
    """Ids of a byte-level BPE, unit by unit: those of ``tokenizers`` with
    add_special_tokens=False, so the string of a special token in a text is that token.

    The pattern of this vocabulary starts a new token at each single space that a
    non-space follows, so texts of single spaces split there and each distinct unit is
    encoded once, with the vocabulary's rank file if it is given and agrees with the
    ``tokenizers`` file on ``PROBES``.  Texts with other white space are encoded whole, and
    those that hold a special token's string by the ``tokenizers`` file alone.
    """

    def __init__(self, json_path: str, rank_path: str | None, pattern: str | None) -> None:
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        added = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = None
        self.cache: dict[str, bytes] = {}
        if rank_path:
            import base64

            import tiktoken

            with open(rank_path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            if any(self._ids(t) != self._exactly(t) for t in PROBES):
                self.fast = None

    def _exactly(self, text: str) -> bytes:
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, text: str) -> bytes:
        if self.fast is None:
            return self._exactly(text)
        try:
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        except BaseException as error:  # the rank library panics on some very long texts
            if isinstance(error, KeyboardInterrupt | SystemExit):
                raise
            return self._exactly(text)

    def encode(self, text: str) -> np.ndarray:
        """All ids of ``text`` as unsigned 32-bit integers."""
        if self.special is not None and self.special.search(text):
            return np.frombuffer(self._exactly(text), "<u4")
        units = text.split(" ")
        if "" in units or any(u[0].isspace() for u in units):
            return np.frombuffer(self._ids(text), "<u4")
        cache = self.cache
        if len(cache) > CACHE_UNITS:
            cache.clear()
        keys = [units[0], *[" " + u for u in units[1:]]]
        parts = list(map(cache.get, keys))
        if None in parts:
            for i, part in enumerate(parts):
                if part is None:
                    key = keys[i]
                    if (part := cache.get(key)) is None:
                        part = self._ids(key)
                        if len(key) < 64:
                            cache[key] = part
                    parts[i] = part
        return np.frombuffer(b"".join(parts), "<u4")


@lru_cache(maxsize=2)
def _tokenizer(json_path: str, rank_path: str | None, pattern: str | None) -> UnitTokenizer:
    return UnitTokenizer(json_path, rank_path, pattern)


def tokenize_pieces(docs: DataFrame, json_path: str, rank_path: str | None = None, pattern: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; a null text is empty."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(json_path, rank_path, pattern)
        tail = np.array([END_ID], "<u4")
        for batch in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = np.concatenate([tok.encode(text.as_py() or ""), tail])
                at, k = 0, 0
                end = len(row) % capacity or capacity
                while at < len(row):
                    ids.append(doc)
                    piece.append(k)
                    start.append(at)
                    length.append(end - at)
                    crc.append(zlib.crc32(row[at:end].tobytes()))
                    at, end, k = end, end + capacity, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, copies) whose sum is the largest that fits ``room``, by subset sums.

    Bit s of the bitset says that sum s can be made.  Lengths enter from short to long, so
    that the way back takes long ones first.
    """
    reach, layers = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted(x for x in counts if x <= room):
        left, copies = min(counts[length], room // length), 1
        while left:
            k = min(copies, left)
            layers.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left, copies = left - k, copies * 2
    at, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(layers):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= length * k
    return list(used.items())


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs (number of bins, [(length, copies in each bin)]) that hold all pieces."""
    left = {length: n for length, n in histogram.items() if n > 0}
    runs = []
    while left:
        longest = max(left)
        if 2 * min(left) > capacity:  # no two fit together
            runs.extend((n, [(length, 1)]) for length, n in sorted(left.items()))
            break
        left[longest] -= 1
        rest = fullest({x: n for x, n in left.items() if n}, capacity - longest)
        left[longest] += 1
        combo: dict[int, int] = {longest: 1}
        for length, k in rest:
            combo[length] = combo.get(length, 0) + k
        bins = min(left[length] // k for length, k in combo.items())
        for length, k in combo.items():
            left[length] -= bins * k
            if not left[length]:
                del left[length]
        runs.append((bins, sorted(combo.items(), reverse=True)))
    return runs


def slot_table(runs: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, copies in a bin, first bin, offset in a bin)."""
    rank: dict[int, int] = {}
    out, first_bin = [], 0
    for bins, combo in runs:
        offset = 0
        for length, k in combo:
            at = rank.get(length, 0)
            out.append((length, at, at + bins * k - 1, k, first_bin, offset))
            rank[length] = at + bins * k
            offset += length * k
        first_bin += bins
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` plus sequence_id and offset (gapless from 0 in each sequence).

    Needs doc_id, piece and length (1 to ``capacity``); other columns are kept, but none
    may start with ``__``.  Order of bins and ranks follows hashes of (doc_id, piece), so a
    repeated run gives the same packing; rows that are repeated share these and may swap
    places.  A null doc_id is packed like any other.  An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    kept = materialize(pieces, "pieces")
    buckets = partitions(spark) * 4
    tagged = kept.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    parts = materialize(tagged.groupBy("length", "__bucket").count(), "histogram")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    slots = slot_table(minimum_bin_slack(histogram, capacity))
    if not slots:
        return kept.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("length", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("length", "__bucket").orderBy(F.xxhash64("doc_id", "piece"), "doc_id", "piece")
    ranked = tagged.withColumn("__in", F.row_number().over(within) - 1).join(bases, ["length", "__bucket"]).withColumn("__rank", F.col("__base") + F.col("__in"))
    # runs of one length as sorted arrays: a bounded table (a run empties at least one counter)
    by_length: dict[int, list] = {}
    for length, low, _high, k, first, offset in slots:
        by_length.setdefault(length, []).append((low, k, first, offset))
    rows = [(length, [{"low": a, "k": k, "first": f, "off": o} for a, k, f, o in x]) for length, x in by_length.items()]
    table = spark.createDataFrame(rows, "length long, __runs array<struct<low:long,k:long,first:long,off:long>>")
    joined = ranked.join(F.broadcast(table), "length")
    run = F.expr("element_at(filter(__runs, r -> r.low <= __rank), -1)")
    out = joined.withColumn("__run", run).withColumns(
        {"sequence_id": F.expr("__run.first + (__rank - __run.low) div __run.k"), "offset": F.expr("__run.off + ((__rank - __run.low) % __run.k) * length")}
    )
    return out.select(*pieces.columns, "sequence_id", "offset")
