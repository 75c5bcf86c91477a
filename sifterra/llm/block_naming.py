"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of fixed size.  All distinct blocks are sorted and
numbered: a block's number is its name.  Then adjacent names are paired, distinct pairs
are sorted and numbered again, level by level, until each document is one name.  Two
documents that end at the same level with the same name have the same tree of names, so
the same blocks: the identity has no collisions.  Equal texts are never compared pair by
pair, and each level is a distinct and an equi-join over half the rows of the last one.

Texts are shuffled once (distinct blocks, after partial aggregation, so that copies of a
block leave a task once).  Names find their way back by a 128-bit address of the block
instead of the block itself; the addresses of all distinct blocks are checked to be
distinct, and if two were alike, addresses of the next seed are taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifterra.storage import discard, materialize

#: Bytes of a block.
BLOCK_BYTES = 2048
#: White space that becomes a space.
_SPACES = "\t\n\x0b\f\r"
#: The other name of a pair whose second block is missing; names are 0 or more.
NONE = -1
MAX_SEEDS = 16


def normalized(text: Column) -> Column:
    """Each run of white space is one space; null is empty.  Plain replacements do nearly all
    of it; only texts that then hold two spaces in a row meet a regular expression."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in _SPACES:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.when(out.contains("  "), F.regexp_replace(out, " {2,}", " ")).otherwise(out)


def addresses(block: Column, seed: int) -> tuple[Column, Column]:
    """Two 64-bit hashes of a block under a seed."""
    return F.xxhash64(F.lit(2 * seed), block), F.xxhash64(F.lit(2 * seed + 1), block)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it (an outer
    expression within a lambda would be computed for each element)."""
    return F.transform(F.array(value), use)[0]


def _blocks(raw: Column, size: int) -> Column:
    """Fixed-size pieces of a binary value; an empty one is one empty piece."""
    last = F.floor((F.greatest(F.octet_length(raw), F.lit(1)) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(raw, i * size + 1, F.lit(size)))


def _numbered(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys, sorted within hash partitions and numbered."""
    return df.select(*keys).distinct().sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _named_blocks(docs: DataFrame, size: int, address: Callable[[Column, int], tuple[Column, Column]]) -> tuple[DataFrame, int]:
    """(a, b, name) of each distinct block, and the seed whose addresses tell them apart."""
    raw = normalized(docs["text"]).cast("binary")
    blocks = docs.select(F.explode(_once(raw, lambda r: _blocks(r, size))).alias("block"))
    for seed in range(MAX_SEEDS):
        a, b = address(F.col("block"), seed)
        names = materialize(_numbered(blocks, "block").select(a.alias("a"), b.alias("b"), "name"), "names")
        if names.groupBy("a", "b").count().where("count > 1").isEmpty():
            return names, seed
        discard(names)
    raise RuntimeError(f"no seed of {MAX_SEEDS} tells all blocks apart")


def identities(docs: DataFrame, size: int = BLOCK_BYTES, address: Callable[[Column, int], tuple[Column, Column]] = addresses) -> tuple[DataFrame, DataFrame]:
    """(rows, ids): ``rows`` is (row, doc_id, text_sha256) of each row of ``docs``, ``ids``
    its (row, level, name).  Rows have equal (level, name) exactly if their normalised texts
    are equal.
    """
    names, seed = _named_blocks(docs, size, address)
    raw = normalized(docs["text"]).cast("binary")
    found = _once(raw, lambda r: F.struct(F.sha2(r, 256).alias("text_sha256"), F.transform(_blocks(r, size), lambda x: F.struct(*(h.alias(k) for h, k in zip(address(x, seed), "ab", strict=True)))).alias("at")))
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), found.alias("x")).select("row", "doc_id", "x.*"), "rows")
    longest = rows.agg(F.max(F.size("at"))).first()[0] or 1

    spread = rows.select("row", F.size("at").cast("long").alias("n"), F.posexplode("at").alias("pos", "at")).select("row", "n", F.col("pos").cast("long").alias("pos"), "at.a", "at.b")
    level = materialize(spread.join(names, ["a", "b"]).select("row", "n", "pos", "name"), "level")
    discard(names)
    done = [level.where("n = 1").select("row", F.lit(0).alias("level"), "name")]
    for k in range(1, (longest - 1).bit_length() + 1):
        half = F.floor(F.col("pos") / 2)
        pairs = level.where("n > 1").groupBy("row", "n", half.alias("pos")).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(NONE)).alias("b"))
        pairs = pairs.select("row", F.ceil(F.col("n") / 2).alias("n"), "pos", "a", "b")
        level = materialize(pairs.join(_numbered(pairs, "a", "b"), ["a", "b"]).select("row", "n", "pos", "name"), "level")
        done.append(level.where("n = 1").select("row", F.lit(k).alias("level"), "name"))
    ids = done[0]
    for more in done[1:]:
        ids = ids.unionAll(more)
    return rows.drop("at"), ids


def exact_groups(docs: DataFrame, size: int = BLOCK_BYTES, address: Callable[[Column, int], tuple[Column, Column]] = addresses) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row of ``docs``.

    Only doc_id and text are read.  A null text counts as empty; a null doc_id is larger
    than any other; of rows that repeat a doc_id and its text one is kept; an empty table
    gives an empty result.  A text of any length takes the memory of its row and its list
    of addresses (16 bytes a block).
    """
    rows, ids = identities(docs, size, address)
    each = materialize(ids.join(rows.select("row", "doc_id"), "row"), "identities")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    # written, so that the join below stands alone in its stage and a large group can be split
    groups = materialize(each.groupBy("level", "name").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")), "groups")
    named = each.join(groups, ["level", "name"]).select("row", "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"))
    return named.join(rows.select("row", "text_sha256"), "row").drop("row")


def drop_exact_copies(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one of the smallest doc_id.

    All columns stay as they are.  Where rows repeat a doc_id with its text, which of them
    stays is not defined.
    """
    kept = exact_groups(docs, size).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha256"))
    marked = docs.withColumn("_sha256", F.sha2(normalized(docs["text"]).cast("binary"), 256))
    found = marked.join(kept, (marked["_sha256"] == kept["_kept_sha256"]) & marked["doc_id"].cast("long").eqNullSafe(kept["_kept_id"]), "left_semi")
    return found.dropDuplicates(["doc_id", "_sha256"]).drop("_sha256")
