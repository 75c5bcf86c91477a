"""Annotation flow: last-wins ledger, verdicts, edits, agreement and time statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifterra.storage import materialize

#: Blocks of annotators: their least number, rows of each; pairs that a task counts at once.
MIN_BLOCKS, BLOCK_ROWS, CHUNK = 12, 1_000_000, 1_000_000


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in ``order``."""
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("__r"))
    return best.select("__r.*")


def ledger_counts(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """(key..., n_added, n_updated): the first row of a key adds, later ones update."""
    return rows.groupBy(*key).agg(F.lit(1).cast("long").alias("n_added"), (F.count(F.lit(1)) - 1).alias("n_updated"))


def verdict(picks: Column, flagged: Column, valid: list[str], unsure: str = "unsure") -> Column:
    """Verdict over the picks of one item (an array, with null for no pick)."""
    return (
        F.when(F.size(picks) < 2, "single_annotated")
        .when(flagged, "flagged")
        .when(F.array_contains(picks, unsure), "unsure")
        .when(F.exists(picks, lambda p: p.isNull() | ~p.isin(*valid)), "invalid")
        .when(F.size(F.array_distinct(picks)) > 1, "disagree")
        .otherwise("include")
    )


def pair_agreement(rows: DataFrame, item: str, annotator: str, pick: str) -> DataFrame:
    """(first, second, agree, total, rate) of annotators who share items; first < second.

    A row for each item and annotator is expected.  Where items are shared by few, their
    pairs are counted by a join and a grouping.  Where that would move more rows than
    sending each row, packed, to every block of annotators, pairs are counted in the task of their two
    blocks, and nothing but the result leaves it.  The result has a row for each pair, so it
    grows with the square of the annotators.
    """
    kept = rows.select(F.col(item).alias("item"), F.col(annotator).alias("who"), F.col(pick).alias("pick")).where("item is not null and who is not null")
    kept = materialize(kept, "picks")
    met, n = kept.groupBy("item").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.expr("n * cast(n - 1 as double) / 2")), F.sum("n")).first()
    blocks = max(MIN_BLOCKS, -(-(n or 0) // BLOCK_ROWS))
    if (met or 0) <= blocks * (n or 0):
        a, b = kept.select("item", F.col("who").alias("first"), F.col("pick").alias("p")), kept.select("item", F.col("who").alias("second"), F.col("pick").alias("q"))
        both = a.join(b, "item").where("first < second")
        out = both.groupBy("first", "second").agg(F.count_if(F.col("p") == F.col("q")).alias("agree"), F.count(F.lit(1)).alias("total"))
    else:
        out = _pairs_by_blocks(kept, blocks)
    return out.withColumn("rate", F.bround(F.col("agree") / F.col("total"), 3))


def _pairs_by_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """(first, second, agree, total) of rows (item, who, pick); one task for each two blocks."""
    one = _packed(rows, blocks).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = one.select(F.least("g", "h").alias("lo"), F.greatest("g", "h").alias("hi"), "g", "data")
    kind = rows.schema["who"].dataType.simpleString()
    return sent.groupBy("lo", "hi").applyInArrow(_block_pairs, f"first {kind}, second {kind}, agree long, total long")


def _packed(rows: DataFrame, blocks: int) -> DataFrame:
    """(g, data): rows of each block of annotators, many to a compressed Arrow stream, since they go to every block."""
    dealt = rows.select(F.pmod(F.xxhash64("who"), F.lit(blocks)).cast("int").alias("g"), "who", "item", "pick")
    return dealt.repartition("g").sortWithinPartitions("g", "who", "item").mapInArrow(_pack, "g int, data binary")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        g = batch.column(0).to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else []
        for lo, hi in zip(begin, [*begin[1:], len(g)]):
            part = batch.slice(lo, hi - lo).select(["who", "item", "pick"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([g[lo]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["g", "data"])


def _block_pairs(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of annotators of block ``lo`` and block ``hi``, in chunks of bounded size."""
    lo, hi = (k.as_py() for k in key)
    tables = []
    for part in parts:
        for of, data in zip(part.column("g"), part.column("data")):
            one = pa.ipc.open_stream(data.as_buffer()).read_all()
            tables.append(one.append_column("g", pa.array(np.full(one.num_rows, of.as_py(), np.int32))))
    table = pa.concat_tables(tables)
    names = pc.unique(table["who"])
    names = names.take(pc.sort_indices(names))
    g = table["g"].to_numpy()
    who = pc.index_in(table["who"], names).to_numpy()
    item = table["item"].combine_chunks().dictionary_encode().indices.to_numpy()
    pick = pc.fill_null(table["pick"].combine_chunks().dictionary_encode().indices, -1).to_numpy()
    left, right = np.flatnonzero(g == lo), np.flatnonzero(g == hi)
    left, right = left[np.argsort(who[left], kind="stable")], right[np.argsort(item[right], kind="stable")]
    begin = np.searchsorted(item[right], item[left], "left")
    count = np.searchsorted(item[right], item[left], "right") - begin
    ends, wide, at = np.cumsum(count), len(names), 0
    while at < len(left):
        # whole annotators of the left block, up to CHUNK pairs of rows and of annotators (one at least)
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right"))
        to = min(max(to, at + 1), int(np.searchsorted(who[left], who[left[at]] + max(1, CHUNK // wide), "left")))
        if to < len(left):
            cut = int(np.searchsorted(who[left], who[left[to]], "left"))
            to = cut if cut > at else int(np.searchsorted(who[left], who[left[at]], "right"))
        size = count[at:to]
        l_ = np.repeat(left[at:to], size)
        r_ = right[np.repeat(begin[at:to] - (np.cumsum(size) - size), size) + np.arange(len(l_))]
        at = to
        base = int(who[l_[0]]) if len(l_) else 0
        code = (who[l_].astype(np.int64) - base) * wide + who[r_]
        same = (pick[l_] == pick[r_]) & (pick[l_] >= 0)
        if lo == hi:
            code, same = code[who[l_] < who[r_]], same[who[l_] < who[r_]]
        if not len(code):
            continue
        if code.max() < 4 * len(code) + 1024:
            total = np.bincount(code)
            cell = np.flatnonzero(total)
            agree, total = np.bincount(code[same], minlength=len(total))[cell], total[cell]
        else:
            cell, back, total = np.unique(code, return_inverse=True, return_counts=True)
            agree = np.bincount(back[same], minlength=len(cell))
        a, b = cell // wide + base, cell % wide
        for k in range(0, len(cell), 1 << 17):
            x, y, s = np.minimum(a, b)[k : k + (1 << 17)], np.maximum(a, b)[k : k + (1 << 17)], slice(k, k + (1 << 17))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(x)), names.take(pa.array(y)), pa.array(agree[s], pa.int64()), pa.array(total[s], pa.int64())], ["first", "second", "agree", "total"])


def disagreements(rows: DataFrame, item: str, annotator: str, pick: str, least: int = 10) -> DataFrame:
    """(annotator, disagree, total) over all pairs with others at the same items, from
    ``least`` pairs on: counted from the picks of each item, without its pairs.

    A row for each item and annotator is expected.  A pair with a missing pick counts in
    ``total`` only; ``disagree`` is null where no pair has both.
    """
    kept = rows.select(F.col(item).alias("item"), F.col(annotator).alias("annotator"), F.col(pick).alias("pick")).where("item is not null and annotator is not null")
    votes = kept.groupBy("item", "pick").agg(F.count(F.lit(1)).alias("same"))
    known = F.coalesce(F.sum(F.when(F.col("pick").isNotNull(), F.col("same"))), F.lit(0))
    items = votes.groupBy("item").agg(F.sum("same").alias("all"), known.alias("known"))
    each = kept.join(items, "item").join(votes.where("pick is not null"), ["item", "pick"], "left")
    each = each.select("annotator", F.when(F.col("known") > 1, F.col("known") - F.col("same")).alias("d"), (F.col("all") - 1).alias("n"))
    return each.groupBy("annotator").agg(F.sum("d").alias("disagree"), F.sum("n").alias("total")).where(F.col("total") >= least)


def fixed_chance_kappa(agree: Column, total: Column, categories: int = 4, empty: float = 0.0) -> Column:
    """Agreement beyond a chance of 1 / categories; ``empty`` where there is nothing."""
    p = agree / total
    chance = 1.0 / categories
    return F.when(total == 0, F.lit(empty)).otherwise((p - chance) / (1 - chance))


def consensus(rows: DataFrame, item: str, pick: str, unsure: str = "unsure") -> DataFrame:
    """(item, consensus): most frequent pick but ``unsure``; null at a tie."""
    n = rows.where(F.col(pick).isNotNull() & (F.col(pick) != unsure)).groupBy(item, pick).agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy(item).agg(F.max("n").alias("top"))
    best = n.join(top, item).where("n = top")
    return best.groupBy(item).agg(F.when(F.count(F.lit(1)) == 1, F.min(pick)).alias("consensus"))


def capped_times(rows: DataFrame, by: str, value: str, cap: float) -> DataFrame:
    """(by, n, raw, capped, n_over, median, mean_capped); zero and missing times left out."""
    v = F.col(value)
    return rows.where(v > 0).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("raw"), F.sum(F.least(v, F.lit(cap))).alias("capped"), F.count_if(v > cap).alias("n_over"), F.median(v).alias("median"), F.avg(F.least(v, F.lit(cap))).alias("mean_capped")
    )


def merge_edits(edits: Column, original: Column) -> Column:
    """Edited value: none or empty ones, the original; else the longest, the first of equals."""
    full = F.filter(edits, lambda e: F.coalesce(e, F.lit("")) != "")
    best = F.array_sort(F.transform(full, lambda e, i: F.struct((-F.length(e)).alias("l"), i.alias("i"), e.alias("e"))))
    return F.coalesce(F.try_element_at(best, F.lit(1))["e"], original)


def majority(rows: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """(key, value): the most frequent value, the one seen first among equals."""
    n = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("p"))
    return n.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("p"))).alias(value))


def annotator_stats(notes: DataFrame, item: str, annotator: str, pick: str, flagged: str, batch: str, unsure: str = "unsure") -> DataFrame:
    """(annotator, total, unsure, flagged, batches, agree, compared) of each annotator.

    ``compared`` are the annotator's notes on items of two notes and more that have a
    consensus (the most frequent pick, unsure and missing ones left out, no tie); ``agree``
    those that pick it.  An unsure note is compared and does not agree.
    """
    p = F.col(pick)
    voted = notes.where(p != "")
    shared = notes.groupBy(item).agg(F.count(F.lit(1)).alias("__n")).where("__n >= 2")
    agreed = consensus(voted, item, pick, unsure).where("consensus is not null").join(shared, item)
    held = notes.join(agreed.select(item, "consensus"), item).groupBy(annotator)
    held = held.agg(F.count_if(p == F.col("consensus")).alias("agree"), F.count(F.lit(1)).alias("compared"))
    own = notes.groupBy(annotator).agg(F.count(F.lit(1)).alias("total"), F.count_if(p == unsure).alias("unsure"), F.count_if(F.col(flagged)).alias("flagged"), F.countDistinct(F.nullif(F.col(batch).cast("string"), F.lit(""))).alias("batches"))
    both = own.join(held, annotator, "left")
    return both.select(annotator, "total", "unsure", "flagged", "batches", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("agree", "compared")])


def item_agreement(notes: DataFrame, item: str, pick: str, unsure: str = "unsure") -> DataFrame:
    """One row (shared, agree, disagree): items of two notes and more, those whose picks are
    all the same, and those that differ; items of unsure notes only are neither."""
    p = F.col(pick)
    real = F.when((p != "") & (p != unsure), p)
    items = notes.groupBy(item).agg(F.count(F.lit(1)).alias("n"), F.min(real).alias("lo"), F.max(real).alias("hi")).where("n >= 2")
    return items.agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("lo") == F.col("hi")).alias("agree"), F.count_if(F.col("lo") != F.col("hi")).alias("disagree"))
