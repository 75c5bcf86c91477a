"""Mixing sources to target weights by Poisson replication.

The target weight of a source and the size of the mix fix its mean repetition rate.
Each document draws its number of copies by inverting the Poisson distribution of that
mean at a uniform number from a keyed hash of the document, is exploded by the count, and
all copies are shuffled globally by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sifterra.storage import partitions

#: With more sources than this, or more numbers in their distributions together, these are
#: joined by a salted shuffle, not broadcast: the rows are the same.
MAX_BROADCAST_SOURCES, MAX_BROADCAST_NUMBERS = 20_000, 4_000_000
SALTS = 32
#: Copies of a document that are exploded at once.
COPY_BLOCK = 4096


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts joined by '|'."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string") if isinstance(p, Column) else F.lit(p), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None) -> DataFrame:
    """(source, n_docs, rate): mean copies of a document of each source.

    ``weights``: target share of each source, in documents, of any sum (None: all
    alike; a source that is not named gets 0, a named one without documents nothing).
    ``total``: documents in the mix (None: as many as there are).  Null is a source.
    """
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        weighted = n.withColumn("__w", F.lit(1.0))
    else:
        table = docs.sparkSession.createDataFrame(list(weights.items()) or [("", 0.0)], "__s string, __w double")
        weighted = n.join(table, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s").withColumn("__w", F.coalesce("__w", F.lit(0.0)))
    sums = weighted.agg(F.sum("__w").alias("__sum"), F.sum("n_docs").alias("__all")).first()
    size = float(total if total is not None else sums["__all"] or 0)
    share = F.col("__w") / (sums["__sum"] or 1.0)
    return weighted.select("source", "n_docs", (share * size / F.col("n_docs")).alias("rate"))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """``rates`` plus __low and __cdf: P(count <= k) for k = __low + 0, 1, ...

    The window is rate +- (12 * sqrt(rate) + 20), at least 0; outside lies a probability
    below 1e-16.  Within it the terms follow from each other by p(k + 1) = p(k) * rate / (k + 1).
    """
    spread = 12 * F.sqrt("rate") + 20
    low, high = F.greatest(F.lit(0.0), F.floor(F.col("rate") - spread)), F.ceil(F.col("rate") + spread)
    k = rates.select("source", "n_docs", "rate", low.cast("long").alias("__low"), F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("k"))
    by = Window.partitionBy("source").orderBy("k")
    step = F.when(F.col("k") > F.col("__low"), F.ln(F.col("rate") / F.col("k"))).otherwise(0.0)
    k = k.withColumn("__log", F.when(F.col("rate") > 0, F.sum(step).over(by)).otherwise(F.when(F.col("k") == 0, 0.0)))
    whole = Window.partitionBy("source")
    k = k.withColumn("__p", F.coalesce(F.exp(F.col("__log") - F.max("__log").over(whole)), F.lit(0.0)))
    k = k.withColumn("__c", F.sum("__p").over(by) / F.sum("__p").over(whole))
    return k.groupBy("source", "n_docs", "rate", "__low").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "__c"))), lambda x: x["__c"]).alias("__cdf"))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: str = "mix") -> DataFrame:
    """(row, copy, n_copies, rate): rows of ``docs``, as a struct of all their columns
    whatever these are called, repeated by Poisson counts and shuffled.

    The draw of a document hashes seed, source and doc_id (a null id: its text), so it
    is the same in every run; rows with the same id draw the same count.  Documents that
    draw 0 are absent.  A null source is a source of its own.  An empty table, or a
    total of 0, gives an empty table.  No source, however large, is gathered, and a
    document of many copies is exploded in blocks.
    """
    spark = docs.sparkSession
    rates = repetition_rates(docs.select("source"), weights, total)
    few = rates.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    # the window of a rate has 24 * sqrt(rate) + 40 numbers; together they must be few, too
    if few:
        few = (rates.agg(F.sum(24 * F.sqrt("rate") + 40).alias("n")).first()["n"] or 0) <= MAX_BROADCAST_NUMBERS
    tables = poisson_tables(rates).select(F.col("source").alias("__source"), "rate", "__low", "__cdf")
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = F.col("row.source").eqNullSafe(F.col("__source"))
    if few:
        joined = base.join(F.broadcast(tables), own)
    else:
        base = base.withColumn("__salt", F.pmod(F.xxhash64("row.doc_id"), F.lit(SALTS)))
        tables = tables.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = base.join(tables, own & (F.col("__salt") == F.col("__salt2")))
    ident = F.coalesce(F.col("row.doc_id").cast("string"), F.col("row.text").cast("string"))
    drawn = joined.withColumns({"__u": uniform(seed, F.col("row.source"), ident), "__name": F.coalesce(F.col("row.doc_id").cast("string"), F.md5(F.coalesce(F.col("row.text").cast("string"), F.lit("~"))))})
    drawn = drawn.select("row", "rate", "__name", F.expr("__low + least(size(filter(__cdf, c -> c <= __u)), size(__cdf) - 1)").alias("n_copies")).where("n_copies > 0")
    blocks = drawn.withColumn("__block", F.explode(F.expr(f"sequence(0L, (n_copies - 1) div {COPY_BLOCK})")))
    copies = blocks.withColumn("copy", F.explode(F.expr(f"sequence(__block * {COPY_BLOCK}, least(n_copies, (__block + 1) * {COPY_BLOCK}) - 1)")))
    copies = copies.withColumn("__at", F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), F.col("copy").cast("string"), F.col("__name"))))
    return copies.repartition(partitions(spark), "__at").sortWithinPartitions("__at").select("row", "copy", "n_copies", "rate")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: str = "mix") -> DataFrame:
    """What ``replicate`` draws, as columns: those of ``docs`` plus ``copy`` (from 0),
    ``n_copies`` and ``rate``; input columns of these three names are replaced, any others
    are kept."""
    base = docs.drop("copy", "n_copies", "rate")
    made = replicate(base, weights, total, seed)
    return made.select(*[F.col(f"row.`{c}`") for c in base.columns], F.col("copy").cast("int").alias("copy"), F.col("n_copies").cast("int").alias("n_copies"), "rate")


def mixed_rows(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: str = "mix") -> DataFrame:
    """What ``replicate`` draws with the columns of ``docs`` alone, all of them unchanged."""
    return replicate(docs, weights, total, seed).select(*[F.col(f"row.`{c}`") for c in docs.columns])
