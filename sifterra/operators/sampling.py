"""Deterministic sampling, allocation, batching, imputation and shuffles.

Order is that of md5('seed:id'), so results are the same in every run and engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_order(seed: int, ident: Column | str) -> Column:
    """Sort key of a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string") if isinstance(ident, str) else ident.cast("string")))


def hash_uniform(seed: int, ident: str) -> Column:
    """Number in [0, 1) from 52 bits of the MD5."""
    return F.conv(F.substring(hash_order(seed, ident), 1, 13), 16, 10).cast("double") / float(1 << 52)


def quotas(rows: DataFrame, group: str, cell: list[str], cap: int, pos: str) -> DataFrame:
    """(group, cell..., n, quota): places of each cell, proportional to its size, summing to
    min(cap, total) in each group.

    Shares are rounded half to even.  What is missing goes to the largest cells with room,
    the first of equals first; what is over is taken, one place each, from the cells that
    exceed their exact share most, the last of equals first.  Cells of a group count in the
    order of their first row by ``pos``.  All of it is arithmetic over windows of a row for
    each cell; null groups and cells are groups and cells.
    """
    cells = rows.groupBy(group, *cell).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("__first"))
    of = Window.partitionBy(group)
    sized = cells.withColumns({"__total": F.sum("n").over(of), "__at": F.row_number().over(of.orderBy(F.col("__first").asc_nulls_first(), *cell))})
    whole = F.expr(f"(n * {cap}) div __total")
    twice = 2 * (F.col("n") * cap - whole * F.col("__total"))
    up = (twice > F.col("__total")) | ((twice == F.col("__total")) & (whole % 2 == 1))
    rounded = sized.withColumn("__got", F.when(F.col("__total") <= cap, F.col("n")).otherwise(F.least("n", whole + up.cast("long"))))
    by_size = of.orderBy(F.desc("n"), "__at").rowsBetween(Window.unboundedPreceding, -1)
    by_excess = of.orderBy(F.col("__got") == 0, F.desc(F.col("__got") * F.col("__total") - F.col("n") * cap), F.desc("__at"))
    off = rounded.withColumns(
        {
            "__short": F.least(F.lit(cap), F.col("__total")) - F.sum("__got").over(of),
            "__room": F.coalesce(F.sum(F.col("n") - F.col("__got")).over(by_size), F.lit(0)),
            "__rank": F.row_number().over(by_excess),
        }
    )
    given = F.greatest(F.lit(0), F.least(F.col("n") - F.col("__got"), F.col("__short") - F.col("__room")))
    taken = ((F.col("__rank") <= -F.col("__short")) & (F.col("__got") > 0)).cast("long")
    return off.select(group, *cell, "n", (F.col("__got") + given - taken).cast("long").alias("quota"))


def hash_ranked(rows: DataFrame, by: list[str], ident: str, seed: int, name: str) -> DataFrame:
    """``rows`` plus the rank (from 1) in the order of the hash within ``by``.

    Rows are numbered within the first three hexadecimal digits of the hash, and what comes
    before these is added, so that a group, however large, is dealt over 4096 parts.
    """
    tagged = rows.withColumn("__o", hash_order(seed, ident)).withColumn("__p", F.substring("__o", 1, 3))
    counts = tagged.groupBy(*by, "__p").agg(F.count(F.lit(1)).alias("__k"))
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows at most
    bases = counts.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__p").alias("__q"), F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__base"))
    same = F.col("__p") == F.col("__q")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    within = Window.partitionBy(*by, "__p").orderBy("__o", ident)
    ranked = tagged.withColumn("__in", F.row_number().over(within)).join(bases, same)
    return ranked.select(*rows.columns, (F.col("__base") + F.col("__in")).alias(name))


def stratified_sample(rows: DataFrame, group: str, cell: list[str], cap: int, ident: str, seed: int = 42) -> DataFrame:
    """``rows`` plus ``sampled``: whether the row is in its group's sample of ``cap``."""
    q = quotas(rows, group, cell, cap, ident).drop("n")
    ranked = hash_ranked(rows, [group, *cell], ident, seed, "__rn")
    same = F.lit(True)
    for c in (group, *cell):
        same = same & ranked[c].eqNullSafe(q[c])
    out = ranked.join(q, same)
    return out.select(*[ranked[c] for c in rows.columns], (F.col("__rn") <= F.col("quota")).alias("sampled"))


def pure_batches(rows: DataFrame, group: str, ident: str, size: int = 50, seed: int = 42) -> DataFrame:
    """``rows`` plus batch_id: chunks of ``size`` within each group, numbered over groups."""
    ranked = hash_ranked(rows, [group], ident, seed, "__rn")
    chunk = ranked.withColumn("__c", F.floor((F.col("__rn") - 1) / size)).drop("__rn")
    # one row for each group: how many batches come before its own
    counts = rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / size).alias("k"))
    before = counts.withColumn("__b", F.coalesce(F.sum("k").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    number = (F.col("__b") + F.col("__c") + 1).cast("long")
    return chunk.join(before, group).withColumn("batch_id", F.concat(F.lit("batch_"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")))).drop("__c", "__b")


def weighted_levels(trusted: DataFrame, group: str, level: str) -> DataFrame:
    """(group, level, lo, hi): cumulative shares of the levels in each group, and for the
    group null over all."""
    n = trusted.where(F.col(level).isNotNull()).groupBy(group, level).agg(F.count(F.lit(1)).alias("n"))
    n = n.where(F.col(group).isNotNull()).unionByName(trusted.where(F.col(level).isNotNull()).groupBy(F.lit(None).cast("string").alias(group), level).agg(F.count(F.lit(1)).alias("n")))
    by = Window.partitionBy(group).orderBy(level)
    total = F.sum("n").over(Window.partitionBy(group))
    hi = F.sum("n").over(by)
    return n.select(group, level, ((hi - F.col("n")) / total).alias("lo"), (hi / total).alias("hi"))


def impute_level(rows: DataFrame, trusted: DataFrame, group: str, level: str, ident: str, seed: int = 42) -> DataFrame:
    """``rows`` with missing levels drawn from the distribution of their group (or of all)."""
    table = weighted_levels(trusted, group, level)
    arrays = table.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("hi", level))).alias("__d"))
    overall = arrays.where(F.col(group).isNull()).first()  # one small array: the levels
    every = F.array(*[F.struct(F.lit(x["hi"]).alias("hi"), F.lit(x[level]).alias(level)) for x in (overall["__d"] if overall else [])]) if overall else F.lit(None)
    drawn = rows.join(arrays.where(F.col(group).isNotNull()), group, "left")
    drawn = drawn.withColumn("__d", F.coalesce("__d", every)) if overall else drawn
    u = hash_uniform(seed, ident)
    pick = F.filter("__d", lambda x: x["hi"] > u)[0][level]
    return drawn.withColumn(level, F.coalesce(F.when(F.col(level) != "", F.col(level)), pick)).drop("__d")


def in_ranges(points: DataFrame, ranges: DataFrame, key: str, value: str, lo: str = "lo", hi: str = "hi", bins: int = 64) -> DataFrame:
    """``points`` with the row of ``ranges`` of their key whose [lo, hi) holds their value; points
    in no range go.

    A range join as an equi-join: the span [0, 1) is cut into ``bins``, a range has a copy for
    each bin that it reaches into, and a point looks in its own bin alone.  Any number of
    ranges, so tables need not fit one array or one broadcast; a key that holds many points
    is dealt over its bins, and adaptive execution splits it further.
    """
    bin_of = lambda x: F.least(F.greatest(F.floor(x * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    # a range ends before hi, so one that ends at a bin's edge does not reach into it
    last = F.greatest(bin_of(F.col(lo)), F.least(F.ceil(F.col(hi) * bins) - 1, F.lit(bins - 1)).cast("int"))
    cut = ranges.where(F.col(lo) < F.col(hi)).withColumn("__bin", F.explode(F.sequence(bin_of(F.col(lo)), last)))
    names = [c for c in ranges.columns if c != key]
    cut = cut.select(F.col(key).alias("__key"), "__bin", *[F.col(c).alias(f"__r_{c}") for c in names])
    near = points.withColumn("__bin", bin_of(F.col(value)))
    inside = near[key].eqNullSafe(cut["__key"]) & (near["__bin"] == cut["__bin"]) & (F.col(f"__r_{lo}") <= F.col(value)) & (F.col(value) < F.col(f"__r_{hi}"))
    return near.join(cut, inside).select(*[near[c] for c in points.columns], *[F.col(f"__r_{c}").alias(c) for c in names])


def impute_level_by_ranges(rows: DataFrame, trusted: DataFrame, group: str, level: str, ident: str, seed: int = 42) -> DataFrame:
    """``impute_level`` for levels too many for an array in each row: missing ones are drawn by
    a range join; rows of a group without trusted levels draw from all."""
    table = weighted_levels(trusted, group, level)
    known = table.where(F.col(group).isNotNull()).select(group).distinct().withColumnRenamed(group, "__known")
    u = rows.withColumns({"__u": hash_uniform(seed, ident), "__row": F.monotonically_increasing_id()})
    has, lacks = u.where(F.coalesce(F.col(level), F.lit("")) != ""), u.where(F.coalesce(F.col(level), F.lit("")) == "")
    keyed = lacks.join(known, lacks[group] == known["__known"], "left").withColumnRenamed("__known", "__g")
    drawn = in_ranges(keyed.drop(level), table.withColumnRenamed(group, "__g"), "__g", "__u")
    got = drawn.select(*[F.col(c) for c in rows.columns])
    if_none = trusted.where(F.col(level).isNotNull()).isEmpty()
    return has.select(*rows.columns).unionByName(lacks.select(*rows.columns) if if_none else got)


def shuffle_options(rows: DataFrame, options: str, answer_key: str, ident: str, seed: int = 42) -> DataFrame:
    """Option texts dealt anew to the sorted keys; the answer key follows its text."""
    o = F.col(options)
    keys = F.array_sort(F.map_keys(o))
    # values in the order of a hash of (seed, id, old key)
    dealt = F.transform(F.array_sort(F.transform(keys, lambda k: F.struct(F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string"), F.lit(":"), k)).alias("h"), o[k].alias("v")))), lambda x: x["v"])
    dealt_rows = rows.withColumns({"__dealt": dealt, "__right": o[F.col(answer_key)], "__keys": keys})
    place = F.array_position("__dealt", F.col("__right")).cast("int")
    moved = F.when(place > 0, F.get("__keys", place - 1)).otherwise(F.col(answer_key))
    return dealt_rows.withColumns({options: F.map_from_arrays("__keys", "__dealt"), answer_key: moved}).drop("__dealt", "__right", "__keys")


def sample_per_source(rows: DataFrame, source: str, ident: str, k: int = 20, seed: int = 42) -> DataFrame:
    """``k`` rows of each source in hash order."""
    by = Window.partitionBy(source).orderBy(hash_order(seed, ident), ident)
    return rows.withColumn("__rn", F.row_number().over(by)).where(F.col("__rn") <= k).drop("__rn")
