"""Frames behind charts: rings and tiles of a hierarchy, a symmetric heatmap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sifterra.operators.agreement import fixed_chance_kappa


def hierarchy(rows: DataFrame, levels: list[str], defaults: list[str]) -> DataFrame:
    """(depth, levels..., n, share, place): counts of a ROLLUP over the levels.

    Missing or empty names are those of ``defaults``.  ``share`` is the part of the parent;
    ``place`` (from 1) ranks siblings by size, then by name.  Depth 0 is the whole.  An empty
    table has no row.
    """
    named = rows.select([F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(d)).alias(c) for c, d in zip(levels, defaults, strict=True)])
    depth = len(levels) - sum((F.grouping(c).cast("int") for c in levels), F.lit(0))
    sizes = named.rollup(*levels).agg(F.count(F.lit(1)).alias("n"), depth.cast("int").alias("depth")).where("n > 0")
    out = None
    for d in range(len(levels) + 1):
        mine = sizes.where(F.col("depth") == d)
        siblings = Window.partitionBy(F.lit(d), *levels[: d - 1] if d else [])
        name = F.col(levels[d - 1]) if d else F.lit("")
        mine = mine.select("depth", *levels, "n", (F.col("n") / F.sum("n").over(siblings)).alias("share"), F.row_number().over(siblings.orderBy(F.desc("n"), name)).alias("place"))
        out = mine if out is None else out.unionAll(mine)
    return out


def heatmap(pairs: DataFrame, names: list[str], metric: str = "kappa", categories: int = 4) -> DataFrame:
    """(annotator, one column for each of ``names``): the symmetric matrix of ``pairs`` (first,
    second, agree, total); null where two share nothing.

    ``metric`` is ``kappa`` (against a chance of 1 / ``categories``), ``agreement`` or
    ``total``.  All of ``names`` have a row, whether they are in a pair or not; pairs of
    others are left out.
    """
    value = {"kappa": fixed_chance_kappa(F.col("agree"), F.col("total"), categories), "agreement": F.when(F.col("total") > 0, F.col("agree") / F.col("total")), "total": F.col("total")}[metric]
    each = pairs.select("first", "second", value.alias("v"))
    both = each.unionAll(each.select("second", "first", "v"))
    rows = pairs.sparkSession.createDataFrame([(n,) for n in names], "first string")
    return rows.join(both, "first", "left").groupBy(F.col("first").alias("annotator")).pivot("second", names).agg(F.max("v"))
