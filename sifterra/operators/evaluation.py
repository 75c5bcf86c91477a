"""Prediction scoring and accuracy roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifterra.functions import text as tx


def scored(predictions: DataFrame, prediction: str, answer: str, options: str | None = None) -> DataFrame:
    """``predictions`` plus key (parsed, else from the options), is_error and correct."""
    p = F.col(prediction)
    key = tx.parse_key(p)
    if options:
        key = F.coalesce(key, F.when(~tx.is_error(p), tx.parse_key_from_options(p, F.col(options))))
    out = predictions.withColumns({"key": key, "is_error": tx.is_error(p)})
    return out.withColumn("correct", F.coalesce(F.col("key") == F.col(answer), F.lit(False)))


def accuracy_rollup(rows: DataFrame, dims: list[str], correct: str = "correct", parseable: str = "parseable") -> DataFrame:
    """(dim, value, n_correct, n_parseable, n_total, accuracy): over all and by each
    dimension in one pass; rows without a value of a dimension are not in its part."""
    parts = F.array(F.struct(F.lit("all").alias("dim"), F.lit("").alias("value")), *[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])
    each = rows.select(correct, parseable, F.explode(parts).alias("x")).where("x.value is not null")
    out = each.groupBy("x.dim", "x.value").agg(F.count_if(F.col(correct) & F.col(parseable)).alias("n_correct"), F.count_if(F.col(parseable)).alias("n_parseable"), F.count(F.lit(1)).alias("n_total"))
    return out.withColumn("accuracy", F.when(F.col("n_parseable") > 0, F.col("n_correct") / F.col("n_parseable")).otherwise(F.lit(0.0)))


def accuracy_wide(rows: DataFrame, by: str, dim: str, values: list[str], correct: str = "correct", parseable: str = "parseable") -> DataFrame:
    """One row for each ``by``: correct, questions and accuracy (percent) of each value."""
    aggs = []
    for v in values:
        here = (F.col(dim) == v) & F.col(parseable)
        c, n = F.count_if(here & F.col(correct)), F.count_if(here)
        aggs += [c.alias(f"{v}_correct"), n.alias(f"{v}_questions"), F.when(n > 0, F.bround(100 * c / n, 2)).otherwise(F.lit(0.0)).alias(f"{v}_accuracy")]
    return rows.groupBy(by).agg(*aggs)


def states(records: DataFrame, prediction: str, answer: str, options: str | None = None, exclude: Column | None = None) -> DataFrame:
    """``records`` that are not excluded, plus ``correct``, ``parseable`` and ``error`` (an empty
    or failed prediction, or one that names no answer)."""
    kept = records if exclude is None else records.where(~F.coalesce(exclude, F.lit(False)))
    out = scored(kept, prediction, answer, options)
    return out.withColumns({"parseable": F.col("key").isNotNull() & ~F.col("is_error")}).withColumn("error", ~F.col("parseable"))


def totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., total_correct, total_questions, total_accuracy in percent, errors)."""
    c, n = F.count_if(F.col("correct") & F.col("parseable")), F.count_if("parseable")
    return rows.groupBy(*by).agg(c.alias("total_correct"), n.alias("total_questions"), F.when(n > 0, F.bround(100 * c / n, 2)).otherwise(F.lit(0.0)).alias("total_accuracy"), F.count_if("error").alias("errors"))


def csv_wide(rows: DataFrame, by: list[str], dim: str, values: list[str]) -> DataFrame:
    """The wide shape: ``totals`` and, for each of ``values`` (spaces as underscores), its
    correct answers, questions and accuracy in percent."""
    key = F.struct(*by).alias("__by")
    wide = accuracy_wide(rows.withColumn("__by", key), "__by", dim, values)
    renamed = wide.toDF("__by", *[c.replace(" ", "_") for c in wide.columns[1:]])
    sums = totals(rows, by).withColumn("__by", key)
    return sums.join(renamed, sums["__by"].eqNullSafe(renamed["__by"])).drop("__by")


def csv_long(rows: DataFrame, by: list[str], dim: str) -> DataFrame:
    """The long shape: (by..., dim, correct, questions, accuracy in percent) of readable answers;
    rows without a value of ``dim`` are left out."""
    c, n = F.count_if("correct"), F.count(F.lit(1))
    return rows.where(F.col("parseable") & (F.col(dim) != "")).groupBy(*by, dim).agg(c.alias("correct"), n.alias("questions"), F.bround(100 * c / n, 2).alias("accuracy"))


def csv_subdomains(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """``csv_long`` of subdomains, each with the domain of its first readable row by ``order``."""
    first = rows.where("parseable").groupBy(*by, "subdomain").agg(F.min_by("domain", order).alias("domain"))
    return csv_long(rows, by, "subdomain").join(first, [*by, "subdomain"]).select(*by, F.coalesce("domain", F.lit("?")).alias("domain"), "subdomain", "correct", "questions", "accuracy")
