"""Projections, restructuring and structural filters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sifterra.functions import text as tx
from sifterra.storage import materialize

LETTERS = "ABCDE"
RELEASE_KEYS = ["id", "question", "options", "correct_key", "domain", "subdomain", "level", "length_tier", "source"]


def slim(rows: DataFrame, keys: list[str] = RELEASE_KEYS) -> DataFrame:
    """Exactly ``keys``; missing ones are null, of their own type."""
    kinds = {"id": "long", "options": "map<string,string>", "source": "array<string>"}
    return rows.select(*[F.col(k) if k in rows.columns else F.lit(None).cast(kinds.get(k, "string")).alias(k) for k in keys])


def union_all_keys(*parts: DataFrame, default: str = "") -> DataFrame:
    """All rows with every key of any part; missing strings get ``default``."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.na.fill(default)


def lettered(options: Column, most: int | None = None) -> Column:
    """Array of options as a map from letters (AA after Z)."""
    x = F.slice(options, 1, most) if most else options
    name = lambda i: F.when(i < 26, F.chr((65 + i).cast("int"))).otherwise(F.concat(F.chr((64 + F.floor(i / 26)).cast("int")), F.chr((65 + i % 26).cast("int"))))
    return F.map_from_entries(F.transform(x, lambda v, i: F.struct(name(i), v)))


def lettered_if_few(options: Column) -> Column:
    """``lettered`` for four or five options, none of them null; else null."""
    return F.when(F.size(options).isin(4, 5) & F.forall(options, lambda v: v.isNotNull()), lettered(options))


def unified(rows: DataFrame, names: Mapping[str, str], language: str = "ur") -> DataFrame:
    """Rows of one source dialect in the common columns: question, options, correct_answer,
    correct_index, domain, subdomain, level, source_url, language.

    ``names`` says which column of ``rows`` stands for which of them.  An answer that the
    dialect does not give follows from its index (0 to 3, else null); level and URL are
    empty and the language is ``language`` where they are missing.
    """
    at = {new: F.col(f"`{old}`") for new, old in names.items()}
    index = at.get("correct_index", F.lit(None).cast("int"))
    letter = F.when((index >= 0) & (index <= 3), F.get(F.array(*map(F.lit, "ABCD")), index.cast("int")))
    text = lambda c, default: F.coalesce(at[c], F.lit(default)) if c in at else F.lit(default)
    return rows.select(
        at["question"].alias("question"), at["options"].alias("options"), at.get("correct_answer", letter).alias("correct_answer"), index.cast("int").alias("correct_index"),
        at["domain"].alias("domain"), at["subdomain"].alias("subdomain"), text("level", "").alias("level"), text("source_url", "").alias("source_url"), text("language", language).alias("language"),
    )


def crosswalk(renumbered: DataFrame, new: str, old: str) -> DataFrame:
    """(new_id, old_id) of rows that got new ids."""
    return renumbered.select(F.col(new).alias("new_id"), F.col(old).alias("old_id"))


def flat_options(options: Column, key: Column) -> list[Column]:
    """option_a to option_d and answer (0 to 3)."""
    cols = [F.coalesce(F.try_element_at(options, F.lit(k)), F.lit("")).alias(f"option_{k.lower()}") for k in "ABCD"]
    return [*cols, (F.array_position(F.array(*map(F.lit, "ABCD")), key) - 1).cast("int").alias("answer")]


def canonical_answer(options: Column, index: Column) -> list[Column]:
    """correct_key and correct_option from a 0-based index; null where it points nowhere."""
    keys = F.array_sort(F.map_keys(options))
    key = F.when((index >= 0) & (index < F.size(keys)), F.try_element_at(keys, (index + 1).cast("int")))
    return [key.alias("correct_key"), F.try_element_at(options, key).alias("correct_option")]


def to_list(x: Column) -> Column:
    """Scalar to array; null and '' to the empty array."""
    return F.when(F.coalesce(x, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(x))


def zip_sources(names: Column, urls: Column, homepages: Mapping[str, str], display: Mapping[str, str]) -> Column:
    """Parallel arrays as array<struct<name, url>>; a missing URL is the source's homepage."""
    home = F.create_map(*[F.lit(v) for kv in homepages.items() for v in kv]) if homepages else F.create_map(F.lit(""), F.lit(""))
    url = lambda i: F.nullif(F.get(urls, i), F.lit(""))
    return F.transform(names, lambda n, i: F.struct(tx.source_name(n, url(i), display).alias("name"), F.coalesce(url(i), F.try_element_at(home, n)).alias("url")))


def anonymized(rows: DataFrame, annotators: str, prefix: str = "ann_") -> DataFrame:
    """Map keys (names) replaced by ``prefix`` and the name's place in sorted order.

    Names are numbered over range partitions; adaptive execution broadcasts their table if it
    is small.
    """
    names = rows.select(F.explode(F.map_keys(annotators)).alias("name")).distinct()
    numbered = contiguous_ids(names, ["name"], "__i").select("name", F.concat(F.lit(prefix), F.col("__i").cast("string")).alias("__ann"))
    # written once, so that both uses see the same row numbers
    keyed = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")
    entries = keyed.select("__row", F.explode(annotators).alias("name", "v")).join(numbered, "name")
    maps = entries.groupBy("__row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__ann", "v")))).alias("__m"))
    return keyed.join(maps, "__row", "left").withColumn(annotators, F.col("__m")).drop("__m", "__row")


def structural_reason(question: Column, options: Column, answer: Column) -> Column:
    """First reason to drop a row, null if there is none."""
    values = F.transform(F.map_values(options), tx.squashed)
    return (
        F.when(tx.squashed(question) == "", "empty_question")
        .when(options.isNull(), "non_dict_options")
        .when(~F.size(options).isin(4, 5), "wrong_option_count")
        .when(F.exists(values, lambda v: v == ""), "empty_option")
        .when(F.size(F.array_distinct(values)) < F.size(values), "duplicate_options")
        .when(answer.isNotNull() & ~F.array_contains(values, tx.squashed(answer)), "correct_option_unresolved")
    )


def contiguous_ids(rows: DataFrame, order: list[Column | str], name: str = "id") -> DataFrame:
    """``rows`` numbered 0, 1, ... in ``order``, without a global window.

    Rows are range-partitioned; each partition numbers its own and adds the sizes of
    those before it (a small table of one row for each partition).
    """
    ranged = rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    ranged = materialize(ranged.sortWithinPartitions(*order), "ranged")
    sizes = ranged.groupBy("__p").count()
    before = sizes.withColumn("__b", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return ranged.withColumn("__o", own).join(F.broadcast(before), "__p").withColumn(name, (F.col("__b") + F.col("__o")).cast("long")).drop("__p", "__o", "__b")


def looked_up(rows: DataFrame, column: str, table: DataFrame, key: str, value: str, default: Column | None = None, out: str | None = None) -> DataFrame:
    """Left join with a small dimension (checked: 100,000 rows to be broadcast)."""
    dim = table.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    if dim.limit(100_001).count() <= 100_000:
        dim = F.broadcast(dim)
    found = rows.join(dim, rows[column] == F.col("__k"), "left")
    return found.withColumn(out or value, F.coalesce("__v", default if default is not None else F.lit(None))).drop("__k", "__v")


def option_count_policy(options: Column, answer_index: Column) -> tuple[Column, Column]:
    """(keep, options): fewer than 4 go; 5 or more go if the fifth is right, else 4 stay."""
    keep = (F.size(options) >= 4) & ~((F.size(options) >= 5) & F.coalesce(answer_index >= 4, F.lit(False)))
    return keep, F.slice(options, 1, 4)


def prompt(template: str, **columns: Column) -> Column:
    """``template`` with {name} replaced by columns; a null is ''."""
    out: list[Column] = []
    rest = template
    while rest:
        text, brace, tail = rest.partition("{")
        if text:
            out.append(F.lit(text))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        out.append(F.coalesce(columns[name].cast("string"), F.lit("")))
    return F.concat(*out)
