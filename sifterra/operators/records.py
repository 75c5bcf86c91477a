"""Record repair, record filters and the combining flows: one row is one question."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sifterra.functions import text as tx
from sifterra.operators.agreement import last_wins, majority, merge_edits, verdict
from sifterra.operators.components import connected_components
from sifterra.operators.dedup import jaccard_pairs
from sifterra.operators.restructure import contiguous_ids
from sifterra.storage import materialize


def arranged(rows: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Columns in the order of ``columns`` (old name: new name); the others go."""
    return rows.select(*[F.col(f"`{old}`").alias(new) for old, new in columns.items()])


def normalized(raw: Column, schema: T.StructType, defaults: Mapping[str, object]) -> Column:
    """A JSON object as a struct of ``schema``, missing or null fields from ``defaults``;
    null for anything that is no object."""
    x = F.from_json(raw, schema)
    fields = [F.coalesce(x[f.name], F.lit(defaults[f.name]).cast(f.dataType)).alias(f.name) if f.name in defaults else x[f.name].alias(f.name) for f in schema]
    return F.when(F.trim(raw).startswith("{"), F.struct(*fields))


def without_bidi(x: Column, kind: T.DataType) -> Column:
    """``x`` without bidi marks in any string of it, however nested."""
    if isinstance(kind, T.StringType):
        return tx.strip_bidi(x)
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda v: without_bidi(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda _, v: without_bidi(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*[without_bidi(x[f.name], f.dataType).alias(f.name) for f in kind]))
    return x


def without_field(values: Column, field: str) -> Column:
    """A map of structs without one field of the structs."""
    return F.transform_values(values, lambda _, v: v.dropFields(field))


def rederived_option(options: Column, key: Column, old: Column) -> Column:
    """The option under the key, or the old text where the map lacks the key."""
    return F.when(F.map_contains_key(options, F.coalesce(key, F.lit(""))), F.try_element_at(options, key)).otherwise(old)


def overlaid(edit: Column, base: Column) -> Column:
    """The edit where there is one (an empty edit is one)."""
    return F.coalesce(edit, base)


def mirrored_path(path: Column, base: str, drop: str = "raw_data") -> Column:
    """Output key of an input file: its path below ``base`` without a first folder ``drop`` and
    without its extension; the bare name for a file outside."""
    name = F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")
    inside = F.substr(name, F.lit(len(base.rstrip("/")) + 2))
    return F.when(path.startswith(base.rstrip("/") + "/"), F.regexp_replace(inside, f"^{drop}/", "")).otherwise(F.element_at(F.split(name, "/"), -1))


def pretty_subdomain(name: Column, labels: Mapping[str, str]) -> Column:
    """What stands after the first ' / ', by the label table or with capital initials."""
    clean = F.lower(F.trim(F.when(name.contains(" / "), F.regexp_replace(name, "(?s)^.*? / ", "")).otherwise(name)))
    table = F.create_map(*[F.lit(v) for kv in (labels or {"": ""}).items() for v in kv])
    return F.coalesce(F.try_element_at(table, clean), F.initcap(clean))


def general_subdomain(domain: Column) -> Column:
    """First two words of the domain."""
    return F.substring_index(F.trim(F.regexp_replace(domain, r"(?U)\s+", " ")), " ", 2)


def without_values(rows: DataFrame, column: str, values: list, or_null: bool = True) -> DataFrame:
    """Rows whose ``column`` is none of ``values``; null ones stay unless told otherwise."""
    return rows.where(F.coalesce(~F.col(column).isin(values), F.lit(or_null)))


def without_flag(rows: DataFrame, flag: str) -> DataFrame:
    """Rows whose flag is not true; a missing flag is false."""
    return rows.where(~F.coalesce(F.col(flag), F.lit(False)))


def excluded(domains: list[str], subdomains: list[str]) -> Column:
    """Whether either list names the row, to filter by and to count apart."""
    return F.coalesce(F.col("domain").isin(domains), F.lit(False)) | F.coalesce(F.col("subdomain").isin(subdomains), F.lit(False))


def complete(rows: DataFrame, needed: list[str]) -> DataFrame:
    """Rows that have all of the ``needed`` columns."""
    return rows.where(" and ".join(f"`{c}` is not null" for c in needed) or "true")


def backfilled(rows: DataFrame, key: str, value: str, other: DataFrame, pos: str) -> DataFrame:
    """``value`` where it is missing from the first row of ``other``, by ``pos``, of the same key."""
    first = other.groupBy(key).agg(F.min_by(value, pos).alias("__first"))
    return rows.join(first, key, "left").withColumn(value, F.coalesce(value, "__first")).drop("__first").select(*rows.columns)


def top_per_group(counted: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group (``counted`` is aggregated, so groups are small)."""
    from pyspark.sql.window import Window

    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= n)


def union_of_new(first: DataFrame, second: DataFrame) -> DataFrame:
    """``first`` and those rows of ``second`` that it does not hold, nulls alike; repeated rows
    of ``second`` stay."""
    same = F.lit(True)
    seen = first.select(*[F.col(c).alias(f"__{c}") for c in first.columns]).distinct()
    for c in first.columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return first.unionByName(second.join(seen, same, "left_anti"))


def correlated_dedup(rows: DataFrame, node: str, question: Column, options: Column, answer: str, threshold: float = 0.9, option_threshold: float = 0.5, check_answer: bool = True, names: str | None = None, urls: str | None = None, stop_df: int | None = None) -> DataFrame:
    """The first row of each group of near-duplicate questions with near-duplicate options,
    plus ``group_size``.

    Rows link at a question-token Jaccard of ``threshold`` and an option-signature Jaccard
    of ``option_threshold``; token frequencies are those of all rows, however short, and with
    ``stop_df`` only rows that share a token of frequency up to it link.  With
    ``check_answer`` a group whose answers differ (empty ones are ignored) goes as a whole.
    ``names`` and ``urls`` (parallel arrays) of a group of several rows become its distinct
    names in order of first sight with their URLs ('' where one is missing).  ``node`` is
    unique and not null.
    """
    each = rows.select(F.col(node).cast("long").alias("n"), F.transform(question, lambda t: F.xxhash64(t)).alias("q"), tx.option_signatures(options).alias("s"))
    first, copies = each, None
    if stop_df is None:  # of rows with the same tokens and options one meets the others
        ordered = F.array_sort("q")
        each = materialize(each.withColumns({"k": F.xxhash64(F.size("q"), ordered), "l": F.xxhash64(F.lit(7), ordered), "o": F.array_sort("s")}), "questions")
        group = materialize(each.groupBy("k", "l", "o").agg(F.min("n").alias("r")), "copies")
        first = each.join(group.select(F.col("r").alias("n")), "n", "left_semi")
        copies = each.where((F.size("q") >= 4) & (tx.jaccard(F.col("s"), F.col("s")) >= option_threshold - 1e-12)).select("k", "l", "o", "n").join(group, ["k", "l", "o"])
        copies = copies.where("r <> n").select(F.col("r").alias("i"), F.col("n").alias("j"))
    pairs = jaccard_pairs(first, "n", F.col("q"), threshold, stop_df, df_of_long_rows_only=False).select("i", "j")
    both = pairs.join(first.select(F.col("n").alias("i"), F.col("s").alias("si")), "i").join(first.select(F.col("n").alias("j"), F.col("s").alias("sj")), "j")
    both = both.where(tx.jaccard(F.col("si"), F.col("sj")) >= option_threshold - 1e-12).select("i", "j")
    comp = connected_components(both if copies is None else both.unionByName(copies), "i", "j")
    # only rows of groups travel; the others stand for themselves
    member = rows.join(comp.select(F.col("node").alias("__n"), F.col("component").alias("__c")), F.col(node).cast("long") == F.col("__n"), "left").drop("__n")
    single = member.where("__c is null").withColumn("group_size", F.lit(1).cast("long"))
    merged = merged_groups(member.where("__c is not null"), F.col("__c"), node, answer, check_answer, names, urls)
    return single.select(*rows.columns, "group_size").unionByName(merged.select(*rows.columns, "group_size"))


def merged_groups(rows: DataFrame, group: Column, node: str, answer: str, check_answer: bool = True, names: str | None = None, urls: str | None = None) -> DataFrame:
    """The first row by ``node`` of each ``group``, plus ``group_size``.

    With ``check_answer`` a group whose answers, normalised, differ (empty ones are ignored)
    goes as a whole.  In groups of several rows ``names`` and ``urls`` (parallel arrays) become
    the group's distinct names in order of first sight with their URLs ('' where one is
    missing); rows that stand alone keep theirs.
    """
    given = F.col(answer).cast("string")
    member = rows.withColumns({"__g": group, "__a": F.when(F.coalesce(given, F.lit("")) != "", tx.fingerprint(given))})
    state = member.groupBy("__g").agg(F.count(F.lit(1)).alias("group_size"), F.min(node).alias("__first"), F.min("__a").alias("__lo"), F.max("__a").alias("__hi"))
    fine = (state.where("__lo is null or __lo = __hi") if check_answer else state).drop("__lo", "__hi")
    out = member.join(fine, "__g").where(F.col(node) == F.col("__first"))
    if names:
        u = F.get(urls, F.col("__at")) if urls else F.lit(None).cast("string")
        several = member.join(fine.where("group_size > 1").select("__g"), "__g", "left_semi")
        seen = several.select("__g", F.col(node).alias("__id"), F.posexplode(names).alias("__at", "__name"), *([urls] if urls else [])).where("coalesce(__name, '') <> ''")
        seen = seen.groupBy("__g", "__name").agg(F.min(F.struct("__id", "__at", F.coalesce(u, F.lit("")).alias("u"))).alias("f"))
        listed = seen.groupBy("__g").agg(F.array_sort(F.collect_list(F.struct("f.__id", "f.__at", "__name", "f.u"))).alias("__l"))
        empty = F.array().cast("array<string>")
        parts = lambda part: F.coalesce(F.transform("__l", lambda x: x[part]), empty)
        out = out.join(listed, "__g", "left")
        for column, part in ((names, "__name"), (urls, "u")):
            if column:
                out = out.withColumn(column, F.when(F.col("group_size") > 1, parts(part)).otherwise(F.col(column)))
    return out.select(*rows.columns, "group_size")


# Keys of an answer.
KEYS = ["A", "B", "C", "D"]


def _tagged(parts: Mapping[str, DataFrame], question: str, key: str, trusted: list[str]) -> DataFrame:
    """All parts with their tag and priority, whether the answer's key may stand, and the
    question without bidi marks."""
    out = None
    for at, (tag, rows) in enumerate(parts.items()):
        valid = F.lit(True) if tag in trusted else F.coalesce(F.col(key).isin(KEYS), F.lit(False))
        part = rows.withColumns({question: F.col(question) if tag in trusted else tx.strip_bidi(F.col(question)), "provenance": F.lit(tag), "__part": F.lit(at), "__valid": valid})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.withColumn("__q", tx.stripped(F.col(question)))


def _lookup(x: Column, table: Mapping[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(v) for kv in table.items() for v in kv]) if table else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.try_element_at(pairs, x)


def combined(parts: Mapping[str, DataFrame], question: str, order: str, domains: Mapping[str, str], renames: Mapping[str, str], key: str = "correct_key", trusted: list[str] = (), first_id: int = 0) -> DataFrame:
    """Inputs in order of priority (tag: rows with ``order``, ``key``, domain, subdomain) as one.

    Rows whose key is none of A to D go, but not those of ``trusted`` tags; questions of the
    others lose their bidi marks.  Of equal stripped questions the first by (priority, order)
    stays.  Then ``domains`` gives the domain of the subdomains that it lists, then ``renames``
    renames subdomains.  Rows get new ids from ``first_id`` in order; an ``id`` of the input
    is ``legacy_id``; ``provenance`` is the tag.
    """
    tagged = _tagged(parts, question, key, list(trusted)).where("__valid")
    tagged = tagged.withColumnRenamed("id", "legacy_id") if "id" in tagged.columns else tagged
    columns = [c for c in tagged.columns if c not in ("__q", "__valid")]
    best = tagged.groupBy("__q").agg(F.min_by(F.struct(*columns), F.struct("__part", order)).alias("r")).select("r.*")
    placed = best.withColumn("domain", F.coalesce(_lookup(F.col("subdomain"), domains), "domain"))
    placed = placed.withColumn("subdomain", F.coalesce(_lookup(F.col("subdomain"), renames), "subdomain"))
    numbered = contiguous_ids(placed, ["__part", order])
    return numbered.withColumn("id", F.col("id") + first_id).drop("__part")


def combine_counts(parts: Mapping[str, DataFrame], question: str, order: str, key: str = "correct_key", trusted: list[str] = ()) -> DataFrame:
    """(provenance, n_input, n_no_key, n_duplicate, n_kept) of ``combined``, by tag."""
    tagged = _tagged(parts, question, key, list(trusted))
    firsts = tagged.where("__valid").groupBy("__q").agg(F.min(F.struct("__part", order)).alias("f"), F.count(F.lit(1)).alias("n"))
    kept = firsts.groupBy(F.col("f.__part").alias("__part")).agg(F.count(F.lit(1)).alias("n_kept"))
    sizes = tagged.groupBy("provenance", "__part").agg(F.count(F.lit(1)).alias("n_input"), F.count_if(~F.col("__valid")).alias("n_no_key"))
    out = sizes.join(kept, "__part", "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))
    return out.select("provenance", "n_input", "n_no_key", (F.col("n_input") - F.col("n_no_key") - F.col("n_kept")).alias("n_duplicate"), "n_kept")


def noted(items: DataFrame, notes: DataFrame, order: list[str], valid: list[str], unsure: str = "unsure") -> DataFrame:
    """``items`` (id, ...) that have notes, plus ``notes`` (an array by annotator) and
    ``verdict``.

    Of an annotator's notes (id, annotator, pick, flagged, ...) on an item the last in
    ``order`` counts; notes on unknown items go.  An item's annotators are few.
    """
    last = last_wins(notes, ["id", "annotator"], order)
    named = last.groupBy("id").agg(F.collect_list(F.struct(*[c for c in last.columns if c != "id"])).alias("n"))
    by_name = lambda a, b: F.when(a["annotator"] < b["annotator"], -1).when(a["annotator"] > b["annotator"], 1).otherwise(0)
    listed = named.select("id", F.array_sort("n", by_name).alias("notes"))
    flagged = F.exists("notes", lambda x: F.coalesce(x["flagged"], F.lit(False)))
    return items.join(listed, "id").withColumn("verdict", verdict(F.col("notes.pick"), flagged, valid, unsure))


def annotated(noted_items: DataFrame, order: str = "id") -> DataFrame:
    """The included rows of ``noted`` (id, question, options, domain, subdomain, notes,
    verdict) with edits applied and bidi marks gone; ``correct_key`` is what they agree on.

    Edits (question_edit, subdomain_edit, option_edits) count in order of the annotator,
    empty ones not at all, the longest of several.  The domain is the one that most of all
    noted rows give to the edited subdomain (of equals the one seen first by ``order``),
    or the row's own if none does.
    """
    said = noted_items.where("verdict = 'include'")
    options = F.transform_values("options", lambda k, v: tx.strip_bidi(merge_edits(F.transform("notes", lambda x: F.try_element_at(x["option_edits"], k)), v)))
    question = tx.strip_bidi(merge_edits(F.col("notes.question_edit"), F.col("question")))
    subdomain = merge_edits(F.col("notes.subdomain_edit"), F.col("subdomain"))
    known = noted_items.where("coalesce(subdomain, '') <> '' and coalesce(domain, '') <> ''")
    usual = majority(known, "subdomain", "domain", order).select(F.col("subdomain").alias("__s"), F.col("domain").alias("__d"))
    edited = said.select("id", question.alias("question"), options.alias("options"), subdomain.alias("subdomain"), F.col("domain").alias("__own"), F.col("notes")[0]["pick"].alias("correct_key"))
    placed = edited.join(usual, edited["subdomain"] == usual["__s"], "left")
    return placed.select("id", "question", "options", "correct_key", F.coalesce("__d", "__own").alias("domain"), "subdomain", (~F.coalesce("__d", "__own").eqNullSafe(F.col("__own"))).alias("domain_corrected"))


def drop_counts(noted_items: DataFrame) -> DataFrame:
    """(verdict, n): how many noted rows are included, and how many go for each reason."""
    return noted_items.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def without_parse_failures(predictions: DataFrame, prediction: str, options: Column) -> DataFrame:
    """Predictions that name an answer, by a pattern or by an option's text; error answers
    (they are counted apart) stay."""
    said = F.coalesce(F.col(prediction), F.lit(""))
    error = said.startswith("ERROR") | said.startswith("CONNECTION_FAILED")
    key = F.coalesce(tx.parse_key(said), tx.parse_key_from_options(said, options))
    return predictions.where(error | key.isNotNull())
