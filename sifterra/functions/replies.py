"""Decoding of model replies: fenced JSON, typed with defaults, corrupt ones set apart.

JSON is parsed once to a VARIANT, so a field's kind can be asked before it is cast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifterra.functions.text import stripped

# Labels of pages; the one that carries a domain; the one for all else.
LABELS, WITH_DOMAIN, OTHER = ("urdu_mcq", "urdu_other", "english", "skip"), "urdu_mcq", "skip"
QUESTION = "question_number, question, options, has_image, image_bbox"


def body(reply: Column) -> Column:
    """A reply without its code fence: where it begins with three backticks, what stands
    between the first line and the last backticks; null if such a line has no end."""
    x = stripped(reply)
    inside = F.regexp_extract(x, r"(?s)^```[^\n]*\n(.*)$", 1)
    closed = F.when(inside.contains("```"), F.regexp_extract(inside, r"(?s)^(.*)```", 1)).otherwise(inside)
    return F.when(~x.startswith("```"), x).when(x.contains("\n"), stripped(closed))


def parsed(reply: Column) -> Column:
    """The reply's JSON as a VARIANT; null if it is none."""
    return F.try_parse_json(body(reply))


def kind(value: Column) -> Column:
    """STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, ARRAY, OBJECT or VOID."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _field(value: Column, name: str) -> Column:
    return F.when(kind(value) == "OBJECT", F.try_variant_get(value, f"$.{name}", "variant"))


def _shown(value: Column) -> Column:
    """A value as text: logical ones with capitals, nothing as ``None``, numbers and strings as
    they are, lists and objects as JSON."""
    k = kind(value)
    text = F.try_variant_get(value, "$", "string")
    return F.when(k == "VOID", "None").when(k == "BOOLEAN", F.initcap(text)).when(k.isin("ARRAY", "OBJECT"), F.to_json(value)).otherwise(text)


def _truth(value: Column) -> Column:
    """False for a missing or null value, zero, false and anything empty."""
    k, text = kind(value), F.to_json(value)
    number = F.try_variant_get(value, "$", "double")
    return F.coalesce(F.when(k == "VOID", F.lit(False)).when(k == "BOOLEAN", text == "true").when(k.isin("BIGINT", "DECIMAL", "DOUBLE"), number != 0).otherwise(~text.isin('""', "[]", "{}")), F.lit(False))


def _struct(item: Column) -> Column:
    """One question, or null where its number is missing, its question no text or its options
    no list."""
    number, question, options, image = (_field(item, n) for n in ("question_number", "question", "options", "has_image"))
    fine = (kind(number) != "VOID") & (kind(question) == "STRING") & (kind(options) == "ARRAY")
    listed = F.transform(F.try_variant_get(options, "$", "array<variant>"), lambda o: F.when(o.isNull(), "None").otherwise(stripped(_shown(o))))
    box = _field(item, "image_bbox")
    return F.when(
        F.coalesce(fine, F.lit(False)),
        F.struct(
            _shown(number).alias("question_number"),
            stripped(F.try_variant_get(question, "$", "string")).alias("question"),
            listed.alias("options"),
            _truth(image).alias("has_image"),
            F.when(_truth(image) & (kind(box) != "VOID"), F.to_json(box)).alias("image_bbox"),
        ),
    )


def questions(reply: Column) -> Column:
    """The questions of a reply (structs of ``QUESTION``), incomplete ones left out; null if the
    reply is not a JSON list."""
    v = parsed(reply)
    items = F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))
    return F.filter(F.transform(items, _struct), lambda q: q.isNotNull())


def decoded(rows: DataFrame, reply: str) -> tuple[DataFrame, DataFrame]:
    """(good, corrupt): a row for each question of a reply, with its place, and the rows whose
    reply is not a JSON list (null ones too), as they came."""
    found = rows.withColumn("__q", questions(F.col(reply)))
    good = found.where("__q is not null").select(*[c for c in rows.columns if c != reply], F.posexplode("__q").alias("pos", "__q")).select("*", "__q.*").drop("__q")
    return good, found.where("__q is null").drop("__q")


def _label(value: Column) -> Column:
    """(label, domain) of an object; the domain only of the label that carries one."""
    said = F.when(kind(_field(value, "label")) == "STRING", F.try_variant_get(value, "$.label", "string"))
    label = F.when(said.isin(*LABELS), said).otherwise(OTHER)
    domain = F.when(label == WITH_DOMAIN, F.coalesce(stripped(_shown(_field(value, "domain"))), F.lit("")))
    return F.struct(label.alias("label"), domain.alias("domain"))


def page_label(reply: Column) -> Column:
    """(label, domain) of a classifier's reply: of its JSON object, else of its bare text in
    lower case without quotes; anything unknown is ``skip``."""
    v, bare = parsed(reply), stripped(F.trim(F.lower(body(reply)), F.lit('"')))
    plain = F.struct(F.when(bare.isin(*LABELS), bare).otherwise(OTHER).alias("label"), F.lit(None).cast("string").alias("domain"))
    skipped = F.struct(F.lit(OTHER).alias("label"), F.lit(None).cast("string").alias("domain"))
    return F.when(v.isNull(), plain).when(kind(v) == "OBJECT", _label(v)).otherwise(skipped)


def keyed_labels(text: Column) -> Column:
    """A JSON object of page and label as a map to (label, domain); a text is a label as it
    stands, an object is checked, anything else is ``skip``.  No object: an empty map."""
    v = F.try_parse_json(text)
    entries = F.when(kind(v) == "OBJECT", F.try_variant_get(v, "$", "map<string,variant>"))
    bare = lambda x: F.struct(F.try_variant_get(x, "$", "string").alias("label"), F.lit(None).cast("string").alias("domain"))
    skipped = F.struct(F.lit(OTHER).alias("label"), F.lit(None).cast("string").alias("domain"))
    found = F.transform_values(entries, lambda _, x: F.when(kind(x) == "STRING", bare(x)).when(kind(x) == "OBJECT", _label(x)).otherwise(skipped))
    return F.coalesce(found, F.from_json(F.lit("{}"), "map<string,struct<label:string,domain:string>>"))
