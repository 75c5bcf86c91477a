"""Readers with declared schemas, page extraction, and path-derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MCQ = "id long, question string, options map<string,string>, domain string, subdomain string, correct_option string, correct_key string, level string, source_url array<string>, source array<string>, quality_flags array<string>, length_tier string, batch_id string"
ANNOTATION = "annotator string, batch_id string, mcq_id long, is_iaa boolean, selected_key string, flagged boolean, flag_note string, edits struct<question:string,subdomain:string,options:map<string,string>>, time_spent_ms long, submitted_at string"
ENVELOPE = f"annotator string, batch_id string, exported_at string, count int, n_answered int, n_flagged int, annotations array<struct<{', '.join(f'{c.split(chr(32), 1)[0]}:{c.split(chr(32), 1)[1]}' for c in ANNOTATION.split(', '))}>>"
PREDICTION = "id long, prediction string, error boolean, token_used struct<input:int,output:int,cached:int,cache_creation:int>"
# Labels of pages.
PAGE_LABELS = ["urdu_mcq", "urdu_other", "english", "skip"]


def json_array(spark: SparkSession, path: str, schema: str | T.StructType = MCQ) -> DataFrame:
    """Files that each hold one JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Annotations of all envelope files below ``path``, with file and position."""
    files = spark.read.schema(ENVELOPE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    each = files.select(F.col("_metadata.file_path").alias("file"), F.posexplode("annotations").alias("pos", "a"))
    return each.select("file", "pos", "a.*")


def named_files(spark: SparkSession, path: str, name: str, schema: str = MCQ) -> DataFrame:
    """Rows of all files of one name below ``path``; broken files are left out."""
    fields = T._parse_datatype_string(schema)
    fields = fields.add("_corrupt_record", T.StringType())
    rows = spark.read.schema(fields).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", True).option("pathGlobFilter", name).json(path)
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def keyed_labels(text: Column) -> Column:
    """JSON object of page -> label (a string or an object with ``label`` and ``domain``) as
    a map to (label, domain); unknown labels become 'skip'."""
    label = lambda v: F.coalesce(F.get_json_object(v, "$.label"), v)
    known = lambda v: F.when(F.lower(label(v)).isin(*PAGE_LABELS), F.lower(label(v))).otherwise("skip")
    return F.transform_values(F.from_json(text, "map<string,string>"), lambda k, v: F.struct(known(v).alias("label"), F.get_json_object(v, "$.domain").alias("domain")))


def latest_per_directory(files: DataFrame, path: str = "path") -> DataFrame:
    """The last file name of each directory."""
    folder, name = F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.regexp_extract(path, "([^/]*)$", 1)
    return files.groupBy(folder.alias("directory")).agg(F.max_by(path, name).alias(path))


def latest_stage(paths: DataFrame, path: str = "path", names: tuple[str, ...] = ()) -> DataFrame:
    """(path, stage) of the highest stage (``<N>-name``) that holds a file of one of ``names``,
    or of the highest at all if none does; ``paths`` are files.  One row, or none."""
    folder, n = F.regexp_extract(path, r"^(.*?(?:^|/)\d+-[^/]*)/", 1), F.regexp_extract(path, r"(?:^|/)(\d+)-[^/]*/", 1)
    has = F.regexp_extract(path, "([^/]*)$", 1).isin(*names) if names else F.lit(True)
    stages = paths.where(n != "").groupBy(folder.alias("folder"), n.cast("int").alias("stage")).agg(F.bool_or(has).alias("has"))
    best = stages.agg(F.max_by(F.struct("folder", "stage"), F.struct("has", "stage", "folder")).alias("x")).where("x is not null")
    return best.select(F.col("x.folder").alias(path), "x.stage")


def prediction_path(path: Column) -> list[Column]:
    """language and model from ``.../<language>/<model>/predictions.json``."""
    return [F.regexp_extract(path, "([^/]+)/[^/]+/[^/]+$", 1).alias("language"), F.regexp_extract(path, "([^/]+)/[^/]+$", 1).alias("model")]


def predictions(spark: SparkSession, path: str, schema: str = PREDICTION, name: str = "predictions.json") -> DataFrame:
    """Rows of all ``<language>/<model>/predictions.json`` below ``path``, the names of the folders
    as columns; the plan is a scan, so a filter on them prunes no file."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(path)
    return rows.select(*prediction_path(F.col("_metadata.file_path")), "*")


def latest_results(spark: SparkSession, path: str, schema: str, pattern: str = "results_*.json") -> DataFrame:
    """Rows of the last file by name in each folder below ``path`` (files of ``pattern``), with
    ``model``, the folder's name.  Only the chosen files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path")
    chosen = [r.path for r in latest_per_directory(files).select("path").collect()]  # a path for each model
    if not chosen:
        return spark.createDataFrame([], T._parse_datatype_string(schema)).withColumn("model", F.lit(None).cast("string"))
    rows = spark.read.schema(schema).option("multiLine", True).json(chosen)
    return rows.withColumn("model", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1))


def submission_name(path: Column) -> list[Column]:
    """annotator and batch_id from ``Name__batch_NNN.json``."""
    rx = r"([A-Za-z]+)__(batch_\d{3})\.json$"
    return [F.regexp_extract(path, rx, 1).alias("annotator"), F.regexp_extract(path, rx, 2).alias("batch_id")]


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as (path, content), whatever the case of the extension."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,JPG,JPEG,PNG}").option("recursiveFileLookup", True).load(path).select("path", "content")


def links(html: Column) -> Column:
    """Targets of href attributes in order."""
    return F.regexp_extract_all(html, F.lit("(?i)href\\s*=\\s*[\"']([^\"']*)[\"']"), 1)


def page_questions(pages: DataFrame, html: str = "html", marker: str = "<h3>") -> DataFrame:
    """Questions of scraped pages: after each ``marker`` a question, then a list of options
    and the line that names the answer's letter."""
    each = pages.select("*", F.posexplode(F.split(html, marker, -1)).alias("pos", "part")).where("pos > 0")
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", ""), "\\s+", " "))
    options = F.transform(F.regexp_extract_all("part", F.lit("(?is)<li[^>]*>(.*?)</li>"), 1), plain)
    return each.select(*[c for c in pages.columns if c != html], "pos", plain(F.regexp_extract("part", "(?s)^(.*?)</h3>", 1)).alias("question"), options.alias("options"), F.upper(F.regexp_extract("part", "(?i)answer[^A-Za-z]*(?:is)?[^A-Za-z]*([A-E])\\b", 1)).alias("answer"))
