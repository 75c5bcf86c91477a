"""Experiment files: models, prompts and limits, as a plan of runs and prompts of samples."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sifterra.operators.restructure import prompt

RUN = "language string, provider string, model string, folder string, system string, template string, suffix string, options map<string,string>"


@dataclass(frozen=True)
class Experiment:
    languages: list[str]
    models: list[dict[str, Any]]
    prompts: dict[str, dict[str, str]]
    limit: int | None
    batch_size: int
    metadata_path: str


def parsed(text: str) -> Experiment:
    """The experiment of a YAML (or JSON) text; ValueError if a language has no prompts.

    Models that are not ``enabled`` are left out.  YAML needs the ``yaml`` package.
    """
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        import yaml

        found = yaml.safe_load(text)
    run = found["experiment"]
    languages = [run["prompt_language"]] if isinstance(run["prompt_language"], str) else list(run["prompt_language"])
    prompts = found.get("prompts") or {}
    if missing := [x for x in languages if x not in prompts]:
        raise ValueError(f"no prompts for {missing}")
    models = [m for m in found.get("models") or [] if m.get("enabled", False)]
    return Experiment(languages, models, prompts, run.get("limit"), int(run.get("batch_size", 20)), found.get("data", {}).get("metadata_path", ""))


def load(spark: SparkSession, path: str) -> Experiment:
    """The experiment file at ``path``, wherever Spark can read."""
    return parsed(spark.read.text(path, wholetext=True).first()[0])


def runs(spark: SparkSession, experiment: Experiment) -> DataFrame:
    """A row (``RUN``) for each language and enabled model; ``folder`` is where its answers go
    below the output folder, ``options`` the model's other settings as JSON."""
    rows = []
    for language in experiment.languages:
        words = experiment.prompts[language]
        for m in experiment.models:
            name = str(m["name"])
            safe = name.replace("/", "__").replace(":", "-").replace(" ", "_")
            more = {k: json.dumps(v) for k, v in m.items() if k not in ("provider", "enabled", "name", "user_prompt_suffix")}
            rows.append((language, m.get("provider"), name, f"{language}/{safe}", words["system"].strip(), words["user_template"], m.get("user_prompt_suffix"), more))
    return spark.createDataFrame(rows, RUN)


def samples(records: DataFrame, experiment: Experiment, order: str) -> DataFrame:
    """The first ``limit`` records in order (all without a limit): the limit is the feature."""
    return records if experiment.limit is None else records.orderBy(order).limit(experiment.limit)


def user_prompt(template: str, options: Column, suffix: str | None = None, **columns: Column) -> Column:
    """The template filled with ``columns`` and the options A to D (missing ones are empty), and
    the model's suffix after a blank line."""
    letters = {k: F.try_element_at(options, F.lit(k)) for k in "ABCD"}
    out = prompt(template, **columns, **letters)
    return F.concat(out, F.lit(f"\n\n{suffix}")) if suffix else out
