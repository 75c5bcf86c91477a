"""Inference that can be killed and goes on: retries, commits by flush, resume, breaker.

Answers are appended to a table in flushes.  A flush is one Spark job that writes one new
folder; it counts once its success mark stands, so a killed flush leaves nothing that is
read, and its samples are asked again.  A sample whose answer is committed is not asked
again (anti join), and where a sample has several answers, ``results`` gives one: a good one
before an error, then that of the first folder by name.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sifterra.storage import discard, materialize

#: What a client returns for each prompt: its answer, or its answer and the tokens it took.
Reply = str | tuple[str, dict[str, int]]
Client = Callable[[list[str]], Sequence[Reply]]
TOKENS = "struct<input:long,output:long,cached:long>"
# How error answers begin.
FAILED = ("CONNECTION_FAILED", "ERROR", "EMPTY_OUTPUT")
LONGEST_WAIT = 60.0


class Halted(RuntimeError):
    """A partition met too many errors in a row; what was answered before is committed."""


def _patiently(client: Client, prompts: list[str], retries: int, wait: float) -> Sequence[Reply]:
    """The client's replies; a client that raises is asked again after growing waits."""
    for attempt in range(retries):
        try:
            said = list(client(prompts))
            if len(said) != len(prompts):
                raise ValueError(f"{len(said)} replies to {len(prompts)} prompts")
            return said
        except Exception as problem:  # noqa: BLE001 - any failure of a client counts
            if attempt == retries - 1:
                return [f"CONNECTION_FAILED: {problem}"] * len(prompts)
        time.sleep(min(LONGEST_WAIT, wait * 2**attempt))
    return ["CONNECTION_FAILED"] * len(prompts)


def answered(samples: DataFrame, client: Client, prompt: str, ident: str, batch: int = 20, retries: int = 5, wait: float = 8.0, halt_after: int = 5) -> DataFrame:
    """(ident, prediction, token_used, error) from an injected client, ``batch`` prompts at a
    time.  After ``halt_after`` errors in a row a partition asks no more and gives no rows
    for what is left of it.  A null prompt is an empty one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = 0
        for frame in frames:
            for lo in range(0, len(frame), batch):
                if row >= halt_after:
                    return
                part = frame.iloc[lo : lo + batch]
                said = [r if isinstance(r, tuple) else (r, {}) for r in _patiently(client, part[prompt].fillna("").tolist(), retries, wait)]
                texts = [(t or "").strip() or "EMPTY_OUTPUT" for t, _ in said]
                error = [t.startswith(FAILED) for t in texts]
                for n, e in enumerate(error, 1):
                    row = row + 1 if e else 0
                    if row >= halt_after:
                        break
                used = [{k: int(u.get(k, 0) or 0) for k in ("input", "output", "cached")} for _, u in said]
                yield pd.DataFrame({ident: part[ident], "prediction": texts, "token_used": used, "error": error}).iloc[:n]

    kind = samples.schema[ident].dataType.simpleString()
    return samples.select(ident, prompt).mapInPandas(run, f"`{ident}` {kind}, prediction string, token_used {TOKENS}, error boolean")


def _committed(spark: SparkSession, path: str) -> list[str]:
    """Folders of ``path`` whose job ended well."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(folder):
        return []
    found = [s.getPath().toString() for s in fs.listStatus(folder) if s.isDirectory()]
    return sorted(p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS")))


def results(spark: SparkSession, path: str, ident: str, kind: T.DataType) -> DataFrame:
    """(ident, prediction, token_used, error): one committed answer for each sample."""
    schema = T.StructType([T.StructField(ident, kind), *T._parse_datatype_string(f"prediction string, token_used {TOKENS}, error boolean")])
    folders = _committed(spark, path)
    rows = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
    best = rows.withColumn("__file", F.col("_metadata.file_path") if folders else F.lit("")).groupBy(ident).agg(F.min_by(F.struct(*schema.names), F.struct("error", "__file")).alias("r"))
    return best.select("r.*")


def pending(samples: DataFrame, done: DataFrame, ident: str, again: bool = True) -> DataFrame:
    """Samples without an answer; ``again``: an error is none."""
    return samples.join((done.where("not error") if again else done).select(ident), ident, "left_anti")


def run(samples: DataFrame, client: Client, path: str, prompt: str = "prompt", ident: str = "id", flush_rows: int = 100_000, again: bool = True, **how: float) -> list[dict]:
    """Ask for all samples that lack an answer in the table at ``path``; a row of counts
    (asked, answered, errors, input, output, cached) for each flush.

    Samples are dealt to flushes by a hash of their id, so each flush holds about
    ``flush_rows``.  Counters ride on the write of the flush (``observe``).  A flush in which
    a partition halted is committed, then ``Halted`` is raised; another run goes on.
    ``ident`` is unique in ``samples``.
    """
    spark, kind = samples.sparkSession, samples.schema[ident].dataType
    open_ = materialize(pending(samples, results(spark, path, ident, kind), ident, again).select(ident, prompt), "pending")
    flushes = max(1, -(-open_.count() // flush_rows))
    flush = F.pmod(F.xxhash64(ident), F.lit(flushes))
    done = []
    for k, n in sorted(open_.groupBy(flush.alias("k")).count().collect()):  # a row for each flush
        after = Observation()
        rows = answered(open_.where(flush == k), client, prompt, ident, **how)
        tokens = [F.coalesce(F.sum(f"token_used.{c}"), F.lit(0)).alias(c) for c in ("input", "output", "cached")]
        rows = rows.observe(after, F.count(F.lit(1)).alias("answered"), F.count_if("error").alias("errors"), *tokens)
        rows.write.parquet(f"{path.rstrip('/')}/flush-{uuid.uuid4().hex}")
        done.append({"asked": n} | after.get)
        if done[-1]["answered"] < n:
            raise Halted(f"errors in a row: {done[-1]}")
    discard(open_)
    return done
