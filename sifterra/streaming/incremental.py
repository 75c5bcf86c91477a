"""Incremental forms of resume and keyed upsert (an extension: the batch forms are in
``operators``)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, key: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """Each key once, within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, time: str, by: str, size: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Rows of each window and key, final once the watermark has passed."""
    out = stream.withWatermark(time, delay).groupBy(F.window(time, size), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), by, "n")


def upsert(key: list[str], order: list[str], path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the last row of each key, in a table of numbered versions
    ``v<epoch>``.

    The last version is found on disk, so a restart goes on from it.  A version counts once
    its success mark is there; an epoch that has one is not written again.  Two versions
    are kept.  Each batch rewrites the table: state, not history, must fit that.
    """
    from sifterra.operators.agreement import last_wins

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        whole = sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))
        if epoch in whole:
            return
        before = [v for v in whole if v < epoch]
        rows = spark.read.schema(batch.schema).parquet(f"{path}/v{before[-1]}").unionByName(batch) if before else batch
        last_wins(rows, key, order).write.mode("overwrite").parquet(f"{path}/v{epoch}")
        for v in before[:-1]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{v}"), True)

    return write


def infer(pending: DataFrame, client: Callable[[list[str]], list[str]], prompt: str, ident: str, batch: int = 20) -> DataFrame:
    """(id, prediction, error) from an injected client, ``batch`` prompts at a time; a client
    that raises gives an error row, and after five failed calls in a row the rest of the
    partition is given up as errors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = 0
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                if failed >= 5:
                    yield pd.DataFrame({"id": part[ident], "prediction": "ERROR: given up", "error": True})
                    continue
                try:
                    said, failed = client(part[prompt].tolist()), 0
                    yield pd.DataFrame({"id": part[ident], "prediction": said, "error": False})
                except Exception as problem:  # noqa: BLE001 - any failure of a client is a row
                    failed += 1
                    yield pd.DataFrame({"id": part[ident], "prediction": f"ERROR: {problem}", "error": True})

    return pending.select(ident, prompt).mapInPandas(run, "id long, prediction string, error boolean")


def pending(samples: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Samples without a result."""
    return samples.join(done.select(key).distinct(), key, "left_anti")
