"""Sinks: JSON lines, CSV, batches with a manifest, kept and dropped rows.

Each writes a whole new folder beside its target and renames it into place afterwards, so
a reader finds the old result or the new one (or, between two renames, none), never half
of one; a job that fails leaves the old one as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replaced(rows: DataFrame, path: str, write: Callable[[str], None]) -> None:
    """Let ``write`` fill a new folder, then put it in the place of ``path``."""
    mark = uuid.uuid4().hex
    jvm, made, old = rows.sparkSession._jvm, f"{path.rstrip('/')}.new-{mark}", f"{path.rstrip('/')}.old-{mark}"
    target, fresh, gone = (jvm.org.apache.hadoop.fs.Path(p) for p in (path.rstrip("/"), made, old))
    fs = target.getFileSystem(rows.sparkSession._jsparkSession.sessionState().newHadoopConf())
    try:
        write(made)
        had = fs.exists(target)
        if had and not fs.rename(target, gone):
            raise OSError(f"cannot move {path} away")
        if not fs.rename(fresh, target):
            if had:
                fs.rename(gone, target)
            raise OSError(f"cannot move {made} to {path}")
        if had:
            fs.delete(gone, True)
    finally:
        if fs.exists(fresh):
            fs.delete(fresh, True)


def json_lines(rows: DataFrame, path: str) -> None:
    replaced(rows, path, lambda p: rows.write.json(p))


def csv(rows: DataFrame, path: str) -> None:
    replaced(rows, path, lambda p: rows.write.option("header", True).csv(p))


def manifest(batched: DataFrame, group: str) -> DataFrame:
    """(batch_id, size, primary, groups): what each batch holds."""
    n = batched.groupBy("batch_id", group).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("batch_id").agg(F.sum("n").alias("size"), F.max_by(group, F.struct("n", group)).alias("primary"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(group, "n")))).alias("groups"))


def batches(batched: DataFrame, group: str, path: str) -> None:
    """One folder for each batch and the manifest; earlier batches go."""

    def write(p: str) -> None:
        batched.write.partitionBy("batch_id").json(f"{p}/batches")
        manifest(batched, group).write.json(f"{p}/manifest")

    replaced(batched, path, write)


def kept_and_dropped(rows: DataFrame, path: str, reason: str = "drop_reason") -> None:
    """Rows without a reason and rows with one, apart."""

    def write(p: str) -> None:
        rows.where(F.col(reason).isNull()).drop(reason).write.json(f"{p}/kept")
        rows.where(F.col(reason).isNotNull()).write.json(f"{p}/dropped")

    replaced(rows, path, write)
