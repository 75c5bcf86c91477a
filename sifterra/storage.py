"""Lineage cuts that survive lost executors.

Intermediate tables go, as Parquet, to the folder that the session names in
``spark.checkpoint.dir``; every executor and the driver must see it.  Only where
that setting is missing (local runs, tests) a folder of this process is used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, without a trailing slash."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sifterra-")
        atexit.register(shutil.rmtree, found[len("file://") :], True)
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


#: Scratch folders of this process that were not discarded.
_made: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``clear`` deletes."""
    path = f"{shared_dir(spark)}/sifterra/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of what was written."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sifterra_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    _made.discard(path)


def discard(df: DataFrame | None) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    path = getattr(df, "_sifterra_path", None)
    if path is not None:
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this process: to be called when the results that read
    them are written.  Results that are not written yet cannot be read any more."""
    for path in sorted(_made):
        _delete(spark, path)


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    """Shuffle partitions of the session, or ``at_least`` if that is more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), at_least)
