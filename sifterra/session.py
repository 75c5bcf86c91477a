"""Session builder with the settings that the library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, memory: str = "8g", name: str = "sifterra", **more: str) -> SparkSession:
    """A local session; on a cluster, pass an own session to every function instead."""
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": memory} | more
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
