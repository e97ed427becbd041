"""SparkSession factory with the settings every query of the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session in UTC with AQE and Arrow on; `extra` takes further Spark settings (dots as `__`)."""
    builder = SparkSession.builder.appName("tidemark")
    if master:
        builder = builder.master(master)
    conf = DEFAULTS | {k.replace("__", "."): v for k, v in extra.items()}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=conf).getOrCreate()
