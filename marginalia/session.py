"""A Spark session with the settings that the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def session(name: str = "marginalia", master: str | None = None, **settings: str) -> SparkSession:
    """The running session or a new one; master is left to spark-submit unless given."""
    from .sources import notes

    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    notes.register(spark)
    return spark
