"""A Spark session with the settings and SQL functions that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .functions.timeseries import register

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, app: str = "tidespan", **extra: str) -> SparkSession:
    """Build or get a session; ``extra`` overrides SETTINGS, with dots written as two underscores."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("__", "."): v for k, v in extra.items()})
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    register(spark)
    return spark
