"""Deterministic test measurements as closed forms over ``spark.range``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The names, constants and formulas of the test measurements, as FIXTURES.md lists them.
BASE_MICROS = 1_000_000_000


def _frame(spark: SparkSession, n: int, step_micros: int, base: int, *columns: Column) -> DataFrame:
    ts = F.timestamp_micros(F.lit(base) + F.col("id") * step_micros).cast("timestamp_ntz").alias("timestamp")
    return spark.range(n).select(ts, *columns)


def _host(mod: int) -> Column:
    return F.concat(F.lit("host_"), F.lpad((F.col("id") % mod).cast("string"), 4, "0")).alias("tag_host")


def _region() -> Column:
    return F.when(F.col("id") % 2 == 0, "us-west").otherwise("us-east").alias("tag_region")


def _pick(values: list[str], name: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col("id") % len(values) + 1).cast("int")).alias(name)


def simple(spark: SparkSession, n: int) -> DataFrame:
    i = F.col("id")
    return _frame(spark, n, 1_000_000, BASE_MICROS, _host(10), _region(), (0.3 + 0.01 * i).alias("usage"), (0.7 - 0.01 * i).alias("idle"), (10 * i).alias("count"))


def mixed_types(spark: SparkSession, n: int) -> DataFrame:
    i = F.col("id")
    return _frame(spark, n, 1_000_000, BASE_MICROS, F.lit("server01").alias("tag_host"), (0.5 + 0.1 * (i % 5)).alias("cpu"), (100 + i).alias("requests"), F.when(i % 2 == 0, "ok").otherwise("error").alias("status"), (i % 3 != 0).alias("active"))


def cross_day(spark: SparkSession, days: int) -> DataFrame:
    """1,000 points a day, one a minute."""
    i = F.col("id")
    ts = F.timestamp_micros((F.floor(i / 1000) * 86_400 + (i % 1000) * 60) * 1_000_000).cast("timestamp_ntz").alias("timestamp")
    return spark.range(1000 * days).select(ts, _host(5), _region(), (0.5 + 0.001 * (i % 100)).alias("usage"), i.alias("count"))


def ohlcv(spark: SparkSession, n: int) -> DataFrame:
    i = F.col("id")
    p = 100 + (i % 50) * 0.1
    return _frame(spark, n, 60_000_000, BASE_MICROS, _pick(["600000", "600036", "000001"], "tag_symbol"), p.alias("open"), (p + 0.5).alias("high"), (p - 0.5).alias("low"), (p + 0.1).alias("close"), (1000 + i).alias("volume"))


def apm_trace(spark: SparkSession, n: int) -> DataFrame:
    i = F.col("id")
    return _frame(spark, n, 10_000_000, BASE_MICROS, _pick(["gateway", "orders", "users", "payments", "search"], "tag_service"), _pick(["prod", "staging"], "tag_env"), (20 + i % 200).alias("duration_ms"), F.when(i % 20 == 0, 500).otherwise(200).alias("status_code"), (i % 20 == 0).alias("is_error"), (i % 100 / 100).alias("cpu_usage"))


def iot_sensor(spark: SparkSession, n: int) -> DataFrame:
    i = F.col("id")
    return _frame(spark, n, 1_000_000, BASE_MICROS, F.concat(F.lit("device_"), (i % 20).cast("string")).alias("tag_device_id"), _pick(["zone-a", "zone-b", "zone-c"], "tag_region"), _pick(["temperature", "humidity", "pressure", "power"], "tag_device_type"), (20 + (i % 100) * 0.1).alias("value"), F.when(i % 7 == 0, 0).otherwise(100).alias("quality"))
