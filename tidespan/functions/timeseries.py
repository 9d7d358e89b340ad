"""Time buckets, series keys, partition transforms, tiers and rates as Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession, WindowSpec
from pyspark.sql import functions as F

SAFE_NAME = r"^[\p{L}\p{N}_.\-]+$"
WARM_AFTER_DAYS, COLD_AFTER_DAYS = 3, 14


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone, taken as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value).cast("timestamp_ntz")


def time_bucket(ts: Column, width_micros: int) -> Column:
    """Start of the bucket that holds ``ts``, truncating toward zero; null stays null."""
    if width_micros <= 0:
        raise ValueError("the bucket must be positive")
    value, width = micros(ts), F.lit(width_micros)
    return from_micros(value - value % width)  # % keeps the sign, so this truncates toward zero


def register(spark: SparkSession) -> None:
    """SQL functions, inlined by the optimizer."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION time_bucket(ts TIMESTAMP_NTZ, width BIGINT) RETURNS TIMESTAMP_NTZ RETURN CAST(timestamp_micros((unix_micros(CAST(ts AS TIMESTAMP)) DIV width) * width) AS TIMESTAMP_NTZ)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tier_for_age(days INT) RETURNS STRING RETURN CASE WHEN days > 14 THEN 'cold' WHEN days > 3 THEN 'warm' ELSE 'none' END")


def escape_key(text: Column) -> Column:
    """Backslash before backslash, comma, equals sign and space."""
    return F.regexp_replace(text, r"([\\,= ])", r"\\$1")


def series_key(measurement: Column, tags: Column) -> Column:
    """``measurement,k=v,...`` with escaped parts in key order; no tags leave the comma."""
    pairs = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(escape_key(e["key"]), F.lit("="), escape_key(e["value"])))
    return F.concat(escape_key(measurement), F.lit(","), F.array_join(pairs, ","))


def series_id(measurement: Column, tags: Column) -> Column:
    """An opaque grouping key; always compare the tags too."""
    return F.xxhash64(measurement, F.to_json(F.array_sort(F.map_entries(tags))))


def utc_date(ts: Column) -> Column:
    return F.to_date(ts)


def transform(kind: str, value: Column, n: int | None = None) -> Column:
    """Partition transforms: identity, day, hour, month, year, bucket(n), truncate(n), void."""
    formats = {"day": "yyyy-MM-dd", "hour": "yyyy-MM-dd-HH", "month": "yyyy-MM", "year": "yyyy"}
    if kind in formats:
        return F.date_format(value, formats[kind])
    if kind == "identity":
        return value
    if kind == "void":
        return F.lit(None).cast("string")
    if kind == "bucket":
        return F.pmod(F.hash(value.cast("string")), F.lit(n))  # the same for a number of any type
    if kind == "truncate":
        return F.substring(value, 1, n)
    raise ValueError(f"no such transform: {kind}")


def partition_path(names: list[str], values: list[Column]) -> Column:
    """``name=value/...``; null is the empty partition's name."""
    parts = [F.concat(F.lit(f"{n}="), F.coalesce(v.cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))) for n, v in zip(names, values)]
    return F.concat_ws("/", *parts)


def key_hex(key: Column) -> Column:
    """A key's bytes in lower-case hex; ``key_text`` reads it back."""
    return F.lower(F.hex(key))


def key_text(text: Column) -> Column:
    """The text of a hex key; null for what is no hex."""
    return F.unhex(text).cast("string")


def is_safe_name(name: Column) -> Column:
    return F.coalesce(name.rlike(SAFE_NAME), F.lit(False))


def age_days(day: Column, today: Column) -> Column:
    return F.greatest(F.datediff(today, day), F.lit(0))


def eligible_tier(days: Column) -> Column:
    return F.when(days > COLD_AFTER_DAYS, "cold").when(days > WARM_AFTER_DAYS, "warm").otherwise("none")


def parse_partition_dir(name: Column) -> Column:
    """The date of ``data_YYYYMMDD``; null for other names."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"^data_(\d{8})$", 1), F.lit("")), F.lit("yyyyMMdd")).cast("date")


def measurement_of(name: Column) -> Column:
    """The measurement of ``ts_<measurement>_YYYYMMDD``; the measurement may hold underscores."""
    return F.nullif(F.regexp_extract(name, r"^ts_(.+)_\d{8}$", 1), F.lit(""))


def duration_days(text: str) -> int:
    """Days of ``30d``."""
    if not (m := re.fullmatch(r"(\d+)d", text.strip())):
        raise ValueError(f"not a number of days: {text!r}")
    return int(m[1])


def field_value(text: Column) -> Column:
    """A JSON field value, bare or tagged (``{"Float": 1.5}``), as text; null stays null."""
    tagged = [F.get_json_object(text, f"$.{t}") for t in ("Float", "Integer", "String", "Boolean")]
    bare = F.when(text.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string")["v"]).otherwise(text)
    return F.when(text.startswith("{"), F.coalesce(*tagged)).when(text == "null", None).otherwise(bare)


def delta(value: Column, series: WindowSpec) -> Column:
    return value - F.lag(value).over(series)


def counter_rate(value: Column, ts: Column, series: WindowSpec) -> Column:
    """Change per second since the series' previous point; null for the first and for no time passed."""
    seconds = (micros(ts) - micros(F.lag(ts).over(series))) / 1e6
    return F.when(seconds != 0, delta(value, series) / seconds)
