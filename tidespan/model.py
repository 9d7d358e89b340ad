"""The data model: measurements in compact and extended layout, validation, inference.

Compact: ``timestamp, tag_<key>..., <field>...``, one typed column for each tag and field, with
the role in the column's metadata. Extended: ``timestamp, measurement, tag_keys, tag_values``.
Raw points: ``measurement, tags map, fields map (of JSON values), timestamp (microseconds)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.timeseries import is_safe_name, series_id, series_key

TAG = "tag_"


def tag_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(TAG)]


def field_columns(df: DataFrame) -> list[str]:
    own = {"timestamp", "measurement", "tags_hash", "write_seq", "date", "tier", "series_key"}
    return [c for c in df.columns if c not in own and not c.startswith(TAG)]


def compact(df: DataFrame, timestamp: str, tags: dict[str, str | Column], fields: dict[str, str | Column]) -> DataFrame:
    """A measurement from any table: tags as strings, fields as they are, roles in the metadata."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    out = [F.col(timestamp).cast("timestamp_ntz").alias("timestamp")]
    out += [col(c).cast("string").alias(TAG + k, metadata={"role": "tag"}) for k, c in tags.items()]
    out += [col(c).alias(k, metadata={"role": "field"}) for k, c in fields.items()]
    return df.select(*out)


def tags_map(df: DataFrame) -> Column:
    """The tags that are set, as a map."""
    keys = tag_columns(df)
    pairs = F.array(*[F.struct(F.lit(k[len(TAG) :]).alias("key"), F.col(k).alias("value")) for k in keys]) if keys else F.array().cast("array<struct<key:string,value:string>>")
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def with_series(df: DataFrame, measurement: str) -> DataFrame:
    """Add series_key (readable) and tags_hash (opaque)."""
    tags = tags_map(df)
    return df.withColumn("series_key", series_key(F.lit(measurement), tags)).withColumn("tags_hash", series_id(F.lit(measurement), tags))


def to_extended(df: DataFrame, measurement: str) -> DataFrame:
    tags = tags_map(df)
    return df.select("timestamp", F.lit(measurement).alias("measurement"), F.map_keys(tags).alias("tag_keys"), F.map_values(tags).alias("tag_values"), *field_columns(df))


def to_compact(df: DataFrame, keys: list[str]) -> DataFrame:
    """Extended layout to compact, for the given tag keys."""
    tags = F.map_from_arrays("tag_keys", "tag_values")
    rest = [c for c in df.columns if c not in ("timestamp", "measurement", "tag_keys", "tag_values")]
    return df.select("timestamp", *[F.try_element_at(tags, F.lit(k)).alias(TAG + k) for k in keys], *rest)


#: Validation errors, in the order in which they are looked for.
CHECKS = ("blank_measurement", "unsafe_measurement", "bad_timestamp", "no_fields", "bad_tag_key", "empty_field_key", "field_is_tag", "not_finite")


def validation_error(measurement: Column, tags: Column, fields: Column, ts_micros: Column) -> Column:
    """The first rule a raw point breaks (one of CHECKS), or null; fields: map of doubles."""
    keys = F.coalesce(F.map_keys(tags), F.array().cast("array<string>"))
    names = F.coalesce(F.map_keys(fields), F.array().cast("array<string>"))
    broken = (
        F.coalesce(F.trim(measurement) == "", F.lit(True)),
        ~is_safe_name(measurement),
        F.coalesce(ts_micros <= 0, F.lit(True)),
        F.size(names) == 0,
        F.exists(keys, lambda k: ~is_safe_name(k)),
        F.exists(names, lambda k: k == ""),
        F.arrays_overlap(names, keys),
        F.exists(F.map_values(fields), lambda v: F.isnan(v) | (F.abs(v) == float("inf"))),
    )
    out = F.when(broken[0], CHECKS[0])
    for rule, name in zip(broken[1:], CHECKS[1:]):
        out = out.when(rule, name)
    return out


def split_valid(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid raw points, and the others with the rule they break."""
    checked = points.withColumn("error", validation_error(F.col("measurement"), F.col("tags"), F.col("fields"), F.col("timestamp")))
    return checked.where("error IS NULL").drop("error"), checked.where("error IS NOT NULL")


def infer_keys(points: DataFrame, column: str) -> list[str]:
    """The union of all map keys of raw points, in order; one small aggregation."""
    return [r[0] for r in points.select(F.explode(F.map_keys(column)).alias("k")).distinct().orderBy("k").collect()]


def points_to_compact(points: DataFrame, tag_keys: list[str] | None = None, field_keys: list[str] | None = None) -> DataFrame:
    """Raw points to the compact layout; keys are inferred from all points if not given."""
    tag_keys = infer_keys(points, "tags") if tag_keys is None else tag_keys
    field_keys = infer_keys(points, "fields") if field_keys is None else field_keys
    at = lambda m, k: F.try_element_at(F.col(m), F.lit(k))
    return points.select("measurement", F.timestamp_micros("timestamp").cast("timestamp_ntz").alias("timestamp"), *[at("tags", k).alias(TAG + k) for k in tag_keys], *[at("fields", k).alias(k) for k in field_keys])
