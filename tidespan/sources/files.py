"""Import and export of points: JSON, JSON Lines, CSV, Parquet, Arrow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timeseries import micros
from ..model import TAG, field_columns, tag_columns

POINT = T.StructType([
    T.StructField("measurement", T.StringType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("timestamp", T.LongType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def read_json_points(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Raw points (field values as text) of a JSON array or of JSON Lines, and the records that are none."""
    df = spark.read.schema(POINT).option("mode", "PERMISSIVE").option("multiLine", str(not lines).lower()).json(path)
    bad = F.col("_corrupt_record").isNotNull() | F.col("measurement").isNull() | F.col("timestamp").isNull()
    return df.where(~bad).drop("_corrupt_record"), df.where(bad)


def typed(value: str) -> str:
    """A CSV or JSON value: integer first, then number, then boolean, then text."""
    return f"coalesce(CAST(try_cast({value} AS BIGINT) AS STRING), CAST(try_cast({value} AS DOUBLE) AS STRING), {value})"


def read_csv_points(spark: SparkSession, path: str, fields: dict[str, str] | None = None) -> DataFrame:
    """A compact frame of a CSV file: measurement, timestamp (microseconds), tag_* and fields.

    Empty values are absent. Field types are given, or found: all-integer columns are bigint,
    all-number columns double, true/false boolean, all others text.
    """
    df = spark.read.option("header", "true").option("emptyValue", None).csv(path)
    names = [c for c in df.columns if c not in ("measurement", "timestamp") and not c.startswith(TAG)]
    if fields is None:
        no = lambda c, t: F.count(F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), 1))
        kinds = ("bigint", "double", "boolean")
        found = df.agg(F.lit(0).alias("_"), *[no(c, t).alias(f"{c}:{t}") for c in names for t in kinds]).first()
        fields = {c: next((t for t in kinds if found[f"{c}:{t}"] == 0), "string") for c in names}
    ts = F.timestamp_micros(F.col("timestamp").cast("long")).cast("timestamp_ntz").alias("timestamp")
    return df.select("measurement", ts, *[c for c in df.columns if c.startswith(TAG)], *[F.col(c).cast(fields[c]).alias(c) for c in names])


def write_csv(df: DataFrame, path: str) -> None:
    """Tags and fields in name order after measurement and timestamp."""
    first = [c for c in ("measurement", "timestamp") if c in df.columns]
    df.select(*first, *sorted(tag_columns(df)), *sorted(field_columns(df))).write.mode("overwrite").option("header", "true").csv(path)


def write_json_points(df: DataFrame, path: str, measurement: str) -> None:
    """A compact frame as JSON Lines of points: field values as JSON text, timestamp in microseconds."""
    pairs = lambda names, cut, value: F.map_filter(F.create_map(*[x for c in names for x in (F.lit(c[cut:]), value(F.col(c)))]) if names else F.create_map().cast("map<string,string>"), lambda k, v: v.isNotNull())
    tags, fields = tag_columns(df), field_columns(df)
    point = F.struct(F.lit(measurement).alias("measurement"), pairs(tags, len(TAG), lambda c: c).alias("tags"), pairs(fields, 0, lambda c: c.cast("string")).alias("fields"), micros(F.col("timestamp")).alias("timestamp"))
    df.select(F.to_json(point).alias("value")).write.mode("overwrite").text(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Damaged files fail the read."""
    df = spark.read.option("ignoreCorruptFiles", "false").option("mergeSchema", "true").parquet(path)
    return df.select(*columns) if columns else df


def preview(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    return spark.read.parquet(path).limit(limit)


def from_arrow(spark: SparkSession, table) -> DataFrame:
    return spark.createDataFrame(table)


def describe(spark: SparkSession, path: str) -> DataFrame:
    """column_name, type, n_files, n_rows, n_bytes of a Parquet path, rows counted from the footers."""
    df = spark.read.parquet(path)
    total = df.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(F.max("file_size").alias("b"), F.count("*").alias("n")).agg(F.count("*").alias("n_files"), F.sum("n").alias("n_rows"), F.sum("b").alias("n_bytes"))
    names = spark.createDataFrame(df.dtypes, "column_name string, type string")
    return names.join(F.broadcast(total))  # one row


def rendered(df: DataFrame, kind: str) -> DataFrame:
    """Each row as a json, csv or tsv line, in the column ``value``; nulls stay visible in json."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    if kind == "json":
        return df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))
    return df.select(F.to_csv(row, {"sep": {"csv": ",", "tsv": "\t"}[kind]}).alias("value"))


def render(df: DataFrame, kind: str, cap: int = 5000) -> tuple[list[str], bool]:
    """Up to ``cap`` result rows as json, csv or tsv lines, and whether there were more."""
    got = [r[0] for r in rendered(df, kind).take(cap + 1)]
    return got[:cap], len(got) > cap
