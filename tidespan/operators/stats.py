"""Statistics of columns, files, tiers and snapshots, mergeable where it matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeseries import age_days, eligible_tier

INTEGERS = ("tinyint", "smallint", "int", "bigint")


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column: kind, n_rows, n_nulls, low, high (as text, exact). One pass.

    kind: integer, number or text; bounds are those by value of the kind.
    """
    types = dict(df.dtypes)
    aggs = []
    for c in columns:
        kind = "integer" if types[c] in INTEGERS else "number" if types[c] in ("float", "double") else "text"
        aggs.append(F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("kind"), F.count("*").alias("n_rows"), F.count(F.when(F.col(c).isNull(), 1)).alias("n_nulls"), F.min(c).cast("string").alias("low"), F.max(c).cast("string").alias("high")).alias(f"s_{c}"))
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[F.col(f"s_{c}") for c in columns])).alias("s")).select("s.*")


def merge_stats(*parts: DataFrame) -> DataFrame:
    """Statistics over several frames, from those of each; a column that is integer in one and number in another is number."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    out = [F.when(F.bool_and(F.col("kind") == "integer"), "integer").when(F.bool_and(F.col("kind") != "text"), "number").otherwise("text").alias("kind"), F.sum("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls")]
    for name, best in (("low", F.min), ("high", F.max)):
        by = {k: best(F.col(name).try_cast(t)).cast("string") for k, t in (("integer", "bigint"), ("number", "double"), ("text", "string"))}
        out.append(F.struct(*[v.alias(k) for k, v in by.items()]).alias(name))
    merged = every.groupBy("column_name").agg(*out)
    pick = lambda name: F.when(F.col("kind") == "integer", F.col(name)["integer"]).when(F.col("kind") == "number", F.col(name)["number"]).otherwise(F.col(name)["text"]).alias(name)
    return merged.select("column_name", "kind", "n_rows", "n_nulls", pick("low"), pick("high"))


def file_stats(df: DataFrame, tags: list[str]) -> DataFrame:
    """For each file read: rows, bytes, time bounds, and bounds and nulls of each tag."""
    bounds: list[Column] = []
    for t in tags:
        bounds += [F.min(t).alias(f"{t}_min"), F.max(t).alias(f"{t}_max"), F.count(F.when(F.col(t).isNull(), 1)).alias(f"{t}_nulls")]
    meta = df.withColumn("file_path", F.col("_metadata.file_path")).withColumn("file_size", F.col("_metadata.file_size"))
    return meta.groupBy("file_path").agg(F.count("*").alias("row_count"), F.max("file_size").alias("file_size"), F.min("timestamp").alias("ts_min"), F.max("timestamp").alias("ts_max"), *bounds)


def tier_totals(partitions: DataFrame, today: Column) -> DataFrame:
    """Totals of (tier, measurement, date, n_rows, n_bytes) rows, with age and the tier they may move to."""
    out = partitions.groupBy("tier", "measurement", "date").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_files"))
    age = age_days(F.col("date"), today)
    return out.withColumn("age_days", age).withColumn("eligible", eligible_tier(age))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files (path, n_rows) added and deleted between two snapshots, with their rows."""
    side = lambda a, b, name: a.join(b, "path", "left_anti").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")).select(F.lit(name).alias("change"), "n_files", "n_rows")
    return side(new, old, "added").unionByName(side(old, new, "deleted"))
