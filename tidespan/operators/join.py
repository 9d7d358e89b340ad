"""Joins that time series need beside the built-in ones: as-of, interval, series dimension, NOT IN."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeseries import micros


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], values: list[str], left_on: str = "timestamp", right_on: str = "timestamp", width_micros: int | None = None) -> DataFrame:
    """Each left row with ``values`` of the last right row of the same ``by`` not after it (null if none).

    One union and one window pass: no range condition, no pairs. With ``width_micros`` a series is
    cut into time ranges of that width, each a window of its own, and the last right row before a
    range is carried into it; so a hot series is not one task.
    """
    r = right.select(*by, F.col(right_on).alias("__t"), F.lit(0).alias("__side"), F.struct(F.col(right_on).alias("at"), *values).alias("__v"))
    l = left.select(*by, F.col(left_on).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"))  # noqa: E741
    both = r.unionByName(l, allowMissingColumns=True)
    if width_micros is None:
        seen = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
        out = both.withColumn("__last", F.last("__v", ignorenulls=True).over(seen))
    else:
        both = both.withColumn("__b", F.floor(micros(F.col("__t")) / width_micros))
        ranges = both.groupBy(*by, "__b").agg(F.max_by("__v", F.when(F.col("__side") == 0, F.col("__t"))).alias("__own"))
        before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        carried = ranges.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__b").alias("__rb"), F.last("__own", ignorenulls=True).over(before).alias("__carry"))
        on = [both[c].eqNullSafe(carried[f"__{c}"]) for c in by] + [both["__b"].eqNullSafe(carried["__rb"])]
        seen = Window.partitionBy(*by, "__b").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
        out = both.join(carried, on).withColumn("__last", F.coalesce(F.last("__v", ignorenulls=True).over(seen), F.col("__carry")))
    return out.where("__side = 1").select("__row.*", F.col("__last.at").alias("matched_at"), *[F.col(f"__last.{v}").alias(v) for v in values])


def interval_join(points: DataFrame, intervals: DataFrame, by: list[str], start: str, end: str, width_micros: int, on: str = "timestamp") -> DataFrame:
    """Points and the intervals [start, end] of the same ``by`` that hold them.

    Both meet by time buckets of ``width_micros``, so it is an equi-join with a residual condition;
    an interval is repeated for each bucket it touches.
    """
    bucket = lambda c: F.floor(micros(F.col(c)) / width_micros)
    i = intervals.withColumn("__b", F.explode(F.sequence(bucket(start), bucket(end))))
    p = points.withColumn("__b", bucket(on))
    return p.join(i, [*by, "__b"]).where(F.col(on).between(F.col(start), F.col(end))).drop("__b")


def with_series_tags(facts: DataFrame, series: DataFrame, key: str = "series_id", keep_unknown: bool = True) -> DataFrame:
    """Facts with their series' tags; unknown series keep null tags or go."""
    return facts.join(series, key, "left" if keep_unknown else "inner")


def not_in(left: DataFrame, column: str, right: DataFrame, value: str) -> DataFrame:
    """Rows of ``left`` whose ``column`` is NOT IN ``value`` of ``right``, as SQL has it for nulls.

    An empty ``right`` keeps all rows, a null in it keeps none, and otherwise a null ``column`` goes.
    Spark builds all of ``right`` into one table on the driver for this; here its distinct values are
    sorted and merged by key, and only the two counts of it that decide about nulls are broadcast.
    """
    values = right.select(F.col(value).alias("__v"))
    counts = values.agg(F.count(F.lit(1)).alias("__rows"), F.count("__v").alias("__known"))
    missing = left.join(values.distinct().hint("merge"), F.col(column) == F.col("__v"), "left_anti")
    kept = (F.col("__rows") == 0) | ((F.col("__rows") == F.col("__known")) & F.col(column).isNotNull())
    return missing.join(F.broadcast(counts), kept).select(*left.columns)
