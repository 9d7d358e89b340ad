"""Scans of a measurement: ranges, series, points, key lists, last values, earlier states.

Bounds are inclusive. A time predicate also restricts ``date`` where the measurement is
partitioned by it, since Spark does not derive one from the other.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import TAG, tag_columns


def time_range(df: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    for bound, keep in ((start, lambda c, b: c >= b), (end, lambda c, b: c <= b)):
        if bound is not None:
            df = df.where(keep(F.col("timestamp"), F.lit(bound).cast("timestamp_ntz")))
            if "date" in df.columns:
                df = df.where(keep(F.col("date"), F.lit(bound.date())))
    return df


def with_tags(df: DataFrame, tags: dict[str, str]) -> DataFrame:
    """Rows with all of ``tags``; a tag the measurement does not have, or null, matches none."""
    for k, v in tags.items():
        df = df.where(F.col(TAG + k) == v if TAG + k in df.columns else F.lit(False))
    return df


def range_scan(df: DataFrame, start: datetime | None = None, end: datetime | None = None, tags: dict[str, str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Subset match on tags, optional projection; order by timestamp where the caller needs it."""
    out = with_tags(time_range(df, start, end), tags or {})
    return out.select(*columns) if columns else out


def series_scan(df: DataFrame, tags: dict[str, str], start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """One series: exactly these tags, all others null."""
    others = [c for c in tag_columns(df) if c[len(TAG) :] not in tags]
    out = range_scan(df, start, end, tags)
    for c in others:
        out = out.where(F.col(c).isNull())
    return out


def point_lookup(df: DataFrame, tags: dict[str, str], at: datetime) -> DataFrame:
    return series_scan(df, tags, at, at).limit(1)


def multi_get(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Each row of ``keys`` (with ``idx``) and its point, or nulls; null tags match null tags.

    Left to the planner: a small key list is broadcast by its size, a large one is shuffled.
    """
    named = keys.select("idx", *[F.col(c).alias(f"__{c}") for c in on])
    cond = [named[f"__{c}"].eqNullSafe(df[c]) for c in on]
    values = [c for c in df.columns if c not in on]
    return named.join(df, cond, "left").select("idx", *[F.col(f"__{c}").alias(c) for c in on], *values)


def latest_first(order: list[str]) -> Column:
    return F.struct(*order)


def last_per_series(df: DataFrame, series: list[str], order: list[str]) -> DataFrame:
    """The newest row of each series (ties: by the later entries of ``order``), by partial aggregation."""
    rest = [c for c in df.columns if c not in series]
    best = F.max_by(F.struct(*rest), latest_first(order)).alias("r")
    return df.groupBy(*series).agg(best).select(*series, "r.*")


def last_overall(df: DataFrame, order: list[str]) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(1)


def as_of(df: DataFrame, seq: int, column: str = "write_seq") -> DataFrame:
    """The writes up to ``seq``: later ones are not seen."""
    return df.where(F.col(column) <= seq)


def page(df: DataFrame, key: str, start, limit: int, cap: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Keyset page: rows from ``start`` in key order, ``cap`` at most, and a one-row frame telling if more follow."""
    limit = max(1, min(limit, cap))
    rows = df.where(F.col(key) >= start).orderBy(key).limit(limit + 1)
    return rows.orderBy(key).limit(limit), rows.agg((F.count("*") > limit).alias("has_more"))
