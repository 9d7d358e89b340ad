"""Writes: last write wins, field merges, and partitioned append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import tag_columns


def _total(df: DataFrame, seq: str, rest: list[str]) -> Column:
    """Newest by ``seq``; rows equal in it by their other columns, so that the winner is always the same."""
    kinds = dict(df.dtypes)
    return F.struct(seq, *[F.to_json(c) if kinds[c].startswith("map") else F.col(c) for c in sorted(rest) if c != seq])


def last_write_wins(df: DataFrame, key: list[str], seq: str = "write_seq", null_keys: bool = False) -> DataFrame:
    """One row for each key, that of the greatest ``seq`` (equal ones: by the other columns).

    Rows with a null in the key all stay, or with ``null_keys`` a null is a value like others. A
    partial aggregation, so duplicates meet on the map side and hot keys shuffle one row a task.
    """
    some = " OR ".join(f"`{k}` IS NULL" for k in key)
    whole = df if null_keys else df.where(f"NOT ({some})")
    rest = [c for c in df.columns if c not in key]
    kept = whole.groupBy(*key).agg(F.max_by(F.struct(*rest), _total(df, seq, rest)).alias("r")).select(*key, "r.*").select(*df.columns)
    return kept if null_keys else kept.unionByName(df.where(some))


def merge_fields(df: DataFrame, key: list[str], fields: list[str], seq: str = "write_seq") -> DataFrame:
    """One row for each key; each field has its last value that is not null (of equal ``seq`` the greatest)."""
    return df.groupBy(*key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), _total(df, seq, [f]))).alias(f) for f in fields])


def rank_writes(df: DataFrame, key: list[str], seq: str = "write_seq") -> DataFrame:
    """All writes with their place, 1 for the newest; equal ones in the order that ``last_write_wins`` has."""
    rest = [c for c in df.columns if c not in key]
    return df.withColumn("write_rank", F.row_number().over(Window.partitionBy(*key).orderBy(_total(df, seq, rest).desc())))


def laid_out(df: DataFrame, tier: str = "active") -> DataFrame:
    """Rows with tier and UTC day, dealt by ranges of day, series and time.

    Ranges follow the rows: a hot day, or a hot series, takes as many tasks and files as its share
    of the rows, and small days share a task.
    """
    out = df.withColumn("tier", F.lit(tier)).withColumn("date", F.to_date("timestamp"))
    order = ["date", *tag_columns(df), "timestamp"]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


def append(df: DataFrame, path: str, tier: str = "active") -> None:
    """Append a measurement, partitioned by tier and UTC day, files sorted by series and time."""
    laid_out(df, tier).write.mode("append").partitionBy("tier", "date").parquet(path)


def widen(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Align to ``schema`` (name to type): missing columns null, int to double and so on widened.

    A change that would lose values (double to int, string to number) is refused.
    """
    wider = {("int", "bigint"), ("int", "double"), ("bigint", "double"), ("float", "double"), ("void", None)}
    have, out = dict(df.dtypes), []
    for name, kind in schema.items():
        own = have.get(name)
        if own not in (None, kind, "void") and (own, kind) not in wider:
            raise TypeError(f"{name}: {own} can't become {kind}")
        out.append((F.col(name) if own else F.lit(None)).cast(kind).alias(name))
    return df.select(*out)


