"""Life cycle of a measurement stored by tier and UTC day: compaction, tiering, retention, archive.

Jobs are ordinary Spark reads and writes of whole files; files change by ``publish.change``. So a
job that dies is finished by running it again with the same staging folder, without losing or
doubling a row, and rows that were appended meanwhile stay. Between the new files' renames and the
old files' removal a reader may see rows twice; last write wins by key settles that.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import tag_columns
from .publish import Files, change, finish
from .write import last_write_wins

#: Compression of a tier's files.
CODECS = {"active": "snappy", "warm": "snappy", "cold": "zstd", "archive": "zstd"}
#: Writer options of each compaction level: later levels are written once and read often.
LEVELS = {0: {"compression": "snappy"}, 1: {"compression": "snappy", "parquet.block.size": 64 << 20}, 2: {"compression": "zstd", "parquet.block.size": 128 << 20}}
#: Files of levels 0 and 1 from which on they are compacted.
FULL = (8, 4)
#: How many retention periods a tier's partitions live; the archive's are never dropped.
LIFETIMES = {"active": 1, "warm": 2, "cold": 4}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The measurement over all tiers, files of different schemas aligned by name."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def _partition(df: DataFrame, tier: str, day: date) -> DataFrame:
    return df.where((F.col("tier") == tier) & (F.col("date") == F.lit(day)))


def _files(spark: SparkSession, path: str, tier: str, day: date | None) -> list[str]:
    """The partition's files, or all of the tier's without a day, relative to ``path``."""
    if day is None:
        return [f"tier={tier}/{n}" for n in Files(spark).below(f"{path}/tier={tier}")]
    part = f"tier={tier}/date={day.isoformat()}"
    return [f"{part}/{n}" for n in Files(spark).list(f"{path}/{part}")]


def _read_files(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return spark.read.option("mergeSchema", "true").option("basePath", path).parquet(*[f"{path}/{n}" for n in names])


def _rewrite(spark: SparkSession, path: str, names: Callable[[], list[str]], folder: str, transform, prefix: str, **options) -> bool:
    """Replace files by what ``transform`` makes of their rows, after what an earlier run left undone; False without files."""
    if Files(spark).exists(f"{folder}/plan"):
        change(spark, folder, path, lambda to: None, [], prefix)
        finish(spark, folder)
    if not (mine := names()):
        return False

    def write(to: str) -> None:
        writer = transform(_read_files(spark, path, mine)).write.mode("overwrite")
        writer.options(**options).partitionBy("tier", "date").parquet(to)

    change(spark, folder, path, write, mine, prefix)
    finish(spark, folder)
    return True


def level_of(name: Column) -> Column:
    """A file's compaction level, by its name."""
    return F.when(name.rlike("^(L2-|compacted-)"), 2).when(name.startswith("L1-"), 1).otherwise(0)


def _newest(part: DataFrame, seq: str | None) -> DataFrame:
    key = [*tag_columns(part), "timestamp"]
    kept = last_write_wins(part, [*key, "tier", "date"], seq, null_keys=True) if seq in part.columns else part
    return kept.repartitionByRange("date", *key).sortWithinPartitions("date", *key)


def compact(spark: SparkSession, path: str, staging: str, day: date | None = None, tier: str = "active", seq: str | None = "write_seq", level: int = 2) -> DataFrame:
    """Rewrite one day of a tier, or in one job all of them: last write wins by (tags, timestamp), sorted by series and time.

    A null tag is one that is not set, like any other value. Files are as many as the rows need.
    """
    _rewrite(spark, path, lambda: _files(spark, path, tier, day), f"{staging}/compact-{tier}-{day or 'all'}", lambda df: _newest(df, seq), f"L{level}-", **LEVELS[level])
    return read(spark, path).where(F.col("tier") == tier) if day is None else _partition(read(spark, path), tier, day)


def compact_levels(spark: SparkSession, path: str, staging: str, tier: str = "active", seq: str | None = "write_seq") -> list[int]:
    """Level 0 files become level 1 in days with ``FULL[0]`` of them or more, then level 1 files level 2 from ``FULL[1]`` on; returns the levels that were written.

    One job for each level, over all such days.
    """

    def full(level: int, least: int) -> list[str]:
        by: dict[str, list[str]] = {}
        for n in Files(spark).below(f"{path}/tier={tier}"):
            if _level(n) == level:
                by.setdefault(n.rpartition("/")[0], []).append(f"tier={tier}/{n}")
        return [n for names in by.values() if len(names) >= least for n in names]

    done = []
    for level, least in enumerate(FULL):
        if _rewrite(spark, path, lambda level=level, least=least: full(level, least), f"{staging}/level-{level}-{tier}", lambda df: _newest(df, seq), f"L{level + 1}-", **LEVELS[level + 1]):
            done.append(level + 1)
    return done


def _level(name: str) -> int:
    last = name.rpartition("/")[2]
    return 2 if last.startswith(("L2-", "compacted-")) else 1 if last.startswith("L1-") else 0


def files(spark: SparkSession, path: str) -> DataFrame:
    """tier, date, file_name, level, size, modified of every file, the last modified first."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    part = lambda k: F.regexp_extract("path", rf"/{k}=([^/]+)/", 1)
    name = F.element_at(F.split("path", "/"), -1)
    out = found.select(part("tier").alias("tier"), part("date").cast("date").alias("date"), name.alias("file_name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return out.withColumn("level", level_of(F.col("file_name"))).orderBy(F.col("modified").desc(), "tier", "date", "file_name")


def move(spark: SparkSession, path: str, staging: str, moves: list[tuple[str, date, str]]) -> None:
    """Rewrite days (from tier, day, to tier) into other tiers with their codecs, one job for each tier."""
    for to in sorted({t for *_, t in moves}):
        mine = [(tier, day) for tier, day, t in moves if t == to]
        names = lambda mine=mine: [n for tier, day in mine for n in _files(spark, path, tier, day)]
        _rewrite(spark, path, names, f"{staging}/move-{to}", lambda df, to=to: df.withColumn("tier", F.lit(to)), "moved-", compression=CODECS[to])


def drop_partitions(spark: SparkSession, path: str, partitions: list[tuple[str, date]]) -> None:
    """Remove partition folders, through the file system that holds ``path``."""
    jvm = spark._jvm
    for tier, day in partitions:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/tier={tier}/date={day.isoformat()}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def partitions(df: DataFrame) -> DataFrame:
    """The (tier, date) pairs there are."""
    return df.select("tier", "date").distinct()


def expired(parts: DataFrame, today: date, days: int) -> DataFrame:
    """Partitions beyond their tier's lifetime of ``days``; never the archive's."""
    limit = F.lit(None).cast("date")
    for tier, n in LIFETIMES.items():
        limit = F.when(F.col("tier") == tier, F.lit(today - timedelta(days=n * days))).otherwise(limit)
    return parts.where(F.col("date") < limit)


def apply_retention(spark: SparkSession, path: str, today: date, days: int) -> list[tuple[str, date]]:
    """Drop expired partitions; returns them (a list of days, not of rows)."""
    gone = [(r["tier"], r["date"]) for r in expired(partitions(read(spark, path)), today, days).collect()]
    drop_partitions(spark, path, gone)
    return gone


def archive(spark: SparkSession, path: str, day: date, target: str, tier: str = "cold") -> None:
    """Write a partition as JSON Lines."""
    _partition(read(spark, path), tier, day).write.mode("overwrite").json(target)


def demote_due(spark: SparkSession, path: str, staging: str, today: date) -> list[tuple[str, date, str]]:
    """Move every partition whose age asks for a colder tier, one job for each tier; returns (from, day, to)."""
    rank = {"active": 0, "warm": 1, "cold": 2, "archive": 3}
    due = []
    for r in partitions(read(spark, path)).orderBy("date", "tier").collect():  # a row a partition
        age = max(0, (today - r["date"]).days)
        to = "cold" if age > 14 else "warm" if age > 3 else r["tier"]
        if rank[to] > rank[r["tier"]]:
            due.append((r["tier"], r["date"], to))
    move(spark, path, staging, due)
    return due
