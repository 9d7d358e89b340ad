"""Helpers shared by the corpus operators: scratch tables, words, safe joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
WORD_BREAKS = " \t\n\x0b\x0c\r"
WORD_BREAK_RE = r"[\x20\x09-\x0D]+"

#: A table of at most this many bytes may be broadcast; its rows and text are always counted first.
BROADCAST_BYTES = 16 << 20
#: Copies of the small side in a join that is spread over salts.
SALTS = 64
#: Keys that can each hold more than a HOT-th of a table's rows: no more than this many. Fewer rows than HOT_ROWS need no care.
HOT = 1_000
HOT_ROWS = 10_000


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder where all executors can read: below ``spark.checkpoint.dir``.

    Where that is unset a temporary folder does on a local master; on a cluster it is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        base = "file://" + tempfile.mkdtemp(prefix="tidespan-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tidespan/{context.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that still read them must be stored before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_array(text: Column) -> Column:
    """The words (runs outside ``WORD_BREAKS``) of ``text``; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(WORD_BREAKS))
    none = F.array().cast("array<string>")
    return F.when(text.isNull() | (trimmed == ""), none).otherwise(F.split(trimmed, WORD_BREAK_RE))


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas inside ``body`` use it."""
    return F.transform(F.array(value), body)[0]


def small_enough(df: DataFrame) -> bool:
    """Whether ``df`` has at most BROADCAST_BYTES, by its rows and the lengths of its strings."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    fixed = 16 * len(df.columns) + 32
    size = df.agg(F.sum(sum(texts, F.lit(fixed)).cast("long"))).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def _salted(big: DataFrame, small: DataFrame, on: Column, how: str) -> DataFrame:
    """Each row of ``big`` meets one of SALTS copies of ``small``; on compares columns of both."""
    # salts come from the rows' values, so that a task that runs again deals its rows as before
    values = [F.col(f"`{c}`") for c, kind in big.dtypes if not kind.startswith("map")]
    left = big.withColumn("__salt", F.pmod(F.xxhash64(*values, F.lit(17)), F.lit(SALTS)).cast("int"))
    right = small.withColumn("__salt_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, on & (F.col("__salt") == F.col("__salt_s")), how).drop("__salt", "__salt_s")


def join_lookup(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``big`` with a table that has one row per ``key`` (null matches null).

    The small side is broadcast only if it is counted to be ``small_enough``; beyond that both
    sides are spread over ``SALTS`` so that a hot key is not one task.
    """
    side = small.select(F.col(key).alias("__key"), *[c for c in small.columns if c != key])
    if small_enough(side):
        return big.join(F.broadcast(side), big[key].eqNullSafe(side["__key"]), how).drop("__key")
    return _salted(big, side, F.col(key).eqNullSafe(F.col("__key")), how).drop("__key")


def hot_keys(counts: DataFrame, key: str) -> DataFrame | None:
    """The keys of (key, n) that hold more than one HOT-th of all rows, so HOT at most; None without any."""
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    least = max((total or 0) / HOT, HOT_ROWS)
    return F.broadcast(materialize(counts.where(F.col("n") > least).select(key), "hot-keys")) if (most or 0) > least else None


def join_spread(big: DataFrame, small: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """Inner join on a key that is never null; counts: (key, n), the rows of ``big`` for each key.

    Keys that hold so many rows that one task would stand out are joined over salts, all others
    by an ordinary shuffle.
    """
    hot = hot_keys(counts, key)
    if hot is None:
        return big.join(small, key)
    side = small.withColumnRenamed(key, "__key")
    spread = _salted(big.join(hot, key, "left_semi"), side.join(hot.withColumnRenamed(key, "__key"), "__key", "left_semi"), F.col(key) == F.col("__key"), "inner").drop("__key")
    return spread.unionByName(big.join(hot, key, "left_anti").join(small, key).select(*spread.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
