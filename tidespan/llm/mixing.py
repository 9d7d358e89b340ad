"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Targets: the mix has ``total_share`` of all words. Each source gets its weight's part of what is
left to share; a source whose part exceeds ``max_epochs`` times its size is clamped there and the
rest is shared again, until no part is above its cap.

Repetitions: a source with r = target / size takes every document floor(r) times; the fraction
that is left takes some once more. Documents of a source are dealt to shards of bounded size by
a seeded hash. In a shard, document sizes run from large to small (by powers of two, in seeded
order within a power), and one is taken whenever the words owed are at least 1 - fraction of its
size. So what a large document takes too much, or leaves, is never more than smaller ones can make
up, and a shard ends within about one of its smallest documents of what it owes. Documents are
always taken whole.

Defined results: a null text has size 0 and is taken 0 times; a source of size 0 has target 0;
a null source is a source of its own, last in order; rows equal in id and text are dealt together,
in no fixed order among themselves, rows without an id by their text; an empty table gives an empty result; other columns pass through ``mix``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_lookup, materialize, word_count

SHARD_DOCS = 5_000
SEED = 42


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to sources of (source, weight, source_size).

    Each round is one aggregation over the sources; it clamps at least one more source.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = 0.0, -1  # words per unit of weight
    while True:
        full = F.col("weight") * F.lit(level) > cap
        used, weight, n = sources.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
        if n == clamped or not weight or total <= (used or 0.0):
            break
        level, clamped = (total - (used or 0.0)) / weight, n
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Weight the sources in order of code points, null last, by ``weights``, repeating.

    Ranks come from a range-partitioned sort: each partition's count first, then places inside.
    """
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    placed = sources.repartitionByRange(n, order).sortWithinPartitions(order).select("source", "source_size", F.monotonically_increasing_id().alias("at"))
    placed = materialize(placed.select("source", "source_size", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("k")), "mix-order")
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    start = placed.groupBy("part").count().select("part", F.coalesce(before, F.lit(0)).alias("start"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("start") + F.col("k"), F.lit(len(weights))) + 1).cast("int"))
    return placed.join(F.broadcast(start), "part").select("source", "source_size", weight.alias("weight"))


def _take(fraction: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 for each document of a shard, in order, that is taken once more."""
    out, owed = np.zeros(len(size), np.int64), 0.0
    for k, (f, s) in enumerate(zip(fraction.tolist(), size.tolist())):
        owed += f * s
        if s and owed >= s * (1 - f):
            out[k], owed = 1, owed - s
    return out


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["power", "order", "doc_id"], ascending=[False, True, True], kind="stable")
    extra = _take(rows["fraction"].to_numpy(), rows["size"].to_numpy())
    return rows[["row_id", "doc_id", "source", "size"]].assign(times=rows["whole"] + extra)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """A stored table, so that row_id stays what it is."""
    return materialize(
        docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("h"), *more),
        "mix-sizes",
    )


def _repetitions(sized: DataFrame, weights: tuple[float, ...], total_share: float, max_epochs: float, seed: int) -> DataFrame:
    sized = sized.select("row_id", "doc_id", "source", "size", "h")
    sources = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "mix-sources")
    total = total_share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    shares = water_fill(materialize(cyclic_weights(sources, weights), "mix-weights"), total, max_epochs)
    counts = sources.select(F.col("source").alias("s"), "n_docs")
    targets = materialize(shares.join(counts, shares["source"].eqNullSafe(counts["s"])).drop("s", "weight"), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = join_lookup(sized, targets.select("source", rate.alias("rate"), "n_docs"), "source")
    code = lambda salt: F.xxhash64(F.col("doc_id"), F.col("size"), F.col("h"), F.lit(seed), F.lit(salt))
    rows = rows.select(
        "row_id", "doc_id", "source", "size",
        F.floor("rate").cast("long").alias("whole"), (F.col("rate") - F.floor("rate")).alias("fraction"),
        F.pmod(code("shard"), F.ceil(F.col("n_docs") / SHARD_DOCS)).alias("shard"),
        F.floor(F.log2(F.col("size") + F.lit(1))).cast("int").alias("power"), code("order").alias("order"),
    )
    taken = rows.groupBy("source", "shard").applyInPandas(_shard, "row_id long, doc_id long, source string, size long, times long")
    return join_lookup(taken, targets.select("source", "source_size", "target"), "source")


def plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total_share: float = 1.5, max_epochs: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken: one row for each row of ``docs``."""
    out = _repetitions(_sized(docs, id_col, text_col, source_col), weights, total_share, max_epochs, seed)
    return out.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total_share: float = 1.5, max_epochs: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, with their columns, as often as the mix takes them."""
    sized = _sized(docs, id_col, text_col, source_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    times = _repetitions(sized, weights, total_share, max_epochs, seed).where("times > 0").select("row_id", "times")
    return sized.select("row_id", "__row").join(times, "row_id").select("__row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("__row.*")
