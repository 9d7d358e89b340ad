"""Streams of points: micro-batch ingest, last-value state, windowed aggregates.

Recovery is the checkpoint's. Late points are always stored, in their own day's partition; a
watermark is only used where state has to be bounded. Watermarks need zoned timestamps, so
``timestamp`` is read as UTC there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.publish import Files, change
from ..operators.scan import last_per_series
from ..operators.write import laid_out


def ingest(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append each micro-batch by tier and day. ``every``: a processing-time trigger; else all there is, then stop.

    A batch is a change of its own folder, named by its id: one that died is finished when the
    stream runs it again, and one that was done is not done twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store = lambda to: laid_out(batch).write.mode("overwrite").partitionBy("tier", "date").parquet(to)
        change(batch.sparkSession, f"{checkpoint}/batches/{batch_id}", path, store, [], f"b{batch_id}-")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/stream")
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def keep_last(stream: DataFrame, path: str, checkpoint: str, series: list[str], order: list[str], cap: int, ttl_days: int | None = None, every: str | None = None) -> StreamingQuery:
    """Keep the newest row of at most ``cap`` series, the latest by ``order``, and none older than ``ttl_days`` before the newest.

    The state is a table: ``path``/state=<batch id>, made from the one before and the batch; the one
    before stays until the next batch, so a batch that is run again makes the same.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, files = batch.sparkSession, Files(batch.sparkSession)
        done = sorted(int(n.partition("=")[2]) for n in files.list(path) if n.startswith("state="))
        before = [k for k in done if k < batch_id]
        rows = batch if not before else spark.read.parquet(f"{path}/state={before[-1]}").unionByName(batch)
        newest = last_per_series(rows, series, order)
        if ttl_days is not None:
            edge = newest.agg((F.max(order[0]) - F.expr(f"INTERVAL {int(ttl_days)} DAYS")).alias("edge"))
            newest = newest.join(F.broadcast(edge), F.col(order[0]) >= F.col("edge")).drop("edge")  # one row
        newest = newest.orderBy(*[F.col(c).desc() for c in (*order, *series)]).limit(cap)
        newest.write.mode("overwrite").parquet(f"{path}/state={batch_id}")
        for k in before[:-1]:
            files.delete(f"{path}/state={k}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/stream")
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def kept(spark: SparkSession, path: str) -> DataFrame:
    """What ``keep_last`` holds now."""
    last = max(int(n.partition("=")[2]) for n in Files(spark).list(path) if n.startswith("state="))
    return spark.read.parquet(f"{path}/state={last}")


def last_values(stream: DataFrame, series: list[str], order: list[str]) -> DataFrame:
    """The newest row of each series so far; for update or complete mode. ``keep_last`` bounds what it keeps."""
    rest = [c for c in stream.columns if c not in series]
    return stream.groupBy(*series).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))


def _zoned(df: DataFrame, late: str | None) -> DataFrame:
    df = df.withColumn("event_time", F.col("timestamp").cast("timestamp"))
    return df.withWatermark("event_time", late) if late and df.isStreaming else df


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    ntz = lambda c: F.col(c).cast("timestamp_ntz")
    return df.select(ntz("w.start").alias("window_start"), ntz("w.end").alias("window_end"), *keys, *[c for c in df.columns if c not in ("w", *keys)])


def windowed(df: DataFrame, width: str, keys: list[str], aggs: list, slide: str | None = None, late: str | None = "10 minutes") -> DataFrame:
    """Tumbling or sliding windows, the same for batch and stream."""
    return _named(_zoned(df, late).groupBy(F.window("event_time", width, slide or width).alias("w"), *keys).agg(*aggs), keys)


def sessions(df: DataFrame, gap: str, keys: list[str], aggs: list, late: str | None = "10 minutes") -> DataFrame:
    return _named(_zoned(df, late).groupBy(F.session_window("event_time", gap).alias("w"), *keys).agg(*aggs), keys)


def distinct_points(stream: DataFrame, key: list[str], late: str = "10 minutes") -> DataFrame:
    """First arrival of each key within the watermark."""
    return _zoned(stream, late).dropDuplicatesWithinWatermark(key).drop("event_time")


# Alert thresholds (metric, above which, severity).
ALERTS = (("cpu_pct", 90.0, "critical"), ("mem_pct", 90.0, "critical"), ("disk_pct", 85.0, "warning"), ("load_1m", 8.0, "warning"), ("temp_c", 80.0, "critical"), ("l0_files", 16.0, "warning"))


def alerts(metrics: DataFrame, rules: tuple = ALERTS) -> DataFrame:
    """One row for each metric column above its threshold."""
    hits = [F.when(F.col(m) > t, F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(t).alias("threshold"), F.lit(s).alias("severity"))) for m, t, s in rules if m in metrics.columns]
    keep = [c for c in metrics.columns if c not in {m for m, _, _ in rules}]
    return metrics.select(*keep, F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("a")).select(*keep, "a.*")
