"""SQL entry points: views over tiers, a read-only gate, result caps and a timeout."""

from __future__ import annotations

import threading
import uuid
from datetime import date

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SQL_BYTES = 10_000
MAX_ROWS = 5_000
#: Commands that only tell something.
TELLING = ("Show", "Describe")


class NotReadOnly(ValueError):
    pass


def check_read_only(text: str, spark: SparkSession | None = None) -> str:
    """The statement, if it only reads: Spark's parser tells queries, EXPLAIN, SHOW and DESCRIBE from all others."""
    body = text.strip().rstrip(";").strip()
    if not body:
        raise NotReadOnly("empty statement")
    if len(text.encode()) > MAX_SQL_BYTES:
        raise NotReadOnly(f"more than {MAX_SQL_BYTES} bytes")
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(body)]
    except Exception as e:  # a parse error of Spark's own class
        raise NotReadOnly(f"not one statement: {e}") from e
    gateway, package = spark.sparkContext._gateway, "org.apache.spark.sql.catalyst.plans.logical."
    while todo:
        plan = todo.pop()
        name = plan.getClass().getSimpleName()
        if name == "ExplainCommand":
            todo.append(plan.logicalPlan())
        elif not name.startswith(TELLING) and any(is_instance_of(gateway, plan, package + c) for c in ("Command", "ParsedStatement")):
            raise NotReadOnly(f"not a query: {name}")
        inner = plan.children()
        todo += [inner.apply(k) for k in range(inner.size())]
    return body


def frame(spark: SparkSession, text: str) -> DataFrame:
    """The result of a read-only statement, as a DataFrame."""
    return spark.sql(check_read_only(text, spark))


def union_tiers(*parts: DataFrame) -> DataFrame:
    """One frame over tiers, aligned by column name, missing columns null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def register(name: str, *parts: DataFrame, hide: tuple[str, ...] = ("tags_hash",)) -> None:
    union_tiers(*parts).drop(*hide).createOrReplaceTempView(name)


def measurement_view(spark: SparkSession, name: str, path: str, since: date | None = None) -> None:
    """A view over a stored measurement's tiers; ``since`` restricts the days, so older partitions are not read."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    register(name, df if since is None else df.where(F.col("date") >= F.lit(since)))


def query(spark: SparkSession, text: str, limit: int = MAX_ROWS, timeout: float | None = 30) -> tuple[list, bool]:
    """Rows of a read-only statement for display, at most ``limit``, and whether there are more; cancelled after ``timeout`` seconds.

    ``frame`` gives all rows, as a DataFrame.
    """
    df = frame(spark, text)
    tag = f"q-{uuid.uuid4().hex}"
    timer = threading.Timer(timeout, spark.sparkContext.cancelJobsWithTag, [tag]) if timeout else None
    spark.sparkContext.addJobTag(tag)
    try:
        if timer:
            timer.start()
        rows = df.take(limit + 1)
    finally:
        if timer:
            timer.cancel()
        spark.sparkContext.removeJobTag(tag)
    return rows[:limit], len(rows) > limit


def tables(spark: SparkSession) -> list[str]:
    """Registered measurements, without the engine's own."""
    return sorted(t.name for t in spark.catalog.listTables() if not t.name.startswith("sys_"))
