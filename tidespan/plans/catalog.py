"""Registered queries over the fixture tables, each with its DuckDB equivalent.

Two kinds: the engine's own operators through their Python API, and SQL families that Spark
provides, in the form a user of the engine writes them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import timeseries as ts
from ..model import compact, tags_map, to_compact, to_extended, validation_error, with_series
from ..operators import join, lifecycle, scan, stats, write
from ..operators.lifecycle import expired
from ..operators.versions import VersionedTable
from ..scratch import new_path
from ..session import register
from ..sources import files, fixtures
from ..streaming.ingest import alerts, ingest, last_values, sessions, windowed
from .families import FAMILIES
from .sql import union_tiers

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return compact(table(spark, sf_dir, "events"), "ts", {"event_type": "event_type", "user_id": "user_id"}, {"value": "value", "k": k, "event_id": "event_id"})


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(table(spark, sf_dir, "lineitem"), "l_shipdate", {"returnflag": "l_returnflag", "linestatus": "l_linestatus"}, {"quantity": "l_quantity", "extendedprice": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"})


E_SQL = "SELECT ts AS timestamp, event_type AS tag_event_type, CAST(user_id AS VARCHAR) AS tag_user_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id FROM events"
FROM, TO = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12)


# --- scans -------------------------------------------------------------------------------------


@query(f"SELECT * FROM ({E_SQL}) WHERE timestamp BETWEEN '2024-01-10' AND '2024-01-12' AND tag_event_type = 'click'")
def scan_range(spark, sf_dir):
    return scan.range_scan(events(spark, sf_dir), FROM, TO, {"event_type": "click"})


@query(f"SELECT timestamp, value FROM ({E_SQL}) WHERE timestamp BETWEEN '2024-01-10' AND '2024-01-12'")
def scan_projection(spark, sf_dir):
    return scan.range_scan(events(spark, sf_dir), FROM, TO, columns=["timestamp", "value"])


@query(f"SELECT * FROM ({E_SQL}) WHERE tag_event_type = 'click' AND tag_user_id = '7'")
def scan_series(spark, sf_dir):
    return scan.series_scan(events(spark, sf_dir), {"event_type": "click", "user_id": "7"})


@query(f"SELECT * FROM ({E_SQL}) WHERE event_id = 100")
def point_lookup(spark, sf_dir):
    df = events(spark, sf_dir)
    p = df.where("event_id = 100").first()  # the point that is asked for
    return scan.point_lookup(df, {"event_type": p["tag_event_type"], "user_id": p["tag_user_id"]}, p["timestamp"]) if p else df.limit(0)


@query("SELECT idx, e.ts AS timestamp, e.value FROM (SELECT event_id AS idx, CASE WHEN event_id % 2 = 0 THEN user_id ELSE -1 END AS u, event_type AS t, ts AS at FROM events WHERE event_id < 50) q LEFT JOIN events e ON e.user_id = q.u AND e.event_type = q.t AND e.ts = q.at")
def multi_get(spark, sf_dir):
    df = events(spark, sf_dir).select("timestamp", "tag_event_type", "tag_user_id", "value").withColumn("at", F.col("timestamp"))
    user = F.when(F.col("event_id") % 2 == 0, F.col("user_id")).otherwise(-1).cast("string")
    keys = table(spark, sf_dir, "events").where("event_id < 50").select(F.col("event_id").alias("idx"), user.alias("tag_user_id"), F.col("event_type").alias("tag_event_type"), F.col("ts").alias("at"))
    return scan.multi_get(df, keys, ["tag_user_id", "tag_event_type", "at"]).select("idx", "timestamp", "value")


@query(f"SELECT tag_event_type, tag_user_id, arg_max(value, (timestamp, event_id)) AS value, max(timestamp) AS timestamp FROM ({E_SQL}) GROUP BY 1, 2")
def last_per_series(spark, sf_dir):
    return scan.last_per_series(events(spark, sf_dir), ["tag_event_type", "tag_user_id"], ["timestamp", "event_id"]).select("tag_event_type", "tag_user_id", "value", "timestamp")


@query(f"SELECT * FROM ({E_SQL}) ORDER BY timestamp DESC, event_id DESC LIMIT 1")
def last_overall(spark, sf_dir):
    return scan.last_overall(events(spark, sf_dir), ["timestamp", "event_id"])


@query("SELECT event_id, value FROM events WHERE event_id >= 500 ORDER BY event_id LIMIT 50")
def keyset_page(spark, sf_dir):
    return scan.page(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", 500, 50)[0]


@query("SELECT event_id, value FROM events WHERE event_id % 3 <= 1")
def snapshot_read(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "value", (F.col("event_id") % 3).alias("write_seq"))
    return scan.as_of(df, 1).drop("write_seq")


# --- predicates --------------------------------------------------------------------------------


@query(f"SELECT * FROM ({E_SQL}) WHERE tag_event_type = 'view'")
def tag_filter_eq(spark, sf_dir):
    return scan.with_tags(events(spark, sf_dir), {"event_type": "view"})


@query(f"SELECT * FROM ({E_SQL}) WHERE false")
def tag_filter_absent(spark, sf_dir):
    return scan.with_tags(events(spark, sf_dir), {"host": "a"})


@query("SELECT event_id FROM events WHERE (value > 50 OR event_type = 'click') AND NOT user_id < 10")
def pred_and_or_not(spark, sf_dir):
    return table(spark, sf_dir, "events").where(((F.col("value") > 50) | (F.col("event_type") == "click")) & ~(F.col("user_id") < 10)).select("event_id")


@query("SELECT event_id FROM events WHERE user_id IN (1, 2, 3, 50) AND value BETWEEN 1 AND 80")
def pred_in_list(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("user_id").isin(1, 2, 3, 50) & F.col("value").between(1, 80)).select("event_id")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value FROM events WHERE (CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END) IS NULL OR NOT ((CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END) > 20)")
def pred_null(spark, sf_dir):
    v = F.when(F.col("event_id") % 4 != 0, F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", v.alias("value")).where(F.col("value").isNull() | ~(F.col("value") > 20))


@query("SELECT event_id FROM events WHERE event_type <> 'click'")
def pred_noteq(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("event_type") != "click").select("event_id")


# --- functions ---------------------------------------------------------------------------------


@query("SELECT make_timestamp((epoch_us(ts) // 3600000000) * 3600000000) AS bucket, event_type AS tag_event_type, round(avg(value), 6) AS avg_value, count(*) AS cnt FROM events GROUP BY 1, 2")
def time_bucket_avg(spark, sf_dir):
    bucket = ts.time_bucket(F.col("timestamp"), 3_600_000_000).alias("bucket")
    return events(spark, sf_dir).groupBy(bucket, "tag_event_type").agg(F.round(F.avg("value"), 6).alias("avg_value"), F.count("*").alias("cnt"))


@query("SELECT make_timestamp((epoch_us(ts) // 86400000000) * 86400000000) AS bucket, count(*) AS cnt FROM events GROUP BY 1 ORDER BY 1")
def time_bucket_sql(spark, sf_dir):
    register(spark)
    events(spark, sf_dir).createOrReplaceTempView("events_m")
    return spark.sql("SELECT time_bucket(timestamp, 86400000000) AS bucket, count(*) AS cnt FROM events_m GROUP BY 1 ORDER BY 1")


@query("SELECT 'events,event_type=' || event_type || ',user_id=' || user_id AS series_key, count(*) AS n FROM events GROUP BY 1")
def series_key(spark, sf_dir):
    return with_series(events(spark, sf_dir), "events").groupBy("series_key").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT p_partkey, 'm\\ x,k=' || replace(replace(replace(p_name, '\\', '\\\\'), ' ', '\\ '), ',', '\\,') AS series_key FROM part")
def series_key_escaped(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", ts.series_key(F.lit("m x"), F.create_map(F.lit("k"), F.col("p_name"))).alias("series_key")).distinct()


@query("SELECT count(DISTINCT (event_type, user_id)) AS n_series FROM events")
def series_cardinality(spark, sf_dir):
    return with_series(events(spark, sf_dir), "events").select("tags_hash", "series_key").distinct().agg(F.count("*").alias("n_series"))


for _kind, _format in (("day", "%Y-%m-%d"), ("hour", "%Y-%m-%d-%H"), ("month", "%Y-%m"), ("year", "%Y")):

    def _partition(spark, sf_dir, kind=_kind):
        return table(spark, sf_dir, "events").groupBy(ts.transform(kind, F.col("ts")).alias("p")).agg(F.count("*").alias("n"))

    _partition.__name__ = f"partition_{_kind}"
    query(f"SELECT strftime(ts, '{_format}') AS p, count(*) AS n FROM events GROUP BY 1")(_partition)


@query("SELECT substr(p_name, 1, 5) AS p, count(*) AS n, max(NULL) AS void FROM part GROUP BY 1")
def partition_truncate(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(ts.transform("truncate", F.col("p_name"), 5).alias("p")).agg(F.count("*").alias("n"), F.max(ts.transform("void", F.col("p_name"))).cast("int").alias("void"))


@query("SELECT count(DISTINCT user_id) AS n_values, true AS stable FROM events")
def partition_bucket(spark, sf_dir):
    b = table(spark, sf_dir, "events").select("user_id", ts.transform("bucket", F.col("user_id"), 16).alias("b")).distinct()
    return b.agg(F.countDistinct("user_id").alias("n_values"), ((F.count("*") == F.countDistinct("user_id")) & F.bool_and(F.col("b").between(0, 15))).alias("stable"))


@query("SELECT ts AS timestamp, 'events' AS measurement, ['event_type', 'user_id'] AS tag_keys, [event_type, CAST(user_id AS VARCHAR)] AS tag_values, value FROM events")
def extended_layout(spark, sf_dir):
    return to_extended(events(spark, sf_dir).drop("k", "event_id"), "events")


@query(f"SELECT timestamp, tag_event_type, tag_user_id, value FROM ({E_SQL})")
def compact_from_extended(spark, sf_dir):
    return to_compact(to_extended(events(spark, sf_dir).drop("k", "event_id"), "events"), ["event_type", "user_id"])


@query("""SELECT coalesce(CASE WHEN event_id % 7 = 0 THEN 'blank_measurement' WHEN event_id % 7 = 1 THEN 'unsafe_measurement' WHEN event_id % 7 = 2 THEN 'bad_timestamp'
    WHEN event_id % 7 = 3 THEN 'no_fields' WHEN event_id % 7 = 4 THEN 'bad_tag_key' WHEN event_id % 7 = 5 THEN 'not_finite' END, 'ok') AS error, count(*) AS n FROM events GROUP BY 1""")
def validate_points(spark, sf_dir):
    k = F.col("event_id") % 7
    df = table(spark, sf_dir, "events").select(
        F.when(k == 0, " ").when(k == 1, "a/b").otherwise("cpu").alias("measurement"),
        F.create_map(F.when(k == 4, "bad key").otherwise("host"), F.lit("a")).alias("tags"),
        F.when(k == 3, F.create_map().cast("map<string,double>")).when(k == 5, F.create_map(F.lit("v"), F.lit(float("nan")))).otherwise(F.create_map(F.lit("v"), F.col("value"))).alias("fields"),
        F.when(k == 2, 0).otherwise(ts.micros(F.col("ts"))).alias("timestamp"),
    )
    error = validation_error(F.col("measurement"), F.col("tags"), F.col("fields"), F.col("timestamp"))
    return df.groupBy(F.coalesce(error, F.lit("ok")).alias("error")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS v, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE 'ok' END AS w FROM events")
def field_values(spark, sf_dir):
    bare = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"Integer":'), F.col("event_id").cast("string"), F.lit("}"))).otherwise('"ok"')
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("v"), ts.field_value(bare).alias("w"))


# --- writes ------------------------------------------------------------------------------------

TWICE = "SELECT event_id, ts, user_id, value, 1 AS write_seq FROM events UNION ALL SELECT event_id, ts, user_id, value * 2, 2 FROM events WHERE event_id % 3 = 0"


def _twice(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", F.lit(1).alias("write_seq"))
    return e.unionByName(e.where("event_id % 3 = 0").withColumn("value", F.col("value") * 2).withColumn("write_seq", F.lit(2)))


@query(f"SELECT event_id, ts, user_id, value, write_seq FROM ({TWICE}) QUALIFY row_number() OVER (PARTITION BY event_id, ts ORDER BY write_seq DESC) = 1")
def dedup_lww(spark, sf_dir):
    return write.last_write_wins(_twice(spark, sf_dir), ["event_id", "ts"])


@query("""SELECT event_id, arg_max(a, s) FILTER (a IS NOT NULL) AS a, arg_max(b, s) FILTER (b IS NOT NULL) AS b FROM (
    SELECT event_id, value AS a, NULL AS b, 1 AS s FROM events UNION ALL SELECT event_id, NULL, user_id, 2 FROM events UNION ALL SELECT event_id, value + 1, NULL, 3 FROM events WHERE event_id % 2 = 0) GROUP BY event_id""")
def merge_fields(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    none = F.lit(None)
    one = e.select("event_id", F.col("value").alias("a"), none.cast("long").alias("b"), F.lit(1).alias("s"))
    two = e.select("event_id", none.cast("double").alias("a"), F.col("user_id").alias("b"), F.lit(2).alias("s"))
    three = e.where("event_id % 2 = 0").select("event_id", (F.col("value") + 1).alias("a"), none.cast("long").alias("b"), F.lit(3).alias("s"))
    return write.merge_fields(one.unionByName(two).unionByName(three), ["event_id"], ["a", "b"], "s")


@query("SELECT event_id, value, CASE WHEN event_id % 2 = 0 THEN user_id END AS extra FROM events")
def union_tiers_aligned(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    hot = e.where("event_id % 2 = 0").select("event_id", "value", F.col("user_id").alias("extra"))
    return union_tiers(hot, e.where("event_id % 2 = 1").select("value", "event_id"))


# --- life cycle and statistics -----------------------------------------------------------------

TODAY = dt.date(2024, 1, 31)


@query("SELECT CAST(ts AS DATE) AS date, date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS age_days, CASE WHEN date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') > 14 THEN 'cold' WHEN date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') > 3 THEN 'warm' ELSE 'none' END AS eligible FROM events GROUP BY 1")
def tier_eligibility(spark, sf_dir):
    age = ts.age_days(F.col("date"), F.lit(TODAY))
    days = table(spark, sf_dir, "events").select(ts.utc_date(F.col("ts")).alias("date")).distinct()
    return days.select("date", age.cast("long").alias("age_days"), ts.eligible_tier(age).alias("eligible"))


PARTS = "SELECT CASE WHEN day(ts) % 4 = 0 THEN 'archive' WHEN day(ts) % 4 = 1 THEN 'active' WHEN day(ts) % 4 = 2 THEN 'warm' ELSE 'cold' END AS tier, event_type AS measurement, CAST(ts AS DATE) AS date, count(*) AS n_rows, 10 * count(*) AS n_bytes FROM events GROUP BY ALL"


def _parts(spark, sf_dir):
    d = F.dayofmonth("ts") % 4
    tier = F.when(d == 0, "archive").when(d == 1, "active").when(d == 2, "warm").otherwise("cold")
    return table(spark, sf_dir, "events").groupBy(tier.alias("tier"), F.col("event_type").alias("measurement"), ts.utc_date(F.col("ts")).alias("date")).agg(F.count("*").alias("n_rows"), (10 * F.count("*")).alias("n_bytes"))


@query(f"SELECT tier, measurement, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, max(date_diff('day', date, DATE '2024-01-31')) AS oldest FROM ({PARTS}) GROUP BY 1, 2")
def tier_totals(spark, sf_dir):
    t = stats.tier_totals(_parts(spark, sf_dir), F.lit(TODAY))
    return t.groupBy("tier", "measurement").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"), F.max("age_days").cast("long").alias("oldest"))


@query(f"SELECT DISTINCT tier, date FROM ({PARTS}) WHERE date < CASE tier WHEN 'active' THEN DATE '2024-01-26' WHEN 'warm' THEN DATE '2024-01-21' WHEN 'cold' THEN DATE '2024-01-11' END")
def retention_expired(spark, sf_dir):
    return expired(_parts(spark, sf_dir).select("tier", "date").distinct(), TODAY, 5)


@query("SELECT event_id, round(CASE WHEN s <> 0 THEN d / s END, 6) AS rate FROM (SELECT event_id, value - lag(value) OVER w AS d, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def counter_rate(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.round(ts.counter_rate(F.col("value"), F.col("ts"), w), 6).alias("rate"))


@query("SELECT event_id, 'cpu_pct' AS metric, value AS value, CAST(90.0 AS DOUBLE) AS threshold, 'critical' AS severity FROM events WHERE value > 90 UNION ALL SELECT event_id, 'load_1m', value / 10, CAST(8.0 AS DOUBLE), 'warning' FROM events WHERE value / 10 > 8")
def metric_alerts(spark, sf_dir):
    return alerts(table(spark, sf_dir, "events").select("event_id", F.col("value").alias("cpu_pct"), (F.col("value") / 10).alias("load_1m")))


@query("SELECT 'value' AS column_name, count(*) AS n_rows, count(*) - count(value) AS n_nulls, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events UNION ALL SELECT 'user_id', count(*), count(*) - count(user_id), CAST(min(user_id) AS DOUBLE), CAST(max(user_id) AS DOUBLE) FROM events")
def column_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    parts = [stats.column_stats(e.where(f"event_id % 2 = {k}"), ["value", "user_id"]) for k in (0, 1)]
    return stats.merge_stats(*parts).select("column_name", "n_rows", "n_nulls", F.round(F.col("low").cast("double"), 6).alias("low"), F.round(F.col("high").cast("double"), 6).alias("high"))


@query("SELECT 'added' AS change, count(*) AS n_files, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows FROM (SELECT user_id, count(*) AS n FROM events WHERE user_id % 3 = 2 GROUP BY 1) UNION ALL SELECT 'deleted', count(*), CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT user_id, count(*) AS n FROM events WHERE user_id % 3 = 0 GROUP BY 1)")
def snapshot_diff(spark, sf_dir):
    f = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), "user_id").agg(F.count("*").alias("n_rows"))
    return stats.snapshot_diff(f.where("user_id % 3 <> 2").drop("user_id"), f.where("user_id % 3 <> 0").drop("user_id"))


@query("SELECT DISTINCT event_type AS measurement FROM events")
def distinct_measurements(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("measurement")).distinct()


# --- joins -------------------------------------------------------------------------------------


@query("SELECT a.event_id, a.ts AS timestamp, a.user_id, b.ts AS matched_at, b.value AS last_view FROM (SELECT * FROM events WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def asof_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("ts", "timestamp")
    clicks = e.where("event_type = 'click'").select("event_id", "timestamp", "user_id")
    views = e.where("event_type = 'view'").groupBy("user_id", "timestamp").agg(F.max_by("value", "event_id").alias("last_view"))
    return join.as_of_join(clicks, views, ["user_id"], ["last_view"])


@query("SELECT a.event_id, b.event_id AS around FROM events a JOIN (SELECT user_id, event_id, ts - INTERVAL 2 HOUR AS lo, ts + INTERVAL 2 HOUR AS hi FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.ts BETWEEN b.lo AND b.hi")
def interval_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("ts", "timestamp")
    near = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("around"), F.expr("timestamp - INTERVAL 2 HOURS").alias("lo"), F.expr("timestamp + INTERVAL 2 HOURS").alias("hi"))
    return join.interval_join(e.select("event_id", "user_id", "timestamp"), near, ["user_id"], "lo", "hi", 4 * 3_600_000_000).select("event_id", "around")


@query("SELECT e.event_id, CASE WHEN e.user_id % 5 > 0 THEN e.event_type END AS tag FROM events e")
def join_series_dim(spark, sf_dir):
    e = with_series(events(spark, sf_dir), "events").withColumnRenamed("tags_hash", "series_id")
    series = e.where("CAST(tag_user_id AS INT) % 5 > 0").select("series_id", F.col("tag_event_type").alias("tag")).distinct()
    return join.with_series_tags(e.select("event_id", "series_id"), series).select("event_id", "tag")


# --- windows over time -------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS window_end, event_type AS tag_event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_window(spark, sf_dir):
    return windowed(events(spark, sf_dir), "6 hours", ["tag_event_type"], [F.count("*").alias("n")])


@query("SELECT s AS window_start, s + INTERVAL 2 HOUR AS window_end, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY ALL")
def sliding_window(spark, sf_dir):
    return windowed(events(spark, sf_dir), "2 hours", [], [F.count("*").alias("n")], slide="1 hour")


@query("""SELECT min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, tag_user_id, count(*) AS n FROM (
    SELECT ts, CAST(user_id AS VARCHAR) AS tag_user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY tag_user_id, g""")
def session_window(spark, sf_dir):
    return sessions(events(spark, sf_dir), "6 hours", ["tag_user_id"], [F.count("*").alias("n")])


@query(f"SELECT tag_event_type, count(*) AS n, count(DISTINCT tag_user_id) AS n_series FROM ({E_SQL}) GROUP BY 1")
def series_listing(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("tag_event_type", "tag_user_id", F.size(tags_map(e)).alias("n_tags")).groupBy("tag_event_type").agg(F.count("*").alias("n"), F.countDistinct("tag_user_id").alias("n_series"))


# --- versions, stored measurements, streams ----------------------------------------------------


def _versions(spark, sf_dir) -> VersionedTable:
    """Three appends of a third of the events each (versions 1 to 3)."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").cast("float").alias("value"))
    t = VersionedTable(spark, new_path(spark, "versions"))
    t.create({"event_id": "bigint", "user_id": "bigint", "value": "float"}, at=0.0)
    for k in range(3):
        t.append(e.where(f"event_id % 3 = {k}"), at=float(k + 1))
    return t


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 <= 1")
def time_travel(spark, sf_dir):
    return _versions(spark, sf_dir).scan(at=2.5, columns=["event_id", "user_id"])


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 = 0")
def rollback_read(spark, sf_dir):
    t = _versions(spark, sf_dir)
    t.rollback(1)
    return t.scan(columns=["event_id", "user_id"])


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 <= 1")
def scan_by_tag(spark, sf_dir):
    t = _versions(spark, sf_dir)
    t.tag("two", 2)
    return t.scan(ref="two", columns=["event_id", "user_id"])


@query("SELECT event_id, user_id AS person, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value, NULL::VARCHAR AS note FROM events UNION ALL SELECT -1, 7, 0.5, 'new'")
def schema_evolution_read(spark, sf_dir):
    t = _versions(spark, sf_dir)
    t.evolve(rename={"user_id": "person"}, promote={"value": "double"}, add={"note": "string"})
    t.append(spark.createDataFrame([(-1, 7, 0.5, "new")], "event_id long, person long, value double, note string"))
    return t.scan()


@query("SELECT count(*) AS n_rows, 1 AS n_files, CAST(sum(event_id) AS BIGINT) AS ids FROM events")
def compact_preserves_rows(spark, sf_dir):
    t = _versions(spark, sf_dir)
    t.compact()
    return t.scan().agg(F.count("*").alias("n_rows"), F.lit(len(t.current().files)).alias("n_files"), F.sum("event_id").alias("ids"))


@query("SELECT 'append' AS operation, 3 AS versions, CAST(3 * (SELECT count(*) FROM events WHERE event_id % 3 = 0) + 2 * (SELECT count(*) FROM events WHERE event_id % 3 = 1) + (SELECT count(*) FROM events WHERE event_id % 3 = 2) AS BIGINT) AS n_rows")
def version_history(spark, sf_dir):
    return _versions(spark, sf_dir).history().where("operation = 'append'").groupBy("operation").agg(F.count("*").cast("int").alias("versions"), F.sum("n_rows").alias("n_rows"))


@query("SELECT 'added' AS change, 2 AS n_files, count(*) AS n_rows FROM events WHERE event_id % 3 > 0 UNION ALL SELECT 'deleted', 0, 0")
def version_diff(spark, sf_dir):
    t = _versions(spark, sf_dir)
    return stats.snapshot_diff(t.files(1), t.files())


def _stored(spark, sf_dir) -> str:
    """All events, with a second write of every third, stored by tier and day."""
    path = new_path(spark, "measurement")
    first = events(spark, sf_dir).withColumn("write_seq", F.lit(1))
    write.append(first, path)
    write.append(first.where("event_id % 3 = 0").withColumn("value", F.col("value") * 2).withColumn("write_seq", F.lit(2)), path)
    return path


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value * 2 ELSE value END AS value FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id, ts ORDER BY CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END DESC) = 1")
def compaction_lww(spark, sf_dir):
    path = _stored(spark, sf_dir)
    return lifecycle.compact(spark, path, new_path(spark, "staging")).select("event_id", "value")


AGE = "date_diff('day', CAST(ts AS DATE), DATE '2024-01-15')"


@query(f"SELECT CASE WHEN {AGE} > 14 THEN 'cold' WHEN {AGE} > 3 THEN 'warm' ELSE 'active' END AS tier, count(*) + count(*) FILTER (event_id % 3 = 0) AS n FROM events GROUP BY 1")
def demoted_tier(spark, sf_dir):
    path = _stored(spark, sf_dir)
    lifecycle.demote_due(spark, path, new_path(spark, "staging"), dt.date(2024, 1, 15))
    return lifecycle.read(spark, path).groupBy("tier").agg(F.count("*").alias("n"))


@query("SELECT count(*) + count(*) FILTER (event_id % 3 = 0) AS n_rows, min(ts) AS ts_min, max(ts) AS ts_max, min(event_type) AS low, max(event_type) AS high, CAST(0 AS BIGINT) AS nulls FROM events")
def file_statistics(spark, sf_dir):
    f = stats.file_stats(lifecycle.read(spark, _stored(spark, sf_dir)), ["tag_event_type"])
    return f.agg(F.sum("row_count").alias("n_rows"), F.min("ts_min").alias("ts_min"), F.max("ts_max").alias("ts_max"), F.min("tag_event_type_min").alias("low"), F.max("tag_event_type_max").alias("high"), F.sum("tag_event_type_nulls").alias("nulls"))


def _restored(spark, sf_dir) -> DataFrame:
    """All events, archived and read back."""
    path = new_path(spark, "archive")
    every = events(spark, sf_dir)
    files.write_json_lines(every, path)
    return spark.read.schema(every.schema).json(path)


@query("SELECT event_id, value FROM events")
def archive_restore(spark, sf_dir):
    return _restored(spark, sf_dir).select("event_id", "value")


def _from_csv(spark, sf_dir) -> DataFrame:
    """All events, exported as CSV points and read back."""
    path = new_path(spark, "csv")
    files.write_csv(events(spark, sf_dir).withColumn("measurement", F.lit("events")).withColumn("timestamp", ts.micros(F.col("timestamp"))), path)
    return files.read_csv_points(spark, path)


@query("SELECT event_id, event_type AS tag_event_type, value FROM events")
def csv_round_trip(spark, sf_dir):
    return _from_csv(spark, sf_dir).select("event_id", "tag_event_type", "value")


@query("SELECT 'host_' || lpad(CAST(i % 10 AS VARCHAR), 4, '0') AS tag_host, count(*) AS n, CAST(sum(10 * i) AS BIGINT) AS total FROM range(1000) t(i) GROUP BY 1")
def fixture_simple(spark, sf_dir):
    return fixtures.simple(spark, 1000).groupBy("tag_host").agg(F.count("*").alias("n"), F.sum("count").alias("total"))


def _stream(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The events as a batch, and the same files as a stream."""
    path = new_path(spark, "stream-in")
    events(spark, sf_dir).write.parquet(path)
    batch = spark.read.parquet(path)
    return batch, spark.readStream.schema(batch.schema).parquet(path)


@query("SELECT event_type AS tag_event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_ingest(spark, sf_dir):
    out = new_path(spark, "stream-out")
    ingest(_stream(spark, sf_dir)[1], out, new_path(spark, "stream-log")).awaitTermination()
    return spark.read.parquet(out).groupBy("tag_event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_type AS tag_event_type, max(ts) AS timestamp, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def stream_last_values(spark, sf_dir):
    out, log = new_path(spark, "last"), new_path(spark, "last-log")
    state = last_values(_stream(spark, sf_dir)[1], ["tag_event_type"], ["timestamp", "event_id"])
    write_all = lambda batch, _: batch.write.mode("overwrite").parquet(out)
    state.writeStream.outputMode("complete").foreachBatch(write_all).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("tag_event_type", "last.timestamp", "last.value")


# --- SQL families ------------------------------------------------------------------------------


def _sql(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark)
        for name in TABLES:
            if f" {name}" in text:
                table(spark, sf_dir, name).createOrReplaceTempView(name)
        return spark.sql(text)

    return run


for _name, (_spark, _duck) in FAMILIES.items():
    QUERIES[_name] = _sql(_spark)
    if _duck is not None:
        ORACLES[_name] = _duck


@query(FAMILIES["join_not_in"][1])
def join_not_in(spark, sf_dir):
    """By the operator: Spark's own plan of that text broadcasts every line item's part."""
    return join.not_in(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", table(spark, sf_dir, "lineitem"), "l_partkey")


from . import storage_queries  # noqa: E402,F401  registers its queries here
