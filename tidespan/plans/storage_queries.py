"""Registered queries over stored, imported, versioned and served measurements, each with its DuckDB equivalent."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timeseries as ts
from ..model import with_series
from ..operators import join, lifecycle, scan, stats, write
from ..operators.versions import Catalog, Conflict, VersionedTable
from ..scratch import new_path
from ..sources import files, metrics
from ..streaming.ingest import keep_last, kept
from . import sql
from .catalog import E_SQL, TODAY, _stream, events, query, table

DAY = "CAST(ts AS DATE)"


def _rows(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- import and export --------------------------------------------------------------------------


@query("SELECT event_id, value, event_type AS tag_event_type, ts AS timestamp FROM events")
def json_points_import(spark, sf_dir):
    """All events as JSON points and back."""
    path = new_path(spark, "json-points")
    files.write_json_points(events(spark, sf_dir), path, "events")
    good, _ = files.read_json_points(spark, path, lines=True)
    value = lambda name, kind: ts.field_value(F.col("fields")[name]).cast(kind).alias(name)
    return good.select(value("event_id", "long"), value("value", "double"), F.col("tags")["event_type"].alias("tag_event_type"), ts.from_micros(F.col("timestamp")).alias("timestamp"))


@query("SELECT 'bad' AS kind, count(*) AS n FROM events WHERE event_id % 7 = 0 UNION ALL SELECT 'good', count(*) FROM events WHERE event_id % 7 <> 0")
def json_bad_points(spark, sf_dir):
    """Records that are no points are told apart: no measurement, no timestamp, no JSON."""
    path, k = new_path(spark, "json-bad"), F.col("event_id")
    point = F.format_string('{"measurement":%s,"tags":{},"fields":{"v":"%d"},"timestamp":%s}', F.when(k % 21 == 0, "null").otherwise('"m"'), k, F.when(k % 21 == 7, "null").otherwise((k + 1).cast("string")))
    table(spark, sf_dir, "events").select(F.when(k % 21 == 14, "{oops").otherwise(point).alias("value")).write.text(path)
    good, bad = files.read_json_points(spark, path, lines=True)
    return good.agg(F.count("*").alias("n")).select(F.lit("good").alias("kind"), "n").unionByName(bad.agg(F.count("*").alias("n")).select(F.lit("bad").alias("kind"), "n"))


@query("SELECT count(*) FILTER (event_id % 5 <> 0) AS n_good, count(*) FILTER (event_id % 5 = 0) AS n_bad, count(*) FILTER (event_id % 5 <> 0) AS n_rows, CAST(coalesce(sum(event_id) FILTER (event_id % 5 <> 0), 0) AS BIGINT) AS ids FROM events")
def points_into_table(spark, sf_dir):
    """JSON points appended to a versioned table; those that don't fit its types are counted."""
    k = F.col("event_id")
    raw = F.when(k % 5 == 0, F.lit('"no number"')).otherwise(k.cast("string"))
    points = table(spark, sf_dir, "events").select(F.lit("m").alias("measurement"), F.create_map(F.lit("event_type"), F.col("event_type")).alias("tags"), F.create_map(F.lit("event_id"), raw).alias("fields"), ts.micros(F.col("ts")).alias("timestamp"))
    t = VersionedTable(spark, new_path(spark, "points-table"))
    t.create({"timestamp": "timestamp_ntz", "tag_event_type": "string", "event_id": "bigint"})
    _, good, bad = t.append_points(points)
    return t.scan().agg(F.lit(good).cast("long").alias("n_good"), F.lit(bad).cast("long").alias("n_bad"), F.count("*").alias("n_rows"), F.coalesce(F.sum("event_id"), F.lit(0)).alias("ids"))


@query("""SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","none":null,"user_id":' || user_id || '}' AS value FROM events""")
def render_json(spark, sf_dir):
    return files.rendered(table(spark, sf_dir, "events").select("event_id", "event_type", F.lit(None).cast("string").alias("none"), "user_id"), "json")


@query("SELECT event_id || ',' || event_type || ',' || user_id AS csv, event_id || chr(9) || event_type || chr(9) || user_id AS tsv FROM events")
def render_csv_tsv(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    csv, tsv = (files.rendered(e, k) for k in ("csv", "tsv"))
    return csv.select(F.col("value").alias("csv"), F.split("value", ",")[0].alias("k")).join(tsv.select(F.col("value").alias("tsv"), F.split("value", "\t")[0].alias("k")), "k").select("csv", "tsv")


@query("SELECT event_id, value FROM events")
def single_file_read(spark, sf_dir):
    return files.read_parquet(spark, f"{sf_dir}/events.parquet", ["event_id", "value"])


@query("SELECT column_name, type, (SELECT count(*) FROM events) AS n_rows FROM (VALUES ('event_id', 'bigint'), ('ts', 'timestamp_ntz'), ('user_id', 'bigint'), ('event_type', 'string'), ('value', 'double'), ('props', 'string')) t(column_name, type)")
def parquet_metadata(spark, sf_dir):
    return files.describe(spark, f"{sf_dir}/events.parquet").select("column_name", "type", "n_rows")


@query("SELECT n_nationkey, n_name FROM nation")
def arrow_points(spark, sf_dir):
    """A dimension table's rows as an Arrow table, taken in."""
    return files.from_arrow(spark, table(spark, sf_dir, "nation").select("n_nationkey", "n_name").toArrow())


@query("SELECT * FROM (VALUES ('sys_cpu', 2), ('sys_memory', 2), ('sys_disk', 2), ('sys_network', 2)) t(measurement, n_fields)")
def system_metrics(spark, sf_dir):
    return metrics.system_points(spark).select("measurement", F.size("fields").alias("n_fields"))


# --- functions ----------------------------------------------------------------------------------


@query("SELECT 'date=' || CAST(CAST(ts AS DATE) AS VARCHAR) || '/tag=' || event_type AS path, count(*) AS n FROM events GROUP BY 1")
def partition_paths(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(ts.partition_path(["date", "tag"], [ts.utc_date(F.col("ts")), F.col("event_type")]).alias("path")).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT user_id) AS n_values, true AS in_range, true AS same_for_types, true AS spread FROM events")
def bucket_spread(spark, sf_dir):
    """Buckets are in range, the same for a value as int, bigint and string, and no bucket has far more values than others."""
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    b = lambda c: ts.transform("bucket", c, 8)
    u = u.select("user_id", b(F.col("user_id")).alias("b"), b(F.col("user_id").cast("int")).alias("i"), b(F.col("user_id").cast("string")).alias("s"))
    per = u.groupBy("b").agg(F.count("*").alias("n"), F.bool_and((F.col("b") == F.col("i")) & (F.col("b") == F.col("s"))).alias("same"))
    return per.agg(F.sum("n").alias("n_values"), F.bool_and(F.col("b").between(0, 7)).alias("in_range"), F.bool_and("same").alias("same_for_types"), (F.max("n") <= F.sum("n") / 8 * 3 + 3).alias("spread"))


@query(r"SELECT p_name AS name, regexp_full_match(p_name, '[\p{L}\p{N}_.\-]+') AS safe, regexp_full_match(replace(p_name, ' ', '_'), '[\p{L}\p{N}_.\-]+') AS safe_joined FROM part GROUP BY p_name")
def safe_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return p.select("name", ts.is_safe_name(F.col("name")).alias("safe"), ts.is_safe_name(F.replace("name", F.lit(" "), F.lit("_"))).alias("safe_joined"))


@query("SELECT event_type, lower(hex(event_type)) AS code, event_type AS back FROM events GROUP BY 1")
def key_hex(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type").distinct().withColumn("code", ts.key_hex(F.col("event_type")))
    return e.withColumn("back", ts.key_text(F.col("code")))


@query(f"SELECT event_id FROM events WHERE date_diff('day', {DAY}, DATE '2024-01-31') <= 12")
def duration_text(spark, sf_dir):
    """Rows within a retention given as text."""
    age = ts.age_days(ts.utc_date(F.col("ts")), F.lit(TODAY))
    return table(spark, sf_dir, "events").where(age <= ts.duration_days("12d")).select("event_id")


# --- scans and joins ----------------------------------------------------------------------------


@query(f"SELECT * FROM ({E_SQL}) WHERE event_id = 100")
def point_scan(spark, sf_dir):
    df = events(spark, sf_dir)
    at = df.where("event_id = 100").first()
    return scan.point_lookup(df, {"event_type": at["tag_event_type"], "user_id": at["tag_user_id"]}, at["timestamp"])


@query("SELECT event_id, event_type AS tag FROM events WHERE user_id % 5 > 0")
def join_series_inner(spark, sf_dir):
    e = with_series(events(spark, sf_dir), "events").withColumnRenamed("tags_hash", "series_id")
    series = e.where("CAST(tag_user_id AS INT) % 5 > 0").select("series_id", F.col("tag_event_type").alias("tag")).distinct()
    return join.with_series_tags(e.select("event_id", "series_id"), series, keep_unknown=False).select("event_id", "tag")


@query("SELECT a.event_id, b.ts AS matched_at, b.value AS last_view FROM (SELECT * FROM events WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def asof_ranges(spark, sf_dir):
    """The as-of join with series cut into days, each a window of its own."""
    e = table(spark, sf_dir, "events").withColumnRenamed("ts", "timestamp")
    views = e.where("event_type = 'view'").groupBy("user_id", "timestamp").agg(F.max_by("value", "event_id").alias("last_view"))
    clicks = e.where("event_type = 'click'").select("event_id", "timestamp", "user_id")
    return join.as_of_join(clicks, views, ["user_id"], ["last_view"], width_micros=86_400_000_000).select("event_id", "matched_at", "last_view")


@query("SELECT column_name, kind, count(*) AS n_rows, low, high FROM (SELECT 'event_id' AS column_name, 'integer' AS kind, CAST(min(9007199254740993 + event_id) AS VARCHAR) AS low, CAST(max(9007199254740993 + event_id) AS VARCHAR) AS high FROM events) a, events GROUP BY ALL")
def stats_of_large_integers(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") + F.lit(9007199254740993)).alias("event_id"))
    return stats.merge_stats(*[stats.column_stats(e.where(f"event_id % 2 = {k}"), ["event_id"]) for k in (0, 1)]).select("column_name", "kind", "n_rows", "low", "high")


# --- life cycle ---------------------------------------------------------------------------------


def _written(spark, sf_dir, times: int) -> str:
    """All events, each written ``times`` times with growing write_seq and value, by tier and day."""
    path = new_path(spark, "written")
    for k in range(times):
        write.append(events(spark, sf_dir).withColumn("value", F.col("value") + k).withColumn("write_seq", F.lit(k)), path)
    return path


LAST = "SELECT event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id, ts ORDER BY event_id DESC) AS r FROM events) WHERE r = 1"


@query("SELECT event_id, value + 7 AS value, 1 AS level FROM events QUALIFY count(*) OVER (PARTITION BY event_type, user_id, ts) = 1")
def compaction_levels(spark, sf_dir):
    """Eight writes of all events become level 1, with the last write of each point."""
    path = _written(spark, sf_dir, 8)
    lifecycle.compact_levels(spark, path, new_path(spark, "staging"))
    rows = lifecycle.read(spark, path).withColumn("level", lifecycle.level_of(F.col("_metadata.file_name")))
    alone = events(spark, sf_dir).groupBy("tag_event_type", "tag_user_id", "timestamp").count().where("count = 1").drop("count")
    return rows.join(alone, ["tag_event_type", "tag_user_id", "timestamp"], "left_semi").select("event_id", "value", "level")


@query(f"SELECT 'active' AS tier, {DAY} AS date, count(*) AS n FROM events WHERE {DAY} >= DATE '2024-01-21' GROUP BY 2")
def retention_applied(spark, sf_dir):
    path = _written(spark, sf_dir, 1)
    lifecycle.apply_retention(spark, path, TODAY, ts.duration_days("10d"))
    return lifecycle.read(spark, path).groupBy("tier", "date").agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN date_diff('day', {DAY}, DATE '2024-01-31') > 14 THEN 'cold' WHEN date_diff('day', {DAY}, DATE '2024-01-31') > 3 THEN 'warm' ELSE 'active' END AS tier, {DAY} AS date, count(*) AS n FROM events GROUP BY ALL")
def demotion_of_all_days(spark, sf_dir):
    path, staging = _written(spark, sf_dir, 1), new_path(spark, "staging")
    lifecycle.demote_due(spark, path, staging, TODAY)
    lifecycle.demote_due(spark, path, staging, TODAY)  # a second run changes nothing
    return lifecycle.read(spark, path).groupBy("tier", "date").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, value FROM events WHERE {DAY} = (SELECT min({DAY}) FROM events)")
def archived_day(spark, sf_dir):
    """The oldest day, archived as JSON Lines from its tier and read back."""
    path, target = _written(spark, sf_dir, 1), new_path(spark, "archived")
    day = lifecycle.read(spark, path).agg(F.min("date")).first()[0]
    lifecycle.archive(spark, path, day, target, "active")
    return spark.read.schema("event_id long, value double").json(target)


@query(f"SELECT count(DISTINCT {DAY}) AS n_days, true AS newest_first, true AS all_level_0 FROM events")
def latest_files(spark, sf_dir):
    f = lifecycle.files(spark, _written(spark, sf_dir, 2)).select("date", "modified", "level", F.monotonically_increasing_id().alias("k"))
    before = F.lag("modified").over(Window.orderBy("k"))  # a row a file
    return f.withColumn("ok", F.coalesce(before >= F.col("modified"), F.lit(True))).agg(F.countDistinct("date").alias("n_days"), F.bool_and("ok").alias("newest_first"), F.bool_and(F.col("level") == 0).alias("all_level_0"))


# --- versioned tables ---------------------------------------------------------------------------

COLUMNS = {"timestamp": "timestamp_ntz", "tag_event_type": "string", "event_id": "bigint", "value": "double"}
SPEC = [("timestamp", "day"), ("tag_event_type", "identity")]


def _third(spark, sf_dir, k: int) -> DataFrame:
    return events(spark, sf_dir).where(f"event_id % 3 = {k}").select(*COLUMNS)


def _versioned(spark, sf_dir, spec=SPEC, name="versioned") -> VersionedTable:
    """Three appends of a third of the events each."""
    t = VersionedTable(spark, new_path(spark, name))
    t.create(COLUMNS, spec, at=0.5)
    for k in range(3):
        t.append(_third(spark, sf_dir, k), at=float(k + 1))
    return t


PRUNED = f"event_type = 'click' AND {DAY} >= DATE '2024-01-20'"
WHERE = [("tag_event_type", "=", "click"), ("timestamp", ">=", dt.datetime(2024, 1, 20, 12))]


@query("SELECT event_id, value FROM events WHERE event_type = 'click' AND ts >= '2024-01-20 12:00:00'")
def pruned_scan(spark, sf_dir):
    return _versioned(spark, sf_dir).scan(where=WHERE, columns=["event_id", "value"])


@query(f"SELECT count(*) AS n_rows_opened, true AS fewer_files FROM (SELECT event_id, max(ts) OVER (PARTITION BY event_id % 3, event_type, {DAY}) AS high, event_type, ts FROM events) WHERE event_type = 'click' AND high >= '2024-01-20 12:00:00'")
def planned_files(spark, sf_dir):
    """Rows of the files that the scan opens: by bounds, those of the days and types asked for."""
    t = _versioned(spark, sf_dir)
    return t.planned(WHERE).agg(F.sum("n_rows").alias("n_rows_opened"), (F.count("*") < t.planned().count()).alias("fewer_files"))


@query("SELECT 'conflict' AS outcome, 2 AS version, count(*) AS n_rows FROM events WHERE event_id % 3 <= 1")
def commit_conflict(spark, sf_dir):
    """Of two writers that start from one version the second fails, and its rows are not seen."""
    t = VersionedTable(spark, new_path(spark, "conflict"))
    base = t.create(COLUMNS)
    t.append(_third(spark, sf_dir, 0), base=base)
    try:
        t.append(_third(spark, sf_dir, 2), base=base)
        outcome = "committed"
    except Conflict:
        outcome = "conflict"
    t.append(_third(spark, sf_dir, 1))
    return t.scan().agg(F.lit(outcome).alias("outcome"), F.lit(t.current().number).alias("version"), F.count("*").alias("n_rows"))


@query(f"SELECT * FROM (VALUES ('cpu'), ('disk')) t(name), (SELECT count(*) AS n FROM events WHERE event_id % 3 = 0)")
def table_catalog(spark, sf_dir):
    """Tables created, renamed, dropped and listed, then read as SQL views."""
    c = Catalog(spark, new_path(spark, "catalog"))
    for name in ("cpu", "memory", "old"):
        c.create(name, COLUMNS).append(_third(spark, sf_dir, 0))
    c.rename("memory", "disk")
    c.drop("old")
    views = c.register("listed_")
    parts = [sql.frame(spark, f"SELECT '{v.removeprefix('listed_')}' AS name, count(*) AS n FROM {v}") for v in views]
    return parts[0].unionByName(parts[1])


@query(f"SELECT 'day' AS spec, count(DISTINCT {DAY}) AS n FROM events UNION ALL SELECT 'hour', count(DISTINCT date_trunc('hour', ts)) FROM events UNION ALL SELECT 'identity', count(DISTINCT event_type) FROM events UNION ALL SELECT 'none', 1")
def partition_types(spark, sf_dir):
    """How many partitions a table has, by its spec."""
    out = []
    for name, spec in (("day", [("timestamp", "day")]), ("hour", [("timestamp", "hour")]), ("identity", [("tag_event_type", "identity")]), ("none", [])):
        t = VersionedTable(spark, new_path(spark, f"spec-{name}"))
        t.create(COLUMNS, spec)
        t.append(events(spark, sf_dir).select(*COLUMNS))
        folder = F.regexp_replace("path", "/[^/]*$", "")
        out.append(t.planned().select(folder.alias("f")).agg(F.countDistinct("f").alias("n")).select(F.lit(name).alias("spec"), "n"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(f"SELECT 'day' AS spec, count(DISTINCT {DAY}) AS n_partitions, count(*) AS n_rows FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 'identity', count(DISTINCT event_type), count(*) FROM events WHERE event_id % 3 = 1")
def spec_evolution(spark, sf_dir):
    """Commits keep the partitions of the spec they were written with."""
    t = VersionedTable(spark, new_path(spark, "respec"))
    t.create(COLUMNS, [("timestamp", "day")])
    t.append(_third(spark, sf_dir, 0))
    t.respec([("tag_event_type", "identity")])
    t.append(_third(spark, sf_dir, 1))
    kind = F.regexp_extract("path", r"/p_\d+_([a-z]+)=", 1).alias("spec")
    return t.planned().select(kind, F.regexp_replace("path", "/[^/]*$", "").alias("f"), "n_rows").groupBy("spec").agg(F.countDistinct("f").alias("n_partitions"), F.sum("n_rows").alias("n_rows"))


@query("SELECT * FROM (VALUES (0, 'gone'), (1, 'held'), (2, 'gone'), (3, 'held'), (4, 'held')) t(version, state), (SELECT count(*) AS n_rows FROM events)")
def expire_versions(spark, sf_dir):
    """Old versions go but the named and the newest ones; the data of those stays readable."""
    t = _versioned(spark, sf_dir)
    t.tag("first", 1)
    gone = t.expire(before=3.5, keep=2, delete_data=True)
    n = t.scan().count()
    return _rows(spark, [(k, "gone" if k in gone else "held", n) for k in range(5)], "version int, state string, n_rows long")


@query("SELECT * FROM (VALUES ('timestamp', 'timestamp_ntz', 'day'), ('tag_event_type', 'string', 'identity'), ('event_id', 'bigint', NULL), ('value', 'double', NULL)) t(column_name, type, partitioned_by)")
def table_detail(spark, sf_dir):
    t = VersionedTable(spark, new_path(spark, "detail"))
    t.create(COLUMNS, SPEC)
    return t.detail().drop("id")


@query("""SELECT version, operation, parent, n_commits, CASE WHEN n_commits = 0 THEN 0 WHEN version = 1 OR version >= 6 THEN a WHEN version = 2 THEN a + b ELSE a + b + c END AS n_rows
    FROM (VALUES (0, 'create', NULL, 0), (1, 'append', 0, 1), (2, 'append', 1, 2), (3, 'append', 2, 3), (4, 'tag', 3, 3), (5, 'schema', 4, 3), (6, 'replace', 5, 1)) t(version, operation, parent, n_commits),
    (SELECT count(*) FILTER (event_id % 3 = 0) AS a, count(*) FILTER (event_id % 3 = 1) AS b, count(*) FILTER (event_id % 3 = 2) AS c FROM events)""")
def version_log(spark, sf_dir):
    """All operations with their parents."""
    t = _versioned(spark, sf_dir, [])
    t.tag("three")
    t.evolve(add={"note": "string"})
    t.rollback(1)
    return t.history().withColumnRenamed("n_files", "n_commits")


@query("SELECT event_id, value, 1 AS n_folders FROM events")
def compacted_rows(spark, sf_dir):
    """The rows after compaction, and the folders on disk that hold them."""
    t = _versioned(spark, sf_dir)
    t.compact()
    stored = t.planned().select(F.split("path", "/")[1].alias("f")).agg(F.countDistinct("f").cast("int").alias("n_folders"))
    return t.scan(columns=["event_id", "value"]).join(F.broadcast(stored))  # one row


# --- SQL entry ----------------------------------------------------------------------------------


@query(f"SELECT event_type AS tag_event_type, count(*) AS n FROM events WHERE {DAY} >= DATE '2024-01-24' GROUP BY 1")
def sql_last_week(spark, sf_dir):
    """A view of the last seven days, read through the read-only gate; older partitions are pruned."""
    sql.measurement_view(spark, "events_week", _written(spark, sf_dir, 1), TODAY - dt.timedelta(days=7))
    return sql.frame(spark, "SELECT tag_event_type, count(*) AS n FROM events_week GROUP BY tag_event_type")


@query(f"SELECT event_type AS tag_event_type, count(*) AS n FROM events WHERE ts >= '2024-01-10' GROUP BY 1")
def sql_all_tiers(spark, sf_dir):
    """Hot, warm and cold partitions as one view."""
    path = _written(spark, sf_dir, 1)
    lifecycle.demote_due(spark, path, new_path(spark, "staging"), TODAY)
    sql.measurement_view(spark, "events_tiers", path)
    return sql.frame(spark, "SELECT tag_event_type, count(*) AS n FROM events_tiers WHERE timestamp >= TIMESTAMP_NTZ '2024-01-10 00:00:00' AND date >= DATE '2024-01-10' GROUP BY tag_event_type")


@query("SELECT event_type AS tag_event_type, count(*) AS n FROM events GROUP BY 1")
def sql_registered(spark, sf_dir):
    """A measurement registered from its points, without the series hash."""
    sql.register("events_registered", with_series(events(spark, sf_dir), "events"))
    return sql.frame(spark, "SELECT tag_event_type, count(*) AS n FROM events_registered GROUP BY tag_event_type")


@query("SELECT * FROM (VALUES ('timestamp'), ('tag_event_type'), ('tag_user_id'), ('value'), ('k'), ('event_id'), ('series_key')) t(col_name)")
def sql_show_columns(spark, sf_dir):
    """SHOW COLUMNS of a registered measurement; the hash is hidden."""
    sql.register("events_columns", with_series(events(spark, sf_dir), "events"))
    return sql.frame(spark, "SHOW COLUMNS IN events_columns")


@query("SELECT 5000 AS shown, true AS truncated UNION ALL SELECT 5, false")
def sql_capped(spark, sf_dir):
    """Rows for display are capped, and it is said so; 10,000 generated rows and the five regions."""
    spark.range(10_000).createOrReplaceTempView("many_rows")
    table(spark, sf_dir, "region").createOrReplaceTempView("few_rows")
    out = []
    for v in ("many_rows", "few_rows"):
        rows, more = sql.query(spark, f"SELECT * FROM {v}")
        out.append((len(rows), more))
    return _rows(spark, out, "shown int, truncated boolean")


GATE = (("SELECT 1", True), ("WITH t AS (SELECT 1 AS a) SELECT * FROM t", True), ("EXPLAIN SELECT 1", True), ("SHOW TABLES", True), ("DROP TABLE x", False), ("INSERT INTO x VALUES (1)", False), ("SELECT 1; DROP TABLE x", False), ("", False), ("EXPLAIN DROP TABLE x", False))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', {str(ok).lower()})" for t, ok in GATE) + ") t(statement, allowed)")
def sql_gate(spark, sf_dir):
    def allowed(text: str) -> bool:
        try:
            sql.check_read_only(text, spark)
            return True
        except sql.NotReadOnly:
            return False

    return _rows(spark, [(t, allowed(t)) for t, _ in GATE], "statement string, allowed boolean")


@query("SELECT 'cancelled' AS outcome")
def sql_timeout(spark, sf_dir):
    """A query that would run for hours ends after a second."""
    try:
        sql.query(spark, "SELECT sum(hash(a.id, b.id)) FROM range(10000000) a JOIN range(10000000) b ON a.id % 3 = b.id % 3", timeout=1)
        outcome = "finished"
    except Exception:
        outcome = "cancelled"
    return _rows(spark, [(outcome,)], "outcome string")


@query("SELECT * FROM (VALUES ('listed_cpu'), ('listed_mem')) t(name)")
def sql_tables(spark, sf_dir):
    """Registered measurements; the engine's own are left out."""
    for name in ("listed_cpu", "listed_mem", "sys_listed"):
        sql.register(name, spark.range(1))
    return _rows(spark, [(n,) for n in sql.tables(spark) if "listed_" in n and n != "listed_disk"], "name string")


# --- streams ------------------------------------------------------------------------------------


@query("SELECT event_type AS tag_event_type, user_id AS u, ts AS timestamp, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1 ORDER BY ts DESC, event_id DESC LIMIT 40")
def stream_kept_series(spark, sf_dir):
    """The last values of the forty newest series, as a stream keeps them."""
    out = new_path(spark, "kept")
    keep_last(_stream(spark, sf_dir)[1], out, new_path(spark, "kept-log"), ["tag_event_type", "tag_user_id"], ["timestamp", "event_id"], cap=40).awaitTermination()
    return kept(spark, out).select("tag_event_type", F.col("tag_user_id").cast("long").alias("u"), "timestamp", "value")
