import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidespan.plans import sql
from tidespan.streaming import ingest

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("text", ["SELECT 1", "with t as (select 1) select * from t", "EXPLAIN FORMATTED SELECT 1", "SHOW TABLES", "SELECT 'insert' AS x", "VALUES (1)", "WITH t AS (SELECT 'delete me' AS update_text) SELECT * FROM t"])
def test_reads_pass(spark, text):
    sql.query(spark, text)


@pytest.mark.parametrize("text", ["", "DROP TABLE x", "INSERT INTO t VALUES (1)", "CREATE TABLE x (a int)", "WITH t AS (SELECT 1) INSERT INTO x SELECT * FROM t", "EXPLAIN DROP TABLE x", "SELECT 1; SELECT 2", "SELEC 1", "SET a=b", "MERGE INTO a USING b ON a.x = b.x WHEN MATCHED THEN DELETE", "CACHE TABLE x", "FROM t INSERT INTO x SELECT 1", "SELECT " + "1," * 6000 + "1"])
def test_writes_are_refused(text):
    with pytest.raises(sql.NotReadOnly):
        sql.check_read_only(text)


def test_views_and_caps(spark):
    sql.register("m", spark.range(5).withColumn("tags_hash", F.lit(1)), spark.createDataFrame([(9, "x")], "id long, extra string"))
    rows, more = sql.query(spark, "SELECT * FROM m ORDER BY id DESC", limit=2, timeout=60)
    assert more and rows[0]["extra"] == "x" and "tags_hash" not in rows[0].asDict()
    assert "m" in sql.tables(spark)


@pytest.fixture()
def stream(spark, tmp_path):
    rows = [(T0 + dt.timedelta(minutes=7 * k), "ab"[k % 2], float(k), k) for k in range(40)]
    spark.createDataFrame(rows, "timestamp timestamp_ntz, tag_host string, v double, write_seq long").repartition(3).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    return batch, spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))


def test_ingest_is_idempotent(spark, stream, tmp_path):
    for _ in range(2):
        ingest.ingest(stream[1], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40


@pytest.mark.parametrize(("step", "nth"), [("write", 1), ("rename", 1), ("rename", 2)])
def test_a_batch_that_died_is_finished(spark, stream, tmp_path, monkeypatch, step, nth):
    from pyspark.errors import StreamingQueryException

    from tidespan.operators import publish

    real, calls = getattr(publish.Files, step), []

    def dies(*a):
        calls.append(1)
        if len(calls) == nth:
            raise RuntimeError("died")
        return real(*a)

    go = lambda: ingest.ingest(stream[1], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    with monkeypatch.context() as m:
        m.setattr(publish.Files, step, dies)
        with pytest.raises(StreamingQueryException):
            go()
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40


def test_kept_state_is_bounded(spark, tmp_path):
    rows = [(T0 + dt.timedelta(days=k % 30, minutes=k), f"h{k % 12}", float(k)) for k in range(60)]
    every = spark.createDataFrame(rows, "timestamp timestamp_ntz, tag_host string, v double")
    os.mkdir(tmp_path / "in")
    live = spark.readStream.schema(every.schema).parquet(str(tmp_path / "in"))
    for part in (rows[:25], rows[25:40], rows[40:]):
        spark.createDataFrame(part, every.schema).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.keep_last(live, str(tmp_path / "s"), str(tmp_path / "cp"), ["tag_host"], ["timestamp", "v"], cap=5, ttl_days=3).awaitTermination(90)
    last = {}
    for t, h, v in sorted(rows):
        last[h] = (t, h, v)
    edge = max(t for t, *_ in rows) - dt.timedelta(days=3)
    want = sorted((r for r in last.values() if r[0] >= edge), reverse=True)[:5]
    got = ingest.kept(spark, str(tmp_path / "s")).select("timestamp", "tag_host", "v").collect()
    assert 0 < len(got) <= 5 and sorted(map(tuple, got), reverse=True)[0] == want[0]
    assert sorted(n for n in os.listdir(tmp_path / "s") if n.startswith("state=")) == ["state=1", "state=2"]


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(90)
    return df.sparkSession.table(name)


def test_stream_equals_batch(spark, stream):
    batch, live = stream
    last = run(ingest.last_values(live, ["tag_host"], ["timestamp", "write_seq"]), "last_values", "complete")
    assert {r["tag_host"]: r["last"]["v"] for r in last.collect()} == {"a": 38.0, "b": 39.0}
    aggs = [F.count("*").alias("n")]
    a = run(ingest.windowed(live, "1 hour", ["tag_host"], aggs), "tumbling", "complete")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, ingest.windowed(batch, "1 hour", ["tag_host"], aggs).collect()))
    assert run(ingest.distinct_points(live, ["write_seq"]), "distinct_points", "append").count() == 40


def test_alerts(spark):
    got = ingest.alerts(spark.createDataFrame([("h", 95.0, 1.0), ("i", 90.0, 9.0)], "host string, cpu_pct double, load_1m double"))
    assert sorted((r["host"], r["metric"]) for r in got.collect()) == [("h", "cpu_pct"), ("i", "load_1m")]


@pytest.mark.parametrize("name", ["stream_ingest", "stream_last_values"])
def test_registered_streams_are_read_when_they_have_ended(spark, monkeypatch, name):
    """A wait that runs out must not be taken for the end of the stream."""
    from pyspark.sql.streaming import StreamingQuery

    from tidespan.plans import catalog

    real, ended = StreamingQuery.awaitTermination, []
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda q, timeout=None: False if timeout else (real(q), ended.append(not q.isActive))[0])
    points = spark.createDataFrame([(T0, "ab"[k % 2], float(k), k) for k in range(9)], "timestamp timestamp_ntz, tag_event_type string, value double, event_id long")
    monkeypatch.setattr(catalog, "events", lambda *_: points)
    assert catalog.QUERIES[name](spark, "").count() == 2 and ended == [True]
