import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidespan.functions import timeseries as ts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_time_bucket_truncates_toward_zero(spark):
    rows = [(1_000_000,), (1_500_000,), (2_000_000,), (-1,), (-1_500_000,), (None,)]
    df = spark.createDataFrame(rows, "m long").select("m", ts.micros(ts.time_bucket(ts.from_micros(F.col("m")), 1_000_000)).alias("b"))
    assert {r["m"]: r["b"] for r in df.collect()} == {1_000_000: 1_000_000, 1_500_000: 1_000_000, 2_000_000: 2_000_000, -1: 0, -1_500_000: -1_000_000, None: None}
    with pytest.raises(ValueError):
        ts.time_bucket(F.col("m"), 0)


def test_sql_functions_are_inlined(spark):
    plan = spark.sql("SELECT time_bucket(CAST('2024-01-01 10:30:00' AS TIMESTAMP_NTZ), 3600000000 + id) FROM range(3)")._jdf.queryExecution().optimizedPlan().toString()
    assert "timestamp_micros" in plan and "time_bucket(" not in plan.replace("time_bucket(CAST", "")
    assert spark.sql("SELECT tier_for_age(5)").first()[0] == "warm"


@settings(max_examples=20, deadline=None)
@given(st.dictionaries(st.text("ab,= \\k", min_size=1, max_size=4), st.text("xy,= \\", max_size=4), max_size=3))
def test_series_key_escapes_and_sorts(spark, tags):
    esc = lambda s: "".join("\\" + c if c in "\\,= " else c for c in s)
    m = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv]) if tags else F.create_map().cast("map<string,string>")
    assert one(spark, ts.series_key(F.lit("m x"), m)) == "m\\ x," + ",".join(f"{esc(k)}={esc(tags[k])}" for k in sorted(tags))


def test_names_tiers_and_directories(spark):
    assert one(spark, ts.is_safe_name(F.lit("cpu.load-1_é"))) and not one(spark, ts.is_safe_name(F.lit("a/b")))
    assert one(spark, ts.parse_partition_dir(F.lit("data_20240203"))) == dt.date(2024, 2, 3)
    assert one(spark, ts.parse_partition_dir(F.lit("data_20241399"))) is None and one(spark, ts.parse_partition_dir(F.lit("x"))) is None
    assert one(spark, ts.measurement_of(F.lit("ts_disk_io_20240203"))) == "disk_io"
    assert [one(spark, ts.eligible_tier(F.lit(d))) for d in (0, 3, 4, 14, 15)] == ["none", "none", "warm", "warm", "cold"]
    assert ts.duration_days("30d") == 30
    with pytest.raises(ValueError):
        ts.duration_days("30h")


def test_field_values(spark):
    got = spark.createDataFrame([('{"Float":1.5}',), ('"a b"',), ("7",), ("true",), ("null",), (None,)], "v string").select(ts.field_value(F.col("v"))).collect()
    assert [r[0] for r in got] == ["1.5", "a b", "7", "true", None, None]


def test_transforms(spark):
    day = F.lit("2024-02-03 04:05:06").cast("timestamp_ntz")
    assert [one(spark, ts.transform(k, day)) for k in ("day", "hour", "month", "year")] == ["2024-02-03", "2024-02-03-04", "2024-02", "2024"]
    assert one(spark, ts.transform("truncate", F.lit("abcdef"), 3)) == "abc" and one(spark, ts.transform("void", F.lit(1))) is None
    assert 0 <= one(spark, ts.transform("bucket", F.lit("x"), 7)) < 7
    with pytest.raises(ValueError):
        ts.transform("week", day)
