import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tidespan import model
from tidespan.operators import join, lifecycle, scan, stats, write
from tidespan.operators.versions import Catalog, Conflict, VersionedTable
from tidespan.sources import files, fixtures

T0 = dt.datetime(2024, 1, 1)


def points(spark, rows):
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, tag_host string, tag_region string, usage double, write_seq long")


@pytest.fixture(scope="module")
def df(spark):
    return points(spark, [(T0, "a", "x", 1.0, 1), (T0 + dt.timedelta(hours=1), "a", "x", 2.0, 2), (T0, "a", None, 3.0, 3), (T0, "b", "y", 4.0, 4), (T0, "a", "x", 5.0, 5)])


def test_scans(spark, df):
    assert scan.range_scan(df, tags={"host": "a"}).count() == 4
    assert scan.series_scan(df, {"host": "a"}).select("usage").collect()[0][0] == 3.0
    assert scan.range_scan(df, tags={"rack": "1"}).count() == 0
    assert scan.range_scan(df, T0, T0, columns=["usage"]).columns == ["usage"]
    assert scan.point_lookup(df, {"host": "b", "region": "y"}, T0).count() == 1
    last = scan.last_per_series(df, ["tag_host", "tag_region"], ["timestamp", "write_seq"])
    assert {(r["tag_host"], r["tag_region"]): r["usage"] for r in last.collect()} == {("a", "x"): 2.0, ("a", None): 3.0, ("b", "y"): 4.0}
    assert scan.as_of(df, 2).count() == 2


def test_multi_get_keeps_order_and_misses(spark, df):
    keys = spark.createDataFrame([(0, "b", "y", T0), (1, "z", None, T0), (2, "a", None, T0)], "idx int, tag_host string, tag_region string, timestamp timestamp_ntz")
    got = scan.multi_get(df, keys, ["tag_host", "tag_region", "timestamp"]).orderBy("idx").collect()
    assert [r["usage"] for r in got] == [4.0, None, 3.0]


def test_page(spark):
    rows, more = scan.page(spark.range(10), "id", 4, 3)
    assert [r[0] for r in rows.collect()] == [4, 5, 6] and more.first()[0]
    assert not scan.page(spark.range(10), "id", 8, 3)[1].first()[0]


def test_last_write_wins_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(T0 + dt.timedelta(minutes=rng.randrange(5)), rng.choice(["a", "b", None]), None, float(k), k) for k in range(60)]
    want, loose = {}, 0
    for r in rows:
        if r[1] is None:
            loose += 1
        else:
            want[r[0], r[1]] = r[3]
    got = write.last_write_wins(points(spark, rows), ["timestamp", "tag_host"]).collect()
    assert len(got) == len(want) + loose
    assert all(want[r["timestamp"], r["tag_host"]] == r["usage"] for r in got if r["tag_host"])


def test_merge_fields(spark):
    rows = [(1, 1.0, None, 1), (1, None, "x", 2), (1, 2.0, None, 3), (2, None, None, 1)]
    got = write.merge_fields(spark.createDataFrame(rows, "k int, a double, b string, write_seq int"), ["k"], ["a", "b"])
    assert {r["k"]: (r["a"], r["b"]) for r in got.collect()} == {1: (2.0, "x"), 2: (None, None)}


def test_merge_fields_breaks_ties(spark):
    rows = [(1, a, 5) for a in (3.0, 1.0, None, 2.0)]
    for order in (rows, rows[::-1]):
        assert write.merge_fields(spark.createDataFrame(order, "k int, a double, write_seq int").repartition(3), ["k"], ["a"]).first() == (1, 3.0)


def test_widen(spark):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    assert write.widen(df, {"n": "double", "s": "string", "z": "bigint"}).first() == (1.0, "a", None)
    with pytest.raises(TypeError):
        write.widen(df, {"s": "double"})


def test_as_of_join_against_brute_force(spark):
    rng = random.Random(2)
    at = lambda: T0 + dt.timedelta(seconds=rng.randrange(100))
    left = [(k, rng.choice("ab"), at()) for k in range(50)]
    right = list({(rng.choice("ab"), at()): k for k in range(30)}.items())
    l = spark.createDataFrame(left, "id int, k string, timestamp timestamp_ntz")  # noqa: E741
    r = spark.createDataFrame([(k, t, v) for (k, t), v in right], "k string, timestamp timestamp_ntz, v int")
    got = {x["id"]: x["v"] for x in join.as_of_join(l, r, ["k"], ["v"]).collect()}
    for i, k, t in left:
        seen = [(rt, v) for (rk, rt), v in right if rk == k and rt <= t]
        assert got[i] == (max(seen)[1] if seen else None)


def test_interval_join(spark):
    p = spark.createDataFrame([(k, "a", T0 + dt.timedelta(minutes=k)) for k in range(20)], "id int, k string, timestamp timestamp_ntz")
    i = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=3), T0 + dt.timedelta(minutes=9), "x")], "k string, lo timestamp_ntz, hi timestamp_ntz, name string")
    assert sorted(r["id"] for r in join.interval_join(p, i, ["k"], "lo", "hi", 120_000_000).collect()) == list(range(3, 10))


@pytest.mark.parametrize("right", [[], [None], [2, 2, 5], [2, None, 5], [9]])
@pytest.mark.parametrize("left", [[], [None], [1, 2, 2, None, 5, 7, 7]])
def test_not_in_is_that_of_sql(spark, left, right):
    l, r = spark.createDataFrame([(k, x) for k, x in enumerate(left)], "k int, x long"), spark.createDataFrame([(x, "a") for x in right], "x long, k string")  # noqa: E741
    l.createOrReplaceTempView("not_in_l")
    r.createOrReplaceTempView("not_in_r")
    got = join.not_in(l, "x", r, "x")
    want = spark.sql("SELECT * FROM not_in_l WHERE x NOT IN (SELECT x FROM not_in_r)")
    assert got.columns == ["k", "x"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_validation_and_layouts(spark):
    rows = [("cpu", {"host": "a"}, {"v": 1.0}, 5), (" ", {}, {"v": 1.0}, 5), ("cpu", {}, {"v": 1.0}, 0), ("cpu", {}, {}, 5), ("cpu", {"v": "a"}, {"v": 1.0}, 5), ("cpu", {}, {"v": float("inf")}, 5), (None, None, None, None)]
    df = spark.createDataFrame(rows, "measurement string, tags map<string,string>, fields map<string,double>, timestamp long")
    good, bad = model.split_valid(df)
    assert good.count() == 1
    assert sorted(r["error"] for r in bad.collect()) == ["bad_timestamp", "blank_measurement", "blank_measurement", "field_is_tag", "no_fields", "not_finite"]
    wide = model.points_to_compact(good)
    assert wide.columns == ["measurement", "timestamp", "tag_host", "v"]
    ext = model.to_extended(wide.drop("measurement"), "cpu")
    assert ext.first()["tag_keys"] == ["host"] and model.to_compact(ext, ["host", "rack"]).first()["tag_rack"] is None


def test_column_stats_merge(spark):
    df = spark.createDataFrame([(10, None), (9, 2.5), (-3, 1.0)], "a int, b double")
    whole = {r["column_name"]: r for r in stats.column_stats(df, ["a", "b"]).collect()}
    assert (whole["a"]["low"], whole["a"]["high"], whole["b"]["n_nulls"]) == ("-3", "10", 1)
    parts = stats.merge_stats(stats.column_stats(df.where("a > 9"), ["a", "b"]), stats.column_stats(df.where("a <= 9"), ["a", "b"]))
    assert {r["column_name"]: tuple(r) for r in parts.collect()} == {k: tuple(v) for k, v in whole.items()}


def test_column_stats_are_exact(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, "b", 0.1 + 0.2), (-big, "a", None)], "n bigint, s string, x double")
    got = {r["column_name"]: (r["low"], r["high"]) for r in stats.merge_stats(stats.column_stats(df, ["n", "s", "x"]), stats.column_stats(df.limit(0), ["n", "s", "x"])).collect()}
    assert got == {"n": (str(-big), str(big)), "s": ("a", "b"), "x": ("0.30000000000000004", "0.30000000000000004")}


def test_equal_writes_have_one_winner(spark):
    rows = [(1, "a", 5, {"x": "1"}), (1, "b", 5, {"x": "2"}), (1, "c", 4, None)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k int, v string, write_seq int, m map<string,string>")
        assert [r["v"] for r in write.last_write_wins(df, ["k"]).collect()] == ["b"]
        assert write.rank_writes(df, ["k"]).where("write_rank = 1").first()["v"] == "b"


@pytest.mark.parametrize("width", [1_000_000, 7_000_000, 10**12])
def test_as_of_join_by_ranges(spark, width):
    """Cut into time ranges or not, also with null keys and series without any row before."""
    rng = random.Random(width)
    at = lambda: T0 + dt.timedelta(seconds=rng.randrange(60))
    left = spark.createDataFrame([(k, rng.choice(["a", "b", "c", None]), at()) for k in range(80)], "id int, k string, timestamp timestamp_ntz")
    right = spark.createDataFrame([(k, t, v) for (k, t), v in {(rng.choice(["a", "b", None]), at()): n for n in range(40)}.items()], "k string, timestamp timestamp_ntz, v int")
    one, many = join.as_of_join(left, right, ["k"], ["v"]), join.as_of_join(left, right, ["k"], ["v"], width_micros=width)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def _stop_at(monkeypatch, module, name, nth):
    """The nth call dies."""
    real, calls = getattr(module, name), []

    def f(*a, **k):
        calls.append(1)
        if len(calls) == nth:
            raise RuntimeError("died")
        return real(*a, **k)

    monkeypatch.setattr(module, name, f)


@pytest.mark.parametrize(("step", "nth"), [("write", 1), ("rename", 1), ("rename", 2), ("delete", 1)])
@pytest.mark.parametrize("kind", ["move", "compact"])
def test_changes_are_finished_after_a_crash(spark, tmp_path, monkeypatch, step, nth, kind):
    from tidespan.operators import publish

    path, staging = str(tmp_path / "m"), str(tmp_path / "s")
    rows = [(T0 + dt.timedelta(minutes=m), "a", None, float(m), m) for m in range(6)]
    write.append(points(spark, rows), path)
    write.append(points(spark, [(T0, "a", None, 99.0, 100)]), path)
    run = (lambda: lifecycle.move(spark, path, staging, [("active", T0.date(), "warm")])) if kind == "move" else (lambda: lifecycle.compact(spark, path, staging, T0.date()))
    with monkeypatch.context() as m:
        _stop_at(m, publish.Files, step, nth)
        with pytest.raises(RuntimeError):
            run()
    # a row that comes in between is not lost
    write.append(points(spark, [(T0 + dt.timedelta(minutes=50), "a", None, 50.0, 200)]), path)
    run()
    got = sorted((r["tier"], r["usage"]) for r in lifecycle.read(spark, path).collect())
    want = [*map(float, range(6)), 50.0, 99.0] if kind == "move" else [*map(float, range(1, 6)), 50.0, 99.0]
    assert got == [("warm" if kind == "move" else "active", u) for u in sorted(want)]


def test_tag_values_survive_compaction(spark, tmp_path):
    path, staging = str(tmp_path / "m"), str(tmp_path / "s")
    write.append(points(spark, [(T0, "a", None, 1.0, 1), (T0, "a", None, 2.0, 2), (T0, "a", "\0", 3.0, 3)]), path)
    got = lifecycle.compact(spark, path, staging, T0.date())
    assert sorted((r["tag_region"] is None, r["usage"]) for r in got.collect()) == [(False, 3.0), (True, 2.0)]


def test_all_days_in_one_compaction(spark, tmp_path):
    path, staging = str(tmp_path / "m"), str(tmp_path / "staging")
    rows = [(T0 + dt.timedelta(days=k % 4), "a", float(s), s) for k in range(8) for s in range(3)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, tag_host string, usage double, write_seq int")
    write.append(df, path)
    write.append(df, path, "warm")
    got = lifecycle.compact(spark, path, staging)
    assert sorted((r["date"], r["usage"], r["tier"]) for r in got.collect()) == [(T0.date() + dt.timedelta(days=k), 2.0, "active") for k in range(4)]
    assert lifecycle.read(spark, path).where("tier = 'warm'").count() == 24
    assert lifecycle.compact(spark, path, staging).count() == 4  # a second run changes nothing


def test_levels(spark, tmp_path):
    path, staging = str(tmp_path / "m"), str(tmp_path / "s")
    every = []
    for k in range(8):
        assert lifecycle.compact_levels(spark, path, staging) == []
        rows = [(T0 + dt.timedelta(minutes=m), "a", None, float(k), k) for m in range(3)]
        every += rows
        write.append(points(spark, rows), path)
    assert lifecycle.compact_levels(spark, path, staging) == [1]
    assert {r["level"] for r in lifecycle.files(spark, path).collect()} == {1}
    assert [r["usage"] for r in lifecycle.read(spark, path).collect()] == [7.0] * 3
    for n in ("L1-x", "L1-y", "L1-z"):
        write.laid_out(points(spark, [(T0, "b", None, 1.0, 50)])).write.mode("append").partitionBy("tier", "date").parquet(str(tmp_path / n))
        from tidespan.operators.publish import Files

        f = Files(spark)
        for name in f.below(str(tmp_path / n)):
            at, _, last = name.rpartition("/")
            assert f.rename(str(tmp_path / n / name), f"{path}/{at}/{n}-{last}")
    assert lifecycle.compact_levels(spark, path, staging) == [2]
    listed = lifecycle.files(spark, path).collect()
    assert {r["level"] for r in listed} == {2} and [r["modified"] for r in listed] == sorted((r["modified"] for r in listed), reverse=True)
    assert lifecycle.read(spark, path).count() == 4


def test_hot_days_take_more_files(spark, tmp_path):
    """Files follow the rows: a day that holds most of them, and one series of it, is not one file."""
    hot = spark.range(200_000).select((F.lit(T0) + F.make_dt_interval(secs=F.col("id") / 10)).cast("timestamp_ntz").alias("timestamp"), F.lit("a").alias("tag_host"), F.rand(1).alias("usage"))
    cold = spark.range(10).select((F.lit(T0) + F.make_dt_interval(days=F.col("id").cast("int") + 2)).cast("timestamp_ntz").alias("timestamp"), F.lit("a").alias("tag_host"), F.rand(1).alias("usage"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write.append(hot.unionByName(cold), str(tmp_path / "m"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    n = {str(r["date"]): r["n"] for r in lifecycle.files(spark, str(tmp_path / "m")).groupBy("date").agg(F.count("*").alias("n")).collect()}
    assert n[str(T0.date())] >= 3


def test_life_cycle(spark, tmp_path):
    path, staging = str(tmp_path / "m"), str(tmp_path / "s")
    rows = [(T0 + dt.timedelta(days=d, minutes=m), "a", None, float(m), m) for d in (0, 20, 30) for m in range(3)]
    write.append(points(spark, rows), path)
    write.append(points(spark, [(T0, "a", None, 99.0, 100)]), path)
    assert lifecycle.compact(spark, path, staging, T0.date()).where("usage = 99.0").count() == 1
    assert lifecycle.read(spark, path).count() == 9
    moved = lifecycle.demote_due(spark, path, staging + "2", dt.date(2024, 1, 31))
    assert [(a, b) for a, _, b in moved] == [("active", "cold"), ("active", "warm")]
    assert {(r["tier"], r["n"]) for r in lifecycle.read(spark, path).groupBy("tier").agg(F.count("*").alias("n")).collect()} == {("cold", 3), ("warm", 3), ("active", 3)}
    lifecycle.archive(spark, path, T0.date(), str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).count() == 3
    gone = lifecycle.apply_retention(spark, path, dt.date(2024, 4, 15), 30)
    assert sorted(t for t, _ in gone) == ["active", "warm"] and lifecycle.read(spark, path).count() == 3
    assert lifecycle.expired(spark.createDataFrame([("archive", T0.date())], "tier string, date date"), dt.date(2034, 1, 1), 1).count() == 0


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.create({"host": "string", "n": "int"}, at=1.0)
    t.append(spark.createDataFrame([("a", 1)], "host string, n int"), at=2.0)
    stale = t.current()
    t.append(spark.createDataFrame([("b", 2)], "host string, n int"), at=3.0)
    with pytest.raises(Conflict):
        t.append(spark.createDataFrame([("c", 3)], "host string, n int"), base=stale)
    assert t.scan(1).count() == 1 and t.scan(at=2.5).count() == 1 and t.scan().count() == 2
    t.tag("first", 1)
    t.evolve(rename={"host": "server"}, promote={"n": "bigint"}, add={"z": "double"})
    with pytest.raises(TypeError):
        t.evolve(promote={"server": "bigint"})
    t.append(spark.createDataFrame([("d", 4, 0.5)], "server string, n long, z double"))
    assert sorted(map(tuple, t.scan().collect())) == [("a", 1, None), ("b", 2, None), ("d", 4, 0.5)]
    assert t.scan(ref="first").columns == ["host", "n"]
    assert stats.snapshot_diff(t.files(1), t.files()).orderBy("change").collect()[0]["n_files"] == 2
    t.compact()
    assert len(t.current().files) == 1 and t.scan().count() == 3
    with pytest.raises(LookupError):
        t.find(at=0.5)
    t.rollback(1)
    assert t.scan().collect() == [("a", 1)]
    assert 1 not in t.expire(before=10.0) and t.history().count() == len(t.versions())
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([(1,)], "nope int"))


def test_partition_specs_and_pruning(spark, tmp_path):
    """Files are opened only if their partition and bounds may hold rows; commits keep their own spec."""
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.create({"timestamp": "timestamp_ntz", "tag_host": "string", "n": "int"}, [("timestamp", "day"), ("tag_host", "identity")])
    rows = [(T0 + dt.timedelta(days=d, hours=h), host, 100 * d + h) for d in range(4) for h in (1, 13) for host in ("a", "b", None)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, tag_host string, n int")
    t.append(df)
    t.respec([("timestamp", "month"), ("tag_host", "bucket", 4)])
    t.append(df.withColumn("n", F.col("n") + 1000))
    t.respec([])
    t.append(df.where("n < 100").withColumn("n", F.col("n") + 5000))
    t.evolve(promote={"n": "bigint"}, rename={"tag_host": "tag_server"}, add={"x": "double"})
    every = [(a, b, c) for a, b, c in rows] + [(a, b, c + 1000) for a, b, c in rows] + [(a, b, c + 5000) for a, b, c in rows if c < 100]
    day = T0 + dt.timedelta(days=2)
    ops = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    for where in ([], [("timestamp", ">=", day)], [("timestamp", "<", day), ("tag_server", "=", "a")], [("tag_server", "=", "b"), ("n", ">", 1100)], [("n", "=", 5001)], [("timestamp", "=", day + dt.timedelta(hours=1))], [("tag_server", ">=", "b")], [("x", "=", 1.0)], [("n", ">", 10**10)]):
        place = {"timestamp": 0, "tag_server": 1, "n": 2}
        want = [r for r in every if all(c in place and r[place[c]] is not None and ops[o](r[place[c]], v) for c, o, v in where)]
        got = t.scan(where=where)
        assert sorted(map(repr, (tuple(r)[:3] for r in got.collect()))) == sorted(map(repr, want)), where
    n = lambda where: t.planned(where).count()
    assert n([]) >= 12 + 2 and n([("n", "=", 5001)]) <= 1 and n([("n", ">", 10**10)]) == 0
    assert n([("timestamp", ">=", day)]) < n([]) and t.planned([("n", "<", 50)]).count() < n([])
    plan = t.scan(where=[("tag_server", "=", "a"), ("timestamp", ">=", day)])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "p_2_identity" in plan
    assert {r["column_name"]: r["partitioned_by"] for r in t.detail().collect()} == {"timestamp": None, "tag_server": None, "n": None, "x": None}
    gone = t.expire(before=time.time() + 1, keep=1, delete_data=True)
    assert gone and t.scan().count() == len(every)
    t.compact()
    t.expire(before=time.time() + 1, keep=1, delete_data=True)
    assert t.scan().count() == len(every) and len([x for x in os.listdir(tmp_path / "t" / "data")]) == 1


def test_a_version_is_never_half_written(spark, tmp_path, monkeypatch):
    from tidespan.operators import publish

    t = VersionedTable(spark, str(tmp_path / "t"))
    t.create({"n": "int"})
    with monkeypatch.context() as m:
        _stop_at(m, publish.Files, "rename", 1)
        with pytest.raises(RuntimeError):
            t.append(spark.range(3).select(F.col("id").cast("int").alias("n")))
    assert t.scan().count() == 0 and t.current().number == 0
    t.append(spark.range(3).select(F.col("id").cast("int").alias("n")))
    assert t.scan().count() == 3


def test_catalog_of_tables(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "w"))
    assert c.tables() == []
    c.create("cpu", {"n": "int"}).append(spark.range(2).select(F.col("id").cast("int").alias("n")))
    c.create("mem", {"n": "int"})
    with pytest.raises(Conflict):
        c.create("cpu", {"n": "int"})
    for bad in ("../x", "a/b", "", ".hidden", "a b"):
        with pytest.raises(ValueError):
            c.create(bad, {"n": "int"})
    with pytest.raises(Conflict):
        c.rename("cpu", "mem")
    c.rename("cpu", "cpu_2")
    c.drop("mem")
    assert c.tables() == ["cpu_2"] and c.load("cpu_2").scan().count() == 2
    assert c.register() == ["versioned_cpu_2"] and spark.sql("SELECT count(*) FROM versioned_cpu_2").first()[0] == 2
    with pytest.raises(LookupError):
        c.load("mem")


def test_points_into_a_table(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"measurement":"cpu","tags":{"host":"a"},"fields":{"v":"1.5"},"timestamp":5},{"measurement":"cpu","tags":{},"fields":{"v":"bad"},"timestamp":6},{"measurement":"cpu","tags":{},"fields":{},"timestamp":0},{"measurement":"cpu","tags":{},"fields":{"v":"{\\"Float\\":2.5}"},"timestamp":7}]')
    good, _ = files.read_json_points(spark, str(tmp_path / "p.json"))
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.create({"timestamp": "timestamp_ntz", "tag_host": "string", "v": "double"})
    _, n, bad = t.append_points(good)
    assert (n, bad) == (2, 2) and sorted((r["tag_host"] or "", r["v"]) for r in t.scan().collect()) == [("", 2.5), ("a", 1.5)]


def test_files(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"measurement":"cpu","tags":{"h":"a"},"fields":{"v":"1"},"timestamp":5},{"measurement":"cpu"}]')
    good, bad = files.read_json_points(spark, str(tmp_path / "p.json"))
    assert (good.count(), bad.count()) == (1, 1)
    (tmp_path / "p.csv").write_text("measurement,timestamp,tag_host,n,x,ok,s\ncpu,1000000,a,1,1.5,true,u\ncpu,2000000,,2,2,false,\n")
    df = files.read_csv_points(spark, str(tmp_path / "p.csv"))
    assert dict(df.dtypes) | {"tag_host": "string", "n": "bigint", "x": "double", "ok": "boolean", "s": "string"} == dict(df.dtypes)
    files.write_csv(df, str(tmp_path / "o"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "o")).count() == 2
    assert files.render(spark.range(5), "csv", 3) == (["0", "1", "2"], True)
    assert files.render(spark.range(1), "json") == (['{"id":0}'], False)
    assert files.render(spark.sql("SELECT 1 AS value, CAST(NULL AS STRING) AS `a.b`"), "json") == (['{"value":1,"a.b":null}'], False)


def test_fixtures(spark):
    assert fixtures.simple(spark, 20).where("tag_host = 'host_0003'").count() == 2
    assert fixtures.cross_day(spark, 2).select(F.to_date("timestamp").alias("d")).distinct().count() == 2
    for f in (fixtures.mixed_types, fixtures.ohlcv, fixtures.apm_trace, fixtures.iot_sensor):
        assert f(spark, 30).count() == 30
