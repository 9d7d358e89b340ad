"""Every registered core query against its DuckDB equivalent, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidespan.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    q = duck.execute(ORACLES[name])
    names = [x[0] for x in q.description]
    want = q.fetchall()
    assert sorted(df.columns) == sorted(names)
    a = [df.columns.index(c) for c in sorted(names)]
    b = [names.index(c) for c in sorted(names)]
    # -0.0 and 0.0 are one value
    flat = lambda v: [flat(x) for x in v] if isinstance(v, (list, tuple)) else v + 0.0 if isinstance(v, float) else v
    assert sorted(repr(flat([r[i] for i in a])) for r in got) == sorted(repr(flat([r[i] for i in b])) for r in want)


@pytest.mark.parametrize("missing", ["tidespan.llm.queries", "zstandard"])
def test_entry_without_corpus_operators(monkeypatch, missing):
    """The entry imports and offers the core queries where the subpackage, or a library that it needs, is gone."""
    import sys

    import __spark_entry__

    for name in [n for n in sys.modules if n.startswith("tidespan.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    assert set(__spark_entry__.queries()) == set(QUERIES) and set(__spark_entry__.oracle_sql()) == set(ORACLES)


@pytest.mark.parametrize("name", ["csv_round_trip", "archive_restore"])
def test_all_events_come_back(spark, duck, monkeypatch, name):
    """The queries export and read back every event, also those that their SQL does not compare."""
    from tidespan.plans import catalog

    read, seen = {"csv_round_trip": "_from_csv", "archive_restore": "_restored"}[name], []
    real = getattr(catalog, read)
    monkeypatch.setattr(catalog, read, lambda *a: seen.append(real(*a)) or seen[0])
    QUERIES[name](spark, SF)
    got = seen[0].select("event_id", "tag_event_type", "value").collect()
    assert sorted(map(tuple, got)) == sorted(duck.execute("SELECT event_id, event_type, value FROM events").fetchall())


def test_not_in_gathers_no_table(spark, duck):
    """NOT IN broadcasts one row of counts; its subquery is merged by key, and not built into a table on the driver."""
    df = QUERIES["join_not_in"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "HashedRelationBroadcastMode" not in plan and "SortMergeJoin" in plan and plan.count("BroadcastExchange ") == 1
    assert sorted(map(tuple, df.collect())) == sorted(duck.execute(ORACLES["join_not_in"]).fetchall())
