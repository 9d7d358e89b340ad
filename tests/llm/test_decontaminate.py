import random

import duckdb
from pyspark.sql import functions as F

from tidespan.llm import common, decontaminate

from .helpers import EDGES, documents, prose, with_clashes

QUESTION = "A train leaves Berlin at 60 km per hour and reaches Paris after 12 hours , so how far is Berlin from Paris in km when it drives at 60 km per hour"


def items(spark):
    return spark.createDataFrame([(1, QUESTION), (2, "too short"), (3, None), (4, ""), (5, prose(random.Random(1), 30))], "item_id long, text string")


def cases():
    rng = random.Random(8)
    swap = QUESTION.replace("60", "75").replace("Berlin", "Madrid").replace("Paris", "Lisbon").replace("12", "9")
    broken = QUESTION.replace("60 km per hour and", "75 km per hour and").replace("Berlin from", "Madrid from")
    around = lambda t: f"{prose(rng, 20)} {t} {prose(rng, 20)}"
    return {10: around(QUESTION), 11: around(swap), 12: around(broken), 13: around(" ".join(QUESTION.split()[:12])), 14: prose(rng, 400), 15: around(prose(random.Random(1), 30)), 16: around(QUESTION.upper()), 17: around("".join(w + "*** " for w in QUESTION.split()))}


def test_copies_and_new_parameters_are_found(spark):
    docs = documents(spark, [*EDGES, *cases().items(), (10, cases()[10])])
    got = decontaminate.contaminated(with_clashes(docs), items(spark)).collect()
    # 12 uses two values for one slot, 13 is too little, 16 has no names any more but other words
    assert {(r["doc_id"], r["item_id"]) for r in got} >= {(10, 1), (11, 1), (15, 5), (17, 1)}
    assert not {12, 13, 14} & {r["doc_id"] for r in got}
    left = decontaminate.drop_contaminated(docs, items(spark))
    assert left.columns == docs.columns and {12, 13, 14} <= {r["doc_id"] for r in left.collect()} and left.where("doc_id IN (10, 11, 15, 17)").count() == 0


def test_equals_sql(spark):
    docs, bench = documents(spark, [(k, t) for k, t in cases().items()] + [(1, None), (2, ""), (3, " ")]), items(spark)
    c = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", bench)):
        c.register(name, df.toPandas())
    want = c.execute(decontaminate.oracle_sql()).fetchall()
    got = decontaminate.contaminated(docs, bench).select("doc_id", "item_id", "n_windows", "n_matched").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_empty_tables_and_native_plan(spark):
    docs, bench = documents(spark, EDGES), items(spark)
    assert decontaminate.contaminated(docs.where(F.lit(False)), bench).count() == 0
    found = decontaminate.contaminated(docs, bench.where(F.lit(False)))
    assert found.count() == 0 and "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_copies_in_any_case_are_dropped(spark):
    rng = random.Random(9)
    around = lambda t: f"{prose(rng, 20)} {t} {prose(rng, 20)}"
    docs = documents(spark, [(20, around(QUESTION.lower())), (21, around(QUESTION.upper())), (22, around(" ".join(QUESTION.lower().split()[:12]))), (23, prose(rng, 200))])
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, items(spark)).collect()) == [22, 23]


def test_one_window_in_all_documents_and_items(spark, monkeypatch):
    """A common template makes no pairs of its own, joined over salts or not, and nothing else is lost."""
    rng = random.Random(10)
    numbers = lambda n: " ".join(str(rng.randrange(1000)) for _ in range(n))
    fresh = lambda n: " ".join(f"w{rng.getrandbits(30):x}".translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(n))
    asked = [(k, f"{numbers(6)} {fresh(25)} {numbers(6)}") for k in range(60)]
    bench = spark.createDataFrame([*asked, (99, numbers(9))], "item_id long, text string")
    rows = [(k, f"{numbers(30)} {fresh(30)} {numbers(8)}") for k in range(150)] + [(1000 + k, f"{fresh(9)} {t} {fresh(9)}") for k, t in asked[::7]]
    docs = documents(spark, rows)
    c = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", bench)):
        c.register(name, df.toPandas())
    want = sorted(c.execute(decontaminate.oracle_sql()).fetchall())
    assert {(1000 + k, k) for k, _ in asked[::7]} <= {(d, i) for d, i, *_ in want}
    for hot in (False, True):
        if hot:
            monkeypatch.setattr(common, "HOT", 10)
            monkeypatch.setattr(common, "HOT_ROWS", 50)
        got = decontaminate.contaminated(docs, bench).select("doc_id", "item_id", "n_windows", "n_matched").collect()
        assert sorted(map(tuple, got)) == want
    pairs = [p for p in seen_pairs(spark, docs, bench)]
    assert all(n < 400 for n in pairs)  # of 150 x 61 that share the window


def seen_pairs(spark, docs, bench):
    """Numbers of pairs that the rare windows form, each time they are stored."""
    found, real = [], decontaminate.materialize

    def keep(df, name):
        out = real(df, name)
        if name == "bench-pairs":
            found.append(out.where("m_item_id <> 99").count())
        return out

    decontaminate.materialize = keep
    try:
        decontaminate.contaminated(docs, bench).count()
    finally:
        decontaminate.materialize = real
    return found


def test_very_long_document(spark):
    rng = random.Random(11)
    long = prose(rng, 150_000) + " " + QUESTION + " " + prose(rng, 150_000)
    docs = documents(spark, [(1, long), (2, long), (3, prose(rng, 200_000))])
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items(spark)).collect()} == {(1, 1), (2, 1)}
