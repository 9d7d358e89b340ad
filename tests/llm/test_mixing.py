import random

import pytest
from pyspark.sql import functions as F

from tidespan.llm import mixing

from .helpers import EDGES, documents, prose, with_clashes


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        part = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if part[s] > cap * sizes[s]]
        if not over:
            return fixed | part
        fixed |= {s: cap * sizes[s] for s in over}


def corpus():
    rng = random.Random(9)
    rows = [(i, t, "en", s) for (i, t), s in zip(EDGES, ["b", None, "a", "b", "é", "Z", "Z", None, "a", "hot"])]
    rows += [(1000 + k, prose(rng, int(rng.paretovariate(0.9) * 5) % 600), "en", "hot" if k % 3 == 0 else rng.choice(["a", "b", "c", "é", "Z", None])) for k in range(900)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_targets_and_taken(spark, rows, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 150)
    docs = with_clashes(documents(spark, rows).withColumnRenamed("n_chars", "taken"))
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = brute_targets(sizes), {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(30, 0.02 * t), (s, t, taken[s])
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(docs.repartition(7)).collect()))


def test_mix_repeats_whole_rows(spark, rows):
    docs = documents(spark, rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    times = {}
    for r in mixing.plan(docs).collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + r["times"]
    got = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {k: v for k, v in times.items() if v}


def test_many_sources_and_empty(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"))
    assert mixing.plan(docs).count() == 300
    assert mixing.plan(docs.where(F.lit(False))).count() == 0
    assert mixing.plan(docs.withColumn("text", F.lit(None).cast("string"))).where("taken = 0 AND target = 0").count() == 300


def test_rows_without_ids_and_long_texts(spark, monkeypatch):
    """Rows of no id and one size are dealt by their texts; whole long texts count."""
    monkeypatch.setattr(mixing, "SHARD_DOCS", 40)
    rng = random.Random(12)
    rows = [(None, prose(rng, 10), "en", "a") for _ in range(400)] + [(1, "w " * 400_000, "en", "b"), (2, None, "en", None)]
    got = mixing.plan(documents(spark, rows)).collect()
    assert len(got) == 402 and next(r for r in got if r["doc_id"] == 1)["size"] == 400_000
    mine = [r for r in got if r["source"] == "a"]
    assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 0.02 * mine[0]["target"] + 30
    sized = mixing._sized(documents(spark, rows), "doc_id", "text", "source")
    assert sized.where("source = 'a'").select("h").distinct().count() == 400


def test_weights_follow_code_points(spark):
    names = ["b", "a", "Z", "é", None, "𝔘", "ﬁ", "zz", "z"]
    sources = spark.createDataFrame([(n, 1) for n in names], "source string, source_size long")
    got = {r["source"]: r["weight"] for r in mixing.cyclic_weights(sources, (5, 2, 1)).collect()}
    order = sorted([n for n in names if n is not None]) + [None]
    assert got == {n: (5.0, 2.0, 1.0)[k % 3] for k, n in enumerate(order)}
