import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidespan.llm import common, simhash

from .helpers import EDGES, documents, prose, with_clashes


def brute_print(text):
    import re

    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints):
    comp = {i: i for i in range(len(ids))}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                comp[find(a)] = find(b)
    low = {}
    for k, i in enumerate(ids):
        r = find(k)
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return [low.get(find(k)) for k in range(len(ids))]


def corpus(rng):
    rows = [*EDGES, (50, "A B C d"), (51, "a b c D"), (52, "x y " * 4000)]
    for k in range(25):
        t = prose(rng, rng.randrange(3, 200))
        rows.append((100 + 10 * k, t))
        w = t.split()
        for j in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "changed"
            rows.append((101 + 10 * k + j, " ".join(w)))
    return rows


def test_against_brute_force(spark):
    rows = corpus(random.Random(5))
    prints = [brute_print(t) for _, t in rows]
    want = sorted((str(i), f"{p:016x}", str(c)) for (i, _), p, c in zip(rows, prints, brute_components([i for i, _ in rows], prints)))
    got = simhash.near_duplicates(with_clashes(documents(spark, rows))).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want


@pytest.mark.parametrize(("limit", "hot"), [(4, False), (4, True), (1024, False)])
def test_links_on_dense_fingerprints(spark, monkeypatch, limit, hot):
    """Clusters of near fingerprints, through top nodes, through deeper ones, and with hot nodes and hubs."""
    monkeypatch.setattr(simhash, "NODE_LIMIT", limit)
    if hot:
        monkeypatch.setattr(common, "HOT", 1_000_000)
        monkeypatch.setattr(common, "HOT_ROWS", 3)
    rng = np.random.default_rng(6)
    codes = set()
    for base in rng.integers(0, 2**63, 12, dtype=np.uint64).tolist() + [0, 2**64 - 1]:
        for _ in range(40):
            c = base
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                c ^= 1 << int(b)
            codes.add(c)
    codes = sorted(codes)
    want = brute_components(list(range(len(codes))), codes)
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(c,) for c in signed], "fp long")
    root = {r["a"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    place = {c: k for k, c in enumerate(signed)}
    groups = {}
    for c in signed:
        groups.setdefault(root.get(c, c), []).append(place[c])
    got = {k: min(v) for v in groups.values() for k in v}
    assert [got[k] for k in range(len(codes))] == want


def test_crowded_top_node(spark, monkeypatch):
    """100,000 fingerprints that agree in their first 30 bits: no pair is lost, and no node is searched whole."""
    rng = np.random.default_rng(7)
    codes = np.unique(np.concatenate([rng.integers(0, 2**34, 90_000, dtype=np.uint64), np.arange(0, 2**16, 8, dtype=np.uint64)]))
    near = codes[:500] ^ (np.uint64(1) << rng.integers(0, 34, 500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 34, 500).astype(np.uint64))
    codes = np.unique(np.concatenate([codes, near]))
    known, parent = {int(c): k for k, c in enumerate(codes)}, np.arange(len(codes))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    masks = [0, *(1 << b for b in range(34))]
    ones = {}
    for c, k in known.items():  # a pair at distance 2 or less shares a value within one bit of both
        for m in masks:
            ones.setdefault(c ^ m, []).append(k)
    for ks in ones.values():
        for k in ks[1:]:
            a, b = find(ks[0]), find(k)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(int(c),) for c in codes], "fp long")
    root = {r["a"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    assert all(root.get(c, c) == int(codes[find(k)]) for c, k in known.items())


def test_long_chains(spark):
    n = 200
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(500, 501)], "a long, b long")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0, 500}
    assert simhash.components(edges.where(F.lit(False))).count() == 0


def test_one_of_each_group_stays(spark):
    t = prose(random.Random(7), 60)
    docs = with_clashes(documents(spark, [(3, t), (1, t), (2, t), (9, "another text that has nothing to do with it"), (1, t)]))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 9]
    assert simhash.drop_near_duplicates(docs.where(F.lit(False))).count() == 0


def test_rows_without_ids(spark):
    """Different texts without an id are different documents; one row of each stays."""
    t, u, v = (prose(random.Random(k), 60) for k in (8, 9, 10))
    docs = documents(spark, [(None, t), (4, t), (None, u), (None, u), (None, v)])
    assert sorted((str(r["doc_id"]), r["text"]) for r in simhash.drop_near_duplicates(docs).collect()) == sorted([("4", t), ("None", u), ("None", v)])


def test_unlike_texts_with_one_id(spark):
    """Every component leaves a row, whatever ids its rows repeat or lack."""
    a, b, c, d = (prose(random.Random(k), 60) for k in (21, 22, 23, 24))
    docs = documents(spark, [(5, a), (5, b), (7, b), (None, c), (None, d), (None, d), (None, b)])
    assert sorted((str(r["doc_id"]), r["text"]) for r in simhash.drop_near_duplicates(docs).collect()) == sorted([("5", a), ("5", b), ("None", c), ("None", d)])
    clash = with_clashes(docs)
    kept = simhash.drop_near_duplicates(clash)
    assert kept.columns == clash.columns and kept.count() == 4
    assert simhash.drop_near_duplicates(docs.where(F.lit(False))).count() == 0


def test_pipeline_stage_keeps_every_component(spark):
    import corpus_pipeline

    a, b = (prose(random.Random(k), 60) for k in (21, 22))
    docs = documents(spark, [(5, a), (5, b), (7, b)])
    assert {r["text"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {a, b}
