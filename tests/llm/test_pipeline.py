import os
import random

import pytest

import corpus_pipeline

from .helpers import documents, prose, with_clashes

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
        if name != "token_output":
            assert docs.columns == columns
            assert {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()} <= texts
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "source_mix", "token_output"]
    assert seen[1] <= seen[0] and seen[2] <= seen[1] and seen[3] <= seen[2] and seen[4] == seen[5] > 0
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def through(spark, docs, tmp_path):
    """The rows after each stage, each stored and read again."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out.append(docs)
    return out


def test_empty_table_through_all_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [d.count() for d in through(spark, docs.where("false"), tmp_path)] == [0] * 5


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Null and repeated ids, nulls in any column, very long and repeated rows, columns of clashing names."""
    rng = random.Random(1)
    texts = [prose(rng, 80, [w + str(k) for k in range(60) for w in ("river", "stone", "light")]) for _ in range(8)]
    long = " ".join(f"w{rng.getrandbits(40)}" for _ in range(100_000))
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[2]), (8, texts[2]), (9, None), (None, None), (10, ""), (11, long)]
    docs = with_clashes(documents(spark, [(i, t, None if k % 2 else "en", None if k % 3 == 0 else "a") for k, (i, t) in enumerate(rows)]))
    quality, near, clean, mixed, tokens = through(spark, docs, tmp_path)
    assert all(d.columns == docs.columns for d in (quality, near, clean, mixed))
    kept = sorted((str(r["doc_id"]), r["text"]) for r in near.collect())
    assert {t for _, t in kept} == {r["text"] for r in quality.collect()} >= {texts[0], texts[1], texts[2], texts[3], long}
    assert len(kept) == len({t for _, t in kept})  # one row of each text, whatever its id
    assert ("7", texts[2]) in kept and ("7", texts[3]) in kept and ("None", texts[1]) in kept
    assert mixed.count() == tokens.count() > 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_entry_registers_all():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}
