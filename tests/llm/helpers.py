"""Small texts and frames for the corpus operators' tests."""

import random

from pyspark.sql import functions as F

VOCABULARY = "the of and river mountain small green house walks under bright morning light people often carry water along old stone paths near quiet towns where market days begin early".split()

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, words=None) -> str:
    return " ".join(rng.choice(words or VOCABULARY) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def documents(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, "en", "src0")[:4] if len(r) == 2 else r for r in rows]
    return spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in full], SCHEMA)


def with_clashes(df):
    """Extra columns with names that operators use for their own."""
    for name in ("fp", "kept", "size", "h", "target", "n_tokens", "score", "rule", "start", "id", "source_size", "times", "row_id", "dk", "gone", "part", "ids", "y", "component_id", "item_id"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "same text here"), (6, "same text here"), (7, "!!! ??? ..."), (None, "text without an id"), (8, "é ß 日本語 𝔘 a")]
