import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidespan.llm import langid

from .helpers import EDGES, documents, prose, with_clashes

OTHER = "der die und ein nicht straße über können mädchen schön wasser groß klein haus abend morgen".split()


def brute_phrases(sequences, test):
    """Longest-match parsing by searching strings."""
    n, k = 0, 0
    while k < len(test):
        m = 0
        while k + m < len(test) and any(test[k : k + m + 1] in s for s in sequences):
            m += 1
        n, k = n + 1, k + max(m, 1)
    return n


@pytest.mark.parametrize(("piece", "chunk"), [(16, 64), (16, 1 << 20), (128, 1 << 20)])
def test_whole_texts_are_parsed_like_string_search(monkeypatch, piece, chunk):
    """One parse without a break, however the symbols are dealt to pieces and chunks."""
    monkeypatch.setattr(langid, "PIECE", piece)
    monkeypatch.setattr(langid, "CHUNK", chunk)
    rng = random.Random(1)
    training = (("a", tuple(prose(rng, 20) for _ in range(3))), ("b", tuple(prose(rng, 20, OTHER) for _ in range(3))))
    table = langid._tables(training)[0]
    text = lambda t: "".join(chr(65 + s) for s in langid.symbols(t, table))
    texts = [prose(rng, 15), prose(rng, 90, OTHER), "", "x", "日本 and", "a1b2  c--d", "the " * 40, training[0][1][0], training[0][1][1] + " " + training[0][1][1], "日" * 50, prose(rng, 200)]
    got, size = langid.phrase_counts(texts, training)
    for row, n, t in zip(got, size, texts):
        assert n == len(text(t)) and row.tolist() == [brute_phrases([text(x) for x in ts], text(t)) for _, ts in training]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc d", max_size=120), min_size=1, max_size=4), st.lists(st.text("abcx d", max_size=200), max_size=5))
def test_any_text_is_parsed_like_string_search(training, texts):
    training = (("l", tuple(training)),)
    table, _, _, _ = langid._tables(training)
    text = lambda t: "".join(chr(65 + s) for s in langid.symbols(t, table))
    piece, langid.PIECE = langid.PIECE, 8
    try:
        got, _ = langid.phrase_counts(texts, training)
    finally:
        langid.PIECE = piece
    assert got[:, 0].tolist() == [brute_phrases([text(x) for x in training[0][1]], text(t)) for t in texts]


def test_costs_are_for_each_symbol():
    """More phrases lose only against the text's length and the labelled text's size."""
    counts, bits = np.array([[10, 12], [10, 12], [0, 0]]), np.array([10.0, 8.0])
    names, score = langid.decide(counts, np.array([100, 10, 0]), bits, ["a", "b"])
    assert names == ["b", "b", "a"]
    assert score == pytest.approx([1 / (1 + 2 ** (0.96 - 1.0)), 1 / (1 + 2 ** (9.6 - 10)), 0.5])


def test_predictions(spark):
    rng = random.Random(2)
    rows = [(i, t, None, "s") for i, t in EDGES]
    rows += [(100 + k, prose(rng, rng.randrange(3, 300), OTHER if k % 2 else None), "de" if k % 2 else "en", "s") for k in range(200)]
    docs = documents(spark, rows)
    training = langid.learn(docs.where("doc_id < 250"))
    assert [lang for lang, _ in training] == ["de", "en"]
    found = langid.identify(with_clashes(docs), training)
    got = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == len(rows)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 7))
    assert np.mean([got[100 + k]["lang_pred"] == ("de" if k % 2 else "en") for k in range(150, 200)]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_nothing_learned(spark):
    docs = documents(spark, [(1, "some text", None, "s"), (2, "more", None, "s")])
    training = langid.learn(docs)
    assert training == () and {r["lang_pred"] for r in langid.identify(docs, training).collect()} == {"und"}
    assert langid.identify(docs.where(F.lit(False)), training).count() == 0


def test_large_alphabets(monkeypatch):
    """Scripts of many letters are told apart by them, with a table and by edges."""
    rng = random.Random(3)
    han = [chr(c) for c in range(0x4E00, 0x4E00 + 400)] + [chr(0x20000 + k) for k in range(100)]
    write = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    common = [chr(0x430 + k) for k in range(32)] + [chr(97 + k) for k in range(26)]
    training = (("a", tuple(write(common, 190) for _ in range(40))), ("b", tuple(write(han[::2], 190) for _ in range(9))), ("c", tuple(write(han[1::2], 190) for _ in range(9))))
    texts = [training[1 + k % 2][1][k % 9][10:110][::-1] + training[1 + k % 2][1][k % 7][20:90] for k in range(20)] + [write(common, 300), "", "x y"]
    counts = langid.phrase_counts(texts, training)[0]
    assert (counts[0:20:2, 1] < counts[0:20:2, 2]).all() and (counts[1:20:2, 2] < counts[1:20:2, 1]).all()
    langid._tables.cache_clear()
    monkeypatch.setattr(langid, "DENSE", 0)
    assert (langid.phrase_counts(texts, training)[0] == counts).all()
    langid._tables.cache_clear()


def test_languages_are_learned_past_empty_texts(spark):
    rng = random.Random(4)
    rows = [(k, (None, "123 !", "")[k % 3], "de", "s") for k in range(600)] + [(1000 + k, prose(rng, 30, OTHER), "de", "s") for k in range(3)]
    rows.append((2000, "1 " * 3000 + "straße", "fr", "s"))
    got = dict(langid.learn(documents(spark, rows), train_docs=3))
    assert len(got["de"]) == 3 and all(map(langid.has_letter, got["de"])) and "straße" in got["fr"][0]


def test_whole_rows_are_learned_up_to_the_bound(spark):
    """Rows are never cut; longer ones than the bound come last; repeated rows count once each."""
    rng = random.Random(5)
    rows = [(k, prose(rng, 30), "de", "s") for k in range(20)] + [(100, prose(rng, 2000), "de", "s"), (101, prose(rng, 3000), "fr", "s"), (102, prose(rng, 2500), "fr", "s"), (103, prose(rng, 30), None, "s")]
    got = dict(langid.learn(documents(spark, rows), train_chars=1000))
    texts = {t for _, t, *_ in rows}
    assert set(got) == {"de", "fr"} and all(t in texts for ts in got.values() for t in ts)
    assert 1000 <= sum(map(len, got["de"])) < 1500 and got["fr"] == (rows[22][1],)


def test_very_long_text(spark):
    rng = random.Random(6)
    rows = [(k, prose(rng, 40, OTHER if k % 2 else None), "de" if k % 2 else "en", "s") for k in range(40)]
    training = langid.learn(documents(spark, rows))
    long = documents(spark, [(1, prose(rng, 500_000, OTHER)), (2, "ü" * 3_000_000), (3, "1 " * 10)])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(long, training).collect()}
    assert got[1][0] == "de" and 0.5 < got[1][1] <= 1 and got[2][0] in ("de", "en") and got[3] == ("und", 0)
