import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidespan.llm import quality
from tidespan.llm.quality import Condition, DecisionList

from .helpers import EDGES, documents, prose, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    at = {}
    for k in range(len(w) - 4):
        at.setdefault(tuple(w[k : k + 5]), []).append(k)
    covered = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def corpus(rng):
    rows = list(EDGES)
    for k in range(40):
        t = prose(rng, rng.randrange(0, 80), VOC)
        rows.append((100 + k, "\n".join([t] * rng.randrange(1, 3)) if k % 3 else t.replace(" ", "\n")))
    rows += [(900, "a b c d e f a b c d e f a b"), (901, "x " * 5000), (902, "a|b#c <d> $%&*\n\na|b#c <d> $%&*\n")]
    return rows


VOC = "a b c d é ff".split()


def test_base_columns_against_brute_force(spark):
    rows = corpus(random.Random(3))
    got = quality.quality_rules(with_clashes(documents(spark, rows)), spark.createDataFrame([], "doc_id long, quality int")).collect()
    want = sorted((str(i), *brute(t)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"])  # nothing to learn from


def test_learns_a_threshold_and_keeps_clean_documents(spark):
    rng = random.Random(4)
    junk = lambda t: " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in t.split())
    rows = [(k, junk(t) if k % 3 == 0 else t) for k in range(300) for t in [prose(rng, rng.randrange(20, 90))]]
    labels = spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(200)] + [(None, 1), (5, None)], "doc_id long, quality int")
    docs = documents(spark, rows)
    stats = quality.document_stats(docs)
    rules = quality.learn(stats, labels)
    assert rules.rules and "reject" in str(rules)
    got = {r["doc_id"]: r["kept"] for r in quality.judge(stats, rules).where("n_repeat_words = 0").collect()}
    assert sum(got[k] == (k % 3 != 0) for k in got) >= 0.99 * len(got)
    kept = quality.keep_good(with_clashes(docs), labels)
    assert set(docs.columns) < set(kept.columns) and not any("###" in r["text"] for r in kept.collect())


def test_rules_are_ordered_and_native(spark):
    rules = DecisionList(((Condition("n_words_d", False, 3.0),), (Condition("n_words_d", False, 10.0), Condition("symbol_share", True, 0.1))))
    stats = quality.document_stats(documents(spark, [(1, "a b"), (2, "a# b# c# d#"), (3, "a b c d")]))
    judged = quality.judge(stats, rules)
    assert {r["doc_id"]: r["rule"] for r in judged.collect()} == {1: 1, 2: 2, 3: 0}
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "CASE WHEN" in plan and "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("y", [0, 1])
def test_one_class_and_empty_tables(spark, y):
    docs = documents(spark, [(k, "a b c d e f g h i j k l m") for k in range(20)])
    assert quality.quality_rules(docs, spark.createDataFrame([(k, y) for k in range(20)], "doc_id long, quality int")).where("kept").count() in (0, 20)
    assert quality.quality_rules(docs.where(F.lit(False)), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


# --- brute force of the learner: every candidate counted row by row ---------------------------------


def brute_values(text):
    n, chars, symbols, dup, repeat = brute(text)
    text = text or ""
    lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
    share = lambda a, b: a / b if b > 0 else 0.0
    return {"dup_line_share": share(dup, lines), "exclaim_share": share(text.count("!"), chars), "mean_word": share(chars, n), "n_words_d": float(n), "repeat_share": share(repeat, n), "symbol_share": share(symbols, chars), "upper_share": share(sum("A" <= c <= "Z" for c in text), chars), "words_per_line": share(n, lines)}


def holds(rule, v):
    return all((v[f] > t) == above for f, above, t in rule)


def brute_learn(rows, cuts):
    """rows: (bad, prune, values). Grow by FOIL gain over all candidates, prune by worth, stop when not precise."""
    rules, left = [], rows
    while len(rules) < quality.MAX_RULES:
        grown, here = [], [r for r in left if not r[1]]
        while len(grown) < quality.MAX_CONDITIONS:
            p0 = sum(r[0] for r in here)
            options = []
            for f in sorted(cuts):
                for t in cuts[f]:
                    for above in (False, True):
                        kept = [r for r in here if (r[2][f] > t) == above]
                        p = sum(r[0] for r in kept)
                        if (f, above, t) in grown or p < quality.MIN_COVERED:
                            continue
                        options.append((p * (math.log2(p / len(kept)) - math.log2(p0 / len(here))), f, above, t))
            best = max((g for g, *_ in options), default=0)
            if best <= 2e-9:
                break
            ties = [o[1:] for o in options if o[0] > best - 1e-9]
            f = ties[0][0]
            ties = [o for o in ties if o[0] == f]
            low, high = [o for o in ties if not o[1]], [o for o in ties if o[1]]
            # of one feature: the first of the candidates by threshold; of equal lower bounds the highest
            first = min(ties, key=lambda o: (o[2], o[1]))
            pick = first if not first[1] else max(high, key=lambda o: o[2])
            assert low or high
            grown.append(pick)
            here = [r for r in here if holds([pick], r[2])]
        if not grown:
            break
        worth = []
        for k in range(1, len(grown) + 1):
            hit = [r[0] for r in left if r[1] and holds(grown[:k], r[2])]
            worth.append(((2 * sum(hit) - len(hit)) / max(1, len(hit)), -k, sum(hit), len(hit)))
        _, k, bad, n = max(worth)
        if not bad or bad < quality.MIN_PRECISION * n:
            break
        rules.append(tuple(grown[:-k]))
        left = [r for r in left if not holds(rules[-1], r[2])]
    return rules


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_learner_against_brute_force(spark, monkeypatch, seed):
    rng = random.Random(seed)
    spoil = [lambda t: t, lambda t: t, lambda t: t.upper(), lambda t: "! ".join(t.split()), lambda t: t.replace(" ", "#$ "), lambda t: t.replace(" ", "\n")]
    rows = [(k, rng.choice(spoil)(prose(rng, rng.randrange(15, 60)))) for k in range(500)]
    odd = lambda t: t.isupper() or "!" in t or ("#" in t and len(t.split()) > 25)
    labels = [(k, int(not odd(t) if rng.random() < 0.97 else odd(t))) for k, t in rows]
    cuts, real = [], quality._between
    monkeypatch.setattr(quality, "_between", lambda v: cuts.append(real(v)) or cuts[-1])
    docs = documents(spark, rows)
    marked = spark.createDataFrame(labels, "doc_id long, quality int")
    stats = quality.document_stats(docs)
    got = quality.learn(stats, marked)
    prune = {r[0]: r[1] for r in docs.select("doc_id", F.abs(F.hash("doc_id", F.lit(7))) % 3 == 0).collect()}
    label, table = dict(labels), []
    for k, t in rows:
        n, *_, repeat = brute(t)
        if n >= 10 and 100 * repeat <= 20 * n:
            table.append((int(label[k] == 0), prune[k], brute_values(t)))
    want = brute_learn(table, dict(zip(quality.feature_columns(), cuts)))
    assert [tuple((c.feature, c.above, c.threshold) for c in r) for r in got.rules] == want and want
    values = {k: brute_values(t) for k, t in rows}
    first = {k: next((m for m, r in enumerate(want, 1) if holds(r, v)), 0) for k, v in values.items()}
    assert {r["doc_id"]: r["rule"] for r in quality.judge(stats, got).collect()} == first
