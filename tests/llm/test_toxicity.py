import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidespan.llm import toxicity as tx

from .helpers import EDGES, documents, prose, with_clashes

MODEL = tx.Model({"=idiot": 3.0, "grumb": 2.0})


def patterns(text):
    symbols = [s for w in text.lower().split() for s in MODEL.symbols(w)]
    return {p: w for p, w in zip(tx.PATTERNS, tx.clause_scores(symbols)) if w}


def test_clauses_not_words():
    assert patterns("what an idiot") == {"plain": 3.0}
    assert patterns("you are an idiot") == {"targeted": 3.0} and patterns("an idiot you are.") == {"targeted": 3.0}
    assert patterns("you left. an idiot came") == {"plain": 3.0}
    assert patterns("you are not an idiot") == {"negated": 3.0} and patterns("this is not right. idiot") == {"plain": 3.0}
    assert patterns("she said you are an idiot") == {"reported": 3.0} and patterns('he wrote "idiot" there') == {"reported": 3.0}
    assert patterns('"fine" idiot') == {"plain": 3.0}
    assert patterns("i will hurt you") == {"threat": 1.0} and patterns("they hurt") == {"threat": 1.0} and patterns("sun can hurt") == {}
    assert patterns("grumbling and grumb grumbles!") == {"plain": 4.0}  # beginnings, not the word itself


def test_composition_adds_marks():
    both = tx.compose(tx.negation(), tx.reported_speech())
    state, marks = both.states[0], []
    for k in (tx.NEGATION, tx.QUOTE, tx.INSULT, tx.QUOTE, tx.END, tx.INSULT):
        state, m = both.step[state, k]
        marks.append(m)
    assert marks == [0, 0, tx.NEGATED | tx.REPORTED, 0, 0, 0]


def test_learns_words_and_beginnings(spark):
    rng, rows, labels = random.Random(1), list(EDGES), []
    for k in range(400):
        words = prose(rng, 60).split()
        toxic = k % 4 == 0
        for _ in range(3 * toxic):
            words[rng.randrange(60)] = rng.choice(["blorg", "vrend" + rng.choice("abcdefgh") + rng.choice("xyz")])
        rows.append((100 + k, " ".join(words)))
        if k < 300:
            labels.append((100 + k, int(toxic)))
    docs = documents(spark, rows)
    model = tx.learn(docs, spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id long, toxic int"))
    assert "=blorg" in model.lexicon and "vrend" in model.lexicon and "=river" not in model.lexicon
    got = tx.score(with_clashes(docs), model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if (r["doc_id"] or 0) >= 400]
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held)


def test_nothing_to_learn(spark):
    docs = documents(spark, EDGES)
    model = tx.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model.lexicon == {} and tx.score(docs, model).where("score < 0.5").count() == len(EDGES)
    assert tx.score(docs.where(F.lit(False)), model).count() == 0


# --- brute force: the rules read off the text, without transducers -----------------------------------

MARKS = "\"“”„«».,!?;:…()[]|*$#%&<>"


def brute_kinds(text, lexicon):
    """(kind, weight) of each word, with quotation marks and clause ends beside it."""
    out = []
    for word in (text or "").lower().split():
        core = word.strip(MARKS)
        lead, tail = (word, "") if not core else (word[: word.index(core)], word[word.index(core) + len(core) :])
        out += [("quote", 0)] * any(c in tx.QUOTES for c in lead)
        weights = [w for e, w in lexicon.items() if e == "=" + core or (not e.startswith("=") and core.startswith(e) and len(core) > len(e))]
        classes = [k for k, ws in (("target", tx.TARGETS), ("threat", tx.THREATS), ("negation", tx.NEGATIONS), ("report", tx.REPORTING)) if core in ws]
        out.append(("insult", max(weights)) if weights and max(weights) > 0 else (classes[-1] if classes else "other", 1.0))
        out += [("quote", 0)] * any(c in tx.QUOTES for c in tail) + [("end", 0)] * any(c in tx.ENDS for c in tail)
    return out


def brute_features(text, lexicon):
    """Weights by pattern, from what stands around each hit in its clause."""
    s, sums = brute_kinds(text, lexicon), dict.fromkeys(tx.PATTERNS, 0.0)
    for k, (kind, weight) in enumerate(s):
        if kind not in ("insult", "threat"):
            continue
        first = max([j + 1 for j in range(k) if s[j][0] == "end"], default=0)
        last = min([j for j in range(k, len(s)) if s[j][0] == "end"], default=len(s))
        clause = s[first:last]
        aimed = any(x == "target" for x, _ in clause)
        quoted = sum(x == "quote" for x, _ in s[:k]) % 2 == 1
        # a reporting verb counts from where it stands, if not itself quoted, to the clause's end outside quotes
        said, inside, spoken = False, False, False
        for x, _ in s[:k]:
            if x == "quote":
                inside = not inside
                spoken = False
            elif not inside:
                spoken = False if x == "end" else spoken or x == "report"
        said = spoken
        words = [j for j in range(first, k) if s[j][0] != "quote"]
        negated = any(s[j][0] == "negation" for j in words[-tx.NEGATED_WORDS :])
        pattern = "reported" if quoted or said else "negated" if negated else ("threat" if aimed else None) if kind == "threat" else "targeted" if aimed else "plain"
        if pattern:
            sums[pattern] += weight
    n = max(1, len((text or "").split()))
    total = sum(sums.values())
    hits = any(k in ("insult", "threat") for k, _ in s)
    return [math.log1p(100 * sums[p] / n) for p in tx.PATTERNS] + [math.log1p(total)] if hits else [0.0] * 6


def babble(rng, n):
    classes = [tx.TARGETS, tx.THREATS, tx.NEGATIONS, tx.REPORTING, ["idiot", "grumbling", "grumb"], ["river", "and", "old", "..", "-"]]
    return " ".join(rng.choice(["", "", "", '"', "(", "“"]) + rng.choice(rng.choice(classes)) + rng.choice(["", "", "", "", ".", ",", '"', '."', ";", "”"]) for _ in range(n))


def test_features_against_brute_force():
    rng = random.Random(5)
    for _ in range(600):
        text = babble(rng, rng.randrange(0, 40))
        assert MODEL.features(text) == pytest.approx(brute_features(text, MODEL.lexicon)), text


def brute_lexicon(rows):
    """Entries over (label, text) rows whose log odds' lower bound is high."""
    total, seen = [sum(y == c for y, _ in rows) for c in (0, 1)], {}
    for y, text in rows:
        words = {w.strip(MARKS) for w in (text or "").lower().split()}
        for e in {"=" + w for w in words if w} | {w[:n] for w in words for n in range(3, 9) if len(w) > n}:
            seen.setdefault(e, [0, 0])[y] += 1
    out = {}
    for e, (c, t) in seen.items():
        bound = math.log((t + 0.5) / (total[1] + 1)) - math.log((c + 0.5) / (total[0] + 1)) - 2 * math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        if t >= 5 and bound >= 1:
            out[e] = bound
    return out


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_against_brute_force(spark):
    """The whole query: lexicon, fitted weights and scores, from the labels it may see."""
    from tidespan.llm.queries import op4_toxicity

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    marked = [(r["toxic"], docs[r["doc_id"]]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["toxic"] is not None and r["doc_id"] in docs and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    lexicon = brute_lexicon(marked)
    x, y = np.array([[*brute_features(t, lexicon), 1.0] for _, t in marked]), np.array([c for c, _ in marked])
    b = np.zeros(7)
    ridge = np.array([0.5] * 6 + [1e-3])
    for _ in range(200):  # Newton steps, as least squares
        p = 1 / (1 + np.exp(-x @ b))
        w = np.maximum(p * (1 - p), 1e-6)
        root = np.vstack([x * np.sqrt(w)[:, None], np.diag(np.sqrt(ridge))])
        b += np.linalg.lstsq(root, np.concatenate([(y - p) / np.sqrt(w), -np.sqrt(ridge) * b]), rcond=None)[0]
    got = op4_toxicity(spark, SF).collect()
    assert len(got) == len(docs) and lexicon
    for r in got:
        score = 1 / (1 + math.exp(-max(-30, min(30, b @ [*brute_features(docs[r["doc_id"]], lexicon), 1.0]))))
        assert r["score"] == pytest.approx(score, abs=1e-6) and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_very_long_text(spark):
    rng = random.Random(6)
    texts = [(1, prose(rng, 400_000)), (2, "you idiot " * 200_000), (3, "x" * 2_000_000)]
    got = {r["doc_id"]: r["score"] for r in tx.score(documents(spark, texts), MODEL).collect()}
    assert got[2] > 0.5 > got[1] and got[3] < 0.5
