"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insults with a learned weight, threats, targets, negations, reporting verbs,
quotation marks, clause ends, other words. Small transducers rewrite the stream, composed
into one machine: negation marks what stands in its scope, reported speech marks what is quoted or
said by others, target marks what shares a clause with a person spoken to; a threat counts only
with a target. Each clause with a match then adds its weights to the pattern it matched (plain,
targeted, threat, negated, reported). A logistic model gives the score, from each pattern's
weight per hundred words of the text and from the whole weight; so how much a negation or a
quotation excuses is learned and not assumed.

The insult lexicon is learned from labelled rows: words and word beginnings (``STEM`` letters)
whose log odds of standing in a toxic document are high by a lower confidence bound. Beginnings
catch inflected and compound forms that were never seen. Learning uses at most ``SAMPLE`` labelled
rows of each class, the first by a hash of the id; scoring reads every row and whole texts.

Defined results: null and empty texts get the model's base rate; with no labelled rows the given
word lists alone and fixed weights are used; a document labelled toxic and clean counts for both;
rows equal in id get a row each; columns other than id and text are not read for scoring.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Labelled rows of each class that the model is learned from.
SAMPLE = 4_000
STEM = range(3, 9)
#: Standard errors below the log odds, and the bound's least value for an entry.
DOUBT, LEAST = 2.0, 1.0
MEMO = 300_000
NEGATED_WORDS = 3

# Closed word classes in the languages served.
TARGETS = "you your yours yourself u ur he she they him her them his their du dich dir dein deine ihr euch euer eure sie tu te toi ton ta vous votre vos tú ti tus usted ustedes vosotros".split()
THREATS = "kill hurt destroy murder beat stab shoot burn hang crush töten umbringen verletzen schlagen zerstören tuer frapper détruire brûler matar golpear destruir quemar".split()
NEGATIONS = "not no never nobody none neither nor isn't aren't wasn't don't doesn't nicht kein keine nie niemals pas jamais aucun nunca jamás ningún".split()
REPORTING = "said says say wrote writes called calls claimed claims stated reported quoted sagte sagt schrieb nannte dit disait écrit appelle dijo dice escribió llamó".split()
QUOTES = "\"“”„«»"
ENDS = ".!?;:…"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END = range(8)
NEGATED, REPORTED, TARGETED = 8, 16, 32
PATTERNS = ("plain", "targeted", "threat", "negated", "reported")


@dataclass(frozen=True)
class Transducer:
    """step[state][symbol kind] is (next state, marks added to the symbol)."""

    states: tuple
    step: dict = field(hash=False)

    def __post_init__(self):
        assert all((s, k) in self.step for s in self.states for k in range(8))


def negation() -> Transducer:
    step = {}
    for left in range(NEGATED_WORDS + 1):
        for k in range(8):
            after = NEGATED_WORDS if k == NEGATION else 0 if k == END else max(0, left - (k != QUOTE))
            step[left, k] = (after, NEGATED if left and k in (INSULT, THREAT) else 0)
    return Transducer(tuple(range(NEGATED_WORDS + 1)), step)


def reported_speech() -> Transducer:
    """States: own speech, after a reporting verb (to the clause's end), inside quotation marks."""
    step = {}
    for s in ("own", "said", "quoted"):
        for k in range(8):
            after = s
            if k == QUOTE:
                after = "own" if s == "quoted" else "quoted"
            elif s != "quoted":
                after = "own" if k == END else "said" if k == REPORT else s
            step[s, k] = (after, REPORTED if s != "own" and k in (INSULT, THREAT) else 0)
    return Transducer(("own", "said", "quoted"), step)


def target() -> Transducer:
    """Marks what follows a target in its clause; the clause's end tells of one that came last."""
    step = {(s, k): ("named" if k == TARGET or (s == "named" and k != END) else "none", TARGETED if s == "named" and k in (INSULT, THREAT, END) else 0) for s in ("none", "named") for k in range(8)}
    return Transducer(("none", "named"), step)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Both read the same kinds; marks add up."""
    states = tuple((a, b) for a in first.states for b in second.states)
    step = {}
    for a, b in states:
        for k in range(8):
            (na, ma), (nb, mb) = first.step[a, k], second.step[b, k]
            step[(a, b), k] = ((na, nb), ma | mb)
    return Transducer(states, step)


GRAMMAR = compose(compose(negation(), reported_speech()), target())


def clause_scores(symbols: list[tuple[int, float]]) -> list[float]:
    """Weights by pattern, added over all clauses of (kind, weight)."""
    out, state, clause = [0.0] * len(PATTERNS), GRAMMAR.states[0], []
    for kind, weight in [*symbols, (END, 0.0)]:
        state, marks = GRAMMAR.step[state, kind]
        if kind in (INSULT, THREAT):
            clause.append((kind, marks, weight))
        elif kind == END:
            for k, m, w in clause:
                aimed = (m | marks) & TARGETED
                if m & REPORTED:
                    p = 4
                elif m & NEGATED:
                    p = 3
                elif k == THREAT:
                    p = 2 if aimed else None  # a threat needs someone it is made to
                else:
                    p = 1 if aimed else 0
                if p is not None:
                    out[p] += w
            clause = []
    return out


def _core(word: str) -> str:
    return word.strip("\"“”„«».,!?;:…()[]|*$#%&<>")


@dataclass
class Model:
    """Entries of the insult lexicon ('=word' or 'stem'), and the weights of the patterns."""

    lexicon: dict[str, float]
    weights: tuple[float, ...] = (1.0, 1.2, 1.2, 0.4, 0.4, 0.5)
    bias: float = -4.0

    def __post_init__(self):
        self.memo: dict[str, tuple] = {}
        self.closed = {w: (k, 1.0) for k, ws in ((TARGET, TARGETS), (THREAT, THREATS), (NEGATION, NEGATIONS), (REPORT, REPORTING)) for w in ws}

    def symbols(self, word: str) -> tuple:
        """The symbols of a lower-case word, with its quotation marks and clause end."""
        core, out = _core(word), []
        lead = word[: len(word) - len(word.lstrip("\"“”„«».,!?;:…()[]|*$#%&<>"))]
        out += [(QUOTE, 0.0)] * any(c in QUOTES for c in lead)
        weight = max([self.lexicon.get("=" + core, 0.0), *(self.lexicon.get(core[:n], 0.0) for n in STEM if len(core) > n)])
        out.append((INSULT, weight) if weight > 0 else self.closed.get(core, (OTHER, 0.0)))
        tail = word[len(lead) + len(core) :]
        out += [(QUOTE, 0.0)] * any(c in QUOTES for c in tail) + [(END, 0.0)] * any(c in ENDS for c in tail)
        return tuple(out)

    def features(self, text: str | None) -> list[float]:
        words = (text or "").lower().split()
        for w in {w for w in words if w not in self.memo}:
            self.memo[w] = self.symbols(w)
        found = [self.memo[w] for w in words]
        if len(self.memo) > MEMO:
            self.memo = {}
        if not any(k in (INSULT, THREAT) for s in found for k, _ in s):
            return [0.0] * (len(PATTERNS) + 1)
        weight = clause_scores([y for s in found for y in s])
        return [math.log1p(100 * x / len(words)) for x in weight] + [math.log1p(sum(weight))]

    def score(self, features: list[float]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + sum(w * x for w, x in zip(self.weights, features))))))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and clean documents of each batch hold each word and word beginning."""
    for b in batches:
        found = Counter()
        for y, text in zip(b.column("y").to_pylist(), b.column("text").to_pylist()):
            words = {_core(w) for w in (text or "").lower().split()}
            found.update((e, y) for e in {"=" + w for w in words if w} | {w[:n] for w in words for n in STEM if len(w) > n})
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([found[k] * (k[1] == 1) for k in keys], pa.int64()), pa.array([found[k] * (k[1] == 0) for k in keys], pa.int64())], names=["entry", "toxic", "clean"])


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b, ridge = np.zeros(x.shape[1]), np.diag([0.5] * (x.shape[1] - 1) + [1e-3])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge @ b
        b = b - np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge, grad)
    return b


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from ``labels`` (id, label): at most ``sample`` rows of each class."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    n = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    code = F.xxhash64("id", F.lit(11))
    picked = marked.where("y = 1").orderBy(code, "id").limit(sample).unionByName(marked.where("y = 0").orderBy(code, "id").limit(sample))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(picked), F.col("doc") == F.col("id")).select("y", "text")
    rows = materialize(rows, "toxic-sample")  # 2 * sample rows
    total = {y: min(sample, n.get(y, 0)) for y in (0, 1)}
    if not total[1]:
        return Model({})
    counts = rows.mapInArrow(_entries, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (total[1] + 1)) - F.log((F.col("c") + 0.5) / (total[0] + 1))
    bound = odds - DOUBT * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    # entries of the sample only, so their number has a bound
    lexicon = {r["entry"]: r["w"] for r in counts.where("t >= 5").select("entry", bound.alias("w")).where(F.col("w") >= LEAST).collect()}
    model = Model(lexicon)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [model.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(f, pa.list_(pa.float64()))], names=["y", "f"])

    got = rows.select(F.col("y").cast("int").alias("y"), "text").mapInArrow(features, "y int, f array<double>").collect()  # 2 * sample rows
    if len({r["y"] for r in got}) == 2:
        y = np.array([r["y"] for r in got], float)
        # each class counts as often as it is labelled
        share = {c: n[c] / max(1, (y == c).sum()) for c in (0, 1)}
        w = np.where(y == 1, share[1], share[0])
        b = _fit(np.array([r["f"] for r in got]), y, w / w.mean())
        model.weights, model.bias = tuple(b[:-1].tolist()), float(b[-1])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and the weights of the five patterns per hundred words (log1p) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [model.features(t) for t in b.column(1).to_pylist()]
            patterns = np.array(f, float).reshape(len(f), len(PATTERNS) + 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(x) for x in f], pa.float64()), *(pa.array(patterns[:, k]) for k in range(len(PATTERNS)))], names=["doc_id", "score", *PATTERNS])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, " + ", ".join(f"{p} double" for p in PATTERNS))
