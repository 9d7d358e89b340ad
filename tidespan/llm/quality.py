"""Quality rules (native): statistics per document and a learned, ordered decision list.

Sequential covering: a rule is a conjunction of thresholds on document statistics. It grows by
the condition of highest FOIL gain on the growing part of the labelled rows, is pruned back to
the prefix with the best ``(bad - good) / (bad + good)`` on the pruning part, and is kept if it
is precise there. Rows it covers go and the next rule grows on the rest. The list becomes one
``CASE WHEN`` column. Learning stops at the first rule that is not precise; a list has ``MAX_RULES``
rules at most, a rule ``MAX_CONDITIONS`` conditions, and thresholds lie between ``BINS`` quantiles of
each class, which bounds the model, not what it is learned from or applied to. Every step is a Spark aggregation over all labelled rows; the driver sees
only quantiles of each class and histograms of ``features x 2 BINS x 2`` counts.

Defined results: a null text counts as empty and has no words, so it fails the base rule; a text
without labels changes nothing; with no labelled rows, or only one class, the list is empty and
only the base rule rejects; a document labelled twice counts twice; equal gains go to the
feature first by name, then to the threshold that covers less; input columns other than id and text are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, word_array

WINDOW = 5
BINS = 24
MAX_RULES = 8
MAX_CONDITIONS = 3
#: A rule is kept if at least this share of what it covers in the pruning part is labelled bad.
MIN_PRECISION = 0.9
MIN_COVERED = 8

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("dup_line_share", "exclaim_share", "mean_word", "n_words_d", "repeat_share", "symbol_share", "upper_share", "words_per_line")


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text, the first included."""

    def hashes(w):
        at = lambda i: [w[i + k] for k in range(WINDOW)]
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*at(i)))

    def covered(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def repeated(s):
            same = lambda e, j: (j >= 0) & (j < F.size(s)) & (F.get(s, j)["h"] == e["h"])
            hit = F.filter(s, lambda e, i: F.coalesce(same(e, i - 1) | same(e, i + 1), F.lit(False)))
            return F.sort_array(F.transform(hit, lambda e: e["p"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
        step = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["to"])).alias("n"), (p + WINDOW).alias("to"))
        return F.aggregate(let(pairs, repeated), start, step, lambda a: a["n"])

    once = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(let(words, hashes), once)).cast("long")


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))).cast("long")


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """One row per input row: id, the base columns and the counts that the features use.

    with_row: also the input row as the struct ``__row``.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")] if with_row else []
    kept = ["__row"] if with_row else []
    text = F.coalesce(F.col("__text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    # one let() holds the words, so that they are split once for all counts
    counts = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w).alias("n_repeat_words"),
    )
    line_counts = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"), *row)
        .select(
            "doc_id",
            *kept,
            let(word_array(text), counts).alias("w"),
            let(lines, line_counts).alias("l"),
            _count(text, r"#*$%&|<>").alias("n_symbols"),
            _count(text, "A-Z").alias("n_upper"),
            _count(text, "!").alias("n_exclaim"),
        )
        .select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_upper", "n_exclaim", *kept)
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def feature_columns() -> dict[str, Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "exclaim_share": share("n_exclaim", "word_chars"),
        "mean_word": share("word_chars", "n_words"),
        "n_words_d": F.col("n_words").cast("double"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "words_per_line": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    """``feature > threshold`` or ``feature <= threshold``."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value, bound = feature_columns()[self.feature], F.lit(self.threshold)
        return value > bound if self.above else value <= bound

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that holds rejects, none: kept."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def rule(self) -> Column:
        """The number of the first rule that holds, from 1; 0 if none does."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            holds = _all(c.column() for c in rule)
            out = F.when(holds, F.lit(k)) if out is None else out.when(holds, F.lit(k))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))

    def __str__(self) -> str:
        lines = [f"WHEN {' AND '.join(map(str, r))} THEN reject" for r in self.rules]
        return "\n".join(["CASE", *lines, "ELSE keep END"])


def _all(columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def _gain(p0: float, n0: float, p1: float, n1: float) -> float:
    """FOIL gain of a condition that leaves p1 bad and n1 good rows of p0 and n0."""
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def _between(values: list[float]) -> list[float]:
    """Thresholds half-way between neighbouring values, so that they lie in gaps where there are any."""
    return [(a + b) / 2 for a, b in zip(values, values[1:])]


def _best(hist: dict, cuts: dict[str, list[float]], taken: list[Condition]) -> Condition | None:
    """The condition of highest gain; hist[feature][bin] is [good, bad]."""
    total = [sum(v[y] for v in next(iter(hist.values()), {}).values()) for y in (0, 1)]
    best, gain = None, 1e-9
    for f in sorted(hist):
        low = [0, 0]
        for k, cut in enumerate(cuts[f]):
            low = [low[y] + hist[f].get(k, (0, 0))[y] for y in (0, 1)]
            for above, (n, p) in ((False, low), (True, [total[y] - low[y] for y in (0, 1)])):
                c = Condition(f, above, cut)
                if c in taken or p < MIN_COVERED:
                    continue
                g = _gain(total[1], total[0], p, n)
                # of equal thresholds of a feature the one that covers less is taken
                if g > gain + 1e-9 or (best and above and best.feature == f and best.above and g > gain - 1e-9):
                    best, gain = c, g
    return best


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DecisionList:
    """Learn from rows of ``stats`` that ``labels`` marks 0 (bad) or 1 and that pass the base rule."""
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("__y")).where(F.col("__y").isin(0, 1))
    rows = (
        stats.where(~base_failed())
        .join(marked, "doc_id")
        .select((F.col("__y") == 0).cast("int").alias("bad"), (F.abs(F.hash("doc_id", F.lit(7))) % 3 == 0).alias("prune"), *(F.col(c) for c in stats.columns if c != "doc_id"))
    )
    rows = materialize(rows, "quality-labelled")
    features = feature_columns()
    grid = [k / BINS for k in range(BINS + 1)]  # with each class's least and greatest value
    quantiles = rows.groupBy("bad").agg(*[F.percentile_approx(c, grid, 10_000).alias(f) for f, c in features.items()]).collect()
    cuts = {f: _between(sorted({v for r in quantiles for v in r[f]})) for f in features}
    bin_of = lambda f: F.size(F.filter(F.lit(cuts[f] or [0.0]), lambda t: t < features[f]))
    binned = F.array(*[F.struct(F.lit(f).alias("f"), bin_of(f).alias("b")) for f in features])

    def histogram(where: Column) -> dict:
        out: dict = {f: {} for f in features}
        found = rows.where(where & ~F.col("prune")).select("bad", F.explode(binned).alias("x")).groupBy("x.f", "x.b").agg(F.sum(1 - F.col("bad")).alias("good"), F.sum("bad").alias("bad"))
        for r in found.collect():  # features x 2 BINS rows at most
            out[r["f"]][r["b"]] = (r["good"], r["bad"])
        return out

    rules: list[tuple[Condition, ...]] = []
    left = F.lit(True)
    while len(rules) < MAX_RULES:
        grown: list[Condition] = []
        while len(grown) < MAX_CONDITIONS and (c := _best(histogram(left & _all(x.column() for x in grown)), cuts, grown)):
            grown.append(c)
        if not grown:
            break
        prefix = [_all(x.column() for x in grown[: k + 1]) for k in range(len(grown))]
        seen = rows.where(left & F.col("prune")).agg(*[F.sum(F.when(p, v)).alias(f"{n}{k}") for k, p in enumerate(prefix) for n, v in (("bad", F.col("bad")), ("good", 1 - F.col("bad")))]).first()
        worth = [((b := seen[f"bad{k}"] or 0) - (g := seen[f"good{k}"] or 0)) / max(1, b + g) for k in range(len(grown))]
        k = max(range(len(grown)), key=lambda i: (worth[i], -i))
        bad, good = seen[f"bad{k}"] or 0, seen[f"good{k}"] or 0
        if bad < MIN_PRECISION * (bad + good) or not bad:
            break
        rules.append(tuple(grown[: k + 1]))
        left = left & ~_all(c.column() for c in rules[-1])
    return DecisionList(tuple(rules))


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """The statistics with base_failed, the number of the rule that fired, and kept."""
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", rules.rule()).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base columns, base_failed, kept, rule: one row for each row of ``docs``."""
    stats = materialize(document_stats(docs, id_col, text_col), "quality-stats")
    return judge(stats, learn(stats, labels, "doc_id")).select("doc_id", *BASE, "base_failed", "kept", "rule")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, that the rules keep."""
    stats = materialize(document_stats(docs, id_col, text_col, with_row=True), "quality-stats")
    return judge(stats, learn(stats.drop("__row"), labels, id_col)).where("kept").select("__row.*")


__all__ = ["Condition", "DecisionList", "document_stats", "judge", "keep_good", "learn", "quality_rules"]
