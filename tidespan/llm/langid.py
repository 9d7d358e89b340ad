"""Language identification by cross-parsing entropy.

A suffix automaton is built for each language from labelled text. A text is parsed against it:
each phrase is the longest match of what follows with a substring of the labelled text. A phrase
takes as many bits as it needs to name a place in the labelled text, so the language of fewest
phrases times log2 of its labelled symbols, for each symbol of the text, wins.

Texts become symbols (small letters; anything else is one space) and are parsed whole, from the
first symbol to the last. To parse many symbols in one step, all pieces of ``PIECE`` symbols are
first parsed side by side as if a phrase began with each; then the state that each piece ends in is
carried into the next one, until both parses begin a phrase at the same symbol. From there on they
are the same. A piece that has no such symbol hands its own state on, and the next is parsed again.
So the count is that of one parse without a break, and a text costs the same per symbol at any
length. One step is a look-up in the automaton's table, or, for large alphabets, among its edges.

The automata hold whole labelled texts: of each language the documents with a letter that come
first by a hash of the id, ``TRAIN_DOCS`` at most, until they hold ``TRAIN_CHARS`` characters; texts
longer than that are taken only where there are no others, the shortest first. All their letters
are in the alphabet. Every text is parsed whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text
if no language was learned; equal values go to the language first by code point; rows equal in id
get a row each; columns other than id and text are not read for a prediction. The score is the
winner's share of 2 to the power of minus the bits for a symbol.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_lookup

TRAIN_DOCS, TRAIN_CHARS = 256, 100_000
PIECE = 128
#: Entries of an automaton's table; a larger one is searched among its edges instead.
DENSE = 1 << 24
#: Symbols that are parsed at once, a multiple of PIECE.
CHUNK = 1 << 21
UNKNOWN = "und"

# symbols: 0 space, 1 any letter that no labelled text has, then the alphabet; PAD fills the last piece
SPACE, RARE, FIRST = 0, 1, 2


@lru_cache(maxsize=1)
def _plain() -> np.ndarray:
    """For each code point: 1 if it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], np.uint8)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def alphabet(texts: list[str]) -> str:
    return "".join(sorted({c for t in texts for c in t.lower() if c.isalpha()}))


def lookup(letters: str) -> np.ndarray:
    table = np.where(_plain() == 1, RARE, SPACE).astype(np.int32)
    for k, c in enumerate(letters):
        table[ord(c)] = FIRST + k
    return table


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """The text's symbols, with one space for each run of other characters."""
    s = table[_codes(text)]
    keep = s != SPACE
    keep[1:] |= s[:-1] != SPACE
    return s[keep]


class SuffixAutomaton:
    """All substrings of a sequence of symbols; built online, state 0 is the empty string."""

    def __init__(self, sequence: list[int]):
        nxt, link, length, last = [{}], [-1], [0], 0
        for c in sequence:
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.next = nxt

    def stepper(self, width: int):
        """A function of (state * width, symbol) that gives 2 * (next state * width) + (a phrase begins).

        A phrase begins at the empty state, and where a state has no such symbol; a symbol that
        occurs nowhere is a phrase alone. The last symbol is PAD: nothing begins. Above DENSE
        entries the edges are searched instead of a table.
        """
        root = self.next[0]
        fresh = np.array([2 * root.get(c, 0) * width + 1 for c in range(width - 1)] + [0], np.int64)
        edges = [(s * width + c, 2 * t * width) for s, e in enumerate(self.next) if s for c, t in e.items() if c < width - 1]
        key, to = np.array(edges, np.int64).reshape(-1, 2).T
        if len(self.next) * width <= DENSE:
            table = np.tile(fresh, len(self.next))
            table[key] = to
            table = table.astype(np.int32)
            return lambda state, symbol: table[state + symbol]
        order = np.argsort(key)
        key, to = key[order], to[order]

        def step(state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
            k = state.astype(np.int64) + symbol
            at = np.minimum(np.searchsorted(key, k), max(0, len(key) - 1))
            return np.where(key[at] == k, to[at], fresh[symbol]) if len(key) else fresh[symbol]

        return step


@lru_cache(maxsize=2)
def _tables(training: tuple[tuple[str, tuple[str, ...]], ...]):
    """(letters' table, PAD, step and bits of a phrase by language) for (language, texts); once for each worker."""
    letters = alphabet([t for _, ts in training for t in ts])
    table, width = lookup(letters), FIRST + len(letters) + 1
    steps, bits = [], []
    for _, texts in training:
        sequence: list[int] = []
        for t in texts:
            sequence += symbols(t, table).tolist() + [width]  # a symbol no text has
        steps.append(SuffixAutomaton(sequence).stepper(width))
        bits.append(np.log2(len(sequence) + 1))
    return table, width - 1, steps, np.array(bits)


def _parse(columns: np.ndarray, follows: np.ndarray, start: np.ndarray, step) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that begin in each piece, and the state after it.

    columns[k] has the k-th symbol of every piece; follows: whether a piece goes on with the text of
    the one before it; start: the state in which the others begin.
    """
    state, begins = np.where(follows, 0, start), np.zeros(columns.shape, bool)
    for k, symbol in enumerate(columns):
        v = step(state, symbol)
        begins[k], state = v & 1, v >> 1
    rest = np.cumsum(begins[::-1], axis=0, dtype=np.int16)[::-1]  # phrases that begin from each symbol on
    count, final, guess = rest[0].astype(np.int64), state.copy(), state
    used = np.zeros_like(final)  # the state that each piece was parsed from
    while True:
        todo = np.flatnonzero(follows[1:] & (used[1:] != final[:-1])) + 1
        if not len(todo):
            return count, final
        used[todo] = final[todo - 1]
        state, n = used[todo], np.zeros(len(todo), np.int64)
        for k in range(len(columns)):
            v = step(state, columns[k][todo])
            new = (v & 1).astype(bool)
            met = new & begins[k][todo]
            if met.any():
                count[todo[met]], final[todo[met]] = n[met] + rest[k][todo[met]], guess[todo[met]]
                todo, v, n, new = todo[~met], v[~met], n[~met], new[~met]
                if not len(todo):
                    break
            n, state = n + new, v >> 1
        else:
            count[todo], final[todo] = n, state


def phrase_counts(texts: list[str], training) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each text (row) in each language (column), and its symbols."""
    table, pad, steps, _ = _tables(training)
    out, size = np.zeros((len(texts), len(steps)), np.int64), np.zeros(len(texts), np.int64)
    parts, total = [], 0  # (text, its symbols from there, whether they go on with the part before)

    def parse(before: list) -> list:
        """Parse the parts; ``before``: the states after the last part, where it goes on."""
        grids, row, follows = [], [], []
        for k, s, on in parts:
            n = -(-len(s) // PIECE)
            grid = np.full(n * PIECE, pad, np.int32)
            grid[: len(s)] = s
            grids.append(grid)
            row.append(np.full(n, k))
            follows.append(np.arange(n) > 0)
        columns = np.ascontiguousarray(np.concatenate(grids).reshape(-1, PIECE).T)
        row, follows, states = np.concatenate(row), np.concatenate(follows), []
        for j, step in enumerate(steps):
            start = np.zeros(len(row), np.int64)
            start[0] = before[j] if parts[0][2] else 0
            count, final = _parse(columns, follows, start, step)
            out[:, j] += np.bincount(row, count, len(texts)).astype(np.int64)
            states.append(int(final[-1]))
        return states

    states = [0] * len(steps)
    for k, t in enumerate(texts):
        s = symbols(t, table)
        size[k] = len(s)
        for at in range(0, len(s), CHUNK):
            part = s[at : at + CHUNK]
            if parts and total + len(part) > CHUNK:
                states = parse(states)
                parts, total = [], 0
            parts.append((k, part, at > 0))
            total += len(part)
    if parts:
        parse(states)
    return out, size


def decide(counts: np.ndarray, size: np.ndarray, bits: np.ndarray, languages: list[str]) -> tuple[list[str], np.ndarray]:
    """The language of fewest bits for a symbol, and its share of 2 ** -bits."""
    cost = counts * bits / np.maximum(size, 1)[:, None]
    best = cost.argmin(axis=1)
    return [languages[b] for b in best], 1 / np.exp2(cost.min(axis=1, keepdims=True) - cost).sum(axis=1)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> tuple:
    """((language, texts), ...) by code point, from the rows of ``docs`` whose language is given."""
    size = F.length(text_col)
    rows = docs.where(F.col(text_col).rlike(r"\p{L}") & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("l"), F.xxhash64(text_col).alias("t"), F.when(size > train_chars, size).otherwise(0).alias("over"), size.alias("n"))
    # of a large language only rows of a low hash are dealt to its window, about eight times as many as can be taken
    rows = join_lookup(rows.withColumn("h", F.xxhash64("id", F.lit(5))), rows.groupBy("l").agg(F.count("*").alias("rows")), "l")
    rows = rows.where(F.col("h") / 2.0**64 + 0.5 <= 8.0 * train_docs / F.col("rows"))
    order = Window.partitionBy("l").orderBy("over", "h", "id", "t")
    first = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= train_docs).drop("k")  # train_docs rows a language
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.withColumn("before", before).withColumn("k", F.row_number().over(order)).where(F.col("before") < train_chars).select("id", "l", "t", "k").distinct()
    mine = (F.col(id_col).cast("long") == F.col("id")) & (F.col(lang_col) == F.col("l")) & (F.xxhash64(text_col) == F.col("t"))
    got = docs.join(F.broadcast(first), mine).select("l", "k", F.col(text_col).alias("text")).distinct().collect()
    by: dict[str, dict] = {}
    for r in got:
        if has_letter(r["text"]):
            by.setdefault(r["l"], {})[r["k"]] = r["text"]
    return tuple((lang, tuple(by[lang][k] for k in sorted(by[lang]))) for lang in sorted(by))


def identify(docs: DataFrame, training: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    languages = [lang for lang, _ in training]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            todo = [k for k, t in enumerate(texts) if languages and has_letter(t)]
            if todo:
                counts, size = phrase_counts([texts[k] for k in todo], training)
                names, score[todo] = decide(counts, size, _tables(training)[3], languages)
                for k, name in zip(todo, names):
                    lang[k] = name
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
