"""Tokenizer access for tasks: a tokenizer per worker, and encoding with memoised units.

``UnitEncoder`` encodes each distinct unit once. It serves byte-level tokenizers without a
normalizer, whose pieces are letters, digits or other visible characters with at most one space
before them, or white space alone. Such a piece never reaches over a space or line break that
stands between two visible characters, nor from a letter or digit to punctuation after it, so a
text cut there falls into units whose encodings do not depend on each other. The tokenizer's own
definition is checked for this; any other tokenizer encodes whole texts. The table of units is
kept in two generations of bounded size.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel ones

#: Units kept in each of the two generations.
GENERATION = 400_000
#: Characters of joined unknown units that the library gets at once.
BATCH_CHARS = 4_000
#: Punctuation that is cut from a unit's end if a letter or digit stands before it.
TAIL = ".,;:!?*$#%&\""

# Single visible spaces and line breaks are the usual case; all else takes the slower cut.
_OTHER_SPACE = re.compile(r"[^\S \n]")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer's file is; only its path is a parameter of the operators."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=4)
def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def independent_units(tok) -> bool:
    """Whether units, as ``units`` cuts them, are encoded independently: by what the tokenizer is made of."""
    made = json.loads(tok.to_str())
    cut, added = made["pre_tokenizer"] or {}, made["added_tokens"]
    by_bytes = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
    plain = not any(set(" \n") & set(a["content"]) or a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added)
    return bool(by_bytes and plain and made["normalizer"] is None and made["model"]["type"] == "BPE" and not made["model"].get("dropout"))


def units(text: str) -> list[str]:
    """The text cut before each space or line break that has a visible character on either side.

    A unit that begins with a line break keeps it; all others but the first follow a space that
    is left out.
    """
    odd = "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1].isspace() or text[-1:].isspace() or _OTHER_SPACE.search(text)
    if not odd:
        return text.replace("\n", " \n").split(" ")
    first, *rest = _CUT.split(text)
    return [first, *(u[1:] if u[0] == " " else u for u in rest)]


class UnitEncoder:
    """Token ids of whole texts, as the library gives them, as little-endian 32-bit integers."""

    def __init__(self, path: str):
        self.tok = load(path)
        self.by_units = independent_units(self.tok)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, u: str) -> bytes | None:
        got = self.new.get(u)
        if got is None and (got := self.old.get(u)) is not None:
            self.new[u] = got
        return got

    def _learn(self, unknown: list[str]) -> None:
        """Encode units, many in one string; offsets tell whose tokens are whose."""
        base = {}
        for u in unknown:
            b = u.rstrip(TAIL)
            base[u] = b if b and b[-1].isascii() and b[-1].isalnum() else u
        fresh = sorted({b for b in base.values() if self._find(b) is None})
        groups, size = [[]] if fresh else [], 0
        for u in fresh:
            if size > BATCH_CHARS:
                groups.append([])
                size = 0
            groups[-1].append(u if u[0] == "\n" else " " + u)
            size += len(u) + 1
        for g, e in zip(groups, self.tok.encode_batch(["".join(g) for g in groups], add_special_tokens=False)):
            # a token belongs to the unit in which its last character lies
            ends = np.array([b for _, b in e.offsets], np.int64)
            cuts = np.searchsorted(ends, np.cumsum([len(u) for u in g]), side="right").tolist()
            raw, start = np.array(e.ids, "<u4").tobytes(), 0
            for u, c in zip(g, cuts):
                self.new[u if u[0] == "\n" else u[1:]] = raw[4 * start : 4 * c]
                start = c
        for u, b in base.items():
            if b is not u and b != u:
                tail = u[len(b) :]
                if tail not in self.tails:
                    self.tails[tail] = self._plain([tail])[0]
                self.new[u] = self.new[b] + self.tails[tail]

    def _encode(self, cut: list[list[str]]) -> list[list[bytes]]:
        """For each text, given as its units, the ids of each unit."""
        get, found, gaps, unknown = self.new.get, [], [], set()
        for u in cut:
            got = list(map(get, u))
            gap = [k for k, g in enumerate(got) if g is None or not k]
            found.append(got)
            gaps.append(gap)
            for k in gap[1:]:
                if self._find(u[k]) is None:
                    unknown.add(u[k])
        self._learn(sorted(unknown))
        heads = self._plain([u[0] for u in cut])
        for u, got, gap, head in zip(cut, found, gaps, heads):
            for k in gap:
                got[k] = self.new[u[k]] if k else head
        if len(self.new) > GENERATION:
            self.old, self.new = self.new, {}
        if len(self.tails) > GENERATION:
            self.tails = {}
        return found

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, four bytes each."""
        if not self.by_units:
            return self._plain(texts)
        return [b"".join(got) for got in self._encode([units(t) for t in texts])]


@lru_cache(maxsize=4)
def encoder(path: str) -> UnitEncoder:
    """One encoder for each worker process and tokenizer."""
    return UnitEncoder(path)
