"""Token counts with overlap resynchronisation.

A text of at most ``CHUNK`` characters is one chunk. A longer one is encoded in chunks that
overlap, each by a call of the library of its own, with offsets. Two neighbours are spliced where
their two encodings prove a boundary: a token that begins a piece in both (the tokenizer reports
the piece of each token), at the same offset and with the same id, followed by at least ``STABLE``
whole pieces that are equal in offsets, ids and piece starts. A token boundary inside a piece
proves nothing, since merges depend on the whole piece; such places are rejected however long the
tokens after them agree. Tokenizers cut pieces from left to right without memory, so from a piece
start that both share the right chunk goes on as the whole text would. Pieces at an artificial edge
may differ from the whole text's: the right chunk's first piece, the left chunk's last one, and
what lies within an added token's length of an edge never count as proof.

Where an overlap has no proven boundary (long runs without a break) it is widened fourfold, until it has
one or takes in all that is not counted yet; the chunk then grows as well, so that a run of n
characters is encoded a few times only, about as often as it has digits.

Memory is bounded by a chunk's encoding, or by the longest run without a boundary. Of an encoding
only the offsets and pieces about the overlap are read.

A quarter of the library's time goes into its normalizer, which keeps alignments for each character.
Where that is NFC, white space to one space and lower case, texts of characters that NFC leaves
alone side by side (``_OTHER`` names the ranges) are normalized by Python's ``re`` and ``lower``,
which give the same string there, and encoded by the same tokenizer without its normalizer. Texts
with any other character, or with an added token's string, go through the library's own.

Defined results: a null text counts as empty (0 bytes, 0 tokens); rows equal in id or text get a
row each; strings of special tokens inside texts count as the library's default has it; other
columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import load

CHUNK = 16_384
OVERLAP = 512
STABLE = 2
BATCH = 64

#: The normalizer whose result ``normalized`` gives.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
# Not Latin, Cyrillic, usual punctuation, kana, ideographs or Hangul syllables. Those within are starters that compose
# with nothing among them, and their lower case does not depend on what stands around them.
_OTHER = re.compile("[^\x00-\u02ff\u0400-\u0481\u2010-\u2027\u3001\u3002\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")
_SPACES = re.compile("[\t-\r \x85\xa0]{2,}|[\t-\r\x85\xa0]")  # all white space within, but for single spaces


@lru_cache(maxsize=4)
def unnormalized(path: str):
    """The tokenizer without its normalizer and the strings of its added tokens, if ``normalized`` can stand for it."""
    from tokenizers import Tokenizer

    made = json.loads(load(path).to_str())
    if made["normalizer"] != NORMALIZER or any(t["normalized"] for t in made["added_tokens"]):
        return None
    return Tokenizer.from_str(json.dumps(made | {"normalizer": None})), [t["content"] for t in made["added_tokens"]]


def normalized(text: str, added: list[str]) -> str | None:
    """What ``NORMALIZER`` makes of the text, or None where that is left to the library."""
    if not text.isascii() and _OTHER.search(text):
        return None
    out = _SPACES.sub(" ", text).lower()
    return None if any(a in text or a in out for a in added) else out


class Read:
    """A sequence whose items are read off an encoding as they are asked for."""

    def __init__(self, n: int, item: Callable):
        self.n, self.item = n, item

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, k: int):
        if k >= self.n:
            raise IndexError(k)
        return self.item(k)


class Chunk:
    """The encoding of text[start:end]: id, offsets in the whole text, and whether a piece begins, by token."""

    def __init__(self, tok, text: str, start: int, end: int):
        self.e = tok.encode(text[start:end], add_special_tokens=False)
        self.start, self.end, self.ids = start, end, self.e.ids
        self.at, self.begins = Read(len(self.ids), self._span), Read(len(self.ids), self._first)

    def _span(self, k: int) -> tuple[int, int]:
        a, b = self.e.token_to_chars(k)
        return self.start + a, self.start + b

    def _first(self, k: int) -> bool:
        return k == 0 or self.e.token_to_word(k) != self.e.token_to_word(k - 1)

    def opens(self, k: int) -> bool:
        """Whether a piece and its character begin with token k; one character may give several pieces."""
        return self.begins[k] and (k == 0 or self.at[k - 1][1] <= self.at[k][0])


def _margin(tok) -> int:
    """Characters at an artificial edge that a cut added token may spoil."""
    return max([len(t.content) for t in tok.get_added_tokens_decoder().values()], default=0)


def splice(left: Chunk, right: Chunk, stable: int = STABLE, margin: int = 0) -> tuple[int, int] | None:
    """Tokens (of left, of right) that begin at the first proven common boundary."""
    low, high = right.start + margin, left.end - margin
    last = next((k for k in reversed(range(len(left.ids))) if left.begins[k]), 0)  # the left chunk's last piece may be cut
    near = len(left.ids)
    while near and left.at[near - 1][0] > low:
        near -= 1
    place = {left.at[k][0]: k for k in range(near, len(left.ids)) if left.opens(k)}
    for j in range(1, len(right.ids)):
        if right.at[j][0] >= high:
            return None
        if right.at[j][0] <= low or not right.opens(j) or (i := place.get(right.at[j][0])) is None:
            continue
        pieces, k = 0, 0
        while pieces <= stable and i + k < last and j + k < len(right.ids) and left.at[i + k][1] <= high:
            if left.ids[i + k] != right.ids[j + k] or left.at[i + k] != right.at[j + k] or left.begins[i + k] != right.begins[j + k]:
                break
            pieces += left.begins[i + k]
            k += 1
        # the last piece that was begun counts only if it ends here, where both begin another
        ends = i + k == last and left.at[last][0] <= high and j + k < len(right.ids) and right.begins[j + k] and left.at[last][0] == right.at[j + k][0]
        if pieces > stable or (pieces == stable and ends):
            return i, j
    return None


def count_long(text: str, tok, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, chunk by chunk."""
    margin = _margin(tok)
    left, first, total = Chunk(tok, text, 0, min(chunk, len(text))), 0, 0
    while left.end < len(text):
        proven = left.at[first][0] if first else left.start
        # a run without a boundary makes the next chunk as long as itself, so that the work stays linear
        width, end = overlap, min(len(text), left.end + max(chunk, left.end - proven))
        while True:
            start = max(proven, left.end - width)
            right = Chunk(tok, text, start, end)
            if start == proven:  # it begins where the counted part ends and takes in all the rest
                first = 0
                break
            at = splice(left, right, margin=margin)
            if at and at[0] >= first:
                total += at[0] - first
                first = at[1]
                break
            width *= 4
        left = right
    return total + len(left.ids) - first


def counts(texts: list[str], tokenizer: str) -> list[int]:
    """Tokens of each text; those of one chunk are encoded in one call."""
    tok, (bare, added) = load(tokenizer), unnormalized(tokenizer) or (None, [])
    plain = [bare and normalized(t, added) for t in texts]
    work = [(tok, t) if p is None else (bare, p) for t, p in zip(texts, plain)]
    n = [count_long(t, by) if len(t) > CHUNK else 0 for by, t in work]
    for by in (tok, bare):
        short = [k for k, (b, t) in enumerate(work) if b is by and len(t) <= CHUNK]
        if short:
            for k, e in zip(short, by.encode_batch_fast([work[k][1] for k in short], add_special_tokens=False)):
                n[k] = len(e)
    return n


def _counts(tokenizer: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = counts(texts, tokenizer)
                size = pa.array([len(t.encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_counts(tokenizer, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
