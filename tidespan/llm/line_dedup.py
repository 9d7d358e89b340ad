"""Line dedup by winnowing over line hashes.

A document is its sequence of lines with words. Lines of more than ``CUT`` words are cut into units
of at most ``2 * CUT`` words inside, at places that only the words around them decide: of each ``CUT``
neighbouring places the one of least hash (the last of equals), sentence ends before all others.
Any other line is one unit; a unit's hash is that of its words. Equal passages are cut alike
except within ``CUT`` places of their ends, wherever in a line they lie.

For each unit a window runs from it to the first unit at which it holds ``min_words`` words, and
another one back from it. Of each window the unit of least hash (the last of equals) is selected:
these minima are the fingerprints. Two equal runs of whole units with ``min_words`` words hold equal
windows, which select equal units, so every such repeat is guaranteed to share a fingerprint. A
repeated passage of n words inside lines holds at least ``n - 4 * CUT + 2`` words of equal whole units.

Fingerprints found at two places or more are joined: of the windows that selected them, each
content's first place in the corpus (by id, then by place in the document) is the source, and the
units of every later place go, with the white space after them. Since windows run both ways from
every unit, a match goes on unit by unit to both sides as long as the next unit's window repeats
too, in whichever document; so the deleted units are exactly those of all repeated runs of
``min_words`` words or more that come later. A deleted unit always equals a unit that comes
earlier, so one copy of everything stays. Contents are compared by 96 bits over their words.

Whole lines of fewer than ``min_words`` words go by an exact count: those that ``frequent`` documents
or more have go from all places but the first.

Work is in blocks of documents, stored once in the shared folder (units and text) and read again
by place. Blocks deal their distinct fingerprints, then their distinct contents, to buckets by
hash; a bucket answers each block with a bit or a byte for each. So neither texts nor units are
shuffled, no pairs are formed, nothing is broadcast, and a fingerprint that all documents have
weighs one entry a block.

Defined results: null texts stay null and have no lines; lines without words are never deleted nor
counted in runs; a line goes as a line if all its units do, else the rest of it stays as it was
written; rows equal in id and text get the same result, none of them counts as a later place of
another, and each counts for the frequency of its lines; null ids come first; documents of fewer
than ``min_words`` words have no windows and lose frequent lines only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path

MIN_WORDS = 9
#: Documents from which on a shorter line goes.
FREQUENT = 10
#: Neighbouring places inside a line of which one is cut.
CUT = 11
ENDS = np.isin(np.arange(256), list(b".!?"))
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: Bytes of text in a block (a longer document is a block of its own).
BLOCK_BYTES = 2_000_000
#: Entries of a bucket, on average.
BUCKET = 1 << 20
#: Bytes whose prefix sums are held at once; longer words than LONG are hashed one by one.
SEGMENT, LONG = 1 << 20, 32
#: Odd multipliers of the polynomial hashes, by use.
BYTES, WORDS, CHECKS = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
NO_ID = -(2**63)


# --- hashes ---------------------------------------------------------------------------------------


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(values: np.ndarray, first: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[first..last] for each pair, from prefix sums."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _powers(base, len(values)), dtype=np.uint64)))
    return _mix((sums[last + 1] - sums[first]) * _powers(pow(base, -1, 1 << 64), len(values))[first] + (last - first).astype(np.uint64))


def _word_hashes(data: bytes, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, k = np.zeros(len(starts), np.uint64), 0
    while k < len(starts):
        n = max(k + 1, int(np.searchsorted(ends, starts[k] + SEGMENT, "right")))
        if ends[n - 1] - starts[k] <= SEGMENT:
            at = starts[k]
            out[k:n] = _runs(buf[at : ends[n - 1]].astype(np.uint64) + np.uint64(1), starts[k:n] - at, ends[k:n] - 1 - at, BYTES)
        k = n
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]])
    return out


# --- units ----------------------------------------------------------------------------------------


@dataclass
class Words:
    """The words of several texts, as offsets into their bytes joined by line breaks."""

    data: bytes
    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    line: np.ndarray  # of each word, numbered through all texts
    doc: np.ndarray
    doc_line: np.ndarray  # first line of each text


def split_words(parts: list[bytes]) -> Words:
    data = b"\n".join(parts)
    buf = np.frombuffer(data, np.uint8)
    seen = np.concatenate(([False], ~SPACE[buf], [False]))
    starts, ends = np.flatnonzero(seen[1:] & ~seen[:-1]), np.flatnonzero(seen[:-1] & ~seen[1:])
    breaks = np.flatnonzero(buf == 10)
    begin = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts[:-1]]))).astype(np.int64) if parts else np.zeros(0, np.int64)
    return Words(data, buf, starts, ends, np.searchsorted(breaks, starts), np.searchsorted(begin, starts, "right") - 1, np.searchsorted(breaks, begin))


def _cut_before(w: Words, h: np.ndarray) -> np.ndarray:
    """Whether a unit begins with each word: a line does, or one of CUT neighbouring places is least there."""
    n = len(h)
    inside = np.zeros(n, bool)  # a place between a word and the next one of its line
    inside[:-1] = w.line[:-1] == w.line[1:]
    rank = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    rank[:-1] = _mix(h[:-1] * np.uint64(WORDS) + h[1:]) >> np.uint64(1)
    rank |= (~ENDS[w.buf[w.ends - 1]]).astype(np.uint64) << np.uint64(63)
    reach = np.ones(n, np.int64)  # how many neighbouring places it is least of
    for side in (-1, 1):
        alive = inside.copy()
        for d in range(1, CUT):
            if d >= n:
                break
            here, there = (slice(d, None), slice(None, -d)) if side < 0 else (slice(None, -d), slice(d, None))
            least = rank[there] >= rank[here] if side < 0 else rank[there] > rank[here]
            near = np.zeros(n, bool)
            near[here] = alive[here] & inside[there] & least
            alive = near
            reach += alive
    out = np.ones(n, bool)
    out[1:] = ~inside[:-1] | (reach[:-1] >= CUT)
    return out


@dataclass
class Units:
    """The units of several texts, in order."""

    code: np.ndarray  # uint64
    check: np.ndarray  # uint32
    size: np.ndarray  # words
    doc: np.ndarray
    line: np.ndarray  # of each unit, numbered through all texts

    def short_lines(self, min_words: int) -> np.ndarray:
        """Units that are whole lines of fewer than min_words words."""
        alone = np.ones(len(self.line), bool)
        alone[1:] &= self.line[1:] != self.line[:-1]
        alone[:-1] &= self.line[1:] != self.line[:-1]
        return np.flatnonzero(alone & (self.size < min_words))


def units(w: Words) -> Units:
    if not len(w.starts):
        none = np.zeros(0, np.int64)
        return Units(none.astype(np.uint64), none.astype(np.uint32), none, none, none)
    h = _word_hashes(w.data, w.buf, w.starts, w.ends)
    first = np.flatnonzero(_cut_before(w, h))
    last = np.append(first[1:], len(h)) - 1
    check = _runs(_mix(h ^ np.uint64(CHECKS)), first, last, CHECKS) >> np.uint64(32)
    return Units(_runs(_mix(h), first, last, WORDS), check.astype(np.uint32), last - first + 1, w.doc[first], w.line[first])


def cuts(words: list[bytes]) -> list[int]:
    """Where a line of these words is cut: numbers of words before each cut, with 0 and all."""
    return [0, *np.cumsum(units(split_words([b" ".join(words)])).size).tolist()]


def read_lines(text: str) -> tuple[list[int], list[int], list[int]]:
    """Of the units of the lines with words: place of the line among all lines, hash, number of words."""
    u = units(split_words([text.encode()]))
    return u.line.tolist(), u.code.tolist(), u.size.tolist()


def _windows(u: Units, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First, last and selected unit of every window, by first unit."""
    n = len(u.code)
    after = np.cumsum(u.size)
    before = after - u.size
    i = np.arange(n)
    j = np.searchsorted(after, before + min_words)
    good = (j < n) & (u.doc[np.minimum(j, n - 1)] == u.doc) if n else np.zeros(0, bool)
    back = np.searchsorted(before, after - min_words, "right") - 1
    again = (back >= 0) & (u.doc[np.maximum(back, 0)] == u.doc) if n else np.zeros(0, bool)
    again &= j[np.maximum(back, 0)] != i if n else again  # forward, it is there already
    first, last = np.concatenate((i[good], back[again])), np.concatenate((j[good], i[again]))
    order = np.argsort(first, kind="stable")
    first, last = first[order], last[order]
    pick = first.copy()
    for d in range(1, min_words):  # a window has no more units than words
        k = np.minimum(first + d, last)
        pick = np.where(u.code[k] <= u.code[pick], k, pick)
    return first, last, pick


def windows(code: list[int], size: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """(first unit, last unit, selected unit) of every window of one text."""
    u = Units(np.array(code, np.uint64), np.zeros(len(code), np.uint32), np.array(size, np.int64), np.zeros(len(code), np.int64), np.arange(len(code)))
    return list(zip(*(x.tolist() for x in _windows(u, min_words))))


# --- blocks in the shared folder ------------------------------------------------------------------


def _dk(id_col: str, text_col: str) -> Column:
    """One key for rows equal in id and text."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**62))), F.col(text_col))


def _pack(rows: list[tuple], out) -> tuple[int, int]:
    """Write a block of (id, dk, text) rows to ``out``; returns its number of units and of bytes."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, rows[k][1]))
    docs = list(dict.fromkeys((rows[k][0], rows[k][1]) for k in order))  # rows equal in id and text are one
    place = {d: k for k, d in enumerate(docs)}
    text = {place[r[0], r[1]]: r[2] for r in rows}
    u = units(split_words([(text[k] or "").encode() for k in range(len(docs))]))
    table = lambda **columns: pa.table({k: pa.array(v) for k, v in columns.items()})
    tables = [
        table(code=u.code, check=u.check, size=u.size.astype(np.uint16), doc=u.doc.astype(np.int32), line=u.line.astype(np.int32)),
        pa.table({"id": pa.array([i for i, _ in docs], pa.int64()), "dk": pa.array([k for _, k in docs], pa.int64()), "text": pa.array([text[k] for k in range(len(docs))], pa.large_string())}),
        table(row=np.array([place[r[0], r[1]] for r in rows], np.int32)),
    ]
    size = 0
    for t in tables:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(t)
        data = sink.getvalue()
        out.write(len(data).to_bytes(8, "little"))
        out.write(data)
        size += 8 + len(data)
    return len(u.code), size


def _write_blocks(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = fs.FileSystem.from_uri(folder)
        name, out, done, found = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", None, 0, []

        def block(rows):
            nonlocal out, done
            out = out or system.open_output_stream(f"{at}/{name}", compression=None)
            n, size = _pack(rows, out)
            found.append((uuid.uuid4().int >> 65, f"{folder}/{name}", done, size, n))
            done += size

        for b in batches:
            rows, size = [], 0
            for r in zip(*(b.column(k).to_pylist() for k in range(3))):
                if rows and size + len(r[2] or "") > BLOCK_BYTES:
                    block(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[2] or "")
            if rows:
                block(rows)
        if out:
            out.close()
            cols = list(zip(*found))
            yield pa.RecordBatch.from_pydict({k: pa.array(c, pa.string() if k == "file" else pa.int64()) for k, c in zip(("block", "file", "at", "length", "n_units"), cols)})

    return run


@dataclass
class Block:
    units: Units
    ids: pa.Array
    dk: np.ndarray
    text: pa.Array
    row: np.ndarray  # the document of each row


def _read_block(r: dict, with_text: bool = False) -> Block:
    system, at = fs.FileSystem.from_uri(r["file"])
    with system.open_input_file(at) as f:
        f.seek(r["at"])
        data, tables, k = f.read(r["length"]), [], 0
    while k < len(data):
        n = int.from_bytes(data[k : k + 8], "little")
        tables.append(pa.ipc.open_stream(data[k + 8 : k + 8 + n]).read_all() if with_text or len(tables) < 2 else None)
        k += 8 + n
    u, docs, rows = tables
    column = lambda t, c: t.column(c).to_numpy()
    wide = lambda c: column(u, c).astype(np.int64)
    return Block(Units(column(u, "code"), column(u, "check"), wide("size"), wide("doc"), wide("line")), docs.column("id"), column(docs, "dk"), docs.column("text"), column(rows, "row") if with_text else np.zeros(0))


# --- fingerprints and contents --------------------------------------------------------------------


def _slices(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys: a bucket has the keys of equal upper bits."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edge = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if a < b:
            yield int(bucket[a]), a, b


def _fingerprints(u: Units, min_words: int):
    """The windows, the distinct fingerprints they select (sorted), and whether each has two places here."""
    first, last, pick = _windows(u, min_words)
    f, n = np.unique(u.code[np.unique(pick)], return_counts=True)
    return first, last, pick, f, n > 1


def _deal_fingerprints(min_words: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                *_, f, _ = _fingerprints(_read_block(r).units, min_words)
                part = (f >> np.uint64(max(0, 32 - bits))).astype(np.uint32)  # the bits after the bucket's
                rows = [(k, r["block"], part[lo:hi].tobytes()) for k, lo, hi in _slices(f, bits)]
                yield _batch(rows, {"bucket": pa.int64(), "block": pa.int64(), "data": pa.binary()})

    return run


def _batch(rows: list[tuple], schema: dict) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.values())], names=list(schema))


def _answers(table: pa.Table, size: int, answer) -> pa.Table:
    """For each row of a bucket the answer to its entries; rows without any are left out."""
    data = table.column("data").to_pylist()
    n = [len(d) // size for d in data]
    found, rows, at = answer(data), [], 0
    for block, bucket, k in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), n):
        part = found[at : at + k]
        at += k
        if part.any():
            rows.append((block, bucket, (np.packbits(part) if part.dtype == bool else part).tobytes()))
    return pa.Table.from_batches([_batch(rows, {"block": pa.int64(), "bucket": pa.int64(), "data": pa.binary()})])


def _shared(table: pa.Table) -> pa.Table:
    """Which fingerprints of a bucket two blocks or more have."""

    def answer(data: list[bytes]) -> np.ndarray:
        f = np.frombuffer(b"".join(data), np.uint32)
        order = np.argsort(f, kind="stable")
        s = f[order]
        same = s[1:] == s[:-1]
        out = np.zeros(len(f), bool)
        out[order] = np.append(same, False) | np.insert(same, 0, False)
        return out

    return _answers(table, 4, answer)


#: What a block says of a content: hash, 32 bits more, first document (id, upper half of dk), number of documents.
ENTRY = np.dtype([("key", "<u8"), ("check", "<u4"), ("id", "<i8"), ("tie", "<i4"), ("n", "<u4")])
ELSEWHERE, OFTEN = 1, 2


def _contents(block: Block, r: dict, min_words: int, bits: int):
    """Windows of shared fingerprints and short lines, as entries.

    Returns (first, last, key) of the windows, (unit, key) of the short lines, and the distinct entries by key.
    """
    u = block.units
    first, last, pick, f, twice = _fingerprints(u, min_words)
    shared = twice | _said(r["shared"], f, bits, bool)
    hit = shared[np.searchsorted(f, u.code[pick])] if len(f) else np.zeros(0, bool)
    first, last = first[hit], last[hit]
    short = u.short_lines(min_words)
    one = np.uint64(1)
    key = np.concatenate((_runs(u.code, first, last, WORDS) & ~one, _mix(u.code[short]) | one)) if len(u.code) else np.zeros(0, np.uint64)
    check = np.concatenate((_runs(u.check.astype(np.uint64) + one, first, last, CHECKS) >> np.uint64(32), u.check[short])) if len(u.code) else key
    at = np.concatenate((first, short))
    keys, where, back = np.unique(key, return_index=True, return_inverse=True)  # units lie in order of places
    out = np.zeros(len(keys), ENTRY)
    doc = u.doc[at[where]] if len(keys) else np.zeros(0, np.int64)
    ids = block.ids.fill_null(NO_ID).to_numpy()
    out["key"], out["check"], out["id"], out["tie"] = keys, check[where], ids[doc], block.dk[doc] >> 32
    pair = np.unique(np.stack((back, u.doc[at])), axis=1)[0] if len(keys) else back
    out["n"] = np.bincount(pair, minlength=len(keys))
    return first, last, short, key, keys, back, where, out


def _said(answers: list[dict] | None, keys: np.ndarray, bits: int, kind) -> np.ndarray:
    """The buckets' answers for sorted distinct keys."""
    out = np.zeros(len(keys), kind)
    by = {a["bucket"]: a["data"] for a in answers or []}
    for bucket, lo, hi in _slices(keys, bits):
        if (data := by.get(bucket)) is not None:
            raw = np.frombuffer(data, np.uint8)
            out[lo:hi] = np.unpackbits(raw, count=hi - lo) if kind is bool else raw
    return out


def _deal_contents(min_words: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                *_, keys, _, _, entries = _contents(_read_block(r), r, min_words, bits)
                rows = [(k, r["block"], entries[lo:hi].tobytes()) for k, lo, hi in _slices(keys, bits)]
                yield _batch(rows, {"bucket": pa.int64(), "block": pa.int64(), "data": pa.binary()})

    return run


def _places(frequent: int):
    """Of each entry: whether its content is first in another document, and whether enough documents have it."""

    def answer(data: list[bytes]) -> np.ndarray:
        e = np.frombuffer(b"".join(data), ENTRY)
        order = np.lexsort((e["tie"], e["id"], e["check"], e["key"]))
        s = e[order]
        new = np.append(True, (s["key"][1:] != s["key"][:-1]) | (s["check"][1:] != s["check"][:-1]))
        group = np.cumsum(new) - 1
        head = np.flatnonzero(new)[group]
        later = (s["id"] != s["id"][head]) | (s["tie"] != s["tie"][head])
        often = np.bincount(group, s["n"])[group] >= frequent
        out = np.zeros(len(e), np.uint8)
        out[order] = later * ELSEWHERE + (often & (s["key"] & np.uint64(1) == 1)) * OFTEN
        return out

    return lambda table: _answers(table, ENTRY.itemsize, answer)


def _gone(block: Block, r: dict, min_words: int, bits: int, content_bits: int) -> np.ndarray:
    """Whether each unit goes."""
    first, last, short, _, keys, back, where, _ = _contents(block, r, min_words, bits)
    said = _said(r["places"], keys, content_bits, np.uint8)[back]
    later = (said & ELSEWHERE > 0) | (where[back] != np.arange(len(back)))
    n = len(first)
    step = np.zeros(len(block.units.code) + 1, np.int64)
    np.add.at(step, first[later[:n]], 1)
    np.add.at(step, last[later[:n]] + 1, -1)
    gone = np.cumsum(step)[:-1] > 0
    gone[short[later[n:] & (said[n:] & OFTEN > 0)]] = True
    return gone


def without(text: bytes, starts: list[int], lines: list[int], gone: list[bool]) -> tuple[int, bytes]:
    """Number of lines that go, and what is left of a text.

    starts: where each unit's first word begins in the text; lines: its line in the text.
    """
    parts, out, n, at, k = text.split(b"\n"), [], 0, 0, 0
    for number, part in enumerate(parts):
        m = k
        while m < len(lines) and lines[m] == number:
            m += 1
        if not any(gone[k:m]):
            out.append(part)
        elif all(gone[k:m]):
            n += 1
        else:  # a unit goes to where the next one's first word begins
            edge = [0, *(s - at for s in starts[k + 1 : m]), len(part)]
            out.append(b"".join(part[edge[x] : edge[x + 1]] for x in range(m - k) if not gone[k + x]))
        at += len(part) + 1
        k = m
    return n, b"\n".join(out)


def _deleted(min_words: int, bits: int, content_bits: int):
    names = {"doc_id": pa.int64(), "n_lines": pa.int64(), "n_removed": pa.int64(), "n_removed_words": pa.int64(), "text": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                block = _read_block(r, with_text=True)
                u, gone = block.units, _gone(block, r, min_words, bits, content_bits)
                texts, ids = block.text.to_pylist(), block.ids.to_pylist()
                words = np.bincount(u.doc, gone * u.size, len(texts)).astype(np.int64).tolist()
                edge = np.searchsorted(u.doc, np.arange(len(texts) + 1)).tolist()
                rows = []
                for d, text in enumerate(texts):
                    removed, left = 0, text
                    if words[d]:
                        part, mine = text.encode(), slice(edge[d], edge[d + 1])
                        w = split_words([part])
                        starts = w.starts[np.cumsum(u.size[mine]) - u.size[mine]]
                        removed, left = without(part, starts.tolist(), np.searchsorted(np.flatnonzero(w.buf == 10), starts).tolist(), gone[mine].tolist())
                        left = left.decode()
                    rows.append((ids[d], 0 if text is None else text.count("\n") + 1, removed, words[d], left))
                for k in range(0, len(block.row), 2_000):
                    yield _batch([rows[d] for d in block.row[k : k + 2_000].tolist()], names)

    return run


# --- the operator ---------------------------------------------------------------------------------


def _bits(entries: int) -> int:
    """Upper bits of a hash that number the buckets."""
    return min(32, max(5, (max(1, entries) // BUCKET).bit_length() + 1))


def _ask(dealt: DataFrame, answer, blocks: DataFrame, name: str) -> DataFrame:
    """The blocks with the buckets' answers, as a column of structs."""
    spark = blocks.sparkSession
    said = dealt.groupBy("bucket").applyInArrow(answer, "block long, bucket long, data binary")
    said = said.groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias(name))  # no more than the block's entries
    out = materialize(blocks.join(said.hint("merge"), "block", "left"), f"line-{name}")
    return out.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_lines, n_removed (whole lines), n_removed_words (also of parts) and the text that is left, for each row."""
    spark = docs.sparkSession
    folder = new_path(spark, "line-blocks")
    system, at = fs.FileSystem.from_uri(folder)
    system.create_dir(at, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _dk(id_col, text_col).alias("dk"), F.col(text_col).alias("text"))
    blocks = materialize(rows.mapInArrow(_write_blocks(folder), "block long, file string, at long, length long, n_units long"), "line-blocks")
    bits = content_bits = _bits(blocks.agg(F.sum("n_units")).first()[0] or 0)
    deal = "bucket long, block long, data binary"
    spread = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block")
    blocks = _ask(spread.mapInArrow(_deal_fingerprints(min_words, bits), deal), _shared, blocks, "shared")
    blocks = _ask(blocks.mapInArrow(_deal_contents(min_words, bits), deal), _places(frequent), blocks, "places")
    return blocks.mapInArrow(_deleted(min_words, bits, content_bits), "doc_id long, n_lines long, n_removed long, n_removed_words long, text string")
