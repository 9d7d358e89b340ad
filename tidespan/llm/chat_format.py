"""Chat formatting at token level.

A turn becomes: start id, role's ids, separator id, content's ids, end id. Roles and contents are
encoded separately by the tokenizer and the control ids, which lie above its vocabulary, are
spliced in between; no text can produce them. Strings that look like control strings are escaped
all the same, so that the rendered text can be parsed as well: ``<``, any backslashes, ``|`` gets
one backslash more, and one less on the way back.

The loss mask marks the content tokens of assistant turns. It is the prefix sum of +1 at the
start and -1 at the end of each marked segment.

A conversation is one or more rows (parts) of at most ``PART_TURNS`` turns, so that a very long
one is neither a row nor a task of its own. Turn numbers come from a two-level prefix sum: counts
in blocks of turn values, then over blocks.

Defined results: null roles and texts are empty; turns are ordered by turn (null first), then
role, then text, and equal rows are all kept; a null conv_id is a conversation; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import encoder, load

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = (START, SEPARATOR, END)
TRAINED_ROLE = "assistant"
PART_TURNS = 128
#: Turn values that share a block of the first level.
BLOCK_TURNS = 128

_RAW = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _RAW.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _encoded(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        as_list = lambda ids: np.frombuffer(ids, "<i4")
        for b in batches:
            role = [escape(x) for x in b.column("role").to_pylist()]
            text = [escape(x) for x in b.column("text").to_pylist()]
            kinds = {r: as_list(i) for r, i in zip(dict.fromkeys(role), enc.encode_batch(list(dict.fromkeys(role))))}
            ids = [as_list(i) for i in enc.encode_batch(text)]
            ints = pa.list_(pa.int32())
            cols = [b.column(k) for k in ("conv_id", "turn", "role", "text")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([kinds[r] for r in role], ints), pa.array(ids, ints)], names=["conv_id", "turn", "role", "text", "role_ids", "text_ids"])

    return run


def _slices(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column of integers, as views of its values."""
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy().tolist()
    return [values[a:b] for a, b in zip(at, at[1:])]


def assemble(turns: list[tuple], base: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of turns (number, trained, role's ids, text's ids); control ids are base, base + 1, base + 2."""
    parts, marks, at = [], [], 0
    start, separator, end = (np.array([base + k], np.int32) for k in range(3))
    for _, trained, role, text in turns:
        parts += [start, role, separator, text, end]
        begin = at + 2 + len(role)
        if trained:
            marks.append((begin, begin + len(text)))
        at = begin + len(text) + 1
    step = np.zeros(at + 1, np.int64)
    for lo, hi in marks:
        step[lo] += 1
        step[hi] -= 1
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return ids, np.cumsum(step)[:at].astype(np.int8)


def _assembled(base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, mask, counts = [], [], []
            turns = b.column("turns")
            cells = turns.values
            rows = list(zip(cells.field("n").to_pylist(), cells.field("trained").to_pylist(), _slices(cells.field("role_ids")), _slices(cells.field("text_ids"))))
            at = turns.offsets.to_pylist()
            for lo, hi in zip(at, at[1:]):
                i, m = assemble(sorted(rows[lo:hi], key=lambda t: t[0]), base)
                ids.append(i)
                mask.append(m)
                counts.append(hi - lo)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("part"), pa.array(counts, pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(mask, pa.list_(pa.int8()))], names=["conv_id", "part", "n_turns", "ids", "loss_mask"])

    return run


def format_conversations(turns: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, part (from 0), n_turns, ids, loss_mask: a conversation's parts in order are its token sequence."""
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    coded = rows.mapInArrow(_encoded(tokenizer), "conv_id long, turn long, role string, text string, role_ids array<int>, text_ids array<int>")
    block = F.floor(F.col("turn") / BLOCK_TURNS)
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    coded = materialize(coded.withColumn("block", block).withColumn("k", F.row_number().over(inside)), "chat-turns")
    before = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = coded.groupBy("conv_id", "block").count().select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    placed = coded.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
    n = F.col("offset") + F.col("k") - 1
    placed = placed.select("conv_id", F.floor(n / PART_TURNS).alias("part"), F.struct(n.alias("n"), (F.col("role") == TRAINED_ROLE).alias("trained"), "role_ids", "text_ids").alias("t"))
    parts = placed.groupBy("conv_id", "part").agg(F.collect_list("t").alias("turns"))  # PART_TURNS at most
    return parts.mapInArrow(_assembled(load(tokenizer).get_vocab_size()), "conv_id long, part long, n_turns int, ids array<int>, loss_mask array<tinyint>")


def parse(ids: np.ndarray, mask: np.ndarray, tok) -> tuple[list[tuple[str, str]], list[str], int]:
    """From a part: its (role, text) turns, the texts under the loss mask, and the rendered characters."""
    base = tok.get_vocab_size()
    cut = np.flatnonzero(ids >= base)
    segments = [ids[a + 1 : b].tolist() for a, b in zip(cut[:-1], cut[1:]) if ids[a] != base + 2]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0]))))
    loss = [ids[a:b].tolist() for a, b in zip(edge[::2], edge[1::2])]
    text = tok.decode_batch(segments + loss, skip_special_tokens=False)
    said, trained = text[: len(segments)], text[len(segments) :]
    chars = sum(map(len, said)) + sum(len(CONTROLS[ids[c] - base]) for c in cut)
    plain = [unescape(t) for t in said]
    return list(zip(plain[::2], plain[1::2])), [unescape(t) for t in trained], chars


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, part, turns, loss_texts, chars of each part, from ids and mask alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(tokenizer)
        turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for b in batches:
            got = [parse(i, m, tok) for i, m in zip(_slices(b.column("ids")), _slices(b.column("loss_mask")))]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("part"), pa.array([[{"role": r, "text": t} for r, t in g[0]] for g in got], turn), pa.array([g[1] for g in got], pa.list_(pa.string())), pa.array([g[2] for g in got], pa.int64())], names=["conv_id", "part", "turns", "loss_texts", "chars"])

    return formatted.mapInArrow(run, "conv_id long, part long, turns array<struct<role:string,text:string>>, loss_texts array<string>, chars long")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation and part; only running digests are held."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now, n, chars, loss = None, 0, 0, 0

    def row():
        return {"conv_id": now[0], "n_turns": n, "turns_sha256": said.hexdigest(), "loss_chars": loss, "loss_sha256": trained.hexdigest(), "formatted_chars": chars}

    schema = pa.schema([(k, pa.string() if "sha" in k else pa.int64()) for k in names])
    for b in batches:
        out = []
        for r in b.to_pylist():
            if now != (r["conv_id"],):
                if now:
                    out.append(row())
                now, n, chars, loss, said, trained = (r["conv_id"],), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for t in r["turns"]:
                said.update(f"{t['role']}\n{t['text']}\n".encode())
            for t in r["loss_texts"]:
                trained.update(t.encode())
                loss += len(t)
            n += len(r["turns"])
            chars += r["chars"]
        yield pa.RecordBatch.from_pylist(out, schema)
    if now:
        yield pa.RecordBatch.from_pylist([row()], schema)


def digests(parts: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from ``read_back``.

    A digest reads its texts in order, so a conversation's parts stream through one task.
    """
    rows = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def oracle_sql(extra: list[tuple[int, int, str, str]]) -> str:
    """The digests of table ``conversations`` and of ``extra`` (conv_id, turn, role, text) rows, in DuckDB."""
    rows = "".join(f" UNION ALL SELECT {c}, {t}, '{r}', '{x}'" for c, t, r, x in extra)
    escaped = lambda c: rf"length(regexp_replace({c}, '<(\\*)\|', '<\\\1|', 'g'))"
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
               FROM (SELECT conv_id, turn, role, text FROM conversations{rows}))
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = '{TRAINED_ROLE}'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' {order}) FILTER (role = '{TRAINED_ROLE}'), '')) AS loss_sha256,
        CAST(sum({escaped("role")} + {escaped("text")} + {sum(map(len, CONTROLS))}) AS BIGINT) AS formatted_chars
    FROM t GROUP BY conv_id
    """
