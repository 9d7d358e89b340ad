"""SimHash near-dedup: fingerprints, and their components under small Hamming distance.

Fingerprints come from the XXH64 values of word shingles. Links between distinct fingerprints
are searched with a Gray-order hierarchical index, dealt out over the cluster:

1. Each fingerprint is stored once for each of ``DISTANCE + 1`` rotations that bring another
   block of its bits to the top. Two fingerprints that differ in at most ``DISTANCE`` bits agree
   in one block, so they meet below the top node of that block: the node's mask is the block,
   and all other top nodes are pruned without being read.
2. Below a top node, fingerprints lie in Gray order (neighbours there differ in few bits). Runs
   of ``FANOUT`` form leaves, runs of leaves form upper nodes; each node stores the bits its
   members share (mask and pattern). A query's differences from a node's pattern, added up on
   the way down, prune the whole node once they exceed the distance.
3. A top node with more than ``NODE_LIMIT`` members is not searched but made an upper node: its
   members are stored again below each of ``DISTANCE + 1`` shares of the bits that its mask leaves,
   rotated to follow the mask. Fingerprints of one node that differ in at most ``DISTANCE`` bits
   agree in one share, so they meet one level down, below a mask of more bits. That goes on until
   nodes are small; a mask that leaves ten bits has 1,024 members at most. Nodes that hold so many
   rows that one task would stand out are found by counts and go down without being dealt.

Each search writes a star per local component, never all pairs, and components of the whole are
found by alternating large-star and small-star steps on tables in the shared folder. Exact
copies are one fingerprint throughout.

Defined results: null and blank texts have fingerprint zero; texts with fewer words than a
shingle have their whole sequence as the only one; rows that repeat an id get one result row
each; a component whose ids are all null has a null component_id; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, join_spread, materialize

BITS, DISTANCE, SHINGLE, SEED = 64, 2, 3, 42
BLOCKS = DISTANCE + 1
FANOUT = 16
#: Members of a node that are searched at once; larger nodes get a level more. At least 2 ** 10.
NODE_LIMIT = 1024
#: Rows of the index that are searched at once, so that a task's memory is bounded.
CHUNK = 32_768
#: Hashes whose bits are counted at once.
COUNTED = 1 << 15


def _bit_sums(h: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits (from the highest) is set in ``h``."""
    out = np.zeros(BITS, np.int64)
    for k in range(0, len(h), COUNTED):
        bits = np.unpackbits(h[k : k + COUNTED].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        out += bits.sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a whole text."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    grams = zip(*(words[k:] for k in range(SHINGLE))) if len(words) >= SHINGLE else [words]
    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams), np.uint64)
    return int.from_bytes(np.packbits(2 * _bit_sums(h) > len(h)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(fp.view(np.int64))], names=["doc_id", "h", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (hash of the text) and fp (the fingerprint's 64 bits as a signed long) of every row."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(_fingerprints, "doc_id long, h long, fp long")


# --- the index below a top node -----------------------------------------------------------------


def _levels(codes: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From leaves to roots: (first row or child, mask, pattern) of each node; bounds: where top nodes begin."""
    out = []
    ones, zeros, starts = codes, ~codes, bounds
    while True:
        # within each top node, a new node begins every FANOUT children
        sizes = np.diff(np.append(starts, len(ones)))
        counts = -(-sizes // FANOUT)
        first = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])) * FANOUT, counts) + np.arange(counts.sum()) * FANOUT
        ones, zeros = np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first)
        out.append((first, ones | zeros, ones))
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        if (counts == 1).all():
            return out


def _pairs(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows a < b of one top node whose codes differ in at most DISTANCE bits."""
    levels = _levels(codes, bounds)
    query, node = np.arange(len(codes)), np.repeat(np.arange(len(bounds)), np.diff(np.append(bounds, len(codes))))
    for k in range(len(levels) - 1, -1, -1):
        first, mask, pattern = levels[k]
        near = np.bitwise_count((codes[query] ^ pattern[node]) & mask[node]) <= DISTANCE
        query, node = query[near], node[near]
        below = len(levels[k - 1][0]) if k else len(codes)
        # a node's children end where the next node's begin
        n = (np.append(first, below)[node + 1] - first[node]).astype(np.int64)
        at = np.repeat(np.cumsum(n) - n, n)
        child = np.repeat(first[node], n) + np.arange(n.sum()) - at
        query, node = np.repeat(query, n), child
        if k:  # only pairs with the later row are wanted: nodes that end at or before the query go
            last = np.append(levels[k - 1][0], len(codes) if k == 1 else len(levels[k - 2][0]))[1:]
            for j in range(k - 2, -1, -1):
                last = np.append(levels[j][0], len(codes) if j == 0 else len(levels[j - 1][0]))[last]
            later = last[node] > query
            query, node = query[later], node[later]
    hit = (node > query) & (np.bitwise_count(codes[query] ^ codes[node]) <= DISTANCE)
    return query[hit], node[hit]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each row's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _search(chunk: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (fingerprint, smallest fingerprint) of the local components; rows lie by top node and Gray rank."""
    bounds = np.flatnonzero(np.append(True, top[1:] != top[:-1]))
    a, b = _pairs(chunk.view(np.uint64), bounds)
    root = _roots(len(chunk), a, b)
    rows = np.flatnonzero(root != np.arange(len(chunk)))
    return chunk[rows], chunk[root[rows]]


def _index_links(last: bool):
    """Rows (fp, code, node, path) come sorted by (node, rank): links of small nodes, members (fp, code, path) of others.

    last: all nodes are searched, since their masks leave too few bits for more members.
    """
    limit = 1 << 62 if last else NODE_LIMIT
    link, member = np.int64(0), np.int64(1)

    def row(a, b, kind, path):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), kind)), pa.array(path)], names=["a", "b", "kind", "path"])

    def out(fp, code, node, path) -> Iterator[pa.RecordBatch]:
        """Whole nodes."""
        start = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(node)))
        crowded = np.repeat(size > limit, size)
        yield row(fp[crowded], code[crowded], member, path[crowded])
        fp, node = fp[~crowded], node[~crowded]
        for lo, hi in _slices(node):
            a, b = _search(fp[lo:hi], node[lo:hi])
            yield row(a, b, link, np.zeros(len(a), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, passing = [], 0, None

        def take(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n, passing
            rows = [np.concatenate(c) for c in zip(*held)]
            if passing is not None:  # the rest of a node whose first members went down already
                more = rows[2] == passing
                yield row(rows[0][more], rows[1][more], member, rows[3][more])
                rows = [c[~more] for c in rows]
            t = rows[2]
            edges = np.flatnonzero(t[1:] != t[:-1])
            cut = len(t) if final else int(edges[-1]) + 1 if len(edges) else 0  # the last node may go on
            yield from out(*[c[:cut] for c in rows])
            rows = [c[cut:] for c in rows]
            if len(rows[0]) > limit:
                passing = int(rows[2][0])
                yield row(rows[0], rows[1], member, rows[3])
                rows = [c[:0] for c in rows]
            held, n = [rows], len(rows[0])

        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)])
            n += batch.num_rows
            if n >= CHUNK:
                yield from take(False)
        if held:
            yield from take(True)

    return run


def _slices(top: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut rows at top nodes so that a slice has at most 4 million pairs in its nodes, or one node."""
    if not len(top):
        return
    starts = np.flatnonzero(np.append(True, top[1:] != top[:-1]))
    ends = np.append(starts[1:], len(top))
    lo, cost = 0, 0
    for s, e in zip(starts.tolist(), ends.tolist()):
        if cost and cost + (e - s) ** 2 > 4_000_000:
            yield lo, s
            lo, cost = s, 0
        cost += (e - s) ** 2
    yield lo, len(top)


def _shares(code, depth: int):
    """The code's bits after the first ``depth``, rotated so that each share of them comes first once."""
    rest, width = BITS - depth, (BITS - depth) // BLOCKS
    low = F.lit((1 << rest) - 1 if depth else -1).cast("long")
    out = []
    for r in range(BLOCKS):
        turned = code
        if r:
            tail = code.bitwiseAND(low)
            turned = F.shiftleft(tail, r * width).bitwiseOR(F.shiftrightunsigned(tail, rest - r * width)).bitwiseAND(low)
            turned = turned.bitwiseOR(code.bitwiseAND(F.bitwise_not(low)))
        out.append(turned)
    return out, depth + width


def _gray_rank(code):
    for k in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, k))
    return code


def links(distinct: DataFrame) -> DataFrame:
    """Stars (a, b) over distinct ``fp`` whose components are those of distance at most DISTANCE."""
    level, depth, found = distinct.select("fp", F.col("fp").alias("code"), F.lit(1).cast("long").alias("path")), 0, None
    while True:
        shares, depth = _shares(F.col("code"), depth)
        last = 1 << (BITS - depth) <= 1024
        # a node: the shares that were chosen so far, and the bits of these
        entry = F.array(*[F.struct(s.alias("code"), (F.col("path") * BLOCKS + r).alias("path")) for r, s in enumerate(shares)])
        index = level.select("fp", F.explode(entry).alias("e")).select("fp", "e.code", "e.path")
        index = index.withColumn("node", F.xxhash64("path", F.shiftrightunsigned("code", BITS - depth)))
        hot = None if last else hot_keys(index.groupBy("node").agg(F.count("*").alias("n")), "node")
        cold = index if hot is None else index.join(hot, "node", "left_anti")
        rank = _gray_rank(F.col("code")).bitwiseXOR(F.lit(-(2**63)).cast("long"))  # moved to sort as signed longs
        dealt = cold.withColumn("rank", rank).repartition("node").sortWithinPartitions("node", "rank").select("fp", "code", "node", "path")
        searched = materialize(dealt.mapInArrow(_index_links(last), "a long, b long, kind long, path long"), "simhash-links")
        near = searched.where("kind = 0").select("a", "b")
        found = near if found is None else found.unionByName(near)
        level = searched.where("kind = 1").select(F.col("a").alias("fp"), F.col("b").alias("code"), "path")
        if hot is not None:
            level = level.unionByName(index.join(hot, "node", "left_semi").select("fp", "code", "path"))
        if last or not level.limit(1).count():
            return found.distinct()


def components(edges: DataFrame, name: str = "simhash") -> DataFrame:
    """(a, root): the smallest node of the component of each node that has an edge.

    Alternates large-star (each node's larger neighbours go to its smallest neighbour) and
    small-star (the smaller ones do), until nothing changes; each round is a table in the
    shared folder. The hub of a large star is joined over salts.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
        large = join_spread(both, least.select("a", "m"), "a", least.select("a", "n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, f"{name}-stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_spread(large, least.select("a", "m"), "a", least.select("a", "n"))
        moved = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(moved.unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
        state = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if state == before:
            return edges.select("a", F.col("b").alias("root"))
        before = state


def _roots_of(prints: DataFrame) -> DataFrame:
    """fp, root, low, n: each fingerprint's component, the smallest id that has the fingerprint, and its rows."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "simhash-nodes")
    root = components(links(nodes.select("fp")))
    return materialize(nodes.join(root, nodes["fp"] == root["a"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "low", "n"), "simhash-roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable) of every row."""
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash-fingerprints")
    member = _roots_of(prints)
    low = member.groupBy("root").agg(F.min("low").alias("component_id"))
    size = member.groupBy("root").agg(F.count("*").alias("n"))
    group = join_spread(member.select("fp", "root"), low, "root", size).select("fp", "component_id")
    hex_print = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return join_spread(prints, group, "fp", member.select("fp", "n")).select("doc_id", hex_print, "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with its columns: the one of smallest id (null last), then smallest hash of the row's text.

    Components are told apart by their root fingerprint, so rows that repeat an id or have none
    count like all others; equal rows leave one.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash-fingerprints")
    key = [F.col("doc_id").isNull().alias("__none"), F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("h").alias("__h")]
    least = prints.groupBy("fp").agg(F.min(F.struct(*key)).alias("k"))
    keep = least.join(_roots_of(prints).select("fp", "root"), "fp").groupBy("root").agg(F.min("k").alias("k")).select("k.*")
    keep = materialize(keep, "simhash-kept")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    i = F.col(id_col).cast("long")
    rows = docs.select(whole, i.isNull().alias("__none"), F.coalesce(i, F.lit(0)).alias("__id"), F.xxhash64(F.col(text_col)).alias("__h"))
    # one shuffle of whole rows: the aggregation and the join share their partitioning
    names = ["__none", "__id", "__h"]
    return rows.groupBy(*names).agg(F.first("__row").alias("__row")).join(keep, names, "left_semi").select("__row.*")
