"""Token-ID output: files of independent zstandard frames with a trailing seek table.

A shard holds whole documents, in ascending order of id, as little-endian 32-bit token ids:

* frames: each is a zstandard frame of its own with a content checksum, and holds whole documents
  up to ``FRAME_BYTES`` (a longer document has a frame to itself);
* a skippable frame with the document index: id, frame, offset and token count of each document;
* a skippable frame with the seek table, in the layout of the public zstandard seekable format:
  compressed size, plain size and checksum (low half of XXH64) for each frame, then a footer.

A reader fetches the tail, then only the frames that hold the documents asked for. Tasks write
shards under names of their own attempt; the manifest, a Parquet table, names those that count,
so lost executors and repeated tasks leave no wrong shard behind. Shards go through pyarrow's
file systems to the folder that all executors share.

Defined results: a null text has no ids but the end id; a null id sorts first; rows equal in id
are ordered by their text's hash and all kept; an empty table has no shards; other columns are
not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, new_path
from .tokens import encoder

FRAME_BYTES = 1 << 18
LEVEL = 3
#: Texts that are encoded at once.
BATCH = 256

# Fixed values of the public zstandard formats.
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC, HAS_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80


def _open(path: str):
    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """Writes one shard; documents must come in order."""

    def __init__(self, stream):
        self.out, self.frames, self.docs, self.buffer, self.size = stream, [], [], [], 0
        self.zip = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > FRAME_BYTES:
            self._frame()
        self.docs.append((doc_id or 0, doc_id is None, len(self.frames), self.size, len(ids) // 4))
        self.buffer.append(ids)
        self.size += len(ids)

    def _frame(self) -> None:
        plain = b"".join(self.buffer)
        packed = self.zip.compress(plain)
        self.out.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.buffer, self.size = [], 0

    def close(self) -> None:
        if self.buffer:
            self._frame()
        index = self.zip.compress(np.array(self.docs, "<i8").reshape(-1, 5).T.tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index) + 4) + index + struct.pack("<I", len(index)))
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(self.frames), HAS_CHECKSUMS, FOOTER_MAGIC))
        self.out.close()


class ShardReader:
    """Reads documents of one shard by place; fetches and checks only the frames asked for."""

    def __init__(self, file):
        self.file, size = file, file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError("not a token shard")
        table = size - 9 - 12 * n
        self.frames = np.frombuffer(self._at(table, 12 * n), "<u4").reshape(n, 3)
        self.starts = np.concatenate(([0], np.cumsum(self.frames[:, 0], dtype=np.int64)))
        (length,) = struct.unpack("<I", self._at(table - 8 - 4, 4))
        index = zstandard.ZstdDecompressor().decompress(self._at(table - 12 - length, length))
        self.ids, self.null, self.frame, self.offset, self.count = np.frombuffer(index, "<i8").reshape(5, -1)
        self.unzip, self.held = zstandard.ZstdDecompressor(), (-1, b"")

    def _at(self, where: int, n: int) -> bytes:
        self.file.seek(where)
        return self.file.read(n)

    def __len__(self) -> int:
        return len(self.ids)

    def plain(self, k: int) -> bytes:
        """Frame k, checked against the seek table."""
        if self.held[0] != k:
            packed, size, check = self.frames[k].tolist()
            data = self.unzip.decompress(self._at(int(self.starts[k]), packed))
            if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} is damaged")
            self.held = (k, data)
        return self.held[1]

    def document(self, i: int) -> tuple[int | None, bytes]:
        """Id and token ids of the i-th document."""
        at = int(self.offset[i])
        return None if self.null[i] else int(self.ids[i]), self.plain(int(self.frame[i]))[at : at + 4 * int(self.count[i])]


def _write_shards(folder: str, tokenizer: str, end_id: int):
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer, total = TaskContext.get().partitionId(), None, 0
        system, at = _open(folder)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.tok.zst"
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                if writer is None:
                    writer = ShardWriter(system.open_output_stream(f"{at}/{name}", compression=None))
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder(tokenizer).encode_batch([t or "" for t in part.column(1).to_pylist()])):
                    writer.add(doc_id, ids + end)
                    total += len(ids) // 4 + 1
        if writer is not None:
            writer.close()
            known = [d[0] for d in writer.docs if not d[1]]
            ends = {"min_id": known[0] if known else None, "max_id": known[-1] if known else None}
            row = {"shard": shard, "file": f"{folder}/{name}", "n_docs": len(writer.docs), "n_tokens": total} | ends
            yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.string() if k == "file" else pa.int64()) for k, v in row.items()})

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards below ``folder`` (a URI all executors share); returns the manifest.

    The manifest has shard (in order of ids), file, n_docs, n_tokens, and its least and greatest id (min_id, max_id).
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-shards")
    system, at = _open(folder)
    system.create_dir(at, recursive=True)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    order = ["doc_id", "h"]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return materialize(rows.mapInArrow(_write_shards(folder, tokenizer, end_id), "shard long, file string, n_docs long, n_tokens long, min_id long, max_id long"), "token-manifest")


def _read_shards(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                system, at = _open(r["file"])
                with system.open_input_file(at) as f:
                    shard, start = ShardReader(f), r["start"]
                    for k in range(0, len(shard), 1024):
                        rows = []
                        for i in range(k, min(k + 1024, len(shard))):
                            doc_id, ids = shard.document(i)
                            rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), ids))
                            start += len(ids) // 4
                        cols = list(zip(*rows))
                        arrays = [pa.array(c, pa.int64()) for c in cols[:4]]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            flat = pa.array(np.frombuffer(b"".join(cols[4]), "<i4"))
                            ends = np.concatenate(([0], np.cumsum(cols[2]))).astype(np.int32)
                            arrays.append(pa.ListArray.from_arrays(pa.array(ends), flat))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of every document, read from the shards."""
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("file", "shard", F.coalesce(before, F.lit(0)).cast("long").alias("start"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return files.repartition(n, "shard").mapInArrow(_read_shards(with_ids), schema)


def read_documents(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the documents whose id is in ``wanted.doc_id``; other frames are not decompressed.

    Wanted ids meet shards by the manifest's ranges of ids (one pair of bounds for each shard), go
    to their shards by a shuffle, and are found there in the index; a shard without a wanted id is
    not opened. Null wanted ids are left out; a repeated one counts once.
    """
    spark = manifest.sparkSession
    ranges = sorted(tuple(r) for r in manifest.where("max_id IS NOT NULL").select("shard", "min_id", "max_id", "file").collect())  # a row a shard
    low, high = (np.array([r[k] for r in ranges], np.int64) for k in (1, 2))
    files = [r[3] for r in ranges]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            first, last = np.searchsorted(high, keys, "left"), np.searchsorted(low, keys, "right")
            n = np.maximum(last - first, 0)  # an id may go on in the next shard
            shard = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int64()), "doc_id": pa.array(np.repeat(keys, n), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = None, None
        for batch in batches:
            places, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for place in np.unique(places).tolist():
                if place != held:
                    system, at = _open(files[place])
                    held, shard = place, ShardReader(system.open_input_file(at))
                hit = np.flatnonzero(np.isin(shard.ids, keys[places == place]) & (shard.null == 0))
                for k in range(0, len(hit), 1024):
                    got = [shard.document(int(i)) for i in hit[k : k + 1024]]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in got], pa.int64()), "ids": pa.array([np.frombuffer(x, "<i4") for _, x in got], pa.list_(pa.int32()))})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    dealt = keys.mapInArrow(deal, "shard long, doc_id long").repartition(n, "shard").sortWithinPartitions("shard", "doc_id")
    return dealt.mapInArrow(run, "doc_id long, ids array<int>")
