"""Token-id files with fixed-width bit packing.

A shard file holds the ids of consecutive documents, each in the fewest bits that the vocabulary
needs.  Ids are grouped into blocks of ``BLOCK`` ids; 64 ids of ``b`` bits fill ``b`` 64-bit words
exactly, so a block starts at a word and packing and unpacking are 64 vectorised shifts.  A footer
has the byte offset of every block and the id and first position of every document: any run of ids
is read by fetching its blocks only.

Layout: ``TIDS`` | bits u32 | block size u32 | blocks ... | block offsets u64[blocks] |
doc ids i64[docs] | first ids u64[docs + 1] | blocks u64 | docs u64 | ids u64 | ``SDIT``.
All integers are little-endian.  A null doc_id is stored as the lowest 64-bit integer.

Documents are range-partitioned and sorted by doc_id, one shard for each task, so a shard's place in
the order is its partition number and no task sees more than its own range.  A shard is streamed
block by block to a file of its attempt and renamed when complete: a task that is run again
replaces the file by an equal one, and unfinished attempts are never read.

Results for odd inputs: a null or empty text is the end id alone; a document may span many blocks;
rows that repeat a doc_id are ordered by text and stored each; null ids come first; an empty table
gives no documents.  Only the id and text columns are read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textcohort.llm.common import doc_texts, materialize, partitions_for, scratch_path
from textcohort.llm.word_bpe import default_vocabulary, encoded, encoder

BLOCK = 4096
NO_ID = -(2 ** 63)
_HEAD, _TAIL = struct.Struct("<4sII"), struct.Struct("<QQQ4s")


def bits_for(vocabulary_size: int) -> int:
    return max(1, int(vocabulary_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Pack ids of a multiple of 64 into ``bits`` bits each, lowest bit first."""
    lanes = ids.astype(np.uint64).reshape(-1, 64)
    words = np.zeros((len(lanes), bits), np.uint64)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        words[:, word] |= lanes[:, i] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, i] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack_bits(data: bytes, bits: int) -> np.ndarray:
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    ids = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        ids[:, i] = (x & mask).astype(np.uint32)
    return ids.reshape(-1)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system and path of a folder URI as Spark writes it (``file:/x`` has one slash)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


class ShardWriter:
    """Streams ids into one shard; at most one block of ids waits in memory."""

    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        out.write(_HEAD.pack(b"TIDS", bits, BLOCK))
        self.at = _HEAD.size
        self.blocks: list[int] = []
        self.docs: list[int] = []
        self.firsts: list[np.ndarray] = []
        self.n_ids = 0
        self.waiting = np.empty(0, np.uint32)

    def _write(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits)
        self.blocks += [self.at + i * (BLOCK * self.bits // 8) for i in range(-(-len(ids) // BLOCK))]
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_ids: list, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.docs += [NO_ID if d is None else d for d in doc_ids]
        self.firsts.append(offsets[:-1] + self.n_ids)
        self.n_ids += len(ids)
        ready = np.concatenate((self.waiting, ids))
        full = len(ready) // BLOCK * BLOCK
        if full:
            self._write(ready[:full])
        self.waiting = ready[full:].copy()

    def close(self) -> None:
        if len(self.waiting):
            self._write(np.concatenate((self.waiting, np.zeros(-len(self.waiting) % 64, np.uint32))))
        firsts = np.concatenate([*self.firsts, [self.n_ids]])
        self.out.write(np.array(self.blocks, "<u8").tobytes() + np.array(self.docs, "<i8").tobytes() + firsts.astype("<u8").tobytes())
        self.out.write(_TAIL.pack(len(self.blocks), len(self.docs), self.n_ids, b"SDIT"))


class Shard:
    """Random access to one shard file: the footer is read at once, blocks when asked for."""

    def __init__(self, path: str):
        fs, at = file_system(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        magic, self.bits, self.block = _HEAD.unpack(self.file.read_at(_HEAD.size, 0))
        blocks, docs, self.n_ids, end = _TAIL.unpack(self.file.read_at(_TAIL.size, size - _TAIL.size))
        if magic != b"TIDS" or end != b"SDIT":
            raise ValueError(f"{path} is not a complete shard")
        foot = self.file.read_at(8 * (blocks + docs + docs + 1), size - _TAIL.size - 8 * (blocks + docs + docs + 1))
        self.offsets = np.frombuffer(foot, "<u8", blocks).astype(np.int64)
        self.doc_ids = np.frombuffer(foot, "<i8", docs, 8 * blocks)
        self.firsts = np.frombuffer(foot, "<u8", docs + 1, 8 * (blocks + docs)).astype(np.int64)
        self.end = size - _TAIL.size - len(foot)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard."""
        if stop <= start:
            return np.empty(0, np.uint32)
        a, b = start // self.block, (stop - 1) // self.block
        end = int(self.offsets[b + 1]) if b + 1 < len(self.offsets) else self.end
        data = self.file.read_at(end - int(self.offsets[a]), int(self.offsets[a]))
        return unpack_bits(data, self.bits)[start - a * self.block:stop - a * self.block]


def write_token_files(docs: DataFrame, out_dir: str | None = None, end_id: int = 2, vocabulary: str | None = None,
                      id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encode all texts in ascending doc_id order into shard files under ``out_dir`` (a folder that
    all executors share; by default one in the checkpoint folder) and return the written table of
    shards ``(shard, path, n_docs, n_ids, first_id)``, one row per file."""
    spark = docs.sparkSession
    path = vocabulary or default_vocabulary()
    out_dir = (out_dir or scratch_path(spark, "token-files")).rstrip("/")
    bits = bits_for(encoder(path).vocabulary_size)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, fs, writer = context.partitionId(), None, None
        name = f"{out_dir}/shard-{shard:06d}.tids"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs, target = file_system(name)
                fs.create_dir(target.rpartition("/")[0], recursive=True)
                attempt = f"{target}.{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.part"
                writer = ShardWriter(fs.open_output_stream(attempt), bits)
            names = batch.column("doc_id").to_pylist()
            for start, stop, ids, at in encoded(path, batch):
                ids = np.insert(ids, at[1:], np.uint32(end_id)).astype(np.uint32)
                writer.add(names[start:stop], ids, at + np.arange(len(at)))
        if writer is not None:
            writer.close()
            writer.out.close()
            fs.move(attempt, target)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int64()), (name, pa.string()), (len(writer.docs), pa.int64()), (writer.n_ids, pa.int64()))],
                                             ["shard", "path", "n_docs", "n_ids"])

    ordered = (doc_texts(docs, id_col, text_col)
               .repartitionByRange(shards or partitions_for(spark), F.col("doc_id").asc_nulls_first())
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text"))
    written = materialize(ordered.mapInArrow(write, "shard long, path string, n_docs long, n_ids long"), "token-shards")
    # one row for each file, so this order needs no more than one small task
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(shards: DataFrame, max_ids: int = 1 << 21) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document in the files: ``start`` counts the ids of
    all documents before it, ``ids`` are little-endian unsigned 32-bit integers.  A task reads its
    shard in runs of about ``max_ids`` ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"])
                at, docs = 0, len(shard.doc_ids)
                while at < docs:
                    to = max(at + 1, int(np.searchsorted(shard.firsts, shard.firsts[at] + max_ids, "right")) - 1)
                    to = min(to, docs)
                    firsts = shard.firsts[at:to + 1]
                    data = pa.py_buffer(shard.ids(int(firsts[0]), int(firsts[-1])).astype("<u4").tobytes())
                    cuts = pa.py_buffer(((firsts - firsts[0]) * 4).astype("<i4").tobytes())
                    names = shard.doc_ids[at:to]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(names, pa.int64(), mask=names == NO_ID), pa.array(firsts[:-1] + row["first_id"], pa.int64()),
                        pa.array(np.diff(firsts), pa.int64()), pa.Array.from_buffers(pa.binary(), to - at, [None, cuts, data])],
                        ["doc_id", "start", "n_tokens", "ids"])
                    at = to
                shard.file.close()

    spread = shards.repartition(partitions_for(shards.sparkSession), "shard")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
