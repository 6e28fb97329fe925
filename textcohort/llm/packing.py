"""Bounded-space online packing of token sequences into windows.

Each input partition keeps at most ``open_windows`` open windows.  A document longer than a window
first fills whole windows; what remains is placed best-fit (the open window with the least room
that holds it).  When none fits and no more windows may be open, the fullest window is topped up
with the document's next ids, emitted full, and the rest is placed again.  At its end a partition
merges its open windows with each other, cutting freely, so that at most one is not full.  These
leftovers, one window for each partition, are finally merged across partitions in the same way, in
groups of ``MERGE_GROUP`` partitions, so that only a group's last sequence needs padding.

The number of open windows bounds a task's memory; ids leave the task as soon as their window is
emitted.  The pieces are written once to the shared checkpoint folder, because the merge needs the
fill of every partition before it can number the leftovers.

Results for odd inputs: a null or empty text is the end id alone; a long text becomes many pieces;
equal and repeated rows are packed each; a null id is passed on; an empty table gives no piece.
Only the id and text columns are read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textcohort.llm.common import doc_texts, materialize, tidy
from textcohort.llm.word_bpe import default_vocabulary, encoded

WINDOW = 2048
OPEN_WINDOWS = 32
MERGE_GROUP = 4096
PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, leftover boolean, ids binary"
_NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "leftover", "ids"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]


class Packer:
    """The open windows of one partition.  A window is a list of pieces
    ``(doc_id, start, doc_tokens, ids)``; emitted pieces collect in ``out``."""

    def __init__(self, window: int, open_windows: int, first_id: int):
        self.size, self.most, self.next_id = window, open_windows, first_id
        self.rooms: list[tuple[int, int]] = []  # (room, window key), ascending by room
        self.windows: dict[int, list] = {}
        self.key = 0
        self.out: list[tuple] = []

    def emit(self, pieces: list, leftover: bool = False) -> None:
        at = 0
        for doc, start, total, ids in pieces:
            self.out.append((doc, start, len(ids), total, self.next_id, at, leftover, ids.tobytes()))
            at += len(ids)
        self.next_id += 1

    def _put(self, key: int, room: int, piece: tuple) -> None:
        self.windows[key].append(piece)
        room -= len(piece[3])
        if room:
            insort(self.rooms, (room, key))
        else:
            self.emit(self.windows.pop(key))

    def add(self, doc, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.size:
            self.emit([(doc, at, total, ids[at:at + self.size])])
            at += self.size
        while at < total:
            left = total - at
            i = bisect_left(self.rooms, (left, -1))
            if i < len(self.rooms):
                room, key = self.rooms.pop(i)
                take = left
            elif len(self.rooms) < self.most:
                self.key += 1
                room, key, take = self.size, self.key, left
                self.windows[key] = []
            else:
                room, key = self.rooms.pop(0)
                take = room
            self._put(key, room, (doc, at, total, ids[at:at + take].copy()))
            at += take

    def close(self) -> None:
        """Merge the open windows, cutting freely; the last one, if not full, is the leftover."""
        held, room = [], self.size
        for _, key in self.rooms:
            for doc, start, total, ids in self.windows[key]:
                at = 0
                while at < len(ids):
                    take = min(room, len(ids) - at)
                    held.append((doc, start + at, total, ids[at:at + take]))
                    at, room = at + take, room - take
                    if not room:
                        self.emit(held)
                        held, room = [], self.size
        if held:
            self.emit(held, leftover=True)
        self.rooms, self.windows = [], {}

    def flush(self) -> pa.RecordBatch:
        cols = list(zip(*self.out, strict=True)) if self.out else [[] for _ in _NAMES]
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)


def packed_partitions(docs: DataFrame, window: int, open_windows: int, end_id: int, path: str,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces that each partition emits, before leftovers are merged across partitions."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # numbers of a partition's own, the same in a repeated attempt
        packer = Packer(window, open_windows, TaskContext.get().partitionId() << 32)
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for start, stop, ids, at in encoded(path, batch):
                # the end id follows each document
                ids = np.insert(ids, at[1:], np.uint32(end_id)).astype("<u4")
                at = at + np.arange(len(at))
                for i in range(start, stop):
                    packer.add(names[i], ids[at[i - start]:at[i - start + 1]])
                yield packer.flush()
        packer.close()
        yield packer.flush()

    return doc_texts(docs, id_col, text_col).mapInArrow(tidy(pack), PIECE)


def pack(docs: DataFrame, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = 1,
         vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit integers; a sequence is its pieces
    in order of ``offset``, and only the last sequence of a merge group is not full."""
    pieces = materialize(packed_partitions(docs, window, open_windows, end_id, vocabulary or default_vocabulary(), id_col, text_col), "packing")
    keep = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    return pieces.filter("NOT leftover").select(keep).unionByName(merge_leftovers(pieces.filter("leftover"), window).select(keep))


def merge_leftovers(left: DataFrame, window: int) -> DataFrame:
    """The pieces of the partitions' leftover windows, laid end to end within each group of partitions and
    cut at multiples of the window.  The order needs one row (a number and a fill) per partition."""
    fills = (left.groupBy(F.col("sequence_id").alias("old")).agg(F.sum("length").alias("fill"))
             .withColumn("group", F.floor(F.shiftright("old", 32) / MERGE_GROUP)))
    group = Window.partitionBy("group")
    before = group.orderBy("old").rowsBetween(Window.unboundedPreceding, -1)
    # a partition numbers its own windows from 0, so the upper half of its numbers is free
    fills = fills.select("old", F.coalesce(F.sum("fill").over(before), F.lit(0)).alias("base"),
                         (F.shiftleft(F.shiftright(F.min("old").over(group), 32), 32) + F.lit(1 << 31)).alias("first"))
    at = left.join(fills, F.col("sequence_id") == F.col("old")).withColumn("at", F.col("base") + F.col("offset"))
    nth = F.explode(F.sequence(F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("length") - 1) / window)))
    cut = (at.withColumn("nth", nth).withColumn("from", F.greatest("at", F.col("nth") * window))
           .withColumn("to", F.least(F.col("at") + F.col("length"), (F.col("nth") + 1) * window)))
    skip = F.col("from") - F.col("at")
    return cut.select("doc_id", (F.col("start") + skip).alias("start"), (F.col("to") - F.col("from")).alias("length"), "doc_tokens",
                      (F.col("first") + F.col("nth")).alias("sequence_id"), (F.col("from") - F.col("nth") * window).alias("offset"),
                      F.substring("ids", (skip * 4 + 1).cast("int"), ((F.col("to") - F.col("from")) * 4).cast("int")).alias("ids"))
