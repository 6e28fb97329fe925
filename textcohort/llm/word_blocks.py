"""Blocks of whole texts as arrays of words, and compact columns for arrays that are shuffled.

Words are runs of bytes of one class, found with NumPy over the bytes of a whole block of texts (all classes
in use are made of ASCII bytes, so no code point is ever cut).  ``A-Z`` are lower-cased, nothing else.  A
text longer than ``LONG_TEXT`` is cut before white space into parts; each later part repeats the last
words of the one before it as context, so that runs of words over a cut are seen once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

#: Bytes of text in one block, and of a text that is cut.
BLOCK_BYTES, LONG_TEXT = 8 << 20, 8 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_CUT = re.compile(rb"[ \t-\r]")


def byte_class(pattern: bytes) -> np.ndarray:
    """Which of the 256 byte values a one-byte pattern matches."""
    return np.array([re.fullmatch(pattern, bytes([b]), re.DOTALL) is not None for b in range(256)])


@dataclass
class Words:
    index: np.ndarray     # of each occurrence: the word's place in distinct
    distinct: pa.Array    # the words, as bytes
    at: np.ndarray        # offsets of each text in index
    begin: np.ndarray     # of each occurrence: its first byte in the block
    piece: np.ndarray     # of each occurrence: how many break bytes stand before it in the block


def words(texts: pa.Array, is_word: np.ndarray, is_break: np.ndarray | None = None) -> Words:
    """The words of a block of texts (a string or binary array without nulls)."""
    wide = texts.type in (pa.large_string(), pa.large_binary())
    _, places, body = texts.buffers()
    ends = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    size = int(ends[-1] - ends[0])
    low = LOWER[np.frombuffer(body, np.uint8)[ends[0]:ends[-1]]] if size else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = is_word[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = ends[:-1][ends[:-1] < size]
    first[heads] = inside[heads]
    begin = np.flatnonzero(first)
    kept = low[inside]
    # where each word starts among the kept bytes
    start = np.empty(len(begin) + 1, np.int32)
    start[:-1] = np.cumsum(inside, dtype=np.int32)[begin] - 1
    start[-1] = len(kept)
    coded = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(start), pa.py_buffer(kept)]).dictionary_encode()
    piece = np.cumsum(is_break[low], dtype=np.int32)[begin] if is_break is not None else np.zeros(0, np.int32)
    index = coded.indices.to_numpy(zero_copy_only=False)
    return Words(index, coded.dictionary, np.searchsorted(begin, ends), begin, piece)


@dataclass
class Block:
    """Texts, or parts of long ones, with what is known of them."""
    texts: list = field(default_factory=list)     # bytes
    rows: list = field(default_factory=list)      # number of the row in its task
    context: list = field(default_factory=list)   # words that repeat the part before
    first: list = field(default_factory=list)     # begins its text
    last: list = field(default_factory=list)      # ends its text
    others: list = field(default_factory=list)    # the row's other columns
    size: int = 0

    def array(self) -> pa.Array:
        return pa.array(self.texts, pa.binary())


def parts_of(data: bytes, is_word: np.ndarray, context: int, limit: int = LONG_TEXT) -> Iterator[tuple[bytes, int, bool]]:
    """``(bytes, context words, last)``: the parts of a text."""
    at, tail, held = 0, b"", 0
    while True:
        cut = _CUT.search(data, at + limit) if len(data) - at > limit else None
        part = tail + data[at:cut.start() if cut else len(data)]
        yield part, held, cut is None
        if cut is None:
            return
        begin = words(pa.array([part], pa.binary()), is_word).begin
        held = min(context, len(begin))
        tail = part[begin[-held]:] if held else b""
        at = cut.start()


def blocks(batches: Iterator[pa.RecordBatch], is_word: np.ndarray, context: int, others: list[str], max_bytes: int = BLOCK_BYTES,
           limit: int = LONG_TEXT) -> Iterator[Block]:
    """The rows of a task (columns ``text`` and ``others``) in blocks of about ``max_bytes``; a null text is empty."""
    block, row = Block(), 0
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        values = list(zip(*(batch.column(c).to_pylist() for c in others), strict=True)) if others else [()] * len(texts)
        for text, value in zip(texts, values, strict=True):
            data = text.as_py() or b""
            first = True
            for part, held, last in [(data, 0, True)] if len(data) <= limit else parts_of(data, is_word, context, limit):
                if block.size and block.size + len(part) > max_bytes:
                    yield block
                    block = Block()
                for name, x in (("texts", part), ("rows", row), ("context", held), ("first", first), ("last", last), ("others", value)):
                    getattr(block, name).append(x)
                block.size += len(part) + 16
                first = False
            row += 1
    if block.texts:
        yield block


def pack(values: np.ndarray) -> bytes:
    """An array of fixed-width numbers, byte plane by byte plane, compressed."""
    values = np.ascontiguousarray(values)
    if not len(values):
        return b""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes, kind) -> np.ndarray:
    """The array that ``pack`` was given; ``kind`` is its NumPy type."""
    kind = np.dtype(kind)
    if not data:
        return np.zeros(0, kind)
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], n * kind.itemsize, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).reshape(-1).view(kind)


def pack_words(distinct: pa.Array) -> bytes:
    """A binary array as one compressed value."""
    if not len(distinct):
        return b""
    table = pa.table({"w": distinct})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack_words(data: bytes) -> pa.Array:
    if not data:
        return pa.array([], pa.binary())
    return pa.ipc.open_stream(data).read_all().column("w").combine_chunks()
