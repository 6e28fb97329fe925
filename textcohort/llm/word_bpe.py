"""Encoding with a word-end BPE vocabulary, one distinct word at a time.

The vocabulary's pre-tokeniser never joins text across white space, so the ids of a text are the
concatenated ids of its chunks between ASCII white space.  A batch of texts is split and
dictionary-encoded by Arrow, only the distinct chunks of the batch are looked up or encoded, and
the ids of all chunks are gathered with NumPy.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from textcohort.llm.common import slices, split_long, text_array

VOCABULARY = "word_bpe_49k.json"
#: Entries and bytes of one generation of a worker's cache; bytes in memory of the longest chunk that it, or
#: a broadcast table, keeps (about 60 code points of any kind).
CACHE_ENTRIES, CACHE_BYTES, KEY_BYTES = 100_000, 32 << 20, 320
#: A longer text is encoded in parts cut at white space.
LONG_TEXT = 4 << 20

# The pre-token pattern of the vocabulary, after lower-casing.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class Generations:
    """A cache of at most two generations of ``size`` entries and ``max_bytes``.  When the young one is full it
    becomes the old one; what is found in the old one moves to the young one, so frequent entries stay.  A key
    of more than ``KEY_BYTES`` is not kept: its work is done again."""

    def __init__(self, size: int = CACHE_ENTRIES, max_bytes: int = CACHE_BYTES):
        self.size, self.max_bytes, self.held, self.young, self.old = size, max_bytes, 0, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        long = sys.getsizeof(key)
        if long > KEY_BYTES:
            return
        cost = long + sys.getsizeof(value)
        if len(self.young) >= self.size or self.held + cost > self.max_bytes:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[key] = value
        self.held += cost


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_symbols() -> dict[int, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: a printable Latin-1
    character stands for itself, the others take the code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of texts under the vocabulary file at ``path``.

    A chunk of printable Latin-1 characters is normal under NFC and lower-cases character by
    character, so its pieces go straight to the vocabulary's BPE model (with a cache of pieces);
    any other chunk goes through the library's full path."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.symbols = _byte_symbols()
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.vocabulary_size = self.tokenizer.get_vocab_size()
        self.pieces, self.chunks = Generations(), Generations()

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            # visible ASCII characters are their own symbols
            symbols = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.symbols)
            tokens = self.model.tokenize(symbols)
            ids = b"".join([t.id.to_bytes(4, "little") for t in tokens])
            self.pieces.put(piece, ids)
        return ids

    def fresh(self, chunk: str) -> bytes:
        """Encode a chunk that no cache has.  Most chunks are one run of letters, many with one mark after it:
        the pattern would give these pieces too."""
        if chunk and (chunk.isascii() or max(chunk) < "Ā"):
            if chunk.isalpha():
                return self.piece(chunk.lower())
            if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
                return self.piece(chunk[:-1].lower()) + self.piece(chunk[-1])
        if chunk.isprintable() and (chunk.isascii() or max(chunk) < "Ā") and not any(s in chunk for s in self.special):
            return b"".join(map(self.piece, PIECES.findall(chunk.lower())))
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def chunk(self, chunk: str) -> bytes:
        # a run of ASCII letters is one piece: its cache is enough
        if chunk.isascii() and chunk.isalpha():
            return self.piece(chunk.lower())
        ids = self.chunks.get(chunk)
        if ids is None:
            ids = self.fresh(chunk)
            self.chunks.put(chunk, ids)
        return ids

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the offsets of each text in them."""
        index, words, doc_at = distinct_chunks(texts)
        coded = [self.chunk(w) for w in words]
        table = np.frombuffer(b"".join(coded), "<u4")
        lens = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        return gather(table, lens, index, doc_at)


def distinct_chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The batch's chunks between ASCII white space: an index into the distinct chunks for each
    occurrence, the distinct chunks, and the occurrence offsets of each text."""
    lists = pc.ascii_split_whitespace(texts)
    at = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return (coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False), at - at[0])


def gather(table: np.ndarray, lens: np.ndarray, index: np.ndarray, doc_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the table's entries in the order of ``index``; the offsets of each text."""
    first = np.concatenate(([0], np.cumsum(lens)))[:-1]
    n = lens[index]
    ends = np.concatenate(([0], np.cumsum(n)))
    take = np.repeat(first[index] - ends[:-1], n) + np.arange(ends[-1])
    return table[take], ends[doc_at]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary."""
    return WordEncoder(path)


def encoded(path: str, batch: pa.RecordBatch, max_bytes: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs ``(start, stop, ids, offsets)`` of a batch with a ``text`` column, each of bounded size;
    a text longer than ``LONG_TEXT`` is encoded in parts."""
    enc, texts = encoder(path), text_array(batch.column("text"))
    for start, stop in slices(texts, max_bytes):
        part = texts.slice(start, stop - start)
        if stop - start == 1 and len(text := part[0].as_py()) > LONG_TEXT:
            ids = np.concatenate([enc.ids(pa.array([p], pa.string()))[0] for p in split_long(text, LONG_TEXT)])
            yield start, stop, ids, np.array([0, len(ids)])
        else:
            yield start, stop, *enc.ids(part)
