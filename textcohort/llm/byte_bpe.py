"""Byte-level BPE with vectorised pre-tokenisation.

Pre-tokens are found without a regular expression.  Every code point has a class (letter, number,
space, other white space, anything else) in one array; with a look at the next characters each
position becomes a *symbol*, and a symbol is a transition function on the eight states of a small
automaton.  Functions compose associatively, and the functions that the symbols generate are few,
so a composition is one table lookup.  A batch is scanned as a matrix of blocks: prefix
compositions inside all blocks at once, a doubling scan over the blocks' totals, and one lookup for
each position's state, which says whether a pre-token starts there.

The pre-tokens are slices of the text's UTF-8 bytes.  Arrow dictionary-encodes them, each distinct
slice of a batch is merged once (a worker cache of bounded size sits in front of the merges), and
NumPy gathers the ids of all slices.  Byte offsets of the tokens are kept with the ids; decoding
places each token's bytes at its offset.

Results for odd inputs: a null or empty text has no ids; one very long pre-token is merged in
O(n log n) with a heap; repeated rows are encoded each; a null id is passed on; an empty table gives
an empty result.  A text is never cut.  Only the id and text columns are read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textcohort.llm.common import doc_texts, slices, text_array

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE_ENTRIES = 300_000
CODE_POINTS = 0x110000
#: Longer slices are merged with a heap.
SHORT_PIECE = 64

# classes of code points
OTHER, LETTER, NUMBER, SPACE, WHITE = range(5)
# symbols: the class with what follows it.  A white space character is the last of its run or not;
# an apostrophe may open a contraction of two or three characters.
_LAST_SPACE, _LAST_WHITE, _MID, _SHORT, _LONG = 3, 4, 5, 6, 7
_SYMBOLS = 8
# states: a new pre-token must start; inside letters, numbers, other characters, white space; after a
# space that belongs to the next pre-token; one or two characters of a contraction to come
_FRESH, _LETTERS, _NUMBERS, _OTHERS, _BLANK, _JOINED, _ONE, _TWO = range(8)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    """The class of every code point as the tokenizer library's own regular expressions see it: the
    library is asked which of all code points match a class."""
    import tiktoken

    points = [c for c in range(CODE_POINTS) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    single = {bytes([b]): b for b in range(256)}
    classes = np.full(CODE_POINTS, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = bytes(probe.encode_ordinary(text)).decode()
        classes[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    classes[ord(" ")] = SPACE
    return classes


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(functions, compose, of_symbol, starts)``: all functions that the symbols generate (rows: the
    state after each state), the number of "first a, then b", the number of each symbol's function
    (symbols of a text's first character, which forget the state, follow the others), and whether
    a pre-token starts at a symbol met in a state."""
    step = np.empty((_SYMBOLS, 8), np.uint8)
    starts = np.zeros((_SYMBOLS, 8), bool)
    for state in range(8):
        fresh = state in (_FRESH, _LETTERS, _NUMBERS, _BLANK)
        for symbol, own in ((LETTER, _LETTERS), (NUMBER, _NUMBERS), (OTHER, _OTHERS)):
            step[symbol, state] = own
            starts[symbol, state] = state not in (own, _JOINED)
        if state in (_ONE, _TWO):  # only letters follow, by the choice of symbols
            step[LETTER, state] = _FRESH if state == _ONE else _ONE
            starts[LETTER, state] = False
        for symbol, to_come in ((_SHORT, _ONE), (_LONG, _TWO)):
            step[symbol, state] = to_come if fresh else _OTHERS
            starts[symbol, state] = fresh
        step[_LAST_SPACE, state], step[_LAST_WHITE, state], step[_MID, state] = _JOINED, _FRESH, _BLANK
        starts[_LAST_SPACE, state] = starts[_LAST_WHITE, state] = True
        starts[_MID, state] = state != _BLANK
    first = np.repeat(step[:, :1], 8, axis=1)
    starts = np.concatenate((starts, np.ones((_SYMBOLS, 8), bool)))
    numbers: dict[bytes, int] = {}
    rows: list[np.ndarray] = []
    generators = [*step, *first, np.arange(8, dtype=np.uint8)]
    todo = list(generators)
    while todo:
        f = todo.pop()
        if f.tobytes() not in numbers:
            numbers[f.tobytes()] = len(rows)
            rows.append(f)
            todo += [g[f] for g in generators]
    functions = np.array(rows)
    compose = np.array([[numbers[b[a].tobytes()] for b in rows] for a in rows], np.uint16)
    return functions, compose, np.array([numbers[g.tobytes()] for g in generators], np.uint16), starts


def symbols(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The symbol at each code point of a batch of texts; ``first`` has each text's first position."""
    kind = classes[points]
    white = kind >= SPACE
    following = np.concatenate((white[1:], [True]))
    following[first[first > 0] - 1] = True  # the end of a text is no character
    out = np.where(white, np.where(following, _MID, np.where(kind == SPACE, _LAST_SPACE, _LAST_WHITE)), kind).astype(np.uint8)
    quote = np.flatnonzero(points == ord("'"))
    if len(quote):
        padded = np.concatenate((points, [0, 0]))
        ends = np.append(first[1:], len(points))
        end = ends[np.searchsorted(first, quote, "right") - 1]
        one, two = padded[quote + 1], padded[quote + 2]
        one, two = np.where(quote + 1 < end, one, 0), np.where(quote + 2 < end, two, 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        out[quote[short]] = _SHORT
        out[quote[long]] = _LONG
    out[first] += _SYMBOLS
    return out


def token_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray, block: int = 256) -> np.ndarray:
    """Positions at which pre-tokens start, by an associative scan over transition functions."""
    if not len(points):
        return np.empty(0, np.int64)
    functions, compose, of_symbol, starts = automaton()
    sym = symbols(points, first, classes)
    rows = -(-len(sym) // block)
    last = len(of_symbol) - 1  # the identity fills the last block
    grid = np.full(rows * block, of_symbol[last], np.uint16)
    grid[:len(sym)] = of_symbol[sym]
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    size = compose.shape[0]
    flat = compose.reshape(-1)
    for j in range(1, block):  # prefix compositions of all blocks, one column at a time
        grid[j] = flat[grid[j - 1].astype(np.intp) * size + grid[j]]
    totals, shift = grid[-1].copy(), 1
    while shift < rows:  # doubling scan over the blocks
        totals[shift:] = flat[totals[:-shift].astype(np.intp) * size + totals[shift:]]
        shift *= 2
    entry = np.concatenate(([_FRESH], functions[totals[:-1], _FRESH])).astype(np.intp)
    after = functions.reshape(-1)[grid * 8 + entry.astype(np.uint16)]  # the state after each position
    before = np.concatenate((entry[None, :].astype(np.uint8), after[:-1])).T.reshape(-1)[:len(sym)]
    return np.flatnonzero(starts[sym, before])


class Merger:
    """Ids of byte slices by rank merging, with a bounded cache."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        names = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            names[rank] = token
        self.lens = np.array([len(x) for x in names], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.lens)))[:-1]
        self.bytes = np.frombuffer(b"".join(names), np.uint8)
        self.cache: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Join the neighbouring parts of the lowest rank, the leftmost first, until none has one."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        if n <= SHORT_PIECE:
            return self._merge_short(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if not end[i] or j >= n or end[j] != stop:  # a part of this pair has been joined since
                continue
            end[i], after[i], end[j] = stop, after[j], 0
            if after[i] < n:
                before[after[i]] = i
                k = end[after[i]]
                if (r := ranks.get(piece[i:k])) is not None:
                    heapq.heappush(heap, (r, i, k))
            if before[i] >= 0 and (r := ranks.get(piece[before[i]:stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = after[i]
        return out

    def _merge_short(self, piece: bytes) -> list[int]:
        """The same for a short slice, with the ranks of all neighbouring pairs in a list."""
        rank, none = self.ranks.get, len(self.bytes)
        cuts = list(range(len(piece) + 1))
        pairs = [rank(piece[i:i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (low := min(pairs)) != none:
            i = pairs.index(low)
            del pairs[i], cuts[i + 1]
            if i < len(pairs):
                pairs[i] = rank(piece[cuts[i]:cuts[i + 2]], none)
            if i:
                pairs[i - 1] = rank(piece[cuts[i - 1]:cuts[i + 1]], none)
        return [self.ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]

    def ids(self, piece: bytes) -> bytes:
        found = self.cache.get(piece)
        if found is None:
            found = np.array(self.merge(piece), "<u4").tobytes()
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[piece] = found
        return found

    def encode(self, texts: pa.Array, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, byte offsets, text offsets)``: all ids, each token's first byte in its own text, and
        where each text's ids begin."""
        data = "".join(texts.to_pylist())
        raw = data.encode()
        points = np.frombuffer(data.encode("utf-32-le"), "<u4")
        lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        sizes = np.array([len(t) for t in texts.to_pylist()], np.int64)
        text_at = np.concatenate(([0], np.cumsum(sizes)))
        first = text_at[:-1][sizes > 0]
        start = token_starts(points, first, classes)
        cuts = np.append(lead[start], len(raw)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(raw)]).dictionary_encode()
        index = pieces.indices.to_numpy(zero_copy_only=False)
        coded = [self.ids(p) for p in pieces.dictionary.to_pylist()]
        table = np.frombuffer(b"".join(coded), "<u4")
        n = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        table_at = np.concatenate(([0], np.cumsum(n)))[:-1]
        lens = n[index] if len(index) else np.empty(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(lens)))
        ids = table[np.repeat(table_at[index] - ends[:-1], lens) + np.arange(ends[-1])] if len(index) else table
        at = ends[np.searchsorted(start, text_at)]
        byte_at = np.concatenate(([0], np.cumsum(self.lens[ids])))
        offsets = byte_at[:-1] - np.repeat(byte_at[at[:-1]], np.diff(at))
        return ids, offsets, at

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The bytes of one text: each token's bytes placed at its offset."""
        if not len(ids):
            return b""
        lens = self.lens[ids]
        out = np.empty(int(offsets[-1] + lens[-1]), np.uint8)
        within = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
        out[np.repeat(offsets, lens) + within] = self.bytes[np.repeat(self.at[ids], lens) + within]
        return out.tobytes()


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    """One merger for each worker process and vocabulary."""
    return Merger(path)


_LIST = pa.list_(pa.int32())


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """``doc_id, ids, offsets``: each text's ids and the byte offset of each token."""
    path = vocabulary or default_vocabulary()
    # one byte for each code point: a table of fixed size
    classes = docs.sparkSession.sparkContext.broadcast(code_point_classes().tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, own = np.frombuffer(classes.value, np.uint8), merger(path)
        for batch in batches:
            names, texts = batch.column("doc_id"), text_array(batch.column("text"))
            for start, stop in slices(texts, batch_bytes):
                ids, offsets, at = own.encode(texts.slice(start, stop - start), table)
                cuts = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([names.slice(start, stop - start), *(pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (ids, offsets))],
                                                 ["doc_id", "ids", "offsets"])

    return doc_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, offsets array<int>")


def round_trip(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """``decode(encode(docs))`` in one pass over the texts: a worker encodes a small batch and decodes it from
    its ids and offsets before it takes the next, so the ids of a batch never wait in the JVM."""
    path = vocabulary or default_vocabulary()
    classes = docs.sparkSession.sparkContext.broadcast(code_point_classes().tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, own = np.frombuffer(classes.value, np.uint8), merger(path)
        for batch in batches:
            names, texts = batch.column("doc_id"), text_array(batch.column("text"))
            for start, stop in slices(texts, batch_bytes):
                ids, offsets, at = own.encode(texts.slice(start, stop - start), table)
                yield _decoded(own, names.slice(start, stop - start), ids, offsets, at)

    return doc_texts(docs, id_col, text_col).mapInArrow(run, _DECODED)


_DECODED = "doc_id long, n_tokens long, id_bytes binary, decoded binary"


def _decoded(own: Merger, names: pa.Array, ids: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """The decoded rows of texts whose ids lie between the offsets ``at``."""
    runs = [slice(a, b) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([names, pa.array(np.diff(at), pa.int64()), pa.array([ids[r].astype("<u4").tobytes() for r in runs], pa.binary()),
                                       pa.array([own.decode(ids[r], offsets[r]) for r in runs], pa.binary())], ["doc_id", "n_tokens", "id_bytes", "decoded"])


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, id_bytes, decoded``: the ids as little-endian unsigned 32-bit integers and
    the bytes that they stand for."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(path)
        for batch in batches:
            lists = [batch.column(c) for c in ("ids", "offsets")]
            at = lists[0].offsets.to_numpy().astype(np.int64)
            ids, offsets = (x.values.to_numpy(zero_copy_only=False) for x in lists)
            base = lists[1].offsets[0].as_py() - int(at[0])
            for k in range(0, batch.num_rows, 256):
                cut = at[k:min(k + 256, batch.num_rows) + 1]
                lo, hi = int(cut[0]), int(cut[-1])
                yield _decoded(own, batch.column("doc_id").slice(k, len(cut) - 1), ids[lo:hi], offsets[lo + base:hi + base], cut - lo)

    return encoded.select("doc_id", "ids", "offsets").mapInArrow(run, _DECODED)
