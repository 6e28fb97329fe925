"""Token counts by a map-side two-tier lookup; no pre-token is ever shuffled.

Tier one is a compact table of the lengths (in tokens) of frequent chunks.  It is broadcast and
holds at most ``table_size`` entries of at most ``KEY_BYTES`` each, whatever the corpus.  Tier two
is each worker's own cache: a chunk that the table lacks is encoded once and its length kept, up to a fixed
number of entries and bytes; a longer chunk is encoded wherever it occurs.
The table only saves work: it is filled from a bounded sample (``sample_rows`` texts), and the
counts are those of the tokenizer library for any table.

Results for odd inputs: a null or empty text has 0 bytes and 0 tokens; texts of any length are
counted whole; equal or repeated rows are counted each; a null id is passed on; an empty table
gives an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

import sys
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from textcohort.llm.common import doc_texts, slices, split_long, text_array
from textcohort.llm.word_bpe import KEY_BYTES, LONG_TEXT, Generations, default_vocabulary, distinct_chunks, encoder

TABLE_SIZE = 32_768
SAMPLE_ROWS = 2_000


def frequent_chunks(docs: DataFrame, table_size: int = TABLE_SIZE, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The most frequent chunks of a sample of at most about ``sample_rows`` texts.  The table is sampled in
    the scan's own tasks; the sampled texts meet in one, which sends its ``table_size`` most frequent
    chunks with their counts."""
    total = docs.count()
    sample = docs if total <= sample_rows else docs.sample(fraction=sample_rows / total, seed=5)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            texts = text_array(batch.column("text"))
            for start, stop in slices(texts):
                index, words, _ = distinct_chunks(texts.slice(start, stop - start))
                n = np.bincount(index, minlength=len(words)).tolist()
                seen.update({w: c for w, c in zip(words, n, strict=True) if sys.getsizeof(w) <= KEY_BYTES})
        top = seen.most_common(table_size)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())], ["chunk", "n"])

    found: Counter = Counter()
    # one task after an exchange, so that it reads about sample_rows texts and not the table
    for row in doc_texts(sample).repartition(1).mapInArrow(count, "chunk string, n long").collect():
        found[row.chunk] += row.n
    return [w for w, c in found.most_common(table_size) if c > 1]


class TwoTier:
    """The broadcast table and this worker's cache."""

    def __init__(self, table: dict[str, int], path: str):
        self.table, self.cache, self.path = table, Generations(), path

    def length(self, chunk: str) -> int:
        n = self.table.get(chunk)
        if n is None:
            n = self.cache.get(chunk)
            if n is None:
                n = len(encoder(self.path).fresh(chunk)) // 4
                self.cache.put(chunk, n)
        return n

    def counts(self, texts: pa.Array) -> np.ndarray:
        index, words, at = distinct_chunks(texts)
        lens = np.fromiter(map(self.length, words), np.int64, len(words))
        ends = np.concatenate(([0], np.cumsum(lens[index])))
        return ends[at[1:]] - ends[at[:-1]]


_TIERS: dict[str, TwoTier] = {}


def _tiers(key: str, value: tuple[bytes, bytes], path: str) -> TwoTier:
    """This worker's tiers for one broadcast table; a worker keeps the last one only."""
    if key not in _TIERS:
        names, lens = value
        words = pa.ipc.open_stream(names).read_all().column(0).to_pylist()
        _TIERS.clear()
        _TIERS[key] = TwoTier(dict(zip(words, np.frombuffer(lens, "<u2").tolist(), strict=True)), path)
    return _TIERS[key]


def _packed(words: list[str], path: str) -> tuple[bytes, bytes]:
    """The table as an Arrow string column and 16-bit lengths."""
    enc = encoder(path)
    lens = [len(enc.fresh(w)) // 4 for w in words]
    fits = [i for i, n in enumerate(lens) if n < 1 << 16]
    table = pa.table({"chunk": pa.array([words[i] for i in fits], pa.string())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes(), np.array([lens[i] for i in fits], "<u2").tobytes()


def token_counts(docs: DataFrame, limit: int = 2048, vocabulary: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", table_size: int = TABLE_SIZE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every text, without special tokens."""
    path = vocabulary or default_vocabulary()
    texts = doc_texts(docs, id_col, text_col)
    words = frequent_chunks(docs.select(id_col, text_col).toDF("doc_id", "text"), table_size, sample_rows)
    table = docs.sparkSession.sparkContext.broadcast(_packed(words, path))
    key = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiers = _tiers(key, table.value, path)
            col = text_array(batch.column("text"))
            out = np.zeros(len(col), np.int64)
            for start, stop in slices(col):
                part = col.slice(start, stop - start)
                if stop - start == 1 and len(text := part[0].as_py()) > LONG_TEXT:
                    out[start] = sum(int(tiers.counts(pa.array([p], pa.string()))[0]) for p in split_long(text, LONG_TEXT))
                else:
                    out[start:stop] = tiers.counts(part)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.cast(pc.binary_length(col), pa.int64()), pa.array(out), pa.array(out > limit)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
