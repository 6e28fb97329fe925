"""Counting words and n-grams of a corpus between blocks of texts and hash parts, in arrays instead of rows.

A *block* is some megabytes of texts (of one group, for instance a language) with its own numbering of its
distinct words.  A block sends each *part* of the key space one row: its distinct keys of that part with
their counts, as packed arrays.  The part adds them up and answers each block with an array in the order that
the block had sent, so no key travels back.  A key is in a block's row once, however often it occurs, so no
key is hot; rows are as many as (block, part) pairs that share a key.  Blocks and parts are sized by bytes and
counts, so both grow in number, not in size, with the corpus.

Row kinds: ``tokens`` (a block's texts as word numbers), ``words`` (a block's words of one part),
``ids`` (the part's answer: place and count of each of them), ``vocabulary`` (a part's words with their
counts), ``stats`` (sums of a part).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcohort.llm.common import scratch_path, tidy
from textcohort.llm.word_blocks import BLOCK_BYTES, LONG_TEXT, Block, blocks, pack, pack_words, unpack, unpack_words, words

ROWS = "kind string, grp string, block long, part int, nums array<long>, a binary, b binary, c binary, d binary, e binary, f binary"
_FIELDS = [("kind", pa.string()), ("grp", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("nums", pa.list_(pa.int64())),
           *((x, pa.binary()) for x in "abcdef")]
SCHEMA = pa.schema(_FIELDS)
#: Bytes of text for one part of the words, and n-grams of one part.
PART_BYTES, PART_GRAMS = 48 << 20, 2_000_000

#: Flags of a text, or a part of one, in a block.
FIRST, LAST, NO_ID, MARKED = 1, 2, 4, 8


def table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist([{name: r.get(name) for name, _ in _FIELDS} for r in rows], SCHEMA)


def rows_of(kind: str, group: pa.Table) -> list[dict]:
    """The rows of one kind in a group, by part (and block)."""
    found = group.filter(pc.equal(group["kind"], kind)).to_pylist()
    return sorted(found, key=lambda r: (r["part"] if r["part"] is not None else -1, r["block"] if r["block"] is not None else -1))


def words_parts(texts: DataFrame, part_bytes: int = PART_BYTES) -> int:
    total = texts.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    return max(1, -(-total // part_bytes))


def encode(texts: DataFrame, parts: int, is_word: np.ndarray, is_break: np.ndarray | None, context: int, max_bytes: int = BLOCK_BYTES,
           limit: int = LONG_TEXT) -> DataFrame:
    """``tokens`` and ``words`` rows of the texts ``(doc_id, text, grp, marked)``, written.

    ``tokens``: ``nums`` the marked texts that end here and all words without context; ``a`` word numbers from 1 in order (negative
    where a break stands before the word), ``b`` words of each text, ``c`` flags, ``d`` row numbers, ``e`` ids, ``f`` how many words at
    the start of each text part are context.  ``words``: ``a`` words, ``b`` how often they occur in marked texts; a word's
    number is its place in the block's rows by part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn = TaskContext.get().partitionId(), 0
        for mixed in blocks(batches, is_word, context, ["doc_id", "grp", "marked"], max_bytes, limit):
            for group in dict.fromkeys(v[1] for v in mixed.others):
                rows = _encoded(mixed, [i for i, v in enumerate(mixed.others) if v[1] == group], group, task << 32 | turn, parts, is_word, is_break)
                turn += 1
                yield from table(rows).to_batches()

    return written(texts.select("doc_id", "text", "grp", "marked").mapInArrow(tidy(run), ROWS), "gram-blocks")


def _encoded(block: Block, take: list[int], group: str, name: int, parts: int, is_word: np.ndarray, is_break: np.ndarray | None) -> list[dict]:
    found = words(pa.array([block.texts[i] for i in take], pa.binary()), is_word, is_break)
    lens = np.diff(found.at)
    marked = np.array([bool(block.others[i][2]) for i in take])
    held = np.minimum([block.context[i] for i in take], lens)
    new = np.ones(len(found.index), bool)
    for i in np.flatnonzero(held):
        new[found.at[i]:found.at[i] + held[i]] = False
    names = found.distinct.to_pylist()
    part = np.fromiter((zlib.crc32(w) % parts for w in names), np.int64, len(names))
    order = np.argsort(part, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    index = place[found.index]
    n = np.bincount(index[new & np.repeat(marked, lens)], minlength=len(order))
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    sorted_words = found.distinct.take(pa.array(order))
    rows = [{"kind": "words", "grp": group, "block": name, "part": p, "a": pack_words(sorted_words.slice(ends[p], ends[p + 1] - ends[p])),
             "b": pack(n[ends[p]:ends[p + 1]].astype(np.int64))} for p in range(parts) if ends[p + 1] > ends[p]]
    numbers = (index + 1).astype(np.int32)
    if is_break is not None:
        apart = np.diff(found.piece, prepend=0) > 0
        numbers[apart] *= -1        # a break stands before this word
    flags = [FIRST * block.first[i] | LAST * block.last[i] | NO_ID * (block.others[i][0] is None) | MARKED * bool(block.others[i][2]) for i in take]
    return [*rows, {"kind": "tokens", "grp": group, "block": name, "nums": [sum(f & LAST > 0 and f & MARKED > 0 for f in flags), int(new.sum())],
                    "a": pack(numbers), "b": pack(lens.astype(np.int32)), "c": pack(np.array(flags, np.uint8)),
                    "d": pack(np.array([block.rows[i] for i in take], np.int64)), "e": pack(np.array([block.others[i][0] or 0 for i in take], np.int64)),
                    "f": pack(held.astype(np.int32))}]


def merge_words(encoded: DataFrame, classes: int = 0, least: int = 1) -> DataFrame:
    """``ids``, ``vocabulary`` and ``stats`` rows, written.

    ``ids``: ``a`` the place of each word in its part's vocabulary from 0 (-1: less than ``least`` occurrences), ``b`` its
    count.  ``vocabulary``: ``a`` words, ``b`` counts.  ``stats``: ``nums`` the number of words, of occurrences (all words), and
    of words with 1, 2, ... ``classes`` occurrences."""
    def merge(key: tuple, group: pa.Table) -> pa.Table:
        rows = rows_of("words", group)
        sent = [unpack_words(r["a"]) for r in rows]
        coded = pa.chunked_array(sent).combine_chunks().dictionary_encode()
        index, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        counts = np.zeros(len(distinct), np.int64)
        np.add.at(counts, index, np.concatenate([unpack(r["b"], np.int64) for r in rows]))
        known = counts >= least
        place = np.where(known, np.cumsum(known) - 1, -1)
        place, own = place[index].astype(np.int32), counts[index]
        at = np.concatenate(([0], np.cumsum([len(s) for s in sent])))
        out = [{"kind": "ids", "grp": r["grp"], "block": r["block"], "part": r["part"], "a": pack(place[at[i]:at[i + 1]]), "b": pack(own[at[i]:at[i + 1]])}
               for i, r in enumerate(rows)]
        kept = counts[known]
        nums = [len(kept), int(counts.sum()), *np.bincount(np.minimum(kept, classes + 1), minlength=classes + 2)[1:classes + 1].tolist()]
        common = {"grp": rows[0]["grp"], "part": rows[0]["part"]}
        return table([*out, {"kind": "vocabulary", **common, "a": pack_words(distinct.filter(pa.array(known))), "b": pack(kept)}, {"kind": "stats", **common, "nums": nums}])

    sent = encoded.filter("kind = 'words'")
    return written(by(sent, ["grp", "part"], merge), "gram-words")


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table of the shared checkpoint folder, one folder per kind."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.partitionBy("kind").parquet(path)
    return rows.sparkSession.read.schema(ROWS).parquet(path)


def by(rows: DataFrame, keys: list[str], run: Callable, schema: str = ROWS) -> DataFrame:
    """``run(key, table)`` for every group of rows."""
    names = ROWS.replace(",", "").split()[::2]
    return rows.select(*names).groupBy(*keys).applyInArrow(run, schema)


def stat_sums(rows: DataFrame, n: int, *keys: str) -> list:
    """The sums of ``nums`` over the parts: ``x0, x1, ...``, one row, or one per key."""
    one = rows.filter("kind = 'stats'")
    return one.groupBy(*keys).agg(*[F.sum(F.col("nums")[i]).alias(f"x{i}") for i in range(n)]).collect()


def local_ids(group: pa.Table, kind: str = "ids", first=np.int32, second=np.int64) -> tuple[list[dict], np.ndarray, np.ndarray]:
    """The answers to a block, joined in the order of its own numbering."""
    rows = rows_of(kind, group)
    none = [np.zeros(0, first)], [np.zeros(0, second)]
    return rows, np.concatenate([unpack(r["a"], first) for r in rows] or none[0]), np.concatenate([unpack(r["b"], second) for r in rows] or none[1])
