"""Importance resampling towards a target distribution, with hashed n-gram features.

1. **Counts.**  Every task counts the hashed features of its whole texts into one array of ``buckets`` numbers; the
   arrays are summed by bucket.  Both tables give a distribution over the same buckets.
2. **Weights.**  A bucket's gain is its scaled log ratio of the two smoothed distributions.  The gains are one array of
   fixed size, which every task indexes with its features; a text's weight is the floored mean of its gains.
3. **Quickselect.**  A seeded Gumbel key is added to the weight; the ``k`` best rows are a weighted draw without
   replacement.  The k-th best composite key (score, id) is found without a sort: random pivot keys split the candidates,
   one pass counts exactly what lies below, at and above each pivot, and the candidates narrow to the one interval
   that holds the k-th.  Only the rows up to that key are sorted and ranked.

A feature's bucket is the CRC-32 of its bytes modulo ``buckets``.  CRC-32 is linear: the checksum of ``a b`` follows from
those of ``a `` and ``b`` by shifting the first over the length of ``b``, so only distinct words are ever hashed
byte by byte, and pairs are one table lookup per byte of the checksum.

Results for odd inputs: a null or empty text, or one without words, has no features and weight 0; texts of any length
are counted whole; equal texts and repeated rows are counted and drawn each (rows equal in id, score and features
are interchangeable, and as many of them are drawn as fit); a null id counts as the empty string in the key and
comes before all others among ties; an empty table, or none with ``least_words`` words, draws nothing; an empty target
gives every bucket its smoothed gain.  Only the id and text columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textcohort.llm.common import doc_texts, materialize, tidy
from textcohort.llm.word_blocks import LONG_TEXT, Words, blocks, byte_class, words
from textcohort.operators.index import ordered_index

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Pivot keys of one round of the selection.
PIVOTS = 15
#: Pairs whose second word is longer are hashed byte by byte.
SHIFTS = 64

WORD = byte_class(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")


@lru_cache(maxsize=1)
def shift_tables() -> np.ndarray:
    """``[n, k, v]``: the checksum bits that byte ``k`` with value ``v`` contributes after ``n`` further bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> 1) ^ np.where(step & 1, np.uint32(0xEDB88320), np.uint32(0))
    out = np.empty((SHIFTS + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, SHIFTS + 1):
        out[n] = (out[n - 1] >> 8) ^ step[out[n - 1] & 255]
    return out


def feature_hashes(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of every word occurrence, and of every pair of neighbours (occurrence i and i + 1, whatever text
    they are in: the caller leaves pairs over a text's end out)."""
    distinct = found.distinct.to_pylist()
    own = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))
    spaced = np.fromiter((zlib.crc32(b" ", c) for c in own.tolist()), np.uint32, len(distinct))
    lens = pc.binary_length(found.distinct).to_numpy(zero_copy_only=False)
    a, b = found.index[:-1], found.index[1:]
    left, n = spaced[a], np.minimum(lens, SHIFTS)[b]
    table = shift_tables()
    pairs = own[b]
    for k in range(4):
        pairs = pairs ^ table[n, k, (left >> np.uint32(8 * k)) & np.uint32(255)]
    for i in np.flatnonzero(lens[b] > SHIFTS).tolist():
        pairs[i] = zlib.crc32(distinct[b[i]], int(left[i]))
    return own[found.index], pairs


def _features(batches: Iterator[pa.RecordBatch], buckets: int, others: list[str]) -> Iterator[tuple]:
    """Of each block: the block, its words' offsets, the word buckets, the pair buckets and which pairs count.  A part's first
    ``context`` words only stand before the next one."""
    for block in blocks(batches, WORD, 1, others):
        found = words(block.array(), WORD)
        one, two = feature_hashes(found)
        at = found.at
        own = np.ones(len(one), bool)
        held = np.array(block.context)
        own[at[:-1][held > 0]] = False
        inner = np.ones(len(one), bool)        # the pair that starts here stays in its text
        inner[at[1:][at[1:] > at[:-1]] - 1] = False
        pairs = np.zeros(len(one), np.int64)   # none starts at the block's last word
        pairs[:len(two)] = two % np.uint32(buckets)
        yield block, at, (one % np.uint32(buckets)).astype(np.int64), own, pairs, inner


def _running(values: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2, ... values."""
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket.  A task sends one number per bucket it has."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, _, one, own, two, inner in _features(batches, buckets, []):
            total += np.bincount(one[own], minlength=buckets) + np.bincount(two[inner], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(tidy(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    # at most one row per bucket, a parameter
    for r in rows.collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket ``floor(1000 ln((t+1)(S+B) / ((s+1)(T+B))))``."""
    b = len(source)
    s_all, t_all = float(int(source.sum()) + b), float(int(target.sum()) + b)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, total`` of every text (``total``: the sum of its features' gains)."""
    shared = texts.sparkSession.sparkContext.broadcast(gain)     # one number per bucket, a parameter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for block, at, one, own, two, inner in _features(batches, len(table), ["doc_id"]):
            sums, n_one = _running(np.where(own, table[one], 0)), _running(own)
            pairs, n_two = _running(np.where(inner, table[two], 0)), _running(inner)
            lo, hi = at[:-1], at[1:]
            last = np.maximum(hi - 1, lo)       # pairs that start before a text's last word
            cols = [n_one[hi] - n_one[lo], n_one[hi] - n_one[lo] + n_two[last] - n_two[lo], sums[hi] - sums[lo] + pairs[last] - pairs[lo]]
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in block.others], pa.int64()), pa.array(block.rows, pa.int64()), pa.array([f and e for f, e in zip(block.first, block.last, strict=True)]),
                                              *map(pa.array, cols)], ["doc_id", "row", "whole", "n_words", "n_features", "total"])

    rows = texts.mapInArrow(tidy(run), "doc_id long, row long, whole boolean, n_words long, n_features long, total long")
    rows = materialize(rows.withColumn("task", F.spark_partition_id()), "resampling-weights")
    # the parts of cut texts are few: they alone are put together
    parts = rows.filter("NOT whole").groupBy("task", "row").agg(F.first("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"),
                                                              F.sum("n_features").alias("n_features"), F.sum("total").alias("total"))
    names = ["doc_id", "n_words", "n_features", "total"]
    return rows.filter("whole").select(*names).unionByName(parts.select(*names))


def gumbel_score(weight: Column, doc_id: Column, seed: int = SEED) -> Column:
    """``weight + floor(-1000 ln(-ln((h + 0.5) / 2^32)))`` with ``h`` from the SHA-256 of ``seed:id``."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return weight + F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def kth_key(rows: DataFrame, order: list[str], k: int, pivots: int = PIVOTS, seed: int = SEED) -> tuple | None:
    """The ``k``-th smallest key (from 1) of the columns ``order`` (no nulls), or None where there are fewer rows.

    Per round: ``pivots`` keys by a seeded hash, then exact counts below and at each of them."""
    left, name = rows.select(F.struct(*order).alias("key")), "quickselect"
    if k < 1:
        return None
    for turn in range(1 << 16):
        drawn = left.orderBy(F.xxhash64(F.lit(seed), F.lit(turn), F.col("key")), "key").limit(pivots).collect()
        cuts = sorted({tuple(r.key) for r in drawn})
        if not cuts:
            return None
        marks = [F.struct(*[F.lit(v).alias(c) for c, v in zip(order, cut, strict=True)]) for cut in cuts]
        one = F.lit(1)
        counted = left.agg(F.count(one).alias("all"), *[F.count(F.when(F.col("key") < m, one)).alias(f"lt{i}") for i, m in enumerate(marks)],
                           *[F.count(F.when(F.col("key") == m, one)).alias(f"eq{i}") for i, m in enumerate(marks)]).first()
        if k > counted["all"]:
            return None
        below, low, high = 0, None, None
        for i, cut in enumerate(cuts):
            if counted[f"lt{i}"] < k <= counted[f"lt{i}"] + counted[f"eq{i}"]:
                return cut
            if k <= counted[f"lt{i}"]:
                high = marks[i]
                break
            below, low = counted[f"lt{i}"] + counted[f"eq{i}"], marks[i]
        k -= below
        for side, keep in ((low, lambda m: F.col("key") > m), (high, lambda m: F.col("key") < m)):
            if side is not None:
                left = left.filter(keep(side))
        # the interval is a small part of what was there, so the written tables shrink from round to round
        left = materialize(left, name)
    raise RuntimeError("the selection did not end")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED,
             id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document: ``rank`` is its place among the drawn ones, or null.

    Of the N documents with at least ``least_words`` words, ``floor(percent * N / 100)`` are drawn."""
    texts = doc_texts(docs, id_col, text_col)
    goal = target.select(F.coalesce(F.col(target_text).cast("string"), F.lit("")).alias("text"))
    gain = gains(bucket_counts(texts, buckets), bucket_counts(goal, buckets))
    n = F.col("n_features")
    mean = F.when(n > 0, (F.col("total") - F.pmod("total", n)) / n).otherwise(0.0)
    rows = (weighted(texts, gain).withColumn("weight", F.round(mean).cast("long"))
            .withColumn("score", gumbel_score(F.col("weight"), F.col("doc_id"), seed))
            .withColumn("fit", F.col("n_words") >= least_words)
            .select("doc_id", "n_features", "weight", "score", "fit", (-F.col("score")).alias("_worse"), F.coalesce("doc_id", F.lit(-(2 ** 63))).alias("_id")))
    rows = materialize(rows, "resampling-scores")
    order = ["_worse", "_id", "n_features", "weight"]
    k = rows.filter("fit").count() * percent // 100
    last = kth_key(rows.filter("fit"), order, k, seed=seed)
    names = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return rows.select(*names, none)
    mark = F.struct(*[F.lit(v).alias(c) for c, v in zip(order, last, strict=True)])
    wins = F.col("fit") & (F.struct(*order) <= mark)
    # rows equal to the last key beyond k have a place above k
    place = ordered_index(rows.filter(wins), [], order, out="_at")
    drawn = place.select(*names, F.when(F.col("_at") < k, F.col("_at") + 1).alias("rank"))
    return drawn.unionByName(rows.filter(~wins).select(*names, none))
