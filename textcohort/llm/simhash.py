"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64-bit points; two documents are linked when their points differ in at most
``max_bits`` bits.  The anchors are the words of a covering code: the product of a Golay code on 23
bits (covering radius 3) and of repetition codes on the remaining bits (blocks of 9, 9, 9, 7 and 7
bits, covering radius 4 or 3), 2^17 anchors with covering radius 21 in all.  For very many points the
code ``"golay2"`` (two Golay blocks and two of 9 bits) has 2^26 anchors with covering radius 14.  All
blocks are perfect codes, so every point has one nearest anchor.

Let m(x) be x's distance to its nearest anchor, its *home* (the covering radius bounds m).  Every
fingerprint is replicated to all anchors within m(x) + max_bits.  For a linked pair with
m(x) <= m(y), x's home lies within m(x) + max_bits <= m(y) + max_bits of y, so y meets x at x's
home: no linked pair is lost.  At each anchor, home points are compared with all points there.

What keeps it even: equal fingerprints are merged before they are replicated (copies, however many,
are one point), anchors spread points by construction, and an anchor whose points are many is dealt
out as pairs of salted parts.  An anchor's links are reduced to a spanning forest where they are
found, so a dense group of n near copies sends at most n - 1 links for each anchor, never its pairs.
Components come from repeated label hooking and jumping over written tables (Spark joins); nothing
but counts reaches the driver.

Results for odd inputs: a null or empty text has no shingle and the fingerprint zero, linked like any
other; a text of fewer words than a shingle has its whole word sequence as the only shingle; texts of
any length are read whole; repeated rows are returned each; a null id takes part through the
smallest id of its fingerprint and never names a component unless all ids there are null; an empty
table gives an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textcohort.llm.common import doc_texts, materialize, partitions_for, text_array, tidy

WORDS, MAX_BITS, SEED = 3, 3, 42
#: Block lengths of a code; 23 stands for the Golay code, any other length for the repetition code.
CODES = {"golay1": (23, 9, 9, 9, 7, 7), "golay2": (23, 23, 9, 9)}
#: Beyond so many distinct fingerprints, the code with more anchors is used.
FINE_CODE_FROM = 40_000_000
#: Points of one anchor that a task compares at once; an anchor with more is dealt out in parts.
ANCHOR_POINTS = 20_000
#: Most heavy anchors that are broadcast; more of them are joined by a shuffle.
BROADCAST_ANCHORS = 1 << 17
#: An anchor is dealt out in at most 2^20 parts.
_PART_BITS = 20


# --- fingerprints ------------------------------------------------------------------------------

def shingle_hashes(text: str, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle, repeats included.  ``bytes.lower`` and ``bytes.split`` treat A-Z and
    the white space \\x20, \\x09-\\x0D only, whatever the locale."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) <= words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, seed) for s in shingles), np.uint64, max(1, len(found) - words + 1))


def fingerprint(hashes: np.ndarray, step: int = 1 << 16) -> int:
    """Bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), step):
        part = hashes[at:at + step].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(hashes))))


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """``(doc_id, fp)``: each document's fingerprint as a signed 64-bit integer; with ``digests`` also the
    ``digest`` (SHA-256) of its text."""
    more = ["digest"] if digests else []

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(shingle_hashes(t.as_py(), words, seed)) for t in text_array(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64)), *map(batch.column, more)], ["doc_id", "fp", *more])

    texts = doc_texts(docs, id_col, text_col)
    if digests:
        texts = texts.withColumn("digest", _digest(F.col("text")))
    return texts.mapInArrow(tidy(sign), "doc_id long, fp long" + ", digest binary" * digests)


# --- anchors -----------------------------------------------------------------------------------

@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, Callable]:
    """The perfect [23, 12] code, from its generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1: its words
    by number (the upper 12 bits), for each of the 2^11 syndromes the error of weight at most 3, and the
    function from points to syndromes."""
    poly = 0b110001110101

    def remainder(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.int64).copy()
        for bit in range(22, 10, -1):
            x ^= np.where(x >> bit & 1, poly << (bit - 11), 0)
        return x

    words = np.arange(4096, dtype=np.int64) << 11
    words |= remainder(words)
    errors = np.zeros(2048, np.int64)
    flips = [sum(1 << b for b in c) for k in range(4) for c in itertools.combinations(range(23), k)]
    flips = np.array(flips, np.int64)
    errors[remainder(flips)] = flips
    return words, errors, remainder


@lru_cache(maxsize=4)
def golay_near(slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome the words near a point with that error, relative to its nearest word: the
    start of its entries, the words' numbers (a word's number is its upper 12 bits) and how much
    farther than the nearest they are, at most ``slack``."""
    words, errors, _ = golay()
    start, number, extra = [0], [], []
    for e in errors.tolist():
        more = np.bitwise_count(words ^ e).astype(np.int64) - e.bit_count()
        near = np.flatnonzero(more <= slack)
        number.append(near)
        extra.append(more[near])
        start.append(start[-1] + len(near))
    return np.array(start), np.concatenate(number), np.concatenate(extra)


def block_options(x: np.ndarray, length: int, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each point of a block its near words: row of the point, the word's number, how much
    farther than the nearest it is; and the bits of a number.  The nearest comes first."""
    rows = np.arange(len(x))
    if length == 23:
        words, errors, remainder = golay()
        syndrome = remainder(x)
        home = (x ^ errors[syndrome]) >> 11
        start, number, extra = golay_near(slack)
        n = start[syndrome + 1] - start[syndrome]
        row = np.repeat(rows, n)
        take = np.repeat(start[syndrome] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(len(row))
        return row, home[row] ^ number[take], extra[take], 12
    ones = np.bitwise_count(x).astype(np.int64)
    near = (2 * ones > length).astype(np.int64)
    gap = np.abs(length - 2 * ones)
    other = np.flatnonzero(gap <= slack)
    return (np.concatenate((rows, other)), np.concatenate((near, 1 - near[other])),
            np.concatenate((np.zeros(len(x), np.int64), gap[other])), 1)


def anchors(fps: np.ndarray, code: tuple[int, ...], slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ``(index of the point, anchor, is the home)``: every anchor that is at most ``slack``
    farther from the point than its nearest one.

    Blocks are independent, so distances add up; ties of a block go to the smaller option, and the
    home is the combination of the first nearest word of each block."""
    row = np.arange(len(fps))
    anchor = np.zeros(len(fps), np.int64)
    extra = np.zeros(len(fps), np.int64)
    home = np.ones(len(fps), bool)
    at = 0
    for length in code:
        x = (fps >> np.uint64(at) & np.uint64((1 << length) - 1)).astype(np.int64)
        at += length
        r, number, more, bits = block_options(x, length, slack)
        order = np.lexsort((number, more, r))
        r, number, more = r[order], number[order], more[order]
        start = np.searchsorted(r, np.arange(len(fps) + 1))
        n = (start[1:] - start[:-1])[row]
        old = np.repeat(np.arange(len(row)), n)
        offset = np.arange(len(old)) - np.repeat(np.concatenate(([0], np.cumsum(n)))[:-1], n)
        take = start[row[old]] + offset
        total = extra[old] + more[take]
        ok = total <= slack
        old, take, offset = old[ok], take[ok], offset[ok]
        row, anchor, extra, home = row[old], anchor[old] << bits | number[take], total[ok], home[old] & (offset == 0)
    if at != 64:
        raise ValueError("the block lengths of a code add up to 64")
    return row, anchor, home


# --- links -------------------------------------------------------------------------------------

class Forest:
    """Union-find over the points of one anchor."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def linked(homes: np.ndarray, points: np.ndarray, max_bits: int, step: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between home points and all points of an anchor, as pairs of
    fingerprints; compared in blocks of at most ``step`` differences."""
    values, where = np.unique(np.concatenate((homes, points)), return_inverse=True)
    a, b = where[:len(homes)], where[len(homes):]
    forest, rows = Forest(len(values)), max(1, step // max(1, len(points)))
    for at in range(0, len(a), rows):
        near = np.bitwise_count(homes[at:at + rows, None] ^ points[None, :]) <= max_bits
        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            if forest.join(int(a[at + i]), int(b[j])):
                yield int(values[a[at + i]]), int(values[b[j]])


def replicated(points: DataFrame, code: str, max_bits: int) -> DataFrame:
    """``(fp, anchor, home)`` for each distinct fingerprint and each anchor that it goes to."""
    blocks = CODES[code]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 2048):
                part = fps[at:at + 2048]
                row, anchor, home = anchors(part, blocks, max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(part[row].view(np.int64)), pa.array(anchor), pa.array(home)], ["fp", "anchor", "home"])

    return points.mapInArrow(tidy(spread), "fp long, anchor long, home boolean")


def links(points: DataFrame, max_bits: int = MAX_BITS, code: str = "golay1", anchor_points: int = ANCHOR_POINTS) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints that connect all points within ``max_bits``.

    An anchor with more than ``anchor_points`` points is cut into p parts by a hash of the
    fingerprint; its home points go to their own part, all points to each of the p parts."""
    spark = points.sparkSession
    n = partitions_for(spark)
    rows = replicated(points.repartition(n), code, max_bits)
    sized = materialize(rows, "anchor-points")
    heavy = (sized.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > anchor_points)
             .select("anchor", F.ceil(F.col("n") / anchor_points).cast("int").alias("parts")))
    # at most (replicated points) / anchor_points rows of two numbers: broadcast where that is few
    few = heavy.count() <= BROADCAST_ANCHORS
    dealt = (sized.join(F.broadcast(heavy) if few else heavy, "anchor", "left")
             .withColumn("parts", F.coalesce("parts", F.lit(1)))
             .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select((F.shiftleft("anchor", _PART_BITS) + F.col("part")).alias("place"), "fp",
                     (F.col("home") & (F.col("own") == F.col("part"))).alias("home"))
             .repartition(n, "place").sortWithinPartitions("place"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def found(place: np.ndarray, fps: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
            edges: list[tuple[int, int]] = []
            bounds = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1, [len(place)]))
            homes = np.add.reduceat(home, bounds[:-1])
            for k in np.flatnonzero((homes > 0) & (np.diff(bounds) > 1)).tolist():
                s = slice(bounds[k], bounds[k + 1])
                edges += linked(fps[s][home[s]], fps[s], max_bits)
            ab = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("place", "fp", "home")]
            cols[1] = cols[1].view(np.uint64)
            held.append(cols)
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if cut:  # groups before the batch's last one are complete
                ready = [np.concatenate([h[i] for h in held[:-1]] + [cols[i][:cut]]) for i in range(3)]
                held = [[c[cut:] for c in cols]]
                yield found(*ready)
        if held:
            yield found(*[np.concatenate([h[i] for h in held]) for i in range(3)])

    return dealt.mapInArrow(tidy(compare), "a long, b long").distinct()


# --- components --------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of a link table: the smallest node that it can reach.

    Every round, each node's neighbours are hooked to the smallest node next to it (first those
    above the node, then all), until nothing changes; chains shorten by a constant factor, so rounds
    grow with the logarithm of the longest chain.  Each round is a written table; a hot node's
    neighbours are grouped after partial aggregation only."""
    current = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = materialize(large, "large-star")
        down = large.filter("u > v")
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(lowest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").filter("u <> v").distinct())
        following = materialize(small, "small-star")
        # a fixed point is a forest of stars: every link goes to a node that is no link's upper end
        moved = following.join(following.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        dup = following.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
        current = following
        if not moved and not dup:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _grouped(signed: DataFrame, max_bits: int, code: str | None) -> DataFrame:
    """The rows of ``signed`` (with ``doc_id`` and ``fp``) with their group: ``root``, a fingerprint that
    only this group has, and ``component_id``."""
    points = signed.groupBy("fp").agg(F.min("doc_id").alias("first"))
    if code is None:
        code = "golay1" if points.count() < FINE_CODE_FROM else "golay2"
    tree = components(links(points.select("fp"), max_bits, code))
    rooted = points.join(tree, points["fp"] == tree["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # narrow rows; a fingerprint or a component with many documents is split by AQE's skew join
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    return signed.join(named, "fp")


def simhash_groups(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS, seed: int = SEED, code: str | None = None,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits) and ``component_id`` (the smallest
    doc_id reachable over links of at most ``max_bits`` differing bits)."""
    signed = materialize(fingerprints(docs, words, seed, id_col, text_col), "fingerprints")
    return _grouped(signed, max_bits, code).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def drop_near_copies(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with all its columns.  Rows that
    repeat that doc_id within the group (or all have none) are told apart by nothing but their text; the
    first stays.  Rows meet their group by id and digest, so an id that several groups have is a head in
    each of them."""
    signed = materialize(fingerprints(docs, words, digests=True), "fingerprints")
    heads = (_grouped(signed, max_bits, None).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
             .select("root", F.col("doc_id").alias("_head"), "digest").distinct())
    # the row travels as one struct, whatever its columns are called
    named = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), _digest(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_sha"))
    nth = F.row_number().over(Window.partitionBy("root").orderBy(F.col("_row.text").asc_nulls_first()))
    met = named.join(heads, F.col("_id").eqNullSafe(F.col("_head")) & (F.col("_sha") == F.col("digest")))
    return met.select("_row", "root").withColumn("_nth", nth).filter("_nth = 1").select("_row.*")
