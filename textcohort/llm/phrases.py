"""Phrase collocations by direct-address tiling of frequency-ranked pairs.

1. **Ranks.**  The words of a language that occur at least ``least`` times are numbered by falling frequency.  No other
   word can be in a phrase that frequent, and frequent words get small numbers.
2. **Tiles.**  A pair of neighbours is a cell of the square of ranks, which is cut into tiles.  The tiles of the first
   ``DENSE`` ranks hold most pairs: each is counted with one ``bincount`` over its addresses.  All other tiles are
   sparse: their cells are sorted coordinates with counts.  Blocks of texts send each tile (sparse ones together by hash
   part) one row; counts are added up there, a dense tile's in salted parts of a bounded number of blocks.
3. **Recursion.**  Frequent pairs are ranked by frequency again and sent back to the blocks, where a pair is now one unit: a unit
   and the word after it make the cells of the next length, up to four words.  A longer phrase can only be frequent if
   the two phrases without its last and first word are.
4. **Scores.**  Counts, cuts, containment and the report are joins and aggregations of the frequent phrases.

Products are decimals of up to 38 digits.  Results for odd inputs: a null or empty text has no pieces; texts of any length are
counted whole (in parts with three words of context); equal and repeated rows count each; a null lang is ``und``; an empty
table, or one without frequent phrases, gives an empty result; ties are broken as stated, by the bytes of
the phrase at last.  Only the text and lang columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textcohort.llm.common import materialize, tidy
from textcohort.llm.gram_exchange import PART_GRAMS, ROWS, by, encode, local_ids, merge_words, rows_of, table, words_parts, written
from textcohort.llm.katz import _mix
from textcohort.llm.word_blocks import LONG_TEXT, byte_class, pack, unpack, unpack_words
from textcohort.operators.index import ordered_index

LEAST, LONGEST, TOP = 30, 4, 2_000
#: Ranks on the side of a tile, and ranks whose tiles are dense.
SIDE, DENSE = 512, 2048
#: Blocks whose rows of one dense tile meet in one group.
TOGETHER = 64
BLOCK = 16 << 20

WORD = byte_class(rb"[^\x20\x09.,;:!?\x0A-\x0D]")
BREAK = byte_class(rb"[.,;:!?\x0A-\x0D]")


class Units:
    """A block's words as ranks, and the phrases of each length that are known to be frequent."""

    def __init__(self, row: dict, group: pa.Table, lengths: int, parts: int):
        _, ranks, _ = local_ids(group, "ranks1", np.int64)
        number = unpack(row["a"], np.int32)
        self.rank = np.concatenate(([-1], ranks))[np.abs(number)]
        lens = unpack(row["b"], np.int32)
        heads = np.cumsum(lens) - lens
        edge = number < 0
        edge[heads[lens > 0]] = True
        self.piece = np.cumsum(edge)
        self.new = np.ones(len(number), bool)
        held = unpack(row["f"], np.int32)
        for i in np.flatnonzero(held):
            self.new[heads[i]:heads[i] + held[i]] = False
        self.parts = parts
        unit = self.rank
        for m in range(2, lengths):
            cell = self.cells(unit, m)[0]
            _, found, _ = local_ids(group, f"ranks{m}", np.int64)
            unit = np.concatenate((found, [-1]))[cell]
        self.unit = unit

    def cells(self, unit: np.ndarray, m: int) -> tuple:
        """``(cell of the phrase of m words that starts at each word or -1, parts, cells, counts)``; cells by part, ascending.
        ``unit``: the rank of the phrase of m - 1 words that starts there, or -1."""
        n = max(len(unit) - m + 1, 0)
        i, j = unit[:n], self.rank[m - 1:]
        # the phrase without its first word begins at the next word
        ok = (i >= 0) & (j >= 0) & (unit[1:n + 1] >= 0) & (self.piece[:n] == self.piece[m - 1:]) if m > 2 else (i >= 0) & (j >= 0) & (self.piece[:n] == self.piece[m - 1:])
        at = np.flatnonzero(ok)
        i, j, new = i[at], j[at], self.new[m - 1:][at]
        cell = np.full(len(unit), -1)
        parts, codes, counts, first = [], [], [], 0
        dense = (i < DENSE) & (j < DENSE)
        tile = np.where(dense, (i // SIDE) * (DENSE // SIDE) + j // SIDE, -1)
        order = np.argsort(tile.astype(np.int16), kind="stable")
        ends = np.searchsorted(tile[order], np.arange((DENSE // SIDE) ** 2 + 1))
        for t in np.unique(tile[order[ends[0]:]]).tolist():
            take = order[ends[t]:ends[t + 1]]
            address = (i[take] % SIDE) * SIDE + j[take] % SIDE
            seen = np.flatnonzero(np.bincount(address, minlength=SIDE * SIDE))
            place = np.empty(SIDE * SIDE, np.int64)
            place[seen] = np.arange(len(seen))
            cell[at[take]] = first + place[address]
            first += len(seen)
            parts.append(np.full(len(seen), -1 - t))
            codes.append((t // (DENSE // SIDE) * SIDE + seen // SIDE) << 32 | (t % (DENSE // SIDE) * SIDE + seen % SIDE))
            counts.append(np.bincount(address[new[take]], minlength=SIDE * SIDE)[seen])
        take = order[:ends[0]]
        kinds, which = np.unique(i[take] << 32 | j[take], return_inverse=True)
        part = sparse_part(kinds, self.parts)
        by_part = np.argsort(part, kind="stable")
        place = np.empty(len(kinds), np.int64)
        place[by_part] = np.arange(len(kinds))
        cell[at[take]] = first + place[which]
        parts.append(part[by_part])
        codes.append(kinds[by_part])
        counts.append(np.bincount(which[new[take]], minlength=len(kinds))[by_part])
        return cell, np.concatenate(parts), np.concatenate(codes).astype(np.int64), np.concatenate(counts).astype(np.int64)


def sparse_part(codes: np.ndarray, parts: int) -> np.ndarray:
    """The part of a sparse tile's cells."""
    i, j = (codes >> 32) // SIDE, (codes & 0xFFFFFFFF) // SIDE
    return (_mix(i * 1_000_003 + j) % np.uint64(parts)).astype(np.int64)


def frequent_phrases(texts: DataFrame, least: int = LEAST, longest: int = LONGEST, max_bytes: int = BLOCK, limit: int = LONG_TEXT, part_grams: int = PART_GRAMS,
                     together: int = TOGETHER) -> tuple[DataFrame, DataFrame]:
    """``(grp, length, phrase, f)`` of every run of 1 to ``longest`` words of a piece that occurs at least ``least`` times, and ``(grp, n)``
    the words of each group.  ``texts``: ``(doc_id, text, grp)``."""
    encoded = encode(texts.withColumn("marked", F.lit(True)), words_parts(texts), WORD, BREAK, longest - 1, max_bytes, limit)
    places = merge_words(encoded, 0, least)
    sizes = places.filter("kind = 'stats'").groupBy("grp").agg(F.sum(F.col("nums")[1]).alias("n"))
    count = encoded.filter("kind = 'tokens'").groupBy("grp").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.col("nums")[1]).alias("n"))
    most = count.agg(F.max("blocks").alias("blocks"), F.max("n").alias("n")).first()
    parts, salts = max(1, -(-(most.n or 0) // part_grams)), max(1, -(-(most.blocks or 0) // together))
    singles = _ranked_words(places)
    answers = _word_ranks(places, singles)
    known = {1: singles.select("grp", "rank", "phrase", "f")}
    tokens = encoded.filter("kind = 'tokens'")
    for m in range(2, longest + 1):
        cells = written(_cells(tokens.unionByName(answers), m, parts, salts), f"phrase-cells{m}")
        grams = _ranked_cells(cells, least, salts, together)
        if m < longest:
            answers = answers.unionByName(_cell_ranks(cells, grams, m, salts, parts))
        left = known[m - 1].select("grp", F.col("rank").alias("i"), F.col("phrase").alias("left"))
        right = known[1].select("grp", F.col("rank").alias("j"), F.col("phrase").alias("right"))
        named = grams.join(left, ["grp", "i"]).join(right, ["grp", "j"])
        known[m] = materialize(named.select("grp", "rank", F.concat_ws(" ", "left", "right").alias("phrase"), "f"), f"phrases{m}")
    out = None
    for m, found in known.items():
        rows = found.select("grp", F.lit(m).alias("length"), "phrase", "f")
        out = rows if out is None else out.unionByName(rows)
    return out, sizes


def _ranked_words(places: DataFrame) -> DataFrame:
    """``(grp, part, place, phrase, f, rank)`` of the frequent words."""
    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = unpack_words(row["a"])
                n = len(words)
                yield pa.RecordBatch.from_arrays([pa.array([row["grp"]] * n, pa.string()), pa.array([row["part"]] * n, pa.int32()), pa.array(np.arange(n)), words.cast(pa.string()),
                                                  pa.array(-unpack(row["b"], np.int64))], ["grp", "part", "place", "phrase", "less"])

    rows = places.filter("kind = 'vocabulary'").select("grp", "part", "a", "b").mapInArrow(tidy(unfold), "grp string, part int, place long, phrase string, less long")
    return ordered_index(rows, ["grp"], ["less", "phrase"], out="rank").select("grp", "part", "place", "phrase", (-F.col("less")).alias("f"), "rank")


def _word_ranks(places: DataFrame, singles: DataFrame) -> DataFrame:
    """Rows ``ranks1``: to each block, in the order of its words, their ranks."""
    def answer(key: tuple, ranks: pa.Table, asked: pa.Table) -> pa.Table:
        rank = np.full(len(ranks) + 1, -1)
        rank[ranks["place"].to_numpy()] = ranks["rank"].to_numpy()
        return table([{"kind": "ranks1", "grp": r["grp"], "block": r["block"], "part": r["part"], "a": pack(rank[unpack(r["a"], np.int32)].astype(np.int64))} for r in rows_of("ids", asked)])

    asked = places.filter("kind = 'ids'").groupBy("grp", "part")
    return written(singles.select("grp", "part", "place", "rank").groupBy("grp", "part").cogroup(asked).applyInArrow(answer, ROWS), "phrase-ranks1")


def _cells(rows: DataFrame, m: int, parts: int, salts: int) -> DataFrame:
    """Rows ``cells``: a block's cells of one part (dense tiles have negative numbers and a salt, in ``nums``) and their counts."""
    def send(key: tuple, group: pa.Table) -> pa.Table:
        out = []
        for row in rows_of("tokens", group):
            units = Units(row, group, m, parts)
            _, part, codes, counts = units.cells(units.unit, m)
            ends = np.flatnonzero(np.diff(part, prepend=np.iinfo(np.int64).min, append=np.iinfo(np.int64).max))
            salt = int(_mix(np.array([row["block"]]))[0] % np.uint64(salts))
            out += [{"kind": "cells", "grp": row["grp"], "block": row["block"], "part": int(part[a]), "nums": [salt if part[a] < 0 else 0], "a": pack(codes[a:b]), "b": pack(counts[a:b])}
                    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return table(out)

    return by(rows, ["grp", "block"], send)


def _ranked_cells(cells: DataFrame, least: int, salts: int, together: int) -> DataFrame:
    """``(grp, part, code, i, j, f, rank)`` of the frequent cells.  A dense tile's sums are added up as a tree: each group has
    the rows of about ``together`` blocks or sums."""
    rows = cells.select("grp", "part", F.col("nums")[0].alias("salt"), "a", "b")
    while salts > 1:
        salts = -(-salts // together)
        rows = (rows.groupBy("grp", "part", "salt").applyInArrow(_summed(least, False), "grp string, part int, salt long, a binary, b binary")
                .withColumn("salt", F.when(F.col("part") < 0, F.pmod("salt", F.lit(salts))).otherwise(0)))
    found = rows.groupBy("grp", "part", "salt").applyInArrow(_summed(least, True), "grp string, part int, code long, f long")
    place = ordered_index(found.withColumn("less", -F.col("f")), ["grp"], ["less", "code"], out="rank")
    return place.select("grp", "part", "code", F.shiftright("code", 32).alias("i"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).alias("j"), "f", "rank")


def _summed(least: int, last: bool):
    """Adds up the cells of one tile or part.  At the last step, one row per frequent cell; before, one row of sums (a sparse part
    is complete after the first step, so its rare cells end there)."""
    def add(key: tuple, group: pa.Table) -> pa.Table:
        grp, part, salt = (k.as_py() for k in key)
        codes, counts = ([unpack(x, np.int64) for x in group[c].to_pylist()] for c in "ab")
        if part < 0:
            # one address per cell of the tile
            t, total = -1 - part, np.zeros(SIDE * SIDE, np.int64)
            for code, n in zip(codes, counts, strict=True):
                total[((code >> 32) % SIDE) * SIDE + (code & 0xFFFFFFFF) % SIDE] += n
            seen = np.flatnonzero(total)
            kinds, f = (t // (DENSE // SIDE) * SIDE + seen // SIDE) << 32 | (t % (DENSE // SIDE) * SIDE + seen % SIDE), total[seen]
        else:
            kinds, which = np.unique(np.concatenate(codes), return_inverse=True)
            f = np.bincount(which, np.concatenate(counts), len(kinds)).astype(np.int64)
        keep = f >= (least if last or part >= 0 else 1)
        kinds, f = kinds[keep], f[keep]
        if last:
            return pa.table({"grp": pa.array([grp] * len(f), pa.string()), "part": pa.array([part] * len(f), pa.int32()), "code": kinds, "f": f})
        return pa.table({"grp": [grp], "part": pa.array([part], pa.int32()), "salt": pa.array([salt], pa.int64()), "a": pa.array([pack(kinds)], pa.binary()), "b": pa.array([pack(f)], pa.binary())})

    return add


def _cell_ranks(cells: DataFrame, grams: DataFrame, m: int, salts: int, parts: int) -> DataFrame:
    """Rows ``ranks<m>``: to each block, in the order of its cells, their ranks or -1."""
    def answer(key: tuple, ranks: pa.Table, asked: pa.Table) -> pa.Table:
        codes, rank = ranks["code"].to_numpy(), ranks["rank"].to_numpy()
        order = np.argsort(codes)
        codes, rank = np.concatenate((codes[order], [np.iinfo(np.int64).max])), np.concatenate((rank[order], [-1]))
        out = []
        for r in rows_of("cells", asked):
            own = unpack(r["a"], np.int64)
            at = np.searchsorted(codes, own)
            # dense tiles stand before the sparse parts in a block's order of cells
            out.append({"kind": f"ranks{m}", "grp": r["grp"], "block": r["block"], "part": dense_first(r["part"]), "a": pack(np.where(codes[at] == own, rank[at], -1))})
        return table(out)

    # a dense tile's frequent cells (at most one tile) go to each of its salted groups
    salted = F.when(F.col("part") < 0, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))).cast("array<long>")
    spread = grams.select("grp", "part", F.explode(salted).alias("salt"), "code", "rank").groupBy("grp", "part", "salt")
    asked = cells.select("kind", "grp", "block", "part", F.col("nums")[0].alias("salt"), "a").groupBy("grp", "part", "salt")
    return written(spread.cogroup(asked).applyInArrow(answer, ROWS), f"phrase-ranks{m}")


def dense_first(part: int) -> int:
    """Parts in the order of a block's cells: dense tiles by number, then sparse parts."""
    tiles = (DENSE // SIDE) ** 2
    return -1 - part if part < 0 else tiles + part


def _exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(28,0)")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", **sizes) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases."""
    texts = docs.select(F.lit(None).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("grp"))
    known, sizes_of = frequent_phrases(texts, least, longest, **sizes)
    known = materialize(known, "phrases")
    phrases = known.filter("length > 1").withColumnRenamed("f", "a")
    # cuts: both sides of a frequent phrase are frequent
    cut = phrases.select("grp", "phrase", "a", "length", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cut = cut.select("grp", "phrase", "a", "length", "k", F.expr("substring_index(phrase, ' ', k)").alias("left"), F.expr("substring_index(phrase, ' ', k - length)").alias("right"))
    sides = known.select("grp", "phrase", "f")
    cut = cut.join(sides.toDF("grp", "left", "l"), ["grp", "left"]).join(sides.toDF("grp", "right", "r"), ["grp", "right"])
    score = F.expr("cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").cast("long")
    scored = (cut.withColumn("score", score).groupBy("grp", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
              .select("grp", "phrase", "a", "best.score", "best.l", "best.r"))
    # the most frequent longer phrase that holds each shorter one
    spans = phrases.filter("length > 2").select("grp", F.col("a").alias("outer"), F.split("phrase", " ").alias("w"), "length")
    spans = spans.select("grp", "outer", "w", "length", F.explode(F.sequence(F.lit(2), F.col("length") - 1)).alias("size"))
    spans = spans.select("grp", "outer", "w", "size", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("size") + 1)).alias("at"))
    held = spans.groupBy("grp", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("outer").alias("outer"))
    kept = scored.join(held, ["grp", "phrase"], "left").filter(F.col("outer").isNull() | (_exact("outer") * 100 < _exact("a") * 80))
    best = Window.partitionBy("grp").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(sizes_of, "grp").select(F.col("grp").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")
