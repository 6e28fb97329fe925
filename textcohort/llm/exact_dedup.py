"""Exact deduplication by content sort, in DataFrame operations only.

1. Sample sort keys and take splitters from them.  A key is ``(prefix, digest, doc_id)``: the
   first bytes of the normalised text, its SHA-256 and the document id, so a splitter is small
   whatever the text, equal texts are adjacent, and a group of copies that is larger than a
   partition is *cut by doc_id* over as many partitions as it needs.
2. Every row finds its range by a binary search in the splitters, and one exchange deals the
   texts to the ranges.  This is the only time that texts move.
3. Each range is sorted (Spark's external sort) and every row compares its whole text with its
   predecessor's.  A change of text starts a run; the largest doc_id of a run stays.
4. Only a text that one of the splitters has can lie in several ranges.  Its partial runs, at
   most one per range and splitter text, are merged in a table whose size is bounded by the
   number of splitters, and that table is broadcast to correct those rows.

Results for odd inputs: a null text counts as empty; empty texts are one group; rows that repeat
a ``doc_id`` with equal text are one group in which exactly one row is kept (``kept`` is true for
one row only); a null ``doc_id`` sorts below every other; an empty table gives an empty result.
Other columns are not read.  Very long texts only cost their own bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textcohort.llm.common import ascii_lower, doc_texts, materialize, partitions_for

PREFIX_CHARS = 32
#: Sampled keys per range: the ranges then differ by a few per cent.
SAMPLE_PER_RANGE = 60
#: Ranges per shuffle partition, so that hashing ranges to partitions stays even.
RANGES_PER_PARTITION = 2


def _sort_key() -> Column:
    # a null doc_id takes the place below all others
    return F.struct(F.substring("norm", 1, PREFIX_CHARS).alias("p"), F.col("text_sha256").alias("h"),
                    F.coalesce(F.col("doc_id"), F.lit(-(2 ** 63))).alias("d"))


def normalised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, norm, text_sha256)`` with ``norm`` the text in which A-Z are lower-cased."""
    return (doc_texts(docs, id_col, text_col)
            .select("doc_id", ascii_lower(F.col("text")).alias("norm"))
            .withColumn("text_sha256", F.sha2(F.encode("norm", "UTF-8"), 256)))


def splitters(docs: DataFrame, ranges: int, id_col: str = "doc_id", text_col: str = "text") -> list:
    """At most ``ranges - 1`` sort keys that cut a random sample of rows into equal parts.

    The driver gets ``SAMPLE_PER_RANGE * ranges`` keys of at most about 200 bytes; splitters decide
    only where a row is compared, never what it is compared with."""
    rows = docs.count()
    wanted = SAMPLE_PER_RANGE * ranges
    picked = docs if rows <= wanted else docs.sample(fraction=min(1.0, wanted / rows), seed=17)
    keys = normalised(picked, id_col, text_col).select(_sort_key().alias("k")).sort("k").collect()
    cuts = [keys[len(keys) * i // ranges].k for i in range(1, ranges)] if keys else []
    return sorted(set(cuts))


def _literal(key) -> Column:
    return F.struct(F.lit(key.p).alias("p"), F.lit(key.h).alias("h"), F.lit(key.d).alias("d"))


def _range_of(cuts: list) -> Column:
    """How many splitters are not above the row's key: a binary search with falling steps."""
    if not cuts:
        return F.lit(0)
    step = 1 << (len(cuts).bit_length() - 1)
    steps = [step >> i for i in range(step.bit_length())]
    table, n = F.array(*[_literal(c) for c in cuts]), len(cuts)

    def move(at: Column, by: Column) -> Column:
        fits = (at + by <= n) & (F.get(table, at + by - 1) <= F.col("key"))
        return F.when(fits, at + by).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), move)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                ranges: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep_id`` is the largest doc_id among the rows with an equal normalised text."""
    spark = docs.sparkSession
    parts = partitions_for(spark)
    ranges = ranges or RANGES_PER_PARTITION * parts
    cuts = splitters(docs, ranges, id_col, text_col)
    dealt = (normalised(docs, id_col, text_col)
             .withColumn("key", _sort_key())
             .withColumn("range", _range_of(cuts))
             .withColumn("prefix", F.col("key.p"))
             .drop("key")
             .repartition(parts, "range"))
    # the sort on (prefix, digest) decides nearly every comparison on a few bytes
    order = Window.partitionBy("range").orderBy("prefix", "text_sha256", "norm", F.col("doc_id").asc_nulls_first())
    runs = (dealt
            .withColumn("new", (~F.col("norm").eqNullSafe(F.lag("norm").over(order))).cast("long"))
            .withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("nth", F.row_number().over(order))
            .select("doc_id", "text_sha256", "range", "run", "nth"))
    whole = Window.partitionBy("range", "run")
    local = (runs
             .withColumn("keep_id", F.max("doc_id").over(whole))
             .withColumn("group_size", F.count(F.lit(1)).over(whole))
             .withColumn("last", F.col("nth") == F.max("nth").over(whole))
             .drop("nth"))
    if not cuts:
        return _result(local.withColumn("winner", F.col("last")))
    local = materialize(local, "content-sort")
    edge = list(dict.fromkeys(c.h for c in cuts))
    # partial runs of texts that a splitter has: at most one row per range and splitter text
    parts_of = (local.filter(F.col("text_sha256").isin(edge) & F.col("last"))
                .select("text_sha256", "range", "keep_id", "group_size"))
    merged = (parts_of.groupBy("text_sha256")
              .agg(F.max("keep_id").alias("all_keep"), F.sum("group_size").alias("all_size"),
                   F.max(F.struct(F.coalesce("keep_id", F.lit(-(2 ** 63))), "range"))["range"].alias("at")))
    # len(edge) rows at most, fixed by the number of ranges
    fixed = local.join(F.broadcast(merged), "text_sha256", "left")
    return _result(fixed.select(
        "doc_id", F.coalesce("all_keep", "keep_id").alias("keep_id"),
        F.coalesce("all_size", "group_size").alias("group_size"),
        (F.col("last") & (F.col("at").isNull() | (F.col("at") == F.col("range")))).alias("winner"),
        "text_sha256"))


def _result(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                     F.col("winner").alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    The decisions are narrow; they meet the texts in one join on ``(doc_id, digest)``.  Rows that
    repeat a doc_id with equal text share that key, and the first of them by text stays."""
    lowest = F.lit(-(2 ** 63))
    kept = (exact_dedup(docs).filter("kept")
            .select(F.coalesce("doc_id", lowest).alias("_id"), F.col("text_sha256").alias("_sha")))
    text = F.coalesce(F.col("text"), F.lit(""))
    # the row travels as one struct, whatever its columns are called
    named = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), lowest).alias("_id"),
                        F.sha2(F.encode(ascii_lower(text), "UTF-8"), 256).alias("_sha"))
    same = Window.partitionBy("_id", "_sha").orderBy(F.col("_row.text").asc_nulls_first())
    return (named.join(kept, ["_id", "_sha"], "left_semi")
            .withColumn("_nth", F.row_number().over(same)).filter("_nth = 1").select("_row.*"))
