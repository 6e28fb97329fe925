"""Exact positions within groups without putting a whole group into one task.

``Window.orderBy`` without a partition, or partitioned only by a handful of folds, sends a
whole fold to one task.  Three exact replacements:

* ``hash_index`` – 0-based position in ``(hash, id)`` order.  The first hex digits of an md5
  give a bucket that is monotone in the order and uniform by construction, so per-bucket
  counts -> running offsets (at most ``16**bucket_hex`` rows per group) -> ``row_number`` inside
  each (group, bucket) is balanced whatever the group sizes.
* ``hash_head`` – flag the first ``floor(ratio * n)`` rows of each group in ``(hash, id)`` order.
  Only the one bucket that straddles the cut is ranked; all other rows are decided from the
  bucket counts alone.
* ``ordered_index`` – 0-based position in an arbitrary order (scores with ties, ids).  Range
  partitioning on ``(group, order..., id)`` spreads even a single hot group or a heavy tie over
  many tasks; each partition is sorted, numbered, and offset by the counts of the partitions
  before it.  The numbered rows are written to the shared checkpoint folder first, so
  recomputation after a lost executor cannot see different sampled range bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textcohort.sources.io import materialize


def _bucket(hash_col: str, bucket_hex: int) -> Column:
    return F.conv(F.substring(F.col(hash_col), 1, bucket_hex), 16, 10).cast("long")


def md5_key(*parts) -> Column:
    """md5 hex of the parts joined by ``:`` — the portable seeded order key (DuckDB: md5)."""
    cols = []
    for i, p in enumerate(parts):
        if i:
            cols.append(F.lit(":"))
        cols.append((F.col(p) if isinstance(p, str) else p).cast("string"))
    return F.md5(F.concat(*cols))


def md5_int(*parts, hex_digits: int = 15) -> Column:
    """Non-negative integer from the leading hex digits of ``md5_key`` (uniform draws)."""
    return F.conv(F.substring(md5_key(*parts), 1, hex_digits), 16, 10).cast("long")


def hash_index(df: DataFrame, group_cols: Sequence[str], hash_col: str, id_col: str,
               out: str = "idx", bucket_hex: int = 4) -> DataFrame:
    """Exact 0-based position of every row in ``(hash_col, id_col)`` order within its group.

    ``hash_col`` is an md5 hex string (uniform), so the ``(group, bucket)`` windows are balanced.
    """
    g = list(group_cols)
    x = df.withColumn("_b", _bucket(hash_col, bucket_hex))
    counts = x.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*g, "_b", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy(*g, "_b").orderBy(hash_col, id_col)
    x = x.withColumn("_rn", F.row_number().over(within))
    return (x.join(offsets, [*g, "_b"])
             .withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("long"))
             .drop("_b", "_off", "_rn"))


def hash_head(df: DataFrame, group_cols: Sequence[str], hash_col: str, id_col: str,
              ratio: float, out: str = "head", bucket_hex: int = 4) -> DataFrame:
    """Flag ``out`` = the row is among the first ``floor(ratio * n)`` of its group in
    ``(hash_col, id_col)`` order.  ``group_cols`` are folds (the cut table is broadcast)."""
    g = list(group_cols)
    x = df.withColumn("_b", _bucket(hash_col, bucket_hex))
    counts = x.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    upto = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*g)
    counts = (counts
              .withColumn("_cum", F.sum("_cnt").over(upto))
              .withColumn("_n", F.sum("_cnt").over(whole))
              # same double arithmetic as int(ratio * n) in Python
              .withColumn("_k", F.floor(F.lit(float(ratio)) * F.col("_n").cast("double")).cast("long"))
              .withColumn("_before", F.col("_cum") - F.col("_cnt")))
    # one row per group: the bucket that holds the k-th row and how many of it are needed
    cut = counts.filter((F.col("_before") < F.col("_k")) & (F.col("_cum") >= F.col("_k"))) \
                .select(*g, F.col("_b").alias("_cb"), (F.col("_k") - F.col("_before")).alias("_need"))
    # at most one row per group (groups = folds, a parameter): a bounded broadcast
    x = x.join(F.broadcast(cut), g, "left")
    decided = x.filter(F.col("_cb").isNull() | (F.col("_b") != F.col("_cb"))) \
               .withColumn(out, F.coalesce(F.col("_b") < F.col("_cb"), F.lit(False)))
    edge = x.filter(F.col("_b") == F.col("_cb"))
    w = Window.partitionBy(*g).orderBy(hash_col, id_col)
    edge = edge.withColumn(out, F.row_number().over(w) <= F.col("_need"))
    return decided.unionByName(edge).drop("_b", "_cb", "_need")


def ordered_index(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence, out: str = "idx",
                  num_partitions: int | None = None, count_out: str | None = None, spread: str | None = None) -> DataFrame:
    """0-based position of each row inside its group in ``order_cols`` order (ascending).

    With ``spread``, an array column, the rows that are numbered are its elements, in their order.

    ``order_cols`` must make the order total (end with a unique id).  ``group_cols`` are
    low-cardinality (folds); the per-partition offset table is broadcast.  Optionally also
    returns the group size in ``count_out``.
    """
    g = list(group_cols)
    keys = [*g, *order_cols]
    # without an explicit count AQE may merge neighbouring ranges (order is kept)
    ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    ordered = ranged.sortWithinPartitions(*keys)
    if spread:
        ordered = ordered.withColumn(spread, F.explode(spread))
    numbered = (ordered
                  .withColumn("_pid", F.spark_partition_id())
                  .withColumn("_mid", F.monotonically_increasing_id()))
    numbered = materialize(numbered, "ordered-index")
    # one row per (partition, group) present in it: at most num_partitions + #groups rows
    stats = numbered.groupBy("_pid", *g).agg(F.count(F.lit(1)).alias("_cnt"),
                                             F.min("_mid").alias("_first"))
    before = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    if count_out:
        stats = stats.withColumn(count_out, F.sum("_cnt").over(Window.partitionBy(*g)))
    stats = stats.drop("_cnt")
    # one row per (partition, group): at most num_partitions + #groups rows with groups = folds,
    # a bound set by configuration, not by the data, so the broadcast is safe
    res = numbered.join(F.broadcast(stats), ["_pid", *g])
    res = res.withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_first")).cast("long"))
    return res.drop("_pid", "_mid", "_first", "_off")


def row_index(df: DataFrame, order_cols: Sequence, group_cols: Sequence[str] = (),
              out: str = "row_idx") -> DataFrame:
    """Global (or per-group) 0-based row position in ``order_cols`` order — the ``arange`` index."""
    return ordered_index(df, list(group_cols), order_cols, out=out)
