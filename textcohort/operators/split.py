"""Monte-Carlo train / validation / test splits and minority oversampling, all folds at once.

Fold ``f`` shuffles the cohort by ``md5(f:id)`` and keeps the first ``int(0.8 n)`` rows for
training + validation, the rest for test; the train + validation rows are shuffled again by
``md5(seed:id)`` and the first ``int(0.75 m)`` become train.  Test sets of different folds are
independent draws, so they overlap (Monte-Carlo cross-validation, not k-fold).  Sizes and
seed determinism are exact; assignments do not depend on the partitioning of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcohort.operators.index import hash_head, hash_index, md5_int, md5_key


def with_folds(df: DataFrame, folds: int, fold_col: str = "fold") -> DataFrame:
    """Replicate each row once per fold (an explode, not a join)."""
    return df.withColumn(fold_col, F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))


def split_assign(cohort: DataFrame, folds: int = 10, seed: int = 0, id_col: str = "id",
                 label_col: str = "label", test_ratio: float = 0.2,
                 train_ratio: float = 0.75) -> DataFrame:
    """``(fold, id, label, split)`` with ``split`` in ``train`` / ``vali`` / ``test``."""
    from textcohort.sources.io import materialize

    base = cohort.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    x = with_folds(base, folds).withColumn("_h", md5_key("fold", "id"))
    x = hash_head(x, ["fold"], "_h", "id", ratio=1.0 - test_ratio, out="_tv")
    # level 2 reads the level-1 result three times: write it once (narrow rows)
    x = materialize(x.select("fold", "id", "label", "_tv"), "split-level1")
    test = x.filter(~F.col("_tv")).select("fold", "id", "label", F.lit("test").alias("split"))
    tv = x.filter(F.col("_tv")).select("fold", "id", "label").withColumn("_h", md5_key(F.lit(seed), "id"))
    tv = hash_head(tv, ["fold"], "_h", "id", ratio=train_ratio, out="_tr")
    tv = tv.select("fold", "id", "label",
                   F.when(F.col("_tr"), F.lit("train")).otherwise(F.lit("vali")).alias("split"))
    return tv.unionByName(test)


def split_gather(split: DataFrame, cohort: DataFrame, which: str, id_col: str = "id") -> DataFrame:
    """Rows of one split joined with their cohort columns (label, text, ...)."""
    part = split.filter(F.col("split") == which).drop("label")
    return part.join(cohort.withColumnRenamed(id_col, "id"), "id")


def split_complement(cohort: DataFrame, split: DataFrame, which: str = "test", folds: int = 10,
                     id_col: str = "id") -> DataFrame:
    """Per fold, the cohort rows that are not in split ``which`` (anti join on (fold, id))."""
    x = with_folds(cohort.select(F.col(id_col).alias("id")), folds)
    return x.join(split.filter(F.col("split") == which).select("fold", "id"), ["fold", "id"], "left_anti")


def seeded_shuffle(df: DataFrame, seed: int, id_col: str = "id", out: str = "pos",
                   group_cols=()) -> DataFrame:
    """Deterministic shuffle: position of each row in ``md5(seed:id), id`` order."""
    x = df.withColumn("_h", md5_key(F.lit(seed), id_col))
    return hash_index(x, list(group_cols), "_h", id_col, out=out).drop("_h")


def shuffle_rows(df: DataFrame, seed: int | None = None) -> DataFrame:
    """Random row order (order only; the content is unchanged).  With a seed the order is
    reproducible for a fixed input partitioning."""
    return df.orderBy(F.rand(seed) if seed is not None else F.rand())


DRAW_CHUNK = 1 << 16


def _oversample_parts(split: DataFrame, seed: int, fold_col: str):
    """Train rows, indexed minority rows and the draws ``(fold, _j, _idx)`` of every fold."""
    tr = split.filter(F.col("split") == "train").select(fold_col, "id", "label")
    cnt = (tr.groupBy(fold_col)
             .agg(F.count_if(F.col("label") == 1).alias("_npos"),
                  F.count_if(F.col("label") == 0).alias("_nneg")))
    cnt = (cnt.withColumn("_minlab", F.when(F.col("_nneg") > F.col("_npos"), F.lit(1)).otherwise(F.lit(0)))
              .withColumn("_diff", F.abs(F.col("_npos") - F.col("_nneg")))
              .withColumn("_nmin", F.least("_npos", "_nneg"))
              .withColumn("_nmin", F.when((F.col("_nmin") == 0) & (F.col("_diff") > 0),
                                          F.raise_error(F.lit("empty minority class in the train split")).cast("long"))
                                    .otherwise(F.col("_nmin"))))
    # minority rows with an exact 0-based index in hash order (one row per fold is broadcast)
    minority = tr.join(F.broadcast(cnt.select(fold_col, "_minlab")), fold_col) \
                 .filter(F.col("label") == F.col("_minlab")).drop("_minlab")
    minority = minority.withColumn("_h", md5_key(F.lit(seed), fold_col, "id"))
    minority = hash_index(minority, [fold_col], "_h", "id", out="_idx").drop("_h")
    # draws: chunk numbers first (few rows), spread them, then explode each chunk
    d = cnt.filter(F.col("_diff") > 0).select(fold_col, "_diff", "_nmin")
    d = d.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_diff") - 1) / DRAW_CHUNK).cast("long"))))
    # an explicit count: AQE would merge the few tiny chunk rows into one task
    d = d.repartition(int(split.sparkSession.conf.get("spark.sql.shuffle.partitions")), fold_col, "_chunk")
    lo = F.col("_chunk") * DRAW_CHUNK
    hi = F.least((F.col("_chunk") + 1) * DRAW_CHUNK, F.col("_diff")) - 1
    d = d.withColumn("_j", F.explode(F.sequence(lo, hi)))
    draws = d.select(fold_col, "_j", F.pmod(md5_int(F.lit(seed), fold_col, "_j"), F.col("_nmin")).alias("_idx"))
    return tr, minority, draws


def oversample(split: DataFrame, seed: int = 0, fold_col: str = "fold") -> DataFrame:
    """Balance the train split of every fold by drawing minority rows with replacement.

    Per fold the minority class (positives when negatives outnumber them, else negatives) gets
    ``|pos - neg|`` extra rows.  Draw ``j`` picks minority row ``md5(seed:fold:j) mod n_min`` in
    ``md5(seed:fold:id)`` order.  Draws are generated in chunks spread over tasks, then joined to
    the indexed minority rows on ``(fold, idx)``.  Returns ``(fold, id, label, copy)``; ``copy``
    is 0 for the original rows and ``j + 1`` for draw ``j``.  An empty minority with a nonzero
    gap fails the job.  (A tiny minority makes ``idx`` hot here; AQE broadcasts the then small
    minority side.  The model uses ``oversample_multiplicity``, which has no hot key at all.)
    """
    tr, minority, draws = _oversample_parts(split, seed, fold_col)
    extra = draws.join(minority, [fold_col, "_idx"]).select(fold_col, "id", "label", (F.col("_j") + 1).alias("copy"))
    return tr.withColumn("copy", F.lit(0).cast("long")).unionByName(extra)


def oversample_multiplicity(split: DataFrame, seed: int = 0, fold_col: str = "fold") -> DataFrame:
    """``(fold, id, label, mult)``: every train row with its number of copies after oversampling.

    Same draws as ``oversample``, but counted per ``(fold, idx)`` before the join (partial
    aggregation: a minority row drawn a billion times is one row per task), so no copy is ever
    materialised and no key or bucket holds the copies of one row.
    """
    tr, minority, draws = _oversample_parts(split, seed, fold_col)
    per_idx = draws.groupBy(fold_col, "_idx").agg(F.count(F.lit(1)).alias("_k"))
    extra = per_idx.join(minority, [fold_col, "_idx"]).select(fold_col, "id", "_k")
    return (tr.join(extra, [fold_col, "id"], "left")
              .select(fold_col, "id", "label", (F.lit(1) + F.coalesce(F.col("_k"), F.lit(0))).cast("long").alias("mult")))


def oversample_counts(balanced: DataFrame, fold_col: str = "fold") -> DataFrame:
    """Per fold: rows per class after oversampling (equal when the minority was non-empty).
    Accepts explicit copies or a multiplicity table (``mult``)."""
    w = F.col("mult") if "mult" in balanced.columns else F.lit(1)
    return balanced.groupBy(fold_col).agg(
        F.sum(F.when(F.col("label") == 1, w).otherwise(0)).cast("long").alias("n_pos"),
        F.sum(F.when(F.col("label") == 0, w).otherwise(0)).cast("long").alias("n_neg"))
