"""Corpus-wide word consensus of token attributions over all folds.

One hash aggregation per word (partial aggregation before the shuffle, so a frequent word such
as ``the`` costs one row per task, not one per occurrence).  The raw value list of a word is
kept as ordered chunks, one per ``(word, fold, id)``: joining the chunks in ``(fold, id)`` order
gives the word's whole ``_``-joined list, and no group larger than one text is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcohort.functions.text import normalise_word
from textcohort.operators.model import keyed
from textcohort.operators.text import unfold


#: Values in one piece of a word's list.
LIST_VALUES = 1 << 16


def with_words(attr: DataFrame, token_col: str = "token") -> DataFrame:
    return attr.withColumn("word", normalise_word(F.col(token_col)))


def word_count(attr: DataFrame) -> DataFrame:
    """``(word, count)`` over all folds (sort by ``word`` at the sink: binary = code-point order)."""
    return with_words(attr).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def consensus(attr: DataFrame) -> DataFrame:
    """``(word, count, shap_avg)``: occurrences and mean attribution per normalised word."""
    return with_words(attr).groupBy("word").agg(F.count(F.lit(1)).alias("count"),
                                                F.avg("phi").alias("shap_avg"))


def token_word_count(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``word_count`` of the given ``(fold, id)`` rows from token counts alone: no model, no occurrence.
    Every row also has its base entry, the empty word."""
    words = unfold(*keyed(rows, counts))
    base = rows.select(F.lit("").alias("token"), F.lit(1).cast("long").alias("tf"))
    return with_words(words.select("token", "tf").unionByName(base)).groupBy("word").agg(F.sum("tf").alias("count"))


def model_consensus(rows: DataFrame, counts: DataFrame, weights: DataFrame, priors: DataFrame, target_class: int = 0) -> DataFrame:
    """``consensus`` of the linear model's attributions without an occurrence table.

    Occurrences of a token in one text share their value, so a word needs the sums of ``tf`` and
    ``tf * phi`` over ``(fold, id, token)``; of a token that is ``w * (sum of x - texts * mean)``.  The empty word collects the rows' base values: its sum is
    the sum of all ``w * mean`` less the folds' mean shifts, one number per fold and row."""
    from textcohort.sources.io import materialize

    # a token's weight is the same in all texts of a fold: their sums meet it, one row per fold and token
    tokens = unfold(*keyed(rows, counts)).groupBy("fold", "token").agg(
        F.sum("tf").alias("n"), F.sum(F.col("tf") / F.col("n_tok")).alias("_x"), F.count(F.lit(1)).alias("_k"))
    known = tokens.join(weights.select("fold", "token", "w", "mean_x"), ["fold", "token"], "left")
    w, mean = F.coalesce("w", F.lit(0.0)), F.coalesce("mean_x", F.lit(0.0))
    words = with_words(known).groupBy("word").agg(
        F.sum("n").alias("n"), F.sum(w * (F.col("_x") - F.col("_k") * mean)).alias("s"), F.sum(F.col("_k") * w * mean).alias("wm"))
    # one row per word: read for the words and for the sum of w * mean
    words = materialize(words, "word-sums")
    shift = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("k")).join(priors.select("fold", "mean_shift"), "fold")
    shift = shift.agg(F.sum("k").alias("n"), F.sum(-F.col("k") * F.col("mean_shift")).alias("s"))
    base = shift.unionByName(words.agg(F.lit(0).cast("long").alias("n"), F.sum("wm").alias("s"))).select(F.lit("").alias("word"), "n", "s")
    sign = 1.0 if target_class == 1 else -1.0
    summed = words.select("word", "n", "s").unionByName(base).groupBy("word").agg(F.sum("n").alias("count"), F.sum("s").alias("s"))
    return summed.filter(F.col("count") > 0).select("word", "count", (F.lit(sign) * F.col("s") / F.col("count")).alias("shap_avg"))


def consensus_raw(attr: DataFrame, fmt: str = "%.2f", sep: str = "_", fold_col: str = "fold") -> DataFrame:
    """``(word, fold, id, raw)``: the word's formatted values inside one text, in position order."""
    a = with_words(attr)
    g = a.groupBy("word", fold_col, "id").agg(F.array_sort(F.collect_list(F.struct("pos", "phi"))).alias("_v"))
    return g.select("word", fold_col, "id",
                    F.array_join(F.transform("_v", lambda s: F.format_string(fmt, s["phi"])), sep).alias("raw"))


def consensus_lists(attr: DataFrame, words: DataFrame, values: int = LIST_VALUES, fmt: str = "%.2f", sep: str = "_", fold_col: str = "fold") -> DataFrame:
    """``(word, piece, n, raw)``: the whole value list of each of ``words``, in (fold, id, position) order, in pieces of ``values``
    values.  Joining a word's pieces with ``sep`` gives the whole list; no group is larger than one piece.

    A word's values in one text are gathered first (without a shuffle, where the attributions are dealt by ``id``) and written, so that
    the attributions are computed once; what is dealt by range is one row per word and text.  Every occurrence gets its place from the
    distributed exact index, so a word may run over any number of tasks; its first place is one aggregated row per word."""
    from textcohort.operators.index import ordered_index
    from textcohort.sources.io import materialize

    rows = with_words(attr).join(words.select("word"), "word", "left_semi").select("word", fold_col, "id", "pos", F.format_string(fmt, "phi").alias("_value"))
    texts = rows.groupBy("word", fold_col, "id").agg(F.array_sort(F.collect_list(F.struct("pos", "_value"))).alias("_v"))
    texts = materialize(texts.select("word", fold_col, "id", F.col("_v._value").alias("_value")), "word-values")
    placed = ordered_index(texts, [], ["word", fold_col, "id"], out="_at", spread="_value")
    first = placed.groupBy("word").agg(F.min("_at").alias("_first"))
    nth = F.col("_at") - F.col("_first")
    piece = placed.join(first, "word").select("word", F.floor(nth / values).cast("long").alias("piece"), nth.alias("_nth"), "_value")
    listed = piece.groupBy("word", "piece").agg(F.array_sort(F.collect_list(F.struct("_nth", "_value"))).alias("_v"))
    return listed.select("word", "piece", F.size("_v").cast("long").alias("n"), F.array_join(F.col("_v._value"), sep).alias("raw"))


def consensus_top(cons: DataFrame, min_count, skip_head: int = 10, skip_tail: int = 3) -> DataFrame:
    """Words with ``count >= min_count``, then rows ``[skip_head : -skip_tail]`` in word order.

    ``min_count`` may be an int or a Column.  Positions in word order come from the distributed
    exact index (range partitioning + per-partition offsets), so no step puts the word table in
    one task; after the threshold the table is small anyway (at most
    ``total_occurrences / min_count`` words).
    """
    from textcohort.operators.index import ordered_index

    mc = min_count if not isinstance(min_count, (int, float)) else F.lit(min_count)
    top = cons.filter(F.col("count") >= mc)
    top = ordered_index(top, [], ["word"], out="_pos", count_out="_n")
    keep = (F.col("_pos") >= skip_head) & (F.col("_pos") < F.col("_n") - skip_tail)
    return top.filter(keep).drop("_pos", "_n")


def consensus_letters(cons: DataFrame, min_count) -> DataFrame:
    """Content-based alternative to the positional slice: keep words made of letters only."""
    mc = min_count if not isinstance(min_count, (int, float)) else F.lit(min_count)
    return cons.filter((F.col("count") >= mc) & F.col("word").rlike(r"^\p{L}+$"))


def consensus_abs(top: DataFrame) -> DataFrame:
    """First three columns with the absolute mean."""
    first3 = top.select(*top.columns[:3])
    return first3.withColumn("shap_avg", F.abs("shap_avg"))
