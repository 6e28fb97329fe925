"""Ranked listings and the example table (n-th pick per class, cleaned text, stop-listed values)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textcohort.functions.text import CLEAN_RULES_BASE, clean_text, join_rounded, \
    trim_tail_chars, trim_tail_items
from textcohort.operators.index import ordered_index
from textcohort.operators.text import unfold


def _order(descending: bool):
    return [F.col("rank").desc(), F.col("id").desc()] if descending else [F.col("rank"), F.col("id")]


def ranked_listing(ranked: DataFrame, label: int, descending: bool, k: int | None = None,
                   fold_col: str = "fold") -> DataFrame:
    """All rows of one class in every fold with their 0-based place ``k`` (positives: highest rank first),
    or the first ``k`` rows of it.

    The whole listing takes its places from the distributed exact index, so a class of any size is
    never ordered in one task."""
    rows = ranked.filter(F.col("label") == label)
    if k is None:
        return ordered_index(rows, [fold_col], _order(descending), out="k")
    w = Window.partitionBy(fold_col).orderBy(*_order(descending))
    # a filter directly on row_number <= k lets Spark insert a per-partition group limit
    # (WindowGroupLimit) before the shuffle: only k rows per fold and partition move
    return (rows.withColumn("_rn", F.row_number().over(w))
                .filter(F.col("_rn") <= k)
                .withColumn("k", F.col("_rn") - 1).drop("_rn"))


def nth_by_rank(ranked: DataFrame, label: int, ks: Sequence[int], descending: bool,
                fold_col: str = "fold") -> DataFrame:
    """The ``k``-th (0-based) row of one class per fold, for each ``k`` in ``ks``."""
    top = ranked_listing(ranked, label, descending, max(ks) + 1, fold_col)
    return top.filter(F.col("k").isin(list(ks)))


# Tokens every example drops before listing attribution values.
STOP_BASE = ["", "|", "nan", ". ", "’", "t ", "m ", "vn", "'", "(", ")", ", ", "."]


@dataclass
class Pick:
    label: int
    k: int
    rules: Sequence[tuple[str, str]] = field(default_factory=lambda: list(CLEAN_RULES_BASE))
    stop: Sequence[str] = field(default_factory=lambda: list(STOP_BASE))
    strip: str = "both"
    trim_chars: int = 0
    trim_items: int = 0


def _not_in(stop_arr):
    """Predicate for ``F.filter``: the element's token is not in ``stop_arr`` (one-argument lambda)."""
    return lambda s: ~F.array_contains(stop_arr, s["token"])


def _by_pick(pick_col: str, exprs: list):
    """``CASE pick WHEN 0 THEN exprs[0] WHEN 1 THEN exprs[1] ... END``."""
    out = None
    for i, e in enumerate(exprs):
        cond = F.col(pick_col) == i
        out = F.when(cond, e) if out is None else out.when(cond, e)
    return out


def example_picks(ranked: DataFrame, fold: int, picks: Sequence[Pick], fold_col: str = "fold") -> DataFrame:
    """``(fold, id, label, rank, _pick)``: the picked rows of ``fold``, at most one per pick.

    The ranked listing per class is computed once (group-limited to the deepest pick) and its rows
    are tagged with their picks."""
    ranked = ranked.filter(F.col(fold_col) == fold)
    cands = None
    for label in sorted({p.label for p in picks}):
        depth = max(p.k for p in picks if p.label == label) + 1
        listing = ranked_listing(ranked, label, label == 1, depth, fold_col)
        cands = listing if cands is None else cands.unionByName(listing)
    tags = F.array(*[F.when((F.col("label") == p.label) & (F.col("k") == p.k), F.lit(i))
                     for i, p in enumerate(picks)])
    return (cands.withColumn("_pick", F.explode(F.filter(tags, lambda x: x.isNotNull())))
                 .select(fold_col, "id", "label", "rank", "_pick"))


def example_report(picked: DataFrame, texts: DataFrame, attr: DataFrame, picks: Sequence[Pick], digits: int = 3,
                   fold_col: str = "fold") -> DataFrame:
    """``(gt, pred, text, shap, pick)`` — one row per picked row of ``example_picks``.

    ``texts``: ``(id, text)``; ``attr``: ``(fold, id, pos, token, phi)`` of the picked rows (rows of others
    are ignored) for the class whose values are listed.  Each pick's cleaning rules, stop list and
    trims are chosen per row by ``CASE`` expressions.
    """
    vals = (attr.join(picked.select(fold_col, "id").distinct(), [fold_col, "id"], "left_semi")
                .groupBy(fold_col, "id")
                .agg(F.array_sort(F.collect_list(F.struct("pos", "token", "phi"))).alias("_v")))
    base = picked.join(texts.select("id", "text"), "id").join(vals, [fold_col, "id"], "left")
    text_exprs, shap_exprs = [], []
    for p in picks:
        stop_arr = F.array(*[F.lit(x) for x in p.stop]) if p.stop else F.array().cast("array<string>")
        kept = F.filter(F.coalesce("_v", F.array().cast("array<struct<pos:int,token:string,phi:double>>")),
                        _not_in(stop_arr))
        values = F.transform(kept, lambda s: s["phi"])
        if p.trim_items:
            values = trim_tail_items(values, p.trim_items)
        text = clean_text(F.col("text"), p.rules, strip=p.strip)
        if p.trim_chars:
            text = trim_tail_chars(text, p.trim_chars)
        text_exprs.append(text)
        shap_exprs.append(join_rounded(values, digits))
    return base.select(F.col("label").alias("gt"), F.bround("rank", digits).alias("pred"),
                       _by_pick("_pick", text_exprs).alias("text"),
                       _by_pick("_pick", shap_exprs).alias("shap"), F.col("_pick").alias("pick"))


def stoplist_tokens(rows: DataFrame, counts: DataFrame, stop: Sequence[str], fold_col: str = "fold") -> DataFrame:
    """Per ``(fold, id)`` row: token occurrences kept and dropped by a stop list, the row's base entry (the
    empty token) included.  Counted from the token counts; no model and no occurrence table."""
    listed = F.col("token").isin(list(stop))
    flat = unfold(counts.select("id", "n_tok", "terms")) if "terms" in counts.columns else counts
    per_text = flat.groupBy("id").agg(F.sum(F.when(listed, 0).otherwise(F.col("tf"))).alias("_kept"),
                                      F.sum(F.when(listed, F.col("tf")).otherwise(0)).alias("_dropped"))
    base = int("" in stop)
    return rows.select(fold_col, "id").join(per_text, "id", "left").select(
        fold_col, "id", (F.coalesce("_kept", F.lit(0)) + (1 - base)).cast("int").alias("n_kept"),
        (F.coalesce("_dropped", F.lit(0)) + base).cast("int").alias("n_dropped"))
