"""Evaluation of scored folds, all folds in one job.

Input convention: one row per scored example with a group column (``fold``), a score and a
truth label (``> 0`` positive, ``== 0`` negative, anything else in neither class).

The histogram AUROC/AUPRC is exact and sparse: only non-empty bins change TPR or PPV, so the
walk over ``10**digits + 1`` bins collapses to a sum over the non-empty ones, with running sums
from a window over at most ``10**digits + 1`` pre-aggregated rows per fold — bounded whatever
the table size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textcohort.functions.numeric import minmax_expr, nan, safe_div, score_bin
from textcohort.operators.index import ordered_index


def minmax_scale(df: DataFrame, group_cols: Sequence[str] = ("fold",), score: str = "pred",
                 out: str | None = None) -> DataFrame:
    """Per-group ``(p - min) / (max - min)``; a constant group gives NaN (no ANSI error).

    The statistics have one row per group.  The join is left to the planner: AQE measures the
    statistics and broadcasts them when they are small (folds), and shuffles for many groups.
    """
    g = list(group_cols)
    out = out or score
    stats = df.groupBy(*g).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    return (df.join(stats, g)
              .withColumn(out, minmax_expr(F.col(score), F.col("_lo"), F.col("_hi")))
              .drop("_lo", "_hi"))


def _invalid(score: str, digits: int):
    b = score_bin(F.col(score), digits)
    return F.col(score).isNull() | F.isnan(score) | (b < 0) | (b > 10 ** digits)


def score_validate(df: DataFrame, group_cols: Sequence[str] = ("fold",), score: str = "pred",
                   digits: int = 3, strict: bool = False) -> DataFrame:
    """Per group: rows and rows outside the histogram range (NaN first: ``floor(NaN)`` is 0).

    ``strict=True`` makes the job fail on the first group with an invalid score, like the
    range check of the original histogram.
    """
    g = list(group_cols)
    res = df.groupBy(*g).agg(F.count(F.lit(1)).alias("n_rows"),
                             F.count_if(_invalid(score, digits)).alias("n_invalid"))
    if strict:
        res = res.withColumn(
            "n_invalid",
            F.when(F.col("n_invalid") == 0, F.col("n_invalid"))
             .otherwise(F.raise_error(F.lit("invalid values in scores")).cast("long")))
    return res


def score_histogram(df: DataFrame, group_cols: Sequence[str] = ("fold",), score: str = "pred",
                    truth: str = "truth", digits: int = 3, invalid_bin: bool = False) -> DataFrame:
    """Sparse per-class histogram ``(group, bin, n_pos, n_neg)`` of the valid scores.

    With ``invalid_bin`` the rows outside the range are kept under a null bin: there ``n_invalid``
    counts them (0 elsewhere), and a group without any valid score still has a row."""
    g = list(group_cols)
    bad = _invalid(score, digits)
    counts = (df.withColumn("bin", F.when(~bad, score_bin(F.col(score), digits)))
                .groupBy(*g, "bin")
                .agg(F.count_if(F.col(truth) > 0).alias("n_pos"),
                     F.count_if(F.col(truth) == 0).alias("n_neg"), F.count(F.lit(1)).alias("_n")))
    valid = F.col("bin").isNotNull()
    if not invalid_bin:
        return counts.filter(valid & ((F.col("n_pos") > 0) | (F.col("n_neg") > 0))).drop("_n")
    return counts.select(*g, "bin", F.when(valid, F.col("n_pos")).otherwise(0).alias("n_pos"),
                         F.when(valid, F.col("n_neg")).otherwise(0).alias("n_neg"),
                         F.when(valid, F.lit(0)).otherwise(F.col("_n")).cast("long").alias("n_invalid"))


def _running(hist: DataFrame, g: list[str]) -> DataFrame:
    upto = Window.partitionBy(*g).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*g)
    return (hist.withColumn("cp", F.sum("n_pos").over(upto))
                .withColumn("cn", F.sum("n_neg").over(upto))
                .withColumn("P", F.sum("n_pos").over(whole))
                .withColumn("N", F.sum("n_neg").over(whole)))


def auc_from_histogram(hist: DataFrame, group_cols: Sequence[str] = ("fold",)) -> DataFrame:
    """Exact trapezoid AUROC and step AUPRC per group; NaN when a class is empty."""
    g = list(group_cols)
    r = _running(hist, g)
    dtpr = safe_div(F.col("n_pos"), F.col("P"))
    roc_term = dtpr * safe_div(2 * F.col("cn") - F.col("n_neg"), 2 * F.col("N"))
    tp_before = F.col("P") - F.col("cp") + F.col("n_pos")
    fp_before = F.col("N") - F.col("cn") + F.col("n_neg")
    pr_term = F.when(F.col("n_pos") > 0, dtpr * safe_div(tp_before, tp_before + fp_before)) \
               .otherwise(F.lit(0.0))
    counts_invalid = "n_invalid" in hist.columns
    agg = r.groupBy(*g).agg(F.sum(roc_term).alias("_roc"), F.sum(pr_term).alias("_pr"),
                            F.max("P").alias("_P"), F.max("N").alias("_N"),
                            F.sum("n_invalid" if counts_invalid else F.lit(0)).alias("n_invalid"))
    defined = (F.col("_P") > 0) & (F.col("_N") > 0) & (F.col("n_invalid") == 0)
    return agg.select(*g, F.when(defined, F.col("_roc")).otherwise(nan()).alias("auroc"),
                      F.when(defined, F.col("_pr")).otherwise(nan()).alias("auprc"),
                      *(["n_invalid"] if counts_invalid else []))


def _settled(metrics: DataFrame, on_invalid: str) -> DataFrame:
    """Strict: fail the job in a group with invalid scores.  Report mode: keep ``n_invalid``."""
    if on_invalid == "nan":
        return metrics
    if on_invalid != "raise":
        raise ValueError(f"on_invalid is 'raise' or 'nan', not {on_invalid!r}")
    checked = F.when(F.col("n_invalid") == 0, F.col("auroc")) \
               .otherwise(F.raise_error(F.lit("invalid values in scores")).cast("double"))
    return metrics.withColumn("auroc", checked).drop("n_invalid")


def auc_scores(df: DataFrame, group_cols: Sequence[str] = ("fold",), score: str = "pred",
               truth: str = "truth", digits: int = 3, on_invalid: str = "raise") -> DataFrame:
    """``(group, auroc, auprc)``, in report mode also ``n_invalid``."""
    hist = score_histogram(df, group_cols, score, truth, digits, invalid_bin=True)
    return _settled(auc_from_histogram(hist, group_cols), on_invalid)


def rank_sum_auc(df: DataFrame, group_cols: Sequence[str] = ("fold",), score: str = "pred", truth: str = "truth",
                 out: str = "rank_sum") -> DataFrame:
    """AUROC per group as the share of (positive, negative) pairs in the right order, ties counting half:
    the negatives below and at each distinct score, summed over its positives."""
    g = list(group_cols)
    per = df.groupBy(*g, score).agg(F.count_if(F.col(truth) > 0).alias("_p"), F.count_if(F.col(truth) == 0).alias("_n"))
    below = Window.partitionBy(*g).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0)))
    agg = per.groupBy(*g).agg(F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2)).alias("_s"),
                              F.sum("_p").alias("_P"), F.sum("_n").alias("_N"))
    return agg.select(*g, safe_div(F.col("_s"), F.col("_P") * F.col("_N")).alias(out))


def roc_curve(df: DataFrame, group_cols: Sequence[str] = ("fold",), score: str = "pred",
              truth: str = "truth", digits: int = 3) -> DataFrame:
    """Operating points after each non-empty bin: counts, TPR, TNR, PPV and their previous values."""
    g = list(group_cols)
    r = _running(score_histogram(df, g, score, truth, digits), g)
    tp = F.col("P") - F.col("cp")
    fp = F.col("N") - F.col("cn")
    prev = Window.partitionBy(*g).orderBy("bin")
    out = (r.withColumn("tp", tp).withColumn("fn", F.col("cp"))
            .withColumn("fp", fp).withColumn("tn", F.col("cn"))
            .withColumn("tpr", safe_div(F.col("tp"), F.col("P")))
            .withColumn("tnr", safe_div(F.col("tn"), F.col("N")))
            .withColumn("ppv", safe_div(F.col("tp"), F.col("tp") + F.col("fp"))))
    out = (out.withColumn("tpr_prev", F.coalesce(F.lag("tpr").over(prev), F.lit(1.0)))
              .withColumn("tnr_prev", F.coalesce(F.lag("tnr").over(prev), F.lit(0.0)))
              .withColumn("ppv_prev", F.coalesce(F.lag("ppv").over(prev),
                                                 safe_div(F.col("P"), F.col("P") + F.col("N")))))
    return out.select(*g, "bin", (F.col("bin") / F.lit(float(10 ** digits))).alias("threshold"),
                      "tp", "fp", "tn", "fn", "tpr", "tnr", "ppv", "tpr_prev", "tnr_prev", "ppv_prev")


def pearson(df: DataFrame, group_cols: Sequence[str] = ("fold",), x: str = "pred",
            y: str = "truth", out: str = "pearson") -> DataFrame:
    """Pearson r per group from stable central moments; NaN on zero variance (ANSI-safe)."""
    g = list(group_cols)
    agg = df.groupBy(*g).agg(*_moments(F.col(x), F.col(y)))
    return agg.select(*g, _pearson_of().alias(out))


def argmax_class(p0, p1):
    """Index of the larger class score; the first class wins a tie."""
    c0 = F.col(p0) if isinstance(p0, str) else p0
    c1 = F.col(p1) if isinstance(p1, str) else p1
    return F.when(c1 > c0, F.lit(1)).otherwise(F.lit(0))


def rank_normalise(df: DataFrame, group_cols: Sequence[str] = ("fold",), score: str = "pred",
                   id_col: str = "id", out: str = "rank") -> DataFrame:
    """Position in ascending ``(score, id)`` order divided by ``n - 1`` (ties broken by id).

    Not ``percent_rank``: tied scores get distinct ranks.  A one-row group gives NaN.
    """
    g = list(group_cols)
    r = ordered_index(df, g, [score, id_col], out="_pos", count_out="_n")
    return r.withColumn(out, safe_div(F.col("_pos"), F.col("_n") - 1)).drop("_pos", "_n")


MetricFn = Callable[[DataFrame, Sequence[str]], DataFrame]


def combine_metrics(df: DataFrame, fns: Sequence[MetricFn], group_cols: Sequence[str] = ("fold",)) -> DataFrame:
    """Evaluate metric callbacks (each ``(df, group_cols) -> (group..., metric...)``) and join
    their per-group rows.  Each callback is an aggregation, so the joins are over one row per group."""
    g = list(group_cols)
    out = None
    for fn in fns:
        r = fn(df, g)
        out = r if out is None else out.join(r, g, "full")
    return out


def _moments(x, y) -> list:
    """Central moments for Pearson r, under the names that ``_pearson_of`` reads."""
    x, y = x.cast("double"), y.cast("double")
    return [F.covar_pop(x, y).alias("_c"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy")]


def _pearson_of():
    """r from the moments; NaN on zero variance or a NaN value (ANSI-safe)."""
    den = F.sqrt(F.col("_vx") * F.col("_vy"))
    return F.when(F.isnan("_vx") | F.isnan("_vy") | F.isnan("_c"), nan()) \
            .when((F.col("_vx") > 0) & (F.col("_vy") > 0), F.col("_c") / den).otherwise(nan())


def fold_metrics(df: DataFrame, group_cols: Sequence[str] = ("fold",), score: str = "pred",
                 truth: str = "truth", digits: int = 6, on_invalid: str = "raise") -> DataFrame:
    """``(group, auroc, auprc, pearson)`` per fold, in report mode also ``n_invalid``."""
    return combine_metrics(df, [lambda d, g: auc_scores(d, g, score, truth, digits, on_invalid),
                                lambda d, g: pearson(d, g, score, truth)], group_cols)


def scaled_fold_metrics(df: DataFrame, group_cols: Sequence[str] = ("fold",), score: str = "score",
                        truth: str = "truth", digits: int = 6, on_invalid: str = "raise") -> DataFrame:
    """``fold_metrics`` of the min-max scaled score in two scans of ``df``.

    Pearson r does not change under scaling, so it comes from the aggregate that finds the minimum
    and maximum; the second scan scales and counts bins, and carries r as a constant of the group."""
    g = list(group_cols)
    stats = df.groupBy(*g).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"), *_moments(F.col(score), F.col(truth)))
    stats = stats.select(*g, "_lo", "_hi", _pearson_of().alias("pearson"))
    scaled = df.join(stats, g).withColumn("pred", minmax_expr(F.col(score), F.col("_lo"), F.col("_hi")))
    hist = score_histogram(scaled, [*g, "pearson"], "pred", truth, digits, invalid_bin=True)
    out = _settled(auc_from_histogram(hist, [*g, "pearson"]), on_invalid)
    return out.select(*g, "auroc", "auprc", "pearson", *(["n_invalid"] if on_invalid == "nan" else []))


def _nan_aware(fn, c: str):
    return F.when(F.max(F.isnan(c).cast("int")) == 1, nan()).otherwise(fn(c))


def fold_report(metrics: DataFrame, fold_col: str = "fold",
                cols: Sequence[str] = ("auroc", "auprc", "pearson")) -> DataFrame:
    """Rows ``fold0..foldK`` plus ``avg`` and ``median`` (exact, interpolated; NaN and null propagate).
    Metrics of report mode keep ``n_invalid``, with the total in the summary rows.

    The metrics (one row per fold) are read by three branches, so they are written once first.
    """
    from textcohort.sources.io import materialize

    carries = "n_invalid" in metrics.columns
    if not carries:
        metrics = metrics.withColumn("n_invalid", F.lit(0).cast("long"))
    # a missing value is an undefined metric, never one that the summary may skip
    clean = [F.coalesce(F.col(c).cast("double"), nan()).alias(c) for c in cols]
    metrics = materialize(metrics.select(F.col(fold_col).cast("string").alias("_fold"), *clean, "n_invalid"), "fold-metrics")
    extra = ["n_invalid"] if carries else []
    per_fold = metrics.select(F.concat(F.lit("fold"), "_fold").alias("fold"), *cols, *extra)
    total = [F.sum("n_invalid").alias("n_invalid")] if carries else []
    avg = metrics.agg(*[F.avg(c).alias(c) for c in cols], *total).select(F.lit("avg").alias("fold"), *cols, *extra)
    med = metrics.agg(*[_nan_aware(F.median, c).alias(c) for c in cols], *total).select(F.lit("median").alias("fold"), *cols, *extra)
    return per_fold.unionByName(avg).unionByName(med)


def format_report(report: DataFrame, cols: Sequence[str] = ("auroc", "auprc", "pearson"),
                  fmt: str = "%.3f") -> DataFrame:
    """Text form of the report (``%.3f``), ready for the TSV sink."""
    return report.select("fold", *[F.format_string(fmt, F.col(c).cast("double")).alias(c) for c in cols])
