"""Text classifiers fitted per fold as Spark jobs.

Multinomial Naive Bayes (alpha = 1) is a pure aggregation: class token counts per
``(fold, token)``, totals per fold, one log-ratio weight per token.  Features at scoring time are
relative frequencies ``tf / n_tok``, so long texts do not saturate the probability.

    w_t   = ln((c1_t + a) / (C1 + a V)) - ln((c0_t + a) / (C0 + a V))
    logit = ln(n1 / n0) + sum_t w_t * tf_t / n_tok         p = 1 / (1 + exp(-logit))

``V`` is the number of distinct train tokens of the fold; ``n1, n0`` count train rows (after
oversampling) per class.  Unseen tokens weigh 0; a text without tokens keeps the prior.

The weight table is ``(fold, token, w, mean_x)`` where ``mean_x`` is the train mean of the relative
frequency (used by the linear attribution).  It grows with the vocabulary, so it is joined by
key (AQE may still broadcast it after measuring it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcohort.functions.numeric import nan, sigmoid
from textcohort.operators.text import unfold


def train_multiplicity(balanced: DataFrame, fold_col: str = "fold") -> DataFrame:
    """``(fold, id, label, mult)``: oversampled copies folded into a weight (a table that already
    has ``mult`` — ``split.oversample_multiplicity`` — is used as it is)."""
    if "mult" in balanced.columns:
        return balanced.select(fold_col, "id", "label", "mult")
    return balanced.groupBy(fold_col, "id", "label").agg(F.count(F.lit(1)).alias("mult"))


def fold_numbers(balanced: DataFrame, fold_col: str = "fold") -> list[int]:
    """The folds of a split (a handful of numbers: a parameter of the run)."""
    return sorted(r[0] for r in balanced.select(fold_col).distinct().collect())


def fold_vectors(balanced: DataFrame, folds: list[int], fold_col: str = "fold") -> DataFrame:
    """``(id, label, m0..mK)``: one row per train text with its multiplicity in every fold."""
    mult = train_multiplicity(balanced, fold_col)
    return mult.groupBy("id").agg(F.max("label").alias("label"), *[
        F.sum(F.when(F.col(fold_col) == f, F.col("mult")).otherwise(0)).alias(f"m{f}") for f in folds])


def text_vectors(texts: DataFrame, folds: list[int]) -> DataFrame:
    """``fold_vectors`` with ``n_tok, terms`` from the table of texts, whose ``folds`` hold the multiplicities: no join."""
    def times(f: int):
        return F.get(F.filter("folds", lambda x: (x["fold"] == f) & (x["split"] == "train")), 0)["mult"]

    return texts.select("label", "n_tok", "terms", *[F.coalesce(times(f), F.lit(0)).alias(f"m{f}") for f in folds])


def nb_fit(balanced: DataFrame, counts: DataFrame, alpha: float = 1.0, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Fit one model per fold.  Returns ``(weights, priors)``.  ``counts`` is a token table, or the table of texts with
    their folds (``workflow.prepare_folds``), which needs no join.

    ``weights``: ``(fold, token, c0, c1, w, mean_x)``;
    ``priors``:  ``(fold, n0, n1, prior, mean_shift)`` with ``mean_shift = sum_t w_t mean_x_t``.

    A text's tokens meet one row with its multiplicities in all folds, so the tokens are joined and
    aggregated once, not once per fold; the sums of a token are vectors over folds, and only those
    small results are unfolded into ``(fold, token)`` rows.
    """
    from textcohort.sources.io import materialize

    folds = fold_numbers(balanced, fold_col)
    if "folds" in counts.columns:
        joined = unfold(text_vectors(counts, folds))
    else:
        joined = unfold(fold_vectors(balanced, folds, fold_col), counts)
    sums = []
    for f in folds:
        times = F.col(f"m{f}") * F.col("tf")
        sums += [F.sum(F.when(F.col("label") == 1, times).otherwise(0)).alias(f"p{f}"),
                 F.sum(F.when(F.col("label") == 0, times).otherwise(0)).alias(f"q{f}"),
                 F.sum(times / F.col("n_tok")).alias(f"x{f}")]
    per_fold = F.array(*[F.struct(F.lit(f).alias(fold_col), F.col(f"p{f}").alias("c1"), F.col(f"q{f}").alias("c0"),
                                  F.col(f"x{f}").alias("_sx")) for f in folds])
    per_token = joined.groupBy("token").agg(*sums).select("token", F.inline(per_fold)).filter("c0 + c1 > 0")
    # read twice below (weights and per-fold totals): written once so the count join runs once
    per_token = materialize(per_token, "nb-token-counts")
    totals = per_token.groupBy(fold_col).agg(F.sum("c1").alias("_C1"), F.sum("c0").alias("_C0"),
                                             F.count(F.lit(1)).alias("_V"))
    rows_per_fold = train_multiplicity(balanced, fold_col).groupBy(fold_col).agg(F.sum("mult").alias("_m"))
    a = F.lit(float(alpha))
    # totals and rows_per_fold hold one row per fold, which AQE measures and broadcasts
    w = (per_token.join(totals, fold_col).join(rows_per_fold, fold_col)
         .withColumn("w", F.log((F.col("c1") + a) / (F.col("_C1") + a * F.col("_V")))
                     - F.log((F.col("c0") + a) / (F.col("_C0") + a * F.col("_V"))))
         .withColumn("mean_x", F.col("_sx") / F.col("_m"))
         .select(fold_col, "token", "c0", "c1", "w", "mean_x"))
    return w, nb_priors(balanced, w, fold_col)


def nb_priors(balanced: DataFrame, weights: DataFrame, fold_col: str = "fold") -> DataFrame:
    """``(fold, n0, n1, prior, mean_shift)`` from the train rows and a (written) weight table."""
    mult = train_multiplicity(balanced, fold_col)
    pri = mult.groupBy(fold_col).agg(
        F.sum(F.when(F.col("label") == 1, F.col("mult")).otherwise(0)).alias("n1"),
        F.sum(F.when(F.col("label") == 0, F.col("mult")).otherwise(0)).alias("n0"))
    shift = weights.groupBy(fold_col).agg(F.sum(F.col("w") * F.col("mean_x")).alias("mean_shift"))
    prior = F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.log(F.col("n1") / F.col("n0"))).otherwise(nan())
    return (pri.select(fold_col, "n0", "n1", prior.alias("prior"))
               .join(shift, fold_col, "left")
               .withColumn("mean_shift", F.coalesce("mean_shift", F.lit(0.0))))


def nb_score(rows: DataFrame, counts: DataFrame, weights: DataFrame, priors: DataFrame, fold_col: str = "fold") -> DataFrame:
    """Add ``logit`` and ``prob`` (class-1 probability) to ``rows`` keyed by ``(fold, id)``.

    A text without known tokens keeps the prior (left join).
    """
    contrib = (unfold(*keyed(rows, counts, fold_col))
                   .join(weights.select(fold_col, "token", "w"), [fold_col, "token"])
                   .groupBy(fold_col, "id")
                   .agg(F.sum(F.col("w") * F.col("tf") / F.col("n_tok")).alias("_s")))
    out = (rows.drop("n_tok", "terms", "places").join(contrib, [fold_col, "id"], "left")
               .join(priors.select(fold_col, "prior"), fold_col)
               .withColumn("logit", F.col("prior") + F.coalesce(F.col("_s"), F.lit(0.0)))
               .withColumn("prob", sigmoid(F.col("logit"))))
    return out.drop("_s", "prior")


def keyed(rows: DataFrame, counts: DataFrame, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """The keys of ``rows``, with their tokens where the rows carry them, and the token table: what ``unfold`` takes."""
    return rows.select(fold_col, "id", *[c for c in ("n_tok", "terms", "places") if c in rows.columns]), counts


def class_probabilities(df: DataFrame, prob: str = "prob") -> DataFrame:
    """Two-class probability columns ``p0, p1`` from the class-1 probability."""
    return df.withColumn("p1", F.col(prob)).withColumn("p0", F.lit(1.0) - F.col(prob))


__all__ = ["keyed", "train_multiplicity", "nb_fit", "nb_priors", "nb_score", "class_probabilities"]
