"""End-to-end compositions: cohort -> split -> oversample -> fit -> score -> report.

``fit_folds`` runs jobs when it is called: it writes the tables that several stages read.  The other
functions return lazy DataFrames.  No rows are collected.  Texts are tokenised once and joined
to the fold assignment late, so ten folds multiply only the narrow ``(fold, id)`` rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcohort.operators import model as M
from textcohort.operators import scoring as S
from textcohort.operators import split as SP
from textcohort.operators import text as TX
from textcohort.sources.io import materialize

#: Text bytes that one task tokenises, and below which a cohort is not cut further.
PART_BYTES, LEAST_PART_BYTES = 128 << 20, 1 << 20


@dataclass
class PreparedFolds:
    cohort: DataFrame      # (id, code, label, text) — raw text, read again only for reports
    docs: DataFrame        # (id, code, label, bytes) — written once
    split: DataFrame       # (fold, id, label, split) — written once, narrow
    counts: DataFrame      # (id, label, folds, n_tok, terms, places) — one row per text, written once

    def rows(self, which: str = "test") -> DataFrame:
        """``(fold, id, label)`` of one split."""
        return self.split.filter(F.col("split") == which).select("fold", "id", "label")

    def texts(self, which: str = "test") -> DataFrame:
        """``(fold, id, label, n_tok, terms, places)``: the same rows with their tokens, without a join."""
        own = F.filter("folds", lambda x: x["split"] == which)
        return self.counts.select("id", "label", "n_tok", "terms", "places", F.explode(own).alias("_fold")).select(
            "_fold.fold", "id", "label", "n_tok", "terms", "places")

    def folded(self, which: str = "test") -> DataFrame:
        """``(id, own, n_tok, terms, places)``: one row per text that is in this split of some fold, ``own`` those folds."""
        own = F.transform(F.filter("folds", lambda x: x["split"] == which), lambda x: x["fold"])
        return self.counts.select("id", own.alias("own"), "n_tok", "terms", "places").filter(F.size("own") > 0)


@dataclass
class FittedFolds(PreparedFolds):
    balanced: DataFrame    # (fold, id, label, mult) — train rows with their oversampling copies
    weights: DataFrame
    priors: DataFrame


def cohort_keys(cohort: DataFrame) -> DataFrame:
    """``(id, code, label, bytes)`` of the cohort, written once (the text filters are evaluated once)."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes")
    return materialize(cohort.select("id", "code", "label", size), "cohort-keys")


def text_parts(total_bytes: int, cores: int) -> int:
    """Into how many parts texts are dealt: parts of at most ``PART_BYTES``, and enough of them for all cores where the
    texts are more than ``LEAST_PART_BYTES`` a core."""
    by_bytes = -(-total_bytes // PART_BYTES)
    return max(1, by_bytes, min(cores, -(-total_bytes // LEAST_PART_BYTES)))


def text_table(cohort: DataFrame, docs: DataFrame, split: DataFrame, balanced: DataFrame | None = None) -> DataFrame:
    """``(id, label, folds, n_tok, terms, places)``: one row per text of the cohort with its place in every fold (``fold, split, mult``, as many
    as there are folds) and its tokens.  Texts are dealt by id once; counting, nesting and the join use that partitioning.
    A text without tokens has null ``n_tok`` and ``terms``."""
    total = docs.agg(F.sum("bytes").alias("n")).first().n or 0
    spark = cohort.sparkSession
    # as many parts as the session's shuffles have: tokens of a part are sorted by text, and larger parts would spill
    parts = text_parts(total, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = cohort.select("id", "text").repartition(parts, "id")
    terms = TX.text_terms(TX.token_counts(TX.doc_tokens(dealt)))
    placed = split.withColumn("mult", F.lit(None).cast("long"))
    if balanced is not None:
        placed = split.join(balanced.select("fold", "id", "mult"), ["fold", "id"], "left")
    # into the same parts: the join would otherwise deal the tokens again
    folds = placed.repartition(parts, "id").groupBy("id").agg(F.max("label").alias("label"), F.collect_list(F.struct("fold", "split", "mult")).alias("folds"))
    return materialize(terms.join(folds, "id", "right").select("id", "label", "folds", "n_tok", "terms", "places"), "texts")


def prepare_folds(cohort: DataFrame, folds: int = 10, seed: int = 0) -> PreparedFolds:
    """Split every fold and count every text's tokens; no model is fitted.

    The raw text is read twice: once for the narrow cohort keys and once to count tokens (with
    positions), which is all that models and attributions read."""
    docs, split = _split(cohort, folds, seed)
    return PreparedFolds(cohort, docs, split, text_table(cohort, docs, split))


def _split(cohort: DataFrame, folds: int, seed: int) -> tuple[DataFrame, DataFrame]:
    docs = cohort_keys(cohort)
    return docs, materialize(SP.split_assign(docs.select("id", "label"), folds=folds, seed=seed), "split")


def fit_folds(cohort: DataFrame, folds: int = 10, seed: int = 0, alpha: float = 1.0) -> FittedFolds:
    """Split, balance and fit every fold.  Results that several later stages read are
    written once to the shared checkpoint folder."""
    docs, split = _split(cohort, folds, seed)
    # train rows with their oversampling multiplicity (no materialised copies, no hot keys)
    balanced = materialize(SP.oversample_multiplicity(split, seed=seed), "train-mult")
    texts = text_table(cohort, docs, split, balanced)
    weights, _ = M.nb_fit(balanced, texts, alpha=alpha)
    weights = materialize(weights, "nb-weights")
    priors = materialize(M.nb_priors(balanced, weights), "nb-priors")    # one row per fold
    return FittedFolds(cohort, docs, split, texts, balanced, weights, priors)


def score_split(m: FittedFolds, which: str = "test") -> DataFrame:
    """``(fold, id, label, logit, prob)`` for one split of every fold."""
    return M.nb_score(m.texts(which), m.counts, m.weights, m.priors).select("fold", "id", "label", "logit", "prob")


def scaled_predictions(m: FittedFolds, which: str = "test", round_digits: int = 9) -> DataFrame:
    """Per-fold min-max scaled class-1 probability ``pred`` (rounded so ties are engine-independent).

    Written once (the prediction store): AUROC, AUPRC, Pearson, ranks and reports all read it.
    """
    # read twice by the scaling (per-fold min/max and the rows): written once, narrow
    scored = materialize(score_split(m, which), f"scored-{which}")
    scaled = S.minmax_scale(scored, ["fold"], score="prob", out="pred")
    return materialize(scaled.withColumn("pred", F.round("pred", round_digits)), f"pred-{which}")


def fold_report(cohort: DataFrame, folds: int = 10, seed: int = 0, digits: int = 6, on_invalid: str = "raise") -> DataFrame:
    """The score table: ``fold0..`` rows plus ``avg`` and ``median`` of AUROC, AUPRC, Pearson.

    A fold with a score outside the range stops the job, or with ``on_invalid="nan"`` gets NaN and
    its number of such scores."""
    m = fit_folds(cohort, folds, seed)
    preds = scaled_predictions(m)
    metrics = S.fold_metrics(preds.withColumnRenamed("label", "truth"), ["fold"], "pred", "truth", digits, on_invalid)
    return S.fold_report(metrics)


def rank_report(ranked: DataFrame, digits: int = 6) -> DataFrame:
    """``(fold, auroc, auprc, pearson)`` of the rank-normalised predictions (``fold, label, rank``)."""
    return S.fold_metrics(ranked.select("fold", F.col("label").alias("truth"), F.col("rank").alias("pred")), ["fold"], "pred", "truth", digits)


def validation_pearson(m: FittedFolds) -> DataFrame:
    """Per fold: Pearson of the argmax class against the label on the validation split."""
    v = M.class_probabilities(score_split(m, "vali"))
    v = v.withColumn("argmax", S.argmax_class("p0", "p1"))
    return S.pearson(v, ["fold"], "argmax", "label", out="pearson")
