"""Token attribution for the linear text model, as joins over the long token table.

Linear Shapley on the logit: with ``x_t = tf_t / n_tok`` and the train mean ``m_t`` of ``x_t``,
``phi_t = w_t (x_t - m_t)``, spread evenly over the ``tf_t`` occurrences of ``t``.  Tokens absent
from the text (``x_t = 0``) are summed into one base row (``pos = -1``, token ``''``):
``base = -sum_all w_t m_t + sum_present w_t m_t`` — one scalar per fold plus one per text, no
dense matrix.  Invariant: ``sum(phi) = logit - mean train logit``.

Occlusion: the class-1 probability of the full text minus that of the text with one token
occurrence removed.  For this model the leave-one-out logit has a closed form,
``prior + (n * (logit - prior) - w_pos) / (n - 1)``, so no text variant is ever re-scored.

For a binary model the class-0 attribution is the negative of the class-1 attribution.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textcohort.functions.numeric import sigmoid
from textcohort.operators.model import keyed
from textcohort.operators.text import unfold


def _per_token(rows: DataFrame, counts: DataFrame, weights: DataFrame, fold_col: str, positions: bool = True) -> DataFrame:
    """``(fold, id, token, tf, n_tok, positions, w, mean_x)``: one row per distinct token of each text.

    Weights are attached at this level, so a frequent word is one row per text on the
    ``(fold, token)`` join, not one row per occurrence (AQE's skew split covers the rest).
    """
    pt = unfold(*keyed(rows, counts, fold_col), positions)
    return pt.join(weights.select(fold_col, "token", "w", "mean_x"), [fold_col, "token"], "left") \
             .withColumn("w", F.coalesce("w", F.lit(0.0))) \
             .withColumn("mean_x", F.coalesce("mean_x", F.lit(0.0)))


def _attach_to_occurrences(per_token: DataFrame, value: str, fold_col: str) -> DataFrame:
    """Spread a per-(text, token) value over the token's occurrences (a narrow explode)."""
    return per_token.select(fold_col, "id", "token", F.explode("positions").alias("pos"),
                            F.col(value).alias("phi")) \
                    .select(fold_col, "id", "pos", "token", "phi")


def _by_token(weights: DataFrame, fold_col: str) -> DataFrame:
    """``(token, _by)``: one row per token with its ``(w, mean_x)`` by fold.  Written: a join of two plain shuffles, which AQE splits
    where a token is in very many texts, or a broadcast where the written table is small."""
    from textcohort.sources.io import materialize

    by_fold = F.map_from_entries(F.collect_list(F.struct(F.col(fold_col), F.struct("w", "mean_x"))))
    return materialize(weights.groupBy("token").agg(by_fold.alias("_by")), "weights-by-token")


def _weighted(rows: DataFrame, wide: DataFrame, fold: Callable[[Column], Column], positions: bool = True) -> DataFrame:
    """``(id, n_tok, token, tf, positions, _own)`` of rows by text: one row per distinct token of a text and entry ``e`` of the array ``own``,
    ``_own`` that entry beside the weights of its fold (``e, w, mean_x``; 0 for unknown tokens).

    A text's tokens meet the weights where the text is, or one narrow row per text and token is shuffled by token; nothing returns to its text by ``id``."""
    if positions:
        tokens = rows.select("id", "own", "n_tok", F.explode(F.arrays_zip("terms", "places")).alias("_t"))
        tokens = tokens.select("id", "own", "n_tok", "_t.terms.token", "_t.terms.tf", F.col("_t.places").alias("positions"))
    else:
        tokens = rows.select("id", "own", F.explode("terms.token").alias("token"))
    others = [c for c in tokens.columns if c != "own"]
    none = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("mean_x"))

    def entry(e: Column) -> Column:
        found = F.coalesce(F.try_element_at("_by", fold(e)), none)
        return F.struct(e.alias("e"), found["w"].alias("w"), found["mean_x"].alias("mean_x"))

    return tokens.join(wide, "token", "left").select(*others, F.explode(F.transform("own", entry)).alias("_own"))


def _text_values(rows: DataFrame, weights: DataFrame, fold_col: str) -> DataFrame:
    """``(id, fold, place, folds, n_tok, entries)`` of rows by text (``workflow.PreparedFolds.folded``): one row per text and fold it is in,
    ``entries`` its distinct tokens ``(token, tf, positions, w, mean_x)`` with that fold's weights (0 for unknown tokens).

    A token meets the weights of all folds at once, so what is shuffled by token is one narrow row per text and token, whatever the
    number of folds; positions stay with the text.  The weights then return to their text by ``id``, and the result keeps
    that partitioning: what follows per text needs no shuffle."""
    wide = _by_token(weights, fold_col)
    tokens = rows.select("id", "own", F.posexplode("terms.token").alias("_i", "token")).join(wide, "token", "left")
    none = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("mean_x"))
    found = tokens.select("id", "_i", F.transform("own", lambda f: F.coalesce(F.try_element_at("_by", f), none)).alias("_v"))
    # dealt first: no token of a text meets another before the shuffle
    found = found.repartition("id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_found"))
    whole = rows.select("id", "own", "n_tok", "terms", "places").join(found, "id", "left")
    each = whole.select("id", "own", "n_tok", "terms", "places", "_found", F.posexplode("own").alias("_place", fold_col))
    return each.select("id", fold_col, F.col("own").alias("folds"), "n_tok", F.transform(
        F.coalesce(F.arrays_zip("terms", "places", "_found"), F.array()),
        lambda x: F.struct(x["terms"]["token"].alias("token"), x["terms"]["tf"].alias("tf"), x["places"].alias("positions"),
                           F.get(x["_found"]["_v"], F.col("_place"))["w"].alias("w"), F.get(x["_found"]["_v"], F.col("_place"))["mean_x"].alias("mean_x"))).alias("entries"))


def _spread(per_text: DataFrame, entries: Column, fold_col: str, target_class: int) -> DataFrame:
    """One row per occurrence of ``entries`` ``(token, positions, phi)``: two narrow explodes."""
    tokens = per_text.select(fold_col, "id", F.explode(entries).alias("_e"))
    out = tokens.select(fold_col, "id", F.explode("_e.positions").alias("pos"), F.col("_e.token").alias("token"), F.col("_e.phi").alias("phi"))
    return out.withColumn("phi", -F.col("phi")) if target_class == 0 else out


def linear_token_values(rows: DataFrame, counts: DataFrame, weights: DataFrame, fold_col: str = "fold", positions: bool = True) -> DataFrame:
    """``(fold, id, token, tf, positions, phi, wm)``: the value of each occurrence of a token in a text, and
    the token's part of the text's base (``w * mean``).  One row per distinct token of a text."""
    pt = _per_token(rows, counts, weights, fold_col, positions)
    x = F.col("tf") / F.col("n_tok")
    return pt.select(fold_col, "id", "token", "tf", *(["positions"] if positions else []),
                     (F.col("w") * (x - F.col("mean_x")) / F.col("tf")).alias("phi"),
                     (F.col("w") * F.col("mean_x")).alias("wm"))


def linear_attribution(rows: DataFrame, counts: DataFrame, weights: DataFrame, priors: DataFrame,
                       target_class: int = 1, fold_col: str = "fold", dealt: bool = True) -> DataFrame:
    """``(fold, id, pos, token, phi)`` for every token occurrence of the given ``(fold, id)`` rows.

    Occurrences come from the position lists of the token counts.  Rows by text (``workflow.PreparedFolds.folded``) get all their folds
    together, base rows included, and come out dealt by ``id``.  Where nothing that follows groups by text (a store), ``dealt=False``
    gives the same rows without moving texts or values by ``id``: only a text's base, one number per fold, is summed by ``id``.
    """
    from textcohort.sources.io import materialize

    if "own" in rows.columns and not dealt:
        wide = _by_token(weights, fold_col)
        w, mean = F.col("_own.w"), F.col("_own.mean_x")
        occ = _weighted(rows, wide, lambda f: f).select(
            F.col("_own.e").alias(fold_col), "id", F.explode("positions").alias("pos"), "token",
            (w * (F.col("tf") / F.col("n_tok") - mean) / F.col("tf")).alias("phi"))
        present = _weighted(rows, wide, lambda f: f, positions=False).groupBy(F.col("_own.e").alias(fold_col), "id").agg(F.sum(w * mean).alias("_present"))
        base = (rows.select(F.explode("own").alias(fold_col), "id").join(present, [fold_col, "id"], "left")
                    .join(F.broadcast(priors.select(fold_col, "mean_shift")), fold_col)
                    .select(fold_col, "id", F.lit(-1).alias("pos"), F.lit("").alias("token"),
                            (F.coalesce("_present", F.lit(0.0)) - F.col("mean_shift")).alias("phi")))
        out = occ.unionByName(base)
        return out.withColumn("phi", -F.col("phi")) if target_class == 0 else out
    if "own" in rows.columns:
        # one row per fold
        pt = _text_values(rows, weights, fold_col).join(F.broadcast(priors.select(fold_col, "mean_shift")), fold_col)
        present = F.aggregate("entries", F.lit(0.0), lambda s, x: s + x["w"] * x["mean_x"])
        # a fold that a repeated id has twice counts twice, as a join by (fold, id) does
        times = F.size(F.filter("folds", lambda f: f == F.col(fold_col)))
        base = F.struct(F.lit("").alias("token"), F.array(F.lit(-1)).alias("positions"), (times * present - F.col("mean_shift")).alias("phi"))
        values = F.transform("entries", lambda x: F.struct(x["token"].alias("token"), x["positions"].alias("positions"), (
            x["w"] * (x["tf"] / F.col("n_tok") - x["mean_x"]) / x["tf"]).alias("phi")))
        return _spread(pt, F.concat(F.array(base), values), fold_col, target_class)
    # read twice (occurrence rows and base rows): written once so the weight join runs once
    pt = materialize(linear_token_values(rows, counts, weights, fold_col), "attr-per-token")
    occ = _attach_to_occurrences(pt, "phi", fold_col)
    present = pt.groupBy(fold_col, "id").agg(F.sum("wm").alias("_present"))
    base = (rows.select(fold_col, "id")
                .join(present, [fold_col, "id"], "left")
                .join(priors.select(fold_col, "mean_shift"), fold_col)
                .select(fold_col, "id", F.lit(-1).alias("pos"), F.lit("").alias("token"),
                        (F.coalesce("_present", F.lit(0.0)) - F.col("mean_shift")).alias("phi")))
    out = occ.unionByName(base)
    if target_class == 0:
        out = out.withColumn("phi", -F.col("phi"))
    return out


def occlusion_attribution(rows: DataFrame, counts: DataFrame, weights: DataFrame,
                          scored: DataFrame, priors: DataFrame, target_class: int = 1,
                          fold_col: str = "fold") -> DataFrame:
    """``(fold, id, pos, token, phi)``: drop in class probability when one occurrence is removed."""
    n = F.col("n_tok").cast("double")
    if "own" in rows.columns:
        # the scores of a text beside its tokens: as many as it has folds
        s = scored.select(fold_col, "id", "logit").join(priors.select(fold_col, "prior"), fold_col)
        s = s.groupBy("id").agg(F.collect_list(F.struct(F.col(fold_col).alias("fold"), "logit", "prior")).alias("_scores"))
        own = F.flatten(F.transform("own", lambda f: F.filter("_scores", lambda x: x["fold"] == f)))
        each = _weighted(rows.join(s, "id").withColumn("own", own), _by_token(weights, fold_col), lambda e: e["fold"])
        logit, prior = F.col("_own.e.logit"), F.col("_own.e.prior")
        loo = F.when(n > 1, prior + (n * (logit - prior) - F.col("_own.w")) / (n - 1)).otherwise(prior)
        out = each.select(F.col("_own.e.fold").alias(fold_col), "id", F.explode("positions").alias("pos"), "token",
                          (sigmoid(logit) - sigmoid(loo)).alias("phi"))
        return out.withColumn("phi", -F.col("phi")) if target_class == 0 else out
    pt = _per_token(rows, counts, weights, fold_col)
    s = scored.select(fold_col, "id", "logit").join(priors.select(fold_col, "prior"), fold_col)
    pt = pt.join(s, [fold_col, "id"])
    loo = F.when(n > 1, F.col("prior") + (n * (F.col("logit") - F.col("prior")) - F.col("w")) / (n - 1)) \
           .otherwise(F.col("prior"))
    pt = pt.withColumn("_phi", sigmoid(F.col("logit")) - sigmoid(loo))
    out = _attach_to_occurrences(pt, "_phi", fold_col)
    if target_class == 0:
        out = out.withColumn("phi", -F.col("phi"))
    return out
