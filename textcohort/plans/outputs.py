"""Run the whole workflow and write every output table, like the original scripts did.

    cohort TSV (label, comment, id)            -> <out>/cohort_<neg>.tsv/
    predictions, by fold and seed              -> <out>/pred/ (other seeds' stay)
    score report (fold, auc, auprc, pear)      -> <out>/score.tsv/
    attributions, by fold and seed             -> <out>/attribution/ (other seeds' stay)
    word consensus (word, count, shap_avg)     -> <out>/consensus/ (+ raw chunks in consensus_raw/)
    top words, sliced                          -> <out>/consensus_top/
    whole value lists of the top words         -> <out>/shap_raw/ (in pieces)
    absolute top-word table (CSV)              -> <out>/tbl_consensus.csv/
    example table (gt, pred, text, shap)       -> <out>/example.tsv/

Everything is computed by Spark jobs; the driver only receives the example count used for the
consensus threshold.  ``out_dir`` must be shared storage on a cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcohort.operators import attribution as AT
from textcohort.operators import consensus as CS
from textcohort.operators import report as RP
from textcohort.operators import scoring as S
from textcohort.plans import workflow as WF
from textcohort.plans.examples import EXAMPLES
from textcohort.sources import io as IO


def run_workflow(cohort: DataFrame, out_dir: str, *, neg_code: int = 6, folds: int = 10, seed: int = 0,
                 digits: int = 6, consensus_class: int = 0, example_fold: int | None = None,
                 picks=None, on_invalid: str = "raise") -> dict[str, str]:
    """``cohort``: ``(id, code, label, text)`` (see ``operators.cohort.build_cohort``).  The example table's
    fold and picks are those of the study with this ``neg_code``; for another code they must be given."""
    if (example_fold is None or picks is None) and neg_code not in EXAMPLES:
        raise ValueError(f"no example picks for negative code {neg_code}: give example_fold and picks")
    if example_fold is None:
        example_fold = EXAMPLES[neg_code][0]
    if picks is None:
        picks = EXAMPLES[neg_code][1]
    out = out_dir.rstrip("/")
    paths = {}
    paths["cohort"] = IO.write_delimited(
        cohort.select(F.col("code").cast("double").alias("label"), F.col("text").alias("comment"), "id"),
        f"{out}/cohort_{neg_code}.tsv")

    m = WF.fit_folds(cohort, folds=folds, seed=seed)
    preds = WF.scaled_predictions(m)
    paths["pred"] = IO.write_predictions(preds.select("fold", F.lit(seed).alias("seed"), "id", "pred"),
                                         f"{out}/pred")
    metrics = S.fold_metrics(preds.withColumnRenamed("label", "truth"), ["fold"], "pred", "truth", digits, on_invalid)
    report = S.format_report(S.fold_report(metrics))
    paths["score"] = IO.write_report(report.select("fold", F.col("auroc").alias("auc"),
                                                   F.col("auprc").alias("auprc"),
                                                   F.col("pearson").alias("pear")), f"{out}/score.tsv")
    ranked = S.rank_normalise(preds, ["fold"], "pred", "id", out="rank")
    paths["rank_score"] = IO.write_report(S.format_report(S.fold_report(WF.rank_report(ranked, digits))), f"{out}/rank_score.tsv")

    rows = m.texts("test")
    attr1 = AT.linear_attribution(m.folded("test"), m.counts, m.weights, m.priors, target_class=1, dealt=False)
    paths["attribution"] = IO.write_attributions(attr1.withColumn("seed", F.lit(seed)), f"{out}/attribution")
    attr1 = IO.read_attributions(cohort.sparkSession, paths["attribution"], seed=seed, folds=range(folds)).drop("seed")
    attr_c = attr1 if consensus_class == 1 else attr1.withColumn("phi", -F.col("phi"))

    cons = IO.materialize(CS.model_consensus(rows, m.counts, m.weights, m.priors, consensus_class), "consensus")
    paths["consensus"] = IO.write_delimited(cons, f"{out}/consensus")
    paths["consensus_raw"] = IO.write_delimited(CS.consensus_raw(attr_c), f"{out}/consensus_raw")
    n_examples = m.rows("test").count()
    top = CS.consensus_top(cons, -(-n_examples // 10))
    paths["consensus_top"] = IO.write_delimited(top, f"{out}/consensus_top")
    paths["shap_raw"] = IO.write_table(CS.consensus_lists(attr_c, top), f"{out}/shap_raw")
    paths["tbl_consensus"] = IO.write_delimited(CS.consensus_abs(top), f"{out}/tbl_consensus.csv", sep=",")

    picked = IO.materialize(RP.example_picks(ranked, example_fold, picks), "picks")
    example = RP.example_report(picked, cohort.select("id", "text"), attr1, picks)
    paths["example"] = IO.write_delimited(example.drop("pick"), f"{out}/example.tsv")
    return paths
