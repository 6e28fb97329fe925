import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textcohort.operators import scoring as S


def _scores(spark, ys, ps, fold=0):
    return spark.createDataFrame([(fold, i + 1, int(y), float(p)) for i, (y, p) in enumerate(zip(ys, ps))],
                                 "fold int, id long, truth int, pred double")


def _auc(spark, ys, ps, digits=3):
    r = S.auc_scores(_scores(spark, ys, ps), digits=digits).collect()[0]
    return r["auroc"], r["auprc"]


def test_auc_basic(spark):
    roc, pr = _auc(spark, [0, 0, 1, 1], [.1, .4, .35, .8])
    assert roc == pytest.approx(0.75)
    assert pr == pytest.approx(0.833333, abs=1e-6)


def test_auc_perfect(spark):
    assert _auc(spark, [0, 1], [0.0, 1.0]) == (pytest.approx(1.0), pytest.approx(1.0))


def test_auc_all_tied(spark):
    assert _auc(spark, [0, 1], [.5, .5]) == (pytest.approx(0.5), pytest.approx(0.5))


def test_auc_one_class(spark):
    roc, pr = _auc(spark, [1, 1], [.2, .7])
    assert math.isnan(roc) and math.isnan(pr)


def _brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum()
    eq = (pos[:, None] == neg[None, :]).sum()
    return (gt + 0.5 * eq) / (len(pos) * len(neg))


def _mean_precision(y, p):
    """AUPRC by its meaning: the mean over positives of the precision among all rows that score at
    least as high."""
    return np.mean([(y[p >= t] == 1).mean() for t in p[y == 1]])


def test_auc_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 400)
    p = np.round(rng.random(400), 2)  # many ties
    roc, pr = _auc(spark, y, p, digits=2)
    assert roc == pytest.approx(_brute_auc(y, p), abs=1e-12)
    assert pr == pytest.approx(_mean_precision(y, p), abs=1e-12)
    df = _scores(spark, y, p)
    assert S.rank_sum_auc(df).collect()[0]["rank_sum"] == pytest.approx(roc, abs=1e-12)


def test_auc_complement(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 200)
    p = rng.random(200).round(6)
    roc, _ = _auc(spark, y, p, digits=6)
    roc2, _ = _auc(spark, y, (1 - p).round(6), digits=6)
    assert roc + roc2 == pytest.approx(1.0, abs=1e-9)


def test_score_invalid(spark):
    df = spark.createDataFrame([(0, 1, 1, 1.2), (0, 2, 0, float("nan")), (0, 3, 1, 0.4)],
                               "fold int, id long, truth int, pred double")
    assert S.score_validate(df).collect()[0]["n_invalid"] == 2
    with pytest.raises(Exception, match="invalid values"):
        S.score_validate(df, strict=True).collect()


def _folds(spark, **bad):
    """Three folds of ten rows; ``bad`` maps ``f<fold>`` to the score of the fold's first row."""
    rows = [(f, i, i % 2, bad.get(f"f{f}", 0.05) if i == 0 else i / 10) for f in range(3) for i in range(10)]
    return spark.createDataFrame(rows, "fold int, id long, truth int, pred double")


@pytest.mark.parametrize("value", [float("nan"), 1.2, -0.4, None])
def test_reports_stop_on_an_invalid_score(spark, value):
    df = _folds(spark, f1=value)
    for report in (lambda: S.auc_scores(df), lambda: S.fold_report(S.fold_metrics(df))):
        with pytest.raises(Exception, match="invalid values"):
            report().collect()


@pytest.mark.parametrize("value", [float("nan"), 1.2, None])
def test_report_mode_counts_and_keeps_the_fold(spark, value):
    metrics = S.fold_metrics(_folds(spark, f1=value), on_invalid="nan")
    rep = {r["fold"]: r for r in S.fold_report(metrics).collect()}
    assert set(rep) == {"fold0", "fold1", "fold2", "avg", "median"}
    assert rep["fold1"]["n_invalid"] == 1 and rep["fold0"]["n_invalid"] == 0 and rep["avg"]["n_invalid"] == 1
    assert all(math.isnan(rep[f]["auroc"]) for f in ("fold1", "avg", "median"))
    assert rep["fold0"]["auroc"] == pytest.approx(rep["fold2"]["auroc"]) and not math.isnan(rep["fold0"]["auprc"])


def test_constant_fold_after_scaling(spark):
    df = _folds(spark).withColumn("score", F.when(F.col("fold") == 2, 0.5).otherwise(F.col("pred"))).drop("pred")
    with pytest.raises(Exception, match="invalid values"):
        S.scaled_fold_metrics(df).collect()
    got = {r["fold"]: r for r in S.scaled_fold_metrics(df, on_invalid="nan").collect()}
    assert math.isnan(got[2]["auroc"]) and got[2]["n_invalid"] == 10 and not math.isnan(got[0]["auroc"])


def test_scaled_metrics_equal_the_two_steps(spark):
    df = _folds(spark).withColumn("score", F.col("pred") * 7 - 3).drop("pred")
    one = {r["fold"]: r for r in S.scaled_fold_metrics(df).collect()}
    two = {r["fold"]: r for r in S.fold_metrics(S.minmax_scale(df, score="score", out="pred")).collect()}
    for f in range(3):
        for c in ("auroc", "auprc", "pearson"):
            assert one[f][c] == pytest.approx(two[f][c], abs=1e-12)


def test_missing_metric_is_undefined_in_the_summary(spark):
    m = spark.createDataFrame([(0, 1.0, 0.5, 0.1), (1, None, 0.5, 0.1)], "fold int, auroc double, auprc double, pearson double")
    rep = {r["fold"]: r for r in S.fold_report(m).collect()}
    assert all(math.isnan(rep[f]["auroc"]) for f in ("fold1", "avg", "median")) and rep["avg"]["auprc"] == 0.5


def test_minmax_constant(spark):
    df = spark.createDataFrame([(0, 1, .3), (0, 2, .3)], "fold int, id long, pred double")
    vals = [r["pred"] for r in S.minmax_scale(df).collect()]
    assert all(math.isnan(v) for v in vals)


def test_rank_basic(spark):
    df = spark.createDataFrame([(0, 1, .9), (0, 2, .1), (0, 3, .5)], "fold int, id long, pred double")
    r = {x["id"]: x["rank"] for x in S.rank_normalise(df).collect()}
    assert r == {1: 1.0, 2: 0.0, 3: 0.5}


def test_rank_ties(spark):
    df = spark.createDataFrame([(0, 1, .2), (0, 2, .2), (0, 3, .7)], "fold int, id long, pred double")
    r = {x["id"]: x["rank"] for x in S.rank_normalise(df).collect()}
    assert r == {1: 0.0, 2: 0.5, 3: 1.0}


def test_rank_heavy_tie_many_partitions(spark):
    # a third of the rows share one score: ranks stay exact, ties broken by id
    rows = [(0, i, 0.5 if i % 3 == 0 else i / 1000.0) for i in range(600)]
    df = spark.createDataFrame(rows, "fold int, id long, pred double").repartition(7)
    got = {x["id"]: x["rank"] for x in S.rank_normalise(df).collect()}
    order = sorted(rows, key=lambda r: (r[2], r[1]))
    want = {r[1]: i / 599 for i, r in enumerate(order)}
    assert got == pytest.approx(want)


def test_median_even(spark):
    m = spark.createDataFrame([(i, float(v), 0.0, 0.0) for i, v in enumerate([1, 2, 4, 9])],
                              "fold int, auroc double, auprc double, pearson double")
    rep = {r["fold"]: r for r in S.fold_report(m).collect()}
    assert rep["median"]["auroc"] == 3.0
    assert rep["avg"]["auroc"] == 4.0
    assert set(rep) == {"fold0", "fold1", "fold2", "fold3", "avg", "median"}


def test_median_nan_propagates(spark):
    m = spark.createDataFrame([(0, 1.0, 0.0, 0.0), (1, float("nan"), 0.0, 0.0), (2, 3.0, 0.0, 0.0)],
                              "fold int, auroc double, auprc double, pearson double")
    rep = {r["fold"]: r for r in S.fold_report(m).collect()}
    assert math.isnan(rep["median"]["auroc"]) and math.isnan(rep["avg"]["auroc"])


def test_pearson_constant(spark):
    df = spark.createDataFrame([(0, 1, 1, .2), (0, 2, 1, .7)], "fold int, id long, truth int, pred double")
    assert math.isnan(S.pearson(df).collect()[0]["pearson"])


def test_pearson_value(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 50)
    p = rng.random(50)
    got = S.pearson(_scores(spark, y, p)).collect()[0]["pearson"]
    assert got == pytest.approx(np.corrcoef(p, y)[0, 1], abs=1e-12)


def test_roc_curve_endpoints(spark):
    df = _scores(spark, [0, 0, 1, 1], [.1, .4, .35, .8])
    r = S.roc_curve(df).orderBy("bin").collect()
    assert r[-1]["tpr"] == 0.0 and r[-1]["tnr"] == 1.0
    assert r[0]["tpr_prev"] == 1.0 and r[0]["tnr_prev"] == 0.0


def test_format_report(spark):
    m = spark.createDataFrame([(0, 0.6976, 0.5, 0.25)], "fold int, auroc double, auprc double, pearson double")
    rows = S.format_report(S.fold_report(m)).filter(F.col("fold") == "fold0").collect()
    assert rows[0]["auroc"] == "0.698"


from hypothesis import given, settings, HealthCheck, strategies as st


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 20)), min_size=2, max_size=40))
def test_auc_property_brute_force(spark, pairs):
    y = np.array([p[0] for p in pairs])
    s = np.array([p[1] / 20.0 for p in pairs])
    roc, pr = _auc(spark, y, s, digits=2)
    if y.min() == y.max():
        assert math.isnan(roc) and math.isnan(pr)
    else:
        assert roc == pytest.approx(_brute_auc(y, s), abs=1e-12)
        assert pr == pytest.approx(_mean_precision(y, s), abs=1e-12)
