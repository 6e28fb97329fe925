import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from textcohort.operators import attribution as AT
from textcohort.operators import model as M
from textcohort.plans import registry as R
from textcohort.plans import workflow as WF


@pytest.fixture(scope="module")
def fitted(spark):
    return WF.fit_folds(R.cohort_df(spark, SF_SMALL), folds=3, seed=0)


def test_probabilities_in_range(fitted):
    s = WF.score_split(fitted, "test")
    rows = s.collect()
    assert rows and all(0.0 <= r["prob"] <= 1.0 for r in rows)
    # every test id scored once per fold
    assert s.groupBy("fold", "id").count().filter(F.col("count") != 1).count() == 0
    assert s.count() == fitted.split.filter(F.col("split") == "test").count()


def test_attribution_sums_to_logit_shift(fitted):
    rows = fitted.split.filter(F.col("split") == "test").select("fold", "id", "label")
    a = AT.linear_attribution(rows, fitted.counts, fitted.weights, fitted.priors)
    scored = M.nb_score(rows, fitted.counts, fitted.weights, fitted.priors)
    tot = a.groupBy("fold", "id").agg(F.sum("phi").alias("s"))
    j = tot.join(scored, ["fold", "id"]).join(fitted.priors, "fold")
    res = j.select((F.col("s") - (F.col("logit") - F.col("prior") - F.col("mean_shift"))).alias("r")).collect()
    assert res and max(abs(r["r"]) for r in res) < 1e-9


def test_class0_is_negative_class1(fitted):
    rows = fitted.split.filter(F.col("split") == "test").select("fold", "id", "label")
    a1 = AT.linear_attribution(rows, fitted.counts, fitted.weights, fitted.priors, 1)
    a0 = AT.linear_attribution(rows, fitted.counts, fitted.weights, fitted.priors, 0)
    j = a1.join(a0.withColumnRenamed("phi", "phi0"), ["fold", "id", "pos", "token"])
    assert j.filter(F.abs(F.col("phi") + F.col("phi0")) > 1e-12).count() == 0


def test_oversampled_balanced(fitted):
    c = fitted.balanced.groupBy("fold").agg(F.sum(F.when(F.col("label") == 1, F.col("mult"))).alias("p"),
                                            F.sum(F.when(F.col("label") == 0, F.col("mult"))).alias("n")).collect()
    assert c and all(r["p"] == r["n"] for r in c)


def test_multiplicity_equals_explicit_copies(spark, fitted):
    from textcohort.operators import split as SP
    copies = M.train_multiplicity(SP.oversample(fitted.split, seed=0))
    mult = SP.oversample_multiplicity(fitted.split, seed=0)
    a = sorted(tuple(r) for r in copies.select("fold", "id", "label", "mult").collect())
    b = sorted(tuple(r) for r in mult.select("fold", "id", "label", "mult").collect())
    assert a == b


def test_map_in_pandas_scorer_matches_join_scorer(spark, fitted):
    from textcohort.operators import scorer as SC
    inputs = SC.nb_inputs(fitted.rows("test"), fitted.counts, fitted.weights, fitted.priors)
    a = SC.score_with(inputs, SC.nb_scorer_factory())
    b = WF.score_split(fitted, "test")
    j = a.select("fold", "id", F.col("prob").alias("pa")).join(b.select("fold", "id", "prob"), ["fold", "id"])
    assert j.count() == b.count()
    assert j.filter(F.abs(F.col("pa") - F.col("prob")) > 1e-9).count() == 0


def test_scorer_of_a_text_without_known_tokens(spark, fitted):
    from textcohort.operators import scorer as SC
    rows = spark.createDataFrame([(0, -5, 1)], "fold int, id long, label int")
    inputs = SC.nb_inputs(rows, fitted.counts, fitted.weights, fitted.priors)
    prior = fitted.priors.filter("fold = 0").collect()[0]["prior"]
    got = SC.score_with(inputs, SC.nb_scorer_factory()).collect()
    assert got[0]["prob"] == pytest.approx(1 / (1 + math.exp(-prior)))


def test_lr_invariants(spark, fitted):
    from textcohort.operators import ml as ML
    from textcohort.operators import text as TX
    features = ML.hashed_features(TX.doc_tokens(fitted.cohort), num_features=1 << 10)
    train = ML.fold_rows(fitted.balanced, features, "t-train")
    test = ML.fold_rows(fitted.rows("test"), features, "t-test")
    models = ML.lr_fit(train, [0, 1])
    p = ML.lr_score(models, test).collect()
    assert len(p) == test.filter("fold < 2").count()
    assert all(0.0 <= r["prob"] <= 1.0 for r in p)
    assert len({(r["fold"], r["id"]) for r in p}) == len(p)
    assert all(done for _, done in ML.lr_summary(models))
    assert all(r["residual"] < 1e-4 for r in ML.lr_residual(models, train).filter("fold < 2").collect())


def test_occlusion_sign_and_range(spark, fitted):
    rows = fitted.split.filter(F.col("split") == "test").select("fold", "id", "label")
    scored = M.nb_score(rows, fitted.counts, fitted.weights, fitted.priors)
    a1 = AT.occlusion_attribution(rows, fitted.counts, fitted.weights, scored, fitted.priors, 1)
    vals = [r["phi"] for r in a1.select("phi").collect()]
    assert vals and all(-1.0 <= v <= 1.0 for v in vals)
