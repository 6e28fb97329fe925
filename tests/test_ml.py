"""The per-fold regressions: same optimum as Spark ML's, and what reaches the driver does not grow with the partitions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from textcohort.operators import ml as ML

SLOTS = 1 << 12


def train_rows(spark, parts: int = 4, folds: int = 2):
    """Texts of 40 words with a repeated id and an empty text; fold 1 has other copies than fold 0."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        label = int(rng.random() < 0.4)
        tokens = [] if i == 7 else [f"w{j}" for j in rng.integers(label * 4, 36 + label * 4, 12)]
        rows.append((i if i != 9 else 8, label, tokens))
    texts = spark.createDataFrame(rows, "id long, label int, tokens array<string>")
    features = ML.HashingTF(inputCol="tokens", outputCol="features", numFeatures=SLOTS).transform(texts)
    every = features.crossJoin(spark.range(folds).select(F.col("id").cast("int").alias("fold")))
    return every.withColumn("mult", (F.col("id") * (F.col("fold") + 1)) % 3 + 1).drop("tokens").repartition(parts)


def test_fits_equal_spark_ml(spark):
    train = train_rows(spark).cache()
    models = ML.lr_fit(train, [0, 1], tol=1e-9)
    for f in (0, 1):
        data = train.filter(F.col("fold") == f).withColumn("label", F.col("label").cast("double")).withColumn("mult", F.col("mult").cast("double"))
        whole = LogisticRegression(regParam=ML.REG, maxIter=500, tol=1e-12, weightCol="mult").fit(data)
        assert np.abs(whole.coefficients.toArray() - models[f].coefficients).max() < 1e-3
        assert models[f].intercept == pytest.approx(whole.intercept, abs=1e-3)
        ours = {tuple(r) for r in ML.lr_score({f: models[f]}, train).select("id", F.round("prob", 2)).collect()}
        assert len(ours) > 10 and all(0 <= p <= 1 for _, p in ours)


def test_driver_gets_a_row_per_slot_in_use(spark, monkeypatch):
    def tables(parts: int) -> list[tuple[int, int]]:
        train, seen = train_rows(spark, parts).cache(), []
        own = type(train).toArrow

        def watched(df):
            table = own(df)
            seen.append((table.num_rows, table.nbytes))
            return table

        with monkeypatch.context() as m:
            m.setattr(type(train), "toArrow", watched)
            ML.lr_fit(train, [0, 1], max_iter=5)
        return seen

    few, many = tables(1), tables(24)
    assert len(few) == len(many) == 7          # the moments, the start and five steps
    assert [n for n, _ in few] == [n for n, _ in many]
    # 40 words, intercept and loss: all passes together less than one dense gradient
    assert all(n <= 42 for n, _ in many[1:]) and sum(b for _, b in many) < 8 * SLOTS


def test_passes_send_the_driver_a_row_per_fold(spark, monkeypatch):
    """Each text has words of its own, so many slots are in use; a block holds one text."""
    rows = [(i, i % 3 // 2, i % 2 + 1, f, [f"w{j}" for j in range(i * 10, i * 10 + 30)]) for i in range(40) for f in (0, 1)]
    texts = spark.createDataFrame(rows, "id long, label int, mult int, fold int, tokens array<string>")
    train = ML.HashingTF(inputCol="tokens", outputCol="features", numFeatures=SLOTS).transform(texts).drop("tokens").cache()
    whole, seen, own = ML.lr_fit(train, [0, 1], max_iter=3), [], type(train).toArrow

    def watched(df):
        table = own(df)
        seen.append((table.num_rows, table.nbytes))
        return table

    monkeypatch.setattr(type(train), "toArrow", watched)
    monkeypatch.setattr(ML, "FEATURES", 1)
    models = ML.lr_fit(train, [0, 1], max_iter=3)
    assert len(seen) == 5 and all(n <= 2 and size < 1000 for n, size in seen)
    for f in (0, 1):
        assert np.count_nonzero(models[f].coefficients) > 300 and models[f].iterations == 3
        assert np.allclose(models[f].coefficients, whole[f].coefficients, atol=1e-6)


def test_equal_labels_and_folds_without_rows(spark):
    train = train_rows(spark).withColumn("label", F.when(F.col("fold") == 1, 1).otherwise(F.col("label")))
    models = ML.lr_fit(train, [0, 1])
    assert models[1].intercept == np.inf and not models[1].coefficients.any() and models[1].iterations == 0
    assert {r.prob for r in ML.lr_score(models, train.filter("fold = 1")).collect()} == {1.0}
    with pytest.raises(ValueError, match="folds without train rows"):
        ML.lr_fit(train, [0, 5])


def test_stored_models_are_the_same(spark, tmp_path):
    models = ML.lr_fit(train_rows(spark), [0, 1])
    again = ML.load_models(ML.save_models(models, str(tmp_path)))
    for f, m in models.items():
        assert np.array_equal(again[f].coefficients, m.coefficients)
        assert (again[f].intercept, again[f].iterations) == (m.intercept, m.iterations)


def test_texts_with_their_folds_are_the_same_rows(spark):
    """Text 3 is twice in fold 0, fold 7 is not fitted, and ids repeat as in ``train_rows``: nested and flat rows give the same models and scores."""
    rows = train_rows(spark)
    features = rows.filter("fold = 0").select("id", "features")
    placed = rows.select("fold", "id", "label", "mult").distinct()
    placed = placed.unionByName(placed.filter("fold = 0 AND id = 3")).unionByName(placed.filter("fold = 1").withColumn("fold", F.lit(7)))
    flat, nested = (ML.fold_rows(placed, features, "t-rows", nested=n).cache() for n in (False, True))
    assert nested.count() == 62 and flat.count() == nested.select(F.inline("folds")).count()      # id 8: two labels, two texts
    a, b = (ML.lr_fit(t, [1, 0], max_iter=4) for t in (flat, nested))
    for f in (0, 1):
        assert np.allclose(a[f].coefficients, b[f].coefficients, atol=1e-6) and a[f].intercept == pytest.approx(b[f].intercept, abs=1e-6)
    one, two = (sorted((r.fold, r.id, r.label, round(r.prob, 5)) for r in ML.lr_score(a, t).collect()) for t in (flat, nested))
    assert one == two and {r[0] for r in two} == {0, 1} and len(two) == flat.filter("fold < 2").count()
    r, s = ({x.fold: x.residual for x in ML.lr_residual(a, t).collect()} for t in (flat, nested))
    assert set(r) == {0, 1} and all(r[f] == pytest.approx(s[f], abs=1e-9) for f in r)


def test_a_pass_is_one_job(spark):
    """And one for the few numbers that the driver asks for; no row per slot is dealt."""
    train, sc = train_rows(spark).cache(), spark.sparkContext
    train.count()

    def jobs(passes: int) -> int:
        sc.setJobGroup(f"fit-{passes}", "")
        ML.lr_fit(train, [0, 1], max_iter=passes)
        sc.setLocalProperty("spark.jobGroup.id", None)
        return len(sc.statusTracker().getJobIdsForGroup(f"fit-{passes}"))

    assert jobs(5) - jobs(2) == 2 * 3


def test_numbers_are_stored_as_they_are():
    for numbers, kind in (([0, 255], "B"), ([1, 256], "H"), ([70000, 3], "i"), ([-1, 2], "i"), ([0.5, 2], "f"), ([0.1], "d"), ([np.nan], "d"), ([2.0 ** 40], "f"), ([], "B")):
        stored = ML._least(np.array(numbers))
        assert stored.dtype.char == kind and np.array_equal(stored, numbers, equal_nan=kind == "d")
