"""Stores by fold and seed: separate writes, rewrites, failed writes, writers at the same time."""

import uuid
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from textcohort.plans import registry as R
from textcohort.plans.outputs import run_workflow
from textcohort.sources import io as IO
from textcohort.sources import store as ST

SCHEMA = "fold int, seed int, id long, pred double"


@pytest.fixture
def path(tmp_path):
    return f"{tmp_path}/store-{uuid.uuid4().hex}"


def rows(spark, fold, seed, ids, pred=0.5):
    return spark.createDataFrame([(fold, seed, i, pred) for i in ids], SCHEMA)


def held(spark, path, **only):
    return sorted((r.fold, r.seed, r.id, r.pred) for r in ST.read_store(spark, path, **only).collect())


def test_writes_keep_other_keys_and_replace_their_own(spark, path):
    for fold, seed in ((0, 0), (1, 0), (0, 1)):
        IO.write_predictions(rows(spark, fold, seed, [1, 2]), path)
    IO.write_predictions(rows(spark, 1, 0, [7], 0.25), path)
    assert held(spark, path) == [(0, 0, 1, .5), (0, 0, 2, .5), (0, 1, 1, .5), (0, 1, 2, .5), (1, 0, 7, .25)]
    assert IO.read_predictions(spark, path).dtypes == [("id", "bigint"), ("pred", "double"), ("fold", "int"), ("seed", "int")]
    assert held(spark, path, fold=0, seed=1) == [(0, 1, 1, .5), (0, 1, 2, .5)] and held(spark, path, fold=9) == []
    # the state that an earlier write left is still whole
    assert held(spark, path, number=2) == [(0, 0, 1, .5), (0, 0, 2, .5), (1, 0, 1, .5), (1, 0, 2, .5)]


def test_a_failed_write_changes_nothing(spark, path):
    IO.write_predictions(rows(spark, 0, 0, [1]), path)
    bad = rows(spark, 0, 0, [1, 2]).withColumn("pred", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(0.1))
    with pytest.raises(Exception, match="lost"):
        IO.write_predictions(bad, path)
    assert held(spark, path) == [(0, 0, 1, .5)]
    with pytest.raises(ValueError, match="null"):
        IO.write_predictions(rows(spark, None, 0, [1]), path)
    assert held(spark, path) == [(0, 0, 1, .5)]


def test_writers_at_the_same_time_both_stay(spark, path):
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: IO.write_predictions(rows(spark, k, 3, [k]), path), range(4)))
    assert [r[0] for r in held(spark, path)] == [0, 1, 2, 3]


def test_a_taken_number_is_not_overwritten(spark, path):
    IO.write_predictions(rows(spark, 0, 0, [1]), path)
    files = ST._Files(spark, path)
    files.fs.mkdirs(files.path(f"{path}/_draft/x"))
    assert not files.publish(f"{path}/_draft/x", f"{path}/_manifest/000000001")
    assert held(spark, path) == [(0, 0, 1, .5)]


def test_vacuum_keeps_what_the_last_manifest_names(spark, path):
    for k in range(3):
        IO.write_predictions(rows(spark, 0, 0, [k]), path)
    IO.write_predictions(rows(spark, 1, 0, [9]), path)
    assert len(ST.vacuum(spark, path)) == 2
    assert [r[2] for r in held(spark, path)] == [2, 9]


def test_missing_store(spark, path):
    with pytest.raises(FileNotFoundError):
        ST.read_store(spark, path)


def test_two_seeds_of_the_workflow_live_side_by_side(spark, path):
    cohort = R.cohort_df(spark, SF_SMALL)
    first = run_workflow(cohort, path, folds=2, seed=0, on_invalid="nan", example_fold=0)
    before = IO.read_predictions(spark, first["pred"], seed=0).select("fold", "id", "pred").collect()
    second = run_workflow(cohort, path, folds=2, seed=1, on_invalid="nan", example_fold=0)
    both = IO.read_predictions(spark, second["pred"])
    assert {(r.fold, r.seed) for r in both.select("fold", "seed").distinct().collect()} == {(f, s) for f in (0, 1) for s in (0, 1)}
    assert sorted(both.filter("seed = 0").select("fold", "id", "pred").collect()) == sorted(before)
    assert {r.seed for r in IO.read_attributions(spark, second["attribution"]).select("seed").distinct().collect()} == {0, 1}


def test_rows_are_written_by_key_without_a_sort(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter
    name, seen, own = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (seen.append(int(spark.conf.get(name))), own(self, *a, **k))[1])
    before = spark.conf.get(name)
    rows = spark.range(0, 4000, 1, 2).selectExpr("cast(id % 40 as int) fold", "id")      # more keys than files open at a time
    IO.write_attributions(rows, str(tmp_path / "s"))
    assert seen[0] >= 10 and spark.conf.get(name) == before
    back = IO.read_attributions(spark, str(tmp_path / "s"))
    assert sorted(tuple(r) for r in back.select("fold", "id").collect()) == sorted((i % 40, i) for i in range(4000))
