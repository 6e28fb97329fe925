import pytest
from pyspark.sql import functions as F

from textcohort.functions.text import tokenise, trim_tail_chars, trim_tail_items
from textcohort.operators import consensus as CS
from textcohort.sources import io as IO
from textcohort.session import scratch_path


def test_tokenise_whole_text(spark):
    text = "Word " * 5000 + "end!"
    df = spark.createDataFrame([(text,)], "t string")
    toks = df.select(tokenise(F.col("t")).alias("x")).collect()[0]["x"]
    assert len(toks) == 5002 and toks[-2:] == ["end", "!"]


def test_consensus(spark):
    a = spark.createDataFrame([(0, 1, 0, "a", .5), (0, 2, 0, "a", -.3), (0, 3, 0, "b", .2)],
                              "fold int, id long, pos int, token string, phi double")
    got = {r["word"]: (r["count"], r["shap_avg"]) for r in CS.consensus(a).collect()}
    assert got["a"][0] == 2 and got["a"][1] == pytest.approx(0.1)
    assert got["b"] == (1, pytest.approx(0.2))


def test_consensus_raw_order(spark):
    a = spark.createDataFrame([(0, 1, 2, "a", .5), (0, 1, 0, "A", -.25), (1, 1, 0, "a", .123)],
                              "fold int, id long, pos int, token string, phi double")
    raw = {(r["fold"], r["id"]): r["raw"] for r in CS.consensus_raw(a).collect()}
    assert raw == {(0, 1): "-0.25_0.50", (1, 1): "0.12"}


def test_slice_10_3(spark):
    words = [f"w{i:02d}" for i in range(20)]
    cons = spark.createDataFrame([(w, 5, 0.0) for w in words], "word string, count long, shap_avg double")
    got = [r["word"] for r in CS.consensus_top(cons, 1).orderBy("word").collect()]
    assert got == words[10:17]


def test_consensus_abs(spark):
    cons = spark.createDataFrame([("a", 5, -0.5, "x")], "word string, count long, shap_avg double, shap_raw string")
    r = CS.consensus_abs(cons).collect()[0]
    assert r.asDict() == {"word": "a", "count": 5, "shap_avg": 0.5}


def test_trims(spark):
    df = spark.createDataFrame([("abcdef", [1.0, 2.0, 3.0]), ("ab", [1.0])], "t string, v array<double>")
    got = df.select(trim_tail_chars(F.col("t"), 3).alias("t"), trim_tail_items(F.col("v"), 1).alias("v")).collect()
    assert (got[0]["t"], got[0]["v"]) == ("abc", [1.0, 2.0])
    assert (got[1]["t"], got[1]["v"]) == ("", [])


def test_tsv_special(spark):
    rows = [(1, 'tab\there "quoted" and\nnewline'), (2, "")]
    df = spark.createDataFrame(rows, "id long, comment string")
    path = IO.write_delimited(df, scratch_path(spark, "tsv-test"), sep="\t")
    back = {r["id"]: r["comment"] for r in IO.read_delimited(spark, path, casts={"id": "long"}).collect()}
    assert back[1] == rows[0][1]
    assert back[2] is None


@pytest.mark.parametrize("sep", [",", "\t"])
def test_white_space_survives_the_round_trip(spark, sep):
    rows = [(1, "  lead and trail  "), (2, "\tx\n "), (3, " "), (4, "a\r\nb")]
    path = IO.write_delimited(spark.createDataFrame(rows, "id long, comment string"), scratch_path(spark, "blanks"), sep=sep)
    back = IO.read_delimited(spark, path, sep=sep, casts={"id": "long"}).collect()
    assert {r["id"]: r["comment"] for r in back}.items() >= dict(rows[:3]).items()


def test_missing_spellings(spark):
    rows = [("1", "NA"), ("NA", "n/a"), ("x", "nan"), ("2.5", "NULL"), (None, "kept")]
    path = IO.write_delimited(spark.createDataFrame(rows, "code string, comment string"), scratch_path(spark, "na"), sep=",")
    back = IO.read_delimited(spark, path, sep=",", casts={"code": "double"}, missing=IO.MISSING).collect()
    assert sorted((str(r["code"]), str(r["comment"])) for r in back) == sorted(
        [("1.0", "None"), ("None", "None"), ("None", "None"), ("2.5", "None"), ("None", "kept")])


def test_survey_from_csv(spark):
    from textcohort.operators.cohort import build_cohort
    from textcohort.sources.tables import SURVEY_CODE, SURVEY_COMMENTS, SURVEY_ID, survey_from_csv
    cols = ["Other", SURVEY_CODE, *SURVEY_COMMENTS, SURVEY_ID]
    rows = [("x", "2.0", "lost smell", None, None, 'ok, "really"\nyes', "English_1"),
            ("x", "6.0", None, None, None, None, "English_2"),
            ("x", "6.0", "fine", None, None, None, "English_3"),
            ("x", "4.0", "n/a", None, None, None, "English_4"),
            ("x", "NA", "coded NA", None, None, None, "English_6"),
            ("x", "6.0", "N/A", "nan", "NULL", "n/a", "English_7"),
            ("x", "3.0", "taste gone", None, None, None, "Spanish_5")]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols))
    path = IO.write_delimited(df, scratch_path(spark, "survey-csv"), sep=",")
    survey = survey_from_csv(spark, path)
    got = {r["id"]: r["comment"] for r in survey.collect()}
    assert got["English_1"] == 'lost smell|nan|nan|ok, "really"\nyes'
    c = {r["id"]: (r["code"], r["label"]) for r in
         build_cohort(survey, lang_needle="English", pos_codes=(2, 3), neg_code=6).collect()}
    # English only, classes 2/3/6, all-missing comments dropped
    assert c == {"English_1": (2, 1), "English_3": (6, 0)}


def test_run_workflow_writes_outputs(spark):
    from tests.conftest import SF_SMALL
    from textcohort.plans import registry as R
    from textcohort.plans.outputs import run_workflow
    out = scratch_path(spark, "workflow-out")
    paths = run_workflow(R.cohort_df(spark, SF_SMALL), out, folds=3)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tc_") and t.name in IO._BUCKETED]
    with pytest.raises(ValueError, match="no example picks"):
        run_workflow(R.cohort_df(spark, SF_SMALL), out, neg_code=9, folds=3)
    score = IO.read_delimited(spark, paths["score"]).collect()
    assert [r["fold"] for r in score][-2:] == ["avg", "median"] and len(score) == 5
    assert IO.read_delimited(spark, paths["consensus"]).count() > 0
    assert spark.read.parquet(paths["pred"]).count() == 3 * (
        R.cohort_df(spark, SF_SMALL).count() - int(0.8 * R.cohort_df(spark, SF_SMALL).count()))


def test_prediction_store_prunes_partitions(spark):
    df = spark.range(100).select((F.col("id") % 5).cast("int").alias("fold"), F.lit(0).alias("seed"),
                                 F.col("id"), (F.col("id") / 100.0).alias("pred"))
    path = IO.write_predictions(df, scratch_path(spark, "pred-prune"))
    one = IO.read_predictions(spark, path, fold=3, seed=0)
    assert sorted(r["id"] for r in one.collect()) == list(range(3, 100, 5))
    assert one.inputFiles() and all("/fold=3/seed=0/" in f for f in one.inputFiles())
    # a filter on the whole store prunes at the scan, too
    plan = IO.read_predictions(spark, path).filter("fold = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan and "(fold#" in plan
