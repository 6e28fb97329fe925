import pytest
from pyspark.sql import functions as F

from textcohort.functions.text import clean_text, normalise_word
from textcohort.operators import cohort as C
from textcohort.operators import split as SP


def test_merge_nulls(spark):
    df = spark.createDataFrame([("a", None, "b", None)], "c1 string, c2 string, c3 string, c4 string")
    assert C.merge_comments(df, ["c1", "c2", "c3", "c4"]).collect()[0]["comment"] == "a|nan|b|nan"


def test_merge_all_null_dropped(spark):
    df = spark.createDataFrame([(None, None, None, None), ("x", None, None, None)],
                               "c1 string, c2 string, c3 string, c4 string")
    m = C.drop_empty_comment(C.merge_comments(df, ["c1", "c2", "c3", "c4"]))
    assert [r["comment"] for r in m.collect()] == ["x|nan|nan|nan"]


def test_class_null_dropped(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, float("nan")), (4, 6.0), (5, 4.0)], "id long, d double")
    assert sorted(r["id"] for r in C.class_filter(df, "d", [2, 3, 6]).collect()) == [1, 4]


def test_binarise(spark):
    df = spark.createDataFrame([(1, 6.0), (2, 2.0), (3, 3.0)], "id long, d double")
    got = {r["id"]: r["label"] for r in C.binarise_label(df, "d", 6).collect()}
    assert got == {1: 0, 2: 1, 3: 1}


def test_normalise_word(spark):
    df = spark.createDataFrame([("The ",), ("I ",), ("i",)], "t string")
    assert [r[0] for r in df.select(normalise_word(F.col("t"))).collect()] == ["the", "I", "I"]


def test_clean_text(spark):
    df = spark.createDataFrame([("good!|nan|smell .|nan",)], "t string")
    assert df.select(clean_text(F.col("t"))).collect()[0][0] == "good ! smell."


def _cohort(spark, n, n_neg):
    return spark.range(n).select(F.col("id"), F.when(F.col("id") < n_neg, 0).otherwise(1).alias("label"))


@pytest.mark.parametrize("n,train,vali,test", [(1174, 704, 235, 235), (1143, 685, 229, 229)])
def test_split_sizes(spark, n, train, vali, test):
    s = SP.split_assign(_cohort(spark, n, 89), folds=3, seed=0)
    sizes = {(r["fold"], r["split"]): r["n"] for r in s.groupBy("fold", "split").count().withColumnRenamed("count", "n").collect()}
    for f in range(3):
        assert (sizes[(f, "train")], sizes[(f, "vali")], sizes[(f, "test")]) == (train, vali, test)
    # disjoint and complete per fold
    per = s.groupBy("fold", "id").count()
    assert per.filter(F.col("count") != 1).count() == 0
    assert per.count() == 3 * n


def test_split_invariance(spark):
    c = _cohort(spark, 500, 40)
    a = SP.split_assign(c.repartition(1), folds=2, seed=1).collect()
    b = SP.split_assign(c.repartition(16), folds=2, seed=1).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_split_folds_overlap(spark):
    # Monte-Carlo CV: test sets of different folds are independent draws
    s = SP.split_assign(_cohort(spark, 400, 40), folds=2, seed=0).filter(F.col("split") == "test")
    t0 = {r["id"] for r in s.filter(F.col("fold") == 0).collect()}
    t1 = {r["id"] for r in s.filter(F.col("fold") == 1).collect()}
    assert len(t0) == len(t1) == 80 and t0 != t1


def _train(spark, pos, neg):
    rows = [(0, i, 1, "train") for i in range(pos)] + [(0, 100 + i, 0, "train") for i in range(neg)]
    return spark.createDataFrame(rows, "fold int, id long, label int, split string")


def test_oversample(spark):
    b = SP.oversample(_train(spark, 5, 2), seed=0)
    counts = SP.oversample_counts(b).collect()[0]
    assert (counts["n_pos"], counts["n_neg"]) == (5, 5)
    extra = b.filter(F.col("copy") > 0).collect()
    assert len(extra) == 3 and all(r["id"] in (100, 101) and r["label"] == 0 for r in extra)


def test_oversample_equal(spark):
    b = SP.oversample(_train(spark, 3, 3), seed=0)
    assert b.count() == 6 and b.filter(F.col("copy") > 0).count() == 0


def test_oversample_empty_minority(spark):
    with pytest.raises(Exception, match="empty minority"):
        SP.oversample(_train(spark, 3, 0), seed=0).collect()


def test_oversample_large_gap_chunks(spark):
    # gap above one draw chunk: the draws are generated in several chunks
    rows = [(0, i, 1, "train") for i in range(SP.DRAW_CHUNK + 10)] + [(0, -1 - i, 0, "train") for i in range(3)]
    b = SP.oversample(spark.createDataFrame(rows, "fold int, id long, label int, split string"), seed=0)
    c = SP.oversample_counts(b).collect()[0]
    assert c["n_pos"] == c["n_neg"] == SP.DRAW_CHUNK + 10


def test_multiplicity_hot_copies(spark):
    # one minority row against many majority rows: every draw hits the same row
    rows = [(0, i, 1, "train") for i in range(5000)] + [(0, -1, 0, "train")]
    split = spark.createDataFrame(rows, "fold int, id long, label int, split string")
    m = {r["id"]: r["mult"] for r in SP.oversample_multiplicity(split, seed=0).collect()}
    assert m[-1] == 5000 and all(m[i] == 1 for i in range(5000))


def test_a_large_gap_is_drawn_in_many_partitions(spark):
    gap = 3_000_000
    counts = [(0, 1, "train", gap + 2), (0, 0, "train", 2)]
    rows = spark.createDataFrame(counts, "fold int, label int, split string, n long")
    split = rows.select("fold", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("id"), "label", "split")
    split = split.withColumn("id", F.when(F.col("label") == 1, F.col("id")).otherwise(-F.col("id")))
    _, _, draws = SP._oversample_parts(split, 0, "fold")
    per = {r["p"]: r["n"] for r in draws.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    chunks = -(-gap // SP.DRAW_CHUNK)
    assert sum(per.values()) == gap and len(per) >= 4
    assert max(per.values()) <= 3 * SP.DRAW_CHUNK * -(-chunks // 8)


def test_whole_class_listing(spark):
    from textcohort.operators import report as RP
    rows = [(f, i, i % 2, (i * 7 % 100) / 100) for f in range(2) for i in range(100)]
    ranked = spark.createDataFrame(rows, "fold int, id long, label int, rank double").repartition(5)
    for label, down in ((1, True), (0, False)):
        got = sorted((r["fold"], r["k"], r["id"]) for r in RP.ranked_listing(ranked, label, down).collect())
        want = [(f, k, r[1]) for f in range(2) for k, r in enumerate(sorted((r for r in rows if r[0] == f and r[2] == label),
                                                                             key=lambda r: (r[3], r[1]), reverse=down))]
        assert got == want


def test_comments_table_keeps_every_turn(spark, tmp_path):
    from textcohort.sources import tables as T
    rows = [(1, t, "user", f"m{t}") for t in range(6)] + [(2, 0, "user", "a"), (2, 0, "user", "b"), (2, 9, "user", "z")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = T.comments_table(spark, str(tmp_path))
    seen = [r[f"comment{i}"] for r in got.collect() for i in range(1, 5) if r[f"comment{i}"]]
    assert sorted(seen) == sorted(r[3] for r in rows)
    assert {(r["id"], r["block"]) for r in got.collect()} == {(c, b) for c in (1, 2) for b in range(3)}
