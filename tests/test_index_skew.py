"""Exact distributed positions, and results under a hot key (a third of all rows)."""

import hashlib

import pytest
from pyspark.sql import functions as F

from textcohort.operators import consensus as CS
from textcohort.operators import index as IX
from textcohort.operators import split as SP


def _md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def test_hash_index_matches_sort(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 3).cast("int").alias("g"))
    df = df.withColumn("h", IX.md5_key("g", "id")).repartition(5)
    got = {(r["g"], r["id"]): r["idx"] for r in IX.hash_index(df, ["g"], "h", "id").collect()}
    for g in range(3):
        ids = sorted((i for i in range(3000) if i % 3 == g), key=lambda i: (_md5(f"{g}:{i}"), i))
        assert all(got[(g, i)] == k for k, i in enumerate(ids))


@pytest.mark.parametrize("ratio", [0.0, 0.25, 0.8, 1.0])
def test_hash_head_exact(spark, ratio):
    df = spark.range(1001).withColumn("g", F.lit(0)).withColumn("h", IX.md5_key(F.lit(7), "id"))
    head = {r["id"] for r in IX.hash_head(df, ["g"], "h", "id", ratio).filter("head").collect()}
    order = sorted(range(1001), key=lambda i: (_md5(f"7:{i}"), i))
    assert head == set(order[:int(ratio * 1001)])


def test_ordered_index_groups_and_ties(spark):
    rows = [(g, i, float(i % 4 if g == 0 else 1.0)) for g in range(3) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, id long, s double").repartition(6)
    got = {(r["g"], r["id"]): r["idx"] for r in IX.ordered_index(df, ["g"], ["s", "id"]).collect()}
    for g in range(3):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))
        assert all(got[(g, r[1])] == k for k, r in enumerate(order))


def test_row_index_global(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("id")).repartition(4)
    got = {r["id"]: r["row_idx"] for r in IX.row_index(df, ["id"]).collect()}
    assert got == {i: i for i in range(500)}


def test_consensus_hot_word(spark):
    # one word holds a third of the occurrences
    n = 3000
    df = spark.range(n).select(F.lit(0).alias("fold"), (F.col("id") % 100).alias("id"), F.col("id").alias("pos"),
                               F.when(F.col("id") % 3 == 0, F.lit("the")).otherwise(F.concat(F.lit("w"), (F.col("id") % 50).cast("string"))).alias("token"),
                               (F.col("id") % 7 / 10.0).alias("phi"))
    c = {r["word"]: (r["count"], r["shap_avg"]) for r in CS.consensus(df).collect()}
    the = [i for i in range(n) if i % 3 == 0]
    assert c["the"][0] == len(the)
    assert c["the"][1] == pytest.approx(sum(i % 7 / 10.0 for i in the) / len(the))
    raw = CS.consensus_raw(df).filter(F.col("word") == "the")
    # chunks are per text, each bounded by that text's occurrences
    assert raw.count() == 100
    assert sum(len(r["raw"].split("_")) for r in raw.collect()) == len(the)


def test_seeded_shuffle_positions(spark):
    df = spark.range(200).repartition(3)
    got = {r["id"]: r["pos"] for r in SP.seeded_shuffle(df, seed=3).collect()}
    order = sorted(range(200), key=lambda i: (_md5(f"3:{i}"), i))
    assert got == {i: k for k, i in enumerate(order)}
