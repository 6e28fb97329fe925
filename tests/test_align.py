"""Certificates of positions, alignment that refuses, whole value lists in pieces."""

import random

import pytest
from pyspark.sql import functions as F

from textcohort.operators import align as AL
from textcohort.operators import consensus as CS


def table(spark, ids, value="a"):
    return spark.createDataFrame([(p, i, f"{value}{i}") for p, i in enumerate(ids)], f"pos long, id long, {value} string").repartition(5)


@pytest.mark.parametrize("change, block", [(lambda x: x, None), (lambda x: x[:37] + x[38:], 3), (lambda x: x[:25] + [x[26], x[25]] + x[27:], 2),
                                           (lambda x: [*x, 99999], 10), (lambda x: x[:60], 6), (lambda x: [], 0), (lambda x: [7, *x], 0)])
def test_the_first_differing_block_is_named(spark, change, block):
    ids = random.Random(1).sample(range(1000), 100)
    left, right = table(spark, ids), table(spark, change(ids), "b")
    found = AL.first_difference(AL.certificate(left, block=10), AL.certificate(right, block=10)).collect()
    assert [r.block for r in found] == ([] if block is None else [block])
    if block is None:
        rows = AL.align(left, right, block=10).collect()
        assert len(rows) == 100 and all(r.a == f"a{r.id}" and r.b == f"b{r.id}" for r in rows)
    else:
        with pytest.raises(ValueError, match=f"block {block} of 10"):
            AL.align(left, right, block=10)


def test_null_ids_and_keys(spark):
    rows = spark.createDataFrame([(0, 0, None), (0, 1, 5), (1, 0, None)], "fold int, pos long, id long")
    assert AL.align(rows, rows.withColumn("v", F.lit(1)), keys=["fold"]).count() == 3
    other = rows.withColumn("id", F.when(F.col("fold") == 1, 4).otherwise(F.col("id")))
    with pytest.raises(ValueError, match="block 0 of 65536 positions of fold 1"):
        AL.align(rows, other, keys=["fold"])


def test_lists_are_whole_whatever_the_piece(spark):
    rng = random.Random(3)
    rows = [(f, i, p, rng.choice(["the", "The", "of", "rare word"]), rng.uniform(-1, 1)) for f in range(3) for i in range(8) for p in range(12)]
    attr = spark.createDataFrame(rows, "fold int, id long, pos int, token string, phi double").repartition(6)
    words = spark.createDataFrame([("the",), ("of",), ("unseen",)], "word string")
    want = {w: "_".join("%.2f" % r[4] for r in sorted(rows) if r[3].lower() == w) for w in ("the", "of")}
    for values in (1, 7, 10 ** 6):
        got = {}
        for r in CS.consensus_lists(attr, words, values).orderBy("word", "piece").collect():
            got.setdefault(r.word, []).append(r)
        assert {w: "_".join(r.raw for r in p) for w, p in got.items()} == want
        assert all([r.piece for r in p] == list(range(len(p))) and all(r.n == values for r in p[:-1]) for p in got.values())
