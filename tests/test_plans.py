"""Plan-shape checks: the physical plans keep the properties the design relies on at scale."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from textcohort.operators import attribution as AT
from textcohort.operators import consensus as CS
from textcohort.operators import model as M
from textcohort.operators import report as RP
from textcohort.operators import scoring as S
from textcohort.operators import text as TX
from textcohort.plans import registry as R
from textcohort.plans import workflow as WF
from textcohort.sources import tables as T


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_ranked_listing_limits_before_shuffle(spark):
    ranked = spark.range(1000).select((F.col("id") % 3).cast("int").alias("fold"), "id",
                                      (F.col("id") % 2).cast("int").alias("label"),
                                      (F.col("id") / 1000.0).alias("rank"))
    p = plan_of(RP.ranked_listing(ranked, 1, True, k=5))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_histogram_aggregates_before_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("int").alias("fold"), "id",
                                  (F.col("id") % 2).cast("int").alias("truth"), (F.col("id") / 1000.0).alias("pred"))
    p = plan_of(S.score_histogram(df, digits=3))
    assert p.index("partial_count") > p.index("Exchange hashpartitioning(fold")  # partial agg below the exchange


def test_minmax_statistics_are_broadcast_when_measured(spark):
    df = spark.range(100).select((F.col("id") % 3).cast("int").alias("fold"), "id", (F.col("id") / 100.0).alias("pred"))
    scaled = S.minmax_scale(df)
    assert "ResolvedHint" not in plan_of(scaled)
    scaled.collect()
    assert "BroadcastHashJoin" in scaled._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def fitted_small(spark):
    return WF.fit_folds(R.cohort_df(spark, SF_SMALL), folds=3, seed=0)


def test_nb_fit_reads_texts_without_a_join(spark, fitted_small):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        p = plan_of(TX.unfold(M.text_vectors(fitted_small.counts, [0, 1, 2])).groupBy("token").agg(F.sum("tf"), F.sum("m1")))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    # a text's folds stand beside its tokens: the only shuffle is the token aggregation
    assert "Join" not in p
    assert p.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(token" in p
    # positions are not read
    assert "terms:array<struct<token:string,tf:bigint>>" in p and "places" not in p


def test_scoring_joins_nothing_by_text(spark, fitted_small):
    m = fitted_small
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan_of(TX.unfold(m.texts("test")).join(m.weights, ["fold", "token"]).groupBy("fold", "id").agg(F.sum("tf")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert p.count("Join") == 1 and "hashpartitioning(id" not in p


def test_parts_follow_bytes_and_have_no_limit(spark):
    assert WF.text_parts(0, 8) == 1 and WF.text_parts(3 << 20, 8) == 3 and WF.text_parts(1 << 30, 8) == 8
    assert WF.text_parts(2 * 10 ** 12, 8000) == 14902           # 10^9 texts of 2 KB
    ids = spark.range(10 ** 9).select("id", F.lit(0).alias("label"))
    texts = ids.select("id", F.lit("a b").alias("text")).repartition(WF.text_parts(2 * 10 ** 12, 8000), "id")
    p = plan_of(TX.text_terms(TX.token_counts(TX.doc_tokens(texts))))
    assert p.count("Exchange") == 1 and "hashpartitioning(id#" in p and "14902" in p


def test_text_table_is_one_row_per_text(spark, fitted_small):
    m = fitted_small
    assert m.counts.count() == m.docs.count() == m.counts.select("id").distinct().count()
    for which in ("train", "vali", "test"):
        a = m.texts(which).select("fold", "id", "label").exceptAll(m.rows(which))
        assert a.isEmpty() and m.texts(which).count() == m.rows(which).count()
    mult = m.counts.select("id", F.explode("folds").alias("x")).select("x.fold", "id", "x.mult").filter("mult IS NOT NULL")
    assert mult.exceptAll(m.balanced.select("fold", "id", "mult")).isEmpty() and mult.count() == m.balanced.count()


def test_token_counts_shuffle_texts_once(spark):
    docs = spark.range(100).select("id", F.lit("a b a").alias("text")).repartition(4, "id")
    p = plan_of(TX.token_counts(TX.doc_tokens(docs)))
    assert p.count("Exchange") == 1 and "Exchange hashpartitioning(id" in p


def test_consensus_needs_no_occurrences(spark, fitted_small):
    m = fitted_small
    p = plan_of(AT.linear_token_values(m.texts("test"), m.counts, m.weights, positions=False).groupBy("token").agg(F.sum("tf")))
    # distinct tokens are unfolded, their positions are not
    assert "places" not in p and "explode(positions" not in p
    got = {r["word"]: (r["count"], r["shap_avg"]) for r in CS.model_consensus(m.texts("test"), m.counts, m.weights, m.priors).collect()}
    want = {r["word"]: (r["count"], r["shap_avg"]) for r in CS.consensus(AT.linear_attribution(m.rows("test"), m.counts, m.weights, m.priors, 0)).collect()}
    assert set(got) == set(want)
    assert all(got[w][0] == want[w][0] and got[w][1] == pytest.approx(want[w][1], abs=1e-9) for w in want)


def test_attributions_move_a_token_once_per_text(spark, fitted_small):
    """All folds of a text meet the weights together, positions stay with the text, and what follows per text needs no shuffle."""
    m = fitted_small
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan_of(CS.consensus_raw(AT.linear_attribution(m.folded("test"), m.counts, m.weights, m.priors, 0)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert p.count("Exchange hashpartitioning(token") == 2 and p.count("Exchange hashpartitioning(id") == 2 and p.count("Exchange hashpartitioning") == 4
    scored = M.nb_score(m.texts("test"), m.counts, m.weights, m.priors)
    for old, new in ((AT.linear_attribution(m.texts("test"), m.counts, m.weights, m.priors), AT.linear_attribution(m.folded("test"), m.counts, m.weights, m.priors)),
                     (AT.occlusion_attribution(m.texts("test"), m.counts, m.weights, scored, m.priors), AT.occlusion_attribution(m.folded("test"), m.counts, m.weights, scored, m.priors))):
        a, b = (sorted((r.fold, r.id, r.pos, r.token, r.phi) for r in x.collect()) for x in (old, new))
        assert a and [r[:4] for r in a] == [r[:4] for r in b] and [r[4] for r in a] == pytest.approx([r[4] for r in b], abs=1e-9)


def odd_cohort(spark):
    """An id that comes twice, a null id, an empty and a null text among texts of 5 to 44 tokens."""
    rows = [(i, 2 if i % 3 else 6, int(i % 3 > 0), " ".join(f"w{i * j % 23}" for j in range(5 + i))) for i in range(40)]
    rows += [(3, 2, 1, "w1 w2 w2"), (None, 6, 0, "w5"), (50, 2, 1, ""), (51, 6, 0, None), (52, 6, 0, "w1 w1 unseen")]
    return spark.createDataFrame(rows, "id long, code int, label int, text string")


def test_attributions_of_a_store_are_not_dealt_by_text(spark):
    m = WF.fit_folds(odd_cohort(spark), folds=3, seed=0)
    weights = m.weights.filter("token < 'w5'")
    for c in (0, 1):
        a, b = (sorted((r.fold, -1 if r.id is None else r.id, r.pos, r.token, round(r.phi, 9) + 0.0) for r in AT.linear_attribution(
            m.folded("test"), m.counts, weights, m.priors, c, dealt=d).collect()) for d in (True, False))
        assert a and a == b
    p = plan_of(AT.linear_attribution(m.folded("test"), m.counts, m.weights, m.priors, dealt=False))
    # the weights are joined where the texts are: only sums of a text are shuffled
    assert "Exchange hashpartitioning(id" not in p and "Exchange hashpartitioning(token" not in p
    scored = M.nb_score(m.texts("test"), m.counts, m.weights, m.priors)
    p = plan_of(AT.occlusion_attribution(m.folded("test"), m.counts, m.weights, scored, m.priors))
    assert "collect_list(struct(_i" not in p


def test_text_table_deals_tokens_once(spark, monkeypatch):
    plans, own = [], WF.materialize
    monkeypatch.setattr(WF, "materialize", lambda df, name, *a: (plans.append((name, plan_of(df))), own(df, name, *a))[1])
    m = WF.prepare_folds(odd_cohort(spark), folds=2)
    p = dict(plans)["texts"]
    # texts and their places in the folds, by id: the join deals neither again
    assert p.count("Exchange hashpartitioning(id") == 2
    assert m.counts.count() == m.split.select("id").distinct().count() > 40 and p.count("REPARTITION_BY_NUM") == 2


def test_consensus_sums_tokens_before_they_meet_weights(spark, fitted_small):
    m = fitted_small
    weights = m.weights.filter("token < 'm'")       # unknown tokens count with the value 0
    want = {r["word"]: (r["count"], r["shap_avg"]) for r in CS.consensus(AT.linear_attribution(m.texts("test"), m.counts, weights, m.priors, 0)).collect()}
    got = {r["word"]: (r["count"], r["shap_avg"]) for r in CS.model_consensus(m.texts("test"), m.counts, weights, m.priors).collect()}
    assert set(got) == set(want) and all(got[w][0] == want[w][0] and got[w][1] == pytest.approx(want[w][1], abs=1e-9) for w in want)


def test_word_lists_sort_texts_and_number_values(spark, monkeypatch):
    from textcohort.operators import index as IX
    dealt, ordered = [], IX.ordered_index
    monkeypatch.setattr(IX, "ordered_index", lambda df, *a, **k: dealt.append(df.count()) or ordered(df, *a, **k))
    rows = [(f, i, p, "a", f + i / 10 + p / 100) for f in (0, 1) for i in (1, 2, 3) for p in range(7)] + [(0, 1, 9, "b", 1.0)]
    attr = spark.createDataFrame(rows, "fold int, id long, pos int, token string, phi double")
    lists = CS.consensus_lists(attr, spark.createDataFrame([("a",)], "word string"), values=5).orderBy("piece").collect()
    assert dealt == [6] and [r.n for r in lists] == [5] * 8 + [2]
    assert "_".join(r.raw for r in lists) == "_".join("%.2f" % r[4] for r in rows[:-1])


def test_scaled_report_scans_twice(spark):
    scored = T.scored_table(spark, SF_SMALL)
    assert plan_of(S.scaled_fold_metrics(scored, score="score")).count("FileScan") == 2


def test_skewed_fold_token_join_is_split(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        # one token in every text: a third of the token rows
        rows = spark.range(0, 60000, 1, 8).select(F.lit(0).alias("fold"), F.col("id"),
                                                  F.when(F.col("id") % 3 == 0, "the").otherwise(F.concat(F.lit("w"), F.col("id"))).alias("token"))
        weights = rows.select("fold", "token").distinct().withColumn("w", F.lit(1.0))
        joined = rows.join(weights, ["fold", "token"], "left")
        assert joined.filter("w = 1").count() == 60000
        joined.write.format("noop").mode("overwrite").save()
        df = joined.select("id", "w")
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_filters_and_columns_reach_the_scan(spark, fitted_small):
    rows = fitted_small.split.filter(F.col("split") == "test").select("fold", "id")
    p = plan_of(rows)
    assert "PushedFilters: [IsNotNull(split), EqualTo(split,test)]" in p
    assert "ReadSchema: struct<fold:int,id:bigint,split:string>" in p
