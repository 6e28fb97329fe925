"""Named queries over the test tables, and their DuckDB oracle SQL.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over whole tables.  Floating
outputs are rounded to 6 decimals on both sides, and every computed column is aliased to the
same name in the Spark query and in the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textcohort.operators import scoring as S
from textcohort.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


# ----------------------------------------------------------------------------------------------
# Scored table (lineitem stand-in): fold = line number, score = extended price, truth = discount
# ----------------------------------------------------------------------------------------------

SQL_SCORED = """
scored AS (
  SELECT CAST(l_linenumber AS INTEGER) AS fold, l_orderkey AS id,
         CAST(l_extendedprice AS DOUBLE) AS score, CAST(l_discount >= 0.05 AS INTEGER) AS truth
  FROM lineitem),
mm AS (SELECT fold, min(score) AS lo, max(score) AS hi FROM scored GROUP BY fold),
scaled AS (
  SELECT s.fold, s.id, s.truth,
         CASE WHEN hi <> lo THEN (score - lo) / (hi - lo) ELSE CAST('NaN' AS DOUBLE) END AS pred
  FROM scored s JOIN mm USING (fold))"""


def sql_hist(src: str, digits: int, group: str = "fold") -> str:
    scale = 10 ** digits
    return f"""
hist AS (
  SELECT {group}, CAST(floor(pred * {scale}.0 + 0.5) AS BIGINT) AS bin,
         count(*) FILTER (WHERE truth > 0) AS n_pos, count(*) FILTER (WHERE truth = 0) AS n_neg
  FROM {src}
  WHERE pred IS NOT NULL AND NOT isnan(pred)
    AND floor(pred * {scale}.0 + 0.5) >= 0 AND floor(pred * {scale}.0 + 0.5) <= {scale}
  GROUP BY {group}, bin
  HAVING count(*) FILTER (WHERE truth > 0) > 0 OR count(*) FILTER (WHERE truth = 0) > 0),
run AS (
  SELECT *, CAST(sum(n_pos) OVER (PARTITION BY {group} ORDER BY bin ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cp,
            CAST(sum(n_neg) OVER (PARTITION BY {group} ORDER BY bin ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cn,
            CAST(sum(n_pos) OVER (PARTITION BY {group}) AS BIGINT) AS P,
            CAST(sum(n_neg) OVER (PARTITION BY {group}) AS BIGINT) AS N
  FROM hist),
auc AS (
  SELECT {group},
    CASE WHEN max(P) > 0 AND max(N) > 0 THEN
      sum((n_pos / CAST(P AS DOUBLE)) * ((2 * cn - n_neg) / (2.0 * N))) ELSE CAST('NaN' AS DOUBLE) END AS auroc,
    CASE WHEN max(P) > 0 AND max(N) > 0 THEN
      sum(CASE WHEN n_pos > 0 THEN (n_pos / CAST(P AS DOUBLE)) *
          ((P - cp + n_pos) / CAST((P - cp + n_pos) + (N - cn + n_neg) AS DOUBLE)) ELSE 0.0 END)
      ELSE CAST('NaN' AS DOUBLE) END AS auprc
  FROM run GROUP BY {group})"""


def sql_pearson(src: str, group: str = "fold", x: str = "pred", y: str = "truth") -> str:
    return f"""
pear AS (
  SELECT {group},
    CASE WHEN isnan(var_pop(CAST({x} AS DOUBLE))) OR isnan(covar_pop(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))) THEN CAST('NaN' AS DOUBLE)
         WHEN var_pop(CAST({x} AS DOUBLE)) > 0 AND var_pop(CAST({y} AS DOUBLE)) > 0 THEN
      covar_pop(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)) / sqrt(var_pop(CAST({x} AS DOUBLE)) * var_pop(CAST({y} AS DOUBLE)))
    ELSE CAST('NaN' AS DOUBLE) END AS pearson
  FROM {src} GROUP BY {group})"""


def scaled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.minmax_scale(T.scored_table(spark, sf_dir), ["fold"], score="score", out="pred") \
            .select("fold", "id", "truth", "pred")


@register("minmax_scale", f"WITH {SQL_SCORED} SELECT fold, id, round(pred, 6) AS pred FROM scaled")
def q_minmax(spark, sf_dir):
    return scaled_scores(spark, sf_dir).select("fold", "id", r6("pred"))


@register("score_histogram", f"WITH {SQL_SCORED}, {sql_hist('scaled', 3)} SELECT fold, bin, n_pos, n_neg FROM hist")
def q_hist(spark, sf_dir):
    return S.score_histogram(scaled_scores(spark, sf_dir), ["fold"], "pred", "truth", digits=3)


@register("score_validate", f"""WITH {SQL_SCORED}
SELECT fold, count(*) AS n_rows,
  count(*) FILTER (WHERE score IS NULL OR isnan(score) OR floor(score * 1000.0 + 0.5) < 0
                   OR floor(score * 1000.0 + 0.5) > 1000) AS n_invalid
FROM scored GROUP BY fold""")
def q_validate(spark, sf_dir):
    return S.score_validate(T.scored_table(spark, sf_dir), ["fold"], score="score", digits=3)


@register("auroc", f"WITH {SQL_SCORED}, {sql_hist('scaled', 5)} SELECT fold, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM auc")
def q_auroc(spark, sf_dir):
    return S.auc_scores(scaled_scores(spark, sf_dir), ["fold"], "pred", "truth", digits=5) \
            .select("fold", r6("auroc"), r6("auprc"))


@register("pearson", f"WITH {SQL_SCORED}, {sql_pearson('scaled')} SELECT fold, round(pearson, 6) AS pearson FROM pear")
def q_pearson(spark, sf_dir):
    return S.pearson(scaled_scores(spark, sf_dir), ["fold"], "pred", "truth").select("fold", r6("pearson"))


@register("roc_curve", f"""WITH {SQL_SCORED}, {sql_hist('scaled', 3)},
roc AS (
  SELECT fold, bin, bin / 1000.0 AS threshold, P - cp AS tp, N - cn AS fp, cn AS tn, cp AS fn,
         (P - cp) / CAST(P AS DOUBLE) AS tpr, cn / CAST(N AS DOUBLE) AS tnr,
         CASE WHEN (P - cp) + (N - cn) > 0 THEN (P - cp) / CAST((P - cp) + (N - cn) AS DOUBLE)
              ELSE CAST('NaN' AS DOUBLE) END AS ppv, P, N
  FROM run)
SELECT fold, bin, round(threshold, 6) AS threshold, tp, fp, tn, fn, round(tpr, 6) AS tpr, round(tnr, 6) AS tnr,
  round(ppv, 6) AS ppv,
  round(coalesce(lag(tpr) OVER (PARTITION BY fold ORDER BY bin), 1.0), 6) AS tpr_prev,
  round(coalesce(lag(tnr) OVER (PARTITION BY fold ORDER BY bin), 0.0), 6) AS tnr_prev,
  round(coalesce(lag(ppv) OVER (PARTITION BY fold ORDER BY bin), P / CAST(P + N AS DOUBLE)), 6) AS ppv_prev
FROM roc""")
def q_roc(spark, sf_dir):
    r = S.roc_curve(scaled_scores(spark, sf_dir), ["fold"], "pred", "truth", digits=3)
    return r.select("fold", "bin", r6("threshold"), "tp", "fp", "tn", "fn", r6("tpr"), r6("tnr"),
                    r6("ppv"), r6("tpr_prev"), r6("tnr_prev"), r6("ppv_prev"))


SQL_RANKED = """
ranked AS (
  SELECT fold, id, truth,
    CASE WHEN count(*) OVER (PARTITION BY fold) > 1 THEN
      (row_number() OVER (PARTITION BY fold ORDER BY pred, id) - 1) / CAST(count(*) OVER (PARTITION BY fold) - 1 AS DOUBLE)
    ELSE CAST('NaN' AS DOUBLE) END AS rank
  FROM scaled)"""


@register("rank_normalise", f"WITH {SQL_SCORED}, {SQL_RANKED} SELECT fold, id, round(rank, 6) AS rank FROM ranked")
def q_rank(spark, sf_dir):
    return S.rank_normalise(scaled_scores(spark, sf_dir), ["fold"], "pred", "id", out="rank") \
            .select("fold", "id", r6("rank"))


@register("rank_metrics", f"""WITH {SQL_SCORED}, {SQL_RANKED},
r2 AS (SELECT fold, id, truth, rank AS pred FROM ranked), {sql_hist('r2', 5)}, {sql_pearson('r2')}
SELECT fold, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(pearson, 6) AS pearson
FROM auc JOIN pear USING (fold)""")
def q_rank_metrics(spark, sf_dir):
    ranked = S.rank_normalise(scaled_scores(spark, sf_dir), ["fold"], "pred", "id", out="rank")
    m = S.fold_metrics(ranked.withColumnRenamed("pred", "score").withColumnRenamed("rank", "pred"),
                       ["fold"], "pred", "truth", digits=5)
    return m.select("fold", r6("auroc"), r6("auprc"), r6("pearson"))


def sql_report(src: str) -> str:
    """Fold rows + avg + median over a ``(fold, auroc, auprc, pearson)`` relation."""
    def med(c):
        return (f"CASE WHEN max(CAST(isnan({c}) AS INTEGER)) = 1 THEN CAST('NaN' AS DOUBLE) "
                f"ELSE median({c}) END")
    return f"""
report AS (
  SELECT 'fold' || CAST(fold AS VARCHAR) AS fold, auroc, auprc, pearson FROM {src}
  UNION ALL SELECT 'avg', avg(auroc), avg(auprc), avg(pearson) FROM {src}
  UNION ALL SELECT 'median', {med('auroc')}, {med('auprc')}, {med('pearson')} FROM {src})"""


@register("scored_fold_report", f"""WITH {SQL_SCORED}, {sql_hist('scaled', 6)}, {sql_pearson('scaled')},
m AS (SELECT fold, auroc, auprc, pearson FROM auc JOIN pear USING (fold)), {sql_report('m')}
SELECT fold, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(pearson, 6) AS pearson FROM report""")
def q_scored_report(spark, sf_dir):
    m = S.scaled_fold_metrics(T.scored_table(spark, sf_dir), ["fold"], "score", "truth", digits=6)
    return S.fold_report(m).select("fold", r6("auroc"), r6("auprc"), r6("pearson"))


SQL_BROKEN = SQL_SCORED.replace(" AS score, CAST(", " AS raw, CAST(").replace("mm AS", """broken AS (
  SELECT fold, id, truth, CASE WHEN fold = 1 THEN 1.0 WHEN fold = 2 AND id = (SELECT min(id) FROM scored WHERE fold = 2)
    THEN CAST('NaN' AS DOUBLE) ELSE raw END AS score FROM scored),
mm AS""", 1).replace("max(score) AS hi FROM scored", "max(score) AS hi FROM broken").replace("FROM scored s JOIN mm", "FROM broken s JOIN mm")


@register("score_report_invalid", f"""WITH {SQL_BROKEN}, {sql_hist('scaled', 5)}, {sql_pearson('scaled')},
bad AS (SELECT fold, count(*) FILTER (WHERE pred IS NULL OR isnan(pred) OR floor(pred * 100000.0 + 0.5) NOT BETWEEN 0 AND 100000) AS n_invalid
        FROM scaled GROUP BY fold),
m AS (SELECT b.fold, n_invalid, CASE WHEN n_invalid = 0 THEN auroc ELSE CAST('NaN' AS DOUBLE) END AS auroc,
        CASE WHEN n_invalid = 0 THEN auprc ELSE CAST('NaN' AS DOUBLE) END AS auprc, pearson
      FROM bad b LEFT JOIN auc ON auc.fold = b.fold JOIN pear ON pear.fold = b.fold), {sql_report('m')}
SELECT r.fold, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(pearson, 6) AS pearson,
       CAST(coalesce(b.n_invalid, (SELECT sum(n_invalid) FROM bad)) AS BIGINT) AS n_invalid
FROM report r LEFT JOIN bad b ON r.fold = 'fold' || CAST(b.fold AS VARCHAR)""")
def q_report_invalid(spark, sf_dir):
    """The report over a table with a constant fold (1) and a NaN score in fold 2: both folds are NaN and
    counted, and so are the summary rows."""
    scored = T.scored_table(spark, sf_dir)
    first = scored.filter("fold = 2").agg(F.min("id").alias("_first"))
    broken = scored.join(first, (F.col("fold") == 2) & (F.col("id") == F.col("_first")), "left")
    broken = broken.withColumn("score", F.when(F.col("fold") == 1, 1.0).when(F.col("_first").isNotNull(), float("nan")).otherwise(F.col("score")))
    m = S.scaled_fold_metrics(broken.drop("_first"), ["fold"], "score", "truth", digits=5, on_invalid="nan")
    return S.fold_report(m).select("fold", r6("auroc"), r6("auprc"), r6("pearson"), "n_invalid")


# ----------------------------------------------------------------------------------------------
# Cohort (documents + labels stand-in for the survey): English rows, codes 2/3 vs 6
# ----------------------------------------------------------------------------------------------

from textcohort.operators import cohort as C  # noqa: E402
from textcohort.operators import split as SP  # noqa: E402

FOLDS, SEED, NEG_CODE, POS_CODES, LANG = 10, 0, 6, (2, 3), "en"

SQL_SURVEY = """
survey AS (
  SELECT d.doc_id AS id, d.lang AS unique_id, d.text AS comment,
    CAST(CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 2.0 WHEN l.quality = 1 AND l.toxic = 1 THEN 3.0
         WHEN l.quality = 0 AND l.toxic = 1 THEN 5.0 WHEN l.quality = 0 AND l.toxic = 0 THEN 6.0 END AS DOUBLE) AS diagnosis
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

SQL_COHORT = SQL_SURVEY + """,
cohort AS (
  SELECT id, CAST(diagnosis AS INTEGER) AS code, CASE WHEN diagnosis = 6 THEN 0 ELSE 1 END AS label, comment AS text
  FROM survey
  WHERE contains(unique_id, 'en') AND diagnosis IN (2, 3, 6) AND comment IS NOT NULL
    AND comment <> 'nan|nan|nan|nan')"""

SQL_SPLIT = SQL_COHORT + """,
fx AS (
  SELECT CAST(f.range AS INTEGER) AS fold, c.id, c.label,
         md5(CAST(f.range AS VARCHAR) || ':' || CAST(c.id AS VARCHAR)) AS h
  FROM cohort c CROSS JOIN range(10) f),
fx2 AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY h, id) AS rn,
               count(*) OVER (PARTITION BY fold) AS n FROM fx),
tv AS (SELECT fold, id, label, md5('0:' || CAST(id AS VARCHAR)) AS h FROM fx2
       WHERE rn <= floor(CAST(0.8 AS DOUBLE) * n)),
tv2 AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY h, id) AS rn,
               count(*) OVER (PARTITION BY fold) AS n FROM tv),
split AS (
  SELECT fold, id, label, CASE WHEN rn <= floor(CAST(0.75 AS DOUBLE) * n) THEN 'train' ELSE 'vali' END AS split FROM tv2
  UNION ALL
  SELECT fold, id, label, 'test' AS split FROM fx2 WHERE rn > floor(CAST(0.8 AS DOUBLE) * n))"""

SQL_OVERSAMPLE = SQL_SPLIT + """,
tr AS (SELECT fold, id, label FROM split WHERE split = 'train'),
cnt AS (SELECT fold, count(*) FILTER (WHERE label = 1) AS npos, count(*) FILTER (WHERE label = 0) AS nneg
        FROM tr GROUP BY fold),
c2 AS (SELECT fold, CASE WHEN nneg > npos THEN 1 ELSE 0 END AS minlab, abs(npos - nneg) AS diff,
              least(npos, nneg) AS nmin FROM cnt),
mino AS (SELECT tr.fold, tr.id, tr.label,
           row_number() OVER (PARTITION BY tr.fold ORDER BY
             md5('0:' || CAST(tr.fold AS VARCHAR) || ':' || CAST(tr.id AS VARCHAR)), tr.id) - 1 AS idx
         FROM tr JOIN c2 ON tr.fold = c2.fold WHERE tr.label = c2.minlab),
dj AS (SELECT fold, nmin, unnest(range(diff)) AS j FROM c2 WHERE diff > 0),
draws AS (SELECT fold, j, CAST(('0x' || substr(md5('0:' || CAST(fold AS VARCHAR) || ':' || CAST(j AS VARCHAR)), 1, 15)) AS BIGINT) % nmin AS idx
          FROM dj),
balanced AS (
  SELECT fold, id, label, CAST(0 AS BIGINT) AS copy FROM tr
  UNION ALL
  SELECT d.fold, m.id, m.label, d.j + 1 AS copy FROM draws d JOIN mino m ON d.fold = m.fold AND d.idx = m.idx)"""


def survey(spark, sf_dir):
    return T.survey_table(spark, sf_dir)


def cohort_df(spark, sf_dir):
    return C.build_cohort(survey(spark, sf_dir), lang_needle=LANG, pos_codes=POS_CODES, neg_code=NEG_CODE)


def cohort_keys(spark, sf_dir):
    """``(id, label)`` of the cohort, written once (the text filter is evaluated once)."""
    from textcohort.sources.io import materialize
    return materialize(cohort_df(spark, sf_dir).select("id", "label"), "cohort-keys")


def split_df(spark, sf_dir):
    return SP.split_assign(cohort_keys(spark, sf_dir), folds=FOLDS, seed=SEED)


def balanced_df(spark, sf_dir):
    from textcohort.sources.io import materialize
    return SP.oversample(materialize(split_df(spark, sf_dir), "split"), seed=SEED)


@register("filter_substring", f"WITH {SQL_SURVEY} SELECT id, unique_id FROM survey WHERE contains(unique_id, 'en')")
def q_filter_substring(spark, sf_dir):
    return C.filter_substring(survey(spark, sf_dir), "unique_id", LANG).select("id", "unique_id")


@register("cohort_project", f"WITH {SQL_SURVEY} SELECT diagnosis, comment, unique_id FROM survey WHERE contains(unique_id, 'en')")
def q_cohort_project(spark, sf_dir):
    return C.project(C.filter_substring(survey(spark, sf_dir), "unique_id", LANG),
                     ["diagnosis", "comment", "unique_id"])


@register("class_filter", f"WITH {SQL_SURVEY} SELECT id, diagnosis FROM survey WHERE contains(unique_id, 'en') AND diagnosis IN (2, 3, 6)")
def q_class_filter(spark, sf_dir):
    df = C.filter_substring(survey(spark, sf_dir), "unique_id", LANG)
    return C.class_filter(df, "diagnosis", [*POS_CODES, NEG_CODE]).select("id", "diagnosis")


@register("distinct_codes", f"WITH {SQL_SURVEY} SELECT DISTINCT diagnosis FROM survey WHERE contains(unique_id, 'en')")
def q_distinct_codes(spark, sf_dir):
    return C.distinct_values(C.filter_substring(survey(spark, sf_dir), "unique_id", LANG), "diagnosis")


@register("class_counts", f"WITH {SQL_COHORT} SELECT code, count(*) AS n FROM cohort GROUP BY code")
def q_class_counts(spark, sf_dir):
    return C.class_counts(cohort_df(spark, sf_dir), "code")


@register("binarise_label", f"WITH {SQL_COHORT} SELECT id, code, label FROM cohort")
def q_binarise(spark, sf_dir):
    return cohort_df(spark, sf_dir).select("id", "code", "label")


@register("cohort", f"WITH {SQL_COHORT} SELECT id, code, label, text FROM cohort")
def q_cohort(spark, sf_dir):
    return cohort_df(spark, sf_dir)


@register("filter_max_chars", f"WITH {SQL_COHORT} SELECT id, label, CAST(length(text) AS INTEGER) AS n_chars FROM cohort WHERE length(text) < 2000")
def q_filter_max_chars(spark, sf_dir):
    return C.filter_max_chars(cohort_df(spark, sf_dir), "text", 2000) \
            .select("id", "label", F.length("text").alias("n_chars"))


SQL_COMMENTS = """
numbered AS (
  SELECT conv_id AS id, turn // 4 AS block, turn % 4 AS place, text,
         row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) - 1 AS nth FROM conversations),
grid AS (SELECT c.id, CAST(b.range AS INTEGER) AS block FROM (SELECT DISTINCT conv_id AS id FROM conversations) c
         CROSS JOIN range((SELECT max(turn) // 4 + 1 FROM conversations)) b),
comments AS (
  SELECT g.id, g.block, coalesce(n.nth, 0) AS nth, max(CASE WHEN place = 0 THEN text END) AS comment1,
         max(CASE WHEN place = 1 THEN text END) AS comment2, max(CASE WHEN place = 2 THEN text END) AS comment3,
         max(CASE WHEN place = 3 THEN text END) AS comment4
  FROM grid g LEFT JOIN numbered n ON n.id = g.id AND n.block = g.block GROUP BY g.id, g.block, n.nth),
merged AS (
  SELECT id, block, CAST(nth AS INTEGER) AS nth, coalesce(comment1, 'nan') || '|' || coalesce(comment2, 'nan') || '|' ||
             coalesce(comment3, 'nan') || '|' || coalesce(comment4, 'nan') AS comment FROM comments)"""

COMMENT_COLS = ["comment1", "comment2", "comment3", "comment4"]


@register("merge_comments", f"WITH {SQL_COMMENTS} SELECT id, block, nth, comment FROM merged")
def q_merge_comments(spark, sf_dir):
    return C.merge_comments(T.comments_table(spark, sf_dir), COMMENT_COLS).select("id", "block", "nth", "comment")


@register("drop_empty_comment", f"WITH {SQL_COMMENTS} SELECT id, block, nth, comment FROM merged WHERE comment <> 'nan|nan|nan|nan'")
def q_drop_empty(spark, sf_dir):
    m = C.merge_comments(T.comments_table(spark, sf_dir), COMMENT_COLS)
    return C.drop_empty_comment(m, "comment").select("id", "block", "nth", "comment")


@register("split_assign", f"WITH {SQL_SPLIT} SELECT fold, id, label, split FROM split")
def q_split_assign(spark, sf_dir):
    return split_df(spark, sf_dir)


@register("split_sizes", f"WITH {SQL_SPLIT} SELECT fold, split, count(*) AS n FROM split GROUP BY fold, split")
def q_split_sizes(spark, sf_dir):
    return split_df(spark, sf_dir).groupBy("fold", "split").agg(F.count(F.lit(1)).alias("n"))


@register("split_gather", f"WITH {SQL_SPLIT} SELECT s.fold, s.id, c.label, c.text FROM split s JOIN cohort c ON s.id = c.id WHERE s.split = 'test'")
def q_split_gather(spark, sf_dir):
    return SP.split_gather(split_df(spark, sf_dir), cohort_df(spark, sf_dir), "test") \
             .select("fold", "id", "label", "text")


@register("split_complement", f"""WITH {SQL_SPLIT}
SELECT f.range AS fold, c.id FROM cohort c CROSS JOIN range(10) f
WHERE NOT EXISTS (SELECT 1 FROM split s WHERE s.split = 'test' AND s.fold = f.range AND s.id = c.id)""")
def q_split_complement(spark, sf_dir):
    return SP.split_complement(cohort_df(spark, sf_dir), split_df(spark, sf_dir), "test", FOLDS) \
             .select(F.col("fold").cast("long").alias("fold"), "id")


@register("seeded_shuffle", f"""WITH {SQL_COHORT}
SELECT id, row_number() OVER (ORDER BY md5('3:' || CAST(id AS VARCHAR)), id) - 1 AS pos FROM cohort""")
def q_seeded_shuffle(spark, sf_dir):
    return SP.seeded_shuffle(cohort_df(spark, sf_dir).select("id"), seed=3, out="pos")


@register("oversample", f"WITH {SQL_OVERSAMPLE} SELECT fold, id, label, copy FROM balanced")
def q_oversample(spark, sf_dir):
    return balanced_df(spark, sf_dir)


@register("oversample_counts", f"""WITH {SQL_OVERSAMPLE}
SELECT fold, count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg
FROM balanced GROUP BY fold""")
def q_oversample_counts(spark, sf_dir):
    return SP.oversample_counts(balanced_df(spark, sf_dir))


# ----------------------------------------------------------------------------------------------
# Tokens, Naive Bayes fit / score, flagship fold report
# ----------------------------------------------------------------------------------------------

from textcohort.operators import model as M  # noqa: E402
from textcohort.operators import text as TX  # noqa: E402
from textcohort.plans import workflow as WF  # noqa: E402

TOKEN_RE = r"'[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'"

SQL_TOKENS = f"""
toks AS (SELECT id, regexp_extract_all(lower(coalesce(text, '')), {TOKEN_RE}) AS t FROM cohort),
lens AS (SELECT id, CAST(len(t) AS INTEGER) AS n_tok FROM toks),
occ AS (SELECT id, unnest(t) AS token FROM toks),
tfs AS (SELECT o.id, o.token, count(*) AS tf, any_value(l.n_tok) AS n_tok FROM occ o JOIN lens l ON o.id = l.id
        GROUP BY o.id, o.token)"""

SQL_NB = SQL_OVERSAMPLE + "," + SQL_TOKENS + """,
mult AS (SELECT fold, id, label, count(*) AS mult FROM balanced GROUP BY fold, id, label),
pt AS (SELECT m.fold, t.token,
         CAST(sum(CASE WHEN m.label = 1 THEN m.mult * t.tf ELSE 0 END) AS DOUBLE) AS c1,
         CAST(sum(CASE WHEN m.label = 0 THEN m.mult * t.tf ELSE 0 END) AS DOUBLE) AS c0,
         sum(m.mult * t.tf / CAST(t.n_tok AS DOUBLE)) AS sx
       FROM mult m JOIN tfs t ON m.id = t.id GROUP BY m.fold, t.token),
tot AS (SELECT fold, sum(c1) AS tot1, sum(c0) AS tot0, CAST(count(*) AS DOUBLE) AS vocab FROM pt GROUP BY fold),
pri AS (SELECT fold, CAST(sum(CASE WHEN label = 1 THEN mult ELSE 0 END) AS BIGINT) AS n1,
               CAST(sum(CASE WHEN label = 0 THEN mult ELSE 0 END) AS BIGINT) AS n0,
               CAST(sum(mult) AS DOUBLE) AS m FROM mult GROUP BY fold),
wt AS (SELECT pt.fold, pt.token, pt.c0, pt.c1,
         ln((pt.c1 + 1.0) / (tot1 + 1.0 * vocab)) - ln((pt.c0 + 1.0) / (tot0 + 1.0 * vocab)) AS w, sx / pri.m AS mean_x
       FROM pt JOIN tot ON pt.fold = tot.fold JOIN pri ON pt.fold = pri.fold),
prio AS (SELECT pri.fold, n0, n1, CASE WHEN n1 > 0 AND n0 > 0 THEN ln(n1 / CAST(n0 AS DOUBLE)) ELSE CAST('NaN' AS DOUBLE) END AS prior,
           coalesce(sh.mean_shift, 0.0) AS mean_shift
         FROM pri LEFT JOIN (SELECT fold, sum(w * mean_x) AS mean_shift FROM wt GROUP BY fold) sh ON pri.fold = sh.fold)"""


def sql_scored(which: str) -> str:
    return f"""
rows_{which} AS (SELECT fold, id, label FROM split WHERE split = '{which}'),
contrib_{which} AS (SELECT r.fold, r.id, sum(wt.w * t.tf / CAST(t.n_tok AS DOUBLE)) AS s
  FROM rows_{which} r JOIN tfs t ON r.id = t.id JOIN wt ON wt.fold = r.fold AND wt.token = t.token
  GROUP BY r.fold, r.id),
scored_{which} AS (SELECT r.fold, r.id, r.label, p.prior + coalesce(c.s, 0.0) AS logit,
    1.0 / (1.0 + exp(-(p.prior + coalesce(c.s, 0.0)))) AS prob
  FROM rows_{which} r JOIN lens l ON r.id = l.id
  LEFT JOIN contrib_{which} c ON c.fold = r.fold AND c.id = r.id JOIN prio p ON p.fold = r.fold)"""


SQL_PREDS = SQL_NB + "," + sql_scored("test") + """,
pmm AS (SELECT fold, min(prob) AS lo, max(prob) AS hi FROM scored_test GROUP BY fold),
preds AS (SELECT s.fold, s.id, s.label AS truth,
    round(CASE WHEN hi <> lo THEN (prob - lo) / (hi - lo) ELSE CAST('NaN' AS DOUBLE) END, 9) AS pred
  FROM scored_test s JOIN pmm ON s.fold = pmm.fold)"""


def fitted(spark, sf_dir) -> WF.FittedFolds:
    return WF.fit_folds(cohort_df(spark, sf_dir), folds=FOLDS, seed=SEED)


def prepared(spark, sf_dir) -> WF.PreparedFolds:
    return WF.prepare_folds(cohort_df(spark, sf_dir), folds=FOLDS, seed=SEED)


@register("tokenise", f"""WITH {SQL_COHORT.replace("cohort AS (", "cohort_unused AS (")},
cohort AS (SELECT doc_id AS id, text FROM documents), {SQL_TOKENS}
SELECT id, unnest(range(len(t))) AS pos, unnest(t) AS token FROM toks""")
def q_tokenise(spark, sf_dir):
    docs = T.read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return TX.token_positions(TX.doc_tokens(docs)).select("id", F.col("pos").cast("long").alias("pos"), "token")


@register("token_counts", f"WITH {SQL_COHORT}, {SQL_TOKENS} SELECT id, token, tf, n_tok FROM tfs")
def q_token_counts(spark, sf_dir):
    return TX.token_counts(TX.doc_tokens(cohort_df(spark, sf_dir))).select("id", "token", "tf", "n_tok")


@register("nb_fit", f"WITH {SQL_NB} SELECT fold, token, c0, c1, round(w, 6) AS w, round(mean_x, 6) AS mean_x FROM wt")
def q_nb_fit(spark, sf_dir):
    w = fitted(spark, sf_dir).weights
    return w.select("fold", "token", F.col("c0").cast("double").alias("c0"), F.col("c1").cast("double").alias("c1"),
                    r6("w"), r6("mean_x"))


@register("nb_prior", f"WITH {SQL_NB} SELECT fold, n0, n1, round(prior, 6) AS prior, round(mean_shift, 6) AS mean_shift FROM prio")
def q_nb_prior(spark, sf_dir):
    p = fitted(spark, sf_dir).priors
    return p.select("fold", "n0", "n1", r6("prior"), r6("mean_shift"))


@register("nb_score", f"WITH {SQL_NB}, {sql_scored('test')} SELECT fold, id, label, round(logit, 6) AS logit, round(prob, 6) AS prob FROM scored_test")
def q_nb_score(spark, sf_dir):
    return WF.score_split(fitted(spark, sf_dir), "test").select("fold", "id", "label", r6("logit"), r6("prob"))


@register("argmax_pearson", f"""WITH {SQL_NB}, {sql_scored('vali')},
am AS (SELECT fold, label, CASE WHEN prob > 1.0 - prob THEN 1 ELSE 0 END AS pred FROM scored_vali),
{sql_pearson('am', 'fold', 'pred', 'label')}
SELECT fold, round(pearson, 6) AS pearson FROM pear""")
def q_argmax_pearson(spark, sf_dir):
    return WF.validation_pearson(fitted(spark, sf_dir)).select("fold", r6("pearson"))


@register("pred_truth_join", f"WITH {SQL_PREDS} SELECT fold, id, truth, round(pred, 6) AS pred FROM preds")
def q_pred_truth(spark, sf_dir):
    p = WF.scaled_predictions(fitted(spark, sf_dir))
    return p.select("fold", "id", F.col("label").alias("truth"), r6("pred"))


@register("fold_report", f"""WITH {SQL_PREDS}, {sql_hist('preds', 6)}, {sql_pearson('preds')},
m AS (SELECT auc.fold, auroc, auprc, pearson FROM auc JOIN pear ON auc.fold = pear.fold), {sql_report('m')}
SELECT fold, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(pearson, 6) AS pearson FROM report""")
def q_fold_report(spark, sf_dir):
    rep = WF.fold_report(cohort_df(spark, sf_dir), folds=FOLDS, seed=SEED, digits=6)
    return rep.select("fold", r6("auroc"), r6("auprc"), r6("pearson"))


# ----------------------------------------------------------------------------------------------
# Attribution, consensus, ranked reports
# ----------------------------------------------------------------------------------------------

from textcohort.operators import attribution as AT  # noqa: E402
from textcohort.operators import consensus as CS  # noqa: E402
from textcohort.operators import report as RP  # noqa: E402
from textcohort.plans.examples import EXAMPLE_FOLD, EXAMPLE_PICKS  # noqa: E402

SQL_ATTR = SQL_NB + "," + sql_scored("test") + """,
occp AS (SELECT id, unnest(range(len(t))) AS pos, unnest(t) AS token FROM toks),
occr AS (SELECT r.fold, r.id, o.pos, o.token, l.n_tok FROM rows_test r JOIN occp o ON r.id = o.id JOIN lens l ON r.id = l.id),
occw AS (SELECT occr.*, coalesce(wt.w, 0.0) AS w, coalesce(wt.mean_x, 0.0) AS mean_x
         FROM occr LEFT JOIN wt ON wt.fold = occr.fold AND wt.token = occr.token),
occt AS (SELECT *, count(*) OVER (PARTITION BY fold, id, token) AS tf FROM occw),
attr_tok AS (SELECT fold, id, pos, token, w * (tf / CAST(n_tok AS DOUBLE) - mean_x) / tf AS phi,
                    w * mean_x / tf AS wm FROM occt),
attr_base AS (SELECT r.fold, r.id, CAST(-1 AS BIGINT) AS pos, '' AS token, coalesce(pr.s, 0.0) - p.mean_shift AS phi
  FROM rows_test r LEFT JOIN (SELECT fold, id, sum(wm) AS s FROM attr_tok GROUP BY fold, id) pr
    ON pr.fold = r.fold AND pr.id = r.id JOIN prio p ON p.fold = r.fold),
attr AS (SELECT fold, id, pos, token, phi FROM attr_tok UNION ALL SELECT fold, id, pos, token, phi FROM attr_base),
attr0 AS (SELECT fold, id, pos, token, -phi AS phi FROM attr),
words AS (SELECT *, CASE WHEN lower(replace(token, ' ', '')) = 'i' THEN 'I' ELSE lower(replace(token, ' ', '')) END AS word
          FROM attr0),
cons AS (SELECT word, count(*) AS count, avg(phi) AS shap_avg FROM words GROUP BY word),
n_ex AS (SELECT count(*) AS n FROM (SELECT DISTINCT fold, id FROM attr0)),
top0 AS (SELECT word, count, shap_avg FROM cons WHERE count * 10 >= (SELECT n FROM n_ex)),
top1 AS (SELECT *, row_number() OVER (ORDER BY word) AS rn, count(*) OVER () AS n FROM top0),
top AS (SELECT word, count, shap_avg FROM top1 WHERE rn > 10 AND rn <= n - 3)"""


def attributions(m: WF.FittedFolds, target_class: int = 1, dealt: bool = True) -> DataFrame:
    return AT.linear_attribution(m.folded("test"), m.counts, m.weights, m.priors, target_class, dealt=dealt)


def min_count_of(m: WF.PreparedFolds) -> int:
    """10 % of the attributed examples (rounded up), i.e. ``count * 10 >= examples``, from the narrow split."""
    return -(-m.rows("test").count() // 10)


def consensus_of(spark, sf_dir) -> tuple[DataFrame, int]:
    m = fitted(spark, sf_dir)
    return CS.model_consensus(m.texts("test"), m.counts, m.weights, m.priors, target_class=0), min_count_of(m)


@register("token_attribution", f"WITH {SQL_ATTR} SELECT fold, id, pos, token, round(phi, 6) AS phi FROM attr")
def q_token_attribution(spark, sf_dir):
    a = attributions(fitted(spark, sf_dir))
    return a.select("fold", "id", F.col("pos").cast("long").alias("pos"), "token", r6("phi"))


@register("attribution_sum_check", f"""WITH {SQL_ATTR}
SELECT a.fold, a.id, round(sum(a.phi) - (s.logit - p.prior - p.mean_shift), 6) AS residual
FROM attr a JOIN scored_test s ON a.fold = s.fold AND a.id = s.id JOIN prio p ON p.fold = a.fold
GROUP BY a.fold, a.id, s.logit, p.prior, p.mean_shift""")
def q_attr_sum(spark, sf_dir):
    m = fitted(spark, sf_dir)
    scored = M.nb_score(m.texts("test"), m.counts, m.weights, m.priors)
    tot = attributions(m).groupBy("fold", "id").agg(F.sum("phi").alias("_s"))
    j = tot.join(scored.select("fold", "id", "logit"), ["fold", "id"]).join(m.priors, "fold")
    return j.select("fold", "id", F.round(F.col("_s") - (F.col("logit") - F.col("prior") - F.col("mean_shift")), 6)
                    .alias("residual"))


@register("token_occlusion", f"""WITH {SQL_ATTR},
occl AS (SELECT o.fold, o.id, o.pos, o.token, s.logit, p.prior, CAST(o.n_tok AS DOUBLE) AS n, o.w
         FROM occw o JOIN scored_test s ON o.fold = s.fold AND o.id = s.id JOIN prio p ON p.fold = o.fold)
SELECT fold, id, pos, token, round(1.0 / (1.0 + exp(-logit)) - 1.0 / (1.0 + exp(-(CASE WHEN n > 1 THEN
  prior + (n * (logit - prior) - w) / (n - 1) ELSE prior END))), 6) AS phi FROM occl""")
def q_occlusion(spark, sf_dir):
    m = fitted(spark, sf_dir)
    scored = M.nb_score(m.texts("test"), m.counts, m.weights, m.priors)
    a = AT.occlusion_attribution(m.folded("test"), m.counts, m.weights, scored, m.priors)
    return a.select("fold", "id", F.col("pos").cast("long").alias("pos"), "token", r6("phi"))


@register("attribution_store", f"WITH {SQL_ATTR} SELECT fold, id, pos, token, round(phi, 6) AS phi FROM attr")
def q_attr_store(spark, sf_dir):
    from textcohort.session import scratch_path
    from textcohort.sources.io import read_attributions, write_attributions
    a = attributions(fitted(spark, sf_dir), dealt=False)
    path = write_attributions(a, scratch_path(spark, "attribution-store"))
    back = read_attributions(spark, path)
    return back.select(F.col("fold").cast("int").alias("fold"), "id", F.col("pos").cast("long").alias("pos"),
                       "token", r6("phi"))


@register("normalise_word", f"WITH {SQL_ATTR} SELECT DISTINCT token, word FROM words")
def q_normalise_word(spark, sf_dir):
    m = prepared(spark, sf_dir)
    seen = TX.unfold(m.texts("test")).select("token")
    # every attributed text also has its base entry, the empty token
    return CS.with_words(seen.unionByName(m.rows("test").select(F.lit("").alias("token"))).distinct()).select("token", "word")


@register("word_count", f"WITH {SQL_ATTR} SELECT word, count(*) AS count FROM words GROUP BY word")
def q_word_count(spark, sf_dir):
    m = prepared(spark, sf_dir)
    return CS.token_word_count(m.texts("test"), m.counts)


@register("consensus", f"WITH {SQL_ATTR} SELECT word, count, round(shap_avg, 6) AS shap_avg FROM cons")
def q_consensus(spark, sf_dir):
    return consensus_of(spark, sf_dir)[0].select("word", "count", r6("shap_avg"))


@register("consensus_raw", f"""WITH {SQL_ATTR}
SELECT word, fold, id, string_agg(printf('%.2f', phi), '_' ORDER BY pos) AS raw FROM words GROUP BY word, fold, id""")
def q_consensus_raw(spark, sf_dir):
    return CS.consensus_raw(attributions(fitted(spark, sf_dir), target_class=0))


@register("shap_raw", f"""WITH {SQL_ATTR},
listed AS (SELECT word, printf('%.2f', phi) AS v, row_number() OVER (PARTITION BY word ORDER BY fold, id, pos) - 1 AS nth FROM words
           WHERE word IN (SELECT word FROM top))
SELECT word, nth // 500 AS piece, count(*) AS n, string_agg(v, '_' ORDER BY nth) AS raw FROM listed GROUP BY word, nth // 500""")
def q_shap_raw(spark, sf_dir):
    """The whole value lists of the words of the consensus table, in pieces of 500 values."""
    m = fitted(spark, sf_dir)
    attr = attributions(m, target_class=0)
    cons = CS.model_consensus(m.texts("test"), m.counts, m.weights, m.priors, target_class=0)
    return CS.consensus_lists(attr, CS.consensus_top(cons, min_count_of(m)), values=500)


@register("consensus_top", f"WITH {SQL_ATTR} SELECT word, count, round(shap_avg, 6) AS shap_avg FROM top")
def q_consensus_top(spark, sf_dir):
    cons, least = consensus_of(spark, sf_dir)
    return CS.consensus_top(cons, least).select("word", "count", r6("shap_avg"))


@register("consensus_abs", f"WITH {SQL_ATTR} SELECT word, count, round(abs(shap_avg), 6) AS shap_avg FROM top")
def q_consensus_abs(spark, sf_dir):
    cons, least = consensus_of(spark, sf_dir)
    return CS.consensus_abs(CS.consensus_top(cons, least)).select("word", "count", r6("shap_avg"))


@register("consensus_letters", f"""WITH {SQL_ATTR}
SELECT word, count, round(shap_avg, 6) AS shap_avg FROM top0 WHERE regexp_full_match(word, '\\p{{L}}+')""")
def q_consensus_letters(spark, sf_dir):
    cons, least = consensus_of(spark, sf_dir)
    return CS.consensus_letters(cons, least).select("word", "count", r6("shap_avg"))


SQL_RANK_TEST = SQL_PREDS + """,
rk AS (SELECT fold, id, truth AS label,
  CASE WHEN count(*) OVER (PARTITION BY fold) > 1 THEN
    (row_number() OVER (PARTITION BY fold ORDER BY pred, id) - 1) / CAST(count(*) OVER (PARTITION BY fold) - 1 AS DOUBLE)
  ELSE CAST('NaN' AS DOUBLE) END AS rank FROM preds)"""


def ranked_test(spark, sf_dir, m=None):
    m = m or fitted(spark, sf_dir)
    p = WF.scaled_predictions(m)
    return S.rank_normalise(p, ["fold"], "pred", "id", out="rank").select("fold", "id", "label", "rank")


@register("ranked_listing", f"""WITH {SQL_RANK_TEST},
o AS (SELECT *, row_number() OVER (PARTITION BY fold, label ORDER BY
        CASE WHEN label = 1 THEN -rank ELSE rank END, CASE WHEN label = 1 THEN -id ELSE id END) - 1 AS k FROM rk)
SELECT fold, label, k, id, round(rank, 6) AS rank FROM o""")
def q_ranked_listing(spark, sf_dir):
    from textcohort.sources.io import materialize
    r = materialize(ranked_test(spark, sf_dir), "ranked")
    pos = RP.ranked_listing(r, 1, descending=True)
    neg = RP.ranked_listing(r, 0, descending=False)
    return pos.unionByName(neg).select("fold", "label", F.col("k").cast("long").alias("k"), "id", r6("rank"))


@register("nth_by_rank", f"""WITH {SQL_RANK_TEST},
o AS (SELECT *, row_number() OVER (PARTITION BY fold, label ORDER BY
        CASE WHEN label = 1 THEN -rank ELSE rank END, CASE WHEN label = 1 THEN -id ELSE id END) - 1 AS k FROM rk)
SELECT fold, label, k, id, round(rank, 6) AS rank FROM o
WHERE (label = 1 AND k IN (6, 24)) OR (label = 0 AND k IN (0, 2, 9, 10))""")
def q_nth_by_rank(spark, sf_dir):
    r = ranked_test(spark, sf_dir)
    pos = RP.nth_by_rank(r, 1, [6, 24], descending=True)
    neg = RP.nth_by_rank(r, 0, [0, 2, 9, 10], descending=False)
    return pos.unionByName(neg).select("fold", "label", F.col("k").cast("long").alias("k"), "id", r6("rank"))


# ----------------------------------------------------------------------------------------------
# Example table, text helpers
# ----------------------------------------------------------------------------------------------

from textcohort.functions import text as FT  # noqa: E402


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_clean(expr: str, rules, strip: str = "both") -> str:
    for old, new in rules:
        expr = f"replace({expr}, {_sql_str(old)}, {_sql_str(new)})"
    if strip == "both":
        expr = f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"
    elif strip == "right":
        expr = f"regexp_replace({expr}, '\\s+$', '', 'g')"
    return expr


def sql_example(fold: int, picks) -> str:
    parts = []
    for i, p in enumerate(picks):
        stop = ", ".join(_sql_str(s) for s in p.stop)
        text = sql_clean("c.text", p.rules, p.strip)
        if p.trim_chars:
            text = f"CASE WHEN length({text}) > {p.trim_chars} THEN substr({text}, 1, length({text}) - {p.trim_chars}) ELSE '' END"
        vals = f"coalesce((SELECT list(round_even(a.phi, 3) + 0.0 ORDER BY a.pos) FROM attr a WHERE a.fold = o.fold AND a.id = o.id AND a.token NOT IN ({stop})), [])"
        if p.trim_items:
            vals = f"list_slice({vals}, 1, greatest(len({vals}) - {p.trim_items}, 0))"
        parts.append(f"""SELECT o.label AS gt, round_even(o.rank, 3) AS pred, {text} AS text,
  array_to_string(list_transform({vals}, lambda x: CAST(x AS VARCHAR)), ' ') AS shap, {i} AS pick
FROM ko o JOIN cohort c ON c.id = o.id WHERE o.fold = {fold} AND o.label = {p.label} AND o.k = {p.k}""")
    return "\nUNION ALL\n".join(parts)


SQL_EXAMPLE_BASE = SQL_ATTR + "," + sql_scored("vali").replace("rows_vali", "rows_v2") + """,
pmm AS (SELECT fold, min(prob) AS lo, max(prob) AS hi FROM scored_test GROUP BY fold),
preds AS (SELECT s.fold, s.id, s.label AS truth,
    round(CASE WHEN hi <> lo THEN (prob - lo) / (hi - lo) ELSE CAST('NaN' AS DOUBLE) END, 9) AS pred
  FROM scored_test s JOIN pmm ON s.fold = pmm.fold),
rk AS (SELECT fold, id, truth AS label,
  CASE WHEN count(*) OVER (PARTITION BY fold) > 1 THEN
    (row_number() OVER (PARTITION BY fold ORDER BY pred, id) - 1) / CAST(count(*) OVER (PARTITION BY fold) - 1 AS DOUBLE)
  ELSE CAST('NaN' AS DOUBLE) END AS rank FROM preds),
ko AS (SELECT *, row_number() OVER (PARTITION BY fold, label ORDER BY
        CASE WHEN label = 1 THEN -rank ELSE rank END, CASE WHEN label = 1 THEN -id ELSE id END) - 1 AS k FROM rk)"""


@register("example_report", f"WITH {SQL_EXAMPLE_BASE} {sql_example(EXAMPLE_FOLD, EXAMPLE_PICKS)}")
def q_example_report(spark, sf_dir):
    return example_of(fitted(spark, sf_dir), EXAMPLE_FOLD, EXAMPLE_PICKS)


def example_of(m: WF.FittedFolds, fold: int, picks) -> DataFrame:
    """Rank, pick, then attribute the picked texts only."""
    from textcohort.sources.io import materialize
    p = WF.scaled_predictions(m)
    ranked = S.rank_normalise(p, ["fold"], "pred", "id", out="rank").select("fold", "id", "label", "rank")
    # at most one row per pick
    picked = materialize(RP.example_picks(ranked, fold, picks), "picks")
    rows = picked.select("fold", "id").distinct()
    attr = AT.linear_attribution(rows, m.counts, m.weights, m.priors, target_class=1)
    return RP.example_report(picked, m.cohort.select("id", "text"), attr, picks)


@register("clean_text", f"WITH {SQL_COHORT} SELECT id, {sql_clean('text', FT.CLEAN_RULES_BASE)} AS text FROM cohort")
def q_clean_text(spark, sf_dir):
    c = cohort_df(spark, sf_dir)
    return c.select("id", FT.clean_text(F.col("text")).alias("text"))


@register("word_token_check", f"""WITH {SQL_COHORT}, {SQL_TOKENS},
cl AS (SELECT c.id, {sql_clean('c.text', FT.CLEAN_RULES_BASE)} AS text, l.n_tok FROM cohort c JOIN lens l ON c.id = l.id)
SELECT id, CAST(len(string_split(text, ' ')) AS INTEGER) AS n_words, n_tok AS n_tokens,
       len(string_split(text, ' ')) = n_tok AS consistent FROM cl""")
def q_word_token_check(spark, sf_dir):
    c = cohort_df(spark, sf_dir)
    j = c.select("id", FT.clean_text(F.col("text")).alias("text"), FT.tokenise(F.col("text")).alias("tokens"))
    return TX.word_token_check(j).select("id", "n_words", "n_tokens", "consistent")


@register("trim_tail", f"""WITH {SQL_COHORT}, {SQL_TOKENS}
SELECT c.id, CASE WHEN length(c.text) > 3 THEN substr(c.text, 1, length(c.text) - 3) ELSE '' END AS text,
       CAST(greatest(len(t.t) - 1, 0) AS INTEGER) AS n_tokens
FROM cohort c JOIN toks t ON c.id = t.id""")
def q_trim_tail(spark, sf_dir):
    c = cohort_df(spark, sf_dir)
    return c.select("id", FT.trim_tail_chars(F.col("text"), 3).alias("text"),
                    F.size(FT.trim_tail_items(FT.tokenise(F.col("text")), 1)).alias("n_tokens"))


@register("token_stoplist", f"""WITH {SQL_ATTR}
SELECT fold, id, CAST(count(*) FILTER (WHERE token NOT IN ({", ".join(_sql_str(s) for s in RP.STOP_BASE)})) AS INTEGER) AS n_kept,
       CAST(count(*) FILTER (WHERE token IN ({", ".join(_sql_str(s) for s in RP.STOP_BASE)})) AS INTEGER) AS n_dropped
FROM attr GROUP BY fold, id""")
def q_token_stoplist(spark, sf_dir):
    m = prepared(spark, sf_dir)
    return RP.stoplist_tokens(m.rows("test"), m.counts, RP.STOP_BASE)


# ----------------------------------------------------------------------------------------------
# Sources / sinks, stores, pluggable scorer, Spark ML classifier, row index
# ----------------------------------------------------------------------------------------------

from textcohort.operators import index as IX  # noqa: E402
from textcohort.operators import ml as ML  # noqa: E402
from textcohort.operators import scorer as SC  # noqa: E402
from textcohort.session import scratch_path  # noqa: E402
from textcohort.sources import io as IO  # noqa: E402


@register("tsv_roundtrip", f"""WITH {SQL_COHORT}
SELECT CAST(code AS DOUBLE) AS label, '  ' || text || chr(9) || ' tail' || chr(10) || ' ' AS comment, id FROM cohort""")
def q_tsv_roundtrip(spark, sf_dir):
    """Texts with blanks at both ends, a tab and a newline come back unchanged."""
    text = F.concat(F.lit("  "), F.col("text"), F.lit("\t tail\n "))
    c = cohort_df(spark, sf_dir).select(F.col("code").cast("double").alias("label"), text.alias("comment"), "id")
    path = IO.write_delimited(c, scratch_path(spark, "cohort-tsv"), sep="\t")
    back = IO.read_delimited(spark, path, sep="\t", columns=["label", "comment", "id"],
                             casts={"label": "double", "id": "long"})
    return back


@register("csv_roundtrip", f"WITH {SQL_ATTR} SELECT word, count, round(abs(shap_avg), 6) AS shap_avg FROM top")
def q_csv_roundtrip(spark, sf_dir):
    cons, least = consensus_of(spark, sf_dir)
    tbl = CS.consensus_abs(CS.consensus_top(cons, least))
    path = IO.write_delimited(tbl, scratch_path(spark, "consensus-csv"), sep=",")
    back = IO.read_delimited(spark, path, sep=",", columns=["word", "count", "shap_avg"],
                             casts={"count": "long", "shap_avg": "double"})
    return back.select("word", "count", r6("shap_avg"))


@register("fold_report_text", f"""WITH {SQL_PREDS}, {sql_hist('preds', 6)}, {sql_pearson('preds')},
m AS (SELECT auc.fold, auroc, auprc, pearson FROM auc JOIN pear ON auc.fold = pear.fold), {sql_report('m')}
SELECT fold, printf('%.3f', auroc) AS auroc, printf('%.3f', auprc) AS auprc, printf('%.3f', pearson) AS pearson FROM report""")
def q_fold_report_text(spark, sf_dir):
    rep = S.format_report(WF.fold_report(cohort_df(spark, sf_dir), folds=FOLDS, seed=SEED, digits=6))
    path = IO.write_report(rep, scratch_path(spark, "score-report"))
    return IO.read_delimited(spark, path, sep="\t", columns=["fold", "auroc", "auprc", "pearson"])


@register("pred_store", f"WITH {SQL_PREDS} SELECT fold, 0 AS seed, id, round(pred, 6) AS pred FROM preds")
def q_pred_store(spark, sf_dir):
    p = WF.scaled_predictions(fitted(spark, sf_dir)).select("fold", F.lit(SEED).alias("seed"), "id", "pred")
    path = IO.write_predictions(p, scratch_path(spark, "pred-store"))
    back = IO.read_predictions(spark, path)
    return back.select(F.col("fold").cast("int").alias("fold"), F.col("seed").cast("int").alias("seed"), "id", r6("pred"))


@register("pred_store_grid", f"""WITH {SQL_PREDS}
SELECT fold, CAST(seed AS INTEGER) AS seed, id,
       round(CASE WHEN seed = 0 THEN pred WHEN fold = 0 THEN pred / 2 ELSE 1 - pred END, 6) AS pred
FROM preds CROSS JOIN (SELECT unnest([0, 1]) AS seed) WHERE fold < 2""")
def q_pred_store_grid(spark, sf_dir):
    """Two folds and two seeds written by four launches, then one of them written again."""
    p = WF.scaled_predictions(fitted(spark, sf_dir)).select("fold", "id", "pred")
    path = scratch_path(spark, "pred-store-grid")
    pred = F.col("pred")
    for fold, seed, value in ((0, 0, pred), (1, 0, pred), (0, 1, 1 - pred), (1, 1, 1 - pred), (0, 1, pred / 2)):
        IO.write_predictions(p.filter(F.col("fold") == fold).select("fold", F.lit(seed).alias("seed"), "id", value.alias("pred")), path)
    return IO.read_predictions(spark, path).select("fold", "seed", "id", r6("pred"))


@register("model_roundtrip", f"WITH {SQL_NB}, {sql_scored('test')} SELECT fold, id, label, round(prob, 6) AS prob FROM scored_test")
def q_model_roundtrip(spark, sf_dir):
    m = fitted(spark, sf_dir)
    wp = IO.write_table(m.weights, scratch_path(spark, "nb-model-weights"))
    pp = IO.write_table(m.priors, scratch_path(spark, "nb-model-priors"))
    w, p = IO.read_table_at(spark, wp), IO.read_table_at(spark, pp)
    return M.nb_score(m.texts("test"), m.counts, w, p).select("fold", "id", "label", r6("prob"))


@register("score_map_in_pandas", f"WITH {SQL_NB}, {sql_scored('test')} SELECT fold, id, label, round(prob, 6) AS prob FROM scored_test")
def q_score_map_in_pandas(spark, sf_dir):
    m = fitted(spark, sf_dir)
    inputs = SC.nb_inputs(m.texts("test"), m.counts, m.weights, m.priors)
    return SC.score_with(inputs, SC.nb_scorer_factory()).select("fold", "id", "label", r6("prob"))


@register("row_index", f"WITH {SQL_COHORT} SELECT id, row_number() OVER (ORDER BY id) - 1 AS row_idx FROM cohort")
def q_row_index(spark, sf_dir):
    return IX.row_index(cohort_df(spark, sf_dir).select("id"), ["id"])


class FittedLR:
    """Features once per text, stored with its folds, then one regression per fold."""

    def __init__(self, spark, sf_dir):
        self.m = fitted(spark, sf_dir)
        features = ML.hashed_features(TX.doc_tokens(self.m.cohort))
        self.train = ML.fold_rows(self.m.balanced, features, "lr-train", nested=True)
        self.test = ML.fold_rows(self.m.rows("test"), features, "lr-test", nested=True)
        self.models = ML.lr_fit(self.train, list(range(FOLDS)))


@register("lr_fit", "SELECT CAST(range AS INTEGER) AS fold, true AS converged, true AS stationary FROM range(10)")
def q_lr_fit(spark, sf_dir):
    """Per fold: the optimiser ended before its bound, and the intercept's derivative is 0 at the fit."""
    lr = FittedLR(spark, sf_dir)
    done = [f for f, ended in ML.lr_summary(lr.models) if ended]
    r = ML.lr_residual(lr.models, lr.train)
    return r.select("fold", F.col("fold").isin(done).alias("converged"), (F.col("residual") < 1e-4).alias("stationary"))


@register("lr_score", f"WITH {SQL_SPLIT} SELECT fold, id, label, true AS in_range FROM split WHERE split = 'test'")
def q_lr_score(spark, sf_dir):
    lr = FittedLR(spark, sf_dir)
    return ML.lr_score(lr.models, lr.test).select("fold", "id", "label", F.col("prob").between(0.0, 1.0).alias("in_range"))


@register("lr_fold_report", f"WITH {SQL_SPLIT} SELECT DISTINCT fold, CAST(0 AS DOUBLE) AS auroc_less_rank_sum FROM split")
def q_lr_report(spark, sf_dir):
    """AUROC of the report less the rank-sum AUROC of the same scores."""
    from textcohort.sources.io import materialize
    lr = FittedLR(spark, sf_dir)
    p = S.minmax_scale(ML.lr_score(lr.models, lr.test), ["fold"], score="prob", out="pred")
    p = materialize(p.select("fold", F.col("label").alias("truth"), F.round("pred", 6).alias("pred")), "lr-pred")
    met = S.fold_metrics(p, ["fold"], "pred", "truth", 6)
    return met.join(S.rank_sum_auc(p, ["fold"], "pred", "truth"), "fold").select(
        "fold", (F.round(F.col("auroc") - F.col("rank_sum"), 6) + 0.0).alias("auroc_less_rank_sum"))


@register("model_roundtrip_lr", f"WITH {SQL_SPLIT} SELECT fold, id, CAST(0 AS DOUBLE) AS difference FROM split WHERE split = 'test'")
def q_lr_roundtrip(spark, sf_dir):
    """Probability under the reloaded models less that under the fitted ones."""
    lr = FittedLR(spark, sf_dir)
    loaded = ML.load_models(ML.save_models(lr.models, scratch_path(spark, "lr-models")))
    again = ML.lr_score(loaded, lr.test).select("fold", "id", F.col("prob").alias("again"))
    return ML.lr_score(lr.models, lr.test).join(again, ["fold", "id"]).select(
        "fold", "id", (F.col("again") - F.col("prob")).alias("difference"))


@register("train_shuffle", f"WITH {SQL_OVERSAMPLE} SELECT fold, id, label, copy FROM balanced")
def q_train_shuffle(spark, sf_dir):
    """Oversampled train rows in random order (the content is what is compared)."""
    return SP.shuffle_rows(balanced_df(spark, sf_dir))


@register("auprc", f"WITH {SQL_SCORED}, {sql_hist('scaled', 5)} SELECT fold, round(auprc, 6) AS auprc FROM auc")
def q_auprc(spark, sf_dir):
    return S.auc_scores(scaled_scores(spark, sf_dir), ["fold"], "pred", "truth", digits=5).select("fold", r6("auprc"))


@register("attribution_union", f"""WITH {SQL_ATTR}
SELECT fold, count(*) AS n_tokens, count(DISTINCT id) AS n_texts, round(sum(phi), 6) AS phi_sum FROM attr GROUP BY fold""")
def q_attr_union(spark, sf_dir):
    """Every fold's attributions written as its own store, then read back as one table."""
    from textcohort.sources.io import read_attributions, write_attributions
    a = attributions(fitted(spark, sf_dir), dealt=False)
    base = scratch_path(spark, "attribution-folds")
    write_attributions(a, base)          # one directory per fold (fold=0 .. fold=9)
    u = read_attributions(spark, base)   # one scan over all fold directories = the union
    return u.groupBy(F.col("fold").cast("int").alias("fold")).agg(
        F.count(F.lit(1)).alias("n_tokens"), F.countDistinct("id").alias("n_texts"),
        F.round(F.sum("phi"), 6).alias("phi_sum"))


# ----------------------------------------------------------------------------------------------
# The study whose negatives have code 5, rank-normalised metrics, the survey scan
# ----------------------------------------------------------------------------------------------

from textcohort.plans.examples import EXAMPLES  # noqa: E402

SQL_COHORT_5 = SQL_COHORT.replace("diagnosis = 6", "diagnosis = 5").replace("IN (2, 3, 6)", "IN (2, 3, 5)")


def class5(sql: str) -> str:
    """The same SQL over the other cohort."""
    return sql.replace(SQL_COHORT, SQL_COHORT_5)


def cohort5_df(spark, sf_dir):
    return C.build_cohort(survey(spark, sf_dir), lang_needle=LANG, pos_codes=POS_CODES, neg_code=5)


@register("cohort_class5", f"WITH {SQL_COHORT_5} SELECT id, code, label, text FROM cohort")
def q_cohort5(spark, sf_dir):
    return cohort5_df(spark, sf_dir)


@register("class_counts_class5", f"WITH {SQL_COHORT_5} SELECT code, count(*) AS n FROM cohort GROUP BY code")
def q_class_counts5(spark, sf_dir):
    return C.class_counts(cohort5_df(spark, sf_dir), "code")


@register("example_report_class5", f"WITH {class5(SQL_EXAMPLE_BASE)} {sql_example(*EXAMPLES[5])}")
def q_example5(spark, sf_dir):
    return example_of(WF.fit_folds(cohort5_df(spark, sf_dir), folds=FOLDS, seed=SEED), *EXAMPLES[5])


@register("rank_report", f"""WITH {SQL_RANK_TEST}, r2 AS (SELECT fold, id, label AS truth, rank AS pred FROM rk),
{sql_hist('r2', 6)}, {sql_pearson('r2')},
m AS (SELECT auc.fold, auroc, auprc, pearson FROM auc JOIN pear ON auc.fold = pear.fold), {sql_report('m')}
SELECT fold, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(pearson, 6) AS pearson FROM report""")
def q_rank_report(spark, sf_dir):
    rep = S.fold_report(WF.rank_report(ranked_test(spark, sf_dir), digits=6))
    return rep.select("fold", r6("auroc"), r6("auprc"), r6("pearson"))


@register("survey_scan", """
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(doc_id % 7 AS DOUBLE) END AS diagnosis,
  CASE WHEN doc_id % 3 = 0 THEN 'nan' ELSE text END || '|nan|' || ' ' || lang || ' |nan' AS comment
FROM documents""")
def q_survey_scan(spark, sf_dir):
    """A survey export with missing codes and comments in several spellings, scanned back."""
    docs = T.read_table(spark, sf_dir, "documents")
    spelled = F.element_at(F.array(*[F.lit(m) for m in ("NA", "n/a", "NULL", "NaN")]), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    code, c1, c2, c3, c4 = T.SURVEY_CODE, *T.SURVEY_COMMENTS
    export = docs.select(
        F.when(F.col("doc_id") % 5 == 0, spelled).otherwise((F.col("doc_id") % 7).cast("string")).alias(code),
        F.when(F.col("doc_id") % 3 == 0, spelled).otherwise(F.col("text")).alias(c1), spelled.alias(c2),
        F.concat(F.lit(" "), "lang", F.lit(" ")).alias(c3), F.lit(None).cast("string").alias(c4), F.col("doc_id").alias(T.SURVEY_ID))
    path = IO.write_delimited(export, scratch_path(spark, "survey-csv"), sep=",")
    return T.survey_from_csv(spark, path).select("id", "diagnosis", "comment")


# ----------------------------------------------------------------------------------------------
# All folds' regressions in one pass per evaluation: a trace of epochs, and the optimum
# ----------------------------------------------------------------------------------------------

from textcohort.operators import optimise as OP  # noqa: E402

EPOCHS, RATE = 3, 20.0


def sql_epoch(e: int) -> str:
    """One step of gradient descent from the weights of epoch ``e`` (0: all zero), and that epoch's probabilities."""
    z = "0.0" if e == 0 else "coalesce(s.z, 0.0) + b.w"
    joins = "" if e == 0 else f"""LEFT JOIN (SELECT o.fold, o.id, sum(x * w) AS z FROM own o JOIN feats USING (id) JOIN w{e} ON w{e}.fold = o.fold AND w{e}.slot = feats.slot
                                 GROUP BY o.fold, o.id) s ON s.fold = o.fold AND s.id = o.id JOIN w{e} b ON b.fold = o.fold AND b.slot = -1"""
    old = "0.0" if e == 0 else "coalesce(w, 0.0)"
    last = "" if e == 0 else f"FULL JOIN w{e} USING (fold, slot)"
    return f"""
z{e} AS (SELECT o.*, 1.0 / (1.0 + exp(-CAST({z} AS DOUBLE))) AS p FROM own o {joins}),
g{e} AS (SELECT fold, slot, sum(x * m * (p - label)) / max(mass) AS g FROM z{e} JOIN feats USING (id) JOIN masses USING (fold) WHERE m > 0 GROUP BY fold, slot
         UNION ALL SELECT fold, -1, sum(m * (p - label)) / max(mass) FROM z{e} JOIN masses USING (fold) GROUP BY fold),
w{e + 1} AS (SELECT fold, slot, {old} - {RATE} * (coalesce(g, 0.0) + CASE WHEN slot >= 0 THEN {OP.REG} * {old} ELSE 0.0 END) AS w FROM g{e} {last})"""


SQL_EPOCHS = SQL_NB + f""",
feats AS (SELECT id, CAST(CAST('0x' || substr(md5(token), 1, 15) AS BIGINT) % {OP.SLOTS} AS INTEGER) AS slot, tf / CAST(n_tok AS DOUBLE) AS x FROM tfs),
own AS (SELECT s.fold, s.id, s.label, s.split = 'vali' AS held, CASE WHEN s.split = 'train' THEN m.mult ELSE 0 END AS m
        FROM split s LEFT JOIN mult m ON m.fold = s.fold AND m.id = s.id WHERE s.split <> 'test'),
masses AS (SELECT fold, CAST(sum(m) AS DOUBLE) AS mass FROM own GROUP BY fold),
{",".join(sql_epoch(e) for e in range(EPOCHS + 1))},
judged AS ({" UNION ALL ".join(f"SELECT {e} AS epoch, fold, p, label, m, held FROM z{e}" for e in range(1, EPOCHS + 1))}),
losses AS (SELECT epoch, j.fold, sum(m * -CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END) / max(mass) AS loss FROM judged j JOIN masses USING (fold) GROUP BY epoch, j.fold),
norms AS ({" UNION ALL ".join(f"SELECT {e} AS epoch, fold, sum(w * w) AS q FROM w{e} WHERE slot >= 0 GROUP BY fold" for e in range(1, EPOCHS + 1))}),
scores AS (SELECT epoch, fold, CASE WHEN var_pop(p) > 1e-18 AND var_pop(label) > 0 THEN covar_pop(p, label) / sqrt(var_pop(p) * var_pop(label)) END AS pearson
           FROM judged WHERE held GROUP BY epoch, fold),
placed AS (SELECT epoch, fold, loss + {OP.REG} / 2 * q AS loss, pearson, row_number() OVER (PARTITION BY fold ORDER BY coalesce(pearson, -2) DESC, epoch) = 1 AS chosen,
                  max(pearson) OVER (PARTITION BY fold ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best
           FROM losses JOIN norms USING (epoch, fold) LEFT JOIN scores USING (epoch, fold))"""


def fold_features(m: WF.FittedFolds) -> DataFrame:
    return OP.fold_features(m.counts, list(range(FOLDS)))


@register("epoch_trace", f"""WITH {SQL_EPOCHS}
SELECT CAST(epoch AS INTEGER) AS epoch, CAST(fold AS INTEGER) AS fold, round(loss, 6) AS loss, round(coalesce(pearson, CAST('NaN' AS DOUBLE)), 6) AS pearson,
       round(coalesce(best, CAST('NaN' AS DOUBLE)), 6) AS best, chosen FROM placed""")
def q_epoch_trace(spark, sf_dir):
    """Three epochs of gradient descent for all folds: loss, validation Pearson, the best so far and the state chosen."""
    trace = OP.descend(fold_features(fitted(spark, sf_dir)), list(range(FOLDS)), EPOCHS, RATE)
    rows = spark.createDataFrame(trace.rows, "epoch int, fold int, loss double, pearson double, best double, chosen boolean")
    return rows.select("epoch", "fold", r6("loss"), r6("pearson"), r6("best"), "chosen")


@register("epoch_states", f"""WITH {SQL_EPOCHS}
SELECT CAST(w.fold AS INTEGER) AS fold, CAST(slot AS INTEGER) AS slot, round(w, 6) AS w
FROM ({" UNION ALL ".join(f"SELECT {e} AS epoch, fold, slot, w FROM w{e}" for e in range(1, EPOCHS + 1))}) w
JOIN placed ON placed.fold = w.fold AND placed.epoch = w.epoch AND chosen WHERE w <> 0""")
def q_epoch_states(spark, sf_dir):
    """The chosen state's weights of every fold, read back from the tables that the epochs wrote."""
    trace = OP.descend(fold_features(fitted(spark, sf_dir)), list(range(FOLDS)), EPOCHS, RATE)
    states = trace.states[0]
    for s in trace.states[1:]:
        states = states.unionByName(s)
    picked = spark.createDataFrame(list(trace.chosen.items()), "fold int, epoch int")
    return states.join(F.broadcast(picked), ["fold", "epoch"]).select("fold", "slot", r6("w"))


@register("lr_all_folds", f"WITH {SQL_OVERSAMPLE} SELECT CAST(fold AS INTEGER) AS fold, CAST(count(*) AS DOUBLE) AS mass, true AS stationary FROM balanced GROUP BY fold")
def q_lr_all_folds(spark, sf_dir):
    """All folds at their optimum: the gradient at the stored weights, recomputed by joins, is below 1e-5."""
    data, folds = fold_features(fitted(spark, sf_dir)), list(range(FOLDS))
    w, _ = OP.minimise(data, folds)
    norms = OP.gradient_norms(data, OP.state_table(spark, w, folds, 0), folds)
    return norms.select("fold", "mass", (F.col("norm") < 1e-5).alias("stationary"))


from textcohort.operators import partition as PA  # noqa: E402

MAX_EVALS = 180


def sql_tree(depth: int) -> str:
    """The node of the tree in which a position lies after ``depth`` halvings."""
    steps = ["node0 AS (SELECT id, pos, token, n_tok, 0 AS lo, n_tok AS hi FROM placed_tokens)"]
    for k in range(depth):
        mid = "(lo + hi) // 2"
        steps.append(f"""node{k + 1} AS (SELECT id, pos, token, n_tok, CASE WHEN hi - lo > 1 AND pos >= {mid} THEN {mid} ELSE lo END AS lo,
                         CASE WHEN hi - lo > 1 AND pos < {mid} THEN {mid} ELSE hi END AS hi FROM node{k})""")
    return ",\n".join(steps)


@register("partition_attribution", f"""WITH {SQL_EPOCHS},
placed_tokens AS (SELECT t.id, unnest(range(len(t.t))) AS pos, unnest(t.t) AS token, CAST(len(t.t) AS BIGINT) AS n_tok
                  FROM toks t JOIN split s ON s.id = t.id AND s.fold = {EXAMPLE_FOLD} AND s.split = 'test'),
{sql_tree(PA.levels(MAX_EVALS))},
valued AS (SELECT n.*, coalesce(w, 0.0) / n_tok AS own FROM node{PA.levels(MAX_EVALS)} n
           LEFT JOIN w{EPOCHS} w ON w.fold = {EXAMPLE_FOLD} AND w.slot = CAST('0x' || substr(md5(token), 1, 15) AS BIGINT) % {OP.SLOTS})
SELECT CAST({EXAMPLE_FOLD} AS INTEGER) AS fold, id, pos, token, round(avg(own) OVER (PARTITION BY id, lo, hi), 6) AS phi FROM valued
UNION ALL
SELECT CAST({EXAMPLE_FOLD} AS INTEGER), s.id, -1, '', round(w.w, 6) FROM split s JOIN w{EPOCHS} w ON w.fold = {EXAMPLE_FOLD} AND w.slot = -1
WHERE s.fold = {EXAMPLE_FOLD} AND s.split = 'test'""")
def q_partition_attribution(spark, sf_dir):
    """One fold's test texts under a scorer that is only a callable (the hashed model's logit, so the tree's values have a
    closed form: a token's share, averaged over the tokens of its last node)."""
    m = fitted(spark, sf_dir)
    folds = list(range(FOLDS))
    trace = OP.descend(OP.fold_features(m.counts, folds), folds, EPOCHS, RATE)
    w = OP.weights_of(trace.states[-1], folds)
    # the fold's texts are picked first: the others are not tokenised
    picked = m.cohort.select("id", "text").join(m.rows("test").filter(F.col("fold") == EXAMPLE_FOLD).select("fold", "id"), "id")
    texts = TX.doc_tokens(picked, keep=["fold"])
    a = PA.partition_attribution(texts, OP.slot_scorer(w, folds, probability=False), MAX_EVALS)
    return a.select("fold", "id", F.col("pos").cast("long").alias("pos"), "token", r6("phi"))


# ----------------------------------------------------------------------------------------------
# Matching by position: certified or refused
# ----------------------------------------------------------------------------------------------

from textcohort.operators import align as AL  # noqa: E402

ALIGN_BLOCK = 16

SQL_CERTIFICATE = """
cert_{0} AS (SELECT fold, CAST(pos // 16 AS BIGINT) AS block, count(*) AS n, min(pos) AS first, max(pos) AS last,
             CAST(sum(CAST('0x' || substr(md5(CAST(pos AS VARCHAR) || ':' || CAST(id AS VARCHAR)), 1, 9) AS BIGINT)) AS BIGINT) AS digest FROM {0} GROUP BY fold, pos // 16)"""


@register("alignment_check", f"""WITH {SQL_SPLIT},
whole AS (SELECT fold, id, row_number() OVER (PARTITION BY fold ORDER BY id) - 1 AS pos FROM split WHERE split = 'test'),
sizes AS (SELECT fold, count(*) AS n FROM whole GROUP BY fold),
less AS (SELECT fold, id, row_number() OVER (PARTITION BY fold ORDER BY id) - 1 AS pos FROM whole JOIN sizes USING (fold)
         WHERE fold % 3 = 0 OR pos <> n // 2),
{SQL_CERTIFICATE.format('whole')}, {SQL_CERTIFICATE.format('less')}
SELECT CAST(coalesce(a.fold, b.fold) AS INTEGER) AS fold, coalesce(a.block, b.block) AS block, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right,
       (a.n = b.n AND a.first = b.first AND a.last = b.last AND a.digest = b.digest) IS TRUE AS same
FROM cert_whole a FULL JOIN cert_less b ON a.fold = b.fold AND a.block = b.block""")
def q_alignment_check(spark, sf_dir):
    """Every fold's test rows against a copy that has lost its middle row in two folds of three: the blocks from that row
    on differ."""
    rows = split_df(spark, sf_dir).filter("split = 'test'").select("fold", "id")
    whole = AL.positions(rows, ["id"], ["fold"])
    sizes = whole.groupBy("fold").agg(F.count(F.lit(1)).alias("_n"))
    kept = whole.join(sizes, "fold").filter((F.col("fold") % 3 == 0) | (F.col("pos") != F.floor(F.col("_n") / 2))).select("fold", "id")
    less = AL.positions(kept, ["id"], ["fold"])
    marks = [AL.certificate(t, block=ALIGN_BLOCK, keys=["fold"]) for t in (whole, less)]
    return AL.compare(*marks, keys=["fold"])
