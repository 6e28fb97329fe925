"""Loaders for the test tables and the stand-ins that give them the cohort schema.

The survey the workflow was written for is not available.  The stand-ins below map the
provided tables onto the same shapes (see FIXTURES.md):

* ``survey_table``   – ``documents`` left-joined with ``labels``: ``id``, ``unique_id`` (the
  language tag plays the part of the id that names the language), ``diagnosis`` (double,
  null when unlabelled) and ``comment`` (the whole text).
* ``comments_table`` – ``conversations`` in blocks of four turns, each block's turns as four
  nullable comment columns.
* ``scored_table``   – ``lineitem`` as a large scored table: ``fold`` = line number,
  ``id`` = order key, ``score`` = extended price, ``truth`` = discount >= 0.05.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Diagnosis code assigned to each (quality, toxic) pair of the labels table.
CLASS_CODE_OF = {(1, 0): 2, (1, 1): 3, (0, 1): 5, (0, 0): 6}

#: Comment columns of a row, and so turns of a block.
COMMENTS = 4


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def survey_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("unique_id"),
        F.col("text").alias("comment"))
    labels = read_table(spark, sf_dir, "labels")
    code = None
    for (q, t), c in CLASS_CODE_OF.items():
        cond = (F.col("quality") == q) & (F.col("toxic") == t)
        code = F.when(cond, F.lit(float(c))) if code is None else code.when(cond, F.lit(float(c)))
    labels = labels.select(F.col("doc_id").alias("id"), code.alias("diagnosis"))
    # labels holds at most one row per document; the join keeps every document.
    return docs.join(labels, "id", "left")


def comments_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, block, nth, comment1..comment4)`` over every turn of every conversation.

    Block ``b`` holds turns ``4b .. 4b + 3``; every conversation has all blocks up to the table's last,
    so rows without any comment stay.  Messages that share a conversation and a turn are numbered
    in text order (``nth``) and stay in rows of their own."""
    conv = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "turn", "text")
    same = Window.partitionBy("id", "turn").orderBy("text")
    placed = (conv.withColumn("nth", F.row_number().over(same) - 1)
                  .withColumn("block", F.floor(F.col("turn") / COMMENTS).cast("int"))
                  .withColumn("place", (F.col("turn") % COMMENTS).cast("int")))
    # conditional aggregation = pivot with fixed values; partial aggregation before the shuffle
    rows = placed.groupBy("id", "block", "nth").agg(
        *[F.max(F.when(F.col("place") == i, F.col("text"))).alias(f"comment{i + 1}") for i in range(COMMENTS)])
    last = conv.agg(F.max(F.floor(F.col("turn") / COMMENTS)).cast("int").alias("last")).first()["last"] or 0
    grid = (conv.select("id").distinct()
                .select("id", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("block")))
    return grid.join(rows, ["id", "block"], "left").withColumn("nth", F.coalesce("nth", F.lit(0)))


def scored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_linenumber").cast("int").alias("fold"),
        F.col("l_orderkey").alias("id"),
        F.col("l_extendedprice").cast("double").alias("score"),
        (F.col("l_discount") >= 0.05).cast("int").alias("truth"))


# Column names of the survey export the workflow reads (code, four comments, id).
SURVEY_CODE = "COVID_diagnosis"
SURVEY_COMMENTS = [
    "Comment_-_changes_in_smell",
    "Comment_-_changes_in_taste",
    "Comment_-_changes_in_chemesthesis",
    "Comment_-_Anything_else_smell__taste__flavor",
]
SURVEY_ID = "UniqueID"
SURVEY_LANGUAGE = "English"


def survey_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """The original survey export (CSV, header, quoted multi-line fields) in the cohort schema.

    Reads every column as a string (no inference pass over the file), selects the six used
    columns by name, turns the spellings of ``io.MISSING`` into nulls, casts the code (anything that is
    no number is missing), and merges the four comments (missing -> ``nan``).  A quoted multi-line file
    is read by one task, so it is parsed once, into a Parquet table that everything else reads.
    Returns ``(id, unique_id, diagnosis, comment)``; ``id`` is the survey's own ``UniqueID``.
    """
    from textcohort.functions.text import merge_columns
    from textcohort.sources.io import MISSING, materialize, read_delimited

    raw = read_delimited(spark, path, sep=",", columns=[SURVEY_CODE, *SURVEY_COMMENTS, SURVEY_ID], missing=MISSING)
    return materialize(raw.select(F.col(SURVEY_ID).alias("id"), F.col(SURVEY_ID).alias("unique_id"),
                                  F.col(SURVEY_CODE).try_cast("double").alias("diagnosis"),
                                  merge_columns(SURVEY_COMMENTS).alias("comment")), "survey")
