"""Cohort building: row filters, projections, class pick, comment merge, labels, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcohort.functions.text import EMPTY_MERGED_4, merge_columns


def filter_substring(df: DataFrame, col: str, needle: str) -> DataFrame:
    """Keep rows whose ``col`` contains ``needle`` (case-sensitive)."""
    return df.filter(F.col(col).contains(needle))


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def class_filter(df: DataFrame, col: str, codes: Sequence) -> DataFrame:
    """Keep rows whose code is one of ``codes``; null / NaN codes fail every equality."""
    return df.filter(F.col(col).isin(list(codes)))


def merge_comments(df: DataFrame, cols: Sequence[str], out: str = "comment") -> DataFrame:
    """``c1|c2|c3|c4`` with a missing comment spelled ``nan``."""
    return df.withColumn(out, merge_columns(cols))


def drop_empty_comment(df: DataFrame, col: str = "comment", sentinel: str = EMPTY_MERGED_4) -> DataFrame:
    return df.filter(F.col(col) != F.lit(sentinel))


def filter_max_chars(df: DataFrame, col: str, max_chars: int) -> DataFrame:
    """Keep texts shorter than ``max_chars`` characters (code points)."""
    return df.filter(F.length(col) < max_chars)


def binarise_label(df: DataFrame, col: str, neg_code, out: str = "label") -> DataFrame:
    """``neg_code`` -> 0, any other code -> 1, as an integer column."""
    return df.withColumn(out, F.when(F.col(col) == F.lit(neg_code), F.lit(0)).otherwise(F.lit(1)).cast("int"))


def class_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per class value (one partial-aggregated shuffle)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def build_cohort(survey: DataFrame, *, id_col: str = "id", lang_col: str = "unique_id",
                 lang_needle: str | None = "en", code_col: str = "diagnosis",
                 pos_codes: Sequence = (2, 3), neg_code=6, text_col: str = "comment") -> DataFrame:
    """Language filter -> class pick -> drop empty comments -> binary label.

    Returns ``(id, code, label, text)``.  One lazy plan: the filters reach the Parquet scan.
    """
    df = survey
    if lang_needle is not None:
        df = filter_substring(df, lang_col, lang_needle)
    df = class_filter(df, code_col, [*pos_codes, neg_code])
    df = df.filter(F.col(text_col).isNotNull())
    df = drop_empty_comment(df, text_col)
    df = binarise_label(df, code_col, neg_code)
    return df.select(F.col(id_col).alias("id"), F.col(code_col).cast("int").alias("code"),
                     "label", F.col(text_col).alias("text"))
