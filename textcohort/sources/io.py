"""Edges: delimited text files, partitioned prediction / attribution stores, written tables.

Delimited files are only edges (multi-line quoted text is not splittable); Parquet is the
internal format.  Quote and escape are both ``"`` so tabs, quotes and newlines inside a field
round-trip; an empty field reads back as null, like the pandas files the workflow exchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textcohort.sources.store import KEYS, read_store, write_store

# Spellings that a delimited file may use for a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
           "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _csv_options(sep: str) -> dict:
    # the writer would strip white space around a field unless told not to
    return {"sep": sep, "header": "true", "quote": '"', "escape": '"', "multiLine": "true",
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_delimited(spark: SparkSession, path: str, sep: str = "\t",
                   schema: StructType | None = None, columns: Sequence[str] | None = None,
                   casts: dict[str, str] | None = None, missing: Sequence[str] = ()) -> DataFrame:
    """Read a CSV/TSV with a header.  Without a schema every column is a string; pick columns
    by name and cast them (a schema is applied by position, so it must list every column).

    A string equal to one of ``missing`` (``MISSING`` has the usual spellings) becomes null; a value that
    its cast does not accept becomes null too."""
    r = spark.read.options(**_csv_options(sep))
    if schema is not None:
        r = r.schema(schema)
    df = r.csv(path)
    if columns is not None:
        df = df.select(*columns)
    if missing:
        text = {c for c, t in df.dtypes if t == "string"}
        df = df.select(*[F.when(~df[c].isin(list(missing)), df[c]).alias(c) if c in text else df[c] for c in df.columns])
    for c, t in (casts or {}).items():
        df = df.withColumn(c, df[c].try_cast(t))
    return df


def write_delimited(df: DataFrame, path: str, sep: str = "\t", mode: str = "overwrite") -> str:
    df.write.mode(mode).options(**_csv_options(sep)).csv(path)
    return path


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Score report sink: one small TSV file with a header (the report has a row per fold),
    rows in the order fold0..foldK, avg, median."""
    kind = F.when(F.col("fold") == "avg", 1).when(F.col("fold") == "median", 2).otherwise(0)
    num = F.regexp_extract(F.col("fold"), r"(\d+)$", 1)
    ordered = report.orderBy(kind, F.when(num != "", num.cast("long")))
    ordered.coalesce(1).write.mode(mode).options(**_csv_options("\t")).csv(path)
    return path


def write_predictions(df: DataFrame, path: str) -> str:
    """Prediction store: ``(fold, seed, id, pred)``.  Replaces the (fold, seed) pairs that ``df`` has, keeps all others."""
    return write_store(df, path)


def read_predictions(spark: SparkSession, path: str, fold: int | None = None,
                     seed: int | None = None) -> DataFrame:
    """Load predictions; only the folders of the wanted folds and seeds are read."""
    return read_store(spark, path, fold=fold, seed=seed)


def write_attributions(df: DataFrame, path: str) -> str:
    """Attribution store: long table ``(fold, id, pos, token, phi)``, with a ``seed`` or without.  Replaces the folds (or fold
    and seed pairs) that ``df`` has, keeps all others."""
    return write_store(df, path, [k for k in KEYS if k in df.columns])


def read_attributions(spark: SparkSession, path: str, folds: Sequence[int] | None = None, seed: int | None = None) -> DataFrame:
    only = {} if seed is None else {"seed": seed}
    return read_store(spark, path, fold=folds, **only)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).parquet(path)
    return path


def read_table_at(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def materialize(df: DataFrame, name: str, partition_by: Sequence[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet under the session's shared checkpoint folder and read it back.

    Used where a result is consumed by several later stages (split assignment, token table,
    model tables): it cuts the lineage (recovery after a lost executor restarts from the written
    table, not from the raw text), keeps query plans small, and gives the optimizer real sizes.
    """
    from textcohort.session import scratch_path

    path = scratch_path(df.sparkSession, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)
