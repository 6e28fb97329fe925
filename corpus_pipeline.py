"""A training corpus from ``documents``: toxicity filter, exact dedup, SimHash near-dedup, redaction of
personal data, packing into token sequences.

Every stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents`` and returns them, the last
one the packed pieces.  Each result is written and read again, so a stage's decisions are those that
the next one sees, and a lost executor repeats work of one stage only.

A null text counts as empty in every decision and is passed on as null.  An empty table gives an empty
result in every stage.  Columns beyond those of ``documents`` are kept up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textcohort.llm.common import importable, materialize, read_table
from textcohort.llm.exact_dedup import drop_copies
from textcohort.llm.packing import pack
from textcohort.llm.pii import redact
from textcohort.llm.simhash import drop_near_copies
from textcohort.llm.toxicity import drop_toxic


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores below one half (all, if the labels lack a class); labels come
    from the ``labels`` table."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased), the row with the largest doc_id."""
    return drop_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by SimHash links (3-word shingles, at most 3 bits), the one with the
    smallest doc_id."""
    return drop_near_copies(docs, words=3, max_bits=3)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All base and discovered spans replaced by their kind in brackets; ``n_chars`` follows the text."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    pieces = pack(docs, window=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity_filter), ("exact dedup", exact_dedup), ("simhash near-dedup", simhash_dedup),
          ("personal data", redact_personal_data), ("packing", packing)]

#: Trees, SimHash components and packing are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared checkpoint folder."""
    importable(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
