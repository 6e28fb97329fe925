"""Small helpers shared by the operators: inputs, batches of bounded size, shared folders."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textcohort.session import scratch_path
from textcohort.sources.io import materialize
from textcohort.sources.tables import read_table

__all__ = ["ascii_lower", "doc_texts", "importable", "materialize", "read_table", "scratch_path",
           "slices", "split_long", "text_array", "tidy", "partitions_for"]

def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, besides what their own path has
    (a cluster has the package installed; a local session may run from another folder)."""
    import textcohort

    root = os.path.dirname(os.path.dirname(os.path.abspath(textcohort.__file__)))
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_SPACE = re.compile(r"[ \t-\r]")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only.  An all-ASCII text takes the byte-wise ``lower``; any other text goes
    through ``translate``, because ``lower`` would also change letters such as É."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)) \
            .otherwise(F.translate(col, UPPER, UPPER.lower()))


def doc_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; a null text counts as empty.  Other
    columns, whatever their names, never enter an operator's plan."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    """The session's shuffle partition count: the cluster owner's sizing."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_array(col) -> pa.Array:
    """A text column of a record batch with nulls as empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col, "") if col.null_count else col


def tidy(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, giving memory that is free at its end back to the system: a Python worker
    outlives its task and would hold it beside the next operator's."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                with contextlib.suppress(OSError, AttributeError):  # a C library without this call
                    ctypes.CDLL(None).malloc_trim(0)

    return task


def slices(texts: pa.Array, max_bytes: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Ranges ``(start, stop)`` of rows whose texts hold at most ``max_bytes`` together; a longer
    text stands alone."""
    start, held = 0, 0
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    for i, n in enumerate(sizes):
        if i > start and held + n > max_bytes:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def split_long(text: str, limit: int) -> Iterator[str]:
    """Cut a text before ASCII white space into parts of about ``limit`` characters (a part grows
    to the next white space where the text has none)."""
    at = 0
    while len(text) - at > limit:
        m = ASCII_SPACE.search(text, at + limit)
        if m is None:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]
