"""Certified alignment of tables that are matched by position.

Two outputs of a run may only be put side by side row by row if they list the same ids in the same order.  A certificate of a
table has, per block of positions, the number of rows, the smallest and largest position and an order-sensitive digest (the sum
of the leading digits of ``md5(position:id)``): one aggregation, one row per block, no sort.  Two tables whose
certificates are equal are aligned; otherwise the first block that differs says where they part.

A null id counts as the empty string.  Positions are 0, 1, 2, ...; a gap or a repeated position shows in the digest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcohort.operators.index import md5_int, ordered_index

BLOCK = 1 << 16


def certificate(rows: DataFrame, pos: str = "pos", id_col: str = "id", block: int = BLOCK, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, block, n, first, last, digest)`` of rows with a position and an id.  ``md5_int`` has 9 hex digits, so the sum
    of a block of less than 2^27 rows fits 63 bits."""
    mark = md5_int(F.col(pos), F.coalesce(F.col(id_col).cast("string"), F.lit("")), hex_digits=9)
    return rows.groupBy(*keys, F.floor(F.col(pos) / block).cast("long").alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"), F.max(pos).alias("last"), F.sum(mark).alias("digest"))


def compare(left: DataFrame, right: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, block, n_left, n_right, same)`` of two certificates; a block that one of them lacks has no rows there."""
    names = ("n", "first", "last", "digest")
    a = left.select(*keys, "block", *[F.col(c).alias(f"_{c}") for c in names])
    both = a.join(right, [*keys, "block"], "full")
    same = F.lit(True)
    for c in names:
        same = same & F.col(f"_{c}").eqNullSafe(F.col(c))
    return both.select(*keys, "block", F.coalesce("_n", F.lit(0)).alias("n_left"), F.coalesce("n", F.lit(0)).alias("n_right"), same.alias("same"))


def first_difference(left: DataFrame, right: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, block)``: per key the first block in which two certificates differ; no row where they are equal."""
    rows = compare(left, right, keys).filter(~F.col("same"))
    return rows.groupBy(*keys).agg(F.min("block").alias("block")).filter("block IS NOT NULL")


def align(left: DataFrame, right: DataFrame, pos: str = "pos", id_col: str = "id", block: int = BLOCK, keys: Sequence[str] = ()) -> DataFrame:
    """``left`` and ``right`` side by side by position (``right`` without its id).  Stops with the first differing block if the
    two do not list the same ids in the same order."""
    differing = first_difference(certificate(left, pos, id_col, block, keys), certificate(right, pos, id_col, block, keys), keys)
    # one row: the first by key and block
    found = differing.orderBy(*keys, "block").limit(1).collect()
    if found:
        where = ", ".join(f"{k} {found[0][k]}" for k in keys)
        raise ValueError(f"tables differ in block {found[0]['block']} of {block} positions" + (f" of {where}" if where else ""))
    return left.join(right.drop(id_col), [*keys, pos])


def positions(rows: DataFrame, order: Sequence, keys: Sequence[str] = (), pos: str = "pos") -> DataFrame:
    """``rows`` with their position in the given order, from the distributed exact index."""
    return ordered_index(rows, list(keys), order, out=pos)
