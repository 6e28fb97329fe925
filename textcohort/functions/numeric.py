"""Guarded numeric column expressions.

ANSI mode is on: ``x / 0`` raises.  The workflow's convention is NaN for undefined values
(constant predictions, an empty class), so every division goes through ``safe_div``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(float("nan")).cast("double")


def safe_div(num: Column, den: Column) -> Column:
    """``num / den`` or NaN when ``den`` is zero or null (never an ANSI error)."""
    return F.when(den.isNotNull() & (den != 0), num.cast("double") / den).otherwise(nan())


def sigmoid(logit: Column) -> Column:
    """Class-1 probability of a two-class softmax with logit difference ``logit``."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def minmax_expr(x: Column, lo: Column, hi: Column) -> Column:
    """``(x - lo) / (hi - lo)``; NaN when the range is empty (constant input)."""
    return safe_div(x - lo, hi - lo)


def score_bin(p: Column, digits: int) -> Column:
    """Index of the fixed-width histogram bin centred on ``k / 10**digits``.

    Bins cover ``[-0.5/scale, 1 + 0.5/scale]``; callers test ``isnan`` first because
    ``floor(NaN)`` is 0 in Spark.
    """
    scale = 10 ** digits
    return F.floor(p * F.lit(float(scale)) + F.lit(0.5)).cast("long")
