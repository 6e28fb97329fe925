"""Pluggable batch scorer: any Python callable from texts to class-1 probabilities.

The scorer is built once per task (``mapInPandas`` hands each task an iterator of Arrow
batches), so a model is loaded once per partition, not once per row.  Spark partitions and
shuffles the work; the callable only sees one batch of texts at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

ScorerFactory = Callable[[], Callable[[pd.DataFrame], pd.Series]]


def ship_by_value(module: str = __name__) -> None:
    """Pickle a module's functions by value, so Python workers need no copy of the package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module])


def score_with(df: DataFrame, factory: ScorerFactory, out: str = "prob") -> DataFrame:
    """Add column ``out`` computed by ``factory()(batch)`` for every Arrow batch of ``df``."""
    ship_by_value()
    schema = StructType(list(df.schema.fields) + [StructField(out, DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for b in batches:
            b = b.copy()
            b[out] = scorer(b).astype("float64").values
            yield b

    return df.mapInPandas(run, schema)


def nb_inputs(rows: DataFrame, counts: DataFrame, weights: DataFrame, priors: DataFrame, fold_col: str = "fold") -> DataFrame:
    """``rows`` with what a linear scorer needs, joined by Spark: ``prior``, ``n_tok`` and the arrays ``tf`` and
    ``w`` of the text's tokens that the fold's model knows.  An array is bounded by one text."""
    from textcohort.operators.model import keyed
    from textcohort.operators.text import unfold

    known = (unfold(*keyed(rows, counts, fold_col)).select(fold_col, "id", "token", "tf", "n_tok")
                 .join(weights.select(fold_col, "token", "w"), [fold_col, "token"])
                 .groupBy(fold_col, "id")
                 .agg(F.first("n_tok").alias("n_tok"), F.collect_list(F.struct("tf", "w")).alias("_t")))
    known = known.select(fold_col, "id", "n_tok", F.col("_t.tf").alias("tf"), F.col("_t.w").alias("w"))
    return rows.drop("n_tok", "terms", "places").join(known, [fold_col, "id"], "left").join(priors.select(fold_col, "prior"), fold_col)


def nb_scorer_factory() -> ScorerFactory:
    """A scorer over the columns of ``nb_inputs``: one NumPy sum per batch, no file and no vocabulary in the
    worker.  It equals the join-based scorer."""

    def factory():
        import numpy as np

        def score(batch: pd.DataFrame) -> pd.Series:
            filled = batch["w"].notna().to_numpy()
            lens = np.array([len(w) if ok else 0 for w, ok in zip(batch["w"], filled)], dtype=np.int64)
            w = np.concatenate([*batch["w"][filled], np.zeros(0)]).astype(np.float64)
            tf = np.concatenate([*batch["tf"][filled], np.zeros(0)]).astype(np.float64)
            ends = np.concatenate(([0.0], np.cumsum(w * tf)))
            at = np.concatenate(([0], np.cumsum(lens)))
            n = batch["n_tok"].fillna(1).to_numpy(dtype=np.float64)
            logit = batch["prior"].to_numpy(dtype=np.float64) + (ends[at[1:]] - ends[at[:-1]]) / n
            return pd.Series(1.0 / (1.0 + np.exp(-logit)))

        return score

    return factory


__all__ = ["ship_by_value", "score_with", "nb_inputs", "nb_scorer_factory"]
