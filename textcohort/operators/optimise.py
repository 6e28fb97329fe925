"""Logistic regression of all folds at once: one distributed pass per evaluation, whatever the number of folds.

A text has its tokens hashed to ``slots`` (the leading digits of an md5, so any engine can compute them) with relative
frequencies ``tf / n_tok``, its label, and its place in every fold: how many copies the fold's train split has of it, and whether
it is in the fold's validation split.  The model of fold f minimises

    sum_i m_if * logloss(y_i, sigmoid(b_f + w_f x_i)) / sum_i m_if + reg / 2 * |w_f|^2

A pass broadcasts the weights of all folds (``slots * folds`` numbers, both parameters), every task computes the
margins of its texts in blocks of bounded size and adds up its part of the gradient in NumPy, and Spark sums the parts by slot
(at most ``slots`` rows reach the driver, which holds the weights).  The same pass gives loss and validation sums, so an epoch is
one pass.  Two optimisers use it: ``descend`` (fixed steps, a trace with the validation Pearson of every epoch and the choice of
the best state) and ``minimise`` (limited-memory BFGS with its own line search per fold).

A fold without train rows keeps its weights at 0.  A text without tokens has only the intercept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textcohort.operators.scorer import ship_by_value
from textcohort.sources.io import materialize

SLOTS, REG = 1 << 16, 0.01
#: Non-zero features, or tokens of texts to be scored, that a task handles at a time.
BLOCK = 1 << 16
#: Passes over which a relative gain is judged.
WAIT = 10
#: Rows of a pass that are not slots.
BIAS, LOSS, MASS, N, SUM_P, SUM_PP, SUM_Y, SUM_PY = range(-1, -9, -1)


def slot_of(token: Column, slots: int = SLOTS) -> Column:
    """The slot of a token: the first 15 hex digits of its md5, modulo ``slots``."""
    return F.pmod(F.conv(F.substring(F.md5(token.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def fold_features(texts: DataFrame, folds: list[int], slots: int = SLOTS) -> DataFrame:
    """``(id, y, at, x, m, v)`` of the texts table (``workflow.text_table``), written once and read by every pass: slots, relative
    frequencies, copies in each fold's train split, and 1 where the text is in a fold's validation split."""
    def place(f: int) -> Column:
        return F.get(F.filter("folds", lambda x: x["fold"] == f), 0)

    terms = F.coalesce("terms", F.array().cast("array<struct<token:string,tf:bigint>>"))
    return materialize(texts.select(
        "id", F.col("label").cast("double").alias("y"), F.transform(terms, lambda t: slot_of(t["token"], slots)).alias("at"),
        F.transform(terms, lambda t: t["tf"] / F.col("n_tok")).alias("x"),
        F.array(*[F.coalesce(F.when(place(f)["split"] == "train", place(f)["mult"]), F.lit(0)).cast("double") for f in folds]).alias("m"),
        F.array(*[F.when(place(f)["split"] == "vali", 1.0).otherwise(0.0) for f in folds]).alias("v")), "fold-features")


@dataclass
class Pass:
    """What one pass over the texts gives, per fold."""
    loss: np.ndarray        # with the penalty
    grad: np.ndarray        # slots + 1 rows (the last: intercepts), one column per fold
    pearson: np.ndarray     # of the probability and the label over the validation split; NaN where undefined


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = column.flatten().to_numpy(zero_copy_only=False)
    at = column.offsets.to_numpy(zero_copy_only=False)
    return values, at - at[0]


def evaluate(data: DataFrame, w: np.ndarray, reg: float = REG) -> Pass:
    """Loss, gradient and validation sums of all folds at weights ``w`` (``slots + 1`` rows, the last one the intercepts)."""
    spark, (rows, k) = data.sparkSession, w.shape
    shared = spark.sparkContext.broadcast(w)
    ship_by_value(__name__)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        grad, extra = np.zeros((rows, k)), np.zeros((9, k))
        for batch in batches:
            slot, at = _lists(batch.column("at"))
            x, _ = _lists(batch.column("x"))
            y = batch.column("y").to_numpy()
            m, v = (_lists(batch.column(c))[0].reshape(-1, k) for c in "mv")
            start = 0
            while start < len(y):
                stop = max(start + 1, int(np.searchsorted(at, at[start] + BLOCK, side="right")) - 1)
                s, value = slot[at[start]:at[stop]], x[at[start]:at[stop], None]
                text = np.repeat(np.arange(stop - start), np.diff(at[start:stop + 1]))
                z = np.zeros((stop - start, k))
                full = np.flatnonzero(np.diff(at[start:stop + 1]))
                if len(full):
                    z[full] = np.add.reduceat(own[s] * value, (at[start:stop] - at[start])[full])
                z += own[-1]
                p, label = 1 / (1 + np.exp(-z)), y[start:stop, None]
                weight, seen = m[start:stop], v[start:stop]
                rest = (p - label) * weight
                for f in range(k):
                    grad[:-1, f] += np.bincount(s, value[:, 0] * rest[text, f], rows - 1)
                grad[-1] += rest.sum(0)
                extra[-LOSS] += (weight * (np.logaddexp(0, z) - label * z)).sum(0)
                for name, value_of in ((MASS, weight), (N, seen), (SUM_P, seen * p), (SUM_PP, seen * p * p), (SUM_Y, seen * label), (SUM_PY, seen * p * label)):
                    extra[-name] += value_of.sum(0)
                start = stop
        some = np.flatnonzero(grad[:-1].any(1))
        names = np.concatenate((some, [BIAS], np.arange(-2, -9, -1)))
        sums = np.concatenate((grad[some], grad[-1:], extra[2:9]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *(pa.array(sums[:, f]) for f in range(k))], ["slot", *(f"g{f}" for f in range(k))])

    parts = data.select("y", "at", "x", "m", "v").mapInArrow(run, "slot int, " + ", ".join(f"g{f} double" for f in range(k)))
    # one row per slot at most, a parameter; as Arrow columns, whatever the session's setting
    total = parts.groupBy("slot").agg(*[F.sum(f"g{f}").alias(f"g{f}") for f in range(k)]).toArrow()
    # unpersist() would leave the weights of every pass in the driver
    shared.destroy()
    sums, names = np.column_stack([total[f"g{f}"].to_numpy() for f in range(k)]), total["slot"].to_numpy()
    named = {n: row for n, row in zip(names.tolist(), sums, strict=True) if n < 0}
    zero = np.zeros(k)
    mass = np.maximum(named.get(MASS, zero), 1e-300)
    grad = np.zeros((rows, k))
    grad[names[names >= 0]] = sums[names >= 0]
    grad[-1] = named.get(BIAS, zero)
    grad /= mass
    grad[:-1] += reg * w[:-1]
    n, p, pp, y, py = (named.get(name, zero) for name in (N, SUM_P, SUM_PP, SUM_Y, SUM_PY))
    with np.errstate(divide="ignore", invalid="ignore"):
        cov, var_p, var_y = py / n - p * y / n ** 2, pp / n - (p / n) ** 2, y / n - (y / n) ** 2
        pearson = np.where((var_p > 1e-18) & (var_y > 0), cov / np.sqrt(var_p * var_y), np.nan)
    return Pass(named.get(LOSS, zero) / mass + reg / 2 * (w[:-1] ** 2).sum(0), grad, pearson)


@dataclass
class Trace:
    """``rows``: one per (epoch, fold) with loss, validation Pearson, the best so far, and whether the state is the chosen one.
    ``states``: a written table ``(epoch, fold, slot, w)`` of every epoch (slot -1: the intercept)."""
    rows: list[tuple]
    states: list[DataFrame]
    chosen: dict[int, int]


def slot_scorer(w: np.ndarray, folds: list[int], probability: bool = True):
    """A scorer factory (``operators.scorer``) of these models for batches with ``fold``, ``tokens`` and ``n_tok``: a callable that knows
    nothing of Spark.  A token's share is ``1 / n_tok`` each time it occurs."""
    ship_by_value(__name__)

    def factory():
        import hashlib
        from itertools import chain

        slots, column = len(w) - 1, {f: i for i, f in enumerate(folds)}
        known: dict[str, int] = {}
        by_fold = w.T.ravel()

        def slot(token: str) -> int:
            return int(hashlib.md5(token.encode()).hexdigest()[:15], 16) % slots

        def score(batch: pd.DataFrame) -> pd.Series:
            if len(known) >= 1 << 17:
                known.clear()
            lists = batch["tokens"].tolist()
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            own = np.array([column[f] for f in batch["fold"].tolist()], np.int64)
            z, n, ends = w[-1, own], np.maximum(batch["n_tok"].to_numpy(), 1), np.cumsum(size)
            start = 0
            while start < len(lists):
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] - size[start] + BLOCK, side="right")))
                flat = list(chain.from_iterable(lists[start:stop]))
                try:
                    at = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
                except KeyError:
                    known.update((token, slot(token)) for token in set(flat).difference(known))
                    at = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
                long = size[start:stop]
                full = np.flatnonzero(long)
                if len(full):
                    sums = np.add.reduceat(by_fold[np.repeat(own[start:stop] * len(w), long) + at], (np.cumsum(long) - long)[full])
                    z[start + full] += sums / n[start + full]
                start = stop
            return pd.Series(1 / (1 + np.exp(-z)) if probability else z)

        return score

    return factory


def state_table(spark, w: np.ndarray, folds: list[int], epoch: int) -> DataFrame:
    """``(epoch, fold, slot, w)`` of the weights that are not 0, written by tasks that each take a range of slots."""
    shared, bias, numbers = spark.sparkContext.broadcast(w), len(w) - 1, list(folds)
    ship_by_value(__name__)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column("id").to_numpy()
            own = shared.value[slots]
            at, f = np.nonzero(own)
            slot = np.where(slots[at] == bias, -1, slots[at])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), epoch), pa.int32()), pa.array(np.array(numbers)[f], pa.int32()),
                                              pa.array(slot, pa.int32()), pa.array(own[at, f])], ["epoch", "fold", "slot", "w"])

    written = materialize(spark.range(len(w)).mapInArrow(run, "epoch int, fold int, slot int, w double"), "fold-weights")
    shared.destroy()
    return written


def weights_of(states: DataFrame, folds: list[int], slots: int = SLOTS) -> np.ndarray:
    """The weights that ``state_table`` wrote: at most ``(slots + 1) * folds`` numbers, both parameters."""
    rows = states.select("fold", "slot", "w").toArrow()
    w, column = np.zeros((slots + 1, len(folds))), {f: i for i, f in enumerate(folds)}
    # slot -1, the intercept, is the last row
    w[rows["slot"].to_numpy(), [column[f] for f in rows["fold"].to_numpy().tolist()]] = rows["w"].to_numpy()
    return w


def descend(data: DataFrame, folds: list[int], epochs: int = 3, rate: float = 1.0, reg: float = REG, slots: int = SLOTS, patience: int | None = None) -> Trace:
    """Gradient descent with a fixed rate, all texts per step.  After every epoch the state is written and judged on the
    validation split; per fold the first state with the best Pearson is chosen (NaN is the worst).  With ``patience`` a fold
    whose best is so many epochs old moves no further, and the descent ends when no fold moves."""
    spark, w = data.sparkSession, np.zeros((slots + 1, len(folds)))
    now, best = evaluate(data, w, reg), np.full(len(folds), -np.inf)
    since, chosen = np.zeros(len(folds), int), np.zeros(len(folds), int)
    trace, states = [], []
    for epoch in range(1, epochs + 1):
        moves = np.ones(len(folds), bool) if patience is None else since < patience
        if not moves.any():
            break
        w = w - rate * now.grad * moves
        states.append(state_table(spark, w, folds, epoch))
        now = evaluate(data, w, reg)
        score = np.where(np.isnan(now.pearson), -np.inf, now.pearson)
        better = moves & ((score > best) | (chosen == 0))
        best, chosen, since = np.where(better, score, best), np.where(better, epoch, chosen), np.where(better, 0, since + 1)
        trace += [(epoch, f, float(now.loss[i]), float(now.pearson[i]), float(best[i]) if np.isfinite(best[i]) else float("nan")) for i, f in enumerate(folds) if moves[i]]
    of_fold = dict(zip(folds, chosen.tolist(), strict=True))
    return Trace([(*r, r[0] == of_fold[r[1]]) for r in trace], states, of_fold)


def minimise(data: DataFrame, folds: list[int], reg: float = REG, slots: int = SLOTS, tol: float = 1e-6, passes: int = 200, memory: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Weights of all folds and the norm of each fold's gradient, by limited-memory BFGS.  The folds share every pass but have
    their own directions and step lengths; a fold that has converged stands still."""
    w, now, _ = lbfgs(lambda at: evaluate(data, at, reg), np.zeros((slots + 1, len(folds))), tol, passes, memory)
    return w, np.sqrt(_dots(now.grad, now.grad))


def lbfgs(run: Callable[[np.ndarray], Pass], w: np.ndarray, tol: float, passes: int, memory: int = 8, relative: bool = False) -> tuple[np.ndarray, Pass, np.ndarray]:
    """Weights (a column per fold), what ``run`` gives there, and the number of passes in which each fold moved, from the start ``w``.  A fold has
    converged when its gradient's norm is at most ``tol``; with ``relative``, when that or what ``WAIT`` passes took from its loss is at most
    that part of its first loss."""
    now, pairs = run(w), []
    bound, losses = tol * np.abs(now.loss) if relative else tol, [now.loss]
    step, direction, moved = np.ones(w.shape[1]), -now.grad, np.zeros(w.shape[1], int)
    for _ in range(passes):
        norm = np.sqrt(_dots(now.grad, now.grad))
        moves = norm > bound
        if relative and len(losses) > WAIT:
            moves &= losses[-WAIT - 1] - now.loss > bound
        if not moves.any():
            break
        moved += moves
        trial = w + step * direction * moves
        then = run(trial)
        slope = _dots(now.grad, direction)
        good = moves & (then.loss <= now.loss + 1e-4 * step * slope + 1e-14 * np.abs(now.loss))
        # a fold whose step was too long tries a shorter one in the next pass; the others go on
        if good.any():
            pairs = [*pairs[-(memory - 1):], ((trial - w) * good, (then.grad - now.grad) * good)] if memory > 1 else [((trial - w) * good, (then.grad - now.grad) * good)]
        w = np.where(good, trial, w)
        now = Pass(np.where(good, then.loss, now.loss), np.where(good, then.grad, now.grad), then.pearson)
        losses = [*losses[-WAIT:], now.loss]
        fresh = _direction(now.grad, pairs)
        direction = np.where(good, fresh, direction)
        step = np.where(good, 1.0, step / 4)
    return w, now, moved


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Column by column the sum of products, without a matrix of them."""
    return np.einsum("ij,ij->j", a, b)


def _direction(grad: np.ndarray, pairs: list) -> np.ndarray:
    """The two-loop recursion, column by column; pairs without curvature in a column are passed over there."""
    q, kept = grad.copy(), []
    for s, y in reversed(pairs):
        sy = _dots(s, y)
        rho = np.where(sy > 0, 1 / np.where(sy > 0, sy, 1), 0)
        a = rho * _dots(s, q)
        q -= a * y
        kept.append((s, y, rho, a, sy))
    scale = np.ones(grad.shape[1])
    for s, y, _, _, sy in reversed(kept):
        scale = np.where(sy > 0, sy / np.maximum(_dots(y, y), 1e-300), scale)
    q = q * scale
    for s, y, rho, a, _ in reversed(kept):
        q += s * (a - rho * _dots(y, q))
    return -q


def gradient_norms(data: DataFrame, weights: DataFrame, folds: list[int], reg: float = REG) -> DataFrame:
    """``(fold, mass, norm)``: the gradient's norm at stored weights, by joins and aggregations of the written features alone.

    The folds stand side by side in columns: a text's terms meet the weights of all folds once (one row per slot, at most ``slots`` rows
    of ``folds`` numbers, which ``evaluate`` broadcasts too), and what is shuffled is one row per text and one per task and slot.
    The intercept is a term of every text, in slot -1."""
    k = range(len(folds))
    wide = weights.groupBy("slot").agg(*[F.sum(F.when(F.col("fold") == f, F.col("w"))).alias(f"w{i}") for i, f in enumerate(folds)])
    term = F.explode(F.concat(F.arrays_zip("at", "x"), F.array(F.struct(F.lit(-1).alias("at"), F.lit(1.0).alias("x"))))).alias("_t")
    terms = data.select("id", term).select("id", F.col("_t.at").alias("slot"), "_t.x")
    margin = terms.join(F.broadcast(wide), "slot", "left").groupBy(F.col("id").alias("_id")).agg(
        *[F.sum(F.col("x") * F.coalesce(f"w{i}", F.lit(0.0))).alias(f"z{i}") for i in k])
    rest = data.join(margin, F.col("id").eqNullSafe(F.col("_id"))).select(
        "at", "x", *[(F.col("m")[i] * (F.lit(1.0) / (1 + F.exp(-F.col(f"z{i}"))) - F.col("y"))).alias(f"r{i}") for i in k])
    by_slot = rest.select(*[f"r{i}" for i in k], term).groupBy(F.col("_t.at").alias("slot")).agg(
        *[F.sum(F.col("_t.x") * F.col(f"r{i}")).alias(f"g{i}") for i in k])
    mass = data.agg(*[F.sum(F.col("m")[i]).alias(f"mass{i}") for i in k])
    # slots with a weight but no train row have the penalty alone; the intercept has none
    whole = by_slot.join(wide, "slot", "full").crossJoin(F.broadcast(mass))

    def part(i: int) -> Column:
        penalty = F.when(F.col("slot") >= 0, reg * F.coalesce(f"w{i}", F.lit(0.0))).otherwise(0.0)
        return F.when(F.col(f"mass{i}") > 0, F.coalesce(f"g{i}", F.lit(0.0)) / F.col(f"mass{i}")) + penalty

    sums = whole.agg(*[F.sum(part(i) * part(i)).alias(f"q{i}") for i in k], *[F.max(f"mass{i}").alias(f"mass{i}") for i in k])
    each = F.array(*[F.struct(F.lit(f).alias("fold"), F.col(f"mass{i}").alias("mass"), F.sqrt(f"q{i}").alias("norm")) for i, f in enumerate(folds)])
    return sums.select(F.inline(each)).filter("mass > 0")
