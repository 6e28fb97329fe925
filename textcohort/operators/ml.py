"""Alternative classifier: hashed token counts (Spark ML's HashingTF) and one logistic regression per fold.

A text's features are computed and stored once, with its place in every fold, whatever the number of folds.  The fits of all folds share
their passes.  What a fit knows (point, gradient, pairs of the optimiser) is a row per fold of a written table, at most ``num_features`` numbers
to a vector, a parameter.  A pass is one Spark job: as many tasks as there are cores read the blocks of train texts, meet the coefficients of
all folds once and add up loss and gradient of every fold in NumPy, a packed row per task and fold is shuffled, and the fold's task sums them,
takes the optimiser's step and writes the next row.  So what reaches the driver in a pass is a row per fold with few numbers, however many
rows, tasks or slots in use there are, and once per fold the model.
The model of fold f minimises, as Spark ML's ``LogisticRegression`` does,

    sum_i m_i * logloss(y_i, sigmoid(b + w x_i)) / sum_i m_i + reg / 2 * sum_j (w_j * sd_j)^2

with ``sd_j`` the weighted standard deviation of slot j in the fold's train rows; a slot that does not vary has no coefficient, and a
fold whose labels are all equal has none but an infinite intercept.

``num_features`` hash slots: two tokens may share a slot, the more often the larger the vocabulary is
against the slots, so the number should exceed the vocabulary several times.  ``max_iter`` bounds the
optimiser; ``lr_summary`` reports whether a fit ended before the bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import HashingTF
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textcohort.operators.optimise import BLOCK, WAIT, _direction, _lists
from textcohort.operators.scorer import ship_by_value
from textcohort.session import scratch_path
from textcohort.sources.io import materialize

NUM_FEATURES, REG, MAX_ITER, TOL = 1 << 18, 0.01, 200, 1e-6
#: Most features in a block of train texts, blocks in a row group of their table, and pairs that the optimiser remembers.
FEATURES, GROUP, MEMORY = 1 << 20, 4, 8
#: A block of train texts as packed numbers: of every text the label and the weight in each fold, of every fold the squared weights' sum, and the
#: features slot by slot: the block's slots and their numbers of features, then of every feature its text and value.  ``kinds``: the types of the last four.
BLOCKS = "kinds string, label binary, mult binary, squares binary, slot binary, n binary, text binary, x binary"
#: A fold's fit between two passes.  ``w``: the coefficients of all slots and the intercept at the next trial, or of the model once the fit has
#: ended.  ``used``: the slots that vary; ``mean`` and ``scale`` (one by the deviation) are theirs.  ``u`` and ``g``: point and gradient for centred and
#: scaled slots, the intercept last; ``s`` and ``y``: the pairs, the oldest first.  All are packed numbers, in single precision but for ``u`` and ``g``: a
#: trial is the point that ``w`` names as it is stored.
STATE = ("fold int, moves boolean, moved int, mass double, loss double, bound double, step double, losses array<double>, "
         "used binary, mean binary, scale binary, u binary, g binary, s binary, y binary, w binary")
#: How the passes run: a job each, without query stages, whose shuffle files go when it has ended; a file to a partition, a row at a time to a task.
PASS = {"spark.sql.adaptive.enabled": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.files.maxPartitionBytes": "128m", "spark.sql.files.openCostInBytes": "128m", "spark.sql.execution.arrow.maxRecordsPerBatch": "1"}


@dataclass
class FoldModel:
    """One fold's regression: a coefficient for each slot, the intercept, and the optimiser's steps."""
    coefficients: np.ndarray
    intercept: float
    iterations: int


def hashed_features(tokens: DataFrame, num_features: int = NUM_FEATURES) -> DataFrame:
    """``(id, features)`` from ``(id, tokens)``: written once, read by every fold's fit and scoring."""
    hashed = HashingTF(inputCol="tokens", outputCol="features", numFeatures=num_features).transform(tokens)
    return materialize(hashed.select("id", "features"), "lr-features")


def fold_rows(rows: DataFrame, features: DataFrame, name: str, nested: bool = False) -> DataFrame:
    """``rows`` (``fold, id, label`` and more) with their features, stored by fold: a fold's job prunes to
    its own partition.  With ``nested`` a text is one row ``(id, label, folds, features)``: its rows are an array, as many as there are folds,
    so its features are stored once and not once per fold."""
    if not nested:
        return materialize(rows.join(features, "id"), name, partition_by=["fold"])
    others = [c for c in rows.columns if c not in ("id", "label")]
    return materialize(rows.groupBy("id", "label").agg(F.collect_list(F.struct(*others)).alias("folds")).join(features, "id"), name)


def _nested(rows: DataFrame) -> DataFrame:
    """Rows with a ``fold`` of their own in the nested shape of ``fold_rows``."""
    if "folds" in rows.columns:
        return rows
    others = [c for c in rows.columns if c not in ("id", "label", "features")]
    return rows.select(*(c for c in rows.columns if c not in others), F.array(F.struct(*others)).alias("folds"))


def _flat(rows: DataFrame) -> DataFrame:
    """``(fold, id, label)`` and more, without the features."""
    return rows.select("id", "label", F.inline("folds")) if "folds" in rows.columns else rows.drop("features")


def _ship() -> None:
    for module in (__name__, _lists.__module__):
        ship_by_value(module)


def _blocks(batch: pa.RecordBatch, most: int = BLOCK) -> Iterator[tuple]:
    """``(start, stop, slots, values, offsets)`` of runs of rows with at most ``most`` features."""
    vectors = batch.column("features")
    slots, at = _lists(pc.struct_field(vectors, "indices"))
    values, _ = _lists(pc.struct_field(vectors, "values"))
    start = 0
    while start < len(vectors):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
        yield start, stop, slots[at[start]:at[stop]], values[at[start]:at[stop]], at[start:stop + 1] - at[start]
        start = stop


def _places(batch: pa.RecordBatch, folds: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every pair of a text and one of its folds: the text's number, the fold's place in ``folds`` (-1: not there), and the pairs before each text."""
    own = batch.column("folds")
    at = own.offsets.to_numpy(zero_copy_only=False)
    numbers, order = own.flatten().field("fold").to_numpy(zero_copy_only=False), np.argsort(folds)
    near = order[np.minimum(np.searchsorted(folds, numbers, sorter=order), len(folds) - 1)]
    return np.repeat(np.arange(len(own)), np.diff(at)), np.where(np.array(folds)[near] == numbers, near, -1), at - at[0]


def _margins(own: np.ndarray, slots: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``b + w x`` of each row; the last of ``own`` is the intercept."""
    z, full = np.zeros(len(at) - 1), np.flatnonzero(np.diff(at))
    if len(full):
        z[full] = np.add.reduceat(own[slots] * values, at[:-1][full])
    return z + own[-1]


def _numbers(packed: pa.Scalar, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(packed.as_buffer(), kind)


def _least(numbers: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest type that holds them all."""
    with np.errstate(invalid="ignore", over="ignore"):
        for kind in (np.uint8, np.uint16, np.int32, np.float32):
            if np.array_equal(numbers, less := numbers.astype(kind)):
                return less
    return numbers


def _packed(data: DataFrame, folds: list[int]) -> str:
    """The path of ``BLOCKS`` of the train texts.  Written once, read by every pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, place, at = _places(batch, folds)
            if len(text) == len(at) - 1 and (np.diff(place) < 0).any():
                # a fold to a text: those of a fold side by side, so that few folds meet in a block
                batch = batch.take(pa.array(np.argsort(place, kind="stable")))
                text, place, at = _places(batch, folds)
            m = batch.column("folds").flatten().field("mult").to_numpy(zero_copy_only=False)
            y, weight = batch.column("label").to_numpy(zero_copy_only=False), np.zeros((batch.num_rows, len(folds)))
            np.add.at(weight, (text[place >= 0], place[place >= 0]), m[place >= 0])
            for start, stop, s, x, ends in _blocks(batch, FEATURES):
                pairs = slice(at[start], at[stop])
                squares = np.bincount(place[pairs] + 1, m[pairs] ** 2, len(folds) + 1)[1:]
                order = np.argsort(s, kind="stable")
                slot, n = np.unique(s, return_counts=True)
                of = np.repeat(np.arange(stop - start), np.diff(ends))
                features = [_least(v) for v in (slot, n, of[order], x[order])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["".join(v.dtype.char for v in features)]), *(pa.array([v.tobytes()], pa.binary()) for v in (y[start:stop], weight[start:stop], squares, *features))],
                    [c.split()[0] for c in BLOCKS.split(", ")])

    _ship()
    path = scratch_path(data.sparkSession, "lr-blocks")
    # a row is some MB: the writer would look at the size of a row group after a hundred of them
    data.mapInArrow(run, BLOCKS).write.option("parquet.block.row.count.limit", GROUP).parquet(path)
    return path


def _each(batch: pa.RecordBatch, folds: int) -> Iterator[tuple]:
    """Of every block the labels, the weights (a column per fold), the squared weights, the slots, their numbers of features and the first of them,
    the features' texts and values."""
    for i in range(batch.num_rows):
        y, m, squares = (_numbers(batch.column(c)[i]) for c in ("label", "mult", "squares"))
        kinds = zip(("slot", "n", "text", "x"), batch.column("kinds")[i].as_py(), (np.intp, np.intp, np.intp, np.float64), strict=True)
        slot, n, text, x = (_numbers(batch.column(c)[i], stored).astype(kind) for c, stored, kind in kinds)
        yield y, np.ascontiguousarray(m.reshape(-1, folds).T), squares, slot, n, np.cumsum(n) - n, text, x


def _some(*sums: np.ndarray) -> list[bytes]:
    """The places of the numbers that are not 0 and those numbers, or no places and all numbers where that is shorter."""
    some = np.flatnonzero(np.any(sums, axis=0))
    if 3 * len(some) > 2 * len(sums[0]):
        return [b"", *(v.tobytes() for v in sums)]
    return [some.astype(np.int32).tobytes(), *(v[some].tobytes() for v in sums)]


def _total(rows: pa.Table, column: str, size: int) -> np.ndarray:
    """The sum of what ``_some`` packed."""
    total = np.zeros(size)
    for slot, sums in zip(rows["slot"], rows[column], strict=True):
        some, own = _numbers(slot, np.int32), _numbers(sums)
        if len(some):
            total[some] += own
        elif len(own):
            total += own
    return total


def _plain(u: np.ndarray, used: np.ndarray, mean: np.ndarray, scale: np.ndarray, slots: int) -> np.ndarray:
    """Coefficients of the slots as they are, and the intercept, from those of centred and scaled slots."""
    w, own = np.zeros(slots + 1, np.float32), u[:-1] * scale
    w[used], w[-1] = own, u[-1] - (own * mean).sum()
    return w


def _scaled(w: np.ndarray, used: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The reverse of ``_plain``."""
    own = w[used].astype(float)
    return np.append(own / scale, w[-1] + (own * mean).sum())


def _state(**values) -> pa.Table:
    """One row of ``STATE``."""
    plain = {"fold": pa.int32(), "moves": pa.bool_(), "moved": pa.int32(), "losses": pa.list_(pa.float64())}
    columns = {}
    for name, v in values.items():
        packed = isinstance(v, np.ndarray)
        columns[name] = pa.array([v.tobytes() if packed else v], pa.binary() if packed else plain.get(name, pa.float64()))
    return pa.table(columns)


def _begin(blocks: DataFrame, folds: list[int], slots: int, parts: int) -> DataFrame:
    """The first ``STATE`` of each fold that has train rows, from the weighted mean and standard deviation of its slots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, others, seen = np.zeros((len(folds), slots)), np.zeros((len(folds), slots)), np.zeros((len(folds), 3)), np.zeros(len(folds), bool)
        for batch in batches:
            for y, m, squares, slot, _, first, text, x in _each(batch, len(folds)):
                for j in np.flatnonzero(squares):
                    seen[j] = True
                    others[j] += m[j].sum(), squares[j], (m[j] * np.where(m[j] != 0, y, 0)).sum()
                    if len(slot):
                        mx = m[j].take(text) * x
                        a[j, slot] += np.add.reduceat(mx, first)
                        b[j, slot] += np.add.reduceat(mx * x, first)
        for j in np.flatnonzero(seen):
            yield pa.RecordBatch.from_arrays([pa.array([folds[j]], pa.int32()), *(pa.array([v], pa.binary()) for v in _some(a[j], b[j])),
                                              *(pa.array([v]) for v in others[j])], ["fold", "slot", "a", "b", "mass", "mass_2", "positive"])

    def begin(rows: pa.Table) -> pa.Table:
        a, b = (_total(rows, c, slots) for c in "ab")
        mass, mass_2, positive = (float(rows[c].to_numpy().sum()) for c in ("mass", "mass_2", "positive"))
        free = mass - mass_2 / mass if mass > 0 else 0.0
        spread = b - a * a / mass if mass > 0 else np.zeros(len(b))
        # what rounding leaves of a slot that does not vary is no spread
        used = np.flatnonzero((spread > 1e-12 * b) & (free > 0)).astype(np.int32)
        mixed = 0 < positive < mass
        mean, scale = ((a[used] / mass).astype(np.float32), (1 / np.sqrt(spread[used] / free)).astype(np.float32)) if len(used) else (np.zeros(0, np.float32),) * 2
        u, none = np.zeros(len(used) + 1), np.zeros(0)
        if mixed:
            u[-1] = np.log(positive / (mass - positive))
            w = _plain(u, used, mean.astype(float), scale.astype(float), slots)
        else:
            # equal labels: nothing to be fitted
            w = np.append(np.zeros(slots), np.inf if positive > 0 else -np.inf).astype(np.float32)
        return _state(fold=rows["fold"][0].as_py(), moves=mixed, moved=-1 if mixed else 0, mass=mass, loss=0.0, bound=0.0, step=0.0, losses=[],
                      used=used, mean=mean, scale=scale, u=u, g=none, s=none, y=none, w=w)

    _ship()
    sums = blocks.mapInArrow(run, "fold int, slot binary, a binary, b binary, mass double, mass_2 double, positive double")
    # a fold has a row per task
    return sums.repartition(parts, "fold").groupBy("fold").applyInArrow(begin, STATE)


def _parts(spark: SparkSession, folds: list[int]) -> int:
    """The least number of partitions in which rows dealt by ``fold`` lie a fold to a partition."""
    dealt = [r[0] for r in spark.createDataFrame(pa.table({"fold": pa.array(folds, pa.int32())})).select(F.hash("fold")).collect()]
    return next(n for n in range(len(folds), 1 << 31) if len({h % n for h in dealt}) == len(set(dealt)))


def _gradients(blocks: DataFrame, state: DataFrame, folds: list[int], slots: int, parts: int) -> DataFrame:
    """``(fold, sums)``, a row per fold that moves: the sums of its loss's gradient by slot, for the intercept, and of the loss."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point, sums, first = {}, {}, []

        def add(batch: pa.RecordBatch) -> None:
            for y, m, squares, slot, n, start, text, x in _each(batch, len(folds)):
                for f, own in point.items():
                    j = folds.index(f)
                    if squares[j] == 0:
                        continue
                    z, here = np.bincount(text, np.repeat(own[slot], n) * x, len(y)) + own[-1], m[j] != 0
                    with np.errstate(over="ignore"):
                        rest = np.where(here, (1 / (1 + np.exp(-z)) - y) * m[j], 0.0)
                    total = sums.setdefault(f, np.zeros(slots + 2))
                    if len(slot):
                        total[slot] += np.add.reduceat(rest.take(text) * x, start)
                    total[slots:] += rest.sum(), np.where(here, m[j] * (np.logaddexp(0, z) - y * z), 0.0).sum()

        # the coefficients of every fold come beside a task's first block, which waits for the last of them
        for batch in batches:
            for i, f in enumerate(batch.column("fold").to_pylist()):
                row = batch.slice(i, 1)
                if f is not None:
                    point[f] = _numbers(row.column("w")[0], np.float32).astype(float)
                    first += [row] if row.column("x")[0].is_valid else []
                else:
                    while first:
                        add(first.pop())
                    add(row)
        while first:
            add(first.pop())
        for f, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), *(pa.array([v], pa.binary()) for v in _some(own))], ["fold", "slot", "sums"])

    def total(rows: pa.Table) -> pa.Table:
        return pa.table({"fold": rows["fold"][:1], "sums": pa.array([_total(rows, "sums", slots + 2).tobytes()], pa.binary())})

    _ship()
    # every task reads the few rows of coefficients from their table: no broadcast, which the driver would have to hold
    place = "monotonically_increasing_id() & ((1L << 33) - 1)"
    points = state.filter("moves").select("fold", "w").coalesce(1).selectExpr("*", f"{place} AS point").hint("shuffle_replicate_nl")
    few = blocks.coalesce(blocks.sparkSession.sparkContext.defaultParallelism).selectExpr("*", f"{place} AS block")
    met = few.join(points, F.expr("block = 0 OR point = 0")).selectExpr(
        *(f"IF(block = 0, {c}, NULL) AS {c}" for c in ("fold", "w")), *(f"IF(point = 0, {c}, NULL) AS {c}" for c in blocks.columns))
    sums = met.mapInArrow(run, "fold int, slot binary, sums binary")
    # a fold has a row per task
    return sums.repartition(parts, "fold").groupBy("fold").applyInArrow(total, "fold int, sums binary")


def _advance(state: DataFrame, gradients: DataFrame, slots: int, reg: float, max_iter: int, tol: float) -> DataFrame:
    """The next ``STATE`` of the folds that move: the trial is accepted or a shorter step is tried, as in ``optimise.lbfgs``, where its loss
    says."""
    def advance(batch: pa.RecordBatch, i: int) -> pa.Table:
        row = {name: batch.column(name)[i] for name in batch.schema.names}
        used, sums = _numbers(row["used"], np.int32), _numbers(row["sums"])
        mean, scale = (_numbers(row[c], np.float32).astype(float) for c in ("mean", "scale"))
        u, g, bias = _numbers(row["u"]), _numbers(row["g"]), float(sums[-2])
        s, y = (_numbers(row[c], np.float32).reshape(-1, len(u), 1).astype(float) for c in "sy")
        pairs = list(zip(s, y, strict=True))
        mass, loss, bound, step = (row[c].as_py() for c in ("mass", "loss", "bound", "step"))
        moved, losses, trial = row["moved"].as_py() + 1, row["losses"].as_py(), _scaled(_numbers(row["w"], np.float32), used, mean, scale)
        then = np.append(scale * (sums[used] - mean * bias), bias) / mass + reg * np.append(trial[:-1], 0.0)
        there = float(sums[-1]) / mass + reg / 2 * float((trial[:-1] ** 2).sum())
        d = _direction(g[:, None], pairs)[:, 0] if moved else None
        slope = float(g @ d) if moved else 0.0
        if moved == 0:
            u, g, d, loss, bound, step = trial, then, -then, there, tol * abs(there), 1.0
        elif there <= loss + 1e-4 * step * slope + 1e-14 * abs(loss):
            pairs = [*pairs, ((trial - u)[:, None], (then - g)[:, None])][-MEMORY:]
            u, g, loss, step = trial, then, there, 1.0
            d = _direction(g[:, None], pairs)[:, 0]
        else:
            # the least of the parabola through both losses and the slope, between a tenth and a half of the step
            step *= min(0.5, max(0.1, -slope * step / (2 * (there - loss - slope * step))))
        losses = [*losses[-WAIT:], loss]
        moves = moved < max_iter and float(np.sqrt(g @ g)) > bound and (len(losses) <= WAIT or losses[-WAIT - 1] - loss > bound)
        s, y = (np.array([v[i] for v in pairs], np.float32) for i in range(2))
        return _state(fold=row["fold"].as_py(), moves=moves, moved=moved, mass=mass, loss=loss, bound=bound, step=step, losses=losses, used=used,
                      mean=mean.astype(np.float32), scale=scale.astype(np.float32), u=u, g=g, s=s, y=y, w=_plain(u + step * d * moves, used, mean, scale, slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from advance(batch, i).to_batches()

    _ship()
    # the states stay where they are read, a fold to a task, and the few rows of sums come to them
    return state.filter("moves").join(gradients.repartition(1).hint("shuffle_replicate_nl"), "fold").mapInArrow(run, STATE)


def _written(df: DataFrame, schema: str, path: str) -> DataFrame:
    # packed numbers neither repeat nor compress
    df.write.mode("overwrite").option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def lr_fit(train: DataFrame, folds: list[int], reg: float = REG, max_iter: int = MAX_ITER, tol: float = TOL) -> dict[int, FoldModel]:
    """``train``: ``(fold, id, label, features)`` with oversampled copies as rows, or with a ``mult``
    column (copies as an instance weight — the same weighted likelihood), or the same rows nested by ``fold_rows``.

    The optimiser works on centred and scaled slots (``u = w * sd``), which changes neither the optimum nor what the tasks do.  A fold's
    fit ends when ten passes have lessened its loss by no more than ``tol`` times the loss it began with, or its gradient's norm is no more
    than that."""
    data, spark = _nested(train), train.sparkSession
    has_mult = "mult" in data.schema["folds"].dataType.elementType.names
    own = F.transform("folds", lambda x: F.struct(x["fold"].cast("int").alias("fold"), (x["mult"].cast("double") if has_mult else F.lit(1.0)).alias("mult")))
    data = data.select(F.col("label").cast("double").alias("label"), F.filter(own, lambda x: x["fold"].isin(folds)).alias("folds"), "features").filter(F.size("folds") > 0)
    first = data.select("features").first()
    if first is None:
        raise ValueError(f"folds without train rows: {folds}")
    slots, passes, models = first["features"].size, spark.newSession(), {}
    for name, value in PASS.items():
        passes.conf.set(name, value)
    blocks = passes.read.schema(BLOCKS).parquet(_packed(data, folds))
    # the states of a pass replace those of the pass before the last
    paths, parts = [scratch_path(spark, "lr-state") for _ in range(2)], _parts(spark, folds)
    state = _written(_begin(blocks, folds, slots, parts), STATE, paths[0])
    known = state.select("fold", "moves", "mass").toArrow().to_pylist()
    if empty := sorted(set(folds) - {r["fold"] for r in known if r["mass"] > 0}):
        raise ValueError(f"folds without train rows: {empty}")
    while True:
        if ended := [r["fold"] for r in known if not r["moves"]]:
            for r in state.filter(F.col("fold").isin(ended)).select("fold", "w", "moved").collect():
                w = np.frombuffer(r["w"], np.float32).astype(float)
                models[r["fold"]] = FoldModel(w[:-1], float(w[-1]), r["moved"])
        if len(ended) == len(known):
            return {f: models[f] for f in folds}
        state = _written(_advance(state, _gradients(blocks, state, folds, slots, parts), slots, reg, max_iter, tol), STATE, paths[1])
        paths.reverse()
        known = state.select("fold", "moves").toArrow().to_pylist()


def lr_score(models: dict[int, FoldModel], rows: DataFrame) -> DataFrame:
    """``rows``: ``(fold, id, label, features)`` or those of ``fold_rows`` -> ``(fold, id, label, prob)``."""
    folds = list(models)
    shared = rows.sparkSession.sparkContext.broadcast(np.vstack([np.append(m.coefficients, m.intercept) for m in models.values()]))
    _ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, place, at = _places(batch, folds)
            z = np.zeros(len(text))
            for start, stop, s, x, ends in _blocks(batch):
                own = place[at[start]:at[stop]]
                for j in np.unique(own):
                    pairs = at[start] + np.flatnonzero(own == j)
                    z[pairs] = _margins(shared.value[j], s, x, ends)[text[pairs] - start]
            with np.errstate(over="ignore"):
                prob = pa.array(1 / (1 + np.exp(-z)))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(folds, np.int32)[place]), *(batch.column(c).take(pa.array(text)) for c in ("id", "label")), prob],
                                             ["fold", "id", "label", "prob"])

    wanted = F.filter(F.transform("folds", lambda x: F.struct(x["fold"].cast("int").alias("fold"))), lambda x: x["fold"].isin(folds)).alias("folds")
    own = _nested(rows).select("id", F.col("label").cast("int").alias("label"), wanted, "features").filter(F.size("folds") > 0)
    return own.mapInArrow(run, f"fold int, id {dict(own.dtypes)['id']}, label int, prob double")


def lr_residual(models: dict[int, FoldModel], train: DataFrame) -> DataFrame:
    """``(fold, residual)``: the absolute weighted mean of ``prob - label`` over a fold's train rows.  The
    intercept has no penalty, so this is its partial derivative and 0 at the optimum."""
    scored = lr_score(models, train).select("fold", "id", "prob")
    rows = _flat(train).select(F.col("fold").cast("int").alias("fold"), "id", "label", "mult").join(scored, ["fold", "id"])
    return rows.groupBy("fold").agg(F.abs(F.sum(F.col("mult") * (F.col("prob") - F.col("label"))) / F.sum("mult")).alias("residual"))


def lr_summary(models: dict[int, FoldModel], max_iter: int = MAX_ITER) -> list[tuple[int, bool]]:
    """``(fold, converged)``: whether the optimiser stopped by itself before its bound on iterations."""
    return [(int(f), bool(m.iterations < max_iter)) for f, m in models.items()]


def save_models(models: dict[int, FoldModel], base: str) -> dict[int, str]:
    """One Parquet folder per fold: ``(slot, w, slots, iterations)`` of the coefficients that are not 0, and slot -1, the intercept."""
    spark, paths = SparkSession.active(), {}
    for f, m in models.items():
        paths[f] = f"{base.rstrip('/')}/fold={f}"
        some = np.flatnonzero(m.coefficients)
        n = len(some) + 1
        table = pa.table({"slot": pa.array(np.append(some, -1), pa.int32()), "w": pa.array(np.append(m.coefficients[some], m.intercept)),
                          "slots": pa.array(np.full(n, len(m.coefficients)), pa.int32()), "iterations": pa.array(np.full(n, m.iterations), pa.int32())})
        spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(paths[f])
    return paths


def load_models(paths: dict[int, str]) -> dict[int, FoldModel]:
    """The models that ``save_models`` wrote: at most ``num_features`` rows per fold, a parameter."""
    spark, models = SparkSession.active(), {}
    for f, path in paths.items():
        stored = spark.read.parquet(path)
        shape = stored.filter("slot = -1").first()
        rows = stored.filter("slot >= 0").select("slot", "w").toArrow()
        w = np.zeros(shape.slots)
        w[rows["slot"].to_numpy()] = rows["w"].to_numpy()
        models[f] = FoldModel(w, shape.w, shape.iterations)
    return models
