"""The all-fold regression against plain NumPy, and the partition tree against brute force."""

import hashlib
import itertools
import math
import os
import random

import numpy as np
import pandas as pd
import pytest

from textcohort.operators import optimise as OP
from textcohort.operators import partition as PA

SLOTS, FOLDS = 32, [0, 3, 5]


def slot(t):
    return int(hashlib.md5(t.encode()).hexdigest()[:15], 16) % SLOTS


@pytest.fixture(scope="module")
def case(spark):
    """Texts with their folds, and the same as dense arrays.  Fold 5 has no train row; text 2 has no tokens."""
    rng = random.Random(4)
    rows, x, y, m, v = [], [], [], [], []
    for i in range(60):
        label = rng.randint(0, 1)
        tokens = [] if i == 2 else rng.choices([f"t{k}" for k in range(12)] + ["plus"] * 4 * label + ["minus"] * 4 * (1 - label), k=rng.randint(1, 9))
        folds = [(f, rng.choice(["train", "train", "vali", "test"]) if f != 5 else "vali", None) for f in FOLDS]
        folds = [(f, s, rng.randint(1, 4) if s == "train" else None) for f, s, _ in folds]
        terms = [(t, tokens.count(t)) for t in dict.fromkeys(tokens)]
        rows.append((i, label, folds, len(tokens) or None, terms or None))
        dense = np.zeros(SLOTS)
        for t, n in terms:
            dense[slot(t)] += n / len(tokens)
        x.append(dense)
        y.append(label)
        m.append([c or 0 for _, _, c in folds])
        v.append([s == "vali" for _, s, _ in folds])
    schema = "id long, label int, folds array<struct<fold:int,split:string,mult:bigint>>, n_tok int, terms array<struct<token:string,tf:bigint>>"
    data = OP.fold_features(spark.createDataFrame(rows, schema).repartition(4), FOLDS, SLOTS)
    return data, np.array(x), np.array(y, float), np.array(m, float), np.array(v, float)


def plain(case, w, reg=OP.REG):
    _, x, y, m, v = case
    loss, grad, pearson = [], np.zeros_like(w), []
    for k in range(w.shape[1]):
        p = 1 / (1 + np.exp(-(x @ w[:-1, k] + w[-1, k])))
        mass = m[:, k].sum() or 1.0
        loss.append(-(m[:, k] * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mass + reg / 2 * (w[:-1, k] ** 2).sum())
        grad[:-1, k] = x.T @ (m[:, k] * (p - y)) / mass + reg * w[:-1, k]
        grad[-1, k] = (m[:, k] * (p - y)).sum() / mass
        on = v[:, k] > 0
        pearson.append(np.corrcoef(p[on], y[on])[0, 1] if p[on].std() > 1e-9 else np.nan)
    return np.array(loss), grad, np.array(pearson)


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_a_pass_equals_plain_numpy(case, block, monkeypatch):
    monkeypatch.setattr(OP, "BLOCK", block)
    w = np.random.default_rng(1).normal(size=(SLOTS + 1, len(FOLDS)))
    got, (loss, grad, pearson) = OP.evaluate(case[0], w), plain(case, w)
    assert np.allclose(got.loss, loss, atol=1e-12) and np.allclose(got.grad, grad, atol=1e-12) and np.allclose(got.pearson, pearson, atol=1e-9, equal_nan=True)


def test_descent_and_choice(spark, case):
    trace = OP.descend(case[0], FOLDS, epochs=4, rate=5.0, slots=SLOTS)
    w = np.zeros((SLOTS + 1, len(FOLDS)))
    for epoch in range(1, 5):
        w = w - 5.0 * plain(case, w)[1]
        loss, _, pearson = plain(case, w)
        for i, f in enumerate(FOLDS):
            row = next(r for r in trace.rows if r[:2] == (epoch, f))
            assert row[2] == pytest.approx(loss[i], abs=1e-12) and (math.isnan(row[3]) and math.isnan(pearson[i]) or row[3] == pytest.approx(pearson[i], abs=1e-9))
        assert np.allclose(OP.weights_of(trace.states[epoch - 1], FOLDS, SLOTS), w, atol=1e-12)
    for f in FOLDS:
        rows = [r for r in trace.rows if r[1] == f]
        best = [r[4] for r in rows]
        assert [r[5] for r in rows].count(True) == 1
        if not math.isnan(best[0]):
            assert best == sorted(best) and next(r for r in rows if r[5])[3] == max(r[3] for r in rows)


def test_patience_ends_a_descent(case):
    trace = OP.descend(case[0], FOLDS, epochs=30, rate=0.0, slots=SLOTS, patience=2)
    assert {r[0] for r in trace.rows} == {1, 2, 3} and set(trace.chosen.values()) == {1}


def test_the_optimum_and_its_independent_check(spark, case):
    w, norms = OP.minimise(case[0], FOLDS, slots=SLOTS)
    assert (norms < 1e-6).all() and np.abs(plain(case, w)[1][:, :2]).max() < 1e-6 and not w[:, 2].any()
    other = w + 0.3
    for weights in (w, other):
        got = {r.fold: r for r in OP.gradient_norms(case[0], OP.state_table(spark, weights, FOLDS, 0), FOLDS).collect()}
        want = np.sqrt((plain(case, weights)[1] ** 2).sum(0))
        assert set(got) == {0, 3}
        for i, f in enumerate(FOLDS[:2]):
            assert got[f].norm == pytest.approx(want[i], abs=1e-9) and got[f].mass == case[3][:, i].sum()


def test_the_driver_keeps_no_weights_of_past_passes(spark, case, monkeypatch):
    kept, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: kept.append(broadcast(self, value)) or kept[-1])
    monkeypatch.setattr(type(spark), "createDataFrame", None)      # weights reach a table through tasks
    w, _ = OP.minimise(case[0], FOLDS, slots=SLOTS, passes=5)
    states = OP.state_table(spark, w, FOLDS, 2)
    assert len(kept) == 7 and not any(os.path.exists(b._path) for b in kept)
    assert np.array_equal(OP.weights_of(states, FOLDS, SLOTS), w) and states.select("epoch").distinct().collect() == [(2,)]
    assert OP.state_table(spark, np.zeros_like(w), FOLDS, 1).isEmpty()


def test_levels():
    assert [PA.levels(n) for n in (2, 3, 4, 11, 12, 44, 171, 172, 500, 684)] == [0, 0, 1, 1, 2, 3, 3, 4, 4, 5]


def shapley(n, f):
    """Exact values by all orders of the players."""
    phi = [0.0] * n
    for order in itertools.permutations(range(n)):
        on = set()
        for i in order:
            phi[i] += (f(on | {i}) - f(on)) / math.factorial(n)
            on.add(i)
    return phi


def owen(n, f):
    """Owen values of the halving tree by averaging over the orders that keep every node's tokens together."""
    def orders(lo, hi):
        if hi - lo == 1:
            return [[lo]]
        mid = (lo + hi) // 2
        return [p for a in orders(lo, mid) for b in orders(mid, hi) for p in (a + b, b + a)]
    phi, every = [0.0] * n, orders(0, n)
    for order in every:
        on = set()
        for i in order:
            phi[i] += (f(on | {i}) - f(on)) / len(every)
            on.add(i)
    return phi


def test_values_equal_brute_force(spark):
    """A scorer with interactions: the tree's values by all orders it allows, and exact Shapley values where they agree."""
    texts = [["a", "b"], ["a", "b", "c"], list("abcab"), list("abcdefgh"), ["a"], [], list("bbbb")]
    worth = {t: k - 2.5 for k, t in enumerate("abcdefgh")}

    def tangled(tokens):
        return sum(map(worth.get, tokens)) + 3.0 * ("a" in tokens and "b" in tokens) + 0.1 * len(tokens) ** 2 + 0.5 * (tokens[:2] == ["b", "c"])

    def linear(tokens):
        return 4.0 + sum(map(worth.get, tokens))

    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "fold int, id long, tokens array<string>")
    for score in (tangled, linear):
        got = {}
        out = PA.partition_attribution(df, lambda score=score: lambda b: pd.Series([float(score(list(t))) for t in b["tokens"]]), max_evals=700)
        for r in out.collect():
            got.setdefault(r.id, {})[r.pos] = (r.token, r.phi)
        for i, t in enumerate(texts):
            def f(on, t=t):
                return score([t[k] for k in sorted(on)])
            assert got[i][-1] == ("", pytest.approx(f(set()))) and [got[i][k][0] for k in range(len(t))] == t
            assert [got[i][k][1] for k in range(len(t))] == pytest.approx(owen(len(t), f) if t else [], abs=1e-9)
            if len(t) <= 2 or score is linear and len(t) <= 7:
                assert [got[i][k][1] for k in range(len(t))] == pytest.approx(shapley(len(t), f), abs=1e-9)


def test_undivided_nodes_share_equally_and_values_add_up(spark):
    text = [f"t{i}" for i in range(37)]
    df = spark.createDataFrame([(0, 1, text)], "fold int, id long, tokens array<string>")
    calls = spark.sparkContext.accumulator(0)

    def factory():
        def score(b):
            calls.add(len(b))
            return pd.Series([math.sin(len(t)) + 2.0 * ("t5" in set(t)) for t in b["tokens"]])
        return score

    rows = {r.pos: r.phi for r in PA.partition_attribution(df, factory, max_evals=44).collect()}
    assert calls.value == 44
    assert sum(rows[i] for i in range(37)) == pytest.approx(math.sin(37) + 2.0 - math.sin(0), abs=1e-9)
    nodes = [(0, 37)]
    for _ in range(3):
        nodes = [x for lo, hi in nodes for x in ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi))]
    assert all(rows[i] == pytest.approx(rows[lo], abs=1e-12) for lo, hi in nodes for i in range(lo, hi))


def test_slot_scorer(spark):
    w = np.random.default_rng(2).normal(size=(SLOTS + 1, 2))
    score = OP.slot_scorer(w, [4, 6])()
    got = score(pd.DataFrame({"fold": [4, 6, 6], "tokens": [["a", "a", "b"], [], ["c"]], "n_tok": [3, 0, 5]}))
    z = [w[-1, 0] + (2 * w[slot("a"), 0] + w[slot("b"), 0]) / 3, w[-1, 1], w[-1, 1] + w[slot("c"), 1] / 5]
    assert got.tolist() == pytest.approx([1 / (1 + math.exp(-t)) for t in z])


def test_calls_are_bounded_in_tokens_and_scores_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(PA, "TOKENS", 50)
    masks = [(0, [(0, n)]) for n in (20, 30, 1, 0, 80, 3, 4)]
    assert [[hi for _, ((_, hi),) in part] for part in PA.calls(masks)] == [[20, 30], [1, 0], [80], [3, 4]]
    w = np.random.default_rng(5).normal(size=(SLOTS + 1, 2))
    rng = random.Random(6)
    lists = [rng.choices("abcdefgh", k=rng.choice([0, 1, 2, 40])) for _ in range(60)]
    batch = pd.DataFrame({"fold": [4 + 2 * (i % 2) for i in range(60)], "tokens": lists, "n_tok": [50] * 60})
    want = [w[-1, i % 2] + sum(w[slot(t), i % 2] for t in own) / 50 for i, own in enumerate(lists)]
    for block in (1, 7, 1 << 16):
        monkeypatch.setattr(OP, "BLOCK", block)
        assert OP.slot_scorer(w, [4, 6], probability=False)()(batch).tolist() == pytest.approx(want, abs=1e-12)


def test_only_the_folds_texts_are_tokenised(spark):
    from textcohort.operators import text as TX
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "c")], "id long, text string")
    picked = docs.join(spark.createDataFrame([(7, 1), (7, 2), (7, 2)], "fold int, id long"), "id")
    got = sorted((r.fold, r.id, r.tokens) for r in TX.doc_tokens(picked, keep=["fold"]).collect())
    assert got == [(7, 1, ["a", "b"]), (7, 2, []), (7, 2, [])]
