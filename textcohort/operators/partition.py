"""Attribution for a scorer that is only a callable: Owen values over a binary tree of a text's tokens.

The tree halves the tokens again and again.  A node's value is what its tokens add to the score; its two halves share it by
the Shapley rule of two players: each half counts once without the other half and once with it, and these two contexts
go down the tree with half the weight each.  Levels are evaluated one after the other, all masks of a level (of all texts in
a batch) in calls of bounded size to the scorer.  A mask keeps some tokens in their order and drops the others.

A text costs ``2 + 2 * (1 + 4 + 16 + ...)`` evaluations, so ``max_evals`` gives the number of levels (``levels``); tokens of a
node that is not divided further share its value equally.  The values of a text add up to its score less the score
of no tokens (the base, position -1).  A text of one token gets the whole difference; a text without tokens has only the base.

Texts are dealt to tasks by their key; a batch holds a few texts, so memory is bounded by their tokens and the masks of a call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcohort.operators.scorer import ScorerFactory, ship_by_value

MAX_EVALS = 500
#: Masks of one call to the scorer, tokens of a call (unless one mask has more), and texts that go down their trees together.
CALL, TOKENS, TOGETHER = 2048, 1 << 20, 16


def levels(max_evals: int) -> int:
    """How many levels of the tree so many evaluations of a text allow."""
    used, depth = 2, 0
    while used + 2 * 4 ** depth <= max_evals:
        used, depth = used + 2 * 4 ** depth, depth + 1
    return depth


def owen_values(sizes: list[int], value: Callable[[list[tuple[int, list]]], list[float]], depth: int) -> tuple[list[list[float]], list[float]]:
    """Per text the values of its tokens, and its base.  ``value`` scores masks ``(text, kept ranges)``."""
    n = len(sizes)
    ends = value([(i, []) for i in range(n)] + [(i, [(0, sizes[i])]) for i in range(n)])
    phi = [[0.0] * size for size in sizes]
    # (text, first token, end, ranges kept beside it, score without it, score with it, weight)
    states = [(i, 0, sizes[i], [], ends[i], ends[n + i], 1.0) for i in range(n) if sizes[i]]
    for level in range(depth + 1):
        split = [s for s in states if s[2] - s[1] > 1 and level < depth]
        for i, lo, hi, _, without, along, weight in states:
            if hi - lo == 1 or level == depth:
                for t in range(lo, hi):
                    phi[i][t] += weight * (along - without) / (hi - lo)
        asked = value([(s[0], [*s[3], half]) for s in split for half in ((s[1], (s[1] + s[2]) // 2), ((s[1] + s[2]) // 2, s[2]))])
        states = []
        for k, (i, lo, hi, on, without, along, weight) in enumerate(split):
            mid, left, right = (lo + hi) // 2, asked[2 * k], asked[2 * k + 1]
            states += [(i, lo, mid, on, without, left, weight / 2), (i, lo, mid, [*on, (mid, hi)], right, along, weight / 2),
                       (i, mid, hi, on, without, right, weight / 2), (i, mid, hi, [*on, (lo, mid)], left, along, weight / 2)]
    return phi, ends[:n]


def calls(masks: list[tuple[int, list]]) -> Iterator[list[tuple[int, list]]]:
    """The masks in calls of at most ``CALL`` masks and ``TOKENS`` tokens."""
    part, tokens = [], 0
    for mask in masks:
        kept = sum(hi - lo for lo, hi in mask[1])
        if part and (len(part) == CALL or tokens + kept > TOKENS):
            yield part
            part, tokens = [], 0
        part.append(mask)
        tokens += kept
    if part:
        yield part


def partition_attribution(texts: DataFrame, factory: ScorerFactory, max_evals: int = MAX_EVALS, parts: int | None = None) -> DataFrame:
    """``(fold, id, pos, token, phi)`` of texts ``(fold, id, tokens)`` under the scorer, which gets batches ``(fold, id, tokens, n_tok)``
    with the kept tokens and the number of all tokens of the text."""
    ship_by_value(__name__)
    depth = levels(max_evals)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for batch in batches:
            for start in range(0, len(batch), TOGETHER):
                rows = batch.iloc[start:start + TOGETHER]
                fold, ids, tokens = (rows[c].tolist() for c in ("fold", "id", "tokens"))
                tokens = [list(t) if t is not None else [] for t in tokens]

                def value(masks: list[tuple[int, list]], fold=fold, ids=ids, tokens=tokens) -> list[float]:
                    out: list[float] = []
                    for part in calls(masks):
                        kept = [list(chain.from_iterable(tokens[i][lo:hi] for lo, hi in sorted(on))) for i, on in part]
                        frame = pd.DataFrame({"fold": [fold[i] for i, _ in part], "id": [ids[i] for i, _ in part], "tokens": kept, "n_tok": [len(tokens[i]) for i, _ in part]})
                        out += scorer(frame).astype("float64").tolist()
                    return out

                phi, base = owen_values([len(t) for t in tokens], value, depth)
                for i, own in enumerate(tokens):
                    yield pd.DataFrame({"fold": fold[i], "id": ids[i], "pos": range(-1, len(own)), "token": ["", *own], "phi": [base[i], *phi[i]]})

    rows = texts.select(F.col("fold").cast("int").alias("fold"), F.col("id").cast("long").alias("id"), "tokens")
    # a text costs far more than its bytes tell: spread the texts over all cores
    rows = rows.repartition(parts or texts.sparkSession.sparkContext.defaultParallelism, "fold", "id")
    return rows.mapInPandas(run, "fold int, id long, pos int, token string, phi double")
