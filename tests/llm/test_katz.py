"""Katz backoff against a plain version, normalisation, odd inputs."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from textcohort.llm import katz as K

DOCS = "doc_id long, text string, score string, marked int, kind double"
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
END = "\n"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in rows], DOCS)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [END]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


class Plain:
    def __init__(self, rows):
        self.one, self.two = Counter(), defaultdict(Counter)
        for i, text in rows:
            if not held(i):
                t = tokens(text)
                self.one.update(t)
                for h, w in zip(["^"] + t, t):
                    self.two[h][w] += 1
        self.n, self.v = sum(self.one.values()), len(self.one)
        kinds = Counter(self.one.values()), Counter(c for h in self.two.values() for c in h.values())
        self.d1, self.d2 = (K.discounts([k[r] for r in range(1, K.CUT + 2)]) for k in kinds)
        self.left = sum(c - self.kept(self.d1, c) for c in self.one.values())
        self.alpha = {}

    @staticmethod
    def kept(d, c):
        return c * (d[c - 1] if c <= len(d) else 1.0)

    def single(self, w):
        left = self.left
        total = self.n + (left < 1e-9)
        return self.kept(self.d1, self.one[w]) / total if self.one[w] else (left if left >= 1e-9 else 1.0) / total

    def pair(self, h, w):
        seen = self.two.get(h)
        if not seen:
            return self.single(w)
        if h not in self.alpha:
            left = sum(c - self.kept(self.d2, c) for c in seen.values())
            total = sum(seen.values()) + (left < 1e-9)
            self.alpha[h] = total, (left if left >= 1e-9 else 1.0) / total / (1 - sum(map(self.single, seen)))
        total, alpha = self.alpha[h]
        return self.kept(self.d2, seen[w]) / total if w in seen else alpha * self.single(w)

    def row(self, i, text):
        t = tokens(text)
        base = sum(math.log10((self.one[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in t)
        score = sum(math.log10(self.pair(h, w)) for h, w in zip(["^"] + t, t))
        return i, held(i), len(t), sum(self.one[w] > 0 for w in t), self.n, base, score


def corpus(n=260, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ça", "The", "the", "中文", "x.", "a" * 300]
    shares = [1 / (k + 1) for k in range(len(vocabulary))]
    rows = [(i, rng.choice([" ", "\n", "  "]).join(rng.choices(vocabulary, shares, k=rng.randint(0, 40)))) for i in range(n)]
    return rows + [(n, None), (n + 1, " \t"), (n + 2, "only here"), (None, "the w1 w2"), (None, None), (4, rows[4][1]), (4, "w1 w1 w1"), (10 ** 12, "never seen words w3")]


def check(df, rows, model=None):
    assert df.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    plain = model or Plain(rows)
    want = sorted((plain.row(i, t) for i, t in rows), key=repr)
    found = sorted((tuple(r) for r in df.collect()), key=repr)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    for a, b in zip(sorted(found, key=lambda r: (repr(r[:5]), r[6])), sorted(want, key=lambda r: (repr(r[:5]), r[6]))):
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("sizes", [{}, {"max_bytes": 700, "limit": 90, "part_grams": 60, "spread": 20}])
def test_equals_the_plain_version(spark, sizes):
    rows = corpus()
    check(K.score_texts(docs(spark, rows).repartition(3), **sizes), rows)


def test_several_word_parts(spark, monkeypatch):
    monkeypatch.setattr(K.words_parts, "__defaults__", (900,))
    rows = corpus(seed=4)
    check(K.score_texts(docs(spark, rows).repartition(4), max_bytes=2000, part_grams=100, spread=15), rows)


def test_probabilities_sum_to_one():
    plain = Plain(corpus())
    for h in ["^", "w0", "w1", "w30", "the", "only", "nothing"]:
        assert sum(plain.pair(h, w) for w in [*plain.one, "unknown"]) == pytest.approx(1, abs=1e-9)


def test_written_tables_are_normalised(spark):
    """From the tables alone: counts, weights and vocabulary give probabilities that sum to 1 after every history."""
    import numpy as np

    from textcohort.llm.common import doc_texts
    from textcohort.llm.word_blocks import unpack

    rows = corpus()
    m = K.Katz(doc_texts(docs(spark, rows)).withColumn("marked", ~K.held_out(K.F.col("doc_id"))))
    vocabulary = m.places.filter("kind = 'vocabulary'").orderBy("part").collect()
    count = np.concatenate([[m.words.ends], *[unpack(r.b, np.int64) for r in vocabulary]])
    weights = m.weights.filter("kind = 'weights'").orderBy("part").collect()
    alpha = np.concatenate([[m.start[0]], *[unpack(r.a, np.float64) for r in weights]])
    more = np.concatenate([[m.start[1]], *[unpack(r.b, np.float64) for r in weights]])
    single = m.words.probability(count)
    assert single.sum() + m.words.unknown == pytest.approx(1, abs=1e-12)
    pairs = m.pairs.filter("kind = 'ngrams'").collect()
    h, w, c = (np.concatenate([unpack(r[x], np.int64) for r in pairs]) for x in "abc")
    for own in range(len(count)):
        at = h == own
        seen = m.order.kept(c[at]) / (count[own] + more[own])
        assert seen.sum() + alpha[own] * (1 - single[w[at]].sum()) == pytest.approx(1, abs=1e-9)
    plain = Plain(rows)
    assert c.sum() == plain.n and len(c) == sum(len(x) for x in plain.two.values())


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "")], [(29, "a b")], [(0, "a a a a"), (1, "")]])
def test_small_tables(spark, rows):
    check(K.score_texts(docs(spark, rows)), rows)


def test_discounts():
    assert K.discounts([10, 4, 2, 1, 1, 1])[-1] == 1.0 or all(0 < x <= 1 for x in K.discounts([10, 4, 2, 1, 1, 1]))
    assert K.discounts([0, 3, 0, 0, 0, 0]) == [(r - 0.5) / r for r in range(1, 6)]
    d = K.discounts([1000, 400, 210, 130, 90, 65])
    assert all(0 < x < 1 for x in d) and len(d) == 5


def test_registered_query(spark):
    from textcohort.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(QUERIES["op11_katz_backoff"](spark, sf), rows)
