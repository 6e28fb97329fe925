"""Importance resampling against a plain version, its selection against a sort, odd inputs."""

import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest

from textcohort.llm import resampling as R
from textcohort.llm import word_blocks as WB

DOCS = "doc_id long, text string, score string, rank int, key double"
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in rows], DOCS)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def features(text):
    w = words(text)
    return [x.encode() for x in w + [a + " " + b for a, b in zip(w, w[1:])]]


def plain(rows, target, percent=25, least=20, buckets=10_000, seed=7):
    """Every document's (doc_id, n_features, weight, score, rank), by sorting."""
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in features(t):
                out[zlib.crc32(f) % buckets] += 1
        return out
    s, t = counts(x for _, x in rows), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, text in rows:
        f = features(text)
        weight = sum(gain[zlib.crc32(x) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0], r[1], r[2]))
    for place, r in enumerate(fit[:percent * len(fit) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)


def corpus(n=300, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(80)] + ["Été", "中文", "É", "x" * 70, "9a"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) + rng.choice(["", ".", "\n!"])) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "-- ++"), (n + 3, "a"), (None, "null id " * 30), (7, rows[8][1]), (9, rows[9][1]), (9, rows[9][1])]
    return rows, [" ".join(rng.choice(vocabulary[:20]) for _ in range(15)) for _ in range(10)] + [None, ""]


def got(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_the_plain_version(spark):
    rows, target = corpus()
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    for parts in (1, 5):
        assert got(R.resample(docs(spark, rows).repartition(parts), goal)) == plain(rows, target)
    assert got(R.resample(docs(spark, rows), goal, percent=100, least_words=0)) == plain(rows, target, percent=100, least=0)


def test_registered_query_equals_the_plain_version(spark):
    from textcohort.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert got(QUERIES["op12_importance_resampling"](spark, sf)) == plain(rows, target)


def test_repeated_rows_are_drawn_as_often_as_they_fit(spark):
    rows = [(1, "same words here " * 10)] * 9 + [(2, "others " * 30)]
    goal = spark.createDataFrame([(0, "same words")], "item_id long, text string")
    out = got(R.resample(docs(spark, rows), goal, percent=50))
    assert out == plain(rows, ["same words"], percent=50)
    assert sorted(r[4] for r in out if r[4]) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "")], [(3, "too few words")]])
def test_nothing_to_draw(spark, rows):
    goal = spark.createDataFrame([], "item_id long, text string")
    out = got(R.resample(docs(spark, rows), goal))
    assert out == plain(rows, []) and all(r[4] is None for r in out)


def test_a_cut_text_counts_as_a_whole_one(spark, monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice(["ab", " ", "\n", ".", "c", "é", "  "]) for _ in range(4000)).encode()
    whole = WB.words(pa.array([text]), R.WORD)
    for limit in (5, 64, 1000):
        one, two = [], []
        for part, held, _ in WB.parts_of(text, R.WORD, 1, limit):
            w = WB.words(pa.array([part]), R.WORD)
            a, b = R.feature_hashes(w)
            one += a.tolist()[held:]
            two += b.tolist()
        a, b = R.feature_hashes(whole)
        assert one == a.tolist() and two == b.tolist()
    monkeypatch.setattr(WB.blocks, "__defaults__", (2000, 500))
    from textcohort.llm.resampling import _features
    batch = pa.RecordBatch.from_arrays([pa.array([text.decode(), "x y", None, "z"])], ["text"])
    n = sum(int(own.sum() + inner.sum()) for _, _, _, own, _, inner in _features(iter([batch]), 10_000, []))
    assert n == sum(len(features(t)) for t in (text.decode(), "x y", "z"))


@pytest.mark.parametrize("pivots", [1, 4])
def test_selection_equals_a_sort(spark, pivots):
    rng = random.Random(pivots)
    keys = [(rng.randint(0, 9), rng.randint(0, 5)) for _ in range(120)]
    df = spark.createDataFrame(keys, "a long, b long").repartition(7)
    for k in (1, 60, 120):
        assert R.kth_key(df, ["a", "b"], k, pivots=pivots) == sorted(keys)[k - 1]
    assert R.kth_key(df, ["a", "b"], 121, pivots=pivots) is None and R.kth_key(df, ["a", "b"], 0) is None
