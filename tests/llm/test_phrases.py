"""Phrase collocations against a plain version: tiles, cuts of long texts, containment, exact scores."""

import random
import re
from collections import Counter, defaultdict

import pytest

from textcohort.llm import phrases as P

DOCS = "doc_id long, text string, lang string, rank int, phrase string, f long"
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "x", 2) for i, (t, g) in enumerate(rows)], DOCS)


def plain(rows, least=30, longest=4, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        g = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[g] += len(w)
            for m in range(1, longest + 1):
                f[g].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for g, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= least}
        outer = Counter()
        for p, a in frequent.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    outer[p[i:i + m]] = max(outer[p[i:i + m]], a)
        found = []
        for p, a in frequent.items():
            if len(p) > 1 and 100 * outer[p] < 80 * a:
                score, k = min((2000000 * a // (frequent[p[:k]] + frequent[p[k:]]), k) for k in range(1, len(p)))
                found.append((score, a, " ".join(p), frequent[p[:k]], frequent[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(g, i, p, a, l, r, n[g], s) for i, (s, a, p, l, r) in enumerate(found[:top], 1)]
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def corpus(n=260, seed=6, words=30):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["New York", "in spite of the", "À la", "à", "中文 字", "x" * 90]
    shares = [1 / (k + 1) for k in range(words)] + [0.3] * 6
    rows = []
    for _ in range(n):
        parts = rng.choices(vocabulary, shares, k=rng.randint(0, 40))
        rows.append(("".join(p + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\r\n"]) for p in parts), rng.choice(["en", "de", None])))
    return rows + [(None, "en"), ("", None), (" . , ", "fr"), rows[0], rows[0], ("only once here", "fr")]


@pytest.mark.parametrize("sizes", [{}, {"max_bytes": 900, "limit": 120, "part_grams": 300, "together": 4}])
def test_equals_the_plain_version(spark, sizes, monkeypatch):
    rows = corpus()
    assert got(P.collocations(docs(spark, rows).repartition(3), least=8, **sizes)) == plain(rows, least=8)


def test_sparse_tiles_and_a_short_report(spark):
    """With small tiles most cells are sparse; the settings of the module are read by the workers, so the vocabulary is made
    larger than the dense ranks instead."""
    rng = random.Random(9)
    base = [f"t{i}" for i in range(P.DENSE + 700)]
    rows = [(" ".join(f"{a} {b}" for a, b in zip(base, base[1:] + base[:1])), "en") for _ in range(3)]
    rows += [(" ".join(rng.choices(base, k=3000)), "en")]
    assert got(P.collocations(docs(spark, rows), least=3, top=900, part_grams=1500)) == plain(rows, least=3, top=900)


def test_registered_query(spark):
    from textcohort.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(QUERIES["op13_phrase_collocations"](spark, sf)) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(None, None)], [("a b", "en")], [("a b " * 40, "en")], [("a, " * 40, None)]])
def test_small_tables(spark, rows):
    assert got(P.collocations(docs(spark, rows))) == plain(rows)


def test_scores_are_exact_beyond_64_bits(spark):
    big = 6 * 10 ** 12
    df = spark.createDataFrame([(big, big, big + 1)], "a long, l long, r long")
    score = "cast(cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long) as s"
    assert df.selectExpr(score).first().s == 2000000 * big // (2 * big + 1)
