"""Exact dedup and SimHash against brute force on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from textcohort.llm import exact_dedup as ED
from textcohort.llm import simhash as SH

DOCS = "doc_id long, text string, kept string, range int, fingerprint int"


def docs(spark, rows):
    """Documents with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], DOCS)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


ODD = [(1, "Same text É"), (2, "same TEXT É"), (3, "same text é"), (4, None), (5, ""), (9, "x " * 40000), (8, "X " * 40000),
       (6, "a"), (7, "A"), (None, "a")]


@pytest.mark.parametrize("ranges", [None, 40])
def test_exact_dedup_matches_brute_force(spark, ranges):
    rng = random.Random(4)
    rows = ODD + [(100 + i, rng.choice(["hot text", "hot text", "Hot Text", f"t{rng.randint(0, 40)}"])) for i in range(400)]
    got = {r.doc_id: r for r in ED.exact_dedup(docs(spark, rows).repartition(7), ranges=ranges).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    assert len(got) == len(rows)
    for i, t in rows:
        own = groups[lower(t)]
        keep = max(x for x in own if x is not None)
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(own), i == keep)
        assert r.text_sha256 == hashlib.sha256(lower(t).encode()).hexdigest()


def test_exact_dedup_cuts_a_hot_group_over_ranges(spark):
    rows = [(i, "copy") for i in range(3000)] + [(5000 + i, f"own {i}") for i in range(500)]
    df = docs(spark, rows)
    cuts = ED.splitters(df, 16)
    assert sum(c.p == "copy" for c in cuts) >= 5  # the group is dealt to several ranges
    got = ED.exact_dedup(df, ranges=16).filter("text_sha256 = sha2('copy', 256)").collect()
    assert len(got) == 3000 and {r.group_size for r in got} == {3000} and {r.keep_id for r in got} == {2999}
    assert [r.doc_id for r in got if r.kept] == [2999]


def test_exact_dedup_empty_and_repeated(spark):
    assert ED.exact_dedup(docs(spark, [])).collect() == []
    twice = ED.exact_dedup(docs(spark, [(1, "a"), (1, "a"), (2, "b")])).collect()
    assert sorted((r.doc_id, r.group_size) for r in twice) == [(1, 2), (1, 2), (2, 1)]
    assert sum(r.kept for r in twice) == 2
    left = ED.drop_copies(docs(spark, [(1, "a"), (1, "a"), (2, "A"), (3, None), (4, "")]))
    assert left.columns == ["doc_id", "text", "kept", "range", "fingerprint"]
    assert sorted(r.doc_id for r in left.collect()) == [2, 4]
    assert [r.doc_id for r in ED.drop_copies(docs(spark, [(1, "a"), (1, "a")])).collect()] == [1]


def brute_fingerprint(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, bits=3):
    up = list(range(len(points)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[i] ^ points[i + 1:]) <= bits):
            a, b = root(i), root(i + 1 + int(j))
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(points))]


def near_copies(rng, n):
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        if i % 3 and out:
            t = rng.choice(out).split(" ")
            t[rng.randrange(len(t))] = rng.choice(words)
        else:
            t = rng.choices(words, k=rng.randint(30, 400))
        out.append(" ".join(t))
    return out


def test_simhash_matches_brute_force(spark):
    texts = near_copies(random.Random(9), 240) + ["", None, " \t", "one", "one two", "One Two", "é x y z"]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in SH.simhash_groups(docs(spark, rows)).collect()}
    points = np.array([brute_fingerprint(t) for t in texts], np.uint64)
    want = brute_components(points)
    assert len(set(want)) < len(texts) - 20
    for i, _ in rows:
        assert (got[i].fingerprint, got[i].component_id) == (f"{int(points[i]):016x}", want[i])


@pytest.mark.parametrize("code", ["golay1", "golay2"])
def test_no_pair_within_the_distance_is_missed(code):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2 ** 64, 400, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, 3, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(int(b))
    row, anchor, home = SH.anchors(np.concatenate((x, y)), SH.CODES[code], 3)
    places, homes = {}, {}
    for r, a, h in zip(row.tolist(), anchor.tolist(), home.tolist(), strict=True):
        places.setdefault(r, set()).add(a)
        if h:
            assert r not in homes
            homes[r] = a
    assert all(homes[i] in places[i + 400] or homes[i + 400] in places[i] for i in range(400))


def test_golay_code_is_perfect():
    words, errors, remainder = SH.golay()
    assert len(set(words.tolist())) == 4096 and not remainder(words).any()
    weights = np.bitwise_count(words)
    assert weights[weights > 0].min() == 7
    assert np.bitwise_count(errors).max() == 3


def test_a_heavy_anchor_is_dealt_out(spark):
    base = 0x0123456789ABCDEF
    points = sorted({base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)})
    df = spark.createDataFrame([(p - (1 << 64) if p >= 1 << 63 else p,) for p in points], "fp long")
    edges = SH.links(df, anchor_points=150)
    assert edges.count() >= len(points) - 1
    tree = {r.node: r.root for r in SH.components(edges).collect()}
    assert len(set(tree.values())) == 1 and len(tree) == len(points) - 1


def test_components_of_a_long_chain(spark):
    n = 300
    order = random.Random(1).sample(range(n), n)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "a long, b long")
    assert {(r.node, r.root) for r in SH.components(edges).collect()} == {(i, 0) for i in range(1, n)}


def test_simhash_empty_repeated_null_ids(spark):
    assert SH.simhash_groups(docs(spark, [])).collect() == []
    got = SH.simhash_groups(docs(spark, [(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (2, "q r s t u v")])).collect()
    assert len(got) == 4 and sorted(r.component_id for r in got) == [2, 3, 3, 3]
    left = SH.drop_near_copies(docs(spark, [(3, "a b c d"), (3, "a b c d"), (5, "A b c d"), (2, "q r s t u v")]))
    assert left.columns == ["doc_id", "text", "kept", "range", "fingerprint"]
    assert sorted(r.doc_id for r in left.collect()) == [2, 3]


def test_near_copies_are_dropped_by_group_not_by_id(spark):
    rng = random.Random(3)
    one, two, three, four = (" ".join(rng.choices([f"v{i}" for i in range(500)], k=60)) for _ in range(4))
    rows = [(None, one), (None, two), (None, two.upper()), (None, three), (None, three)]  # three groups without an id
    rows += [(7, four), (7, "p q r s t"), (7, "P q r s t"), (8, four.upper()), (9, "p q r s t")]  # one id in two groups
    rows += [(-2 ** 63, "z y x w"), (None, None)]
    left = SH.drop_near_copies(docs(spark, rows).repartition(3)).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in left) == sorted([
        ((True, 0), one), ((True, 0), min(two, two.upper())), ((True, 0), three), ((True, 0), ""), ((False, 7), four), ((False, 7), "P q r s t"),
        ((False, -2 ** 63), "z y x w")])
