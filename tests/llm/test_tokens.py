"""Token counts, byte BPE, packing and token files against the tokenizer libraries and round trips."""

import base64
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from textcohort.llm import byte_bpe as BB
from textcohort.llm import packing as PK
from textcohort.llm import token_counts as TC
from textcohort.llm import token_files as TF
from textcohort.llm import word_bpe as WB

DOCS = "doc_id long, text string, n_tokens string, ids int, start int"
ALPHABET = [*"abcsterlvdmSTé ÀÖß中'’.,!?-0123456789½²\n\t\r\x0b\x1c\x85\xa0 　", "\U0001f600", "é", "'s", "'re", "'LL", " '", "  ", "\n ",
            "<|endoftext|>", "the", " and"]


def texts(n=150, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["", None, " ", "a" * 3000, "word " * 20000, "'s'S don'tİ ΑΣ"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(library, t):
    return library.encode(t or "", add_special_tokens=False).ids


def test_word_encoder_equals_the_library(library):
    enc = WB.encoder(WB.default_vocabulary())
    own = texts(600)
    batch = pa.array([t or "" for t in own])
    ids, at = enc.ids(batch)
    for i, t in enumerate(own):
        assert ids[at[i]:at[i + 1]].tolist() == ids_of(library, t), repr(t)


def test_caches_and_table_are_bounded_in_bytes(spark, library):
    cache = WB.Generations(max_bytes=1 << 20)
    for i in range(50_000):
        cache.put(f"word{i}", bytes(100))
    assert cache.held <= 1 << 20 and sum(len(v) for g in (cache.young, cache.old) for v in g.values()) < 2 << 20
    cache.put("x" * 1_000_000, b"")
    assert cache.get("x" * 1_000_000) is None
    enc = WB.WordEncoder(WB.default_vocabulary())
    rng = random.Random(4)
    long = ["".join(rng.choices("abcdefgh0123", k=200_000)) for _ in range(20)]
    for t in long:
        assert len(enc.chunk(t)) // 4 == len(ids_of(library, t))
    assert not any(len(k) > 400 for c in (enc.chunks, enc.pieces) for g in (c.young, c.old) for k in g)
    rows = docs(spark, [(i, f"the {long[i % 2]} cat {long[i % 2]}") for i in range(6)])
    assert sorted(TC.frequent_chunks(rows)) == ["cat", "the"]
    for r in TC.token_counts(rows).collect():
        assert r.n_tokens == len(ids_of(library, f"the {long[r.doc_id % 2]} cat {long[r.doc_id % 2]}"))


def test_generations_keep_frequent_entries():
    cache = WB.Generations(3)
    for i in range(20):
        cache.put(i, str(i))
        cache.get("hot") or cache.put("hot", "h")
    assert cache.get("hot") == "h" and cache.get(5) is None
    assert len(cache.young) <= 3 and len(cache.old) <= 3


def test_long_texts_are_encoded_in_parts(library, monkeypatch):
    monkeypatch.setattr(WB, "LONG_TEXT", 500)
    t = " ".join(texts(200)[:150]) + "é" * 2000 + " tail"
    batch = pa.RecordBatch.from_arrays([pa.array([t, "b"])], ["text"])
    runs = list(WB.encoded(WB.default_vocabulary(), batch, max_bytes=100))
    assert [(a, b) for a, b, _, _ in runs] == [(0, 1), (1, 2)]
    assert runs[0][2].tolist() == ids_of(library, t)


@pytest.mark.parametrize("table", [0, 64, TC.TABLE_SIZE])
def test_token_counts(spark, library, table):
    rows = list(enumerate(texts())) + [(7, "twice"), (7, "twice"), (None, "no id")]
    got = TC.token_counts(docs(spark, rows), limit=100, table_size=table, sample_rows=50).collect()
    want = sorted((i is None, i or 0, len((t or "").encode()), len(ids_of(library, t))) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)


def test_frequent_chunks_are_sampled_in_the_tasks_of_the_scan(spark):
    def tag(batches):
        from pyspark import TaskContext
        word = "abcdefgh"[TaskContext.get().partitionId()] * 4
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f"{word} {word}"] * b.num_rows)], ["doc_id", "text"])

    scan = spark.range(0, 400, 1, 8).mapInArrow(tag, "doc_id long, text string")
    for rows in (1000, 200):  # the whole table, a sample
        found = "".join(TC.frequent_chunks(scan, sample_rows=rows))
        assert all(c * 4 in found for c in "abcdefgh"), found


def test_token_counts_empty(spark):
    assert TC.token_counts(docs(spark, [])).collect() == []


@pytest.fixture(scope="module")
def byte_library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(BB.VOCABULARY), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library(spark, byte_library):
    rows = list(enumerate(texts(400))) + [(1000, "'" * 300 + "s"), (1001, " " * 900 + "x"), (1002, "ab" * 900)]
    back = {r.doc_id: r for r in BB.decode(BB.encode(docs(spark, rows), batch_bytes=2000)).collect()}
    assert back == {r.doc_id: r for r in BB.round_trip(docs(spark, rows), batch_bytes=3000).collect()}
    for i, t in rows:
        assert np.frombuffer(back[i].id_bytes, "<u4").tolist() == byte_library.encode_ordinary(t or ""), repr(t)
        assert bytes(back[i].decoded) == (t or "").encode() and back[i].n_tokens * 4 == len(back[i].id_bytes)


def test_byte_bpe_scan_does_not_depend_on_blocks():
    classes = BB.code_point_classes()
    data = "".join(t or "" for t in texts(200))
    points = np.frombuffer(data.encode("utf-32-le"), "<u4")
    first = np.array([0])
    want = BB.token_starts(points, first, classes, block=len(points) + 5)
    for block in (2, 7, 256):
        assert (BB.token_starts(points, first, classes, block=block) == want).all()


def test_byte_bpe_heap_and_list_merges_agree(monkeypatch):
    own = BB.merger(BB.default_vocabulary())
    pieces = [(t or "x").encode()[:200] for t in texts(100) if t]
    listed = [own._merge_short(p) for p in pieces]
    monkeypatch.setattr(BB, "SHORT_PIECE", 0)
    assert [own.merge(p) for p in pieces] == [x if p not in own.ranks else [own.ranks[p]] for p, x in zip(pieces, listed, strict=True)]


def test_byte_bpe_empty_and_null_id(spark):
    assert BB.decode(BB.encode(docs(spark, []))).collect() == []
    assert [r.doc_id for r in BB.encode(docs(spark, [(None, "a")])).collect()] == [None]


def check_pieces(rows, pieces, library, window, end_id):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for i, t in rows:
        ids = np.array([*ids_of(library, t), end_id], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert bytes(p.ids) == ids[at:at + p.length].tobytes()
            at += p.length
        assert at == len(ids)
    total = 0
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        total += at
    return 1 - total / (len(by_seq) * window)


@pytest.mark.parametrize(("window", "open_windows", "parts"), [(64, 4, 3), (64, 1, 1), (2048, 32, 9)])
def test_packing_covers_every_id_once(spark, library, window, open_windows, parts):
    rows = [(i, t) for i, t in enumerate(texts(120))]
    pieces = PK.pack(docs(spark, rows).repartition(parts), window=window, open_windows=open_windows, end_id=5).collect()
    padding = check_pieces(rows, pieces, library, window, 5)
    assert padding < (0.02 if window == 64 else 0.5)


def test_packing_leftovers_are_merged_across_partitions(spark, library):
    rows = [(i, f"w{i}") for i in range(200)]
    pieces = PK.pack(docs(spark, rows).repartition(20), window=64).collect()
    check_pieces(rows, pieces, library, 64, 1)
    total = sum(p.length for p in pieces)
    assert len({p.sequence_id for p in pieces}) == -(-total // 64)  # no sequence but the last is padded


def test_packing_empty_null_and_repeated(spark):
    assert PK.pack(docs(spark, [])).collect() == []
    got = PK.pack(docs(spark, [(1, None), (1, None), (None, "")])).collect()
    assert [p.length for p in got] == [1, 1, 1] and {p.sequence_id for p in got} == {got[0].sequence_id}


@pytest.mark.parametrize("bits", [1, 3, 16, 17, 31])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 64 * 37).astype(np.uint32)
    data = TF.pack_bits(ids, bits)
    assert len(data) == len(ids) * bits // 8
    assert (TF.unpack_bits(data, bits) == ids).all()


@pytest.mark.parametrize("shards", [1, 5])
def test_token_files_round_trip(spark, library, shards):
    own = texts()
    rows = [(3 * i - 50, t) for i, t in enumerate(own)] + [(None, "null id"), (10 ** 9, "a"), (10 ** 9, "b")]
    files = TF.write_token_files(docs(spark, rows), shards=shards)
    got = TF.read_token_files(files, max_ids=1000).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    assert len(got) == len(rows)
    for r, (i, t) in zip(sorted(got, key=lambda r: r.start), order, strict=True):
        ids = np.array([*ids_of(library, t), 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids)) and bytes(r.ids) == ids.tobytes()
        at += len(ids)
    shard = TF.Shard(files.orderBy("shard").collect()[0].path)  # random access reads the blocks of a run only
    whole = shard.ids(0, shard.n_ids)
    for a, b in ((0, 1), (4095, 4097), (shard.n_ids - 3, shard.n_ids), (70, 70)):
        assert (shard.ids(a, b) == whole[a:b]).all()


def test_token_files_empty(spark):
    assert TF.read_token_files(TF.write_token_files(docs(spark, []))).collect() == []
    assert zlib.crc32(TF.pack_bits(np.empty(0, np.uint32), 16)) == 0
