"""Registered queries of the training-data operators and, where SQL can express one, its oracle.

Each ``opN_<name>`` applies the operator to its whole table and derives the columns of its
contract from the operator's own output.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textcohort.llm.common import importable, read_table

QUERIES: dict = {}
ORACLE: dict = {}


def query(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op6_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textcohort.llm.exact_dedup import exact_dedup

    return exact_dedup(read_table(spark, sf_dir, "documents"))


NORM_SQL = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

ORACLE["op6_content_sort_dedup"] = f"""
    WITH n AS (SELECT doc_id, {NORM_SQL} AS norm FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY norm)"""


@query
def op5_two_tier_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textcohort.llm.token_counts import token_counts

    return token_counts(read_table(spark, sf_dir, "documents"), limit=2048)


@query
def op8_bounded_space_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textcohort.llm.packing import pack

    pieces = pack(read_table(spark, sf_dir, "documents"), window=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op9_bit_packed_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textcohort.llm.token_files import read_token_files, write_token_files

    shards = write_token_files(read_table(spark, sf_dir, "documents"), end_id=2)
    return read_token_files(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_simhash_anchor_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textcohort.llm.simhash import simhash_groups

    return simhash_groups(read_table(spark, sf_dir, "documents"), words=3, max_bits=3, seed=42)


@query
def op10_scanned_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textcohort.llm.byte_bpe import round_trip

    back = round_trip(read_table(spark, sf_dir, "documents"))
    return back.select("doc_id", "n_tokens", F.sha2("id_bytes", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op2_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textcohort.llm.warc import read_warc, write_warc

    back = read_warc(write_warc(read_table(spark, sf_dir, "pages")), with_data=False)
    return back.filter("last").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"),
                                      "record_type", "refers_to")


# base32 of the hex digest: four bits per hex digit, then one letter per five bits
SQL_BITS = ("array_to_string(list_transform(range(40), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', "
            "CAST(4 * (instr('0123456789abcdef', substr(h, i + 1, 1)) - 1) + 1 AS BIGINT), 4)), '')")
SQL_BASE32 = ("array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(5), "
              "lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INTEGER) * (16 >> j))) AS BIGINT), 1)), '')")

ORACLE["op2_chunked_warc"] = f"""
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h,
                 max(page_id) OVER (PARTITION BY payload) AS keep FROM p),
    b AS (SELECT *, {SQL_BITS} AS bits FROM d)
    SELECT page_id, payload_bytes, {SQL_BASE32} AS payload_digest,
           CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
    FROM b"""


@query
def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textcohort.llm.order_minhash import compare_edited

    pairs = compare_edited(read_table(spark, sf_dir, "documents"))
    return pairs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
                        "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query
def op1_toxicity_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textcohort.llm.toxicity import toxicity

    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op4_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textcohort.llm.pii import KINDS, count_of, personal_data, spans_text

    found = personal_data(read_table(spark, sf_dir, "documents"))
    counts = [count_of(k, F.col("base")).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.encode(spans_text(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
                        spans_text(F.col("spans")).alias("spans"))


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textcohort.llm.resampling import resample

    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


# CRC-32 by its rule, one byte after the other, of the distinct features only
SQL_CRC_TABLE = """
    SELECT list(c ORDER BY i) AS t FROM (
      SELECT i, list_reduce([CAST(i AS BIGINT)] || list_transform(range(8), lambda k: CAST(0 AS BIGINT)),
                            lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END)) AS c
      FROM (SELECT unnest(range(256)) AS i))"""


def sql_features(table: str, key: str) -> str:
    """``(key, feature)`` of every run of one or two words, repeats included, and ``(key, w)`` the words."""
    return f"""
    {table}_w AS (SELECT {key} AS k, regexp_extract_all({NORM_SQL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}),
    {table}_f AS (SELECT k, unnest(w || list_transform(range(len(w) - 1), lambda i: w[i + 1] || ' ' || w[i + 2])) AS f FROM {table}_w)"""


ORACLE["op12_importance_resampling"] = f"""
    WITH {sql_features('documents', 'doc_id')}, {sql_features('benchmark', 'item_id')},
    crc AS ({SQL_CRC_TABLE}),
    kinds AS (SELECT DISTINCT f FROM (SELECT f FROM documents_f UNION ALL SELECT f FROM benchmark_f)),
    coded AS (SELECT f, list_transform(range(CAST(octet_length(encode(f)) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(f)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM kinds),
    bucket AS (SELECT f, xor(list_reduce([CAST(4294967295 AS BIGINT)] || b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM coded CROSS JOIN crc),
    s AS (SELECT bucket, count(*) AS s FROM documents_f JOIN bucket USING (f) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM benchmark_f JOIN bucket USING (f) GROUP BY bucket),
    sizes AS (SELECT (SELECT count(*) FROM documents_f) AS big_s, (SELECT count(*) FROM benchmark_f) AS big_t),
    gain AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (big_s + 10000) / ((s + 1.0::DOUBLE) * (big_t + 10000)))) AS BIGINT) AS g
             FROM s LEFT JOIN t USING (bucket) CROSS JOIN sizes),
    total AS (SELECT k, CAST(sum(g) AS BIGINT) AS total, count(*) AS n FROM documents_f JOIN bucket USING (f) JOIN gain USING (bucket) GROUP BY k),
    weighed AS (SELECT w.k AS doc_id, coalesce(n, 0) AS n_features, len(w.w) >= 20 AS fit,
                       coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
                       CAST('0x' || substr(sha256('7:' || CAST(w.k AS VARCHAR)), 1, 8) AS BIGINT) AS h
                FROM documents_w w LEFT JOIN total ON total.k = w.k),
    scored AS (SELECT doc_id, n_features, fit, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weighed),
    placed AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY fit) AS n FROM scored)
    SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
           CASE WHEN fit AND place <= 25 * n // 100 THEN place END AS rank
    FROM placed"""


@query
def op11_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textcohort.llm.katz import score_texts

    return score_texts(read_table(spark, sf_dir, "documents"))


@query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textcohort.llm.phrases import collocations

    return collocations(read_table(spark, sf_dir, "documents"))


# every run of 1 to 4 words of a piece, with its count per language
ORACLE["op13_phrase_collocations"] = f"""
    WITH pieces AS (SELECT lang, unnest(regexp_split_to_array(norm, '[.,;:!?\\x0A-\\x0D]')) AS piece
                    FROM (SELECT coalesce(lang, 'und') AS lang, {NORM_SQL} AS norm FROM documents)),
    worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
    runs AS (SELECT lang, m, unnest(list_transform(range(CAST(greatest(len(w) - m + 1, 0) AS BIGINT)), lambda i: array_to_string(w[i + 1:i + m], ' '))) AS phrase
             FROM worded CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS m)),
    f AS (SELECT lang, m, phrase, count(*) AS f FROM runs GROUP BY lang, m, phrase HAVING count(*) >= 30),
    sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
    cuts AS (SELECT c.lang, c.m, c.phrase, c.f AS a, k, array_to_string(w[1:k], ' ') AS lo, array_to_string(w[k + 1:], ' ') AS hi
             FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1) c),
    scores AS (SELECT c.lang, c.phrase, c.m, a, k, l.f AS l, r.f AS r, CAST((CAST(a AS HUGEINT) * 2000000) // (l.f + r.f) AS BIGINT) AS score
               FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.lo JOIN f r ON r.lang = c.lang AND r.phrase = c.hi),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scores) WHERE nth = 1),
    held AS (SELECT DISTINCT s.lang, s.phrase FROM best s JOIN f o ON o.lang = s.lang AND o.m > s.m AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' ')
             WHERE CAST(o.f AS HUGEINT) * 100 >= CAST(s.a AS HUGEINT) * 80),
    placed AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
               FROM best b ANTI JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase)
    SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN sizes USING (lang) WHERE rank <= 2000"""


@query
def katz_backoff_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op11`` with its two sums rounded, so that they can be compared with SQL value by value."""
    rows = op11_katz_backoff(spark, sf_dir)
    return rows.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def sql_discounts(order: str, counts: str) -> str:
    """``<order>_d (r, d)`` from a table of counts ``c``: the Good-Turing discounts, as ``katz.discounts`` states them."""
    n = [f"CAST((SELECT count(*) FROM {counts} WHERE c = {r}) AS DOUBLE)" for r in range(1, 7)]
    return f"""
    {order}_n AS (SELECT [{", ".join(n)}] AS n),
    {order}_k AS (SELECT k, r, n, (k + 1) * n[k + 1] / n[1] AS top, ((r + 1) * n[r + 1] / (n[r] * r) - (k + 1) * n[k + 1] / n[1]) / (1 - (k + 1) * n[k + 1] / n[1]) AS d
                  FROM {order}_n CROSS JOIN (SELECT unnest(range(1, 6)) AS k) CROSS JOIN (SELECT unnest(range(1, 6)) AS r)
                  WHERE r <= k AND list_min(n[1:k + 1]) > 0 AND (k + 1) * n[k + 1] < n[1]),
    {order}_best AS (SELECT coalesce(max(k), 0) AS k FROM (SELECT k FROM {order}_k GROUP BY k HAVING min(d) > 0 AND max(d) < 1)),
    {order}_d AS (SELECT x.r, CASE WHEN b.k = 0 THEN (x.r - 0.5) / x.r WHEN x.r <= b.k THEN y.d ELSE 1.0 END AS d
                  FROM (SELECT unnest(range(1, 6)) AS r) x CROSS JOIN {order}_best b LEFT JOIN {order}_k y ON y.k = b.k AND y.r = x.r)"""


ORACLE["katz_backoff_rounded"] = f"""
    WITH crc AS ({SQL_CRC_TABLE}),
    docs AS (SELECT doc_id, regexp_extract_all({NORM_SQL}, '[^\\x20\\x09-\\x0D]+') || [chr(10)] AS w,
                    list_transform(range(CAST(length(CAST(doc_id AS VARCHAR)) AS BIGINT)), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i + 1 AS BIGINT), 1)) AS BIGINT)) AS b FROM documents),
    marked AS (SELECT doc_id, w, xor(list_reduce([CAST(4294967295 AS BIGINT)] || b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10 = 0 AS held_out
               FROM docs CROSS JOIN crc),
    tok AS (SELECT doc_id, held_out, unnest([''] || w[:len(w) - 1]) AS h, unnest(w) AS w FROM marked),
    one AS (SELECT w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY w),
    two AS (SELECT h, w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY h, w),
    {sql_discounts('o1', 'one')}, {sql_discounts('o2', 'two')},
    kept1 AS (SELECT w, c, c * coalesce(d, 1.0) AS k FROM one LEFT JOIN o1_d ON r = c),
    sums AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v, coalesce(sum(CASE WHEN c <= 5 THEN c - k ELSE 0 END), 0) AS rest FROM kept1),
    p1 AS (SELECT w, c, k / (n + CASE WHEN rest = 0 THEN 1 ELSE 0 END) AS p FROM kept1 CROSS JOIN sums),
    kept2 AS (SELECT h, w, c, c * coalesce(d, 1.0) AS k FROM two LEFT JOIN o2_d ON r = c),
    hist AS (SELECT h, CAST(sum(kept2.c) AS BIGINT) AS n, sum(CASE WHEN kept2.c <= 5 THEN kept2.c - k ELSE 0 END) AS rest, sum(p) AS lower FROM kept2 JOIN p1 USING (w) GROUP BY h),
    back AS (SELECT h, n + CASE WHEN rest = 0 THEN 1 ELSE 0 END AS total, CASE WHEN rest = 0 THEN 1 ELSE rest END / (n + CASE WHEN rest = 0 THEN 1 ELSE 0 END) / (1 - lower) AS alpha FROM hist),
    valued AS (SELECT t.doc_id, t.held_out, coalesce(p1.c, 0) AS c, n, v,
                      CASE WHEN kept2.k IS NOT NULL THEN kept2.k / back.total
                           ELSE coalesce(back.alpha, 1.0) * coalesce(p1.p, CASE WHEN rest = 0 THEN 1.0 ELSE rest END / (n + CASE WHEN rest = 0 THEN 1 ELSE 0 END)) END AS p
               FROM tok t CROSS JOIN sums LEFT JOIN p1 ON p1.w = t.w LEFT JOIN back ON back.h = t.h LEFT JOIN kept2 ON kept2.h = t.h AND kept2.w = t.w)
    SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE c > 0) AS n_known, max(n) AS train_tokens,
           round(sum(log10((c + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))), 6) AS base_score, round(sum(log10(p)), 6) AS score
    FROM valued GROUP BY doc_id, held_out"""
