"""Language-model scores by Katz backoff with Good-Turing discounts.

The model has words and pairs; a text is a start mark, its words and an end mark.

    P(w | h) = d(c) c / C(h)          if the pair h w occurred c > 0 times in training texts
             = alpha(h) P(w)          otherwise, evaluated one order lower
    P(w)     = d(c) c / N             for a word that occurred c > 0 times, and for all other words together
             = (what the discounts leave) / N

``d(c)`` is the Good-Turing discount of an order for c <= CUT (``discounts``), 1 above.  ``alpha(h)`` is
what the discounts leave of ``h`` divided by one less the lower-order probabilities of the words seen after it, so the
probabilities after every history, the unknown word included, sum to 1.  A history (or the words) whose
counts are all above the cut leaves nothing: it counts one occurrence more, and that one is what is left.

Everything is counted over all training texts: words and pairs travel as arrays between blocks of texts and
parts of the key space (``gram_exchange``).  The pairs of a frequent history are dealt to several parts by
their second word.  Counts and backoff weights are written as tables, one row per part; a block gets
the counts of its own pairs and the weights of its own histories, and scores its texts token by token.

Results for odd inputs: a null or empty text is a start and an end mark (one token); a text of any length is read whole (in
parts with one word of context); equal and repeated rows are learnt from and scored each; a null id is learnt
from (not held out) and passed on; without training texts every probability is 1 and every score 0; an empty table
gives an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textcohort.llm.common import doc_texts, materialize
from textcohort.llm.gram_exchange import (FIRST, LAST, MARKED, NO_ID, PART_GRAMS, by, encode, local_ids, merge_words, rows_of, stat_sums, table,
                                          words_parts, written)
from textcohort.llm.word_blocks import BLOCK_BYTES, LONG_TEXT, byte_class, pack, unpack

#: Counts up to this one are discounted.
CUT = 5
#: A history with more occurrences is dealt to several parts.
SPREAD = 200_000
WORD = byte_class(rb"[^\x20\x09-\x0D]")


def held_out(doc_id: Column, modulus: int = 10) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == 0, F.lit(False))


def discounts(n: list[int]) -> list[float]:
    """``d(1) ... d(CUT)`` from ``n[r - 1]`` = how many kinds occurred r times, r = 1 ... CUT + 1.

    The largest cut whose discounts all lie between 0 and 1 is used (above it: 1); where there is none, as in very small
    corpora, half an occurrence is taken off."""
    cut = len(n) - 1
    for k in range(cut, 0, -1):
        if min(n[:k + 1]) > 0 and (top := (k + 1) * n[k] / n[0]) < 1:
            d = [((r + 1) * n[r] / (n[r - 1] * r) - top) / (1 - top) for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return d + [1.0] * (cut - k)
    return [(r - 0.5) / r for r in range(1, cut + 1)]


@dataclass
class Order:
    """Discounted relative frequencies of one order."""
    d: list[float]

    def kept(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        factor = np.array([0.0, *self.d, 1.0])
        return c * factor[np.minimum(c, len(self.d) + 1)]

    def left(self, classes: np.ndarray) -> np.ndarray:
        """What the discounts take off, from the numbers of kinds with 1, 2, ... CUT occurrences (last axis)."""
        return classes @ (np.arange(1, len(self.d) + 1) * (1 - np.array(self.d)))


@dataclass
class Words:
    """The unigram model: counts of classes, all tokens, kinds; ``ends`` training texts."""
    order: Order
    tokens: int
    kinds: int
    ends: int
    left: float
    first: list[int]        # of each part: the number of its first word (from 1; 0 is the mark)

    @property
    def total(self) -> float:
        return self.tokens + (self.left == 0)

    @property
    def unknown(self) -> float:
        return (self.left or 1.0) / self.total

    def probability(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.order.kept(c) / self.total, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.kinds + 1)))


def _mix(x: np.ndarray) -> np.ndarray:
    """A well-spread hash of whole numbers."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Texts:
    """A block's texts as one sequence: each text, or part of one, begins with its history (the start mark, or the word before
    the cut), and a text's last part ends with the end mark.  ``local``: word numbers of the block, 0 for a mark."""

    def __init__(self, row: dict):
        lens, self.flags = unpack(row["b"], np.int32).astype(np.int64), unpack(row["c"], np.uint8)
        self.rows, self.ids = unpack(row["d"], np.int64), unpack(row["e"], np.int64)
        held = unpack(row["f"], np.int32)
        lead, tail = (held == 0).astype(np.int64), (self.flags & LAST > 0).astype(np.int64)
        size = lens + lead + tail
        self.at = np.concatenate(([0], np.cumsum(size)))
        self.local = np.zeros(self.at[-1], np.int64)
        self.local[np.arange(lens.sum()) + np.repeat(self.at[:-1] + lead - np.concatenate(([0], np.cumsum(lens)))[:-1], lens)] = unpack(row["a"], np.int32)
        # a token and the one before it
        scored = np.ones(self.at[-1], bool)
        scored[self.at[:-1]] = False
        self.token = np.flatnonzero(scored)
        self.tokens = size - 1
        self.learnt = np.repeat(self.flags & MARKED > 0, self.tokens)


def _global(words: Words, group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of every word number of the block: its number in the corpus (-1: not in training texts) and its count.  Number 0 is the mark."""
    answers, place, count = local_ids(group)
    sizes = np.array([len(unpack(r["a"], np.int32)) for r in answers], np.int64)
    first = np.repeat(np.array([words.first[r["part"]] for r in answers], np.int64), sizes)
    return np.concatenate(([0], np.where(place >= 0, first + place, -1))), np.concatenate(([words.ends], count))


def _pairs(texts: Texts, number: np.ndarray, count: np.ndarray, parts: int, spread: int) -> tuple:
    """The block's distinct pairs of known words by part: ``(pair of each token or -1, history, word, occurrences in training texts, part)``."""
    h, w = texts.local[texts.token - 1], texts.local[texts.token]
    known = (number[h] >= 0) & (number[w] >= 0) & (count[h] > 0) & (count[w] > 0)
    kinds, which = np.unique(h[known] * len(number) + w[known], return_inverse=True)
    a, b = kinds // len(number), kinds % len(number)
    salt = number[b] % (1 + count[a] // spread)
    part = (_mix(number[a] * 1_000_003 + salt) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    pair = np.full(len(h), -1)
    pair[known] = place[which]
    n = np.bincount(pair[known & texts.learnt], minlength=len(order))
    return pair, number[a][order], number[b][order], n, part[order], b[order]


class Katz:
    """Counts of a corpus, written; ``scores`` evaluates the texts it was built over."""

    def __init__(self, texts: DataFrame, spread: int = SPREAD, part_grams: int = PART_GRAMS, max_bytes: int = BLOCK_BYTES, limit: int = LONG_TEXT):
        """``texts``: ``(doc_id, text, marked)``; marked rows are learnt from."""
        self.spread = spread
        self.blocks = encode(texts.withColumn("grp", F.lit("")), words_parts(texts), WORD, None, 1, max_bytes, limit)
        self.places = merge_words(self.blocks, CUT + 1)
        ends = self.blocks.filter("kind = 'tokens'").agg(F.sum(F.col("nums")[0]).alias("ends"), F.sum(F.col("nums")[1]).alias("n")).first()
        self.words = self._words(ends.ends or 0)
        self.parts = max(1, -(-(ends.n or 0) // part_grams))
        self.pairs = self._merged()
        found = stat_sums(self.pairs, CUT + 1)[0]
        self.order = Order(discounts([found[f"x{i}"] or 0 for i in range(CUT + 1)]))
        self.weights = self._backoff()
        start = self.weights.filter("kind = 'start'").select("a").collect()       # one row
        self.start = unpack(start[0].a, np.float64).tolist() if start else [1.0, 0.0]

    def _words(self, ends: int) -> Words:
        # one row of sums and one number per part
        found = stat_sums(self.places, CUT + 3)[0]
        kinds, tokens, *classes = [found[f"x{i}"] or 0 for i in range(CUT + 3)]
        if 0 < ends <= CUT + 1:
            classes[ends - 1] += 1
        order = Order(discounts(classes))
        sizes = {r.part: r.m for r in self.places.filter("kind = 'stats'").select("part", F.col("nums")[0].alias("m")).collect()}
        first, at = [], 1
        for p in range(max(sizes, default=-1) + 1):
            first.append(at)
            at += sizes.get(p, 0)
        return Words(order, tokens + ends, kinds + (ends > 0), ends, float(order.left(np.array(classes[:CUT]))), first)

    def _merged(self) -> DataFrame:
        """Rows ``counts`` (to each block: the count of its pairs), ``ngrams`` (the table of counts), ``histories`` (to the part of
        each history: its classes and the lower-order probability of the words after it) and ``stats``."""
        words, parts, spread = self.words, self.parts, self.spread
        base = 1 + words.kinds
        if base >= 3_000_000_000:
            raise ValueError("a pair of word numbers does not fit 63 bits")

        def send(key: tuple, group: pa.Table) -> pa.Table:
            number, count = _global(words, group)
            out = []
            for row in rows_of("tokens", group):
                _, h, w, n, part, local = _pairs(Texts(row), number, count, parts, spread)
                ends = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
                out += [{"kind": "pairs", "grp": "", "block": row["block"], "part": int(part[i]), "a": pack(h[i:j]), "b": pack(w[i:j]), "c": pack(n[i:j].astype(np.int64)), "d": pack(count[local[i:j]])}
                        for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            return table(out)

        first = np.array(words.first or [1])

        def merge(key: tuple, group: pa.Table) -> pa.Table:
            rows = rows_of("pairs", group)
            sent = [unpack(r["a"], np.int64) * base + unpack(r["b"], np.int64) for r in rows]
            at = np.concatenate(([0], np.cumsum([len(s) for s in sent])))
            kinds, which = np.unique(np.concatenate(sent), return_inverse=True)
            c = np.bincount(which, np.concatenate([unpack(r["c"], np.int64) for r in rows]), len(kinds)).astype(np.int64)
            of_word = np.zeros(len(kinds), np.int64)
            of_word[which] = np.concatenate([unpack(r["d"], np.int64) for r in rows])
            answer = c[which]
            out = [{"kind": "counts", "grp": "", "block": r["block"], "part": r["part"], "a": pack(answer[at[i]:at[i + 1]])} for i, r in enumerate(rows)]
            seen = c > 0
            kinds, c, of_word = kinds[seen], c[seen], of_word[seen]
            h, w = kinds // base, kinds % base
            part = rows[0]["part"]
            out.append({"kind": "ngrams", "grp": "", "part": part, "a": pack(h), "b": pack(w), "c": pack(c)})
            out.append({"kind": "stats", "grp": "", "part": part, "nums": np.bincount(np.minimum(c, CUT + 2), minlength=CUT + 3)[1:CUT + 2].tolist()})
            if len(h):
                heads = np.flatnonzero(np.diff(h, prepend=-1))
                classes = np.stack([np.add.reduceat((c == r).astype(np.int64), heads) for r in range(1, CUT + 1)], 1)
                lower = np.add.reduceat(words.probability(of_word), heads)
                own = h[heads]
                home = np.maximum(np.searchsorted(first, own, side="right") - 1, 0)      # the start mark is at home in the first part
                ends = np.flatnonzero(np.diff(home, prepend=-1, append=-1))
                out += [{"kind": "histories", "grp": "", "block": part, "part": int(home[i]), "a": pack(own[i:j]), "b": pack(classes[i:j].reshape(-1)), "c": pack(lower[i:j])}
                        for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            return table(out)

        both = self.blocks.filter("kind = 'tokens'").unionByName(self.places.filter("kind = 'ids'"))
        return written(by(by(both, ["block"], send), ["part"], merge), "katz-pairs")

    def _backoff(self) -> DataFrame:
        """Rows ``backoff`` (to each block, in the order of its ``ids``: the weight of its histories and what is added to their
        counts), ``weights`` (the table of weights) and ``start`` (those of the start mark)."""
        words, order = self.words, self.order

        def weigh(key: tuple, group: pa.Table) -> pa.Table:
            part = int(key[0].as_py())
            vocabulary = rows_of("vocabulary", group)
            count = np.concatenate([unpack(r["b"], np.int64) for r in vocabulary] or [np.zeros(0, np.int64)])
            # place 0 is the start mark (it counts in the first part only)
            count = np.concatenate(([words.ends], count))
            classes, lower = np.zeros((len(count), CUT)), np.zeros(len(count))
            offset = (words.first[part] if part < len(words.first) else 1) - 1
            for r in rows_of("histories", group):
                own = unpack(r["a"], np.int64)
                at = np.where(own == 0, 0, own - offset)
                np.add.at(classes, at, unpack(r["b"], np.int64).reshape(-1, CUT))
                np.add.at(lower, at, unpack(r["c"], np.float64))
            left = order.left(classes)
            more = (left == 0).astype(np.float64)
            with np.errstate(divide="ignore", invalid="ignore"):
                alpha = np.where(count > 0, np.where(left > 0, left, 1.0) / (count + more) / (1 - lower), 1.0)
            out = [{"kind": "weights", "grp": "", "part": part, "a": pack(alpha[1:]), "b": pack(more[1:])}]
            if part == 0:
                out.append({"kind": "start", "grp": "", "part": part, "a": pack(np.array([alpha[0], more[0]]))})
            for r in rows_of("ids", group):
                place = unpack(r["a"], np.int32)
                known = np.maximum(place, -1) + 1
                out.append({"kind": "backoff", "grp": "", "block": r["block"], "part": part, "a": pack(np.where(place >= 0, alpha[known], 1.0)),
                            "b": pack(np.where(place >= 0, more[known], 0.0))})
            return table(out)

        rows = self.places.filter("kind IN ('ids', 'vocabulary')").unionByName(self.pairs.filter("kind = 'histories'"))
        return written(by(rows, ["part"], weigh), "katz-weights")

    def scores(self) -> DataFrame:
        """``doc_id, n_tokens, n_known, base_score, score, marked`` of every text."""
        words, order, parts, spread, start = self.words, self.order, self.parts, self.spread, self.start

        def score(key: tuple, group: pa.Table) -> pa.Table:
            number, count = _global(words, group)
            _, alpha, more = local_ids(group, "backoff", np.float64, np.float64)
            alpha, more = np.concatenate(([start[0]], alpha)), np.concatenate(([start[1]], more))
            of_pairs = np.concatenate([unpack(r["a"], np.int64) for r in rows_of("counts", group)] or [np.zeros(0, np.int64)])
            single = words.probability(count)
            out = []
            for row in rows_of("tokens", group):
                t = Texts(row)
                pair = _pairs(t, number, count, parts, spread)[0]
                h, w = t.local[t.token - 1], t.local[t.token]
                c = np.concatenate((of_pairs, [0]))[pair]
                with np.errstate(divide="ignore", invalid="ignore"):
                    p = np.where(c > 0, order.kept(c) / (count[h] + more[h]), np.where(count[h] > 0, alpha[h], 1.0) * single[w])
                sums = [_sums(x, t.tokens) for x in (np.log10(p), words.base(count)[w], count[w] > 0)]
                no_id = t.flags & NO_ID > 0
                out.append(pa.table({"block": pa.array([row["block"]] * len(t.ids), pa.int64()), "row": t.rows, "doc_id": pa.array(t.ids, pa.int64(), mask=no_id), "whole": t.flags & (FIRST | LAST) == FIRST | LAST,
                                     "marked": t.flags & MARKED > 0, "n_tokens": t.tokens, "n_known": sums[2].astype(np.int64), "base_score": sums[1], "score": sums[0]}))
            return pa.concat_tables(out)

        rows = (self.blocks.filter("kind = 'tokens'").unionByName(self.places.filter("kind = 'ids'"))
                .unionByName(self.pairs.filter("kind = 'counts'")).unionByName(self.weights.filter("kind = 'backoff'")))
        schema = "block long, row long, doc_id long, whole boolean, marked boolean, n_tokens long, n_known long, base_score double, score double"
        done = materialize(by(rows, ["block"], score, schema), "katz-scores")
        # the parts of cut texts are few: they alone are put together (a task's blocks share its number)
        names = ["doc_id", "marked", "n_tokens", "n_known", "base_score", "score"]
        parts_of = done.filter("NOT whole").groupBy(F.shiftright("block", 32).alias("task"), "row").agg(
            F.first("doc_id").alias("doc_id"), F.first("marked").alias("marked"), *[F.sum(c).alias(c) for c in names[2:]])
        return done.filter("whole").select(*names).unionByName(parts_of.select(*names))


def _sums(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The sum of each text's values, added up within the text."""
    out = np.zeros(len(lens))
    full = lens > 0
    if full.any():
        out[full] = np.add.reduceat(values.astype(np.float64), (np.cumsum(lens) - lens)[full])
    return out


def score_texts(docs: DataFrame, modulus: int = 10, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document; those that are held out are
    not learnt from."""
    texts = doc_texts(docs, id_col, text_col)
    model = Katz(texts.withColumn("marked", ~held_out(F.col("doc_id"), modulus)), **sizes)
    return model.scores().select("doc_id", (~F.col("marked")).alias("held_out"), "n_tokens", "n_known", F.lit(model.words.tokens).cast("long").alias("train_tokens"),
                                 "base_score", "score")
