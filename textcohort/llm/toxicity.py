"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration.

1. **Lexicon.**  Words that are much more frequent (by document) in toxic than in other labelled texts
   are found by one aggregation over distinct words of the fitting rows; the ``lexicon_size`` words
   with the largest signed G² stay, each with its log odds.  A document's copies count once.
2. **Features** (one pass over a whole text, no vector as wide as a vocabulary): densities and counts of
   lexicon words, their weights, how close they stand to each other and to second-person words,
   shares of capitals, all-capital words, punctuation marks and runs, obfuscated words (letters mixed
   with digits or symbols, letters repeated or spelled out) that become lexicon words when restored.
3. **Trees.**  A boosted classifier of Spark ML is fitted on one part of the fitting rows and an
   isotonic regression on the other part maps its margin to a probability.

Labelled rows used for fitting are bounded by ``max_fit_rows`` (the smallest hashes of the id, so the
choice does not depend on the input's partitioning); every document is scored whole.  The score of a
text depends on the text alone.  ``held_out`` rows (crc32 of the id as text, modulo 5, is 0) are never
used for fitting.

Results for odd inputs: a null or empty text has all features 0 and gets that point's score; a
document labelled more than once is used with its largest label; labels of unknown documents or null
labels are ignored; with no labelled rows, or only one class, every score is the share of toxic
fitting rows (0 if there are none) and the filter keeps all rows; where toxic rows share no word, the
lexicon is empty and the trees have the other features; a part of the fitting rows that lacks a class is
replaced by all of them; repeated rows are scored each; an empty table gives an empty result.
Only the id and text columns of documents and the id and label columns of labels are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from textcohort.llm.common import doc_texts, materialize, slices, text_array, tidy

MAX_FIT_ROWS = 24_000
LEXICON_SIZE = 256
#: A lexicon word is in at least so many toxic fitting rows, and in this share of them.
LEAST_ROWS, LEAST_SHARE = 4, 0.01
TREES, DEPTH, SEED = 20, 3, 7
NEAR = 12

# Second-person words of the four languages.
SECOND_PERSON = frozenset("you your yours yourself yourselves ya u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos "
                          "usted ustedes ti tú tus vosotros".split())
# Characters that stand for a letter in obfuscated words.
LEET = str.maketrans("013457@$!|", "oieastasil")

_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = re.compile(r"([^\W\d_])\1{2,}")
_RUN = re.compile(r"[!?]{2,}")
_SYMBOLS = re.compile(r"[0-9@$!|*]")
FEATURES = ["log_words", "hits", "hit_density", "distinct_hits", "weight", "weight_density", "best_weight", "close_hits", "second_person", "near_second_person",
            "near_hits_second_person", "capitals", "shouted", "exclamations", "questions", "punctuation", "runs", "mixed", "spelled", "repeated", "restored_hits"]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """The features of one text, in the order of ``FEATURES``."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    low, tokens = words_of(text), text.split()
    total, kinds, lens = max(1, len(low)), set(low), list(map(len, low))
    at = [i for i, w in enumerate(low) if w in lexicon] if not kinds.isdisjoint(lexicon) else []
    second = [i for i, w in enumerate(low) if w in SECOND_PERSON] if not kinds.isdisjoint(SECOND_PERSON) else []
    weights = [lexicon[low[i]] for i in at]
    near = _pairs_within(at, second, NEAR)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    # capitals of ASCII and Latin-1
    capitals = np.count_nonzero((points - 65 < 26) | (points - 192 < 31) & (points != 215))
    same = points[1:] == points[:-1]
    thrice = np.flatnonzero(same[1:] & same[:-1])
    repeated = [w for w in low if _LETTERS.search(w)] if any(text[k].isalpha() for k in thrice.tolist()) else []
    shouted = sum(len(w) > 2 for w in tokens if w.isupper())
    mixed = [w for w in tokens if _SYMBOLS.search(w.rstrip("!?")) and _WORD.search(w)] if _SYMBOLS.search(text) else []
    spelled = _spelled(low, lens) if lens.count(1) >= 4 else []
    restored = sum("".join(_WORD.findall(w.lower().translate(LEET))) in lexicon for w in mixed) + sum(bool({w, w[1:], w[:-1]} & lexicon.keys()) for w in spelled)
    restored += sum(_LETTERS.sub(r"\1", w) in lexicon or _LETTERS.sub(r"\1\1", w) in lexicon for w in repeated)
    exclaim, ask = text.count("!"), text.count("?")
    marks = exclaim + ask + sum(map(text.count, ".,;:"))
    return [math.log1p(len(low)), float(len(at)), len(at) / total, float(len(kinds & lexicon.keys()) if at else 0), sum(weights), sum(weights) / total,
            max(weights, default=0.0), float(sum(b - a <= NEAR for a, b in zip(at, at[1:], strict=False))), len(second) / total, float(near > 0), float(near),
            float(capitals) / max(1, sum(lens)), shouted / total, exclaim / n, ask / n, marks / n, (len(_RUN.findall(text)) if exclaim + ask else 0) / total,
            len(mixed) / total, len(spelled) / total, len(repeated) / total, float(restored)]


def _spelled(words: list[str], lens: list[int]) -> list[str]:
    """Words spelled out letter by letter: runs of four or more one-letter words, joined (a run may begin or
    end with a word of one letter that is none of them)."""
    out, run = [], []
    for w, n in zip([*words, ""], [*lens, 0], strict=True):
        if n == 1:
            run.append(w)
            continue
        if len(run) >= 4:
            out.append("".join(run))
        run = []
    return out


def _pairs_within(a: list[int], b: list[int], reach: int) -> int:
    """How many positions of ``a`` have one of ``b`` within reach; both ascend."""
    j, n = 0, 0
    for x in a:
        while j < len(b) and b[j] < x - reach:
            j += 1
        n += j < len(b) and b[j] <= x + reach
    return n


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fitting_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS, label_col: str = "toxic") -> DataFrame:
    """``(doc_id, text, label)`` of at most ``max_rows`` labelled rows that are not held out, one for each
    distinct text."""
    marked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).dropna()
              .groupBy("doc_id").agg(F.max("label").alias("label")).filter(~held_out()))
    # the bounded sample is chosen from the narrow label rows, before a text is read
    chosen = marked.orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(max_rows)
    # at most max_rows rows of an id and a label
    texts = doc_texts(docs).join(F.broadcast(chosen), "doc_id")
    return texts.dropDuplicates(["text"])


def learn_lexicon(rows: DataFrame, size: int = LEXICON_SIZE) -> dict[str, float]:
    """Log odds of the words that mark toxic rows; at most ``size`` words reach the driver."""
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(text_array(batch.column("text")).to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = list(set(words_of(text)))
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array(words), pa.array([label] * len(words))], ["word", "label"])

    totals = rows.agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = totals["toxic"] or 0.0, (totals["n"] or 0) - (totals["toxic"] or 0.0)
    if not toxic or not clean:
        return {}
    least = max(LEAST_ROWS, LEAST_SHARE * toxic)
    a, b = F.col("a"), F.col("b")
    rate = (F.col("a") + F.col("b")) / F.lit(toxic + clean)
    gain = a * F.log(a / (rate * toxic)) + F.when(b > 0, b * F.log(b / (rate * clean))).otherwise(0.0)
    odds = F.log((a + 0.5) / (toxic - a + 0.5)) - F.log((b + 0.5) / (clean - b + 0.5))
    # words of toxic rows only; counts are partially aggregated before the shuffle
    counted = (rows.mapInArrow(tidy(distinct), "word string, label double").groupBy("word")
               .agg(F.sum("label").alias("a"), (F.count(F.lit(1)) - F.sum("label")).alias("b")).filter(a >= least))
    best = counted.withColumn("odds", odds).filter("odds > 1.5").withColumn("gain", gain).orderBy(F.desc("gain"), "word").limit(size)
    return {r.word: r.odds for r in best.collect()}


def with_features(rows: DataFrame, lexicon: dict[str, float], keep: list[str], struct: str | None = None) -> DataFrame:
    """``keep`` columns and the array ``features`` of each row's ``text``, a column or a field of ``struct``."""
    schema = StructType([*(rows.schema[c] for c in keep), StructField("features", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = text_array(pc.struct_field(whole.column(struct), "text") if struct else whole.column("text"))
            for start, stop in slices(texts, 2 << 20):
                found = np.array([features(t.as_py(), lexicon) for t in texts.slice(start, stop - start)]).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(found) + 1, len(FEATURES)), pa.int32()), pa.array(found, pa.float64()))
                yield pa.RecordBatch.from_arrays([*(whole.column(c).slice(start, stop - start) for c in keep), lists], [*keep, "features"])

    return rows.mapInArrow(tidy(run), schema)


class ToxicityModel:
    """Lexicon, trees and calibration; ``score`` adds a score to any table of texts."""

    def __init__(self, lexicon: dict[str, float], trees, calibration, prior: float):
        self.lexicon, self.trees, self.calibration, self.prior = lexicon, trees, calibration, prior

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``doc_id, score`` of every whole text."""
        texts = doc_texts(docs, id_col, text_col)
        if self.trees is None:
            return texts.select("doc_id", F.lit(float(self.prior)).alias("score"))
        rows = with_features(texts, self.lexicon, ["doc_id"]).withColumn("features", array_to_vector("features"))
        raw = self.trees.transform(rows).withColumn("margin", vector_to_array("rawPrediction")[1])
        return self.calibration.transform(raw.select("doc_id", "margin")).select("doc_id", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS, lexicon_size: int = LEXICON_SIZE, label_col: str = "toxic") -> ToxicityModel:
    rows = materialize(fitting_rows(docs, labels, max_rows, label_col), "toxicity-rows")
    low, high = F.min("label").alias("low"), F.max("label").alias("high")
    totals = rows.agg(F.avg("label").alias("p"), low, high).first()
    if totals.low == totals.high:
        return ToxicityModel({}, None, None, totals.p or 0.0)
    # a quarter of the fitting rows calibrates; the lexicon and the trees see the rest
    part = F.pmod(F.xxhash64(F.lit("calibration"), F.col("doc_id")), F.lit(4)) == 0
    # at most two rows
    both = {r.calibrates for r in rows.groupBy(part.alias("calibrates")).agg(low, high).collect() if r.low != r.high}
    lexicon = learn_lexicon(rows.filter(~part) if False in both else rows, lexicon_size)
    table = materialize(with_features(rows.withColumn("calibrates", part), lexicon, ["label", "calibrates"]), "toxicity-features")
    table = table.withColumn("features", array_to_vector("features"))
    for_trees = table.filter("NOT calibrates") if False in both else table
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED, maxBins=32).fit(for_trees)
    for_margins = table.filter("calibrates") if True in both else table
    margins = trees.transform(for_margins).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(margins)
    return ToxicityModel(lexicon, trees, calibration, totals.p)


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = fit(docs, labels, max_rows).score(docs)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose text scores below the threshold, with all their columns.  A row is decided by
    its own text, so the features are computed beside the row and no join is needed.  Without labels of both
    classes nothing tells rows apart, and all stay."""
    model = fit(docs, labels)
    if model.trees is None:
        return docs
    # the row travels as one struct, whatever its columns are called
    packed = docs.select(F.struct("*").alias("row"))
    rows = with_features(packed, model.lexicon, ["row"], struct="row").withColumn("features", array_to_vector("features"))
    raw = model.trees.transform(rows).withColumn("margin", vector_to_array("rawPrediction")[1])
    scored = model.calibration.transform(raw.select("row", "margin"))
    return scored.filter(F.col("score") < threshold).select("row.*")
