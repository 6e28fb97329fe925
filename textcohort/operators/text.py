"""Token tables.  A text is tokenised once, whatever the number of folds that use it.

The table that fits, scores and attributions read has one row per text (``text_terms``), with the text's folds beside its
tokens: a stage unfolds the texts it needs and joins nothing by text.  It is ordinary Parquet in parts of a bounded number
of bytes, so it has no limit on the number of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcohort.functions.text import tokenise, word_count


def doc_tokens(docs: DataFrame, id_col: str = "id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``(id, tokens)`` — whole-text token arrays — and the columns ``keep`` before them."""
    return docs.select(*keep, F.col(id_col).alias("id"), tokenise(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))


def token_positions(tokens: DataFrame) -> DataFrame:
    """``(id, pos, token)`` — one row per token occurrence (0-based positions)."""
    return tokens.select("id", F.posexplode("tokens").alias("pos", "token"))


def token_counts(tokens: DataFrame) -> DataFrame:
    """``(id, token, tf, n_tok, positions)``: term counts per text, the text's token count, and
    the token's positions in the text (so occurrences never need the token arrays again).

    On rows that are already dealt by ``id`` the grouping needs no shuffle of its own.  Otherwise the
    explode is narrow, so the partial aggregate combines each text's tokens before the shuffle; a
    frequent word costs one row per text, and its position list is bounded by that text's length.
    """
    occ = tokens.select("id", F.size("tokens").alias("n_tok"), F.posexplode("tokens").alias("pos", "token"))
    return occ.groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"), F.first("n_tok").alias("n_tok"),
                                          F.array_sort(F.collect_list("pos")).alias("positions"))


def text_terms(counts: DataFrame) -> DataFrame:
    """``(id, n_tok, terms, places)``: one row per text that has tokens; ``terms`` an array of ``(token, tf)``, ``places`` the
    positions of each.  On counts that are dealt by ``id`` this needs no shuffle; an array is bounded by its text."""
    whole = counts.groupBy("id").agg(F.first("n_tok").alias("n_tok"), F.collect_list(F.struct("token", "tf", "positions")).alias("_t"))
    return whole.select("id", "n_tok", F.transform("_t", lambda t: F.struct(t["token"].alias("token"), t["tf"].alias("tf"))).alias("terms"),
                        F.col("_t.positions").alias("places"))


def unfold(rows: DataFrame, texts: DataFrame | None = None, positions: bool = False) -> DataFrame:
    """``rows`` with one row per distinct token of their text: ``n_tok, token, tf`` and, if wanted, ``positions``.

    Rows that carry ``terms`` are unfolded as they are.  Others first meet the texts (one row per text) by ``id``, so the tokens
    themselves are never joined or shuffled; a flat token table is joined as it is.  Positions are a column of their own,
    which is read only where they are wanted."""
    if "terms" not in rows.columns:
        if "terms" not in texts.columns:
            return rows.join(texts, "id")
        rows = rows.join(texts.select("id", "n_tok", "terms", "places"), "id")
    others = [c for c in rows.columns if c not in ("terms", "places")]
    if positions:
        both = rows.select(*others, F.explode(F.arrays_zip("terms", "places")).alias("_both"))
        return both.select(*others, "_both.terms.token", "_both.terms.tf", F.col("_both.places").alias("positions"))
    return rows.select(*others, F.explode("terms").alias("_term")).select(*others, "_term.token", "_term.tf")


def word_token_check(docs: DataFrame, tokens_col: str = "tokens", text_col: str = "text") -> DataFrame:
    """Words (single-space split of the text) against tokens, per row."""
    return docs.withColumn("n_words", word_count(F.col(text_col))) \
               .withColumn("n_tokens", F.size(tokens_col)) \
               .withColumn("consistent", F.col("n_words") == F.col("n_tokens"))
