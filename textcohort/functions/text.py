"""Text column helpers: merge, clean, tokenise, normalise, stop-list, trims.

All of them are built-in Spark expressions (JVM side, inside whole-stage codegen).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a missing comment is spelled after merging, the merge separator,
# and the sentinel of a row whose four comments are all missing.
MISSING_TEXT = "nan"
MERGE_SEP = "|"
EMPTY_MERGED_4 = "nan|nan|nan|nan"

# The literal replacement chain of the example report, in the order applied.
CLEAN_RULES_BASE = [("|", " "), ("nan", ""), ("!", " !"), (" .", "."), ("  ", " ")]
CLEAN_RULES_SLASH = [("|", " "), ("nan", ""), ("!", " !"), ("  ", " "), ("/", " / ")]
CLEAN_RULES_SHORT = [("|", " "), ("nan", ""), ("!", " !")]
CLEAN_RULES_MIN = [("|", " "), ("nan", "")]

# Token pattern: a run of letters/digits, or one other non-space character.
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def merge_columns(cols: Sequence, sep: str = MERGE_SEP, missing: str = MISSING_TEXT) -> Column:
    """Join columns with ``sep``; a null becomes ``missing`` (``concat_ws`` alone skips nulls)."""
    return F.concat_ws(sep, *[F.coalesce(_c(c).cast("string"), F.lit(missing)) for c in cols])


def strip_ws(text, left: bool = True, right: bool = True) -> Column:
    """Strip whitespace (not just spaces, unlike ``trim``) from one or both ends."""
    parts = []
    if left:
        parts.append(r"^\s+")
    if right:
        parts.append(r"\s+$")
    return F.regexp_replace(_c(text), "|".join(parts), "")


def clean_text(text, rules: Iterable[tuple[str, str]] = CLEAN_RULES_BASE,
               strip: str = "both") -> Column:
    """Apply literal (non-regex) replacements in order, then strip whitespace."""
    out = _c(text)
    for old, new in rules:
        out = F.replace(out, F.lit(old), F.lit(new))
    if strip == "both":
        out = strip_ws(out)
    elif strip == "right":
        out = strip_ws(out, left=False)
    return out


def normalise_word(token) -> Column:
    """Remove spaces, lower-case, then spell the lone pronoun ``i`` as ``I``."""
    w = F.lower(F.replace(_c(token), F.lit(" "), F.lit("")))
    return F.when(w == F.lit("i"), F.lit("I")).otherwise(w)


def tokenise(text) -> Column:
    """Whole-text word/punctuation tokens of the lower-cased text, as ``array<string>``."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_PATTERN), 0)


def word_count(text) -> Column:
    """Number of pieces when splitting on a single space (empty pieces count)."""
    return F.size(F.split(_c(text), " ", -1))


def drop_tokens(tokens, stop: Sequence[str]) -> Column:
    """Drop the listed exact tokens from an array, keeping order."""
    stop_arr = F.array(*[F.lit(s) for s in stop]) if stop else F.array().cast("array<string>")
    return F.filter(_c(tokens), lambda t: ~F.array_contains(stop_arr, t))


def trim_tail_chars(text, n: int) -> Column:
    """``text[:-n]`` (all but the last ``n`` characters)."""
    t = _c(text)
    return F.substring(t, F.lit(1), F.greatest(F.length(t) - F.lit(n), F.lit(0)))


def trim_tail_items(arr, n: int) -> Column:
    """``arr[:-n]`` (all but the last ``n`` elements)."""
    a = _c(arr)
    return F.when(F.size(a) > n, F.slice(a, F.lit(1), F.size(a) - F.lit(n))).otherwise(
        F.slice(a, F.lit(1), F.lit(0)))


def join_rounded(values, digits: int = 3, sep: str = " ") -> Column:
    """Round each double half-even to ``digits`` and join their string forms."""
    return F.array_join(F.transform(_c(values), lambda v: F.bround(v, digits).cast("string")), sep)
