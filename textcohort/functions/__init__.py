from textcohort.functions.numeric import nan, safe_div, sigmoid, minmax_expr, score_bin
from textcohort.functions.text import (
    merge_columns, clean_text, normalise_word, tokenise, strip_ws, word_count,
    drop_tokens, trim_tail_chars, trim_tail_items, join_rounded,
)

__all__ = [
    "nan", "safe_div", "sigmoid", "minmax_expr", "score_bin",
    "merge_columns", "clean_text", "normalise_word", "tokenise", "strip_ws", "word_count",
    "drop_tokens", "trim_tail_chars", "trim_tail_items", "join_rounded",
]
