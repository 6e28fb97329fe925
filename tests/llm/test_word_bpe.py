"""Ids of chunks by the short paths, and what the caches hold."""

from __future__ import annotations

import numpy as np

from textcohort.llm.word_bpe import WordEncoder, default_vocabulary

CHUNKS = ["Word", "word", "WORDS", "word,", "Été", "naïve.", "don't", "x86_64", "ab12", "ﬁn", "Straße", "İ", "a", "<unk>", "Zqxjkvbw", "1999", "…", "e-mail;"]


def test_chunks_have_the_ids_of_the_library():
    encoder = WordEncoder(default_vocabulary())
    for _ in range(2):      # computed, then from the caches
        for chunk in CHUNKS:
            assert np.frombuffer(encoder.chunk(chunk), "<u4").tolist() == encoder.tokenizer.encode(chunk, add_special_tokens=False).ids


def test_runs_of_letters_are_kept_once():
    encoder = WordEncoder(default_vocabulary())
    for chunk in ("Word", "word", "WORD", "Zqxjkvbw"):
        encoder.chunk(chunk)
    assert not encoder.chunks.young and sorted(encoder.pieces.young) == ["word", "zqxjkvbw"]
