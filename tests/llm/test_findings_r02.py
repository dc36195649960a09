"""Cases of the review in FINDINGS_r02.md."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa

from docspark.llm import queries, token_output


class Counting:
    """The tokenizer; counts the words that it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.words = tokenizer, Counter()

    def encode_batch_fast(self, texts, **how):
        for t in texts:
            self.words.update(w.rstrip(token_output._TAIL) for w in t.split())
        return self.tokenizer.encode_batch_fast(texts, **how)

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)


def held_against_the_library(encoder, tokenizer, texts):
    ids, counts = encoder(texts, np.array([0], "<u4").tobytes())
    whole = [[*x.ids, 0] for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in whole] and ids.tolist() == [i for x in whole for i in x]


def test_op8_frequent_words_are_encoded_once(monkeypatch):
    """Also where rare ones fill the memory and the frequent ones return with other marks."""
    monkeypatch.setattr(token_output, "REMEMBERED_BYTES", 60_000)
    encoder = token_output._Encoder(queries.tokenizer_path())
    encoder.tokenizer = counting = Counting(encoder.tokenizer)
    common = [f"common{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    letters = np.random.default_rng(2).integers(97, 123, (6, 2000, 12), np.uint8)
    for marks, rare in zip([".", "!", ",,", "?!", "###", ":;"], letters, strict=True):
        text = " ".join(["start", *[w + marks for w in common * 3], *[bytes(w).decode() for w in rare]])
        held_against_the_library(encoder, counting.tokenizer, [text])
    assert {counting.words[w] for w in common} == {1}
    assert encoder.words.nbytes + encoder.ids.nbytes < 300_000


def test_op8_white_space_and_marks_equal_the_library():
    encoder = token_output._Encoder(queries.tokenizer_path())
    white = [c for c in map(chr, range(0x110000)) if c.isspace() or c in "᠎​⁠﻿"]
    texts = [t for c in white for t in (f"a {c}b", f"a{c} b", f"a{c}b c", f"{c} a", f"a {c}", f"a b{c}.", f" {c}{c} ")]
    last = ["è", "ß", "×", "÷", "À", "ā", "я", "中", "1", "²", "_", "'", "", "x́", "\U0001d400"]
    texts += [f"a b{x}{m} c{x}{m}" for x in last for m in (".", "...", "?!", "$%&#*:;", "§.", ".'s")]
    texts += ["", ".", " .", "a", "a ..", "a .. b", "a <|endoftext|>. <|endoftext|>.", "a x<|endoftext|>, b"]
    held_against_the_library(encoder, encoder.tokenizer, texts)
    ids, counts = encoder(pa.array(texts, pa.string()).slice(3, 50))
    assert ids.tolist() == encoder(texts[3:53])[0].tolist() and len(counts) == 50
