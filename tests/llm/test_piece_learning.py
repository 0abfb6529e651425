"""Pieces are learned many at a time: each is looked at once, and ids are the library's."""

from __future__ import annotations

import random

import pytest

from quillspark.llm import tokens


@pytest.mark.parametrize(("name", "keep_space"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_are_looked_at_once(monkeypatch, name, keep_space):
    looked = []
    touches = tokens._touches_space
    monkeypatch.setattr(tokens, "_touches_space", lambda piece: looked.append(piece) or touches(piece))
    enc = tokens.Encoder(tokens.default_path(name), keep_space)
    whole = lambda texts: [e.ids for e in enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    plain = ["alpha Beta, gamma. été naïve; ÀÉ!", "beta alpha (x) Ünter... zz"]
    assert [a.tolist() for a in enc.encode(plain)] == whole(plain)
    assert all(b"(x)" in piece for piece in looked)
    rng = random.Random(7)
    bits = ["word", "Été", "ÇA", "don't", "x,", "é.", "--", "<|endoftext|>", "<|", "\n", "\n\n", "  ", "\t", " ", "日本", "ß×÷", "12", "a1", "longer" * 8, "end" * 12 + "!", "", "Σ", "\x1e"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", " ", " ", ""]) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    monkeypatch.setattr(tokens, "MEMORY_PIECES", 60)  # so that pieces come back from the older memory
    for at in range(0, len(texts), 50):
        assert [a.tolist() for a in enc.encode(texts[at : at + 50])] == whole(texts[at : at + 50])
    assert max(map(len, enc.young)) <= tokens.MEMORY_PIECE_BYTES
