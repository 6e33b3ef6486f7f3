"""What the encoder of token ids hands to the tokenizers library, and what it keeps."""

from __future__ import annotations

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tickvault.llm import tokens

BOTH = pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])


class Counting:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.chars = tokenizer, 0

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **kw):
        self.chars += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **kw)


def counting(name, spaced):
    coder, fresh = tokens.PieceEncoder(P.path(name), spaced), Tokenizer.from_file(P.path(name))
    coder.tokenizer = Counting(coder.tokenizer)

    def given(texts):
        before = coder.tokenizer.chars
        assert [x.tolist() for x in coder.encode(texts)] == [fresh.encode(t, add_special_tokens=False).ids for t in texts]
        return coder.tokenizer.chars - before
    return given


@BOTH
def test_a_word_is_encoded_once_whatever_marks_follow(name, spaced):
    given = counting(name, spaced)
    assert given(["x incomprehensible x%%% x)."])
    assert given(["x incomprehensible%%% incomprehensible). incomprehensible"]) == 0


@BOTH
def test_a_full_table_keeps_the_parts_of_the_last_batch(name, spaced, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 12)
    given = counting(name, spaced)
    first, second = "x one two three four five", "x six seven eight nine ten"
    given([first + " eleven twelve"])
    assert given([second])
    assert given([second]) == 0
    assert given([first])


@BOTH
def test_long_parts_are_not_kept(name, spaced):
    given = counting(name, spaced)
    text = "x " + "y" * 200
    assert given([text]) and given([text]) >= 200
