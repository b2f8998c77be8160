"""New words are encoded many at a time, with the ids of whole-text encoding."""

import random

import pytest

from sparkveil.llm.queries import tokenizer_path
from sparkveil.llm.word_tokens import WordEncoder

BOTH = pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])


class Counted:
    """A tokenizer that counts the strings given to it."""

    def __init__(self, tokenizer):
        self.tokenizer, self.strings = tokenizer, 0

    def encode_batch_fast(self, strings, **options):
        self.strings += len(strings)
        return self.tokenizer.encode_batch_fast(strings, **options)

    def encode(self, text, **options):
        self.strings += 1
        return self.tokenizer.encode(text, **options)


@BOTH
def test_new_words_are_encoded_together(name, spaces):
    rng = random.Random(3)
    bag = ["".join(rng.choice("abcdeéß") for _ in range(9)) + rng.choice(["", "", ",", ".", "1", "%%"]) for _ in range(3000)]
    texts = [rng.choice([" ", "\n"]).join(bag[k : k + 30]) for k in range(0, len(bag), 30)]
    e = WordEncoder(tokenizer_path(name), spaces)
    want = [e.whole(t) for t in texts]
    e.tokenizer = Counted(e.tokenizer)
    assert e.encode(texts) == want
    assert e.tokenizer.strings < 20


@BOTH
def test_odd_words_among_joined_ones(name, spaces):
    rng = random.Random(4)
    texts = ["\n", "\na", "a\n", " \na", "a\n b", "\x01", "a \x01 b", "a\x01\nb", "\x01 \x01"]
    texts += ["".join(rng.choice("abAé.,'1½ \n \n\t\x01\x1c\x85　́漢🙂") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    e = WordEncoder(tokenizer_path(name), spaces)
    assert e.encode(texts) == [e.whole(t) for t in texts]


class Looked(dict):
    """A cache that counts what is taken from it."""

    looked = 0

    def __getitem__(self, key):
        self.looked += 1
        return super().__getitem__(key)


@BOTH
def test_repeated_words_are_looked_up_once(name, spaces):
    e = WordEncoder(tokenizer_path(name), spaces)
    e.cache = Looked()
    texts = ["of the end, and of it " * 500 + "x"] * 3
    assert e.encode(texts) == [e.whole(t) for t in texts]
    assert e.cache.looked < 20


@BOTH
def test_batches_without_words(name, spaces):
    e = WordEncoder(tokenizer_path(name), spaces)
    for texts in ([], [""], ["", " "], ["\n"], ["<|endoftext|>"]):
        assert e.encode(texts) == [e.whole(t) for t in texts]
