"""What the memo of words recomputes, and splits of words that are no plain letters."""

import itertools

import numpy as np
import public_tokenizers

from caregap.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_frequent_words_outlive_a_full_memo(spark, monkeypatch):
    """A word in every text is merged once, though rare words fill the memo again and again."""
    words = packing.WordIds(PATH)
    words.clear()
    monkeypatch.setattr(packing, "MEMO_WORDS", 20)
    merged = []
    merge = words.merge
    words.merge = lambda word: merged.append(word) or merge(word)
    rare = ("".join(x) for x in itertools.product("bcdfg", repeat=4))
    for word in itertools.islice(rare, 200):
        words.ids(f"frequent {word}")
    assert merged.count("frequent") == 1
    assert len(words) <= 20 and len(words.older) <= 20


def test_ascii_words_are_split_at_letters_digits_and_marks(spark):
    """All short words over letters, digits, marks and controls equal the library; their parts are asked, not the whole."""
    words = packing.WordIds(PATH)
    for size in (1, 2, 3, 4):
        for letters in itertools.product("aZ9.#'\r", repeat=size):
            word = "".join(letters)
            assert np.frombuffer(words.ids(word), "<u4").tolist() == words.library.encode(word, add_special_tokens=False).ids, repr(word)
    asked = []
    library = words._library
    words._library = lambda word: asked.append(word) or library(word)
    words.ids("card4929348385146306.end of<|endoftext|>text")
    assert [a for a in asked if len(a) > 1] == ["of<|endoftext|>text"]
