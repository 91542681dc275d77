import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from trackloom.llm import packing
from trackloom.llm.packing import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_those_of_the_plain_tokenizer():
    plain, words = Tokenizer.from_file(PATH), WordIds(PATH)
    rng = random.Random(5)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "Some", "words,", ".", " ", "\n", "İ", "é", "é", "\x01", "X<", "it's", "　", "12", "<|endoftext"]
    texts = ["some words <|endoftext|> more", "a<|endoftext|>b, <|EndOfText|>. <|startoftext|>,", *("".join(rng.choices(parts, k=rng.randrange(1, 15))) for _ in range(3000))]
    for text in texts:
        assert np.frombuffer(words.ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert np.frombuffer(words.ids(texts[0]), "<u4").tolist() == [836, 2709, 49407, 750]


def test_texts_with_more_words_than_are_kept(monkeypatch):
    """However few words are kept, each text ends, and its ids are the tokenizer's."""
    tokenizer = Tokenizer.from_file(PATH)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcde,.") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    for most in (0, 1, 3, 20):
        monkeypatch.setattr(packing, "KNOWN_WORDS", most)
        words = packing.WordIds(PATH)
        for text in texts:
            assert np.frombuffer(words.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
            assert len(words) <= most
