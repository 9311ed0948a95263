import os
import random

import numpy as np
import pytest

from tidemark.llm import tokens

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder(tokens.default_tokenizer())


def ids(enc, text):
    return np.frombuffer(enc.encode(text), "<u4").tolist()


def test_encode_equals_the_library_on_mixed_texts(enc):
    rng = random.Random(4)
    alphabet = "abcXYZéÉßñÑçÀ'’stredvml0123²½ .,;!?-_#<|>\t\n\x0b\x1c\x85\xa0 ́İΣσς语カ😀ﬁǅ"
    pieces = ["don't", "it's", "WE'LL", "<|endoftext|>", "a<|startoftext|>b", "x" * 70, "Übergröße", "naïve.", "İstanbul", "ΟΔΟΣ", "éa", "3.14", "___", "a_b", "'S", "é", "ª", "Å"]
    for _ in range(3000):
        text = "".join(rng.choice([rng.choice(alphabet), rng.choice(pieces), " "]) for _ in range(rng.randrange(1, 14)))
        assert ids(enc, text) == enc.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_character_of_the_basic_plane(enc):
    for code in [*range(0, 0x3100), *range(0xFB00, 0xFFFE)]:
        text = f"a{chr(code)}B"
        assert ids(enc, text) == enc.tokenizer.encode(text, add_special_tokens=False).ids, hex(code)


def test_empty_and_blank(enc):
    assert ids(enc, "") == [] and ids(enc, " \n\t ") == []
