"""Words are kept without the marks that close them, and their ids are the library's."""

from __future__ import annotations

import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from hourgrid.llm import token_files  # noqa: E402
from hourgrid.llm.common import vocabulary_path  # noqa: E402

PIECES = [
    *"abzé ßÉİŁñ÷×жΣςम्漢²½٣7 .,;:!?'\"%&*()-_|<>«»—̸́​\xa0\x85\x0b\x0c\x1c\t\n\r ",
    "word", "l'été", "don't", "we'LL", "x's", "'s", "Å", "ﬁ", "<|endoftext|>", "<|EndOfText|>", "<|endoftext", "  ",
]


@pytest.fixture(scope="module")
def path():
    return vocabulary_path("word_bpe_49k.json")


def test_words_with_and_without_marks_are_one_unit(path):
    ids = token_files._WordIds(path)
    ids.of(["word word! Word?! word%%% eté& WORD 7!"])
    assert sorted(ids) == sorted(["word", "eté", "7", "!", "?!", "%%%", "&"])


def test_ids_are_those_of_the_library(path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "CACHE_ENTRIES", 300)
    encode, draw = Tokenizer.from_file(path).encode, random.Random(7)
    ids = token_files._WordIds(path)
    for _ in range(60):
        texts = ["".join(draw.choices(PIECES, k=draw.randrange(25))) for _ in range(50)]
        found = [np.frombuffer(f, "<u4").tolist() for f in ids.of(texts)]
        assert found == [encode(t, add_special_tokens=False).ids for t in texts]
