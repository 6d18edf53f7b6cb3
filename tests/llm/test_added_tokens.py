"""Added tokens count in the case they have."""

from __future__ import annotations

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from hourgrid.llm import token_files  # noqa: E402
from hourgrid.llm.common import vocabulary_path  # noqa: E402


def test_upper_case_added_tokens_are_plain_text():
    from tokenizers import Tokenizer

    path = vocabulary_path("word_bpe_49k.json")
    encode = Tokenizer.from_file(path).encode
    texts = [
        "a <|ENDOFTEXT|> b",
        "x<|StartOfText|>",
        "Ab<|endoftext|>CD <|EndOfText|><|startoftext|> E",
        "\x1cA <|ENDOFTEXT|>\x1d B <|endoftext|>",
        "a <|endoftext|> b",
    ]
    found = token_files._WordIds(path).of(texts)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [encode(t, add_special_tokens=False).ids for t in texts]
