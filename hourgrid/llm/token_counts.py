"""Token counts of whole texts with a public tokenizer."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.common import map_rows, strings

PIECE_CHARS = 32_768
BATCH_CHARS = 1_000_000

# A cut before white space that follows something else never divides a match of the pre-tokenizer, and
# neither does one between a letter and a digit.
_SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def split_long(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """Pieces of a text whose token counts add up to that of the whole; each cut is the first safe one
    after ``limit`` characters, so a text without safe places stays whole.
    """
    start = 0
    while len(text) - start > limit:
        cut = _SAFE.search(text, start + limit)
        if cut is None or cut.start() >= len(text):
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def batches_of(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Pieces of like total size, with the number of the text each belongs to."""
    pieces, owners, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in split_long(text) if len(text) > PIECE_CHARS else (text,):
            pieces.append(piece)
            owners.append(i)
            size += len(piece)
            if size >= BATCH_CHARS:
                yield pieces, owners
                pieces, owners, size = [], [], 0
    if pieces:
        yield pieces, owners


def count_tokens(texts: list[str], tokenizer_path: str) -> np.ndarray:
    encode = _tokenizer(tokenizer_path).encode_batch_fast
    counts = np.zeros(len(texts), np.int64)
    for pieces, owners in batches_of(texts):
        lengths = [len(e) for e in encode(pieces, add_special_tokens=False)]
        np.add.at(counts, owners, lengths)
    return counts


def add_token_counts(docs: DataFrame, tokenizer_path: str, limit: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text.

    Only lengths leave the Arrow function. Special strings inside a text are treated as the library does by
    default; nothing is cut, padded or added. A null text counts as empty: 0 bytes, 0 tokens. Rows are
    independent, so null and repeated ids and copies stay as they are; extra columns are not read; an
    empty table gives an empty one.
    """

    def count(batch: pa.RecordBatch) -> dict:
        counts = count_tokens(strings(batch), tokenizer_path)
        return {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": counts}

    sized = docs.select(
        F.col("doc_id").cast("long"),
        "text",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
    )
    counted = map_rows(sized, count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
