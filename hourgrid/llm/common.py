"""Small helpers of the operators: Arrow batches, word hashes, file names of the public vocabularies."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
# What a Python worker remembers of each kind; workers are used again by later stages.
CACHE_ENTRIES = 100_000
# Longer words are not remembered: in scripts without spaces a word may be a paragraph.
KEPT_WORD = 64
# Bytes of text that a function gets at a time.
SLICE_BYTES = 2 << 20

Batches = Iterator[pa.RecordBatch]

_in_use: dict | None = None


def remember_in(cache: dict | None) -> None:
    """Say what this worker remembers things in from now on. What another operator has left there is emptied, so
    a worker that serves one stage after another holds one such table at a time.
    """
    global _in_use
    if _in_use is not cache:
        if _in_use is not None:
            _in_use.clear()
            pa.default_memory_pool().release_unused()
        _in_use = cache


def vocabulary_path(name: str) -> str:
    """The place of a public vocabulary file; the same package is installed on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def sliced(batches: Batches, column: str = "text", size: int | None = None) -> Batches:
    """The rows in batches of some SLICE_BYTES (or ``size``) of text, a longer text alone; so what is made of one batch stays small."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + (size or SLICE_BYTES), "right")))
            yield batch.slice(at, stop - at)
            at = stop


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``mapInArrow`` of a function from a batch to columns, in the order of ``schema``; texts come a few at a time."""

    def run(batches: Batches) -> Batches:
        for batch in sliced(batches) if has_text else batches:
            if batch.num_rows:
                yield as_batch(fn(batch))

    has_text = "text" in df.columns

    return df.mapInArrow(run, schema)


def as_batch(columns: dict) -> pa.RecordBatch:
    arrays = [v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def strings(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; a null id has none."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


FILTER_BITS = 24


def bitmap_of(df: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter with one hash, of a fixed size of 2 MB for any number of rows: which top FILTER_BITS bits
    the column's 64-bit hashes have.
    """
    word = F.shiftrightunsigned(column, 64 - FILTER_BITS + 6)
    bit = F.shiftrightunsigned(column, 64 - FILTER_BITS).bitwiseAND(F.lit(63))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))
    words = df.select(word.alias("word"), one.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return table


def may_be_in(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For unsigned 64-bit hashes, whether the filter has them; it may say so of others."""
    place = hashes >> np.uint64(64 - FILTER_BITS)
    return (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0


class WordHashes(dict):
    """64-bit hash of a word, kept for words seen lately."""

    def __init__(self, clean: Callable[[bytes], bytes] = bytes):
        super().__init__()
        self.clean = clean

    def __missing__(self, word: bytes) -> int:
        found = int.from_bytes(hashlib.blake2b(self.clean(word), digest_size=8).digest(), "little")
        if len(word) <= KEPT_WORD:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = found
        return found

    def of(self, text: str) -> np.ndarray:
        """Hashes of the words of a text, A-Z lower-cased."""
        remember_in(self)
        words = WORD.findall(text.encode("utf-8", "surrogatepass").translate(LOWER))
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` words, in order; a shorter text is one run; no words, none."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        found = np.full(n, np.uint64(width))
        for i in range(width):
            found = found * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
            found ^= found >> np.uint64(29)
    return mix(found)
