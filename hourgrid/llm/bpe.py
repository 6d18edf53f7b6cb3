"""Byte-level BPE by a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hourgrid.llm.common import CACHE_ENTRIES, map_rows, remember_in, strings

KEPT_PIECE = 64


class RankQueue:
    """Positions by merge rank. A bitmap says which ranks have positions, 64 to a word, and a wider word above
    it which of those words are not empty; the lowest set bit of each leads to the next rank. Positions of a
    rank leave from left to right.
    """

    __slots__ = ("buckets", "top", "words")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.words: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        above = rank >> 6
        self.words[above] = self.words.get(above, 0) | 1 << (rank & 63)
        self.top |= 1 << above

    def pop(self) -> tuple[int, int] | None:
        top = self.top
        if not top:
            return None
        above = (top & -top).bit_length() - 1
        word = self.words[above]
        low = word & -word
        rank = above << 6 | low.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        word ^= low
        self.words[above] = word
        if not word:
            self.top = top & (top - 1)
        return rank, bucket.pop()


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank, leftmost first, is merged until none is left.

    Parts are a doubly linked list over byte positions. ``waiting`` holds the rank under which a pair was
    queued last, so an entry of a pair that has changed since is stale and skipped.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after, before, waiting = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
    queue, find = RankQueue(), ranks.get
    push, pop = queue.push, queue.pop
    for at in range(n - 1):
        rank = find(piece[at : at + 2])
        if rank is not None:
            waiting[at] = rank
            push(rank, at)
    while (entry := pop()) is not None:
        rank, at = entry
        if waiting[at] != rank:
            continue
        gone = after[at]
        after[at] = end = after[gone]
        waiting[gone] = waiting[at] = -1
        if end < n:
            before[end] = at
            rank = find(piece[at : after[end]])
            if rank is not None:
                waiting[at] = rank
                push(rank, at)
        left = before[at]
        if left >= 0:
            rank = find(piece[left:end])
            if rank is None:
                waiting[left] = -1
            elif rank != waiting[left]:
                waiting[left] = rank
                push(rank, left)
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


class PieceIds(dict):
    """Ids of short pre-tokens as little-endian 32-bit bytes, ``entries`` at most: when half of them are new, those that have not
    been met since the last time go.
    """

    def __init__(self, ranks: dict[bytes, int], entries: int):
        super().__init__()
        self.ranks, self.entries, self.earlier = ranks, entries, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.earlier.get(piece)
        if found is None:
            found = array("I", merge_piece(piece.encode("utf-8"), self.ranks)).tobytes()
        if len(piece) <= KEPT_PIECE:
            if 2 * len(self) >= self.entries:
                self.earlier = dict(self)
                super().clear()
            self[piece] = found
        return found

    def clear(self) -> None:
        super().clear()
        self.earlier = {}


@lru_cache(2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(2)
def _encoder(path: str, pattern: str, entries: int = CACHE_ENTRIES):
    pieces, cache = regex.compile(pattern), PieceIds(read_ranks(path), entries)

    def encode(text: str) -> bytes:
        remember_in(cache)
        return b"".join(map(cache.__getitem__, pieces.findall(text)))

    return encode


@lru_cache(2)
def _decoder(path: str):
    """From ids to bytes: all tokens lie one after another in one table, from which the ids' spans are taken together."""
    tokens = {rank: token for token, rank in read_ranks(path).items()}
    lengths = np.array([len(tokens.get(rank, b"")) for rank in range(max(tokens) + 1)], np.int64)
    table = np.frombuffer(b"".join(tokens[rank] for rank in sorted(tokens)), np.uint8)
    starts = np.cumsum(lengths) - lengths

    def decode(ids: bytes) -> bytes:
        found = np.frombuffer(ids, "<u4")
        own = lengths[found]
        place = np.cumsum(own) - own
        return table[np.arange(own.sum()) + np.repeat(starts[found] - place, own)].tobytes()

    return decode


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of every whole text as little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is merged by itself; strings of special tokens are ordinary text. A null or
    empty text has no ids (empty binary). Rows are independent: null and repeated ids and copies stay as
    they are, extra columns are not read, an empty table gives an empty one. Long pre-tokens take
    O(n log n) steps.
    """

    def encode(batch: pa.RecordBatch) -> dict:
        found = list(map(_encoder(ranks_path, pattern), strings(batch)))
        return {"doc_id": batch.column("doc_id"), "ids": pa.array(found, pa.binary())}

    return map_rows(docs.selectExpr("CAST(doc_id AS bigint) doc_id", "text"), encode, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, data): the bytes that the ids stand for."""

    def decode(batch: pa.RecordBatch) -> dict:
        data = list(map(_decoder(ranks_path), batch.column("ids").to_pylist()))
        return {"doc_id": batch.column("doc_id"), "ids": batch.column("ids"), "data": pa.array(data, pa.binary())}

    return map_rows(encoded.select("doc_id", "ids"), decode, "doc_id long, ids binary, data binary")




def round_trip(docs: DataFrame, ranks_path: str, pattern: str, remembered: int = CACHE_ENTRIES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): the ids of every whole text, and what they decode to,
    in one pass. Rows and texts are treated as in ``encode_documents``. A Python worker keeps the ids of
    ``remembered`` pre-tokens, some 200 bytes each.
    """

    def both(batch: pa.RecordBatch) -> dict:
        encode, decode = _encoder(ranks_path, pattern, remembered), _decoder(ranks_path)
        ids = list(map(encode, strings(batch)))
        return {
            "doc_id": batch.column("doc_id"),
            "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
            "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
            "decoded_sha256": [hashlib.sha256(decode(i)).hexdigest() for i in ids],
            "ids": pa.array(ids, pa.binary()),
        }

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"
    return map_rows(docs.selectExpr("CAST(doc_id AS bigint) doc_id", "text"), both, schema)
