"""Homomorphic multiset fingerprints of documents."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.llm.common import Batches, as_batch, strings
from hourgrid.sources.scratch import store

LANES = 128
# Code points of a text that help to divide the rows of one id.
BEGINNING = 64
_CUT = re.compile(r"\n|(?<=[.!?]) ")

_ROW = """doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,
  near_edited double, near_next double"""
_EDGE = "bucket int, role string, edge_id long, text string"


def paragraphs(text: str) -> list[bytes]:
    """The multiset that is hashed: lines, long lines cut after a sentence's end; empty pieces do not count."""
    return [p.encode("utf-8", "surrogatepass") for p in _CUT.split(text) if p]


def vectors(pieces: list[bytes]) -> np.ndarray:
    """One vector a paragraph: LANES odd numbers from -15 to 15, from a 512-bit hash, modulo 2^32."""
    raw = b"".join(hashlib.blake2b(p, digest_size=LANES // 2).digest() for p in pieces)
    halves = np.frombuffer(raw, np.uint8).reshape(len(pieces), LANES // 2)
    lanes = np.empty((len(pieces), LANES), np.int32)
    lanes[:, 0::2], lanes[:, 1::2] = halves & 15, halves >> 4
    return lanes * 2 - 15


def fingerprints(texts: list[str]) -> np.ndarray:
    """The sums of the paragraphs' vectors, a row for each text (int32, wrapping)."""
    found = np.zeros((len(texts), LANES), np.int32)
    pieces = [paragraphs(t) for t in texts]
    at = 0
    while at < len(texts):
        end, count = at, 0
        while end < len(texts) and (end == at or count + len(pieces[end]) <= 20_000):
            count += len(pieces[end])
            end += 1
        owners = np.repeat(np.arange(at, end), [len(p) for p in pieces[at:end]])
        if count:
            lanes = vectors([p for one in pieces[at:end] for p in one])
            starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
            found[owners[starts]] = np.add.reduceat(lanes, starts, axis=0, dtype=np.int32)
        at = end
    return found


def insert(fingerprint: str, paragraph: str) -> str:
    return to_text(from_text(fingerprint) + fingerprints([paragraph])[0])


def delete(fingerprint: str, paragraph: str) -> str:
    return to_text(from_text(fingerprint) - fingerprints([paragraph])[0])


def combine(left: str, right: str) -> str:
    """The fingerprint of both multisets together."""
    return to_text(from_text(left) + from_text(right))


def to_text(lanes: np.ndarray) -> str:
    return lanes.astype("<i4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), "<i4")


def likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimated cosine of the two multisets, 0 to 1, by rows: the lanes are independent signed projections,
    so products of sums estimate the shared weight. Equal fingerprints give 1, also two empty ones; an
    empty and another one give 0.
    """
    a, b = left.astype(np.float64), right.astype(np.float64)
    size = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    cosine = np.divide((a * b).sum(1), size, out=np.zeros(len(a)), where=size > 0)
    same = (left == right).all(1)
    return np.where(same, 1.0, np.clip(cosine, 0.0, 1.0 - 1e-9))


def edited(text: str, following: str) -> str:
    """The last third of the code points gives way to the first as many of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _pairs(ids: list, texts: list[str], prints: np.ndarray) -> dict:
    """Result rows of all texts but the last, each with the one after it."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    new = fingerprints(changed)
    return {
        "doc_id": pa.array(ids[:-1], pa.int64()),
        "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        "fingerprint": [to_text(f) for f in prints[:-1]],
        "edited_fingerprint": [to_text(f) for f in new],
        "near_edited": likeness(prints[:-1], new),
        "near_next": likeness(prints[:-1], prints[1:]),
    }


def _edges(role: str, bucket: int, doc_id: int | None, text: str, empty: dict) -> pa.RecordBatch:
    columns = {k: pa.nulls(1, v) for k, v in empty.items()}
    edge = {"bucket": pa.array([bucket], pa.int32()), "role": [role], "edge_id": pa.array([doc_id], pa.int64()), "text": [text]}
    return as_batch({**columns, **edge})


_TYPES = {
    "doc_id": pa.int64(),
    "n_chars": pa.int64(),
    "edited_sha256": pa.string(),
    "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(),
    "near_next": pa.float64(),
}


def _walk(batches: Batches) -> Batches:
    """Along one range of documents in descending order: a row for each neighbouring pair, and the two ends."""
    context = TaskContext.get()
    bucket = context.partitionId() if context else 0
    ids: list = []
    texts: list[str] = []
    prints = np.zeros((0, LANES), np.int32)
    for batch in batches:
        size = batch.num_rows
        for at in range(0, size, 500):
            part = batch.slice(at, 500)
            new = strings(part)
            if not ids:
                yield _edges("head", bucket, part.column("doc_id")[0].as_py(), new[0], _TYPES)
            ids = ids[-1:] + part.column("doc_id").to_pylist()
            texts = texts[-1:] + new
            prints = np.vstack([prints[-1:], fingerprints(new)])
            n = len(ids) - 1
            if n:
                edge = {"bucket": pa.nulls(n, pa.int32()), "role": ["row"] * n, "edge_id": pa.nulls(n, pa.int64()), "text": pa.nulls(n, pa.string())}
                yield as_batch({**_pairs(ids, texts, prints), **edge})
    if ids:
        yield _edges("tail", bucket, ids[-1], texts[-1], _TYPES)


def _close(batches: Batches) -> Batches:
    """The pair that straddles two ranges."""
    for batch in batches:
        rows = zip(batch.column("edge_id").to_pylist(), strings(batch), strings(batch, "next_text"))
        for doc_id, text, following in rows:
            yield as_batch(_pairs([doc_id, None], [text, following], fingerprints([text, following])))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edit with the next document's, with their likeness.

    Next is the next lower doc_id; null ids come last, equal ids are ordered by descending text, and after the last comes the first, so
    a single document is followed by itself. A null text counts as empty. Equal texts, and texts whose
    paragraphs are equal in another order, have equal fingerprints. Extra columns are not read; an empty
    table gives an empty one.

    Documents are sorted by range of id and beginning of the text, not into one partition; what crosses two ranges is their
    first and last document, two rows a range, kept in a stored table.
    """
    order = [F.desc_nulls_last("doc_id"), F.desc_nulls_last("text")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The texts' beginnings divide the rows of one id too, in the same order.
    ranged = texts.repartitionByRange(order[0], F.desc(F.substring("text", 1, BEGINNING))).sortWithinPartitions(*order)
    walked = store(ranged.mapInArrow(_walk, f"{_ROW}, {_EDGE}"), "fingerprints")
    rows = walked.where("role = 'row'").drop("bucket", "role", "edge_id", "text")
    heads = walked.where("role = 'head'").select("bucket", F.col("text").alias("next_text"))
    tails = walked.where("role = 'tail'").select("bucket", "edge_id", "text")
    # The numbers of the ranges that have rows, without texts: one for each partition.
    numbers = Window.partitionBy(F.lit(0)).orderBy("bucket")
    whole = numbers.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead("bucket").over(numbers), F.first("bucket").over(whole))
    pairs = heads.select("bucket").withColumn("next_bucket", following)
    ring = tails.join(pairs, "bucket").join(heads.withColumnRenamed("bucket", "next_bucket"), "next_bucket").select("edge_id", "text", "next_text")
    return rows.unionByName(ring.mapInArrow(_close, _ROW))
