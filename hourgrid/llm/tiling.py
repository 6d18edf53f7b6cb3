"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.common import Batches, WordHashes, as_batch, bitmap_of, map_rows, may_be_in, shingles, sliced, strings
from hourgrid.sources.scratch import store

MIN_TILE = 5
COVERAGE = 0.5
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_WORDS = WordHashes(lambda word: word.strip(_PUNCTUATION) or word)


def tokens(text: str) -> np.ndarray:
    """Hashes of the words, A-Z lower-cased, without ASCII punctuation around them."""
    return _WORDS.of(text)


def tiles(item: np.ndarray, doc: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """(item position, document position, length) of a greedy tiling, longest tiles first.

    Again and again the longest match of unmarked tokens is marked on both sides; of equally long ones the first in
    the item, then in the document. Matches start where Karp-Rabin hashes of ``least`` tokens agree and the tokens do.
    Such places lie on diagonals; a match is a run of them, as long as the run and ``least`` - 1 tokens more. A round looks at
    all places as arrays.
    """
    if len(item) < least or len(doc) < least:
        return []
    i, j = _seeds(item, doc, least)
    marked_item, marked_doc = np.zeros(len(item) + 1, np.int64), np.zeros(len(doc) + 1, np.int64)
    found = []
    while len(i):
        before_item, before_doc = np.cumsum(marked_item) - marked_item, np.cumsum(marked_doc) - marked_doc
        free = (before_item[i + least] == before_item[i]) & (before_doc[j + least] == before_doc[j])
        i, j = i[free], j[free]
        if not len(i):
            break
        last = np.flatnonzero(np.append((np.diff(i) != 1) | (np.diff(j) != 1), True))
        ends = i[last[np.searchsorted(last, np.arange(len(i)))]]
        length = ends - i + least
        best = int(length.max())
        x, y = i[length == best], j[length == best]
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        while len(x):
            at, there = int(x[0]), int(y[0])
            marked_item[at : at + best] = marked_doc[there : there + best] = 1
            found.append((at, there, best))
            apart = (np.abs(x - at) >= best) & (np.abs(y - there) >= best)
            x, y = x[apart], y[apart]
    return found


def _seeds(item: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in both where ``least`` tokens agree, by diagonal and along it."""
    of_item, of_doc = shingles(item, least), shingles(doc, least)
    order = np.argsort(of_doc, kind="stable")
    low = np.searchsorted(of_doc, of_item, "left", sorter=order)
    count = np.searchsorted(of_doc, of_item, "right", sorter=order) - low
    i = np.repeat(np.arange(len(of_item)), count)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
    same = np.ones(len(i), bool)
    for k in range(least):
        same &= item[i + k] == doc[j + k]
    i, j = i[same], j[same]
    along = np.lexsort((i, j - i))
    return i[along], j[along]


def _item_seeds(batch: pa.RecordBatch) -> dict:
    items, keys, places, seeds, sizes = [], [], [], [], []
    for item_id, key, text in zip(batch.column("item_id").to_pylist(), batch.column("item_key").to_pylist(), strings(batch)):
        words = tokens(text)
        if len(words) >= MIN_TILE:
            own = shingles(words, MIN_TILE).view(np.int64)
            items += [item_id] * len(own)
            keys += [key] * len(own)
            sizes += [len(words)] * len(own)
            places += range(len(own))
            seeds += own.tolist()
    return {
        "item_id": pa.array(items, pa.int64()),
        "item_key": pa.array(keys, pa.int64()),
        "place": pa.array(places, pa.int32()),
        "n_words": pa.array(sizes, pa.int32()),
        "seed": pa.array(seeds, pa.int64()),
    }


def _hits(shared):
    def run(batches: Batches) -> Batches:
        """Documents with a seed that may be one of the benchmark's, and those seeds."""
        table = shared.value
        for batch in sliced(batches):
            rows, seeds = [], []
            for i, text in enumerate(strings(batch)):
                words = tokens(text)
                if len(words) >= MIN_TILE:
                    own = shingles(words, MIN_TILE)
                    hit = own[may_be_in(table, own)]
                    if len(hit):
                        rows.append(i)
                        seeds.append(np.unique(hit).view(np.int64))
            if rows:
                kept = batch.take(pa.array(rows))
                columns = {c: kept.column(c) for c in ("doc_id", "doc_key", "text")}
                yield as_batch({**columns, "seeds": pa.array(seeds, pa.list_(pa.int64()))})

    return run


def _tile(batch: pa.RecordBatch) -> dict:
    out: dict[str, list] = {"coverage": [], "n_tiles": [], "longest": [], "item_starts": [], "doc_starts": [], "lengths": []}
    last, words = None, None
    for text, item in zip(strings(batch), strings(batch, "item_text")):
        if text != last:
            last, words = text, tokens(text)
        parts = tokens(item)
        found = tiles(parts, words)
        out["coverage"].append(sum(n for _, _, n in found) / max(1, len(parts)))
        out["n_tiles"].append(len(found))
        out["longest"].append(found[0][2] if found else 0)
        for k, name in enumerate(("item_starts", "doc_starts", "lengths")):
            out[name].append([t[k] for t in found])
    types = (pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()))
    return {c: batch.column(c) for c in ("doc_id", "doc_key", "item_id")} | {k: pa.array(v, t) for (k, v), t in zip(out.items(), types)}


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, doc_key, item_id, coverage, n_tiles, longest, item_starts, doc_starts, lengths), a row for each
    document and item of whose words the document's tiles cover at least ``coverage``.

    Tiles are runs of MIN_TILE common words at least, in any order, none overlapping. An item under MIN_TILE words
    never matches, nor does a null or empty text. An item with a null id counts; its rows have a null item_id. Rows with a null or repeated doc_id are separate documents, told apart by doc_key (a hash
    of the text); repeated rows give one row an item. Items with the same id and text are one; with the same id
    and different texts, each is tried. Extra columns are not read; an empty table on either side gives an
    empty one.

    Documents are read once; those with a seed that passes the filter are stored. Seeds are joined exactly. A pair is
    tiled only if its shared seeds can cover enough: a tile of t words has t - MIN_TILE + 1 of them.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = items.withColumn("item_key", F.xxhash64("text"))
    seeds = store(map_rows(items.select("item_id", "item_key", "text"), _item_seeds, "item_id long, item_key long, place int, n_words int, seed long"), "item-seeds")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(seeds, "seed"))
    schema = "doc_id long, doc_key long, text string, seeds array<long>"
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("doc_key"), "text")
    hits = store(texts.mapInArrow(_hits(shared), schema), "hit-documents")
    places = seeds.groupBy("seed", "item_id", "item_key", "n_words").agg(F.count("*").alias("places"))
    candidates = (
        hits.select("doc_id", "doc_key", F.explode("seeds").alias("seed"))
        .distinct()
        .join(places, "seed")
        .groupBy("doc_id", "doc_key", "item_id", "item_key", "n_words")
        .agg(F.sum("places").alias("places"))
        .where(F.col("places") * MIN_TILE >= coverage * F.col("n_words"))
        .select("doc_id", "doc_key", "item_id", "item_key")
        .distinct()
    )
    candidates = store(candidates, "candidate-pairs")
    once = hits.select("doc_id", "doc_key", "text").dropDuplicates(["doc_id", "doc_key"])
    same = once["doc_id"].eqNullSafe(candidates["doc_id"]) & (once["doc_key"] == candidates["doc_key"])
    pairs = once.join(candidates, same).select(once["doc_id"], once["doc_key"], "text", candidates["item_id"], "item_key")
    named = items.select(F.col("item_id").alias("own_id"), F.col("item_key").alias("own_key"), F.col("text").alias("item_text"))
    full = pairs.join(named, (F.col("item_key") == F.col("own_key")) & F.col("item_id").eqNullSafe(F.col("own_id"))).drop("own_id", "own_key")
    schema = """doc_id long, doc_key long, item_id long, coverage double, n_tiles int, longest int,
      item_starts array<int>, doc_starts array<int>, lengths array<int>"""
    return map_rows(full, _tile, schema).where(F.col("coverage") >= coverage)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that cover no item enough, with all their columns."""
    found = store(contaminated(docs, benchmark).select("doc_id", "doc_key").distinct(), "contaminated")
    same = docs["doc_id"].cast("long").eqNullSafe(found["doc_id"]) & (F.xxhash64(docs["text"]) == found["doc_key"])
    return docs.join(found, same, "left_anti")
