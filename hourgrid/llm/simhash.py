"""Near-duplicate documents by 64-bit SimHash; close fingerprints by a self-join of their binary trie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.common import LOWER, WORD, Batches, as_batch, map_rows, strings
from hourgrid.llm.components import components
from hourgrid.sources.scratch import store

WIDTH = 4
SEED = 42
BITS = 64
BUDGET = 4
# Fingerprints below a node that is not divided any more, and pairs of nodes looked at together.
BUCKET = 16
FRONTIER = 1 << 14
# A shard of the trie has at most so many fingerprints (32 MB); smaller tables have about LEAST_SHARDS shards, but for very small ones.
SHARD = 1 << 22
LEAST_SHARDS, LEAST_SHARD = 64, 1 << 10
HASHED_TOGETHER = 1 << 16


def shingle_hashes(text: str) -> Iterator[np.ndarray]:
    """XXH64 of the space-joined runs of WIDTH words, repeats included, some thousands at a time."""
    words = WORD.findall(text.encode("utf-8", "surrogatepass").translate(LOWER))
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, width = ends - lengths, min(WIDTH, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), HASHED_TOGETHER):
        cuts = zip(starts[at : at + HASHED_TOGETHER].tolist(), ends[at : at + HASHED_TOGETHER].tolist())
        yield np.array([digest(joined[a:b], SEED) for a, b in cuts], np.uint64)


def fingerprint(text: str) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; 0 without words."""
    total, ones = 0, np.zeros(BITS, np.int64)
    for hashes in shingle_hashes(text):
        total += len(hashes)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0]) if total else 0


def _fingerprints(batch: pa.RecordBatch) -> dict:
    found = np.fromiter(map(fingerprint, strings(batch)), np.uint64, batch.num_rows)
    return {"doc_id": batch.column("doc_id"), "fp": found.view(np.int64)}


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    high, low = values >> np.uint64(32), values & np.uint64(0xFFFFFFFF)
    length = lambda part: np.frexp(part.astype(np.float64))[1]
    return np.where(high > 0, length(high) + 32, length(low)).astype(np.uint8)


class Trie:
    """A path-compressed binary trie over sorted distinct fingerprints.

    Node i covers ``values[start[i]:stop[i]]``, which agree in their first ``depth[i]`` bits; ``left`` and ``right``
    are -1 below a node of up to BUCKET fingerprints, whose places are column ``bucket[i]`` of ``places``.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        start, stop = [np.zeros(1, np.int64)], [np.full(1, len(values), np.int64)]
        left, right, made = [], [], 1
        while len(start[-1]):
            lo, hi = start[-1], stop[-1]
            wide = hi - lo > BUCKET
            first, last = values[lo[wide]], values[hi[wide] - 1]
            bit = (_bit_lengths(first ^ last) - 1).astype(np.uint64)
            middle = np.searchsorted(values, (last >> bit) << bit)
            below = np.full(len(lo), -1, np.int64)
            below[wide] = made + 2 * np.arange(len(middle))
            left.append(below)
            right.append(np.where(wide, below + 1, -1))
            start.append(np.stack([lo[wide], middle], 1).ravel())
            stop.append(np.stack([middle, hi[wide]], 1).ravel())
            made += 2 * len(middle)
        self.start, self.stop = np.concatenate(start), np.concatenate(stop)
        self.left, self.right = np.concatenate(left), np.concatenate(right)
        self.first = values[self.start]
        self.depth = (BITS - _bit_lengths(self.first ^ values[self.stop - 1])).astype(np.uint64)
        leaves = np.flatnonzero(self.left < 0)
        self.bucket = np.full(made, -1, np.int64)
        self.bucket[leaves] = np.arange(len(leaves))
        # Short buckets repeat their last value.
        self.places = np.minimum(self.start[leaves] + np.arange(BUCKET)[:, None], self.stop[leaves] - 1)
        self.lower = values[self.places].astype(np.uint32)


def _within(a: Trie, b: Trie, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which node pairs differ in at most BUDGET of the bits that both have in common with all below."""
    depth = np.minimum(a.depth[u], b.depth[v])
    # A shift by all 64 bits isn't defined, hence two.
    gone = np.uint64(BITS) - depth
    differing = (a.first[u] ^ b.first[v]) >> (gone >> np.uint64(1)) >> (gone - (gone >> np.uint64(1)))
    return np.bitwise_count(differing) <= BUDGET


def _close_in(a: Trie, b: Trie, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the close fingerprints of pairs of buckets; most pairs already differ too much in their lower halves."""
    lower = b.lower[:, y]
    for k in range(BUCKET):
        found = np.flatnonzero(np.bitwise_count(a.lower[k, x] ^ lower) <= BUDGET)
        pair = found % len(x)
        i, j = a.places[k, x[pair]], b.places[found // len(x), y[pair]]
        close = np.bitwise_count(a.values[i] ^ b.values[j]) <= BUDGET
        yield i[close], j[close]


def close_pairs(a: Trie, b: Trie) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) of all fingerprints that differ in at most BUDGET bits; with a itself as b, each pair in one or
    both directions and every place with itself.

    Pairs of nodes go down together, the one of the shorter prefix first, and end where their prefixes differ in
    more bits than the budget has. A bounded number of them is taken from a stack at a time.
    """
    stack = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        u, v = stack.pop()
        if len(u) > FRONTIER:
            stack.append((u[FRONTIER:], v[FRONTIER:]))
            u, v = u[:FRONTIER], v[:FRONTIER]
        near = _within(a, b, u, v)
        u, v = u[near], v[near]
        flat_u, flat_v = a.left[u] < 0, b.left[v] < 0
        both = flat_u & flat_v
        if both.any():
            yield from _close_in(a, b, a.bucket[u[both]], b.bucket[v[both]])
        u, v, flat_u, flat_v = (side[~both] for side in (u, v, flat_u, flat_v))
        if not len(u):
            continue
        same = (u == v) if a is b else np.zeros(len(u), bool)
        down_u = ~same & ~flat_u & (flat_v | (a.depth[u] <= b.depth[v]))
        down_v = ~same & ~down_u
        s, x, y = u[same], u[down_u], v[down_u]
        p, q = u[down_v], v[down_v]
        stack.append(
            (
                np.concatenate([a.left[s], a.left[s], a.right[s], a.left[x], a.right[x], p, p]),
                np.concatenate([a.left[s], a.right[s], a.right[s], y, y, b.left[q], b.right[q]]),
            )
        )


def _rooted(parent: np.ndarray) -> np.ndarray:
    while True:
        above = parent[parent]
        if np.array_equal(above, parent):
            return parent
        parent = above


def _stars(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` with the nodes of each link under one root, the smallest place of what they connect."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        parent = _rooted(parent)


def _linked(table: pa.Table) -> pa.Table:
    """Of a pair of shards (or one with itself), each fingerprint that is connected with a smaller one, and that one."""
    blocks = [np.frombuffer(block.as_buffer(), np.uint64) for block in table.column("block")]
    a = Trie(blocks[0])
    b = Trie(blocks[1]) if len(blocks) > 1 else a
    values = np.concatenate(blocks)
    parent, offset = np.arange(len(values)), len(blocks[0]) if len(blocks) > 1 else 0
    for i, j in close_pairs(a, b):
        parent = _stars(parent, i, j + offset)
    child = np.flatnonzero(parent != np.arange(len(values)))
    return pa.table({"a": values[child].view(np.int64), "b": values[parent[child]].view(np.int64)})


def _shards(classes: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first value, prefix length) of nodes that divide the trie, of at most SHARD fingerprints each.

    Fingerprints are counted by their first byte, and again by one byte more where there are too many; each
    count brings at most 256 numbers for every node that is too large.
    """
    most = min(SHARD, max(n // LEAST_SHARDS, LEAST_SHARD))
    cells: dict[tuple[int, int], int] = {}
    crowded = None
    for bits in range(8, BITS + 1, 8):
        prefix = F.shiftrightunsigned("fp", BITS - bits) if bits < BITS else F.col("fp")
        rows = classes if crowded is None else classes.join(crowded, F.shiftrightunsigned("fp", BITS - bits + 8) == F.col("crowd"), "left_semi")
        found = {(r["prefix"] % (1 << bits), bits): r["n"] for r in rows.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n")).collect()}
        cells.update(found)
        large = [p for (p, b), count in found.items() if count > most and b < BITS]
        if not large:
            break
        crowded = classes.sparkSession.createDataFrame([(p,) for p in large], "crowd long")
        for p in large:
            del cells[p, bits]
    placed = sorted((prefix << (BITS - bits), bits, count) for (prefix, bits), count in cells.items())

    def divided(prefix: int, length: int, inside: list) -> list[tuple[int, int]]:
        if len(inside) < 2 or sum(count for *_, count in inside) <= most:
            return [(prefix, length)]
        half = prefix + (1 << (BITS - length - 1))
        halves = ([c for c in inside if c[0] < half], [c for c in inside if c[0] >= half])
        return divided(prefix, length + 1, halves[0]) + divided(half, length + 1, halves[1])

    first, length = zip(*divided(0, 0, placed))
    return np.array(first, np.uint64), np.array(length, np.uint64)


def _numbered(first: np.ndarray):
    def run(batch: pa.RecordBatch) -> dict:
        values = np.asarray(batch.column("fp")).view(np.uint64)
        return {"shard": (np.searchsorted(first, values, "right") - 1).astype(np.int32), "fp": batch.column("fp")}

    return run


def _to_partners(first: np.ndarray, length: np.ndarray):
    """A shard's block once for every shard whose prefix is within the budget."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in range(batch.num_rows):
                own = batch.column("shard")[row].as_py()
                values = np.sort(np.asarray(batch.column("fps")[row].values).view(np.uint64))
                gone = np.uint64(BITS) - np.minimum(length, length[own])
                differing = (first ^ first[own]) >> (gone >> np.uint64(1)) >> (gone - (gone >> np.uint64(1)))
                for other in np.flatnonzero(np.bitwise_count(differing) <= BUDGET).tolist():
                    low, high = sorted((own, other))
                    yield as_batch(
                        {"low": pa.array([low], pa.int32()), "high": pa.array([high], pa.int32()), "block": pa.array([values.tobytes()], pa.binary())}
                    )

    return run


def links(classes: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp``: their components are those of all pairs that differ in at most BUDGET bits.

    The trie is divided at its upper nodes into shards; the node pairs within the budget among these become
    groups of two shards (or one with itself), each traversed further in one task. A group returns the
    components of what it finds as stars, so a dense cluster returns one row a fingerprint, not all its pairs.
    """
    first, length = _shards(classes, classes.count())
    numbered = map_rows(classes.select("fp"), _numbered(first), "shard int, fp long")
    blocks = numbered.groupBy("shard").agg(F.collect_list("fp").alias("fps"))
    dealt = blocks.mapInArrow(_to_partners(first, length), "low int, high int, block binary")
    return dealt.groupBy("low", "high").applyInArrow(_linked, "a long, b long")


def to_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Documents are linked when their fingerprints differ in at most BUDGET bits; component_id is the smallest doc_id
    that links reach. A null or wordless text has fingerprint zero, which is linked like any other. Equal fingerprints
    are one class, so copies are never paired. A row without id takes part; its component_id is the smallest id of its
    component, null if there is none. Rows with the same id are separate texts. Extra columns are not read; an
    empty table gives an empty one.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = store(map_rows(texts, _fingerprints, "doc_id long, fp long"), "simhash-marked")
    classes = store(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-classes")
    low = store(components(store(links(classes), "simhash-links")), "simhash-components")
    grouped = classes.join(low.withColumnRenamed("node", "fp"), "fp", "left").withColumn("low", F.coalesce("low", "fp"))
    ids = grouped.groupBy("low").agg(F.min("least_id").alias("component_id"))
    named = grouped.join(ids, "low").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", to_text(F.col("fp")).alias("fingerprint"), "component_id")
