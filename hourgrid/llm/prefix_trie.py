"""Shared prefixes of conversations: double-array tries of sorted runs, their shared upper nodes merged afterwards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.common import Batches, as_batch
from hourgrid.sources.scratch import store

# A trie is closed when it holds so many turns; ids are joined into runs of so many.
TRIE_TURNS = 100_000
RUN_IDS = 20_000
GROUP = 100
LONGEST_HEAD = 5
NOTHING = hashlib.sha256().digest()
_ROOT = bytes(16)


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (key, chars): 128 bits of role and text, and the text's code points.

    Turns are ordered by number, null first; equal numbers by role, then by the text's MD5. A null role or text is
    empty. Rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            role.alias("role"),
            F.md5(text.cast("binary")).alias("text_md5"),
            F.unhex(F.md5(F.concat_ws(":", F.length(role), role, text).cast("binary"))).alias("key"),
            F.char_length(text).cast("long").alias("chars"),
        ).alias("place"),
    )
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("place")).alias("places"))
    return ordered.select("conv_id", F.transform("places", lambda p: F.struct(p["key"].alias("key"), p["chars"].alias("chars"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): a conversation c begins with the first h turns of conversation c - c % GROUP, h = crc32(c) % 6, or with
    none if there is no such conversation, and goes on with its own turns after the first h.
    """
    base = (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (LONGEST_HEAD + 1)).cast("int").alias("h")
    heads = conversations.where(f"conv_id % {GROUP} = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, LONGEST_HEAD).alias("head"))
    joined = conversations.select("conv_id", "turns", base, h).join(heads, "base", "left")
    none = F.slice("turns", F.lit(1), F.lit(0))
    head = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(head, own).alias("turns"))


def _joined_runs(batches: Batches) -> Batches:
    """Of sorted (sequence, conv_id) the joined decimal ids, in runs: a sequence that very many conversations have is many runs."""
    held: list[str] = []
    at = None

    def closed() -> pa.RecordBatch:
        return as_batch({"sequence": pa.array([at[0]], pa.binary()), "first": pa.array([at[1]], pa.int64()), "ids": pa.array([",".join(held)])})

    for batch in batches:
        for sequence, conv_id in zip(batch.column("sequence").to_pylist(), batch.column("conv_id").to_pylist()):
            if at is not None and (sequence != at[0] or len(held) >= RUN_IDS):
                yield closed()
                held, at = [], None
            at = at or (sequence, conv_id)
            held.append(str(conv_id))
    if held:
        yield closed()


def _hashed_runs(batches: Batches) -> Batches:
    """SHA-256 of each sequence's runs, comma-joined; the runs of one follow each other in the order of their ids."""
    at, digest = None, None
    for batch in batches:
        done: list[tuple[bytes, bytes]] = []
        for sequence, ids in zip(batch.column("sequence").to_pylist(), batch.column("ids").to_pylist()):
            if sequence == at:
                digest.update(b"," + ids.encode())
                continue
            if at is not None:
                done.append((at, digest.digest()))
            at, digest = sequence, hashlib.sha256(ids.encode())
        if done:
            yield as_batch({"sequence": pa.array([d[0] for d in done], pa.binary()), "ends": pa.array([d[1] for d in done], pa.binary())})
    if at is not None:
        yield as_batch({"sequence": pa.array([at], pa.binary()), "ends": pa.array([digest.digest()], pa.binary())})


def distinct_sequences(conversations: DataFrame) -> DataFrame:
    """(turns, n, conv_id, ends): each different sequence once, with how many conversations have it, the smallest, and the
    SHA-256 of their ids. Copies meet in these sums, not in the tries.
    """
    joined = F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "")
    marked = store(conversations.select(F.unhex(F.md5(joined.cast("binary"))).alias("sequence"), "conv_id", "turns"), "trie-sequences")
    counted = marked.groupBy("sequence").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns"))
    ids = marked.select("sequence", "conv_id").repartitionByRange("sequence", "conv_id").sortWithinPartitions("sequence", "conv_id")
    runs = ids.mapInArrow(_joined_runs, "sequence binary, first long, ids string").repartition("sequence").sortWithinPartitions("sequence", "first")
    return counted.join(runs.mapInArrow(_hashed_runs, "sequence binary, ends binary"), "sequence").drop("sequence")


@dataclass
class DoubleArray:
    """A trie packed into BASE and CHECK: the child of state s by turn id c is at BASE[s] + c, if CHECK there says s."""

    base: list[int] = field(default_factory=lambda: [0])
    check: list[int] = field(default_factory=lambda: [0])
    # The next free place at or behind each taken one, as far as known.
    after: dict[int, int] = field(default_factory=lambda: {0: 1})

    def _free(self, place: int) -> int:
        path = []
        while place in self.after:
            path.append(place)
            place = self.after[place]
        for taken in path:
            self.after[taken] = place
        return place

    def add_children(self, state: int, ids: list[int]) -> list[int]:
        """Places for the children of a state by ascending turn ids, at the first offset where all are free."""
        place = self._free(max(ids[0], 1))
        while any(place - ids[0] + c in self.after for c in ids):
            place = self._free(place + 1)
        base = place - ids[0]
        grown = base + ids[-1] + 1 - len(self.base)
        if grown > 0:
            self.base.extend([0] * grown)
            self.check.extend([-1] * grown)
        self.base[state] = base
        for c in ids:
            self.check[base + c] = state
            self.after[base + c] = base + c + 1
        return [base + c for c in ids]

    def child(self, state: int, turn: int) -> int | None:
        place = self.base[state] + turn
        return place if place < len(self.check) and place and self.check[place] == state else None


def packed(paths: list[list[int]]) -> DoubleArray:
    """The double array of sorted sequences of dense turn ids."""
    trie = DoubleArray()
    level = [(0, 0, len(paths))] if paths else []
    depth = 0
    while level:
        below = []
        for state, lo, hi in level:
            while lo < hi and len(paths[lo]) == depth:
                lo += 1
            if lo == hi:
                continue
            cuts = [lo] + [i for i in range(lo + 1, hi) if paths[i][depth] != paths[i - 1][depth]] + [hi]
            ids = [paths[i][depth] for i in cuts[:-1]]
            below += zip(trie.add_children(state, ids), cuts, cuts[1:])
        level, depth = below, depth + 1
    return trie


_NODE = (
    "node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, chars long, "
    "n_children long, n_leaves long, saved long, ends binary, open boolean"
)
_TYPES = [pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.binary(), pa.bool_()]


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    """The nodes of one sorted run of distinct sequences (turns, n, conv_id, ends).

    Other runs can share only nodes on the path of its first or last sequence; those are left open: their sums are of the
    branches of this run that hang on them and have no open node. All other nodes are whole.
    """
    keys = sorted({t["key"] for turns, *_ in rows for t in turns})
    dense = {key: i for i, key in enumerate(keys)}
    paths = [[dense[t["key"]] for t in turns] for turns, *_ in rows]
    trie = packed(paths)
    order, at = [0], {0: 0}
    parent, depth, chars, names, last = [0], [0], [0], [_ROOT], [-1]
    convs, least, ends, is_open = [0], [None], [None], [True]
    for row, ((turns, n, conv_id, end), path) in enumerate(zip(rows, paths)):
        state, edge, node = 0, row in (0, len(rows) - 1), 0
        convs[0] += n
        least[0] = conv_id if least[0] is None else min(least[0], conv_id)
        for turn, code in zip(turns, path):
            below = trie.child(state, code)
            if below not in at:
                at[below] = len(order)
                order.append(below)
                parent.append(node)
                depth.append(depth[node] + 1)
                chars.append(turn["chars"])
                names.append(hashlib.blake2b(names[node] + turn["key"], digest_size=16).digest())
                convs.append(0)
                least.append(conv_id)
                ends.append(None)
                is_open.append(False)
            state, node = below, at[below]
            convs[node] += n
            least[node] = min(least[node], conv_id)
            is_open[node] |= edge
        ends[node] = end
    size = len(order)
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    # Nodes come after their parents.
    for node in range(size - 1, 0, -1):
        if not is_open[node]:
            children[parent[node]] += 1
            leaves[parent[node]] += leaves[node] + (not children[node])
            saved[parent[node]] += saved[node] + (convs[node] - 1) * chars[node]
    for node in range(1, size):
        if not is_open[node]:
            leaves[node] += not children[node]
            saved[node] += (convs[node] - 1) * chars[node]
    whole_parent = [None if is_open[p] else least[p] for p in parent]
    columns = (names, [names[p] for p in parent], depth, least, whole_parent, convs, chars, children, leaves, saved, ends, is_open)
    named = zip(_NODE.split(", "), columns, _TYPES)
    return as_batch({c.split()[0]: pa.array(values, kind) for c, values, kind in named})


def _trie_nodes(batches: Batches) -> Batches:
    def runs() -> Iterator[list[tuple]]:
        held, turns = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("turns", "n", "conv_id", "ends"))):
                held.append(row)
                turns += len(row[0]) + 1
                if turns >= TRIE_TURNS:
                    yield held
                    held, turns = [], 0
        if held:
            yield held

    for run in runs():
        yield _nodes(run)


def _below(nodes: DataFrame) -> DataFrame:
    """(node, n_leaves, saved): sums over the subtrees of open nodes, whose parents are open too.

    In round k every node gives what it has gathered from its 2^k upper levels to its 2^k-th ancestor; so rounds grow with the
    logarithm of the depth.
    """
    gathered = store(nodes.select("node", F.col("parent").alias("above"), "n_leaves", "saved"), "trie-open")
    while not gathered.where("above IS NOT NULL").isEmpty():
        given = gathered.where("above IS NOT NULL").groupBy(F.col("above").alias("node"))
        given = given.agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        further = gathered.select(F.col("node").alias("above"), F.col("above").alias("further"))
        next_ = gathered.join(given, "node", "left").join(further, "above", "left")
        plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        gathered = store(next_.select("node", F.col("further").alias("above"), plus("n_leaves", "more_leaves"), plus("saved", "more_saved")), "trie-open")
    return gathered.select("node", "n_leaves", "saved")


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations (conv_id, turns), the root included; see ``conversation_trie``.

    The different sequences are sorted by range, so that a shard is what has its prefixes between two others, however many
    share a first turn. A task builds double arrays over runs of its shard.
    """
    different = distinct_sequences(conversations)
    shards = different.repartitionByRange("turns").sortWithinPartitions("turns")
    found = store(shards.mapInArrow(_trie_nodes, _NODE), "trie-nodes")
    upper = found.where("open").groupBy("node").agg(
        *(F.first(c).alias(c) for c in ("parent", "depth", "chars")),
        F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")),
        F.max("ends").alias("ends"),
    )
    upper = store(upper.withColumn("parent", F.when(F.col("depth") > 0, F.col("parent"))), "trie-upper")
    among = upper.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("upper_children"))
    upper = upper.join(among, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("upper_children", F.lit(0)))
    upper = store(
        upper.withColumns(
            {
                "n_leaves": F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0),
                "saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("chars"),
            }
        ).drop("upper_children"),
        "trie-upper",
    )
    upper = upper.drop("n_leaves", "saved").join(_below(upper), "node")
    nodes = found.where("NOT open").unionByName(upper.withColumns({"parent_conv_id": F.lit(None).cast("long"), "open": F.lit(True)}))
    known = store(upper.select(F.col("node").alias("parent"), F.col("conv_id").alias("upper_conv_id")), "trie-parents")
    joined = nodes.where("parent_conv_id IS NULL AND depth > 0").join(known, "parent", "left")
    named = joined.withColumn("parent_conv_id", F.col("upper_conv_id")).drop("upper_conv_id")
    return nodes.where("parent_conv_id IS NOT NULL OR depth = 0").unionByName(named)


def _digest(ends: str) -> Column:
    return F.lower(F.hex(F.coalesce(ends, F.lit(NOTHING))))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (see ``rebuilt``).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the smallest member, the
    number of turns, the parent's smallest member (null for the root), members, children, childless nodes of the
    subtree, its saved code points, and the SHA-256 of the members that end here, comma-joined (of nothing if none). Every
    rebuilt conversation is a member of the root, also one without turns. Turns are equal if role and text are (null as
    empty). A table without conversations has no nodes. Other columns are not read.
    """
    nodes = prefix_nodes(rebuilt(sequences(turns.select("conv_id", "turn", "role", "text"))))
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves")
    return nodes.select(*columns, F.col("saved").alias("saved_tokens"), _digest("ends").alias("ends_sha256"))
