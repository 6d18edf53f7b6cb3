"""The conversation trie against prefixes counted in plain dictionaries."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from hourgrid.llm import prefix_trie  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, node string, n_leaves int"


def plain_nodes(table):
    own = defaultdict(list)
    for conv_id, turn, role, text, *_ in table:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(t[2], t[4]) for t in sorted(rows)] for c, rows in own.items()}
    members = defaultdict(list)
    lengths = {}
    for c, sequence in turns.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
        sequence = turns.get(base, [])[:h] + sequence[h:]
        lengths[c] = len(sequence)
        for d in range(len(sequence) + 1):
            members[tuple(sequence[:d])].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(convs) - 1) * (len(path[-1][1]) if path else 0)
    rows = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if lengths[c] == len(path)))
        parent = min(members[path[:-1]]) if path else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        rows.append((min(convs), len(path), parent, len(convs), children[path], leaves[path], saved[path], digest))
    return sorted(rows, key=str)


def found(spark, table):
    return sorted((tuple(r) for r in prefix_trie.conversation_trie(spark.createDataFrame(table, SCHEMA)).collect()), key=str)


def conversations(seed, many=260):
    """A third of the conversations share their content, another third their first turns; some ids have no base."""
    rng = np.random.default_rng(seed)
    table = []
    for c in range(-130, many):
        if c % 100 == 0 and c > 100:
            continue
        kind, n = int(rng.integers(0, 3)), int(rng.integers(1, 9))
        for turn in range(n):
            text = f"same {turn} é" if kind == 0 or (kind == 1 and turn < 3) else f"own {rng.integers(0, 3)}"
            table.append((c, turn, ("user", "assistant")[turn % 2], text, "x", 1))
    return table


AWKWARD = [
    (None, 1, "user", "belongs to none", "x", 1),
    (0, None, None, None, "x", 1),
    (0, None, "user", "also without number", "x", 1),
    (0, 1, "user", "repeated", "x", 1),
    (0, 1, "user", "repeated", "x", 1),
    (0, 1, "assistant", "same number", "x", 1),
    (1, 5, "", "", "x", 1),
    (2, 1, "a:b", "c", "x", 1),
    (3, 1, "a", "b:c", "x", 1),
    (-7, 3, "user", "below zero", "x", 1),
    (250, 0, "user", "no base", "x", 1),
    (251, 0, "user", "long " * 40_000, "x", 1),
    *[(300, t, "user", f"turn {t}", "x", 1) for t in range(700)],
    *[(333, t, "user", f"turn {t}", "x", 1) for t in range(700)],
    *[(334, t, "user", f"turn {min(t, 600)}", "x", 1) for t in range(700)],
]


def test_awkward_rows_equal_plain_counts(spark):
    assert found(spark, AWKWARD) == plain_nodes(AWKWARD)


def test_empty_table(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("turns", [20, 100_000])
def test_small_tries_merge_to_the_same_nodes(spark, monkeypatch, turns):
    monkeypatch.setattr(prefix_trie, "TRIE_TURNS", turns)
    monkeypatch.setattr(prefix_trie, "RUN_IDS", 7)
    table = conversations(turns)
    assert found(spark, table) == plain_nodes(table)


def test_runs_of_ids_are_cut_and_joined(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(prefix_trie, "RUN_IDS", 7)
    name = [b"a" * 16] * 30 + [b"b" * 16] * 3
    batches = [pa.RecordBatch.from_pydict({"sequence": name[i : i + 11], "conv_id": list(range(i, i + 11))}) for i in (0, 11, 22)]
    runs = list(prefix_trie._joined_runs(iter(batches)))
    assert len(runs) == 6
    digests = [d for batch in prefix_trie._hashed_runs(iter(runs)) for d in batch.column("ends").to_pylist()]
    assert digests == [hashlib.sha256(",".join(map(str, ids)).encode()).digest() for ids in (range(30), range(30, 33))]


def test_double_array_holds_every_sequence_and_no_other():
    rng = np.random.default_rng(0)
    paths = sorted({tuple(rng.integers(0, 12, rng.integers(0, 6)).tolist()) for _ in range(400)})
    trie = prefix_trie.packed([list(p) for p in paths])
    known = {p[:d] for p in paths for d in range(len(p) + 1)}
    states = {}
    for path in known:
        state = 0
        for turn in path:
            state = trie.child(state, turn)
            assert state is not None
        states[path] = state
    assert len(set(states.values())) == len(known)
    for path in known:
        for turn in range(12):
            assert (trie.child(states[path], turn) is not None) == ((*path, turn) in known)
