"""SimHash links against brute force over all pairs."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

pytest.importorskip("public_tokenizers")

from hourgrid.llm import simhash  # noqa: E402

PROSE = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen. " * 6
ROWS = [
    (5, PROSE, "a"),
    (3, PROSE.upper(), "b"),
    (9, PROSE + "One more word", None),
    (None, PROSE, "x"),
    (7, "", "y"),
    (6, None, "y"),
    (8, " \t\n", "y"),
    (4, "Two words", ""),
    (4, "two  WORDS", ""),
    (4, "something else in the same row id altogether", ""),
    (11, "É é İ wide 中文 text \x0b that isn't a copy", ""),
    (12, "long " + "x" * 50_000 + " " + "ab " * 30_000, ""),
    (None, "only here, without an id at all", ""),
]
SCHEMA = "doc_id long, text string, fp string"


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    runs = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(table):
    marks = [plain_fingerprint(t) for _, t, *_ in table]
    group = list(range(len(marks)))
    for i, a in enumerate(marks):
        for j, b in enumerate(marks[:i]):
            if (a ^ b).bit_count() <= 4 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for g, (i, *_) in zip(group, table):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    return [(i, f"{m:016x}", least[g]) for (i, *_), m, g in zip(table, marks, group)]


def found(df):
    return sorted((tuple(r) for r in simhash.simhash_duplicates(df).collect()), key=str)


def test_awkward_rows_equal_brute_force(spark):
    assert found(spark.createDataFrame(ROWS, SCHEMA)) == sorted(plain_components(ROWS), key=str)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_random_texts_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    table = []
    for i in range(240):
        words = [f"w{x}" for x in np.random.default_rng(i % 60).integers(0, 500, 120)]
        for at in rng.integers(0, 120, rng.integers(0, 4)):
            words[at] = "changed"
        table.append((int(rng.integers(0, 10**6)), " ".join(words), ""))
    expected = plain_components(table)
    assert len({c for *_, c in expected}) < len(table)
    assert found(spark.createDataFrame(table, SCHEMA)) == sorted(expected, key=str)


def clustered(n, seed):
    """Fingerprints around few centres, one of which has a third of all."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**64, max(n // 8, 1), dtype=np.uint64)
    values = []
    for i in range(n):
        value = int(centres[0 if i % 3 == 0 else i % len(centres)])
        for bit in rng.integers(0, 64, rng.integers(0, 5)):
            value ^= 1 << int(bit)
        values.append(value)
    return np.unique(np.array(values, np.uint64))


@pytest.mark.parametrize("n", [1, 2, 17, 400, 3000])
def test_trie_finds_every_close_pair(n):
    values = clustered(n, n)
    trie, half = simhash.Trie(values), len(values) // 2
    expected = {(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(values[:, None] ^ values) <= 4)) if i < j}
    pairs = {tuple(sorted(p)) for i, j in simhash.close_pairs(trie, trie) for p in zip(i.tolist(), j.tolist()) if p[0] != p[1]}
    assert pairs == expected
    if half:
        low, high = simhash.Trie(values[:half]), simhash.Trie(values[half:])
        across = {p for i, j in simhash.close_pairs(low, high) for p in zip(i.tolist(), (j + half).tolist())}
        assert across == {(i, j) for i, j in expected if i < half <= j}


def test_shards_do_not_change_components(spark, monkeypatch):
    values = clustered(600, 1)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    whole = {frozenset(r) for r in simhash.links(frame).collect()}
    monkeypatch.setattr(simhash, "SHARD", 20)
    monkeypatch.setattr(simhash, "LEAST_SHARD", 1)
    cut = {frozenset(r) for r in simhash.links(frame).collect()}

    def groups(pairs):
        of = {int(v): int(v) for v in values.view(np.int64)}
        for a, b in map(tuple, pairs):
            old, new = of[a], of[b]
            of = {k: new if g == old else g for k, g in of.items()}
        return {frozenset(k for k in of if of[k] == g) for g in of.values()}

    assert groups(whole) == groups(cut)
