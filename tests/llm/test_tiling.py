"""Greedy tiling against a search through all matches, and on long repetitive texts."""

from __future__ import annotations

import time

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from hourgrid.llm import tiling  # noqa: E402


def plain_tiles(item, doc, least):
    """The longest match of unmarked tokens, first in the item, then in the document, until none is long enough."""
    free_item, free_doc, found = [True] * len(item), [True] * len(doc), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and free_item[i + n] and free_doc[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return found
        free_item[i : i + n] = free_doc[j : j + n] = [False] * n
        found.append((i, j, n))


@pytest.mark.parametrize("seed", range(40))
def test_tiles_equal_a_plain_search(seed):
    draw = np.random.default_rng(seed)
    kinds = int(draw.integers(1, 9))
    item = draw.integers(0, kinds, draw.integers(0, 26)).astype(np.uint64)
    doc = draw.integers(0, kinds, draw.integers(0, 40)).astype(np.uint64)
    if seed % 2:
        doc = np.concatenate([doc, item[: len(item) // 2], doc[:4], item[len(item) // 3 :]])
    assert tiling.tiles(item, doc, 5) == plain_tiles(item.tolist(), doc.tolist(), 5)


def test_repetitive_texts_take_moments():
    item, doc = (np.arange(400) % 7).astype(np.uint64), (np.arange(20_000) % 7).astype(np.uint64)
    started = time.perf_counter()
    assert tiling.tiles(item, doc) == [(0, 0, 400)]
    assert time.perf_counter() - started < 20
