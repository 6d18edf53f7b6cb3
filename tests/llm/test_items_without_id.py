"""Benchmark items without an id."""

from __future__ import annotations

from hourgrid.llm import tiling


def test_items_without_id_are_matched(spark):
    one, two, other = (" ".join(f"{p}{i}" for i in range(20)) for p in "abc")
    items = spark.createDataFrame([(None, one), (None, two), (7, two), (7, other)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {one}"), (2, two), (3, other), (4, "clean " * 20)], "doc_id long, text string")
    found = sorted(((r["doc_id"], r["item_id"]) for r in tiling.contaminated(docs, items).collect()), key=str)
    assert found == [(1, None), (2, 7), (2, None), (3, 7)]
    assert [r["doc_id"] for r in tiling.drop_contaminated(docs, items).collect()] == [4]
