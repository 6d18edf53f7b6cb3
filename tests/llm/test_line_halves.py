"""What is stored of lines is as narrow as plain numbers."""

from __future__ import annotations

import pytest

pytest.importorskip("public_tokenizers")

from hourgrid.llm import line_dedup  # noqa: E402


def test_stored_lines_hold_plain_columns(spark, monkeypatch):
    kept, store = {}, line_dedup.store
    monkeypatch.setattr(line_dedup, "store", lambda df, label: kept.setdefault(label, store(df, label)))
    words = [f"w{i}" for i in range(20)]
    texts = [" ".join(words[:9]), " ".join([*words[:4], "x", *words[5:9]]), "\t".join(words[:8]), "  W0  w1 ", "w0 w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted((r.doc_id, r.first_doc_id, r.edits) for r in line_dedup.duplicate_lines(docs).collect())
    # One word replaced, one word less, equal words.
    assert found == [(1, 0, 1), (2, 0, 1), (4, 3, 0)]
    kinds = {kind for label in ("line-places", "line-firsts") for _, kind in kept[label].dtypes}
    assert kinds <= {"boolean", "bigint", "int"}
