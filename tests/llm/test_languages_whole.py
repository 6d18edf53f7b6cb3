"""All languages are learned, whatever their number and their n-grams."""

from __future__ import annotations

import numpy as np

from hourgrid.llm import langid


def test_more_languages_than_a_mask_has_bits(spark):
    draw = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in draw.integers(0, 26, 12)) for _ in range(70)]
    train = [(f"l{i:02d}", " ".join([w] * (i + 1))) for i, w in enumerate(words)]
    filters = langid.learn(spark.createDataFrame(train, "lang string, text string"))
    assert len(filters.languages) == 70
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    found = langid.identify(docs, filters).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in found} == {i: f"l{i:02d}" for i in range(70)}


def test_filters_grow_with_the_ngrams(spark, monkeypatch):
    monkeypatch.setattr(langid, "SLOT_BITS", 10)
    draw = np.random.default_rng(4)
    rich = "".join(chr(0x4E00 + c) for c in draw.integers(0, 20_000, 20_000))
    train = [("rich", rich), ("poor", "kolo mira tuna " * 10)]
    filters = langid.learn(spark.createDataFrame(train, "lang string, text string"))
    assert filters.decide([rich[500:600] + " kolo", "kolo tuna"])[0] == ["rich", "poor"]
