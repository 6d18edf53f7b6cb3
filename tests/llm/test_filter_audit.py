"""The audit of filter orders against a loop over documents and orders, in one run and as files arrive."""

from __future__ import annotations

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from hourgrid.llm import filter_audit  # noqa: E402
from hourgrid.sources.scratch import scratch_path  # noqa: E402

SCHEMA = "doc_id long, text string, source string, key string, mask int"
LONG = " ".join(f"word{i}" for i in range(220))
ROWS = [
    (1, LONG, "a"),
    (2, LONG, "a"),
    (2, LONG, "b"),
    (-4, LONG, "b"),
    (-4, LONG, None),
    (None, LONG, ""),
    (None, None, "a"),
    (7, "", "a"),
    (3, None, None),
    (9, "SHOUT & more", "c"),
    (8, "SHOUT & more", "c"),
    (10, "same " * 400, "c"),
    (11, "É Ü plain 中文\x0b\x1cwords", "a"),
    (12, "x" * 200_000 + " %", "only here"),
    (13, LONG + " A" * 20, "a"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (-4, 1, 1), (7, None, 1), (9, 1, None), (None, 1, 1), (99, 1, 1), (13, 1, 1)]


def plain_report(rows, labels):
    def fails(doc_id, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        least = min((i for i, t, _ in rows if i is not None and (t or "") == text), default=None)
        return {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and doc_id > least,
        }

    documents = []
    for doc_id, text, part in rows:
        own = [row for row in labels if row[0] == doc_id and doc_id is not None]
        documents.append((part or "", fails(doc_id, text or ""), any(q == 1 for _, q, _ in own), any(t == 1 for *_, t in own)))
    report, shapley = {}, {}
    for part in {d[0] for d in documents}:
        inside = [d for d in documents if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                letter, earlier = order[step - 1], order[: step - 1]
                left = [d for d in inside if not any(d[1][x] for x in earlier)]
                gone = [d for d in left if d[1][letter]]
                failing = sum(d[1][letter] for d in inside)
                unique = sum(d[1][letter] and sum(d[1].values()) == 1 for d in inside)
                good, toxic = sum(d[2] for d in gone), sum(d[3] for d in gone)
                report[part, order, step] = [len(left) - len(gone), len(gone), failing - len(gone), unique, good, toxic]
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in report.items())


def written(spark, rows, path, mode="append"):
    frame = spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA)
    frame.repartition(3, F.xxhash64("doc_id", "source")).write.mode(mode).parquet(path)


def labelled(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def collected(report):
    return sorted(tuple(r) for r in report.collect())


def test_orders_equal_a_plain_loop(spark):
    path = scratch_path(spark, "audit-docs")
    written(spark, ROWS, path)
    found = filter_audit.audit_filters(spark, path, labelled(spark), scratch_path(spark, "audit"))
    assert collected(found) == plain_report(ROWS, LABELS)


@pytest.mark.parametrize("in_memory", [0, 1000])
def test_smaller_ids_retract_what_came_before(spark, monkeypatch, in_memory):
    """Files arrive in three goes, the smaller ids last; every report in between is right for what has come."""
    monkeypatch.setattr(filter_audit, "MEMORY_TEXTS", in_memory)
    path, folder = scratch_path(spark, "audit-docs"), scratch_path(spark, "audit")
    later = sorted(ROWS, key=lambda r: -(r[0] or 0))
    for at in (0, 5, 10):
        written(spark, later[at : at + 5], path)
        filter_audit.update_audit(spark, path, folder, batch_bytes=1)
        found = filter_audit.filter_orders(filter_audit.part_counters(spark, folder, labelled(spark)))
        assert collected(found) == plain_report(later[: at + 5], LABELS)
    changes = spark.read.parquet(f"{folder}/changes")
    assert changes.where("n < 0").count() > 0
    before = changes.count()
    filter_audit.update_audit(spark, path, folder)
    assert spark.read.parquet(f"{folder}/changes").count() == before


def test_empty_table(spark):
    path = scratch_path(spark, "audit-docs")
    written(spark, [], path)
    assert collected(filter_audit.audit_filters(spark, path, labelled(spark), scratch_path(spark, "audit"))) == []
