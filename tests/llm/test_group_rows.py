"""What near duplicates make rows of in groups of many members: no more than pairs need, dealt evenly, and no pair lost."""

from __future__ import annotations

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from hourgrid.llm import near_dup  # noqa: E402

LEVEL = Fraction(8, 10)
SCHEMA = "mark long, node binary, n long, rare long, values array<long>"


def compared(spark, groups, references):
    """Members by mark, as sets, against their group's reference."""
    rows = [(mark, b"%d-%d" % (mark, i), len(s), 0, sorted(s)) for mark, sets in groups.items() for i, s in enumerate(sets)]
    sides = spark.createDataFrame([(m, sorted(r)) for m, r in references.items()], "mark long, reference array<long>")
    return near_dup._compared(spark.createDataFrame(rows, SCHEMA), sides, LEVEL)


@pytest.fixture
def taken(monkeypatch):
    """The rows that values are chosen from."""
    seen, rarest = [], near_dup._rarest

    def kept(rows):
        seen.append(rows)
        return rarest(rows)

    monkeypatch.setattr(near_dup, "_rarest", kept)
    return seen


def test_groups_without_another_side_make_no_rows_of_what_they_lost(spark, taken):
    core = set(range(100))
    alike = [core - {i} for i in range(20)]  # have lost a value each, and all are similar to the core
    grown = [core | {1000 * i + j for j in range(60)} for i in range(1, 20)]  # none has lost more than it gained
    near_dup._lost_pairs(compared(spark, {1: alike, 2: grown}, {1: core, 2: core}), LEVEL)
    assert taken[0].count() == 0


def test_lost_pairs_holds_every_linked_pair(spark):
    draw = random.Random(7)
    groups, references, wanted = {}, {}, set()
    for mark in range(30):
        core = set(range(draw.choice([10, 40])))
        sets = []
        for _ in range(12):
            base = draw.choice(sets) if sets and draw.random() < 0.7 else core - set(draw.sample(sorted(core), draw.randrange(len(core) // 2))) | {draw.randrange(100, 130) for _ in range(draw.randrange(25))}
            changed = set(base) - set(draw.sample(sorted(base), min(len(base) - 1, draw.randrange(3)))) | {draw.randrange(100, 130) for _ in range(draw.randrange(3))}
            sets.append(changed)
        groups[mark], references[mark] = sets, core
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                losing, open_ = len(core - x) > len(x - core), 10 * len(y & core) < 8 * len(y | core)
                if i != j and losing and open_ and 10 * len(x & y) >= 8 * len(x | y):
                    wanted.add(tuple(sorted((b"%d-%d" % (mark, i), b"%d-%d" % (mark, j)))))
    pairs = near_dup._lost_pairs(compared(spark, groups, references), LEVEL)
    found = {(bytes(r["a"]), bytes(r["b"])) for r in pairs.collect()}
    assert len(wanted) > 50
    assert wanted <= found


def test_members_of_one_group_are_dealt_evenly(spark):
    core = set(range(40))
    grown = [core | {1000 * i + j for j in range(30)} for i in range(1, 401)]
    joined = compared(spark, {1: grown}, {1: core}).repartition("mark")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one task's again
    try:
        sizes = [r["count"] for r in near_dup._spread(joined).groupBy(F.spark_partition_id().alias("task")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 400 and max(sizes) <= 150
