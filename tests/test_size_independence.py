"""Both sides of a size limit give the same answer; keys and payloads lose no rows."""

from __future__ import annotations

import json
import math

import pytest

from hourgrid.operators import order, quantiles, summary
from hourgrid.sources import payload

INF, NAN = math.inf, math.nan


@pytest.mark.parametrize(
    "values",
    [[1.0, 2.0, 3.0, NAN], [1.0, 2.0, 3.0, INF], [-INF, -INF, 5.0, None], [None, NAN], [INF, INF], [4.0] * 5 + [1.0, 9.0]],
)
def test_quantiles_do_not_depend_on_the_limit(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    small = quantiles.exact_quantiles(df, ["v"], [0.0, 0.25, 0.5, 0.95, 1.0])
    narrowed = quantiles.exact_quantiles(df, ["v"], [0.0, 0.25, 0.5, 0.95, 1.0], group_rows=1)
    assert narrowed == small
    if values[-1] is NAN and values[0] == 1.0:
        assert small["v"][2] == 2.0


def test_all_ranks_are_found_in_few_jobs(spark, monkeypatch):
    """Five columns and three quartiles past the limit: bounds, a few narrowing passes, the values."""
    rows = spark.range(20_000).selectExpr(*[f"double(hash(id, {k})) * {10.0 ** (3 * k - 6)} AS c{k}" for k in range(4)], "double(id % 3) AS c4")
    columns, fractions = [f"c{k}" for k in range(5)], [0.25, 0.5, 0.75]
    small = quantiles.exact_quantiles(rows, columns, fractions)
    passes = []
    for name in ("_narrowed", "_ranked"):
        monkeypatch.setattr(quantiles, name, lambda *a, f=getattr(quantiles, name), name=name: passes.append(name) or f(*a))
    found = quantiles.exact_quantiles(rows, columns, fractions, group_rows=2)
    assert all(found[c] == pytest.approx(small[c], rel=1e-12) for c in columns)
    assert len(passes) <= 8 and passes.count("_ranked") <= 1


@pytest.mark.parametrize("limit", [1, 2, 100])
def test_numbering_keeps_null_labels(spark, load_rows, limit):
    rows = load_rows([("2024-01-01", 1, 5), ("2024-01-01", 1, 4), ("2024-01-02", 3, 7)])
    lost = rows.selectExpr("source_stage", "CAST(NULL AS date) load_date", *rows.columns[2:])
    both = rows.unionByName(lost)
    found = order.number_repeated_hours(both, group_rows=limit)
    shown = found.select("load_date", "hour_ending", "caiso_mw", "hour_instance", "records_at_hour_label").collect()
    assert len(shown) == 6
    assert sorted((r[0] is None, r[1], int(r[2]), r[3], r[4]) for r in shown) == sorted(
        (gone, hour, load, instance, size) for gone in (False, True) for hour, load, instance, size in ((1, 4, 1, 2), (1, 5, 2, 2), (3, 7, 1, 1))
    )


def test_null_days_keep_their_rows(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "load_date string, x int")
    assert {(r["x"], r["hours_in_load_date"]) for r in order.add_hours_in_day(df).collect()} == {(1, 1), (2, 2), (3, 2)}
    assert [r["x"] for r in order.duplicate_rows(df, ["load_date"]).collect()] in ([2, 3], [3, 2])
    assert summary.duplicate_count(df, ["load_date"]).first()[0] == 1


def test_payloads_over_several_lines(spark, tmp_path):
    one = {"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1.5, 2.5]}}
    (tmp_path / "poway_2024.json").write_text(json.dumps(one, indent=2))
    (tmp_path / "fresno_2024.json").write_text(json.dumps(one) + "\n" + json.dumps(one) + "\n")
    found = payload.read_hourly_payloads(spark, str(tmp_path)).groupBy("city").count().collect()
    assert {tuple(r) for r in found} == {("poway", 2), ("fresno", 4)}
    (tmp_path / "bad_2024.json").write_text("{not json")
    with pytest.raises(Exception, match="no hourly payload"):
        payload.read_hourly_payloads(spark, str(tmp_path)).collect()


def test_payload_lists_of_different_lengths_stop_the_read(spark, tmp_path):
    one = {"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1.5]}}
    (tmp_path / "poway_2024.json").write_text(json.dumps(one))
    with pytest.raises(Exception, match="hours without temperatures of city poway"):
        payload.read_hourly_payloads(spark, str(tmp_path)).collect()
