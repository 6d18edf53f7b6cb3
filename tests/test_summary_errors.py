from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourgrid.functions import scores
from hourgrid.operators import errors, features, order, quantiles, summary
from hourgrid.plans import error_report, medallion


def daily(spark, n):
    return spark.range(n).select(
        F.lit("historical").alias("source_stage"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("load_date"),
        (F.col("id") + 1).cast("double").alias("average_load_mw"),
    )


def test_rolling_means_of_both_kinds(spark):
    rows = daily(spark, 40)
    partial = summary.add_rolling_mean(rows, "average_load_mw", "r", partition=["source_stage"])
    full = summary.add_rolling_mean(rows, "average_load_mw", "r", full_only=True)
    partial, full = [[r.r for r in df.orderBy("load_date").collect()] for df in (partial, full)]
    assert partial[0] == 1.0 and partial[28] == 15.0
    assert full[:29] == [None] * 29 and full[29] == partial[29] == 15.5 and full[39] == 25.5


@pytest.mark.parametrize("group_rows", [10, 1_000_000])
def test_quantiles_are_exact(spark, group_rows):
    """Narrowing has to cope with a value that holds most of the rows."""
    values = np.concatenate([np.full(3000, 7.25), np.arange(2000) ** 1.5, [-5.0, 1e9]])
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    wanted = [0.0, 0.25, 0.5, 0.75, 0.95, 0.9999, 1.0]
    found = quantiles.exact_quantiles(rows, ["v"], wanted, group_rows)["v"]
    assert np.allclose(found, np.quantile(values, wanted), rtol=1e-12)


def test_quantile_of_the_literal_case_and_of_nothing(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "v double")
    assert errors.load_threshold(rows, "v") == pytest.approx(8.95)
    assert errors.load_threshold(rows.where("v > 99"), "v") is None


def test_describe_counts_without_nulls(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "a double")
    row = summary.describe(rows, ["a"]).first()
    assert (row.row_count, row["min"], row.q50, row["max"]) == (3, 1.0, 2.0, 4.0)
    assert row["std"] == pytest.approx(np.std([1, 2, 4], ddof=1))


def test_energy_is_split_completely_among_periods(random_loads):
    monthly = medallion.gold_monthly_tou(random_loads)
    totals = summary.tou_totals(monthly).agg(F.sum("system_load_mwh_proxy"), F.sum("hourly_observations")).first()
    assert tuple(totals) == tuple(random_loads.agg(F.sum("caiso_mw"), F.count("*")).first())
    sliced = summary.tou_slice(monthly, years=[2024], periods=["On-Peak"])
    assert {r.tou_period for r in sliced.collect()} == {"On-Peak"}


def test_scores_match_numpy_and_skip_missing_forecasts(spark):
    rng = np.random.default_rng(5)
    y, f = rng.uniform(50, 100, 300), rng.uniform(50, 100, 300)
    rows = [(float(a), float(b)) for a, b in zip(y, f)] + [(60.0, None)]
    row = errors.score(spark.createDataFrame(rows, "y double, f double"), "y", "f").first()
    assert row.scored_rows == 300
    assert row.mae == pytest.approx(np.mean(np.abs(y - f)))
    assert row.rmse == pytest.approx(np.sqrt(np.mean((y - f) ** 2)))
    assert row.mape == pytest.approx(np.mean(np.abs((y - f) / y)) * 100)


def test_percentage_of_zero(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (1.0, 4.0)], "p double, w double")
    assert [r[0] for r in rows.select(scores.percentage_of(F.col("p"), F.col("w"))).collect()] == [float("inf"), None, 25.0]


def test_error_report_on_a_known_forecast(load_rows):
    rows = [("2024-01-01", h, 100 + h) for h in range(1, 25)] + [("2024-01-08", 5, 50)]
    loads = order.number_repeated_hours(load_rows(rows)).withColumn("f", F.col("caiso_mw") - 10)
    report = error_report.error_report(loads, "caiso_mw", "f")
    assert report["by_month"].first().mae == 10.0 and report["by_hour"].count() == 24
    peak = report["peak"].first()
    assert (peak.hour_ending, float(peak.peak_error)) == (24, 10.0)
    assert peak.peak_error_pct == pytest.approx(10 / 124 * 100)
    assert report["peak_week"].count() == 24
    assert report["top_hours"].first().load_threshold == pytest.approx(np.quantile([*range(101, 125), 50], 0.95))


def test_leaderboard_compares_with_the_base(spark):
    rows = spark.createDataFrame([(10.0, 8.0, 9.0), (10.0, 12.0, 11.0)], "y double, a double, b double")
    board = errors.leaderboard(rows, "y", {"a": "a", "b": "b"}, "a").collect()
    assert [(r.model, r.mae, r.mae_change_pct) for r in board] == [("b", 1.0, -50.0), ("a", 2.0, 0.0)]


def test_null_profile_and_duplicates(spark):
    rows = spark.createDataFrame([(1, None), (1, 2), (None, 3)], "a int, b int")
    found = {r.column_name: r.null_count for r in summary.null_profile(rows).collect()}
    assert found == {"a": 1, "b": 1}
    assert summary.duplicate_count(rows, "a").first()[0] == 1


def test_split_by_year(spark):
    days = daily(spark, 800)
    train, test = features.split_by_year(days, 2024)
    assert (train.count(), test.count()) == (366, 365)
