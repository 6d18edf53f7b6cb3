"""Aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.fixed import HISTORICAL, LOAD_COLUMNS, MATCHED
from hourgrid.operators import clean, errors, features, order, summary
from hourgrid.plans import medallion
from hourgrid.sources.scratch import store
from standins import inputs, sql
from standins.registry import register
from standins.section_b import naive_errors, naive_test

MEAN = sql.mean("caiso_mw")


@register("d01_row_count", "SELECT COUNT(*) AS row_count FROM lineitem")
def row_count(spark, sf):
    return summary.row_count(inputs.readings(spark, sf))


@register(
    "d02_count_by_stage",
    sql.readings("SELECT source_stage, COUNT(*) AS row_count FROM r_silver GROUP BY 1"),
)
def count_by_stage(spark, sf):
    return summary.count_by(inputs.readings(spark, sf), "source_stage")


_COVERAGE = """SELECT source_stage, COUNT(*) AS hourly_rows, MIN(load_date) AS first_load_date,
  MAX(load_date) AS last_load_date,
  CAST(SUM(CASE WHEN hours_in_load_date <> 24 THEN 1 ELSE 0 END) AS BIGINT) AS rows_on_dst_transition_dates
FROM {p}_gold GROUP BY 1"""


@register("d03_coverage_summary", sql.hourly(_COVERAGE.format(p="h")))
def coverage_summary(spark, sf):
    return summary.coverage(order.add_hours_in_day(inputs.hourly_silver(spark, sf)))


@register("d03_coverage_summary_readings", sql.readings(_COVERAGE.format(p="r")))
def coverage_summary_readings(spark, sf):
    return summary.coverage(order.add_hours_in_day(inputs.readings(spark, sf)))


@register(
    "d04_hourly_profile",
    sql.readings(
        f"""SELECT hour_ending, {MEAN} AS average_caiso_load_mw, MIN(caiso_mw) AS minimum_caiso_load_mw,
  MAX(caiso_mw) AS maximum_caiso_load_mw FROM r_gold WHERE source_stage = 'historical' GROUP BY 1"""
    ),
)
def hourly_profile(spark, sf):
    return summary.hourly_profile(features.at_stage(inputs.readings(spark, sf), HISTORICAL))


@register(
    "d05_hourly_weekend_profile",
    sql.readings(
        f"""SELECT hour_ending, is_weekend, {MEAN} AS average_caiso_load_mw
FROM r_gold WHERE source_stage = 'historical' GROUP BY 1, 2"""
    ),
)
def hourly_weekend_profile(spark, sf):
    rows = features.add_weekday(features.at_stage(inputs.readings(spark, sf), HISTORICAL))
    return summary.mean_by(rows, ["hour_ending", "is_weekend"])


@register("d06_daily_summary", sql.readings("SELECT * FROM r_daily"))
def daily_summary(spark, sf):
    return summary.daily_summary(inputs.readings(spark, sf))


@register(
    "d07_daily_mean",
    sql.readings(f"SELECT load_date, {MEAN} AS average_caiso_load_mw FROM r_rows GROUP BY 1"),
)
def daily_mean(spark, sf):
    return summary.mean_by(inputs.readings(spark, sf), ["load_date"])


_BAND = f"""SELECT CASE WHEN temp_sacramento_f < 55 THEN 'Below 55 F'
    WHEN temp_sacramento_f < 70 THEN '55 to under 70 F'
    WHEN temp_sacramento_f < 85 THEN '70 to under 85 F' ELSE '85 F and above' END AS sacramento_temperature_band,
  COUNT(*) AS hourly_rows, {MEAN} AS average_caiso_load_mw
FROM h_load_weather WHERE source_stage = 'historical' AND weather_match_status = 'matched' GROUP BY 1"""


@register("d08_band_profile", sql.hourly(_BAND))
def band_profile(spark, sf):
    return summary.band_profile(features.at_stage(inputs.hourly_load_weather(spark, sf), HISTORICAL, MATCHED))


@register(
    "d09_match_status_counts",
    sql.hourly("SELECT weather_match_status, COUNT(*) AS row_count FROM h_load_weather GROUP BY 1"),
)
def match_status_counts(spark, sf):
    return summary.count_by(inputs.hourly_load_weather(spark, sf), "weather_match_status")


@register("d10_monthly_tou_summary", sql.readings("SELECT * FROM r_tou"))
def monthly_tou_summary(spark, sf):
    return summary.monthly_tou(features.add_weekday(inputs.readings(spark, sf)))


@register(
    "d11_tou_rollup",
    sql.readings(
        """SELECT source_stage, tou_period, CAST(SUM(hourly_observations) AS BIGINT) AS hourly_observations,
  CAST(SUM(system_load_mwh_proxy) AS DECIMAL(38,3)) AS system_load_mwh_proxy FROM r_tou GROUP BY 1, 2"""
    ),
)
def tou_rollup(spark, sf):
    return summary.tou_totals(medallion.gold_monthly_tou(inputs.readings(spark, sf)))


@register(
    "d12_mean_by_weekday",
    sql.readings(
        f"""SELECT CAST(ISODOW(load_date) AS INT) AS day_order, DAYNAME(load_date) AS day_name,
  {MEAN} AS average_caiso_load_mw FROM r_rows GROUP BY 1, 2"""
    ),
)
def mean_by_weekday(spark, sf):
    return summary.mean_by_weekday(features.add_day_name(inputs.readings(spark, sf)))


@register(
    "d13_mean_by_weekday_hour",
    sql.readings(
        f"SELECT DAYNAME(load_date) AS day_name, hour_ending, {MEAN} AS average_caiso_load_mw FROM r_rows GROUP BY 1, 2"
    ),
)
def mean_by_weekday_hour(spark, sf):
    return summary.mean_by(features.add_day_name(inputs.readings(spark, sf)), ["day_name", "hour_ending"])


@register(
    "d14_mean_by_month",
    sql.readings(
        f"SELECT CAST(MONTH(load_date) AS INT) AS load_month, {MEAN} AS average_caiso_load_mw FROM r_rows GROUP BY 1"
    ),
)
def mean_by_month(spark, sf):
    return summary.mean_by(features.add_year_month(inputs.readings(spark, sf)), ["load_month"])


@register(
    "d15_mean_by_month_hour",
    sql.readings(
        f"""SELECT CAST(MONTH(load_date) AS INT) AS load_month, hour_ending, {MEAN} AS average_caiso_load_mw
FROM r_rows GROUP BY 1, 2"""
    ),
)
def mean_by_month_hour(spark, sf):
    return summary.mean_by(features.add_year_month(inputs.readings(spark, sf)), ["load_month", "hour_ending"])


@register(
    "d16_monthly_peak",
    sql.readings(
        """SELECT CAST(YEAR(load_date) AS INT) AS load_year, CAST(MONTH(load_date) AS INT) AS load_month,
  MAX(caiso_mw) AS peak_load_mw FROM r_rows GROUP BY 1, 2"""
    ),
)
def monthly_peak(spark, sf):
    return summary.monthly_maximum(features.add_year_month(inputs.readings(spark, sf)))


_COUNTED = ["load_date", "hour_ending", "caiso_mw", "caiso_lag_24_mw", "caiso_lag_168_mw"]


@register(
    "d17_null_profile",
    sql.readings(
        "\nUNION ALL ".join(
            f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count, COUNT(*) AS row_count FROM r_gold"
            for c in _COUNTED
        )
    ),
)
def null_profile(spark, sf):
    lagged = order.add_lags(inputs.readings_placed(spark, sf), order.load_lags())
    return summary.null_profile(lagged.select(*_COUNTED))


@register(
    "d17_reject_counts",
    sql.hourly(
        """SELECT CASE WHEN NULLIF(TRIM("Date"), '') IS NULL OR TRIM("Date") = 'CAISO Public' THEN 'blank or footer'
    WHEN TRY_CAST("Date" AS DATE) IS NULL THEN 'date'
    WHEN COALESCE(TRY_CAST("HR" AS INT) NOT BETWEEN 1 AND 24, TRUE) THEN 'hour'
    WHEN TRY_CAST("PGE" AS DECIMAL(12,3)) IS NULL THEN 'load' ELSE 'kept' END AS rule,
  COUNT(*) AS row_count FROM h_raw GROUP BY 1"""
    ),
)
def reject_counts(spark, sf):
    historical, validation = inputs.hourly_raw(spark, sf)
    return clean.reject_counts(historical.union(validation))


def _described(column):
    x = f"CAST({column} AS DOUBLE)"
    return f"""SELECT '{column}' AS column_name, COUNT({column}) AS row_count, {sql.mean(column)} AS mean,
  ROUND(STDDEV_SAMP({x}), 8) AS std, MIN({x}) AS min, MAX({x}) AS max,
  ROUND(quantile_cont({x}, 0.25), 8) AS q25, ROUND(quantile_cont({x}, 0.5), 8) AS q50,
  ROUND(quantile_cont({x}, 0.75), 8) AS q75 FROM r_rows"""


@register("d18_describe", sql.readings("\nUNION ALL ".join(_described(c) for c in LOAD_COLUMNS)))
def describe(spark, sf):
    table = summary.describe(inputs.readings(spark, sf), LOAD_COLUMNS)
    return table.withColumns({c: F.round(c, 8) for c in ["std", "q25", "q50", "q75"]})


@register("d18_describe_narrowed", sql.readings("\nUNION ALL ".join(_described(c) for c in LOAD_COLUMNS)))
def describe_narrowed(spark, sf):
    """The same by repeated binning, as taken when the values do not fit into one task."""
    table = summary.describe(inputs.readings(spark, sf), LOAD_COLUMNS, group_rows=1_000)
    return table.withColumns({c: F.round(c, 8) for c in ["std", "q25", "q50", "q75"]})


@register("d19_distinct_hours", sql.readings("SELECT DISTINCT hour_ending FROM r_rows"))
def distinct_hours(spark, sf):
    return summary.distinct_values(inputs.readings(spark, sf), "hour_ending")


@register(
    "d20_hour_value_counts",
    sql.hourly("SELECT hour_ending, COUNT(*) AS row_count FROM h_rows GROUP BY 1"),
)
def hour_value_counts(spark, sf):
    """One hour more and one less than days, for the two clock changes."""
    return summary.value_counts(medallion.typed_loads(*inputs.hourly_raw(spark, sf)), "hour_ending")


@register(
    "d21_nonpositive_counts",
    sql.readings(
        "SELECT " + ", ".join(f"COUNT(*) FILTER ({c} <= 0) AS {c}" for c in LOAD_COLUMNS) + " FROM r_rows"
    ),
)
def nonpositive_counts(spark, sf):
    return summary.nonpositive_counts(inputs.readings(spark, sf), LOAD_COLUMNS)


@register(
    "d22_date_span",
    sql.readings("SELECT MIN(load_date) AS first_date, MAX(load_date) AS last_date FROM r_rows"),
)
def date_span(spark, sf):
    return summary.date_span(inputs.readings(spark, sf))


@register(
    "d23_duplicate_count",
    sql.readings("SELECT COUNT(*) - COUNT(DISTINCT local_timestamp_label) AS duplicate_count FROM r_silver"),
)
def duplicate_count(spark, sf):
    return summary.duplicate_count(clean.add_hour_label(inputs.readings(spark, sf)), "local_timestamp_label")


def _one_score(name):
    """One of the three scores, with the number of rows behind it."""
    expression = next(
        part for part in sql.score("caiso_mw", "forecast_24").split(",\n") if part.strip().endswith(f"AS {name}")
    )
    return sql.readings(f"SELECT COUNT(*) AS scored_rows, {expression.strip()} FROM r_test")


@register("d24_mae", _one_score("mae"))
def mae(spark, sf):
    return errors.score(naive_test(spark, sf), "caiso_mw", "forecast_24").select("scored_rows", "mae")


@register("d25_rmse", _one_score("rmse"))
def rmse(spark, sf):
    return errors.score(naive_test(spark, sf), "caiso_mw", "forecast_24").select("scored_rows", "rmse")


@register("d26_mape", _one_score("mape"))
def mape(spark, sf):
    return errors.score(naive_test(spark, sf), "caiso_mw", "forecast_24").select("scored_rows", "mape")


_ROUNDED = {
    "mae": f"ROUND({sql.mean('abs_error')}, 8) AS mae",
    "mape": f"ROUND({sql.mean('ape')}, 8) AS mape",
    "rmse": f"ROUND(SQRT({sql.mean('error * error')}), 8) AS rmse",
}


@register(
    "d27_error_by_month",
    sql.readings(
        f"""SELECT CAST(MONTH(load_date) AS INT) AS load_month, {", ".join(_ROUNDED.values())}
FROM r_errors GROUP BY 1"""
    ),
)
def error_by_month(spark, sf):
    return errors.error_by_month(naive_errors(spark, sf))


@register(
    "d28_error_by_hour",
    sql.readings(f"SELECT hour_ending, {_ROUNDED['mae']}, {_ROUNDED['mape']} FROM r_errors GROUP BY 1"),
)
def error_by_hour(spark, sf):
    return errors.error_by_hour(naive_errors(spark, sf))


_QUANTILE = "quantile_cont(CAST(caiso_mw AS DOUBLE), 0.95)"


@register(
    "d29_load_quantile_95",
    sql.readings(f"SELECT ROUND({_QUANTILE}, 8) AS load_threshold, COUNT(*) AS row_count FROM r_rows"),
)
def load_quantile_95(spark, sf):
    rows = inputs.readings(spark, sf)
    threshold = errors.load_threshold(rows, "caiso_mw")
    return summary.row_count(rows).withColumn("load_threshold", F.round(F.lit(threshold), 8))


@register(
    "d29_load_quantile_narrowed",
    sql.readings(f"SELECT ROUND({_QUANTILE}, 8) AS load_threshold, COUNT(*) AS row_count FROM r_rows"),
)
def load_quantile_narrowed(spark, sf):
    """The same quantile by repeated binning, as taken when the values do not fit into one task."""
    rows = inputs.readings(spark, sf)
    threshold = errors.load_threshold(rows, "caiso_mw", group_rows=1_000)
    return summary.row_count(rows).withColumn("load_threshold", F.round(F.lit(threshold), 8))


@register(
    "d30_peak_hours_metrics",
    sql.readings(
        f"""SELECT (SELECT {_QUANTILE} FROM r_errors) AS load_threshold, {", ".join(_ROUNDED.values())}
FROM r_errors WHERE caiso_mw >= (SELECT {_QUANTILE} FROM r_errors)"""
    ),
)
def peak_hours_metrics(spark, sf):
    results = store(naive_errors(spark, sf).select("caiso_mw", "error", "abs_error", "ape"), "results")
    return errors.peak_hours_metrics(results, "caiso_mw")


@register(
    "d31_model_leaderboard",
    sql.readings(
        f"""SELECT model, scored_rows, mae, rmse, mape,
  ROUND((mae - base) / base * 100, 6) AS mae_change_pct FROM (
  SELECT *, MAX(CASE WHEN model = 'naive_168' THEN mae END) OVER () AS base FROM (
    SELECT 'naive_24' AS model, COUNT(*) AS scored_rows, {sql.score("caiso_mw", "forecast_24")} FROM r_test
    UNION ALL
    SELECT 'naive_168', COUNT(*), {sql.score("caiso_mw", "forecast_168")} FROM r_test))"""
    ),
)
def model_leaderboard(spark, sf):
    models = {"naive_24": "forecast_24", "naive_168": "forecast_168"}
    return errors.leaderboard(naive_test(spark, sf), "caiso_mw", models, "naive_168")
