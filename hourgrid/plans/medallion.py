"""Bronze text to silver rows to gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.fixed import HISTORICAL, HOUR_KEY, TEMPERATURE_COLUMNS, VALIDATION
from hourgrid.operators import clean, features, joins, order, summary

SILVER_LOADS = [
    "source_stage",
    "load_date",
    "hour_ending",
    "hour_instance",
    "records_at_hour_label",
    "local_timestamp_label",
    "pge_mw",
    "sce_mw",
    "sdge_mw",
    "vea_mw",
    "caiso_mw",
    "regional_total_mw",
    "caiso_minus_regional_mw",
    "source_file",
]
SILVER_WEATHER = [
    "source_stage",
    "weather_timestamp_label",
    "weather_date",
    "hour_ending",
    *TEMPERATURE_COLUMNS,
]
GOLD_FEATURES = [
    "source_stage",
    "load_date",
    "hour_ending",
    "hour_instance",
    "local_timestamp_label",
    "load_year",
    "load_month",
    "weekday_number",
    "is_weekend",
    "pge_mw",
    "sce_mw",
    "sdge_mw",
    "vea_mw",
    "caiso_mw",
    "regional_total_mw",
    "caiso_minus_regional_mw",
    "caiso_lag_24_mw",
    "caiso_lag_168_mw",
    "hours_in_load_date",
]


def _typed(historical: DataFrame, validation: DataFrame) -> DataFrame:
    stacked = clean.stack_stages({HISTORICAL: historical, VALIDATION: validation})
    return clean.type_loads(clean.drop_footer_rows(stacked))


def typed_loads(historical: DataFrame, validation: DataFrame) -> DataFrame:
    """Both stages, footers and incomplete rows dropped, typed."""
    return clean.complete_loads(_typed(historical, validation))


def silver_loads(historical: DataFrame, validation: DataFrame) -> DataFrame:
    """Numbered per hour label; the check for large labels parses dates and hours only."""
    labels = _typed(historical, validation).select(*HOUR_KEY)
    numbered = order.number_repeated_hours(typed_loads(historical, validation), labels=labels)
    return clean.add_regional_total(clean.add_hour_label(numbered)).select(*SILVER_LOADS)


def silver_weather(historical: DataFrame, validation: DataFrame) -> DataFrame:
    """No exchange: every step looks at one row."""
    stacked = clean.stack_stages({HISTORICAL: historical, VALIDATION: validation})
    typed = clean.complete_weather(clean.type_weather(stacked))
    return clean.add_weather_hour(typed).select(*SILVER_WEATHER)


def gold_features(silver: DataFrame) -> DataFrame:
    """Calendar, both system lags over the whole series (stages included), rows per day."""
    placed = order.add_lags(order.add_position(silver), order.load_lags())
    return features.add_weekday(features.add_year_month(placed)).select(*GOLD_FEATURES)


def gold_load_weather(gold: DataFrame, weather: DataFrame) -> DataFrame:
    return joins.join_weather_on_full_days(gold, weather)


def gold_daily_summary(gold: DataFrame) -> DataFrame:
    """Daily rows with a rolling mean over the rows there are, restarting with each stage."""
    return summary.add_rolling_mean(
        summary.daily_summary(gold),
        "average_load_mw",
        "rolling_30_day_average_load_mw",
        partition=["source_stage"],
    )


def gold_monthly_tou(silver: DataFrame) -> DataFrame:
    """From silver or gold rows: only the date, hour, stage and load are read."""
    weekend = features.add_weekday(silver) if "is_weekend" not in silver.columns else silver
    return summary.monthly_tou(weekend)


def rolling_trend(daily: DataFrame, stage: str = HISTORICAL) -> DataFrame:
    listed = daily.where(F.col("source_stage") == stage)
    return listed.select("load_date", "average_load_mw", "rolling_30_day_average_load_mw").orderBy("load_date")
