"""Whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.plans import exploration, layers, medallion
from hourgrid.sources import text
from hourgrid.sources.scratch import scratch_path
from standins import inputs, sql
from standins.registry import register


@register("k01_silver_loads", sql.hourly("SELECT * FROM h_silver"))
def silver_loads(spark, sf):
    return inputs.hourly_silver(spark, sf)


@register("k01_silver_loads_readings", sql.readings("SELECT * FROM r_silver"))
def silver_loads_readings(spark, sf):
    """From text: many rows per label, three sources."""
    return medallion.silver_loads(*inputs.readings_raw(spark, sf))


@register("k02_silver_weather", sql.hourly("SELECT * FROM h_weather"))
def silver_weather(spark, sf):
    return medallion.silver_weather(*inputs.hourly_weather_raw(spark, sf))


@register("k03_gold_features", sql.hourly("SELECT * FROM h_gold"))
def gold_features(spark, sf):
    return inputs.hourly_gold(spark, sf)


@register("k03_gold_features_readings", sql.readings("SELECT * FROM r_gold"))
def gold_features_readings(spark, sf):
    return medallion.gold_features(medallion.silver_loads(*inputs.readings_raw(spark, sf)))


@register("k04_gold_load_weather", sql.hourly("SELECT * FROM h_load_weather"))
def gold_load_weather(spark, sf):
    return inputs.hourly_load_weather(spark, sf)


@register("k04_layers_written", sql.hourly("SELECT * FROM h_load_weather"))
def layers_written(spark, sf):
    """The whole batch through staged files and tables; the last join read back."""
    paths = []
    for raw in (inputs.hourly_raw(spark, sf), inputs.hourly_weather_raw(spark, sf)):
        paths.append({stage: scratch_path(spark, "staged") for stage in layers.STAGES})
        for stage, rows in zip(layers.STAGES, raw):
            text.write_csv(rows, paths[-1][stage])
    built = layers.rebuild_layers(spark, *paths, scratch_path(spark, "layers"))
    return built[layers.GOLD_LOAD_WEATHER]


_ROLLED = """SELECT *, ROUND(AVG(average_load_mw) OVER (PARTITION BY source_stage ORDER BY load_date
  ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 8) AS rolling_30_day_average_load_mw FROM {p}_daily"""
ROLLING = "rolling_30_day_average_load_mw"


@register("k05_gold_daily_summary", sql.hourly(_ROLLED.format(p="h")))
def gold_daily_summary(spark, sf):
    daily = medallion.gold_daily_summary(inputs.hourly_silver(spark, sf))
    return daily.withColumn(ROLLING, F.round(ROLLING, 8))


@register("k05_gold_daily_summary_readings", sql.readings(_ROLLED.format(p="r")))
def gold_daily_summary_readings(spark, sf):
    daily = medallion.gold_daily_summary(inputs.readings(spark, sf))
    return daily.withColumn(ROLLING, F.round(ROLLING, 8))


@register("k06_gold_monthly_tou", sql.hourly("SELECT * FROM h_tou"))
def gold_monthly_tou(spark, sf):
    return medallion.gold_monthly_tou(inputs.hourly_gold(spark, sf))


@register("k06_gold_monthly_tou_readings", sql.readings("SELECT * FROM r_tou"))
def gold_monthly_tou_readings(spark, sf):
    """The summary reads neither lags nor row numbers, so typed text rows are enough."""
    return medallion.gold_monthly_tou(medallion.typed_loads(*inputs.readings_raw(spark, sf)))


def _pack(part):
    def query(spark, sf):
        gold = inputs.hourly_gold(spark, sf)
        daily = medallion.gold_daily_summary(gold)
        weather = medallion.silver_weather(*inputs.hourly_weather_raw(spark, sf))
        answer = exploration.exploration_pack(gold, medallion.gold_load_weather(gold, weather), daily)[part]
        return answer.withColumn(ROLLING, F.round(ROLLING, 8)) if ROLLING in answer.columns else answer

    return query


_MEAN = sql.mean("caiso_mw")
_ANSWERS = {
    "coverage": """SELECT source_stage, COUNT(*) AS hourly_rows, MIN(load_date) AS first_load_date,
  MAX(load_date) AS last_load_date, COUNT(*) FILTER (hours_in_load_date <> 24) AS rows_on_dst_transition_dates
FROM h_gold GROUP BY 1""",
    "hourly_profile": f"""SELECT hour_ending, {_MEAN} AS average_caiso_load_mw, MIN(caiso_mw) AS minimum_caiso_load_mw,
  MAX(caiso_mw) AS maximum_caiso_load_mw FROM h_gold WHERE source_stage = 'historical' GROUP BY 1""",
    "weekend_profile": f"""SELECT hour_ending, is_weekend, {_MEAN} AS average_caiso_load_mw
FROM h_gold WHERE source_stage = 'historical' GROUP BY 1, 2""",
    "monthly_peaks": """SELECT load_year, load_month, load_date, hour_ending, caiso_mw AS monthly_peak_load_mw,
  caiso_minus_regional_mw FROM h_gold WHERE source_stage = 'historical'
QUALIFY ROW_NUMBER() OVER (PARTITION BY load_year, load_month
  ORDER BY caiso_mw DESC, load_date, hour_ending, hour_instance) = 1""",
    "rolling_trend": f"""SELECT load_date, average_load_mw, {ROLLING}
FROM ({_ROLLED.format(p="h")}) WHERE source_stage = 'historical'""",
    "temperature_bands": f"""SELECT CASE WHEN temp_sacramento_f < 55 THEN 'Below 55 F'
    WHEN temp_sacramento_f < 70 THEN '55 to under 70 F'
    WHEN temp_sacramento_f < 85 THEN '70 to under 85 F' ELSE '85 F and above' END AS sacramento_temperature_band,
  COUNT(*) AS hourly_rows, {_MEAN} AS average_caiso_load_mw
FROM h_load_weather WHERE source_stage = 'historical' AND weather_match_status = 'matched' GROUP BY 1""",
}
for _part, _sql in _ANSWERS.items():
    register(f"k07_exploration_{_part}", sql.hourly(_sql))(_pack(_part))
