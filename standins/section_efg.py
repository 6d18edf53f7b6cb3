"""Windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.fixed import HISTORICAL, TERRITORIES
from hourgrid.operators import clean, features, order, summary
from hourgrid.plans import medallion
from hourgrid.sources import text
from standins import inputs, sql
from standins.registry import register
from standins.section_b import ID, IDS

NUMBERED = f"{IDS}, source_file, caiso_mw, pge_mw"
_NUMBERED = [*ID, "source_file", "caiso_mw", "pge_mw"]


@register("e01_hour_instance", sql.readings(f"SELECT {NUMBERED} FROM r_silver"))
def hour_instance(spark, sf):
    return order.number_repeated_hours(inputs.readings(spark, sf)).select(*_NUMBERED)


@register("e01_hour_instance_split", sql.readings(f"SELECT {NUMBERED} FROM r_silver"))
def hour_instance_split(spark, sf):
    """The same numbering by a range sort, as taken when one label outgrows a task."""
    return order.number_repeated_hours(inputs.readings(spark, sf), group_rows=1).select(*_NUMBERED)


@register("e02_records_at_hour_label", sql.hourly(f"SELECT {IDS}, records_at_hour_label FROM h_silver"))
def records_at_hour_label(spark, sf):
    return inputs.hourly_silver(spark, sf).select(*ID, "records_at_hour_label")


@register(
    "e02_records_at_hour_label_readings", sql.readings(f"SELECT {IDS}, records_at_hour_label FROM r_silver")
)
def records_at_hour_label_readings(spark, sf):
    return inputs.readings_silver(spark, sf).select(*ID, "records_at_hour_label")


@register(
    "e03_hours_in_load_date",
    sql.readings("SELECT load_date, hour_ending, caiso_mw, hours_in_load_date FROM r_gold"),
)
def hours_in_load_date(spark, sf):
    rows = inputs.readings(spark, sf).select("load_date", "hour_ending", "caiso_mw")
    return order.add_hours_in_day(rows)


def _lag(hours):
    def query(spark, sf):
        lagged = order.add_lags(inputs.readings_placed(spark, sf), order.load_lags(hours=[hours]))
        return lagged.select(*ID, "caiso_mw", f"caiso_lag_{hours}_mw")

    return query


for _place, _hours in ((4, 24), (5, 168)):
    register(
        f"e{_place:02d}_lag_{_hours}", sql.readings(f"SELECT {IDS}, caiso_mw, caiso_lag_{_hours}_mw FROM r_gold")
    )(_lag(_hours))


@register(
    "e04_lag_across_stages",
    sql.hourly(
        f"""SELECT source_stage, {IDS}, caiso_mw, caiso_lag_24_mw, caiso_lag_168_mw FROM h_gold
WHERE source_stage = 'validation'"""
    ),
)
def lag_across_stages(spark, sf):
    """The first validation rows look back into the historical stage."""
    gold = inputs.hourly_gold(spark, sf).where("source_stage = 'validation'")
    return gold.select("source_stage", *ID, "caiso_mw", "caiso_lag_24_mw", "caiso_lag_168_mw")


_ROLLING = """SELECT source_stage, load_date, average_load_mw, ROUND({mean}, 8) AS rolling
FROM r_daily WINDOW w AS ({part} ORDER BY load_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""


@register(
    "e06_rolling_30_partial",
    sql.readings(_ROLLING.format(mean="AVG(average_load_mw) OVER w", part="PARTITION BY source_stage")),
)
def rolling_30_partial(spark, sf):
    daily = summary.daily_summary(inputs.readings(spark, sf))
    rolled = summary.add_rolling_mean(daily, "average_load_mw", "rolling", partition=["source_stage"])
    return rolled.select("source_stage", "load_date", "average_load_mw", F.round("rolling", 8).alias("rolling"))


_BY_DATE = f"""SELECT load_date, average_load_mw,
  ROUND(CASE WHEN COUNT(*) OVER w = 30 THEN AVG(average_load_mw) OVER w END, 8) AS rolling
FROM (SELECT load_date, {sql.mean("caiso_mw")} AS average_load_mw FROM r_rows GROUP BY 1)
WINDOW w AS (ORDER BY load_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""


@register("e07_rolling_30_full", sql.readings(_BY_DATE))
def rolling_30_full(spark, sf):
    daily = summary.mean_by(inputs.readings(spark, sf), ["load_date"], name="average_load_mw")
    rolled = summary.add_rolling_mean(daily, "average_load_mw", "rolling", full_only=True)
    return rolled.select("load_date", "average_load_mw", F.round("rolling", 8).alias("rolling"))


@register(
    "e08_monthly_peak_hour",
    sql.readings(
        """SELECT load_year, load_month, load_date, hour_ending, caiso_mw AS monthly_peak_load_mw,
  caiso_minus_regional_mw FROM r_gold WHERE source_stage = 'historical'
QUALIFY ROW_NUMBER() OVER (PARTITION BY load_year, load_month
  ORDER BY caiso_mw DESC, load_date, hour_ending, hour_instance) = 1"""
    ),
)
def monthly_peak_hour(spark, sf):
    rows = features.at_stage(inputs.readings_silver(spark, sf), HISTORICAL)
    return summary.monthly_peak_hours(features.add_year_month(rows))


_REGION = ", ".join(f"LAG({t}_mw, {k}) OVER w AS {t}_lag_{k}_mw" for t in TERRITORIES for k in (24, 168))


@register(
    "e09_region_lags",
    sql.readings(f"SELECT {IDS}, {_REGION} FROM r_placed WINDOW w AS (ORDER BY row_ix)"),
)
def region_lags(spark, sf):
    lags = order.load_lags(TERRITORIES)
    return order.add_lags(inputs.readings_placed(spark, sf), lags).select(*ID, *lags)


@register(
    "e10_seasonal_difference",
    sql.readings(
        f"SELECT {IDS}, caiso_mw, caiso_mw - forecast_24 AS diff_24, caiso_mw - forecast_168 AS diff_168 FROM r_naive"
    ),
)
def seasonal_difference(spark, sf):
    gaps = order.add_seasonal_differences(inputs.readings_placed(spark, sf), "caiso_mw")
    return gaps.select(*ID, "caiso_mw", "diff_24", "diff_168")


@register("e11_row_index", sql.readings(f"SELECT {IDS}, caiso_mw, row_ix FROM r_placed"))
def row_index(spark, sf):
    return inputs.readings_placed(spark, sf).select(*ID, "caiso_mw", "row_ix")


@register("e11_row_index_by_sort", sql.readings(f"SELECT {IDS}, caiso_mw, row_ix FROM r_placed"))
def row_index_by_sort(spark, sf):
    """Positions by a range sort, for rows that carry no numbering."""
    rows = inputs.readings_silver(spark, sf).select(*ID, "caiso_mw")
    return order.range_positions(rows, ID)


@register(
    "e12_duplicate_rows",
    sql.readings(
        """SELECT local_timestamp_label, load_date, hour_ending, caiso_mw FROM r_silver
WHERE records_at_hour_label > 1"""
    ),
)
def duplicate_rows(spark, sf):
    rows = clean.add_hour_label(inputs.readings(spark, sf))
    kept = rows.select("local_timestamp_label", "load_date", "hour_ending", "caiso_mw")
    return order.duplicate_rows(kept, ["local_timestamp_label"])


_FIRST = f"SELECT {IDS}, caiso_mw FROM r_silver ORDER BY load_date, hour_ending, hour_instance LIMIT 10"
_LAST = f"SELECT {IDS}, caiso_mw FROM r_silver ORDER BY load_date DESC, hour_ending DESC, hour_instance DESC LIMIT 10"


@register("f01_preview", sql.readings(_FIRST))
def preview(spark, sf):
    return summary.preview(inputs.readings_silver(spark, sf).select(*ID, "caiso_mw"), ID)


@register("f01_preview_tail", sql.readings(_LAST))
def preview_tail(spark, sf):
    return summary.preview(inputs.readings_silver(spark, sf).select(*ID, "caiso_mw"), ID, last=True)


@register("f02_sort_time", sql.readings(f"SELECT {IDS}, caiso_mw FROM r_silver ORDER BY row_ix".replace("r_silver", "r_placed")))
def sort_time(spark, sf):
    return summary.sort_time(inputs.readings_silver(spark, sf).select(*ID, "caiso_mw"))


@register(
    "f03_sort_result",
    sql.readings(
        """SELECT source_stage, tou_period, CAST(SUM(hourly_observations) AS BIGINT) AS hourly_observations,
  CAST(SUM(system_load_mwh_proxy) AS DECIMAL(38,3)) AS system_load_mwh_proxy
FROM r_tou GROUP BY 1, 2 ORDER BY 1, 2"""
    ),
)
def sort_result(spark, sf):
    totals = summary.tou_totals(medallion.gold_monthly_tou(inputs.readings(spark, sf)))
    return totals.orderBy("source_stage", "tou_period")


@register(
    "f04_rolling_trend_listing",
    sql.readings(
        """SELECT load_date, average_load_mw, ROUND(AVG(average_load_mw) OVER
  (ORDER BY load_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 8) AS rolling_30_day_average_load_mw
FROM r_daily WHERE source_stage = 'historical' ORDER BY load_date"""
    ),
)
def rolling_trend_listing(spark, sf):
    trend = medallion.rolling_trend(medallion.gold_daily_summary(inputs.readings(spark, sf)))
    name = "rolling_30_day_average_load_mw"
    return trend.withColumn(name, F.round(name, 8))


@register("g01_union_all_loads", sql.readings("SELECT * FROM r_raw"))
def union_all_loads(spark, sf):
    historical, validation = inputs.readings_raw(spark, sf)
    return clean.stack_stages({"historical": historical, "validation": validation})


@register("g02_union_all_weather", sql.hourly("SELECT * FROM h_weather_raw"))
def union_all_weather(spark, sf):
    historical, validation = inputs.hourly_weather_raw(spark, sf)
    return clean.stack_stages({"historical": historical, "validation": validation})


@register(
    "g03_concat_load_and_weather",
    sql.readings(
        """SELECT 'load' AS kind, "Date" AS label, "CAISO" AS value, NULL AS temp_fresno_f FROM r_raw
UNION ALL SELECT 'weather', CAST("timestamp" AS VARCHAR), NULL, temp_fresno_f FROM r_weather"""
    ),
)
def concat_load_and_weather(spark, sf):
    """Rows of two stages each, matched by name, columns of the other kind NULL."""
    load = text.stack_by_name(inputs.readings_raw(spark, sf)).select(
        F.lit("load").alias("kind"), F.col("Date").alias("label"), F.col("CAISO").alias("value")
    )
    weather = inputs.readings_weather(spark, sf)
    cut = F.lit("2001-01-01").cast("timestamp_ntz")
    stages = [weather.where(F.col("timestamp") < cut), weather.where(F.col("timestamp") >= cut)]
    stacked = text.stack_by_name(stages).select(
        "temp_fresno_f", F.lit("weather").alias("kind"), F.col("timestamp").cast("string").alias("label")
    )
    return text.stack_by_name([load, stacked])
