"""Joins and argmax rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.fixed import CITIES, FOUR_CITIES, TEMPERATURE_COLUMNS
from hourgrid.operators import features, joins, order, summary
from standins import inputs, sql
from standins.registry import register
from standins.section_b import ID, IDS


@register("c01_weather_left_join_guarded", sql.hourly("SELECT * FROM h_load_weather"))
def weather_left_join_guarded(spark, sf):
    return inputs.hourly_load_weather(spark, sf)


@register(
    "c02_weather_left_join_ts",
    sql.readings(
        f"""SELECT {IDS}, local_timestamp_label AS "timestamp", caiso_mw, {sql.TEMPS}
FROM r_silver LEFT JOIN r_weather ON local_timestamp_label = "timestamp" """
    ),
)
def weather_left_join_ts(spark, sf):
    silver = inputs.readings_silver(spark, sf).withColumnRenamed("local_timestamp_label", "timestamp")
    joined = joins.join_weather_on_label(silver, inputs.readings_weather(spark, sf))
    return joined.select(*ID, "timestamp", "caiso_mw", *TEMPERATURE_COLUMNS)


def _wide(cities):
    """Cities lose different hours, so the outer join has gaps on every side."""
    kept = {c: f"(EXTRACT(HOUR FROM \"timestamp\") + {i}) % 5 <> 0" for i, c in enumerate(cities)}
    columns = ", ".join(f"CASE WHEN {k} THEN CAST(temp_{c}_f AS DOUBLE) END AS temp_{c}" for c, k in kept.items())
    return f"""SELECT "timestamp", {columns} FROM r_weather WHERE {" OR ".join(kept.values())}"""


def _gappy(spark, sf, cities):
    place = F.array_position(F.array(*[F.lit(c) for c in cities]), F.col("city")) - 1
    long = inputs.city_readings(spark, sf, cities)
    return long.where((F.hour("timestamp") + place) % 5 != 0)


@register("c03_city_outer_join", sql.readings(_wide(CITIES)))
def city_outer_join(spark, sf):
    return joins.cities_side_by_side(_gappy(spark, sf, CITIES), CITIES)


@register("c03_city_outer_join_four", sql.readings(_wide(FOUR_CITIES)))
def city_outer_join_four(spark, sf):
    return joins.cities_side_by_side(_gappy(spark, sf, FOUR_CITIES), FOUR_CITIES)


@register(
    "c04_assign_by_row_key",
    sql.readings(
        """SELECT row_ix, load_date, hour_ending, caiso_mw,
  CASE WHEN YEAR(load_date) = 2000 THEN forecast_24 END AS forecast_rf FROM r_naive"""
    ),
)
def assign_by_row_key(spark, sf):
    placed = inputs.readings_placed(spark, sf)
    lagged = order.add_lags(placed, {"forecast_rf": ("caiso_mw", 24)})
    _, test = features.split_by_year(lagged, inputs.LAST_TRAIN_YEAR)
    rows = placed.select("row_ix", "load_date", "hour_ending", "caiso_mw")
    return joins.assign_by_key(rows, test.select("row_ix", "forecast_rf"))


@register(
    "c05_argmax_rows_per_group",
    sql.readings(
        """SELECT load_year, load_month, load_date, hour_ending, hour_instance, caiso_mw FROM r_gold
QUALIFY ROW_NUMBER() OVER (PARTITION BY load_year, load_month
  ORDER BY caiso_mw DESC, load_date, hour_ending, hour_instance) = 1"""
    ),
)
def argmax_rows_per_group(spark, sf):
    rows = features.add_year_month(inputs.readings_silver(spark, sf))
    return joins.peak_rows_by(rows, ["load_year", "load_month"], "caiso_mw", [*ID, "caiso_mw"])


@register(
    "c06_argmax_row",
    sql.readings(
        f"""SELECT {IDS}, caiso_mw, forecast_24 FROM r_naive WHERE YEAR(load_date) = 2000
ORDER BY caiso_mw DESC, row_ix LIMIT 1"""
    ),
)
def argmax_row(spark, sf):
    lagged = order.add_lags(inputs.readings_placed(spark, sf), {"forecast_24": ("caiso_mw", 24)})
    _, test = features.split_by_year(lagged, inputs.LAST_TRAIN_YEAR)
    return joins.peak_row(test, "caiso_mw").select(*ID, "caiso_mw", "forecast_24")


@register(
    "c07_reindex_days",
    sql.readings(
        f"""SELECT CAST(o AS INT) AS day_order, d AS day_name, average_caiso_load_mw
FROM (VALUES (1, 'Monday'), (2, 'Tuesday'), (3, 'Wednesday'), (4, 'Thursday'), (5, 'Friday'),
  (6, 'Saturday'), (7, 'Sunday')) AS days(o, d)
LEFT JOIN (SELECT DAYNAME(load_date) AS d, {sql.mean("caiso_mw")} AS average_caiso_load_mw FROM r_rows
  WHERE ISODOW(load_date) <> 3 GROUP BY 1) USING (d)"""
    ),
)
def reindex_days(spark, sf):
    """No Wednesday in the data: the day stays, with NULL."""
    rows = features.add_day_name(inputs.readings(spark, sf)).where(F.col("day_of_week") != 2)
    return joins.in_day_order(summary.mean_by(rows, ["day_name"]), "day_name")


@register(
    "c07_reindex_days_whole",
    sql.readings(
        f"""SELECT CAST(o AS INT) AS day_order, d AS day_name, average_caiso_load_mw
FROM (VALUES (1, 'Monday'), (2, 'Tuesday'), (3, 'Wednesday'), (4, 'Thursday'), (5, 'Friday'),
  (6, 'Saturday'), (7, 'Sunday')) AS days(o, d)
LEFT JOIN (SELECT DAYNAME(load_date) AS d, {sql.mean("caiso_mw")} AS average_caiso_load_mw FROM r_rows GROUP BY 1) USING (d)"""
    ),
)
def reindex_days_whole(spark, sf):
    rows = features.add_day_name(inputs.readings(spark, sf))
    return joins.in_day_order(summary.mean_by(rows, ["day_name"]), "day_name")
