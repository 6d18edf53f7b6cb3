"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.fixed import CITIES, HISTORICAL, LOAD_COLUMNS, MATCHED, TEMPERATURE_COLUMNS
from hourgrid.functions import calendar
from hourgrid.operators import clean, errors, features, order, summary
from hourgrid.plans import forecasts, medallion
from hourgrid.sources.text import stack_by_name
from standins import inputs, sql
from standins.registry import register

ID = ["load_date", "hour_ending", "hour_instance"]
IDS = ", ".join(ID)
LOADS_MW = ", ".join(LOAD_COLUMNS)


@register(
    "b01_normalise_columns",
    sql.readings('SELECT "Date" AS "date", "HR" AS hr, "PGE" AS pge, "CAISO" AS caiso, source_file FROM r_raw'),
)
def normalise_columns(spark, sf):
    text = inputs.as_text(inputs.readings(spark, sf)).select("Date", "HR", "PGE", "CAISO", "source_file")
    return clean.normalise_columns(text.toDF(" Date", "HR ", " PGE ", "CAISO", "Source_File"))


@register("b02_tag_stage", sql.readings("SELECT 'historical' AS source_stage, load_date, hour_ending, caiso_mw FROM r_rows"))
def tag_stage(spark, sf):
    return clean.tag_stage(inputs.readings(spark, sf).select("load_date", "hour_ending", "caiso_mw"), HISTORICAL)


@register("b03_drop_footer_rows", sql.hourly("SELECT * FROM h_kept"))
def drop_footer_rows(spark, sf):
    historical, validation = inputs.hourly_raw(spark, sf)
    return clean.drop_footer_rows(clean.stack_stages({"historical": historical, "validation": validation}))


@register("b04_safe_cast_loads", sql.hourly("SELECT * FROM h_typed"))
def safe_cast_loads(spark, sf):
    historical, validation = inputs.hourly_raw(spark, sf)
    stacked = clean.stack_stages({"historical": historical, "validation": validation})
    return clean.type_loads(clean.drop_footer_rows(stacked))


@register(
    "b05_safe_cast_weather",
    sql.hourly(f"SELECT source_stage, weather_timestamp_label, {sql.TEMPS} FROM h_weather"),
)
def safe_cast_weather(spark, sf):
    historical, validation = inputs.hourly_weather_raw(spark, sf)
    return clean.type_weather(clean.stack_stages({"historical": historical, "validation": validation}))


@register("b06_complete_rows_loads", sql.hourly("SELECT * FROM h_rows"))
def complete_rows_loads(spark, sf):
    return clean.complete_loads(safe_cast_loads(spark, sf))


@register(
    "b07_complete_rows_weather",
    f"""SELECT user_id, weather_timestamp_label, {sql.TEMPS} FROM (
  SELECT user_id, ts AS weather_timestamp_label,
    {", ".join(f"CASE WHEN event_id % {i + 2} = 0 THEN NULL ELSE CAST(user_id % 60 + {i} AS DECIMAL(5,1)) END AS temp_{c}_f" for i, c in enumerate(CITIES, 1))}
  FROM events) WHERE {" AND ".join(f"temp_{c}_f IS NOT NULL" for c in CITIES)}""",
)
def complete_rows_weather(spark, sf):
    """Every city lacks a share of the events; only rows with all seven stay."""
    gaps = {
        f"temp_{c}_f": F.when(F.col("event_id") % (i + 2) == 0, None).otherwise(
            (F.col("user_id") % 60 + i).cast("decimal(5,1)")
        )
        for i, c in enumerate(CITIES, 1)
    }
    rows = inputs.table(spark, sf, "events").select(
        "user_id", F.col("ts").alias("weather_timestamp_label"), *[v.alias(n) for n, v in gaps.items()]
    )
    return clean.complete_weather(rows)


@register(
    "b08_regional_total_residual",
    sql.readings(f"SELECT {IDS}, regional_total_mw, caiso_minus_regional_mw FROM r_silver"),
)
def regional_total_residual(spark, sf):
    numbered = order.number_repeated_hours(inputs.readings(spark, sf))
    return clean.add_regional_total(numbered).select(*ID, "regional_total_mw", "caiso_minus_regional_mw")


@register("b09_hour_label", sql.readings("SELECT load_date, hour_ending, local_timestamp_label FROM r_silver"))
def hour_label(spark, sf):
    return clean.add_hour_label(inputs.readings(spark, sf)).select(
        "load_date", "hour_ending", "local_timestamp_label"
    )


@register(
    "b10_weather_date_hour",
    """SELECT event_id, CAST(ts AS DATE) AS weather_date, CAST(EXTRACT(HOUR FROM ts) AS INT) + 1 AS hour_ending
FROM events""",
)
def weather_date_hour(spark, sf):
    labels = inputs.table(spark, sf, "events").select("event_id", F.col("ts").alias("weather_timestamp_label"))
    return clean.add_weather_hour(labels).drop("weather_timestamp_label")


def _calendar(spark, sf):
    rows = inputs.readings(spark, sf).select("load_date", "hour_ending", "caiso_mw")
    return features.add_day_name(features.add_weekday(features.add_year_month(rows)))


_CALENDAR = """SELECT load_date, hour_ending, caiso_mw, {columns} FROM r_rows"""


@register(
    "b11_calendar_features",
    sql.readings(
        _CALENDAR.format(
            columns="CAST(YEAR(load_date) AS INT) AS load_year, CAST(MONTH(load_date) AS INT) AS load_month"
        )
    ),
)
def calendar_features(spark, sf):
    return _calendar(spark, sf).select("load_date", "hour_ending", "caiso_mw", "load_year", "load_month")


@register(
    "b12_weekday_number",
    sql.readings(
        _CALENDAR.format(
            columns="CAST(date_diff('day', DATE '1900-01-01', load_date) % 7 + 1 AS INT) AS weekday_number"
        )
    ),
)
def weekday_number(spark, sf):
    return _calendar(spark, sf).select("load_date", "hour_ending", "caiso_mw", "weekday_number")


@register(
    "b13_weekend_flag",
    sql.readings(_CALENDAR.format(columns="CASE WHEN ISODOW(load_date) >= 6 THEN 1 ELSE 0 END AS is_weekend")),
)
def weekend_flag(spark, sf):
    return _calendar(spark, sf).select("load_date", "hour_ending", "caiso_mw", "is_weekend")


@register(
    "b14_day_name",
    sql.readings(
        _CALENDAR.format(columns="DAYNAME(load_date) AS day_name, CAST(ISODOW(load_date) - 1 AS INT) AS day_of_week")
    ),
)
def day_name(spark, sf):
    return _calendar(spark, sf).select("load_date", "hour_ending", "caiso_mw", "day_name", "day_of_week")


@register("b15_gold_feature_projection", sql.readings("SELECT * FROM r_gold"))
def gold_feature_projection(spark, sf):
    return medallion.gold_features(inputs.readings_silver(spark, sf))


@register(
    "b16_weather_match_status",
    sql.hourly("SELECT load_date, hour_ending, hour_instance, weather_match_status FROM h_load_weather"),
)
def weather_match_status(spark, sf):
    return inputs.hourly_load_weather(spark, sf).select(*ID, "weather_match_status")


@register(
    "b17_tou_classify",
    sql.readings(
        """SELECT load_date, hour_ending, caiso_mw,
  CASE WHEN hour_ending BETWEEN 17 AND 21 THEN 'On-Peak'
       WHEN hour_ending <= 14 AND (ISODOW(load_date) >= 6 OR hour_ending NOT BETWEEN 7 AND 10) THEN 'Super Off-Peak'
       ELSE 'Off-Peak' END AS tou_period
FROM r_rows"""
    ),
)
def tou_classify(spark, sf):
    period = calendar.tou_period(F.col("hour_ending"), F.col("is_weekend"))
    return _calendar(spark, sf).select("load_date", "hour_ending", "caiso_mw", period.alias("tou_period"))


@register(
    "b18_temperature_band",
    sql.readings(
        """SELECT "timestamp", CASE WHEN temp_sacramento_f < 55 THEN 'Below 55 F'
  WHEN temp_sacramento_f < 70 THEN '55 to under 70 F'
  WHEN temp_sacramento_f < 85 THEN '70 to under 85 F' ELSE '85 F and above' END AS band FROM r_weather"""
    ),
)
def temperature_band(spark, sf):
    band = calendar.temperature_band(F.col("temp_sacramento_f"))
    return inputs.readings_weather(spark, sf).select("timestamp", band.alias("band"))


@register(
    "b19_squared_terms",
    sql.readings(
        'SELECT "timestamp", ' + ", ".join(f"CAST(temp_{c}_f * temp_{c}_f AS DECIMAL(11,2)) AS temp_{c}_f_sq" for c in CITIES) + " FROM r_weather"
    ),
)
def squared_terms(spark, sf):
    return features.add_squares(inputs.readings_weather(spark, sf), TEMPERATURE_COLUMNS).drop(*TEMPERATURE_COLUMNS)


@register(
    "b20_year_split",
    sql.readings(
        f"""SELECT 'train' AS part, load_date, hour_ending, {LOADS_MW} FROM r_rows WHERE YEAR(load_date) <= 1999
UNION ALL SELECT 'test', load_date, hour_ending, {LOADS_MW} FROM r_rows WHERE YEAR(load_date) = 2000"""
    ),
)
def year_split(spark, sf):
    rows = inputs.readings(spark, sf).select("load_date", "hour_ending", *LOAD_COLUMNS)
    train, test = features.split_by_year(rows, inputs.LAST_TRAIN_YEAR)
    return stack_by_name([t.select(F.lit(n).alias("part"), "*") for n, t in {"train": train, "test": test}.items()])


@register(
    "b21_date_range_filter",
    sql.readings(
        f"SELECT load_date, hour_ending, {LOADS_MW} FROM r_rows WHERE load_date BETWEEN DATE '2000-07-01' AND DATE '2000-07-14'"
    ),
)
def date_range_filter(spark, sf):
    rows = inputs.readings(spark, sf).select("load_date", "hour_ending", *LOAD_COLUMNS)
    return features.between_days(rows, "2000-07-01", "2000-07-14")


@register(
    "b21_peak_week_filter",
    sql.readings(
        f"""SELECT load_date, hour_ending, {LOADS_MW} FROM r_rows
WHERE ABS(date_diff('day', load_date, (SELECT load_date FROM r_rows ORDER BY caiso_mw DESC, load_date LIMIT 1))) <= 3"""
    ),
)
def peak_week_filter(spark, sf):
    rows = inputs.readings(spark, sf).select("load_date", "hour_ending", *LOAD_COLUMNS)
    return features.around_peak(rows, "caiso_mw")


@register(
    "b22_stage_status_filter",
    sql.hourly(
        f"""SELECT {IDS}, caiso_mw, temp_sacramento_f FROM h_load_weather
WHERE source_stage = 'historical' AND weather_match_status = 'matched'"""
    ),
)
def stage_status_filter(spark, sf):
    kept = features.at_stage(inputs.hourly_load_weather(spark, sf), HISTORICAL, MATCHED)
    return kept.select(*ID, "caiso_mw", "temp_sacramento_f")


@register(
    "b23_drop_missing_features",
    sql.readings(f"SELECT {IDS}, caiso_mw, caiso_lag_24_mw, caiso_lag_168_mw FROM r_gold WHERE caiso_lag_168_mw IS NOT NULL"),
)
def drop_missing_features(spark, sf):
    lagged = order.add_lags(inputs.readings_placed(spark, sf), order.load_lags())
    kept = clean.drop_missing(lagged, ["caiso_lag_24_mw", "caiso_lag_168_mw"])
    return kept.select(*ID, "caiso_mw", "caiso_lag_24_mw", "caiso_lag_168_mw")


@register(
    "b24_rows_with_any_null",
    sql.readings(f"SELECT {IDS}, caiso_lag_24_mw, caiso_lag_168_mw FROM r_gold WHERE caiso_lag_24_mw IS NULL OR caiso_lag_168_mw IS NULL"),
)
def rows_with_any_null(spark, sf):
    lagged = order.add_lags(inputs.readings_placed(spark, sf), order.load_lags())
    lags = ["caiso_lag_24_mw", "caiso_lag_168_mw"]
    return clean.rows_with_any_null(lagged, lags).select(*ID, *lags)


@register("b25_null_date_rows", sql.hourly('SELECT * FROM h_raw WHERE "Date" IS NULL'))
def null_date_rows(spark, sf):
    historical, validation = inputs.hourly_raw(spark, sf)
    return clean.rows_without_date(clean.stack_stages({"historical": historical, "validation": validation}))


def naive_test(spark, sf):
    """Test year with the naive forecasts."""
    forecast = forecasts.naive_forecasts(inputs.readings_silver(spark, sf))
    return features.split_by_year(forecast, inputs.LAST_TRAIN_YEAR)[1]


def naive_errors(spark, sf):
    return errors.add_errors(naive_test(spark, sf), "caiso_mw", "forecast_24")


@register(
    "b26_forecast_errors",
    sql.readings(f"SELECT {IDS}, error, abs_error, ROUND(ape, 8) AS ape FROM r_errors"),
)
def forecast_errors(spark, sf):
    return naive_errors(spark, sf).select(*ID, "error", "abs_error", F.round("ape", 8).alias("ape"))


@register(
    "b27_top_load_filter",
    sql.readings(
        f"""SELECT {IDS}, caiso_mw FROM r_silver
WHERE caiso_mw >= (SELECT quantile_cont(CAST(caiso_mw AS DOUBLE), 0.95) FROM r_silver)"""
    ),
)
def top_load_filter(spark, sf):
    return errors.top_load_rows(inputs.readings_silver(spark, sf), "caiso_mw").select(*ID, "caiso_mw")


@register(
    "b28_peak_error_row",
    sql.readings(
        """SELECT load_date, hour_ending, caiso_mw AS peak_load, forecast_24 AS peak_forecast, error AS peak_error,
  ROUND(ape, 8) AS peak_error_pct
FROM r_errors ORDER BY caiso_mw DESC, row_ix LIMIT 1"""
    ),
)
def peak_error_row(spark, sf):
    return errors.peak_error(naive_test(spark, sf), "caiso_mw", "forecast_24")


@register(
    "b29_report_slice",
    sql.readings(
        """SELECT * FROM r_tou WHERE load_year IN (1998, 1999) AND load_month IN (6, 7, 8)
AND source_stage = 'historical' AND tou_period IN ('On-Peak', 'Off-Peak')"""
    ),
)
def report_slice(spark, sf):
    monthly = medallion.gold_monthly_tou(inputs.readings(spark, sf))
    return summary.tou_slice(monthly, [1998, 1999], [6, 7, 8], [HISTORICAL], ["On-Peak", "Off-Peak"])
