from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hourgrid.fixed import CITIES, DAY_NAMES, TEMPERATURE_COLUMNS
from hourgrid.functions import calendar
from hourgrid.operators import clean, features, joins, order, summary
from hourgrid.sources import tables

HOURS = [6, 7, 10, 11, 14, 15, 16, 17, 21, 22]
WEEKDAY = ["Super Off-Peak", "Off-Peak", "Off-Peak", "Super Off-Peak", "Super Off-Peak", "Off-Peak", "Off-Peak", "On-Peak", "On-Peak", "Off-Peak"]
WEEKEND = ["Super Off-Peak"] * 5 + ["Off-Peak", "Off-Peak", "On-Peak", "On-Peak", "Off-Peak"]


@pytest.mark.parametrize("weekend,expected", [(0, WEEKDAY), (1, WEEKEND)])
def test_time_of_use_borders(spark, weekend, expected):
    rows = spark.createDataFrame([(i, h, weekend) for i, h in enumerate(HOURS)], "i int, h int, w int")
    found = rows.orderBy("i").select(calendar.tou_period(F.col("h"), F.col("w"))).collect()
    assert [r[0] for r in found] == expected


@pytest.mark.parametrize(
    "temperature,band",
    [(54.9, "Below 55 F"), (55.0, "55 to under 70 F"), (69.9, "55 to under 70 F"), (70.0, "70 to under 85 F"), (84.9, "70 to under 85 F"), (85.0, "85 F and above"), (None, "85 F and above")],
)
def test_temperature_borders(spark, temperature, band):
    rows = spark.createDataFrame([(temperature,)], "t double")
    assert rows.select(calendar.temperature_band(F.col("t"))).first()[0] == band


def test_weekday_number_counts_from_a_monday(spark):
    days = spark.range(1826).select(F.date_add(F.lit("2021-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    since = F.datediff("d", F.lit("1900-01-01").cast("date"))
    wrong = days.where(calendar.weekday_number(F.col("d")) != since % 7 + 1)
    assert wrong.count() == 0
    assert [r[0] for r in days.limit(3).select(calendar.day_name(F.col("d"))).collect()] == ["Friday", "Saturday", "Sunday"]


def gold(load_rows, rows):
    placed = order.add_hours_in_day(order.number_repeated_hours(load_rows(rows)))
    return clean.add_hour_label(placed)


def weather(spark, labels):
    rows = [("historical", dt.datetime.fromisoformat(t), *[50.0 + i for i in range(7)]) for t in labels]
    schema = "source_stage string, weather_timestamp_label timestamp_ntz, " + ", ".join(f"{c} double" for c in TEMPERATURE_COLUMNS)
    return spark.createDataFrame(rows, schema)


def test_guarded_join_keeps_odd_days_without_weather(spark, load_rows):
    full = [("2024-01-01", h, h) for h in range(1, 25)]
    spring = [("2024-03-10", h, h) for h in range(1, 25) if h != 2]
    w = weather(spark, ["2024-01-01 00:00:00", "2024-03-10 00:00:00"])
    joined = joins.join_weather_on_full_days(gold(load_rows, full + spring), w)
    counts = {r.weather_match_status: r["count"] for r in joined.groupBy("weather_match_status").count().collect()}
    assert counts == {"matched": 1, "missing weather": 23, "not joined: DST transition": 23}
    assert joined.where("load_date = '2024-03-10' and temp_poway_f is not null").count() == 0


def test_join_on_label_gives_both_autumn_rows_the_same_weather(spark, load_rows):
    rows = gold(load_rows, [("2024-11-03", 1, 10), ("2024-11-03", 1, 20)]).withColumnRenamed("local_timestamp_label", "timestamp")
    w = weather(spark, ["2024-11-03 00:00:00"]).withColumnRenamed("weather_timestamp_label", "timestamp").drop("source_stage")
    assert [r.temp_fresno_f for r in joins.join_weather_on_label(rows, w).collect()] == [52.0, 52.0]


def test_cities_side_by_side_is_an_outer_join(spark):
    hour = dt.datetime(2024, 1, 1)
    rows = [("sacramento", hour, 1.0), ("poway", hour, 2.0), ("poway", hour + dt.timedelta(hours=1), 3.0)]
    wide = joins.cities_side_by_side(spark.createDataFrame(rows, "city string, timestamp timestamp_ntz, temperature double"), CITIES)
    found = [(r.temp_sacramento, r.temp_poway, r.temp_fresno) for r in wide.orderBy("timestamp").collect()]
    assert found == [(1.0, 2.0, None), (None, 3.0, None)]


def test_first_of_equal_peaks_wins(load_rows):
    rows = [("2024-01-09", 5, 7), ("2024-01-02", 9, 7), ("2024-01-02", 3, 7), ("2024-01-01", 1, 6)]
    numbered = features.add_year_month(clean.add_regional_total(order.number_repeated_hours(load_rows(rows))))
    peak = summary.monthly_peak_hours(numbered).first()
    assert (peak.load_date.day, peak.hour_ending) == (2, 3)
    first = joins.peak_row(numbered, "caiso_mw").first()
    assert (first.load_date.day, first.hour_ending) == (2, 3)
    assert features.around_peak(numbered, "caiso_mw", days=3).count() == 3


def test_absent_days_stay_in_order(spark):
    means = spark.createDataFrame([("Sunday", 1.0), ("Monday", 2.0)], "day_name string, m double")
    rows = joins.in_day_order(means, "day_name").collect()
    assert [r.day_name for r in rows] == DAY_NAMES and [r.m for r in rows][:2] == [2.0, None]


def test_values_are_written_back_by_key(spark):
    rows = spark.range(4).withColumnRenamed("id", "row_ix")
    values = spark.createDataFrame([(2, 0.5)], "row_ix long, f double")
    assert [r.f for r in joins.assign_by_key(rows, values).orderBy("row_ix").collect()] == [None, None, 0.5, None]


def test_rebuilding_a_table_replaces_it(spark, tmp_path):
    tables.create_layers(spark, str(tmp_path))
    for n in (5, 3):
        rows = spark.range(n).select((F.col("id") % 2).alias("source_stage"), "id")
        built = tables.rebuild_table(rows, "gold.t", ["source_stage"], path=f"{tmp_path}/t{n}")
    assert built.count() == 3 and built.columns == ["source_stage", "id"]
