"""Counts, profiles, daily and monthly summaries.

Grouped aggregates are combined inside tasks first, so a group of any size reaches the shuffle as
one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourgrid.fixed import GROUP_ROWS, LOADS
from hourgrid.functions import calendar
from hourgrid.functions.scores import mean_of
from hourgrid.operators.joins import in_day_order, peak_rows_by
from hourgrid.operators.quantiles import exact_quantiles


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("row_count"))


def coverage(features: DataFrame) -> DataFrame:
    """Rows, first and last day, and rows on days without 24 rows, per stage."""
    odd_day = F.when(F.col("hours_in_load_date") != calendar.FULL_DAY, 1).otherwise(0)
    return features.groupBy("source_stage").agg(
        F.count("*").alias("hourly_rows"),
        F.min("load_date").alias("first_load_date"),
        F.max("load_date").alias("last_load_date"),
        F.sum(odd_day).alias("rows_on_dst_transition_dates"),
    )


def mean_by(df: DataFrame, keys: Sequence[str], load: str = "caiso_mw", name: str = "average_caiso_load_mw") -> DataFrame:
    return df.groupBy(*keys).agg(mean_of(F.col(load)).alias(name))


def hourly_profile(df: DataFrame, load: str = "caiso_mw") -> DataFrame:
    return df.groupBy("hour_ending").agg(
        mean_of(F.col(load)).alias("average_caiso_load_mw"),
        F.min(load).alias("minimum_caiso_load_mw"),
        F.max(load).alias("maximum_caiso_load_mw"),
    )


def daily_summary(features: DataFrame, load: str = "caiso_mw") -> DataFrame:
    return features.groupBy("source_stage", "load_date").agg(
        F.count("*").alias("hours_in_day"),
        mean_of(F.col(load)).alias("average_load_mw"),
        F.max(load).alias("peak_load_mw"),
        F.min(load).alias("minimum_load_mw"),
    )


def add_rolling_mean(
    daily: DataFrame,
    value: str,
    name: str,
    days: int = 30,
    partition: Sequence[str] = (),
    full_only: bool = False,
) -> DataFrame:
    """Mean of the last ``days`` daily rows; ``full_only`` leaves the first days NULL.

    The window runs over one row per day, never over hourly rows.
    """
    last = W.partitionBy(*partition).orderBy("load_date").rowsBetween(1 - days, 0)
    mean = F.avg(value).over(last)
    if full_only:
        mean = F.when(F.count(value).over(last) == days, mean)
    return daily.withColumn(name, mean)


def band_profile(load_weather: DataFrame, temperature: str = "temp_sacramento_f") -> DataFrame:
    band = calendar.temperature_band(F.col(temperature)).alias("sacramento_temperature_band")
    return load_weather.groupBy(band).agg(
        F.count("*").alias("hourly_rows"),
        mean_of(F.col("caiso_mw")).alias("average_caiso_load_mw"),
    )


def monthly_tou(features: DataFrame) -> DataFrame:
    """Hours and energy per stage, month and time-of-use period (one MW for one hour is one MWh)."""
    period = calendar.tou_period(F.col("hour_ending"), F.col("is_weekend"))
    return features.groupBy(
        "source_stage",
        F.year("load_date").alias("load_year"),
        F.month("load_date").alias("load_month"),
        period.alias("tou_period"),
    ).agg(
        F.count("*").alias("hourly_observations"),
        F.sum(F.col("caiso_mw").cast("decimal(18,3)")).alias("system_load_mwh_proxy"),
    )


def tou_totals(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy("source_stage", "tou_period").agg(
        F.sum("hourly_observations").alias("hourly_observations"),
        F.sum("system_load_mwh_proxy").alias("system_load_mwh_proxy"),
    )


def tou_slice(
    monthly: DataFrame,
    years: Sequence[int] | None = None,
    months: Sequence[int] | None = None,
    stages: Sequence[str] | None = None,
    periods: Sequence[str] | None = None,
) -> DataFrame:
    """The report's slicers; an argument left out does not filter."""
    wanted = {"load_year": years, "load_month": months, "source_stage": stages, "tou_period": periods}
    for column, values in wanted.items():
        if values is not None:
            monthly = monthly.where(F.col(column).isin(list(values)))
    return monthly


def mean_by_weekday(df: DataFrame, load: str = "caiso_mw") -> DataFrame:
    """Mean per day name, Monday first, absent days NULL."""
    return in_day_order(mean_by(df, ["day_name"], load), "day_name")


def monthly_maximum(df: DataFrame, load: str = "caiso_mw") -> DataFrame:
    return df.groupBy("load_year", "load_month").agg(F.max(load).alias("peak_load_mw"))


def monthly_peak_hours(features: DataFrame) -> DataFrame:
    """Day and hour of each month's largest load, the earliest of equals."""
    kept = ["load_date", "hour_ending", "caiso_mw", "caiso_minus_regional_mw"]
    peaks = peak_rows_by(features, ["load_year", "load_month"], "caiso_mw", kept)
    return peaks.withColumnRenamed("caiso_mw", "monthly_peak_load_mw").orderBy("load_year", "load_month")


def null_profile(df: DataFrame) -> DataFrame:
    """NULL count of every column and the row count, one pass, as (column_name, null_count, row_count)."""
    counts = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(name).isNull()).alias(name) for name in df.columns]
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n).alias("null_count")) for n in df.columns])
    return counts.select(F.inline(pairs), F.col("_rows").alias("row_count"))


def describe(df: DataFrame, columns: Sequence[str] = LOADS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum, one row per column."""
    spark = df.sparkSession
    found = exact_quantiles(df, columns, [0.25, 0.5, 0.75], group_rows)
    quartiles = [(name, *found[name]) for name in columns]
    schema = "column_name string, q25 double, q50 double, q75 double"
    parts = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.count(name).alias("row_count"),
            mean_of(F.col(name)).alias("mean"),
            F.stddev_samp(F.col(name).cast("double")).alias("std"),
            F.min(name).cast("double").alias("min"),
            F.max(name).cast("double").alias("max"),
        )
        for name in columns
    ]
    moments = df.agg(F.array(*parts).alias("_parts")).select(F.inline("_parts"))
    # One row per described column on both sides.
    return moments.join(F.broadcast(spark.createDataFrame(quartiles, schema)), "column_name")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return count_by(df, column).orderBy(column)


def nonpositive_counts(df: DataFrame, columns: Sequence[str] = LOADS) -> DataFrame:
    return df.agg(*[F.count_if(F.col(name) <= 0).alias(name) for name in columns])


def date_span(df: DataFrame, day: str = "load_date") -> DataFrame:
    return df.agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"))


def duplicate_count(df: DataFrame, column: str) -> DataFrame:
    """Rows beyond the first of each value; a NULL counts as a value, as it does for the rows."""
    values = df.groupBy(column).agg(F.count("*").alias("_rows"))
    return values.agg(F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).alias("duplicate_count"))


def preview(df: DataFrame, order: Sequence[str], rows: int = 10, last: bool = False) -> DataFrame:
    """First (or last) rows of an order: each task keeps at most ``rows`` of them."""
    keys = [F.col(name).desc() if last else F.col(name).asc() for name in order]
    return df.orderBy(*keys).limit(rows)


def sort_time(df: DataFrame, order: Sequence[str] = ("load_date", "hour_ending", "hour_instance")) -> DataFrame:
    return df.orderBy(*order)
