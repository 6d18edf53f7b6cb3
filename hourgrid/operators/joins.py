"""Joins of load with weather, and rows picked by their maximum."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.fixed import DAY_NAMES, TEMPERATURE_COLUMNS, TIME_ORDER
from hourgrid.functions import calendar


def join_weather_on_full_days(
    load: DataFrame, weather: DataFrame, temperatures: Sequence[str] = TEMPERATURE_COLUMNS
) -> DataFrame:
    """Left join on stage and label for days of 24 rows; other days get a status and no weather.

    The day guard is part of the join condition: rows that fail it stay, without weather.
    """
    right = weather.select(
        F.col("source_stage").alias("_stage"),
        F.col("weather_timestamp_label").alias("_label"),
        *temperatures,
    )
    same_hour = (F.col("source_stage") == F.col("_stage")) & (F.col("local_timestamp_label") == F.col("_label"))
    full_day = F.col("hours_in_load_date") == calendar.FULL_DAY
    joined = load.join(right, same_hour & full_day, "left")
    status = calendar.weather_status(F.col("hours_in_load_date"), F.col("_label"))
    return joined.select(*load.columns, *temperatures, status.alias("weather_match_status"))


def join_weather_on_label(load: DataFrame, weather: DataFrame, label: str = "timestamp") -> DataFrame:
    """Left join on the label alone: a repeated autumn hour gets the same temperature twice."""
    return load.join(weather, label, "left")


def cities_side_by_side(readings: DataFrame, cities: Sequence[str]) -> DataFrame:
    """One row per timestamp of any city, one column per city; one exchange for all cities.

    Written as conditional maxima because ``pivot`` would shuffle twice.

    Equal to outer-joining the cities one by one as long as a city has one reading per timestamp.
    """
    columns = [F.max(F.when(F.col("city") == c, F.col("temperature"))).alias(f"temp_{c}") for c in cities]
    return readings.groupBy("timestamp").agg(*columns)


def cities_outer_joined(readings: DataFrame, cities: Sequence[str]) -> DataFrame:
    """The cities outer-joined one by one: no reading is lost, and repeated ones of a city and timestamp
    give a row each, which ``order.duplicate_rows`` lists. Takes a join for each city; see
    ``cities_side_by_side`` for readings known to be unique.
    """
    columns = [
        readings.where(F.col("city") == c).select("timestamp", F.col("temperature").alias(f"temp_{c}")) for c in cities
    ]
    return reduce(lambda left, right: left.join(right, "timestamp", "full_outer"), columns)


def assign_by_key(df: DataFrame, values: DataFrame, key: str = "row_ix") -> DataFrame:
    """Write columns back to the rows with the same unique key; other rows get NULL."""
    return df.join(values, key, "left").select(*df.columns, *[c for c in values.columns if c != key])


def peak_first(load: str, order: Sequence[str] = TIME_ORDER) -> list[Column]:
    """Largest load first; among equals the earliest row."""
    return [F.col(load).desc_nulls_last(), *[F.col(column).asc() for column in order]]


def peak_rows_by(
    df: DataFrame, groups: Sequence[str], load: str, kept: Sequence[str], order: Sequence[str] = TIME_ORDER
) -> DataFrame:
    """The first row with the largest load in each group.

    An aggregate over one struct per row, combined within tasks before the shuffle: (load, minus
    the time order) is largest for the earliest of the largest.
    """
    earliest = [_descending(column, df) for column in order]
    best = F.max_by(F.struct(*kept), F.struct(F.col(load), *earliest))
    return (
        df.where(F.col(load).isNotNull())
        .groupBy(*groups)
        .agg(best.alias("_best"))
        .select(*groups, *[F.col(f"_best.{column}").alias(column) for column in kept])
    )


def _descending(column: str, df: DataFrame) -> Column:
    """A number that falls as ``column`` (a date or an integer) rises."""
    value = F.col(column)
    number = F.unix_date(value) if df.schema[column].dataType.typeName() == "date" else value
    return (-number).alias(f"_{column}")


def peak_row(df: DataFrame, load: str, order: Sequence[str] = TIME_ORDER) -> DataFrame:
    """The one row with the largest load: every task hands over a single row."""
    return df.orderBy(*peak_first(load, order)).limit(1)


def in_day_order(df: DataFrame, day_column: str, days: Sequence[str] = DAY_NAMES) -> DataFrame:
    """One row per day of ``days`` in their order, ``day_order`` from 1; absent days are NULL.

    The list of days is written into the query, so its size is known and it may be broadcast.
    """
    places = F.posexplode(F.array(*[F.lit(day) for day in days])).alias("_place", day_column)
    wanted = df.sparkSession.range(1).select(places)
    placed = F.broadcast(wanted).join(df, day_column, "left")
    return placed.withColumn("day_order", (F.col("_place") + 1).cast("int")).drop("_place").orderBy("day_order")
