"""Hours, days and the classes built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hourgrid.fixed import (
    DAY_NAMES,
    MATCHED,
    MISSING_WEATHER,
    NOT_JOINED,
    OFF_PEAK,
    ON_PEAK,
    SUPER_OFF_PEAK,
    TEMPERATURE_BANDS,
)

FULL_DAY = 24


def hour_label(day: Column, hour_ending: Column) -> Column:
    """Start of the hour that ends at ``hour_ending``, without a zone."""
    return F.timestamp_add("HOUR", hour_ending - 1, day.cast("timestamp_ntz"))


def hour_ending_of(label: Column) -> Column:
    return F.hour(label) + 1


def weekday_number(day: Column) -> Column:
    """1 = Monday .. 7 = Sunday."""
    return F.weekday(day) + 1


def weekday_index(day: Column) -> Column:
    """0 = Monday .. 6 = Sunday."""
    return F.weekday(day)


def weekend_flag(day: Column) -> Column:
    return F.when(F.weekday(day) >= 5, 1).otherwise(0)


def day_name(day: Column) -> Column:
    """English name; a lookup, since a date formatter is slow and follows the locale."""
    return F.get(F.array(*[F.lit(name) for name in DAY_NAMES]), F.weekday(day))


def tou_period(hour_ending: Column, is_weekend: Column) -> Column:
    """Evening is on-peak every day; the super off-peak hours depend on the kind of day."""
    evening = hour_ending.between(17, 21)
    night = hour_ending.between(1, 6)
    midday = hour_ending.between(11, 14)
    weekend_quiet = (is_weekend == 1) & hour_ending.between(1, 14)
    weekday_quiet = (is_weekend == 0) & (night | midday)
    return F.when(evening, ON_PEAK).when(weekend_quiet | weekday_quiet, SUPER_OFF_PEAK).otherwise(OFF_PEAK)


def temperature_band(temperature: Column, bands: list[tuple[int | None, str]] = TEMPERATURE_BANDS) -> Column:
    """First band whose upper bound lies above the temperature; NULL falls into the open band."""
    *bounded, (_, rest) = bands
    (bound, label), *more = bounded
    chain = F.when(temperature < bound, label)
    for bound, label in more:
        chain = chain.when(temperature < bound, label)
    return chain.otherwise(rest)


def weather_status(hours_in_day: Column, weather_label: Column) -> Column:
    return (
        F.when(hours_in_day != FULL_DAY, NOT_JOINED)
        .when(weather_label.isNull(), MISSING_WEATHER)
        .otherwise(MATCHED)
    )
