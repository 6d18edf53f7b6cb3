"""Calendar columns, powers and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.functions import calendar


def add_year_month(df: DataFrame, day: str = "load_date") -> DataFrame:
    return df.withColumns({"load_year": F.year(day), "load_month": F.month(day)})


def add_weekday(df: DataFrame, day: str = "load_date") -> DataFrame:
    date = F.col(day)
    return df.withColumns(
        {"weekday_number": calendar.weekday_number(date), "is_weekend": calendar.weekend_flag(date)}
    )


def add_day_name(df: DataFrame, day: str = "load_date") -> DataFrame:
    date = F.col(day)
    return df.withColumns({"day_name": calendar.day_name(date), "day_of_week": calendar.weekday_index(date)})


def add_squares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{name}_sq": F.col(name) * F.col(name) for name in columns})


def split_by_year(df: DataFrame, last_train_year: int, day: str = "load_date") -> tuple[DataFrame, DataFrame]:
    """Rows up to a year, and rows of the year after; date bounds, so that a reader can skip files."""
    first_test = F.make_date(F.lit(last_train_year + 1), F.lit(1), F.lit(1))
    after_test = F.make_date(F.lit(last_train_year + 2), F.lit(1), F.lit(1))
    date = F.col(day)
    return df.where(date < first_test), df.where((date >= first_test) & (date < after_test))


def between_days(df: DataFrame, first: str, last: str, day: str = "load_date") -> DataFrame:
    """Days from ``first`` to ``last``, both included."""
    return df.where(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def in_years(df: DataFrame, first: int, last: int, day: str = "load_date") -> DataFrame:
    """Days of the years from ``first`` to ``last``; where the table has ``load_year`` its folders are pruned by it."""
    days = between_days(df, f"{first}-01-01", f"{last}-12-31", day)
    return days.where(F.col("load_year").between(first, last)) if "load_year" in df.columns else days


def around_peak(df: DataFrame, load: str, days: int = 3, day: str = "load_date") -> DataFrame:
    """All rows up to ``days`` days away from the day of the largest load (its first occurrence).

    The day becomes a literal, so the reader skips everything outside the week.
    """
    first = F.max_by(day, F.struct(F.col(load), -F.unix_date(F.col(day))))
    peak_day = F.lit(df.where(F.col(load).isNotNull()).agg(first).first()[0]).cast("date")
    return df.where(F.col(day).between(F.date_sub(peak_day, days), F.date_add(peak_day, days)))


def at_stage(df: DataFrame, stage: str, status: str | None = None) -> DataFrame:
    kept = df.where(F.col("source_stage") == stage)
    return kept if status is None else kept.where(F.col("weather_match_status") == status)
