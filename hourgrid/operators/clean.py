"""Projections and filters that turn text exports into typed rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.fixed import CITIES, FOOTER, LOAD_COLUMNS, LOADS, TEMPERATURE_COLUMNS, TERRITORIES
from hourgrid.functions import calendar, parsing


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip().lower() for name in df.columns])


def tag_stage(df: DataFrame, stage: str) -> DataFrame:
    return df.select(F.lit(stage).alias("source_stage"), "*")


def stack_stages(stages: dict[str, DataFrame]) -> DataFrame:
    """All rows of all stages, none merged; the literal lets a stage filter drop whole inputs."""
    tagged = [tag_stage(df, stage) for stage, df in stages.items()]
    return reduce(DataFrame.unionByName, tagged)


def drop_footer_rows(df: DataFrame, date_column: str = "Date", footer: str = FOOTER) -> DataFrame:
    return df.where(parsing.is_data_row(F.col(date_column), footer))


def type_loads(df: DataFrame) -> DataFrame:
    loads = [parsing.to_load(F.col(name)).alias(f"{name}_mw") for name in LOADS]
    return df.select(
        "source_stage",
        F.col("Date").try_cast("date").alias("load_date"),
        F.col("HR").try_cast("int").alias("hour_ending"),
        *loads,
        "source_file",
    )


def type_weather(df: DataFrame) -> DataFrame:
    temperatures = [parsing.to_temperature(F.col(f"temp_{city}")).alias(f"temp_{city}_f") for city in CITIES]
    return df.select(
        "source_stage",
        parsing.to_label(F.col("timestamp")).alias("weather_timestamp_label"),
        *temperatures,
    )


def complete_loads(df: DataFrame) -> DataFrame:
    in_day = F.col("hour_ending").between(1, calendar.FULL_DAY)
    return df.where(in_day).dropna(subset=["load_date", *LOAD_COLUMNS])


def complete_weather(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["weather_timestamp_label", *TEMPERATURE_COLUMNS])


def add_regional_total(df: DataFrame) -> DataFrame:
    total = reduce(add, [F.col(f"{name}_mw") for name in TERRITORIES])
    return df.withColumns({"regional_total_mw": total, "caiso_minus_regional_mw": F.col("caiso_mw") - total})


def add_hour_label(df: DataFrame) -> DataFrame:
    label = calendar.hour_label(F.col("load_date"), F.col("hour_ending"))
    return df.withColumn("local_timestamp_label", label)


def add_weather_hour(df: DataFrame) -> DataFrame:
    label = F.col("weather_timestamp_label")
    return df.withColumns({"weather_date": F.to_date(label), "hour_ending": calendar.hour_ending_of(label)})


def any_missing(columns: Sequence[str]) -> Column:
    return reduce(or_, [F.col(name).isNull() for name in columns])


def rows_with_any_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(any_missing(columns))


def rows_without_date(df: DataFrame, date_column: str = "Date") -> DataFrame:
    return df.where(F.col(date_column).isNull())


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def reject_counts(raw: DataFrame) -> DataFrame:
    """How many staged rows each cleaning rule drops, by the first rule that fails."""
    flags = raw.select(
        F.coalesce(parsing.is_data_row(F.col("Date")), F.lit(False)).alias("is_data"),
        F.col("Date").try_cast("date").isNotNull().alias("has_date"),
        F.coalesce(F.col("HR").try_cast("int").between(1, calendar.FULL_DAY), F.lit(False)).alias("has_hour"),
        (~reduce(or_, [parsing.to_load(F.col(name)).isNull() for name in LOADS])).alias("has_loads"),
    )
    rule = (
        F.when(~F.col("is_data"), "blank or footer")
        .when(~F.col("has_date"), "date")
        .when(~F.col("has_hour"), "hour")
        .when(~F.col("has_loads"), "load")
        .otherwise("kept")
    )
    return flags.groupBy(rule.alias("rule")).agg(F.count("*").alias("row_count"))
