"""The guarded weather join and what follows from it, on hours that grow in number with the tables: one per order key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid import schemas
from hourgrid.fixed import CITIES, HISTORICAL, MATCHED, TEMPERATURE_COLUMNS, VALIDATION
from hourgrid.operators import clean, features, order, summary
from hourgrid.plans import medallion
from standins import sql
from standins.inputs import table
from standins.registry import ORACLES, register
from standins.section_b import ID

FIRST_DAY = "1900-01-01"
# Days are used again after so many; of so many keys one loses its hour and one has it twice.
DAYS = 2_000_000
CLOCK = 2_400

PARTS = {"pge": "l_quantity", "sce": "l_partkey % 1000", "sdge": "l_suppkey % 100", "vea": "l_linenumber"}


def _day(key: str) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), (F.floor(F.col(key) / 24) % DAYS).cast("int"))


def _stage(key: str) -> Column:
    return F.when(F.floor(F.col(key) / 24) % 10 < 8, HISTORICAL).otherwise(VALIDATION)


def silver(spark: SparkSession, sf: str) -> DataFrame:
    loads = [F.sum(F.expr(c).cast(schemas.LOAD_TYPE)).cast(schemas.LOAD_TYPE).alias(f"{n}_mw") for n, c in PARTS.items()]
    orders = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(*loads)
    clock = F.col("l_orderkey") % CLOCK
    none = F.array().cast("array<int>")
    copies = F.when(clock == 5, none).when(clock == 1207, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    again = orders.withColumn("again", F.explode(copies))
    total = sum((F.col(f"{n}_mw") for n in PARTS), F.col("again"))
    rows = again.select(
        _stage("l_orderkey").alias("source_stage"),
        _day("l_orderkey").alias("load_date"),
        (F.col("l_orderkey") % 24 + 1).cast("int").alias("hour_ending"),
        *[f"{n}_mw" for n in PARTS],
        total.cast(schemas.LOAD_TYPE).alias("caiso_mw"),
        F.lit("lineitem.parquet").alias("source_file"),
    )
    numbered = order.number_repeated_hours(rows)
    return clean.add_regional_total(clean.add_hour_label(numbered)).select(*medallion.SILVER_LOADS)


def weather(spark: SparkSession, sf: str) -> DataFrame:
    """An hour for every order key but each seventh."""
    hour = F.col("o_orderkey") % 24
    label = F.timestamp_add("HOUR", hour, _day("o_orderkey").cast("timestamp_ntz"))
    cities = [(F.lit(40) + (F.col("o_custkey") * i) % 60).cast(schemas.TEMPERATURE_TYPE).alias(f"temp_{c}_f") for i, c in enumerate(CITIES, 1)]
    hours = table(spark, sf, "orders").where("o_orderkey % 7 <> 3")
    return hours.select(
        _stage("o_orderkey").alias("source_stage"),
        label.alias("weather_timestamp_label"),
        _day("o_orderkey").alias("weather_date"),
        (hour + 1).cast("int").alias("hour_ending"),
        *cities,
    )


def load_weather(spark: SparkSession, sf: str) -> DataFrame:
    return medallion.gold_load_weather(medallion.gold_features(silver(spark, sf)), weather(spark, sf))


def _sql_day(key: str) -> str:
    return f"DATE '{FIRST_DAY}' + CAST({key} // 24 % {DAYS} AS INT)"


def _sql_stage(key: str) -> str:
    return f"CASE WHEN {key} // 24 % 10 < 8 THEN 'historical' ELSE 'validation' END"


_SUMS = ", ".join(f"CAST(SUM(CAST({c} AS DECIMAL(12,3))) AS DECIMAL(12,3)) AS {n}_mw" for n, c in PARTS.items())
_TOTAL = " + ".join(f"{n}_mw" for n in PARTS)
LONG = f"""
g_orders AS (SELECT l_orderkey AS k, {_SUMS} FROM lineitem GROUP BY 1),
g_again AS (
  SELECT *, 0 AS again FROM g_orders WHERE k % {CLOCK} <> 5
  UNION ALL SELECT *, 1 FROM g_orders WHERE k % {CLOCK} = 1207),
g_rows AS (
  SELECT {_sql_stage("k")} AS source_stage, {_sql_day("k")} AS load_date, CAST(k % 24 AS INT) + 1 AS hour_ending,
    {", ".join(f"{n}_mw" for n in PARTS)}, CAST({_TOTAL} + again AS DECIMAL(12,3)) AS caiso_mw, 'lineitem.parquet' AS source_file
  FROM g_again),{sql._SILVER.format(p="g")},
g_weather AS (
  SELECT {_sql_stage("o_orderkey")} AS source_stage,
    CAST({_sql_day("o_orderkey")} AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INT)) AS weather_timestamp_label,
    {", ".join(f"CAST(40 + (o_custkey * {i}) % 60 AS DECIMAL(5,1)) AS temp_{c}_f" for i, c in enumerate(CITIES, 1))}
  FROM orders WHERE o_orderkey % 7 <> 3),
g_load_weather AS (
  SELECT l.*, {", ".join(f"w.{c}" for c in TEMPERATURE_COLUMNS)},
    CASE WHEN l.hours_in_load_date <> 24 THEN 'not joined: DST transition'
         WHEN w.weather_timestamp_label IS NULL THEN 'missing weather'
         ELSE 'matched' END AS weather_match_status
  FROM g_gold l LEFT JOIN g_weather w
    ON l.source_stage = w.source_stage AND l.local_timestamp_label = w.weather_timestamp_label
   AND l.hours_in_load_date = 24)"""


def _twin(name: str) -> str:
    """The body of the short query's twin over the long rows."""
    body = ORACLES[name].removeprefix(sql.hourly(""))
    return f"WITH {LONG}\n{body.replace('h_load_weather', 'g_load_weather')}"


@register("c01_weather_left_join_guarded_long", _twin("c01_weather_left_join_guarded"))
def weather_left_join_guarded(spark, sf):
    return load_weather(spark, sf)


@register("b16_weather_match_status_long", _twin("b16_weather_match_status"))
def weather_match_status(spark, sf):
    return load_weather(spark, sf).select(*ID, "weather_match_status")


@register("d08_band_profile_long", _twin("d08_band_profile"))
def band_profile(spark, sf):
    return summary.band_profile(features.at_stage(load_weather(spark, sf), HISTORICAL, MATCHED))


@register("d09_match_status_counts_long", _twin("d09_match_status_counts"))
def match_status_counts(spark, sf):
    return summary.count_by(load_weather(spark, sf), "weather_match_status")
