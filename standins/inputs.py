"""Load and weather tables made from the supplied ones by Spark.

* ``hourly``: one load row per hour of ``events``, with a 23-row and a 25-row day, as staged text.
* ``readings``: one load row per ``lineitem`` row, seven years, many rows per hour label.
* weather of ``hourly`` from the error events, weather of ``readings`` from ``orders``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid import schemas
from hourgrid.fixed import CITIES, LOADS
from hourgrid.operators import clean, order
from hourgrid.plans import medallion

LAST_TRAIN_YEAR = 1999
TEST_YEAR = 2000
FINAL_YEAR = 2001

# Rows that cleaning has to drop.
DIRTY_ROWS = [
    ("CAISO Public", None, None, None, None, None, None, "events.parquet"),
    (" CAISO Public ", None, None, None, None, None, None, "events.parquet"),
    ("  ", None, None, None, None, None, None, "events.parquet"),
    (None, None, None, None, None, None, None, "events.parquet"),
    ("2024-01-05", "x", "1", "1", "1", "1", "4", "events.parquet"),
    ("2024-01-05", "0", "1", "1", "1", "1", "4", "events.parquet"),
    ("2024-01-05", "25", "1", "1", "1", "1", "4", "events.parquet"),
    ("2024-01-05", "3", "n/a", "1", "1", "1", "4", "events.parquet"),
    ("no date", "3", "1", "1", "1", "1", "4", "events.parquet"),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _load(value: Column) -> Column:
    return value.cast(schemas.LOAD_TYPE)


def _hourly(spark: SparkSession, sf: str) -> DataFrame:
    value = _load(F.col("value"))
    kinds = {"pge": "click", "sce": "view", "sdge": "purchase", "vea": "signup"}
    parts = [
        F.coalesce(F.sum(F.when(F.col("event_type") == kind, value)), F.lit(0)).alias(name)
        for name, kind in kinds.items()
    ]
    hours = (
        table(spark, sf, "events")
        .groupBy(F.to_date("ts").alias("d"), (F.hour("ts") + 1).alias("he"))
        .agg(*parts, F.sum(value).alias("caiso"))
    )
    lost = (F.col("d") == F.lit("2024-01-10").cast("date")) & (F.col("he") == 2)
    doubled = (F.col("d") == F.lit("2024-01-17").cast("date")) & (F.col("he") == 1)
    copies = F.when(lost, F.array().cast("array<int>")).when(doubled, F.array(F.lit(0), F.lit(1)))
    spread = hours.withColumn("again", F.explode(copies.otherwise(F.array(F.lit(0)))))
    return spread.withColumns({"pge": F.col("pge") + F.col("again"), "caiso": F.col("caiso") + F.col("again")})


def hourly_raw(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Staged text of both stages; the dirty rows are in the first."""
    hours = _hourly(spark, sf)
    cut = F.lit("2024-01-24").cast("date")
    text = [
        F.col("d").cast("string").alias("Date"),
        F.col("he").cast("string").alias("HR"),
        *[_load(F.col(name)).cast("string").alias(name.upper()) for name in LOADS],
        F.lit("events.parquet").alias("source_file"),
    ]
    dirty = spark.createDataFrame(DIRTY_ROWS, schemas.STAGED_LOADS)
    return hours.where(F.col("d") < cut).select(*text).union(dirty), hours.where(F.col("d") >= cut).select(*text)


def hourly_weather_raw(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    value = _load(F.col("value"))
    hours = (
        table(spark, sf, "events")
        .where(F.col("event_type") == "error")
        .groupBy(F.to_date("ts").alias("d"), F.hour("ts").alias("h"))
        .agg(F.sum(value).alias("s"))
    )
    label = F.timestamp_add("HOUR", F.col("h"), F.col("d").cast("timestamp_ntz")).cast("string")
    cities = [
        (F.lit(40) + (F.col("s") * i) % 60).cast(schemas.TEMPERATURE_TYPE).cast("string").alias(f"temp_{city}")
        for i, city in enumerate(CITIES, 1)
    ]
    cut = F.lit("2024-01-24").cast("date")
    early, late = hours.where(F.col("d") < cut), hours.where(F.col("d") >= cut)
    return early.select(label.alias("timestamp"), *cities), late.select(label.alias("timestamp"), *cities)


def hourly_silver(spark: SparkSession, sf: str) -> DataFrame:
    return medallion.silver_loads(*hourly_raw(spark, sf))


def hourly_gold(spark: SparkSession, sf: str) -> DataFrame:
    return medallion.gold_features(hourly_silver(spark, sf))


def hourly_load_weather(spark: SparkSession, sf: str) -> DataFrame:
    weather = medallion.silver_weather(*hourly_weather_raw(spark, sf))
    return medallion.gold_load_weather(hourly_gold(spark, sf), weather)


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """One typed load row per line item."""
    parts = {
        "pge_mw": F.col("l_quantity"),
        "sce_mw": F.col("l_partkey") % 1000,
        "sdge_mw": F.col("l_suppkey") % 100,
        "vea_mw": F.col("l_linenumber"),
    }
    items = table(spark, sf, "lineitem")
    day = F.to_date("l_shipdate")
    stage = F.when(day < F.make_date(F.lit(FINAL_YEAR), F.lit(1), F.lit(1)), "historical").otherwise("validation")
    rows = items.select(
        stage.alias("source_stage"),
        day.alias("load_date"),
        ((F.col("l_orderkey") % 24).cast("int") + 1).alias("hour_ending"),
        *[_load(c).alias(name) for name, c in parts.items()],
        _load(F.col("l_discount")).alias("_rest"),
        F.concat(F.lit("export_"), "l_returnflag", F.lit(".csv")).alias("source_file"),
    )
    total = _load(sum((F.col(name) for name in parts), F.col("_rest")))
    return rows.select(
        "source_stage", "load_date", "hour_ending", *parts, total.alias("caiso_mw"), "source_file"
    )


def as_text(rows: DataFrame) -> DataFrame:
    """Typed load rows as staged text."""
    return rows.select(
        F.col("load_date").cast("string").alias("Date"),
        F.col("hour_ending").cast("string").alias("HR"),
        *[F.col(f"{name}_mw").cast("string").alias(name.upper()) for name in LOADS],
        "source_file",
    )


def readings_raw(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = readings(spark, sf)
    return tuple(as_text(rows.where(F.col("source_stage") == s)) for s in ("historical", "validation"))


def readings_silver(spark: SparkSession, sf: str) -> DataFrame:
    """Typed, numbered and labelled readings."""
    numbered = order.number_repeated_hours(readings(spark, sf))
    return clean.add_regional_total(clean.add_hour_label(numbered)).select(*medallion.SILVER_LOADS)


def readings_placed(spark: SparkSession, sf: str) -> DataFrame:
    return order.add_position(readings_silver(spark, sf))


def day_sums(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "orders")
        .groupBy(F.to_date("o_orderdate").alias("d"))
        .agg(F.sum("o_custkey").alias("s"))
    )


def _temperature(i: int) -> Column:
    tenths = F.lit(400) + (F.col("s") * i + F.col("h") * (2 * i + 1)) % 600
    return (tenths * F.lit("0.1").cast("decimal(2,1)")).cast(schemas.TEMPERATURE_TYPE)


def readings_weather(spark: SparkSession, sf: str) -> DataFrame:
    """24 labels for every day with orders: ``timestamp`` and seven typed temperatures."""
    hours = day_sums(spark, sf).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23))))
    label = F.timestamp_add("HOUR", F.col("h"), F.col("d").cast("timestamp_ntz"))
    cities = [_temperature(i).alias(f"temp_{city}_f") for i, city in enumerate(CITIES, 1)]
    return hours.select(label.alias("timestamp"), *cities)


def readings_weather_raw(spark: SparkSession, sf: str) -> DataFrame:
    typed = readings_weather(spark, sf)
    return typed.select(
        F.col("timestamp").cast("string").alias("timestamp"),
        *[F.col(f"temp_{city}_f").cast("string").alias(f"temp_{city}") for city in CITIES],
    )


def city_readings(spark: SparkSession, sf: str, cities: list[str] = CITIES) -> DataFrame:
    """The same weather in long form: city, timestamp, temperature."""
    wide = readings_weather(spark, sf)
    pairs = [F.struct(F.lit(c).alias("city"), F.col(f"temp_{c}_f").cast("double").alias("temperature")) for c in cities]
    return wide.select("timestamp", F.inline(F.array(*pairs)))
