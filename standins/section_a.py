"""Scans, sources and sinks: written to the scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.fixed import CITIES, LOADS
from hourgrid.functions import parsing
from hourgrid.operators import clean
from hourgrid.plans import medallion
from hourgrid.sources import payload, tables, text
from hourgrid.sources.scratch import scratch_path
from standins import inputs, sql
from standins.registry import register

TEXT = '"Date", "HR", "PGE", "SCE", "SDGE", "VEA", "CAISO", source_file'
TEXT_TEMPS = ", ".join(f"CAST(temp_{c}_f AS VARCHAR) AS temp_{c}" for c in CITIES)


def _layers(spark):
    """Namespaces below the scratch folder, once per session."""
    tables.create_layers(spark, scratch_path(spark, "warehouse"))


@register("a01_csv_text_scan", sql.hourly(f"SELECT {TEXT} FROM h_raw"))
def csv_text_scan(spark, sf):
    """Blank and footer dates, and values that will not parse, come through as they were written."""
    historical, validation = inputs.hourly_raw(spark, sf)
    path = scratch_path(spark, "staged")
    text.write_csv(historical.union(validation), path)
    return text.read_staged_loads(spark, path)


@register("a01_csv_text_scan_readings", sql.readings(f"SELECT {TEXT} FROM r_raw"))
def csv_text_scan_readings(spark, sf):
    path = scratch_path(spark, "staged")
    text.write_csv(inputs.as_text(inputs.readings(spark, sf)), path)
    return text.read_staged_loads(spark, path)


@register(
    "a02_weather_text_scan",
    sql.readings(f'SELECT CAST("timestamp" AS VARCHAR) AS "timestamp", {TEXT_TEMPS} FROM r_weather'),
)
def weather_text_scan(spark, sf):
    path = scratch_path(spark, "weather")
    text.write_csv(inputs.readings_weather_raw(spark, sf), path)
    return text.read_raw_weather(spark, path)


@register("a03_create_table_as", sql.readings("SELECT * FROM r_tou"))
def create_table_as(spark, sf):
    """Rebuilt twice: the second run replaces the first."""
    _layers(spark)
    for _ in range(2):
        monthly = medallion.gold_monthly_tou(inputs.readings_silver(spark, sf))
        path = scratch_path(spark, "tou")
        rebuilt = tables.rebuild_table(monthly, "gold.system_load_monthly_tou_summary", ["source_stage"], path)
    return rebuilt


@register(
    "a04_create_namespaces",
    sql.readings(
        """SELECT 'bronze' AS namespace, COUNT(*) AS row_count FROM r_raw
UNION ALL SELECT 'silver', COUNT(*) FROM r_silver
UNION ALL SELECT 'gold', COUNT(*) FROM r_tou"""
    ),
)
def create_namespaces(spark, sf):
    """The three layers exist, each with a table built from the readings."""
    _layers(spark)
    silver = inputs.readings_silver(spark, sf)
    layers = {
        "bronze": inputs.as_text(inputs.readings(spark, sf)),
        "silver": silver,
        "gold": medallion.gold_monthly_tou(silver),
    }
    counts = []
    for layer, rows in layers.items():
        built = tables.rebuild_table(rows, f"{layer}.layer_check", path=scratch_path(spark, layer))
        counts.append(built.agg(F.lit(layer).alias("namespace"), F.count("*").alias("row_count")))
    known = spark.sql("SHOW DATABASES").select("namespace")
    return text.stack_by_name(counts).join(known, "namespace", "left_semi")


@register(
    "a05_multi_file_ingest",
    sql.readings(
        """SELECT "Date", "HR", "PGE", "SCE", "SDGE", "VEA", "CAISO", TRUE AS from_csv_file FROM r_raw"""
    ),
)
def multi_file_ingest(spark, sf):
    """A folder of exports, each row tagged with the file it came from."""
    folder = scratch_path(spark, "exports")
    rows = inputs.as_text(inputs.readings(spark, sf))
    text.write_csv(rows.drop("source_file"), folder)
    tagged = text.read_exports(spark, folder)
    return tagged.withColumn("from_csv_file", F.col("source_file").endswith(".csv")).drop("source_file")


@register(
    "a06_union_by_name_ingest",
    sql.readings(
        """SELECT "Date", "HR", "PGE", NULL AS "VEA", "CAISO" FROM r_raw WHERE source_stage = 'historical'
UNION ALL SELECT "Date", "HR", NULL, "VEA", "CAISO" FROM r_raw WHERE source_stage = 'validation'"""
    ),
)
def union_by_name_ingest(spark, sf):
    historical, validation = inputs.readings_raw(spark, sf)
    return text.stack_by_name(
        [historical.select("Date", "HR", "PGE", "CAISO"), validation.select("CAISO", "VEA", "HR", "Date")]
    )


@register("a07_csv_staging_sink", sql.readings("SELECT * FROM r_silver"))
def csv_staging_sink(spark, sf):
    silver = inputs.readings_silver(spark, sf)
    path = scratch_path(spark, "silver")
    text.write_csv(silver, path)
    return text.read_csv_text(spark, path, silver.schema)


@register(
    "a08_clean_csv_scan",
    sql.readings(
        f"""SELECT load_date AS "date", hour_ending AS hr,
  {", ".join(f"CAST({n}_mw AS DOUBLE) AS {n}" for n in LOADS)},
  source_file, local_timestamp_label AS "timestamp" FROM r_silver"""
    ),
)
def clean_csv_scan(spark, sf):
    labelled = clean.add_hour_label(inputs.readings(spark, sf)).select(
        F.col("load_date").alias("date"),
        F.col("hour_ending").alias("hr"),
        *[F.col(f"{name}_mw").alias(name) for name in LOADS],
        "source_file",
        F.col("local_timestamp_label").alias("timestamp"),
    )
    path = scratch_path(spark, "clean")
    text.write_csv(labelled, path)
    return text.read_clean_loads(spark, path)


@register(
    "a09_mixed_timestamp_parse",
    """SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_linenumber % 4 = 0 THEN CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP)
       ELSE CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) + to_hours(CAST(l_orderkey % 24 AS INT)) END AS parsed
FROM lineitem""",
)
def mixed_timestamp_parse(spark, sf):
    """Four spellings by turns: date only, blank, ``T`` and month/day/year."""
    day = F.to_date("l_shipdate").cast("timestamp_ntz")
    moment = F.timestamp_add("HOUR", (F.col("l_orderkey") % 24).cast("int"), day)
    turn = F.col("l_linenumber") % 4
    spelled = (
        F.when(turn == 0, F.to_date("l_shipdate").cast("string"))
        .when(turn == 1, moment.cast("string"))
        .when(turn == 2, F.translate(moment.cast("string"), " ", "T"))
        .otherwise(
            F.format_string("%d/%d/%d %d:%02d", F.month(moment), F.day(moment), F.year(moment), F.hour(moment), F.minute(moment))
        )
    )
    items = inputs.table(spark, sf, "lineitem").withColumn("spelled", spelled)
    american = (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm")
    parsed = parsing.to_label_of_any(F.col("spelled"), [american])
    return items.select("l_orderkey", "l_linenumber", "l_partkey", parsed.alias("parsed"))


@register(
    "a10_hourly_json_source",
    sql.readings(
        "\nUNION ALL\n".join(
            f"""SELECT '{c}' AS city, "timestamp", CAST(temp_{c}_f AS DOUBLE) AS temperature FROM r_weather"""
            for c in CITIES
        )
    ),
)
def hourly_json_source(spark, sf):
    """One folder per city with payloads of a day's parallel arrays, back to one row per hour."""
    hours = inputs.city_readings(spark, sf)
    moment = F.translate(F.substring(F.col("timestamp").cast("string"), 1, 16), " ", "T")
    day = F.array_sort(F.collect_list(F.struct(moment.alias("time"), F.col("temperature").alias("temperature_2m"))))
    days = hours.groupBy("city", F.to_date("timestamp").alias("d")).agg(day.alias("day"))
    arrays = F.struct(F.col("day.time").alias("time"), F.col("day.temperature_2m").alias("temperature_2m"))
    path = scratch_path(spark, "payload")
    days.select("city", arrays.alias("hourly")).write.partitionBy("city").json(path)
    return payload.read_hourly_payloads(spark, path, r"city=([a-z_]+)/")


@register("a11_table_scan", sql.readings("SELECT * FROM r_silver"))
def table_scan(spark, sf):
    _layers(spark)
    silver = inputs.readings_silver(spark, sf)
    tables.rebuild_table(silver, "silver.caiso_load_hourly", path=scratch_path(spark, "silver"))
    return spark.table("silver.caiso_load_hourly")
