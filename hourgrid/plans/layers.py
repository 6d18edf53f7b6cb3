"""The whole batch: staged text to bronze, silver and gold tables, each written once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from hourgrid.fixed import HISTORICAL, VALIDATION
from hourgrid.plans import medallion
from hourgrid.sources import tables, text

# Fixed table names.
BRONZE_LOADS = "bronze.caiso_load_{stage}_raw"
BRONZE_WEATHER = "bronze.regional_weather_{stage}_raw"
SILVER_LOADS = "silver.caiso_load_hourly"
SILVER_WEATHER = "silver.regional_weather_hourly"
GOLD_FEATURES = "gold.caiso_hourly_load_features"
GOLD_LOAD_WEATHER = "gold.caiso_hourly_load_weather"
GOLD_DAILY = "gold.caiso_daily_summary"
GOLD_TOU = "gold.system_load_monthly_tou_summary"

STAGES = [HISTORICAL, VALIDATION]
# A filter on stage or year lists only the folders of those; inside a file rows are in the order of their dates.
BY_YEAR = ["source_stage", "load_year"]


def rebuild_layers(
    spark: SparkSession, load_paths: dict[str, str], weather_paths: dict[str, str], location: str | None = None
) -> dict[str, DataFrame]:
    """Rebuild every table from the staged files of both stages; returns the tables by name.

    A layer is read back before the next one is built, so a later step never repeats an earlier
    one, and joins are planned with real sizes. ``location`` puts the files below a folder of one's
    own choice, otherwise the catalog decides.
    """
    tables.create_layers(spark, location)
    built: dict[str, DataFrame] = {}

    def keep(name: str, rows: DataFrame, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> DataFrame:
        path = f"{location}/{name.replace('.', '/')}" if location else None
        built[name] = tables.rebuild_table(rows, name, partition_by, path, sort_by)
        return built[name]

    loads, weather = (
        [keep(name.format(stage=stage), read(spark, paths[stage])) for stage in STAGES]
        for name, read, paths in (
            (BRONZE_LOADS, text.read_staged_loads, load_paths),
            (BRONZE_WEATHER, text.read_raw_weather, weather_paths),
        )
    )
    silver = keep(SILVER_LOADS, medallion.silver_loads(*loads), ["source_stage"], ["load_date"])
    silver_weather = keep(SILVER_WEATHER, medallion.silver_weather(*weather), ["source_stage"], ["weather_date"])
    gold = keep(GOLD_FEATURES, medallion.gold_features(silver), BY_YEAR, ["load_date"])
    keep(GOLD_LOAD_WEATHER, medallion.gold_load_weather(gold, silver_weather), BY_YEAR, ["load_date"])
    keep(GOLD_DAILY, medallion.gold_daily_summary(gold))
    keep(GOLD_TOU, medallion.gold_monthly_tou(gold))
    return built
