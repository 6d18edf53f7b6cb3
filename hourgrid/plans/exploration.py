"""The six questions asked of the gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hourgrid.fixed import HISTORICAL, MATCHED
from hourgrid.operators import features, summary
from hourgrid.plans import medallion


def exploration_pack(gold: DataFrame, load_weather: DataFrame, daily: DataFrame) -> dict[str, DataFrame]:
    """Coverage, daily shape, weekend shape, monthly peaks, trend, and load by temperature band."""
    historical = features.at_stage(gold, HISTORICAL)
    matched = features.at_stage(load_weather, HISTORICAL, MATCHED)
    weekend_keys = ["hour_ending", "is_weekend"]
    return {
        "coverage": summary.coverage(gold),
        "hourly_profile": summary.hourly_profile(historical).orderBy("hour_ending"),
        "weekend_profile": summary.mean_by(historical, weekend_keys).orderBy(*weekend_keys),
        "monthly_peaks": summary.monthly_peak_hours(historical),
        "rolling_trend": medallion.rolling_trend(daily),
        "temperature_bands": summary.band_profile(matched).orderBy("sacramento_temperature_band"),
    }
