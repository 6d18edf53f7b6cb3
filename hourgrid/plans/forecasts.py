"""The modelling frame, naive forecasts and the final validation run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.fixed import LOADS, TEMPERATURE_COLUMNS
from hourgrid.operators import clean, errors, features, forest, joins, order, regression
from hourgrid.sources.scratch import store


def modelling_frame(silver: DataFrame, weather: DataFrame, temperatures: Sequence[str] = TEMPERATURE_COLUMNS) -> DataFrame:
    """Silver rows with position, weather by label, lags of all five loads, calendar and squares.

    ``weather`` has ``timestamp`` and the temperature columns. The position comes before the join
    and the join keeps one row per load row (a label occurs once in ``weather``). Temperatures are squared
    a label and joined last, so they pass no shuffle of load rows.
    """
    placed = order.add_position(silver).withColumnRenamed("local_timestamp_label", "timestamp")
    lagged = order.add_lags(placed, order.load_lags(LOADS))
    calendar = features.add_day_name(features.add_year_month(lagged))
    squared = features.add_squares(weather.select("timestamp", *temperatures), temperatures)
    rows = [c for c in placed.columns if c != "timestamp"]
    derived = [c for c in calendar.columns if c not in placed.columns]
    squares = [c for c in squared.columns if c not in ("timestamp", *temperatures)]
    return joins.join_weather_on_label(calendar, squared).select("timestamp", *rows, *temperatures, *derived, *squares)


def naive_forecasts(silver: DataFrame, load: str = "caiso_mw") -> DataFrame:
    """``forecast_24`` and ``forecast_168``: the load that many rows earlier."""
    lags = {"forecast_24": (load, 24), "forecast_168": (load, 168)}
    return order.add_lags(order.add_position(silver), lags)


def naive_scores(silver: DataFrame, hours: int, test_year: int, load: str = "caiso_mw") -> DataFrame:
    """Scores of one seasonal-naive forecast on one year."""
    _, test = features.split_by_year(naive_forecasts(silver, load), test_year - 1)
    return errors.score(test, load, f"forecast_{hours}")


def fit_and_score(
    frame: DataFrame, spec: regression.OlsSpec, last_train_year: int, name: str = "forecast"
) -> DataFrame:
    """Train up to a year, score the next one."""
    train, test = features.split_by_year(frame, last_train_year)
    fitted = regression.fit_ols(train, spec)
    return errors.score(fitted.forecast(test, name), spec.actual, name)


def territory_scores(forecast: DataFrame, territories: Sequence[str]) -> DataFrame:
    return errors.score(regression.territory_rows(forecast, territories), "actual", "forecast", ["territory"])


def final_validation(
    frame: DataFrame,
    last_train_year: int,
    settings: forest.ForestSettings = forest.ForestSettings(),
    fitted: forest.FittedForest | None = None,
) -> DataFrame:
    """All test rows with the territory, regional and forest forecasts.

    ``frame`` is read by two fits and the forecast, so pass a stored table; ``fitted`` is a forest trained on the
    same split, if there is one already.
    """
    train, test = features.split_by_year(frame, last_train_year)
    regional = regression.forecast_territories(test, regression.fit_territories(train))
    return (fitted or forest.fit_forest(train, settings=settings)).forecast(regional)


# Every model by the column of its forecast; the base of comparison comes first.
ALL_MODELS = {
    "naive_168": "caiso_lag_168_mw",
    "naive_24": "caiso_lag_24_mw",
    "ols_basic": "forecast_basic",
    "ols_interaction": "forecast_interaction",
    "ols_weather": "forecast_weather",
    "regional_ols": "forecast_regional",
    "random_forest": "forecast_rf",
}


def all_forecasts(frame: DataFrame, last_train_year: int, fitted: forest.FittedForest | None = None) -> DataFrame:
    """The rows of the test year with the forecasts of every model; all regressions come from one pass over the training rows.

    The naive forecasts are the lags that the frame has. Without a forest its column is missing.
    """
    train, test = features.split_by_year(frame, last_train_year)
    single = {"basic": regression.BASIC, "interaction": regression.INTERACTION, "weather": regression.WEATHER}
    models = regression.fit_specs(train, {**single, **regression.TERRITORY_SPECS})
    for name in single:
        test = models[name].forecast(test, f"forecast_{name}")
    test = regression.forecast_territories(test, {t: models[t] for t in regression.TERRITORY_SPECS})
    return fitted.forecast(test) if fitted else test


def all_scores(results: DataFrame) -> DataFrame:
    """Leaderboard of the models that ``results`` has, against the weekly naive forecast."""
    there = {model: column for model, column in ALL_MODELS.items() if column in results.columns}
    return errors.leaderboard(results, "caiso_mw", there, next(iter(ALL_MODELS)))


def validation_scores(results: DataFrame) -> DataFrame:
    """Leaderboard of the regional sum and the forest."""
    models = {"regional_ols": "forecast_regional", "random_forest": "forecast_rf"}
    return errors.leaderboard(results, "caiso_mw", models, "regional_ols")


def unscored_rows(results: DataFrame, forecast: str) -> DataFrame:
    """Rows left without a forecast, by reason: a gap in the input, or a class never trained."""
    missing = clean.any_missing([forecast])
    return results.agg(F.count_if(missing).alias("without_forecast"), F.count("*").alias("rows"))


def stored_frame(silver: DataFrame, weather: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The modelling frame written once: later fits read the columns they need from Parquet.

    ``columns`` may name all that will be read; then no others are sorted, shuffled or written.
    """
    frame = modelling_frame(silver, weather)
    return store(frame.select(*columns) if columns else frame, "modelling_frame")
