"""Scores of a forecast and where it goes wrong."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourgrid.fixed import GROUP_ROWS
from hourgrid.functions import scores as S
from hourgrid.operators.joins import peak_row
from hourgrid.operators.quantiles import exact_quantiles

DIGITS = 8


def score(df: DataFrame, actual: str, forecast: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and MAPE over rows with both values, and their number."""
    both = df.where(F.col(actual).isNotNull() & F.col(forecast).isNotNull())
    measures = [c.alias(name) for name, c in S.scores(F.col(actual), F.col(forecast), DIGITS).items()]
    return both.groupBy(*by).agg(F.count("*").alias("scored_rows"), *measures)


def add_errors(df: DataFrame, actual: str, forecast: str) -> DataFrame:
    """``error`` (actual minus forecast), ``abs_error`` and ``ape`` in percent."""
    error = S.error_of(F.col(actual), F.col(forecast))
    return df.withColumns(
        {"error": error, "abs_error": F.abs(error), "ape": S.percentage_of(F.abs(error), F.col(actual))}
    )


def _measures(*names: str) -> list[Column]:
    error = F.col("error")
    known = {
        "mae": S.mean_of(F.col("abs_error")),
        "mape": S.mean_of(F.col("ape")),
        "rmse": S.root_mean_square(error),
    }
    return [F.round(known[name], DIGITS).alias(name) for name in names]


def error_by_month(errors: DataFrame, day: str = "load_date") -> DataFrame:
    return errors.groupBy(F.month(day).alias("load_month")).agg(*_measures("mae", "mape", "rmse"))


def error_by_hour(errors: DataFrame, hour: str = "hour_ending") -> DataFrame:
    return errors.groupBy(hour).agg(*_measures("mae", "mape"))


def load_threshold(
    df: DataFrame, load: str, fraction: float = 0.95, group_rows: int = GROUP_ROWS
) -> float | None:
    """The exact quantile of the load, linear between neighbours."""
    return exact_quantiles(df, [load], [fraction], group_rows)[load][0]


def top_load_rows(df: DataFrame, load: str, fraction: float = 0.95) -> DataFrame:
    """Rows at or above the quantile."""
    return df.where(F.col(load) >= F.lit(load_threshold(df, load, fraction)))


def peak_hours_metrics(errors: DataFrame, load: str, fraction: float = 0.95) -> DataFrame:
    """Threshold and scores over the highest loads."""
    threshold = load_threshold(errors, load, fraction)
    return (
        errors.where(F.col(load) >= F.lit(threshold))
        .agg(*_measures("mae", "rmse", "mape"))
        .select(F.lit(threshold).cast("double").alias("load_threshold"), "mae", "rmse", "mape")
    )


def peak_error(df: DataFrame, actual: str, forecast: str) -> DataFrame:
    """The annual peak: when, how much, the forecast, its error and error in percent."""
    top = peak_row(df, actual)
    error = S.error_of(F.col(actual), F.col(forecast))
    return top.select(
        "load_date",
        "hour_ending",
        F.col(actual).alias("peak_load"),
        F.col(forecast).alias("peak_forecast"),
        error.alias("peak_error"),
        F.round(S.percentage_of(F.abs(error), F.col(actual)), DIGITS).alias("peak_error_pct"),
    )


def leaderboard(df: DataFrame, actual: str, forecasts: Mapping[str, str], base: str) -> DataFrame:
    """One row per model, best first, with the change of MAE against ``base`` in percent.

    ``forecasts`` maps a model name to its column. Each row fans out into one row per model before
    the aggregate, which combines them inside the task again.
    """
    pairs = [F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("forecast")) for m, c in forecasts.items()]
    long = df.select(F.col(actual).cast("double").alias("actual"), F.inline(F.array(*pairs)))
    table = score(long, "actual", "forecast", ["model"])
    # One row per model, so one task holds them all.
    base_mae = F.max(F.when(F.col("model") == base, F.col("mae"))).over(W.partitionBy())
    change = F.round((F.col("mae") - base_mae) / base_mae * 100, 6)
    board = table.withColumn("mae_change_pct", change)
    return board.orderBy("mae", "model")
