"""Means and forecast scores.

A mean is the exact sum divided by the count: sums of decimals do not depend on the order in
which partitions arrive, so two runs agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_of(value: Column) -> Column:
    return F.try_divide(F.sum(value).cast("double"), F.count(value))


def error_of(actual: Column, forecast: Column) -> Column:
    """Positive when the forecast was too low."""
    return actual - forecast


def percentage_of(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole``; infinite for a zero whole, NULL for zero of zero."""
    part, whole = part.cast("double"), whole.cast("double")
    return F.when(whole != 0, F.try_divide(part, whole) * 100).when(part != 0, F.lit(float("inf")))


def mean_absolute(error: Column) -> Column:
    return mean_of(F.abs(error))


def root_mean_square(error: Column) -> Column:
    return F.sqrt(mean_of(error * error))


def mean_percentage(error: Column, actual: Column) -> Column:
    return mean_of(percentage_of(F.abs(error), F.abs(actual)))


def scores(actual: Column, forecast: Column, digits: int = 8) -> dict[str, Column]:
    """MAE, RMSE and MAPE over the rows that have both values."""
    error = error_of(actual, forecast)
    return {
        "mae": F.round(mean_absolute(error), digits),
        "rmse": F.round(root_mean_square(error), digits),
        "mape": F.round(mean_percentage(error, actual), digits),
    }
