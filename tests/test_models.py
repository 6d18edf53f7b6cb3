from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourgrid.fixed import CITIES, LOADS
from hourgrid.operators import errors, features, forest, order, regression
from hourgrid.plans import forecasts
from hourgrid.sources.scratch import store


@pytest.fixture(scope="module")
def signal(spark):
    """Three years of hours: daily wave, weekend step, squared temperature and a hash for noise."""
    hours = spark.range(3 * 365 * 24)
    day = F.date_add(F.lit("2021-01-01").cast("date"), F.floor(F.col("id") / 24).cast("int"))
    hour = (F.col("id") % 24 + 1).cast("int")
    noise = F.abs(F.hash("id")) % 200 - 100
    base = hours.select("id", day.alias("load_date"), hour.alias("hour_ending"), noise.alias("noise"))
    temps = {f"temp_{c}_f": 60 + 15 * F.sin(F.col("id") / 1400 + i) + F.abs(F.hash("id", F.lit(i))) % 10 for i, c in enumerate(CITIES)}
    base = base.withColumns({n: c.cast("double") for n, c in temps.items()})
    wave = 400 * F.sin(F.lit(2 * np.pi) * F.col("hour_ending") / 24) + 150 * F.when(F.weekday("load_date") >= 5, -1).otherwise(0)
    parts = {f"{t}_mw": (1000 + 100 * i + wave + 0.2 * F.col("temp_fresno_f") ** 2 + F.col("noise")).cast("decimal(12,3)") for i, t in enumerate(LOADS[:4])}
    total = sum((F.col(f"{t}_mw") for t in LOADS[:4]), F.lit(0))
    rows = base.withColumns(parts).withColumn("caiso_mw", total.cast("decimal(12,3)"))
    silver = rows.withColumns({"hour_instance": F.lit(1), "local_timestamp_label": F.timestamp_add("HOUR", F.col("hour_ending") - 1, F.col("load_date").cast("timestamp_ntz"))})
    weather = silver.select(F.col("local_timestamp_label").alias("timestamp"), *temps)
    return store(forecasts.modelling_frame(silver.drop("id", "noise", *temps), weather), "signal")


def dummies(codes):
    levels = np.unique(codes)[1:]
    return (codes[:, None] == levels[None, :]).astype(float)


@pytest.mark.parametrize("spec", [regression.BASIC, regression.WEATHER, regression.TERRITORY_SPECS["pge"]])
def test_regression_equals_least_squares(signal, spec):
    train, test = features.split_by_year(signal, 2021)
    fitted = regression.fit_ols(train, spec)
    found = fitted.forecast(test, "f").orderBy("row_ix").select("f").toPandas()["f"].to_numpy()

    columns = ["load_date", "hour_ending", *dict.fromkeys([*spec.numeric, spec.actual]), "row_ix"]
    both = train.dropna(subset=[*spec.numeric]).select(*columns).union(test.select(*columns)).orderBy("row_ix").toPandas()
    dates = both["load_date"].astype("datetime64[ns]")
    codes = {
        "hour": both["hour_ending"],
        "weekday": dates.dt.dayofweek,
        "month": dates.dt.month,
        "hour_in_month": dates.dt.month * 100 + both["hour_ending"],
    }
    numeric = both[list(spec.numeric)].astype(float).to_numpy()
    x = np.hstack([np.ones((len(both), 1)), *[dummies(codes[c].to_numpy()) for c in spec.classes], numeric])
    y = both[spec.actual].astype(float).to_numpy()
    known = len(both) - len(found)
    beta, *_ = np.linalg.lstsq(x[:known], y[:known], rcond=None)
    assert np.allclose(found, x[known:] @ beta, rtol=1e-6)
    residual = y[:known] - x[:known] @ beta
    assert abs(residual.mean()) < 1e-6


def test_unknown_classes_and_gaps_have_no_forecast(signal):
    train, test = features.split_by_year(signal, 2021)
    fitted = regression.fit_ols(train.where("hour_ending <> 5"), regression.INTERACTION)
    gaps = F.when(F.col("hour_ending") != 9, F.col("caiso_lag_24_mw"))
    forecast = fitted.forecast(test.withColumn("caiso_lag_24_mw", gaps), "f")
    missing = forecast.where("f is null").groupBy("hour_ending").count().collect()
    assert sorted((r.hour_ending, r["count"]) for r in missing) == [(5, 365), (9, 365)]
    assert forecasts.unscored_rows(forecast, "f").first().without_forecast == 730


def test_weather_and_lags_beat_the_naive_forecast(signal):
    naive = forecasts.naive_scores(signal.drop("row_ix", "hours_in_load_date"), 24, 2022).first()
    ols = forecasts.fit_and_score(signal, regression.TERRITORY_SPECS["pge"], 2021).first()
    assert 4 * ols.mae < naive.mae


def test_forest_is_repeatable_and_better_than_naive(spark, signal):
    small = forest.ForestSettings(trees=8, depth=7)
    train, test = features.split_by_year(signal, 2021)
    first, second = (forest.fit_forest(train, settings=small) for _ in range(2))
    scored = [errors.score(m.forecast(test), "caiso_mw", "forecast_rf").first() for m in (first, second)]
    assert scored[0] == scored[1]
    naive = forecasts.naive_scores(signal.drop("row_ix", "hours_in_load_date"), 24, 2022).first()
    assert scored[0].mae < naive.mae
    shares = first.importances(spark).collect()
    assert sum(r.importance for r in shares) == pytest.approx(1)
    assert [r.importance for r in shares] == sorted((r.importance for r in shares), reverse=True)


def test_final_validation_keeps_every_row_and_sums_territories(signal):
    gap = F.when(F.col("hour_ending") != 3, F.col("temp_poway_f"))
    holed = signal.withColumn("temp_poway_f", gap)
    results = store(forecasts.final_validation(holed, 2022, forest.ForestSettings(trees=3, depth=4)), "results")
    assert results.count() == 365 * 24
    parts = sum((F.col(f"forecast_{t}") for t in LOADS[:4]), F.lit(0.0))
    off = results.where(F.abs(parts - F.col("forecast_regional")) > 1e-6)
    assert off.count() == 0
    assert results.where("forecast_rf is null").count() == 365
    assert results.where("forecast_vea is null").count() == 0
    assert forecasts.validation_scores(results).count() == 2


def test_modelling_frame_lags_every_load(signal):
    lags = order.load_lags(LOADS)
    assert set(lags) <= set(signal.columns)
    assert signal.where("row_ix < 24 and pge_lag_24_mw is not null").count() == 0


def test_specs_fitted_together_keep_their_own_rows(signal):
    """Gaps differ by column, so every spec has its own complete rows in the one matrix."""
    holed = signal.withColumns(
        {
            "caiso_lag_24_mw": F.when(F.col("row_ix") % 7 != 0, F.col("caiso_lag_24_mw")),
            "temp_fresno_f": F.when(F.col("row_ix") % 5 != 0, F.col("temp_fresno_f")),
            "vea_mw": F.when(F.col("row_ix") % 11 != 0, F.col("vea_mw")),
        }
    )
    train, test = features.split_by_year(holed, 2021)
    specs = {"basic": regression.BASIC, **regression.TERRITORY_SPECS}
    together = regression.fit_specs(train.repartition(5), specs)
    for name in ("basic", "pge", "vea"):
        spec = specs[name]
        alone = regression.fit_ols(train.dropna(subset=[spec.actual, *spec.numeric]), spec)
        assert alone.slopes == pytest.approx(together[name].slopes, rel=1e-6)
        assert alone.intercept == pytest.approx(together[name].intercept, rel=1e-6)
    nothing = regression.fit_ols(train.limit(0), regression.BASIC)
    assert nothing.forecast(test, "f").where("f IS NOT NULL").count() == 0
