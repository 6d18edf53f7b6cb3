"""Forecast models on the readings: train to 1999, score 2000; final run trains to 2000."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourgrid.fixed import TERRITORIES
from hourgrid.operators import errors, features, forest, regression
from hourgrid.plans import error_report, forecasts
from hourgrid.sources import text
from hourgrid.sources.scratch import scratch_path, store
from standins import inputs, ols_sql, sql
from standins.registry import register
from standins.section_b import naive_test

DIGITS = 4
ACTUAL = "CAST(caiso_mw AS DOUBLE)"
# The full-size forest, as in the operator.
FOREST = forest.ForestSettings()


def rounded(scores):
    return scores.withColumns({c: F.round(c, DIGITS) for c in ["mae", "rmse", "mape"]})


def frame(spark, sf):
    return forecasts.stored_frame(inputs.readings_silver(spark, sf), inputs.readings_weather(spark, sf))


def _naive(hours):
    def query(spark, sf):
        return forecasts.naive_scores(inputs.readings_silver(spark, sf), hours, inputs.TEST_YEAR)

    return query


for _place, _hours in ((1, 24), (2, 168)):
    _scores = sql.score("caiso_mw", f"forecast_{_hours}")
    register(
        f"j{_place:02d}_seasonal_naive_{_hours}",
        sql.readings(f"SELECT COUNT(*) AS scored_rows, {_scores} FROM r_test"),
    )(_naive(_hours))


def _fitted(spec):
    def query(spark, sf):
        return rounded(forecasts.fit_and_score(frame(spark, sf), spec, inputs.LAST_TRAIN_YEAR))

    return query


_MODELS = {
    "j03_ols_basic": regression.BASIC,
    "j04_ols_interaction": regression.INTERACTION,
    "j05_ols_weather": regression.WEATHER,
    "j06_ols_region_pge": regression.TERRITORY_SPECS["pge"],
    "j07_ols_region_sce": regression.TERRITORY_SPECS["sce"],
    "j08_ols_region_sdge": regression.TERRITORY_SPECS["sdge"],
    "j09_ols_region_vea": regression.TERRITORY_SPECS["vea"],
}
for _name, _spec in _MODELS.items():
    _actual = f"CAST({_spec.actual} AS DOUBLE)"
    register(
        _name,
        ols_sql.query(
            [ols_sql.forecast(_spec, inputs.LAST_TRAIN_YEAR, "m")],
            f"SELECT {ols_sql.score(_actual, 'f', DIGITS)} FROM frame JOIN m USING (row_ix)",
        ),
    )(_fitted(_spec))


def _regional(spark, sf, last_train_year):
    columns = ["caiso_mw", *regression.columns_read(regression.TERRITORY_SPECS)]
    rows = forecasts.stored_frame(inputs.readings_silver(spark, sf), inputs.readings_weather(spark, sf), columns)
    train, test = features.split_by_year(rows, last_train_year)
    return regression.forecast_territories(test, regression.fit_territories(train))


def _territories(last_train_year):
    return [
        ols_sql.forecast(spec, last_train_year, f"f_{t}") for t, spec in regression.TERRITORY_SPECS.items()
    ]


_SUM = " + ".join(f"f_{t}.f" for t in TERRITORIES)
_ALL = "frame " + " ".join(f"JOIN f_{t} ON frame.row_ix = f_{t}.row_ix" for t in TERRITORIES)


@register(
    "j10_regional_metrics",
    ols_sql.query(
        _territories(inputs.LAST_TRAIN_YEAR),
        "\nUNION ALL ".join(
            f"""SELECT '{t}' AS territory, {ols_sql.score(f"CAST({t}_mw AS DOUBLE)", "f", DIGITS)}
FROM frame JOIN f_{t} USING (row_ix)"""
            for t in TERRITORIES
        ),
    ),
)
def regional_metrics(spark, sf):
    return rounded(forecasts.territory_scores(_regional(spark, sf, inputs.LAST_TRAIN_YEAR), TERRITORIES))


def _bottom_up(last_train_year):
    return ols_sql.query(
        _territories(last_train_year), f"SELECT {ols_sql.score(ACTUAL, f'({_SUM})', DIGITS)} FROM {_ALL}"
    )


@register("j11_bottom_up_sum", _bottom_up(inputs.LAST_TRAIN_YEAR))
def bottom_up_sum(spark, sf):
    regional = _regional(spark, sf, inputs.LAST_TRAIN_YEAR)
    return rounded(errors.score(regional, "caiso_mw", "forecast_regional"))


@register("j11_bottom_up_sum_final", _bottom_up(inputs.TEST_YEAR))
def bottom_up_sum_final(spark, sf):
    regional = _regional(spark, sf, inputs.TEST_YEAR)
    return rounded(errors.score(regional, "caiso_mw", "forecast_regional"))


# One forest per session, tables and split; its nodes are in the scratch folder.
_FORESTS: dict[tuple, forest.FittedForest] = {}


def _frame_and_forest(spark, sf, last_train_year):
    """The frame and the forest of one split; the queries share what the first of them trains."""
    key = (spark.sparkContext.applicationId, sf, last_train_year)
    rows = frame(spark, sf)
    if key not in _FORESTS:
        train, _ = features.split_by_year(rows, last_train_year)
        _FORESTS[key] = forest.fit_forest(train, settings=FOREST)
    return rows, _FORESTS[key]


def _forest(spark, sf):
    return _frame_and_forest(spark, sf, inputs.LAST_TRAIN_YEAR)


@register("j12_random_forest_fit")
def random_forest_fit(spark, sf):
    """Size of the trained forest."""
    return _forest(spark, sf)[1].sizes(spark)


@register("j13_random_forest_predict")
def random_forest_predict(spark, sf):
    rows, fitted = _forest(spark, sf)
    _, test = features.split_by_year(rows, inputs.LAST_TRAIN_YEAR)
    return rounded(errors.score(fitted.forecast(test), "caiso_mw", "forecast_rf"))


@register("j14_feature_importance")
def feature_importance(spark, sf):
    return _forest(spark, sf)[1].importances(spark)


@register("f05_sort_importances")
def sort_importances(spark, sf):
    """Largest first; the rank is part of the result."""
    importances = _forest(spark, sf)[1].importances(spark)
    # One row per feature.
    rank = F.row_number().over(W.orderBy(F.desc("importance"), "feature"))
    return importances.withColumn("rank", rank).orderBy("rank")


def _final(spark, sf):
    rows, fitted = _frame_and_forest(spark, sf, inputs.TEST_YEAR)
    return forecasts.final_validation(rows, inputs.TEST_YEAR, fitted=fitted)


@register("j15_final_validation")
def final_validation(spark, sf):
    """Every row of the final year with all six forecasts, as written to CSV and read back."""
    results = _final(spark, sf)
    path = scratch_path(spark, "forecasts")
    text.write_csv(results, path)
    return text.read_csv_text(spark, path, results.schema)


@register("j15_final_leaderboard")
def final_leaderboard(spark, sf):
    return rounded(forecasts.validation_scores(_final(spark, sf)))


def _all_models():
    """Scores of every model but the forest, each on the rows that it has a forecast for."""
    specs = {"ols_basic": regression.BASIC, "ols_interaction": regression.INTERACTION, "ols_weather": regression.WEATHER}
    parts = [ols_sql.forecast(spec, inputs.LAST_TRAIN_YEAR, name) for name, spec in specs.items()]
    test = f"y = {inputs.LAST_TRAIN_YEAR + 1}"
    bodies = [
        f"SELECT '{model}' AS model, {ols_sql.score(ACTUAL, f'CAST(caiso_lag_{h}_mw AS DOUBLE)', 12)} FROM frame WHERE {test} AND caiso_lag_{h}_mw IS NOT NULL"
        for model, h in (("naive_168", 168), ("naive_24", 24))
    ]
    bodies += [f"SELECT '{name}', {ols_sql.score(ACTUAL, f'{name}.f', 12)} FROM frame JOIN {name} USING (row_ix)" for name in specs]
    bodies.append(f"SELECT 'regional_ols', {ols_sql.score(ACTUAL, f'({_SUM})', 12)} FROM {_ALL}")
    union = "\nUNION ALL ".join(bodies)
    return ols_sql.query(
        [*parts, *_territories(inputs.LAST_TRAIN_YEAR)],
        f"""SELECT model, scored_rows, ROUND(mae, {DIGITS}) AS mae, ROUND(rmse, {DIGITS}) AS rmse, ROUND(mape, {DIGITS}) AS mape,
  ROUND((mae - base) / base * 100, 3) AS mae_change_pct
FROM (SELECT *, MAX(CASE WHEN model = 'naive_168' THEN mae END) OVER () AS base FROM ({union}))""",
    )


def _board(results):
    board = rounded(forecasts.all_scores(results))
    return board.withColumn("mae_change_pct", F.round("mae_change_pct", 3))


@register("j17_all_models_leaderboard", _all_models())
def all_models_leaderboard(spark, sf):
    """Two naive forecasts, three regressions and the regional sum in one table."""
    return _board(forecasts.all_forecasts(frame(spark, sf), inputs.LAST_TRAIN_YEAR))


@register("j17_all_models_leaderboard_forest")
def all_models_leaderboard_forest(spark, sf):
    """The same with the forest."""
    rows, fitted = _forest(spark, sf)
    return _board(forecasts.all_forecasts(rows, inputs.LAST_TRAIN_YEAR, fitted))


def _report(results, forecast):
    """The scored tables of the report, stacked."""
    report = error_report.error_report(results, "caiso_mw", forecast)
    month = report["by_month"].select(F.lit("month").alias("part"), F.col("load_month").alias("key"), "mae", "mape", "rmse")
    hour = report["by_hour"].select(F.lit("hour").alias("part"), F.col("hour_ending").alias("key"), "mae", "mape")
    top = report["top_hours"].select(F.lit("top").alias("part"), "load_threshold", "mae", "mape", "rmse")
    week = report["peak_week"].agg(F.lit("peak week").alias("part"), F.count("*").cast("int").alias("key"))
    peak = report["peak"].select(
        F.lit("peak").alias("part"),
        F.col("hour_ending").alias("key"),
        F.col("peak_load").cast("double").alias("load_threshold"),
        F.col("peak_error").cast("double").alias("mae"),
        F.col("peak_error_pct").alias("mape"),
    )
    return text.stack_by_name([month, hour, top, week, peak])


_MAE = f"ROUND({sql.mean('abs_error')}, 8) AS mae"
_MAPE = f"ROUND({sql.mean('ape')}, 8) AS mape"
_RMSE = f"ROUND(SQRT({sql.mean('error * error')}), 8) AS rmse"
_TOP = "(SELECT quantile_cont(CAST(caiso_mw AS DOUBLE), 0.95) FROM r_errors)"


@register(
    "j16_error_report",
    sql.readings(
        f"""SELECT 'month' AS part, CAST(MONTH(load_date) AS INT) AS key, CAST(NULL AS DOUBLE) AS load_threshold,
  {_MAE}, {_MAPE}, {_RMSE} FROM r_errors GROUP BY 2
UNION ALL SELECT 'hour', hour_ending, NULL, {_MAE}, {_MAPE}, NULL FROM r_errors GROUP BY 2
UNION ALL SELECT 'top', NULL, {_TOP}, {_MAE}, {_MAPE}, {_RMSE} FROM r_errors WHERE caiso_mw >= {_TOP}
UNION ALL SELECT 'peak week', CAST(COUNT(*) AS INT), NULL, NULL, NULL, NULL FROM r_errors
  WHERE ABS(date_diff('day', load_date, (SELECT load_date FROM r_errors ORDER BY caiso_mw DESC, row_ix LIMIT 1))) <= 3
UNION ALL SELECT * FROM (SELECT 'peak', hour_ending, CAST(caiso_mw AS DOUBLE), CAST(error AS DOUBLE), ROUND(ape, 8), NULL
  FROM r_errors ORDER BY caiso_mw DESC, row_ix LIMIT 1)"""
    ),
)
def error_report_naive(spark, sf):
    """On the 24-row forecast, stored once and read by every part."""
    return _report(store(naive_test(spark, sf), "naive_results"), "forecast_24")


@register("j16_error_report_forest")
def error_report_forest(spark, sf):
    return _report(store(_final(spark, sf), "final_results"), "forecast_rf")
