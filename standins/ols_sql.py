"""Ordinary least squares as SQL, the twin of the fitted regressions.

One calendar class is absorbed: every column is taken as its difference from the mean of its class,
which leaves the other coefficients as they are. The remaining normal equations are eliminated
column by column in a recursive query over one matrix.
"""

from __future__ import annotations

from hourgrid.fixed import CITIES, LOADS
from hourgrid.operators.regression import OlsSpec
from standins import sql

_LAGS = ", ".join(f"LAG({n}_mw, {k}) OVER (ORDER BY row_ix) AS {n}_lag_{k}_mw" for n in LOADS for k in (24, 168))
_SQUARES = ", ".join(f"temp_{c}_f * temp_{c}_f AS temp_{c}_f_sq" for c in CITIES)

FRAME = f"""
frame AS MATERIALIZED (
  SELECT *, {_SQUARES}, YEAR(load_date) AS y, MONTH(load_date) AS month, ISODOW(load_date) AS weekday,
    hour_ending AS hour, MONTH(load_date) * 100 + hour_ending AS hour_in_month
  FROM (SELECT *, {_LAGS} FROM r_placed) l LEFT JOIN r_weather w ON l.local_timestamp_label = w."timestamp")"""

_LEVELS = {"weekday": range(2, 8), "month": range(2, 13)}


def forecast(spec: OlsSpec, last_train_year: int, name: str) -> str:
    """Queries ending in ``{name}``: row_ix and f, for the rows of the next year that have all inputs."""
    absorbed, *others = spec.classes
    columns = [f"CAST({c} AS DOUBLE)" for c in spec.numeric]
    columns += [f"CAST({c} = {level} AS DOUBLE)" for c in others for level in _LEVELS[c]]
    xs = [f"x{i}" for i in range(len(columns))]
    picked = ", ".join(f"{c} AS {x}" for c, x in zip(columns, xs))
    whole = " AND ".join(f"{c} IS NOT NULL" for c in spec.numeric)
    p = len(xs)
    names = [*xs, "a"]
    means = ", ".join(f"AVG({v}) AS m_{v}" for v in names)
    centred = ", ".join(f"t.{v} - m.m_{v} AS {v}" for v in names)
    rows = ", ".join("[" + ", ".join(f"SUM({xs[i]} * {v})" for v in names) + "]" for i in range(p))
    fitted = " + ".join(f"beta[{i + 1}] * (t.{x} - m.m_{x})" for i, x in enumerate(xs))
    n = name
    return f"""
{n}_train AS MATERIALIZED (SELECT {absorbed} AS g, {picked}, CAST({spec.actual} AS DOUBLE) AS a
  FROM frame WHERE y <= {last_train_year} AND {whole}),
{n}_means AS MATERIALIZED (SELECT g, {means} FROM {n}_train GROUP BY g),
{n}_centred AS MATERIALIZED (SELECT {centred} FROM {n}_train t JOIN {n}_means m USING (g)),
{n}_steps(k, e) AS (
  SELECT 0, [{rows}] FROM {n}_centred
  UNION ALL
  SELECT k + 1, [CASE WHEN i = k + 1 THEN [e[i][j] / e[i][i] FOR j IN range(1, {p + 2})]
    ELSE [e[i][j] - e[i][k + 1] * e[k + 1][j] / e[k + 1][k + 1] FOR j IN range(1, {p + 2})] END
    FOR i IN range(1, {p + 1})]
  FROM {n}_steps WHERE k < {p}),
{n}_beta AS MATERIALIZED (SELECT [e[i][{p + 1}] FOR i IN range(1, {p + 1})] AS beta FROM {n}_steps WHERE k = {p}),
{n} AS MATERIALIZED (SELECT t.row_ix, m.m_a + {fitted} AS f
  FROM (SELECT row_ix, {absorbed} AS g, {picked} FROM frame WHERE y = {last_train_year + 1} AND {whole}) t
  JOIN {n}_means m USING (g), {n}_beta)"""


def query(parts: list[str], body: str) -> str:
    return "WITH RECURSIVE " + ",".join([sql.READINGS.strip(), FRAME, *parts]) + "\n" + body


def score(actual: str, predicted: str, digits: int) -> str:
    error = f"({actual} - {predicted})"
    return f"""COUNT(*) AS scored_rows, ROUND(AVG(ABS{error}), {digits}) AS mae,
  ROUND(SQRT(AVG({error} * {error})), {digits}) AS rmse, ROUND(AVG(ABS{error} / {actual}) * 100, {digits}) AS mape"""
