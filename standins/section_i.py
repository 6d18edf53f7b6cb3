"""Time-series diagnostics on the readings as one long series."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.operators import diagnostics, order
from standins import inputs, sql
from standins.registry import register

LOAD = "caiso_mw"
KPSS_LAGS = 12


def _series(column, start):
    """The series ``x`` at ``t`` with its mean, its first values left out where a difference has none."""
    return f"""series AS MATERIALIZED (
  SELECT row_ix - {start} AS t, CAST({column} AS DOUBLE) AS x FROM r_naive WHERE row_ix >= {start}),
level AS (SELECT COUNT(*) AS n, {sql.mean(f"CAST({column} AS DECIMAL(18,3))")} AS m FROM r_naive WHERE row_ix >= {start}),
centred AS MATERIALIZED (SELECT t, x - m AS e, n FROM series, level)"""


def _products(max_lag):
    return f"""products AS MATERIALIZED (
  SELECT k, SUM(a.e * b.e) AS p, MIN(a.n) AS n FROM range({max_lag + 1}) AS lags(k), centred a, centred b
  WHERE b.t = a.t + k GROUP BY k)"""


def _with(*parts):
    return "WITH RECURSIVE " + ",\n".join([sql.READINGS.strip(), *parts])


def _acf(column, start, max_lag):
    return (
        _with(_series(column, start), _products(max_lag))
        + """
, r AS (SELECT k, n, p / FIRST_VALUE(p) OVER (ORDER BY k) AS r FROM products)
SELECT CAST(k AS INT) AS lag, ROUND(r, 8) AS autocorrelation,
  CASE WHEN k = 0 THEN 0 ELSE ROUND(1.959963984540054 * SQRT((1 + 2 * COALESCE(SUM(CASE WHEN k > 0 THEN r * r ELSE 0 END)
    OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n), 8) END AS band
FROM r"""
    )


@register(
    "i01_lag_correlation",
    sql.readings(
        "\nUNION ALL ".join(
            f"""SELECT CAST({k} AS INT) AS lag, ROUND(CORR(x, y), 8) AS correlation FROM (
  SELECT CAST(caiso_mw AS DOUBLE) AS x, CAST(LAG(caiso_mw, {k}) OVER (ORDER BY row_ix) AS DOUBLE) AS y FROM r_placed)"""
            for k in (1, 24, 48, 168)
        )
    ),
)
def lag_correlation(spark, sf):
    return diagnostics.lag_correlations(inputs.readings_placed(spark, sf), LOAD)


@register("i02_acf", _acf("caiso_mw", 0, 200))
def acf(spark, sf):
    return diagnostics.acf(inputs.readings_placed(spark, sf), LOAD)


def _differenced(hours):
    def query(spark, sf):
        gaps = order.add_seasonal_differences(inputs.readings_placed(spark, sf), LOAD, [hours])
        return diagnostics.acf(gaps.where(F.col("row_ix") >= hours), f"diff_{hours}")

    return query


for _hours in (24, 168):
    register(f"i02_acf_diff_{_hours}", _acf(f"(caiso_mw - forecast_{_hours})", _hours, 200))(_differenced(_hours))


@register(
    "i03_acf_confidence",
    _acf("caiso_mw", 0, 48).replace("ROUND(r, 8) AS autocorrelation,", ""),
)
def acf_confidence(spark, sf):
    return diagnostics.acf(inputs.readings_placed(spark, sf), LOAD, max_lag=48).select("lag", "band")


@register(
    "i04_pacf",
    _with(
        _series("caiso_mw", 0),
        _products(60),
        """r AS (SELECT list(p / p0 ORDER BY k) AS r FROM products, (SELECT p AS p0 FROM products WHERE k = 0))""",
        """steps(k, phi, last) AS (
  SELECT 1, [r[2]], r[2] FROM r
  UNION ALL
  SELECT k + 1, list_append([phi[j] - a * phi[k + 1 - j] FOR j IN range(1, k + 1)], a), a FROM (
    SELECT k, phi, (r[k + 2] - list_sum([phi[j] * r[k + 2 - j] FOR j IN range(1, k + 1)]))
      / (1 - list_sum([phi[j] * r[j + 1] FOR j IN range(1, k + 1)])) AS a
    FROM steps, r WHERE k < 60))""",
    )
    + """
SELECT 0 AS lag, CAST(1 AS DOUBLE) AS partial_autocorrelation
UNION ALL SELECT CAST(k AS INT), ROUND(last, 8) FROM steps""",
)
def pacf(spark, sf):
    return diagnostics.pacf(inputs.readings_placed(spark, sf), LOAD)


def _eliminated(name, source, columns, steps):
    """Products of the listed columns over ``source``, the first ``steps`` of them eliminated one by one."""
    return f"""{name}_sums AS MATERIALIZED (
  SELECT i, j, SUM({columns}[i] * {columns}[j]) AS p FROM {source}, range(1, 1000) a(i), range(1, 1000) b(j)
  WHERE i <= j AND j <= len({columns}) GROUP BY i, j),
{name}_rows AS (
  SELECT i, list(p ORDER BY j) AS r FROM (
    SELECT i, j, p FROM {name}_sums UNION ALL SELECT j, i, p FROM {name}_sums WHERE i < j) GROUP BY i),
{name}(k, e) AS (
  SELECT 0, (SELECT list(r ORDER BY i) FROM {name}_rows)
  UNION ALL
  SELECT k + 1, [CASE WHEN i = k + 1 THEN e[i]
    ELSE [e[i][j] - e[i][k + 1] * e[k + 1][j] / e[k + 1][k + 1] FOR j IN range(1, len(e) + 1)] END
    FOR i IN range(1, len(e) + 1)]
  FROM {name} WHERE k < {steps})"""


def _tau(column, start):
    """The statistic, lags and rows of the unit-root test with every lag order that the rule allows."""
    return _with(
        _series(column, start),
        "limits AS MATERIALIZED (SELECT CAST(LEAST(CEIL(12 * POWER(n / 100.0, 0.25)), n // 2 - 2) AS INT) AS most FROM level)",
        """steps AS MATERIALIZED (SELECT t, LAG(e) OVER (ORDER BY t) AS level, e - LAG(e) OVER (ORDER BY t) AS y, most
  FROM centred, limits)""",
        """rows_all AS MATERIALIZED (SELECT *, list_reverse(list(y) OVER (ORDER BY t ROWS BETWEEN most PRECEDING AND 1 PRECEDING)) AS gaps
  FROM steps)""",
        "rows_full AS MATERIALIZED (SELECT list_concat([1.0, level], gaps, [y]) AS v FROM rows_all WHERE t > most)",
        _eliminated("nested", "rows_full", "v", "(SELECT most FROM limits) + 2"),
        """orders AS (SELECT k - 2 AS lags, n * LN(e[len(e)][len(e)] / n) + 2 * k AS aic
  FROM nested, (SELECT COUNT(*) AS n FROM rows_full) WHERE k >= 2)""",
        "best AS MATERIALIZED (SELECT CAST(arg_min(lags, aic) AS INT) AS lags FROM orders)",
        "rows_used AS MATERIALIZED (SELECT list_concat([1.0], gaps[:lags], [level, y]) AS v FROM rows_all, best WHERE t > lags)",
        _eliminated("refit", "rows_used", "v", "(SELECT lags FROM best) + 1"),
        """tau AS (SELECT e[lags + 2][lags + 3] / SQRT((e[lags + 3][lags + 3] - e[lags + 2][lags + 3] * e[lags + 2][lags + 3] / e[lags + 2][lags + 2])
    / (used_rows - lags - 2) * e[lags + 2][lags + 2]) AS x, lags, used_rows
  FROM refit, best, (SELECT COUNT(*) AS used_rows FROM rows_used) WHERE k = lags + 1)""",
    )


@register(
    "i05_adf_statistic",
    _tau("(caiso_mw - forecast_24)", 24) + "\nSELECT ROUND(x, 6) AS statistic, CAST(lags AS INT) AS lags, used_rows FROM tau",
)
def adf_statistic(spark, sf):
    """On the 24-row difference, which needs many lags."""
    gaps = order.add_seasonal_differences(inputs.readings_placed(spark, sf), LOAD, [24])
    return diagnostics.adf_test(gaps.where(F.col("row_ix") >= 24), "diff_24").select("statistic", "lags", "used_rows")


@register(
    "i05_adf_test",
    _tau("caiso_mw", 0)
    + """
, place AS (SELECT *, CASE WHEN x <= -1.61 THEN 2.1659 + 1.4412 * x + 0.038269 * x * x
    ELSE 1.7339 + 0.93202 * x - 0.12745 * x * x - 0.010368 * x * x * x END AS z FROM tau)
-- The normal distribution function by its power series, |z|^(2k+1) over the odd numbers up to 2k+1.
, normal AS (SELECT *, 0.5 + SIGN(z) * EXP(-z * z / 2) / SQRT(2 * PI()) * list_sum([
    EXP((2 * k + 1) * LN(ABS(z)) - (k + 1) * LN(2) - lgamma(k + 1.5) + LN(PI()) / 2) FOR k IN range(0, 200)]) AS below FROM place)
SELECT ROUND(x, 6) AS statistic, ROUND(CASE WHEN x > 2.74 THEN 1 WHEN x < -18.83 OR z < -8 THEN 0 WHEN z > 8 THEN 1 ELSE below END, 6) AS p_value,
  CAST(lags AS INT) AS lags, used_rows
FROM normal""",
)
def adf_test(spark, sf):
    """All lags the rule allows, and the p-value."""
    return diagnostics.adf_test(inputs.readings_placed(spark, sf), LOAD)


@register(
    "i06_kpss_statistic",
    _with(_series("caiso_mw", 0), _products(KPSS_LAGS))
    + f"""
, path AS (SELECT SUM(e) OVER (ORDER BY t) AS s FROM centred)
SELECT ROUND((SELECT SUM(s * s) FROM path) / n / n / v, 8) AS statistic, CAST({KPSS_LAGS} AS INT) AS lags
FROM (SELECT MIN(n) AS n, SUM(CASE WHEN k = 0 THEN p ELSE 2 * (1 - k / {KPSS_LAGS + 1}.0) * p END) / MIN(n) AS v
  FROM products)""",
)
def kpss_statistic(spark, sf):
    """Fixed bandwidth."""
    return diagnostics.kpss_test(inputs.readings_placed(spark, sf), LOAD, KPSS_LAGS).select("statistic", "lags")


@register(
    "i06_kpss_test",
    _with(_series("caiso_mw", 0), _products(200))
    + """
, path AS (SELECT SUM(e) OVER (ORDER BY t) AS s FROM centred)
, size AS (SELECT MIN(n) AS n, CAST(FLOOR(POWER(MIN(n), 2 / 9.0)) AS INT) AS m FROM products)
, ratio AS (SELECT SUM(CASE WHEN k = 0 THEN 0 ELSE 2 * k * p END) / SUM(CASE WHEN k = 0 THEN p ELSE 2 * p END) AS r
  FROM products, size WHERE k <= m)
, width AS (SELECT n, CAST(FLOOR(1.1447 * POWER(r * r, 1 / 3.0) * POWER(n, 1 / 3.0)) AS INT) AS lags FROM ratio, size)
, variance AS (SELECT SUM(CASE WHEN k = 0 THEN p ELSE 2 * (1 - CAST(k AS DOUBLE) / (lags + 1)) * p END) / MIN(width.n) AS v
  FROM products, width WHERE k <= lags)
, test AS (SELECT (SELECT SUM(s * s) FROM path) / n / n / v AS x, lags FROM width, variance)
SELECT ROUND(x, 8) AS statistic, lags, ROUND(CASE
    WHEN x <= 0.347 THEN 0.1
    WHEN x <= 0.463 THEN 0.1 - 0.05 * (x - 0.347) / (0.463 - 0.347)
    WHEN x <= 0.574 THEN 0.05 - 0.025 * (x - 0.463) / (0.574 - 0.463)
    WHEN x <= 0.739 THEN 0.025 - 0.015 * (x - 0.574) / (0.739 - 0.574)
    ELSE 0.01 END, 8) AS p_value
FROM test""",
)
def kpss_test(spark, sf):
    """Automatic bandwidth and p-value."""
    return diagnostics.kpss_test(inputs.readings_placed(spark, sf), LOAD)
