"""The stand-in inputs once more, as SQL for the oracle."""

from __future__ import annotations

from hourgrid.fixed import CITIES, LOADS

MW = ", ".join(f"{name}_mw" for name in LOADS)
TEMPS = ", ".join(f"temp_{city}_f" for city in CITIES)

_SILVER = """
{p}_numbered AS (
  SELECT *,
    CAST(ROW_NUMBER() OVER (PARTITION BY load_date, hour_ending
      ORDER BY source_file, caiso_mw, pge_mw, sce_mw, sdge_mw, vea_mw) AS INT) AS hour_instance,
    COUNT(*) OVER (PARTITION BY load_date, hour_ending) AS records_at_hour_label
  FROM {p}_rows),
{p}_silver AS (
  SELECT source_stage, load_date, hour_ending, hour_instance, records_at_hour_label,
    CAST(load_date AS TIMESTAMP) + to_hours(hour_ending - 1) AS local_timestamp_label,
    pge_mw, sce_mw, sdge_mw, vea_mw, caiso_mw,
    pge_mw + sce_mw + sdge_mw + vea_mw AS regional_total_mw,
    caiso_mw - (pge_mw + sce_mw + sdge_mw + vea_mw) AS caiso_minus_regional_mw,
    source_file
  FROM {p}_numbered),
{p}_placed AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY load_date, hour_ending, hour_instance) - 1 AS row_ix,
    COUNT(*) OVER (PARTITION BY load_date) AS hours_in_load_date
  FROM {p}_silver),
{p}_gold AS (
  SELECT source_stage, load_date, hour_ending, hour_instance, local_timestamp_label,
    CAST(YEAR(load_date) AS INT) AS load_year, CAST(MONTH(load_date) AS INT) AS load_month,
    CAST(ISODOW(load_date) AS INT) AS weekday_number,
    CASE WHEN ISODOW(load_date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
    pge_mw, sce_mw, sdge_mw, vea_mw, caiso_mw, regional_total_mw, caiso_minus_regional_mw,
    LAG(caiso_mw, 24) OVER (ORDER BY row_ix) AS caiso_lag_24_mw,
    LAG(caiso_mw, 168) OVER (ORDER BY row_ix) AS caiso_lag_168_mw,
    hours_in_load_date
  FROM {p}_placed),
{p}_daily AS (
  SELECT source_stage, load_date, COUNT(*) AS hours_in_day,
    CAST(SUM(caiso_mw) AS DOUBLE) / COUNT(caiso_mw) AS average_load_mw,
    MAX(caiso_mw) AS peak_load_mw, MIN(caiso_mw) AS minimum_load_mw
  FROM {p}_gold GROUP BY 1, 2),
{p}_tou AS (
  SELECT source_stage, load_year, load_month,
    CASE WHEN hour_ending BETWEEN 17 AND 21 THEN 'On-Peak'
         WHEN is_weekend = 1 AND hour_ending <= 14 THEN 'Super Off-Peak'
         WHEN is_weekend = 0 AND (hour_ending <= 6 OR hour_ending BETWEEN 11 AND 14) THEN 'Super Off-Peak'
         ELSE 'Off-Peak' END AS tou_period,
    COUNT(*) AS hourly_observations,
    CAST(SUM(CAST(caiso_mw AS DECIMAL(18,3))) AS DECIMAL(28,3)) AS system_load_mwh_proxy
  FROM {p}_gold GROUP BY 1, 2, 3, 4)"""

_LOST = "NOT (d = DATE '2024-01-10' AND he = 2)"

HOURLY = f"""
h_base AS (
  SELECT CAST(ts AS DATE) AS d, CAST(EXTRACT(HOUR FROM ts) AS INT) + 1 AS he,
    COALESCE(SUM(CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(12,3)) END), 0) AS pge,
    COALESCE(SUM(CASE WHEN event_type = 'view' THEN CAST(value AS DECIMAL(12,3)) END), 0) AS sce,
    COALESCE(SUM(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(12,3)) END), 0) AS sdge,
    COALESCE(SUM(CASE WHEN event_type = 'signup' THEN CAST(value AS DECIMAL(12,3)) END), 0) AS vea,
    SUM(CAST(value AS DECIMAL(12,3))) AS caiso
  FROM events GROUP BY 1, 2),
h_hours AS (
  SELECT * FROM h_base WHERE {_LOST}
  UNION ALL
  SELECT d, he, pge + 1, sce, sdge, vea, caiso + 1 FROM h_base WHERE d = DATE '2024-01-17' AND he = 1),
h_clean AS (
  SELECT CASE WHEN d < DATE '2024-01-24' THEN 'historical' ELSE 'validation' END AS source_stage,
    CAST(d AS VARCHAR) AS "Date", CAST(he AS VARCHAR) AS "HR",
    {", ".join(f'CAST(CAST({n} AS DECIMAL(12,3)) AS VARCHAR) AS "{n.upper()}"' for n in LOADS)},
    'events.parquet' AS source_file
  FROM h_hours),
h_raw AS (
  SELECT * FROM h_clean
  UNION ALL SELECT 'historical', v.* FROM (VALUES
    ('CAISO Public', NULL, NULL, NULL, NULL, NULL, NULL, 'events.parquet'),
    (' CAISO Public ', NULL, NULL, NULL, NULL, NULL, NULL, 'events.parquet'),
    ('  ', NULL, NULL, NULL, NULL, NULL, NULL, 'events.parquet'),
    (NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'events.parquet'),
    ('2024-01-05', 'x', '1', '1', '1', '1', '4', 'events.parquet'),
    ('2024-01-05', '0', '1', '1', '1', '1', '4', 'events.parquet'),
    ('2024-01-05', '25', '1', '1', '1', '1', '4', 'events.parquet'),
    ('2024-01-05', '3', 'n/a', '1', '1', '1', '4', 'events.parquet'),
    ('no date', '3', '1', '1', '1', '1', '4', 'events.parquet')) AS v),
h_kept AS (
  SELECT * FROM h_raw
  WHERE NULLIF(TRIM("Date"), '') IS NOT NULL AND TRIM("Date") <> 'CAISO Public'),
h_typed AS (
  SELECT source_stage, TRY_CAST("Date" AS DATE) AS load_date, TRY_CAST("HR" AS INT) AS hour_ending,
    {", ".join(f'TRY_CAST("{n.upper()}" AS DECIMAL(12,3)) AS {n}_mw' for n in LOADS)}, source_file
  FROM h_kept),
h_rows AS (
  SELECT * FROM h_typed
  WHERE load_date IS NOT NULL AND hour_ending BETWEEN 1 AND 24
    AND {" AND ".join(f"{n}_mw IS NOT NULL" for n in LOADS)}),{_SILVER.format(p="h")},
h_weather_raw AS (
  SELECT CASE WHEN d < DATE '2024-01-24' THEN 'historical' ELSE 'validation' END AS source_stage,
    CAST(CAST(d AS TIMESTAMP) + to_hours(h) AS VARCHAR) AS "timestamp",
    {", ".join(f"CAST(CAST(40 + (s * {i}) % 60 AS DECIMAL(5,1)) AS VARCHAR) AS temp_{c}" for i, c in enumerate(CITIES, 1))}
  FROM (SELECT CAST(ts AS DATE) AS d, CAST(EXTRACT(HOUR FROM ts) AS INT) AS h,
          SUM(CAST(value AS DECIMAL(12,3))) AS s
        FROM events WHERE event_type = 'error' GROUP BY 1, 2)),
h_weather AS (
  SELECT source_stage, TRY_CAST("timestamp" AS TIMESTAMP) AS weather_timestamp_label,
    CAST(TRY_CAST("timestamp" AS TIMESTAMP) AS DATE) AS weather_date,
    CAST(EXTRACT(HOUR FROM TRY_CAST("timestamp" AS TIMESTAMP)) AS INT) + 1 AS hour_ending,
    {", ".join(f"TRY_CAST(temp_{c} AS DECIMAL(5,1)) AS temp_{c}_f" for c in CITIES)}
  FROM h_weather_raw),
h_load_weather AS (
  SELECT l.*, {", ".join(f"w.temp_{c}_f" for c in CITIES)},
    CASE WHEN l.hours_in_load_date <> 24 THEN 'not joined: DST transition'
         WHEN w.weather_timestamp_label IS NULL THEN 'missing weather'
         ELSE 'matched' END AS weather_match_status
  FROM h_gold l LEFT JOIN h_weather w
    ON l.source_stage = w.source_stage AND l.local_timestamp_label = w.weather_timestamp_label
   AND l.hours_in_load_date = 24)"""

READINGS = f"""
r_parts AS (
  SELECT CASE WHEN l_shipdate < DATE '2001-01-01' THEN 'historical' ELSE 'validation' END AS source_stage,
    CAST(l_shipdate AS DATE) AS load_date, CAST(l_orderkey % 24 AS INT) + 1 AS hour_ending,
    CAST(l_quantity AS DECIMAL(12,3)) AS pge_mw, CAST(l_partkey % 1000 AS DECIMAL(12,3)) AS sce_mw,
    CAST(l_suppkey % 100 AS DECIMAL(12,3)) AS sdge_mw, CAST(l_linenumber AS DECIMAL(12,3)) AS vea_mw,
    CAST(l_discount AS DECIMAL(12,3)) AS rest, 'export_' || l_returnflag || '.csv' AS source_file
  FROM lineitem),
r_rows AS (
  SELECT source_stage, load_date, hour_ending, pge_mw, sce_mw, sdge_mw, vea_mw,
    CAST(pge_mw + sce_mw + sdge_mw + vea_mw + rest AS DECIMAL(12,3)) AS caiso_mw, source_file
  FROM r_parts),
r_raw AS (
  SELECT source_stage, CAST(load_date AS VARCHAR) AS "Date", CAST(hour_ending AS VARCHAR) AS "HR",
    {", ".join(f'CAST({n}_mw AS VARCHAR) AS "{n.upper()}"' for n in LOADS)}, source_file
  FROM r_rows),{_SILVER.format(p="r")},
r_weather AS (
  SELECT CAST(d AS TIMESTAMP) + to_hours(h) AS "timestamp",
    {", ".join(f"CAST((400 + (s * {i} + h * {2 * i + 1}) % 600) * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(5,1)) AS temp_{c}_f" for i, c in enumerate(CITIES, 1))}
  FROM (SELECT CAST(o_orderdate AS DATE) AS d, CAST(SUM(o_custkey) AS BIGINT) AS s FROM orders GROUP BY 1)
  CROSS JOIN (SELECT CAST(range AS INT) AS h FROM range(24))),
r_naive AS (
  SELECT *, LAG(caiso_mw, 24) OVER (ORDER BY row_ix) AS forecast_24,
    LAG(caiso_mw, 168) OVER (ORDER BY row_ix) AS forecast_168
  FROM r_placed),
r_test AS (SELECT * FROM r_naive WHERE YEAR(load_date) = 2000),
r_errors AS (
  SELECT *, caiso_mw - forecast_24 AS error, ABS(caiso_mw - forecast_24) AS abs_error,
    CAST(ABS(caiso_mw - forecast_24) AS DOUBLE) / CAST(caiso_mw AS DOUBLE) * 100 AS ape
  FROM r_test)"""


def hourly(body: str) -> str:
    return f"WITH {HOURLY}\n{body}"


def readings(body: str) -> str:
    return f"WITH {READINGS}\n{body}"


def mean(column: str) -> str:
    return f"CAST(SUM({column}) AS DOUBLE) / COUNT({column})"


def score(actual: str, forecast: str) -> str:
    """MAE, RMSE and MAPE of decimal columns."""
    error = f"({actual} - {forecast})"
    return f"""ROUND({mean(f"ABS({error})")}, 8) AS mae,
      ROUND(SQRT({mean(f"{error} * {error}")}), 8) AS rmse,
      ROUND({mean(f"CAST(ABS({error}) AS DOUBLE) / CAST({actual} AS DOUBLE) * 100")}, 8) AS mape"""
