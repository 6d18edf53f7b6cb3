"""Lag correlation, autocorrelation and stationarity tests of one long series.

A series is cut into spans of consecutive positions, each preceded by as many earlier values as the
largest lag. A task sees one span at a time (a fixed number of rows) and returns sums; Spark adds
the sums. Only the added vector (one number per lag) or a few matrices (lags by lags) reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourgrid.fixed import SERIES_SPAN
from hourgrid.functions.scores import mean_of
from hourgrid.operators.order import add_lags, with_halo
from hourgrid.sources.scratch import store

# Fixed values of the published tests.
NORMAL_975 = 1.959963984540054
KPSS_CRITICAL = [0.347, 0.463, 0.574, 0.739]
KPSS_P = [0.10, 0.05, 0.025, 0.01]
ADF_STEP = -1.61
ADF_CERTAIN = -18.83
ADF_HOPELESS = 2.74
ADF_LEFT = [2.1659, 1.4412, 0.038269]
ADF_RIGHT = [1.7339, 0.93202, -0.12745, -0.010368]

# From so many lags on a span's products come from a transform.
TRANSFORM_FROM = 32
# Lag products taken before the bandwidth is known; most bandwidths lie below.
KPSS_FIRST_PASS = 200
SPAN_BLOCK = 4_096
# Tasks in which matrices meet; a column of which less than this share is its own counts as dependent.
ADDERS = 16
DEPENDENT = 1e-12


def lag_correlations(df: DataFrame, value: str, lags: Sequence[int] = (1, 24, 48, 168)) -> DataFrame:
    """Pearson correlation of the series with itself ``lag`` rows earlier, over complete pairs."""
    lagged = add_lags(df, {f"_lag_{k}": (value, k) for k in lags})
    x = F.col(value).cast("double")
    pairs = [
        F.struct(F.lit(k).alias("lag"), F.round(F.corr(x, F.col(f"_lag_{k}").cast("double")), 8).alias("correlation"))
        for k in lags
    ]
    return lagged.agg(F.array(*pairs).alias("_pairs")).select(F.inline("_pairs"))


@dataclass
class SeriesSums:
    """What one pass over the spans yields."""

    rows: int
    products: np.ndarray
    spans: DataFrame


@dataclass
class Series:
    """Position and value, stored, because every diagnostic reads them more than once."""

    rows: DataFrame
    length: int
    mean: float

    @staticmethod
    def of(df: DataFrame, value: str, position: str) -> Series:
        pairs = store(df.select(F.col(position).alias("ix"), F.col(value).alias("x")), "series")
        length, mean = pairs.agg(F.count("x"), mean_of(F.col("x"))).first()
        return Series(pairs, int(length), mean)

    def spans(self, reach: int, span: int) -> DataFrame:
        return with_halo(self.rows.withColumn("x", F.col("x").cast("double")), reach, span, "ix")


def _lag_products(e: np.ndarray, own: int, max_lag: int) -> np.ndarray:
    """Sums of e[t] e[t - k] over t from ``own`` on, for k up to ``max_lag``: few by themselves, many by one transform.

    The values before ``own`` are the span's overlap with the one before. Padding by the largest lag keeps the ends
    of the circular product apart, so its cost no longer is rows times lags.
    """
    if max_lag < TRANSFORM_FROM:
        starts = [max(own, k) for k in range(max_lag + 1)]
        return np.array([float(e[s:] @ e[s - k : max(len(e) - k, s - k)]) for k, s in enumerate(starts)])
    size = 1 << int(len(e) + max_lag).bit_length()
    home = np.where(np.arange(len(e)) < own, 0.0, e)
    spectrum = np.fft.rfft(home, size) * np.conj(np.fft.rfft(e, size))
    return np.fft.irfft(spectrum, size)[: max_lag + 1]


def series_sums(series: Series, max_lag: int, span: int = SERIES_SPAN) -> SeriesSums:
    """Lag products of the centred series, and what ``squared_path`` needs of every span."""
    mean = series.mean
    span = max(span, 4 * max_lag)

    def sums_of_span(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ix")
        e = part["x"].to_numpy() - mean
        own = int((part["ix"].to_numpy() < key[0] * span).sum())
        home = e[own:]
        path = np.cumsum(home)
        products = _lag_products(e, own, max_lag).tolist()
        return pd.DataFrame(
            {
                "span": [key[0]],
                "n": [len(home)],
                "total": [float(home.sum())],
                "path": [float(path.sum())],
                "path_sq": [float(path @ path)],
                "products": [products],
            }
        )

    schema = "span long, n long, total double, path double, path_sq double, products array<double>"
    spans = series.spans(max_lag, span).groupBy("_span")
    parts = store(spans.applyInPandas(sums_of_span, schema).where("n > 0"), "span_sums")
    places = parts.select(F.posexplode("products").alias("lag", "v"))
    added = places.groupBy("lag").agg(F.sum("v").alias("v")).orderBy("lag").collect()
    return SeriesSums(series.length, np.array([row["v"] for row in added]), parts)


def squared_path(sums: SeriesSums) -> float:
    """Sum of squares of the running sum of the centred series.

    With ``o`` the total before a span, the running sums inside are ``o + c``, so a span needs only
    its row count, total, sum of ``c`` and sum of ``c`` squared. ``o`` is added up in two steps, over
    blocks of spans and inside a block, so no task sees more than one row per block.
    """
    spans = sums.spans.select("span", "n", "total", "path", "path_sq", F.floor(F.col("span") / SPAN_BLOCK).alias("block"))
    earlier_blocks = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = spans.groupBy("block").agg(F.sum("total").alias("block_total"))
    blocks = blocks.select("block", F.coalesce(F.sum("block_total").over(earlier_blocks), F.lit(0.0)).alias("before_block"))
    earlier = W.partitionBy("block").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("before_block") + F.coalesce(F.sum("total").over(earlier), F.lit(0.0))
    placed = spans.join(blocks, "block").withColumn("o", before)
    squares = F.col("n") * F.col("o") * F.col("o") + 2 * F.col("o") * F.col("path") + F.col("path_sq")
    return float(placed.agg(F.sum(squares)).first()[0])


def acf(df: DataFrame, value: str, max_lag: int = 200, position: str = "row_ix") -> DataFrame:
    """Autocorrelation by lag with Bartlett's 95 % band, one row per lag.

    Products use the mean of the whole series and are divided by its whole sum of squares.
    """
    sums = series_sums(Series.of(df, value, position), max_lag)
    table = [(k, float(r)) for k, r in enumerate(sums.products / sums.products[0])]
    by_lag = df.sparkSession.createDataFrame(table, "lag int, r double")
    earlier = W.orderBy("lag").rowsBetween(W.unboundedPreceding, -1)
    counted = F.when(F.col("lag") > 0, F.col("r") * F.col("r")).otherwise(0.0)
    spread = 1 + 2 * F.coalesce(F.sum(counted).over(earlier), F.lit(0.0))
    band = F.when(F.col("lag") == 0, 0.0).otherwise(NORMAL_975 * F.sqrt(spread / sums.rows))
    return by_lag.select("lag", F.round("r", 8).alias("autocorrelation"), F.round(band, 8).alias("band"))


def partial_autocorrelations(r: Sequence[float]) -> list[float]:
    """Durbin-Levinson on autocorrelations r[0..m]; m is a few dozen."""
    found, phi = [1.0], np.zeros(0)
    for k in range(1, len(r)):
        known = np.asarray(r[1:k])
        last = (r[k] - phi @ known[::-1]) / (1 - phi @ known)
        phi = np.append(phi - last * phi[::-1], last)
        found.append(float(last))
    return found


def pacf(df: DataFrame, value: str, max_lag: int = 60, position: str = "row_ix") -> DataFrame:
    """Partial autocorrelation by lag (Yule-Walker without adjustment)."""
    products = series_sums(Series.of(df, value, position), max_lag).products
    found = partial_autocorrelations(products / products[0])
    rows = [(k, round(v, 8)) for k, v in enumerate(found)]
    return df.sparkSession.createDataFrame(rows, "lag int, partial_autocorrelation double")


def kpss_lags(rows: int, products: np.ndarray) -> int:
    """Automatic bandwidth of Hobijn, Franses and Ooms."""
    m = int(rows ** (2 / 9))
    p = 2 * products[1 : m + 1] / rows
    s0 = products[0] / rows + p.sum()
    s1 = float(np.arange(1, m + 1) @ p)
    gamma = 1.1447 * ((s1 / s0) ** 2) ** (1 / 3)
    return min(int(gamma * rows ** (1 / 3)), rows - 1)


def kpss_test(df: DataFrame, value: str, lags: int | None = None, position: str = "row_ix") -> DataFrame:
    """Stationarity around a level: statistic, p-value (clipped to the table), bandwidth."""
    series = Series.of(df, value, position)
    rows = series.length
    sums = series_sums(series, lags if lags is not None else max(KPSS_FIRST_PASS, int(rows ** (2 / 9))))
    if lags is None:
        lags = kpss_lags(rows, sums.products)
        if lags >= len(sums.products):
            sums = series_sums(series, lags)
    weights = 1 - np.arange(1, lags + 1) / (lags + 1)
    variance = (sums.products[0] + 2 * float(weights @ sums.products[1 : lags + 1])) / rows
    statistic = squared_path(sums) / rows**2 / variance
    p = float(np.interp(statistic, KPSS_CRITICAL, KPSS_P))
    result = [(round(float(statistic), 8), round(p, 8), int(lags))]
    return df.sparkSession.createDataFrame(result, "statistic double, p_value double, lags int")


def adf_p_value(statistic: float) -> float:
    """Response surface of the constant-only case."""
    if statistic > ADF_HOPELESS:
        return 1.0
    if statistic < ADF_CERTAIN:
        return 0.0
    powers = ADF_LEFT if statistic <= ADF_STEP else ADF_RIGHT
    z = sum(c * statistic**i for i, c in enumerate(powers))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _added_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row from all rows of a task: their sum."""
    rows, total = 0, None
    for batch in batches:
        for n, gram in zip(batch.column("n").to_pylist(), batch.column("gram")):
            rows += n
            own = np.asarray(gram.values)
            total = own.copy() if total is None else total + own
    if total is not None:
        grams = pa.array([total], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), grams], names=["n", "gram"])


def _design(x: np.ndarray, first: int, lags: int) -> np.ndarray:
    """Rows from ``first`` on of (1, level before, ``lags`` earlier differences, difference)."""
    steps = np.diff(x)
    earlier = [steps[first - 1 - k : len(steps) - k] for k in range(1, lags + 1)]
    return np.column_stack([np.ones(len(x) - first), x[first - 1 : -1], *earlier, steps[first - 1 :]])


def _difference_gram(series: Series, lags: int, span: int = SERIES_SPAN) -> tuple[int, np.ndarray]:
    """Rows, and the products of (1, level before, ``lags`` earlier differences, difference).

    The rows are those with all ``lags`` differences; the level is centred, which leaves its
    coefficient as it is and keeps the products well scaled. A task adds up the upper triangles of its spans;
    the tasks' sums meet in ADDERS tasks, of which the driver gets a triangle each.
    """
    mean = series.mean
    reach = lags + 1
    span = max(span, 4 * reach)
    width = lags + 3
    upper = np.triu_indices(width)

    def gram_of_span(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ix")
        x = part["x"].to_numpy() - mean
        own = int((part["ix"].to_numpy() < key[0] * span).sum())
        first = max(own, reach)
        if len(x) <= first:
            return pd.DataFrame({"n": [0], "gram": [np.zeros(len(upper[0]))]})
        design = _design(x, first, lags)
        return pd.DataFrame({"n": [len(design)], "gram": [(design.T @ design)[upper]]})

    schema = "n long, gram array<double>"
    grams = series.spans(reach, span).groupBy("_span").applyInPandas(gram_of_span, schema).mapInArrow(_added_grams, schema)
    parts = grams.repartition(ADDERS).mapInArrow(_added_grams, schema).collect()
    gram = np.zeros((width, width))
    gram[upper] = np.sum([part["gram"] for part in parts], axis=0) if parts else 0.0
    return sum(part["n"] for part in parts), gram + np.triu(gram, 1).T


def _factor(gram: np.ndarray) -> np.ndarray:
    """The upper triangular root of a matrix of products. Row k holds what column k adds to those before it, so the squares that the
    first p columns leave of the last one are what its entries from row p on add up to: one factor serves every p. A
    column that depends on those before it has a row of zeros.
    """
    scale = np.sqrt(np.diag(gram))
    scale[scale == 0] = 1.0
    rest, root = gram / np.outer(scale, scale), np.zeros_like(gram)
    for k in range(len(gram)):
        if rest[k, k] > DEPENDENT:
            root[k, k:] = rest[k, k:] / math.sqrt(rest[k, k])
            rest = rest - np.outer(root[k], root[k])
    return root * scale


def _with_first_rows(series: Series, gram: np.ndarray, lags: int, fewer: int) -> tuple[int, np.ndarray]:
    """How many more rows have ``fewer`` differences, all at the start of the series, and the products with them."""
    kept = [0, 1, *range(2, fewer + 2), lags + 2]
    smaller = gram[np.ix_(kept, kept)]
    start = series.rows.orderBy("ix").limit(lags + 1).collect()
    x = np.array([float(row["x"]) for row in start]) - series.mean
    if fewer == lags or len(x) <= fewer + 1:
        return 0, smaller
    design = _design(x, fewer + 1, fewer)
    return len(design), smaller + design.T @ design


def adf_test(df: DataFrame, value: str, max_lag: int | None = None, position: str = "row_ix") -> DataFrame:
    """Augmented Dickey-Fuller with a constant, lag order by AIC: statistic, p-value, lags, rows.

    One matrix of products and one factor of it serve all lag orders; the chosen order is refitted on all the
    rows it can use, which are those of the matrix and the first ones of the series.
    """
    series = Series.of(df, value, position)
    if max_lag is None:
        max_lag = min(math.ceil(12 * (series.length / 100) ** 0.25), series.length // 2 - 2)
    used, gram = _difference_gram(series, max_lag)
    squares = _factor(gram)[:, -1] ** 2
    left = np.maximum(np.cumsum(squares[::-1])[::-1], np.finfo(float).tiny)

    def criterion(lags: int) -> float:
        return used * (math.log(2 * math.pi * left[lags + 2] / used) + 1) + 2 * (lags + 2)

    best = min(range(max_lag + 1), key=criterion)
    more, gram = _with_first_rows(series, gram, max_lag, best)
    used += more
    # With the level last, its row alone says what it adds.
    order = [0, *range(2, best + 2), 1, best + 2]
    root = _factor(gram[np.ix_(order, order)])
    statistic = root[-2, -1] / math.sqrt(root[-1, -1] ** 2 / (used - best - 2))
    result = [(round(float(statistic), 6), round(adf_p_value(statistic), 6), best, used)]
    return df.sparkSession.createDataFrame(result, "statistic double, p_value double, lags int, used_rows long")
