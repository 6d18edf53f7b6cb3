from __future__ import annotations

import numpy as np
import pytest

from hourgrid.operators import diagnostics as D


def frame(spark, x):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "row_ix long, x double").repartition(3)


def autoregressive(n=3000, phi=0.7):
    noise = np.random.default_rng(11).normal(size=n)
    x = np.zeros(n)
    for t in range(1, n):
        x[t] = phi * x[t - 1] + noise[t]
    return x + 50


def correlations(x, lags):
    e = x - x.mean()
    return np.array([e[k:] @ e[: len(e) - k] for k in range(lags + 1)]) / (e @ e)


@pytest.mark.parametrize("span", [1, 500, 65536])
def test_spans_add_up_to_the_whole_series(spark, span, monkeypatch):
    monkeypatch.setattr(D, "SPAN_BLOCK", 3)
    x = autoregressive()
    series = D.Series.of(frame(spark, x), "x", "row_ix")
    sums = D.series_sums(series, 30, span)
    e = x - x.mean()
    assert np.allclose(sums.products / sums.products[0], correlations(x, 30))
    assert D.squared_path(sums) == pytest.approx(np.sum(np.cumsum(e) ** 2))


def test_short_series_with_long_lags(spark):
    x = np.array([1.0, 4.0, 2.0, 8.0, 5.0])
    series = D.Series.of(frame(spark, x), "x", "row_ix")
    sums = D.series_sums(series, 7, 2)
    assert np.allclose(sums.products[:5] / sums.products[0], correlations(x, 4))
    assert np.allclose(sums.products[5:], 0)


def test_acf_band_starts_at_white_noise(spark):
    x = autoregressive(1000)
    rows = D.acf(frame(spark, x), "x", 5).orderBy("lag").collect()
    r = correlations(x, 5)
    assert rows[0].autocorrelation == 1.0 and rows[0].band == 0.0
    assert rows[1].band == pytest.approx(1.959964 / np.sqrt(1000), rel=1e-5)
    assert rows[3].band == pytest.approx(1.959964 * np.sqrt((1 + 2 * (r[1] ** 2 + r[2] ** 2)) / 1000), rel=1e-5)


def test_pacf_of_an_autoregression(spark):
    x = autoregressive()
    found = [r[1] for r in D.pacf(frame(spark, x), "x", 10).orderBy("lag").collect()]
    assert found[1] == pytest.approx(0.7, abs=0.05) and max(map(abs, found[2:])) < 0.06
    r = correlations(x, 10)
    toeplitz = np.array([[r[abs(i - j)] for j in range(4)] for i in range(4)])
    assert found[4] == pytest.approx(np.linalg.solve(toeplitz, r[1:5])[-1], abs=1e-7)


def direct_adf(x, lags, start):
    """Regression of the differences from row ``start`` on, by least squares."""
    d = np.diff(x)
    rows = range(start, len(d))
    design = np.array([[1.0, x[t], *[d[t - k] for k in range(1, lags + 1)]] for t in rows])
    y = d[start:]
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    left = y - design @ beta
    s2 = left @ left / (len(y) - design.shape[1])
    error = np.sqrt(s2 * np.linalg.inv(design.T @ design)[1, 1])
    aic = len(y) * (np.log(2 * np.pi * (left @ left) / len(y)) + 1) + 2 * design.shape[1]
    return beta[1] / error, aic


def test_adf_matches_least_squares(spark):
    x = autoregressive(400, 0.9)
    found = D.adf_test(frame(spark, x), "x", max_lag=6).first()
    best = min(range(7), key=lambda k: direct_adf(x, k, 6)[1])
    assert found.lags == best and found.used_rows == len(x) - 1 - best
    assert found.statistic == pytest.approx(direct_adf(x, best, best)[0], abs=1e-5)


def test_stationary_and_wandering_series_are_told_apart(spark):
    steady, wandering = autoregressive(), np.cumsum(np.random.default_rng(3).normal(size=3000))
    assert D.adf_test(frame(spark, steady), "x").first().p_value < 0.01
    assert D.adf_test(frame(spark, wandering), "x").first().p_value > 0.1
    assert D.kpss_test(frame(spark, steady), "x").first().p_value > 0.05
    assert D.kpss_test(frame(spark, wandering), "x").first().p_value == 0.01


def test_kpss_by_hand(spark):
    x = autoregressive(500)
    e, lags = x - x.mean(), 4
    variance = (e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))) / len(e)
    expected = np.sum(np.cumsum(e) ** 2) / len(e) ** 2 / variance
    assert D.kpss_test(frame(spark, x), "x", lags).first().statistic == pytest.approx(expected, abs=1e-7)


@pytest.mark.parametrize("tau,p", [(-3.43, 0.010), (-2.86, 0.050), (-2.57, 0.099), (-20, 0.0), (3, 1.0)])
def test_adf_critical_values(tau, p):
    assert D.adf_p_value(tau) == pytest.approx(p, abs=0.0006)


def test_lag_correlation(spark):
    x = autoregressive()
    rows = {r["lag"]: r.correlation for r in D.lag_correlations(frame(spark, x), "x", [1, 24]).collect()}
    for k, r in rows.items():
        assert r == pytest.approx(np.corrcoef(x[k:], x[:-k])[0, 1], abs=1e-7)


@pytest.mark.parametrize("own, lags", [(0, 40), (70, 64), (300, 300), (5, 200)])
def test_transformed_lag_products_equal_direct_ones(monkeypatch, own, lags):
    e = np.random.default_rng(own).normal(0, 100, 900)
    quick = D._lag_products(e, own, lags)
    monkeypatch.setattr(D, "TRANSFORM_FROM", 10_000)
    direct = D._lag_products(e, own, lags)
    assert np.abs(quick - direct).max() <= 1e-9 * direct[0]
    expected = [sum(e[t] * e[t - k] for t in range(max(own, k), 900)) for k in range(lags + 1)]
    assert direct == pytest.approx(expected, rel=1e-9, abs=1e-6)
