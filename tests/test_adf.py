"""Stationarity tests of stacked intervals against one regression at a time, and against published values."""

import numpy as np
import pytest

from spark_rca.functions.numeric import adf_p, adf_stack, adf_tail


def series(rng, kind, n):
    e = rng.normal(size=n)
    if kind == "walk":
        return np.cumsum(e)
    if kind == "noise":
        return 100 + 5 * e
    if kind == "level":  # one that is far from 0 and moves little
        return 1e6 + np.cumsum(e) * 1e-2
    x = np.zeros(n)
    for t in range(1, n):
        x[t] = (0.7 if kind == "ar" else 1.0) * x[t - 1] + e[t] + (0.4 * e[t - 1] if kind == "arima" else 0)
    return x


@pytest.mark.parametrize("lag", [0, 3, None])
def test_stack_equals_single_fits(lag):
    """500 intervals of five kinds of series."""
    rng = np.random.default_rng(17)
    for kind in ("walk", "noise", "level", "ar", "arima"):
        x = series(rng, kind, 400)
        s = rng.integers(0, 340, size=100)
        e = np.minimum(s + rng.integers(3, 200, size=100), 400)
        want = np.array([adf_p(x[a:b], lag) for a, b in zip(s, e)])
        assert np.allclose(adf_stack(x, s, e, lag), want, rtol=0, atol=1e-9, equal_nan=True), kind


def test_stretches_without_movement():
    x = np.concatenate([np.full(50, 3.0), np.random.default_rng(1).normal(size=50)])
    s, e = np.array([0, 10, 0, 50, 49]), np.array([50, 40, 100, 100, 51])
    want = [adf_p(x[a:b], 2) for a, b in zip(s, e)]
    assert np.allclose(adf_stack(x, s, e, 2), want, atol=1e-9, equal_nan=True) and np.isnan(want[0])
    assert np.isnan(adf_stack(np.ones(30), np.array([0]), np.array([30]))[0])
    period = np.tile([1.0, 2.0, 4.0], 40)  # regressors that depend on each other
    assert np.allclose(adf_stack(period, np.array([0, 3]), np.array([120, 90]), 4), [adf_p(period, 4), adf_p(period[3:90], 4)], atol=1e-9, equal_nan=True)


@pytest.mark.parametrize(("tau", "p"), [(-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)])
def test_published_critical_values(tau, p):
    """Asymptotic critical values of the test with a constant."""
    assert adf_tail(tau) == pytest.approx(p, abs=0.002)


def test_statistic_by_textbook_regression():
    """Without lags the statistic is a slope over its standard error."""
    x = series(np.random.default_rng(5), "ar", 120)
    y, a = np.diff(x), np.column_stack([x[:-1], np.ones(119)])
    beta, ssr, *_ = np.linalg.lstsq(a, y, rcond=None)
    tau = beta[0] / np.sqrt(ssr[0] / 117 * np.linalg.inv(a.T @ a)[0, 0])
    assert adf_stack(x, np.array([0]), np.array([120]), 0)[0] == pytest.approx(adf_tail(tau), abs=1e-10)
