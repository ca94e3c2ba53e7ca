import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spark_rca.functions import numeric as nm


def test_f_tail_closed_forms():
    # With 2 degrees of freedom above: (1 + 2 f / d2) ** (-d2 / 2); with (1, 1): arctangent.
    f = np.array([0.5, 1.0, 4.0, 20.0])
    for d2 in (3, 10, 55):
        assert np.allclose(nm.f_tail(f, np.full(4, 2), np.full(4, d2)), (1 + 2 * f / d2) ** (-d2 / 2), atol=1e-12)
    assert np.allclose(nm.f_tail(f, np.ones(4), np.ones(4)), 1 - 2 / math.pi * np.arctan(np.sqrt(f)), atol=1e-10)


def test_granger_prefix_grams_equal_least_squares():
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    y = np.zeros(300)
    for t in range(2, 300):
        y[t] = 0.8 * x[t - 2] + 0.3 * rng.normal()
    lag, s, e = 3, np.array([0, 40, 100]), np.array([300, 160, 280])
    p = nm.granger_p(nm.lag_rows(y, x, lag), s, e, lag)
    for k in range(3):
        rows = nm.lag_rows(y[s[k] : e[k]], x[s[k] : e[k]], lag)

        def ssr(cols):
            b = np.linalg.lstsq(rows[:, cols], rows[:, 0], rcond=None)[0]
            return ((rows[:, 0] - rows[:, cols] @ b) ** 2).sum()

        own, full = [1, 2, 3, 7], list(range(1, 8))
        df = len(rows) - 7
        f = (ssr(own) - ssr(full)) / ssr(full) / lag * df
        assert p[k] == pytest.approx(nm.f_tail(np.array([f]), lag, df)[0], abs=1e-9)
    assert np.isnan(nm.granger_p(nm.lag_rows(y, x, lag), np.array([0]), np.array([3 * lag + 1]), lag))[0]


def test_adf_separates_walks_from_noise():
    rng = np.random.default_rng(1)
    noise = rng.normal(size=400)
    assert nm.adf_p(noise) < 0.01
    assert nm.adf_p(np.cumsum(noise)) > 0.05
    assert math.isnan(nm.adf_p(np.ones(50)))


def test_spline_passes_through_its_points():
    t = np.array([0, 1, 3, 6, 8, 9.0])
    v = np.sin(t)
    for d in (2, 3):
        assert np.allclose(nm.spline(t, v, t, d), v, atol=1e-9)
    assert np.allclose(nm.spline(t, t**3, np.array([2.0, 4.5]), 3), [8, 91.125])


def test_gpd_recovers_parameters():
    rng = np.random.default_rng(2)
    u = rng.random(4000)
    g, s = 0.25, 1.5
    y = s / g * (u**-g - 1)
    gamma, sigma = nm.gpd_fit(y)
    assert abs(gamma - g) < 0.08 and abs(sigma - s) < 0.15
    gamma, sigma = nm.gpd_fit(rng.exponential(2.0, 4000))
    assert abs(gamma) < 0.08 and abs(sigma - 2) < 0.2


def test_partial_correlation_removes_a_common_cause():
    rng = np.random.default_rng(3)
    z = rng.normal(size=5000)
    c = np.corrcoef([z + 0.3 * rng.normal(size=5000), z + 0.3 * rng.normal(size=5000), z])
    assert c[0, 1] > 0.8 and abs(nm.partial_corr(c, 0, 1, [2])) < 0.05


@settings(max_examples=30, deadline=None)
@given(st.floats(0.5, 40), st.floats(0.5, 40), st.floats(0.001, 0.999))
def test_beta_inc_is_a_distribution(a, b, x):
    v = float(nm.beta_inc(a, b, x))
    assert 0 <= v <= 1 and abs(v + float(nm.beta_inc(b, a, 1 - x)) - 1) < 1e-9
