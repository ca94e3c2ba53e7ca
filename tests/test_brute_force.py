"""Splines, verdicts and alarm levels against plain forms that share no code with them."""

import math
from itertools import combinations

import numpy as np
import pytest

from spark_rca.functions import numeric as nm
from spark_rca.operators.causality import granger_verdict
from spark_rca.operators.spline import fill_spline
from spark_rca.streaming.spot import run_spot

METRIC = "incident_id string, service_id int, t long, value double"


def frame(spark, *series):
    return spark.createDataFrame([("m", s, t, float(v)) for s, vs in enumerate(series, 1) for t, v in enumerate(vs)], METRIC)


def pieces(t, v, at, degree):
    """The spline as polynomials between breaks: values at the points, equal derivatives at the breaks."""
    breaks = [t[0], *(t[2:-2] if degree == 3 else (t[1:-2] + t[2:-1]) / 2), t[-1]]
    k, rows, right = degree + 1, [], []
    piece = lambda x: min(int(np.searchsorted(breaks[1:-1], x, "right")), len(breaks) - 2)

    def row(p, x, order):
        out = np.zeros(k * (len(breaks) - 1))
        for d in range(order, k):
            out[p * k + d] = math.perm(d, order) * (x - breaks[p]) ** (d - order)
        return out

    for x, y in zip(t, v):
        rows.append(row(piece(x), x, 0))
        right.append(y)
    for p, b in enumerate(breaks[1:-1]):
        for order in range(degree):
            rows.append(row(p, b, order) - row(p + 1, b, order))
            right.append(0.0)
    coef = np.linalg.solve(np.array(rows), np.array(right))
    return np.array([row(piece(x), x, 0) @ coef for x in at])


@pytest.mark.parametrize("method", ["quadratic", "cubic"])
def test_splines_equal_their_pieces(spark, method):
    rng = np.random.default_rng(41)
    full = 5 + rng.normal(size=(3, 40)).cumsum(axis=1) * 0.3
    gaps = rng.random((3, 40)) < 0.4
    gaps[:, [0, -1]] = False
    given = np.where(gaps, 0.0, full)
    got = {(r["service_id"], r["t"]): r["value"] for r in fill_spline(frame(spark, *given, np.zeros(40)), method).collect()}
    t = np.arange(40.0)
    for s, v in enumerate(given, 1):
        on = v != 0
        want = np.where(on, v, pieces(t[on], v[on], t, {"quadratic": 2, "cubic": 3}[method]))
        assert np.allclose([got[s, k] for k in range(40)], want, rtol=1e-7, atol=1e-7)
    assert all(got[4, k] == 0 for k in range(40))


def granger(y, x, lag):
    """p of the F test that past x helps to tell y, from two regressions."""
    n = len(y) - lag
    own = np.column_stack([np.ones(n), *(y[lag - k : len(y) - k] for k in range(1, lag + 1))])
    both = np.column_stack([own, *(x[lag - k : len(x) - k] for k in range(1, lag + 1))])
    rest = [((y[lag:] - m @ np.linalg.lstsq(m, y[lag:], rcond=None)[0]) ** 2).sum() for m in (own, both)]
    df = n - 2 * lag - 1
    return nm.f_tail(np.array([(rest[0] - rest[1]) / lag / (rest[1] / df)]), lag, df)[0]


def test_verdicts_equal_regressions(spark):
    rng = np.random.default_rng(42)
    e = rng.normal(size=(6, 300))
    a, b, c, d = e[0], e[1].copy(), e[2].copy(), e[3].copy()
    for t in range(1, 300):
        b[t] += 0.8 * a[t - 1]
        c[t] += 0.4 * d[t - 1]
        d[t] += 0.4 * c[t - 1]
    x = {1: b, 2: a, 3: c, 4: d, 5: e[4].cumsum(), 6: e[5]}
    got = {(r["x"], r["y"]): r["verdict"] for r in granger_verdict(frame(spark, *x.values()), 2).collect()}
    assert len(got) == 15
    for i, j in combinations(x, 2):
        # p of (x, y) asks whether y is told by past x
        there, back = granger(x[j], x[i], 2) < 0.05, granger(x[i], x[j], 2) < 0.05
        want = "not stationary" if 5 in (i, j) else {(1, 1): "both", (1, 0): "x causes y", (0, 1): "y causes x", (0, 0): "none"}[there, back]
        assert got[i, j] == want, (i, j)
    assert got[1, 2] == "y causes x" and got[3, 4] == "both"


def likeliest(y):
    """(gamma, sigma) by ever finer grids over the profile likelihood of gamma / sigma, where gamma is over -0.9."""
    lo, hi, mean = -1 / y.max() + 1e-9, 20 / y.mean(), y.mean()
    best = (-len(y) * (math.log(mean) + 1), 0.0, mean)
    for _ in range(12):
        grid = np.linspace(lo, hi, 2001)
        grid = grid[np.abs(grid) > 1e-9]
        g = np.log1p(np.multiply.outer(grid, y)).mean(axis=1)
        fits = np.where(g > -0.9, -len(y) * (np.log(g / grid) + g + 1), -np.inf)
        k = int(fits.argmax())
        best = max(best, (fits[k], g[k], g[k] / grid[k]))
        lo, hi = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
    return best[1], best[2]


def alarms(v, n_init, q, level, depth=0, two_sided=False, adapt=False):
    """(upper, lower, alarm) of each later value, all thresholds and levels from lists of what was seen."""
    normal, raw = [], list(v[:n_init])
    for k in range(depth, n_init):
        normal.append(v[k] - (np.mean(v[k - depth : k]) if depth else 0.0))
    order = sorted(normal)
    thr = {1: order[int(level * len(order))], -1: order[int((1 - level) * len(order))]}
    peaks = {s: [s * (x - thr[s]) for x in normal if s * (x - thr[s]) > 0] for s in (1, -1)}
    n, z, out = len(normal), {}, []

    def fit(s):
        gamma, sigma = likeliest(np.array(peaks[s]))
        r = q * n / len(peaks[s])
        z[s] = thr[s] + s * (-sigma * math.log(r) if gamma == 0 else sigma / gamma * (r**-gamma - 1))

    sides = (1, -1) if two_sided else (1,)
    for s in sides:
        fit(s)
    for value in v[n_init:]:
        base = np.mean(raw[-depth:]) if depth else 0.0
        x = value - base
        alarm = not adapt and any(s * (x - z[s]) > 0 for s in sides)
        if not alarm:
            n += 1
            raw.append(value)
            for s in sides:
                if s * (x - thr[s]) > 0:
                    peaks[s].append(s * (x - thr[s]))
                    fit(s)
        out.append((z[1] + base, z[-1] + base if two_sided else None, alarm))
    return out


@pytest.mark.parametrize("kind", [{}, {"two_sided": True}, {"depth": 10}, {"depth": 10, "two_sided": True}, {"adapt": True}])
def test_alarm_levels_equal_a_plain_form(spark, kind):
    rng = np.random.default_rng(43)
    v = 10 + rng.normal(size=500)
    v[[340, 390, 391, 450]] += [7, -7, 7, 7]
    got = {r["t"]: r for r in run_spot(frame(spark, v), n_init=300, q=1e-3, level=0.9, **kind).collect()}
    want = alarms(v, 300, 1e-3, 0.9, **kind)
    assert any(a for _, _, a in want) == (not kind.get("adapt"))
    for t, (upper, lower, alarm) in enumerate(want, 300):
        assert got[t]["alarm"] == alarm and got[t]["upper"] == pytest.approx(upper, rel=1e-5)
        assert (got[t]["lower"] is None) == (lower is None) and (lower is None or got[t]["lower"] == pytest.approx(lower, rel=1e-5))
