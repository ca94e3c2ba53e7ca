"""Small vectorised numerical helpers for task-side kernels."""

from __future__ import annotations

import math

import numpy as np


def erf(x: np.ndarray) -> np.ndarray:
    """Error function, elementwise, by its series of terms of one sign; NaN stays NaN.  Over 6 it is 1 in double precision."""
    x = np.asarray(x, float)
    near = np.clip(x, -6.0, 6.0)
    term = total = near
    for k in range(1, 160):
        term = term * (2 * near * near) / (2 * k + 1)
        total = total + term
    return np.where(np.abs(x) >= 6, np.sign(x), 2 / math.sqrt(math.pi) * np.exp(-near * near) * total)


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.clip(np.where(swap, 1 - x, x), 0, 1)
    tiny = 1e-300
    lg = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lg(p + q) - lg(p) - lg(q) + p * np.log(np.maximum(z, tiny)) + q * np.log1p(-np.minimum(z, 1 - 1e-16))) / p
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
            h *= d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    out = np.where(z <= 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


def f_tail(f: np.ndarray, d1, d2) -> np.ndarray:
    """P(F > f) with d1 and d2 degrees of freedom."""
    f = np.maximum(np.asarray(f, float), 0)
    return beta_inc(np.asarray(d2) / 2, np.asarray(d1) / 2, d2 / (d2 + d1 * f))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def lag_rows(y: np.ndarray, x: np.ndarray, lag: int) -> np.ndarray:
    """Columns y[t], y[t-1..t-lag], x[t-1..t-lag] and 1 for t >= lag."""
    n = len(y) - lag
    cols = [y[lag:]] + [y[lag - k : lag - k + n] for k in range(1, lag + 1)] + [x[lag - k : lag - k + n] for k in range(1, lag + 1)]
    return np.column_stack([*cols, np.ones(n)])


def _ssr(gram: np.ndarray, keep: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Residual sums of squares and ranks of regressing column 0 on ``keep``, for stacked Gram matrices."""
    a = gram[:, keep][:, :, keep]
    b = gram[:, keep, 0]
    scale = np.sqrt(np.maximum(np.einsum("nii->ni", a), 1e-300))
    a = a / scale[:, :, None] / scale[:, None, :]
    b = b / scale
    w, v = np.linalg.eigh(a)
    fine = w > np.maximum(w[:, -1:], 1e-300) * 1e-11
    inv = np.where(fine, 1 / np.where(fine, w, 1), 0)
    proj = np.einsum("nji,nj->ni", v, b)
    return np.maximum(gram[:, 0, 0] - (proj * proj * inv).sum(1), 0), fine.sum(1)


def granger_grams(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, lag: int) -> np.ndarray:
    """Gram matrix of the lag rows of every interval [start, end) as a difference of prefix sums."""
    outer = rows[:, :, None] * rows[:, None, :]
    pre = np.concatenate([np.zeros((1, *outer.shape[1:])), np.cumsum(outer, axis=0)])
    return pre[np.maximum(ends - lag, starts)] - pre[starts]


def granger_p(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, lag: int) -> np.ndarray:
    """P-values that x helps to predict y in each interval; NaN for 3 * lag + 1 rows or fewer."""
    return granger_stats(rows, starts, ends, lag)[1]


def granger_stats(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """F statistics and their p-values."""
    return gram_stats(granger_grams(rows, starts, ends, lag), ends - starts, lag)


def gram_stats(gram: np.ndarray, n: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """F statistics and p-values from the stacked Gram matrices of intervals of ``n`` samples, of any number of pairs."""
    own = [*range(1, lag + 1), 2 * lag + 1]
    r, _ = _ssr(gram, own)
    u, rank = _ssr(gram, list(range(1, 2 * lag + 2)))
    df = np.maximum(n - lag - rank, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        f = np.where(u > 0, (r - u) / np.where(u > 0, u, 1) / lag * df, np.where(r > 0, np.inf, 0.0))
    p = f_tail(np.minimum(f, 1e12), np.full(len(n), lag), df)
    few = n <= 3 * lag + 1
    return np.where(few, np.nan, f), np.where(few, np.nan, p)


#: MacKinnon (1994) response surface, constant and no trend: tau bounds and coefficients, fixed values.
ADF_MAX, ADF_MIN, ADF_STAR = 2.74, -18.83, -1.61
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def adf_p(x: np.ndarray, max_lag: int | None = None) -> float:
    """P-value of the augmented Dickey-Fuller test with a constant; the lag has the least AIC. NaN if it can't be run."""
    x = np.asarray(x, float)
    n = len(x)
    if max_lag is None:
        max_lag = int(math.ceil(12 * (n / 100) ** 0.25))
    max_lag = min(max_lag, n // 2 - 2)
    if max_lag < 0 or np.ptp(x) == 0:
        return math.nan
    x = (x - x.mean()) / x.std()  # the statistic does not depend on level and scale, its rounding does
    dx = np.diff(x)

    def fit(lag: int, first: int) -> tuple[float, float]:
        y = dx[first:]
        cols = [x[first:-1]] + [dx[first - k : len(dx) - k] for k in range(1, lag + 1)] + [np.ones(len(y))]
        a = np.column_stack(cols)
        beta, *_ = np.linalg.lstsq(a, y, rcond=None)
        ssr = float(((y - a @ beta) ** 2).sum())
        m, k = a.shape
        if m <= k or ssr <= 0:
            return math.inf, -math.inf
        cov = np.linalg.pinv(a.T @ a)[0, 0] * ssr / (m - k)
        llf = -m / 2 * (math.log(2 * math.pi) + math.log(ssr / m) + 1)
        return -2 * llf + 2 * k, float(beta[0] / math.sqrt(max(cov, 1e-300)))

    best = min(range(max_lag + 1), key=lambda k: fit(k, max_lag)[0])
    return adf_tail(fit(best, best)[1])


def adf_tail(tau: float) -> float:
    """P-value of a Dickey-Fuller statistic."""
    if tau > ADF_MAX:
        return 1.0
    if tau < ADF_MIN:
        return 0.0
    coef = ADF_SMALL if tau <= ADF_STAR else ADF_LARGE
    return normal_cdf(sum(c * tau**k for k, c in enumerate(coef)))


def adf_stack(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, max_lag: int | None = None) -> np.ndarray:
    """``adf_p`` of x[start:end] for many intervals of one series.

    Rows of (difference, level, earlier differences) have one prefix Gram; an interval's is a difference of two of its sums.
    With the constant swept out, one Cholesky factor of it in the order of the lags holds the residual sums of all
    nested regressions, so the lag of least AIC costs a stack of factors for all intervals.  An interval
    whose factor fails, or nearly, is fitted by ``adf_p``.
    """
    x = np.asarray(x, float)
    size = ends - starts
    top = np.array([int(math.ceil(12 * (n / 100) ** 0.25)) for n in size]) if max_lag is None else np.full(len(size), max_lag)
    top = np.minimum(top, size // 2 - 2)
    moves = np.concatenate([[0], np.cumsum(np.diff(x) != 0)])
    out = np.full(len(size), math.nan)
    live = np.flatnonzero((top >= 0) & (moves[np.maximum(ends - 1, 0)] > moves[np.minimum(starts, len(moves) - 1)]))
    if not len(live):
        return out
    z = (x - x.mean()) / (x.std() or 1)
    dz, widest = np.diff(z), int(top[live].max())
    rows = np.zeros((len(dz), widest + 3))
    rows[:, 0], rows[:, 1], rows[:, -1] = dz, z[:-1], 1
    for k in range(1, widest + 1):
        rows[k:, 1 + k] = dz[: len(dz) - k]
    pre = np.concatenate([np.zeros((1, rows.shape[1], rows.shape[1])), np.cumsum(rows[:, :, None] * rows[:, None, :], axis=0)])

    def swept(i, lag):
        """Gram of difference, level and ``lag`` earlier differences, and the number of rows, without the constant."""
        g = pre[ends[i] - 1] - pre[starts[i] + lag[:, None, None].ravel()]
        mean = g[:, -1, :-1] / g[:, -1:, -1]
        return g[:, :-1, :-1] - g[:, -1, :-1, None] * mean[:, None, :], g[:, -1, -1]

    def residuals(g, width):
        """Residual sums with 0, 1, ... ``width`` regressors, each stacked; NaN where they can't be told from rounding."""
        keep = [*range(1, width + 1), 0]
        a = g[:, keep][:, :, keep]
        scale = np.sqrt(np.maximum(np.einsum("nii->ni", a), 1e-300))
        a = a / scale[:, :, None] / scale[:, None, :]
        try:
            f = np.linalg.cholesky(a)
        except np.linalg.LinAlgError:
            f = np.full_like(a, math.nan)
            for k, one in enumerate(a):
                try:
                    f[k] = np.linalg.cholesky(one)
                except np.linalg.LinAlgError:
                    pass
        weak = np.einsum("nii->ni", f).min(1) < 1e-4
        left = 1 - np.concatenate([np.zeros((len(a), 1)), np.cumsum(f[:, -1, :-1] ** 2, axis=1)], axis=1)
        left[:, -1] = f[:, -1, -1] ** 2
        return np.where(weak[:, None], math.nan, left * scale[:, -1:] ** 2), f, scale

    for lag in np.unique(top[live]).tolist():
        i = live[top[live] == lag]
        g, m = swept(i, np.full(len(i), lag))
        ssr = residuals(g, lag + 1)[0][:, 1:]
        k = np.arange(lag + 1) + 2
        with np.errstate(divide="ignore", invalid="ignore"):
            aic = m[:, None] * (math.log(2 * math.pi) + np.log(ssr / m[:, None]) + 1) + 2 * k
        aic[m[:, None] <= k] = math.inf
        bad = np.isnan(aic).any(1) | np.isinf(aic).all(1)
        best = np.where(bad, 0, np.argmin(np.where(np.isnan(aic), math.inf, aic), axis=1))
        # Two lags whose AIC rounding could swap are left to the direct fit too.
        two = np.sort(np.where(np.isnan(aic), math.inf, aic), axis=1)[:, :2] if lag else None
        if two is not None:
            bad |= ~(two[:, 1] > two[:, 0] + 1e-7)
        for b in np.unique(best[~bad]).tolist():
            at = np.flatnonzero((best == b) & ~bad)
            g, m = swept(i[at], np.full(len(at), b))
            ssr, f, scale = residuals(g, b + 1)
            ok = ~np.isnan(ssr[:, -1]) & (m > b + 2)
            bad[at[~ok]] = True
            if not ok.any():
                continue
            low, y = f[ok][:, :-1, :-1], f[ok][:, -1, :-1]
            beta = np.linalg.solve(low.transpose(0, 2, 1), y[:, :, None])[:, 0, 0]
            inverse = np.linalg.solve(low, np.eye(b + 1)[None, :, :1])
            spread = (inverse**2).sum((1, 2)) * f[ok][:, -1, -1] ** 2 / (m[ok] - b - 2)
            out[i[at[ok]]] = [adf_tail(t) for t in (beta / np.sqrt(np.maximum(spread, 1e-300))).tolist()]
        for j in i[bad].tolist():
            out[j] = adf_p(x[starts[j] : ends[j]], max_lag)
    return out


def partial_corr(corr: np.ndarray, i: int, j: int, cond: list[int]) -> float:
    """Partial correlation of i and j given cond, from the precision matrix of their block."""
    idx = [i, j, *cond]
    p = np.linalg.pinv(corr[np.ix_(idx, idx)])
    d = p[0, 0] * p[1, 1]
    return float(-p[0, 1] / math.sqrt(d)) if d > 0 else 0.0


def fisher_p(r: float, n: int, conds: int) -> float:
    """Two-sided p-value of a (partial) correlation by Fisher's z."""
    r = min(max(r, -0.9999999), 0.9999999)
    return 2 * (1 - normal_cdf(abs(math.atanh(r)) * math.sqrt(max(n - conds - 3, 1))))


def spline(t: np.ndarray, v: np.ndarray, at: np.ndarray, degree: int) -> np.ndarray:
    """Interpolating spline through (t, v): cubic with not-a-knot ends, quadratic with knots at midpoints."""
    m = len(t)
    if m <= degree:
        return np.interp(at, t, v) if m else np.zeros(len(at))
    inner = t[2:-2] if degree == 3 else (t[1:-2] + t[2:-1]) / 2
    knots = np.concatenate([np.repeat(t[0], degree + 1), inner, np.repeat(t[-1], degree + 1)]).astype(float)

    def basis(x):
        i = np.clip(np.searchsorted(knots, x, "right") - 1, degree, len(knots) - degree - 2)
        b = np.zeros((len(x), m))
        n = np.zeros((len(x), degree + 1))
        n[:, 0] = 1
        for d in range(1, degree + 1):
            saved = np.zeros(len(x))
            for r in range(d):
                right, left = knots[i + r + 1], knots[i + r + 1 - d]
                w = np.where(right > left, n[:, r] / np.where(right > left, right - left, 1), 0)
                n[:, r] = saved + (right - x) * w
                saved = (x - left) * w
            n[:, d] = saved
        for r in range(degree + 1):
            b[np.arange(len(x)), i - degree + r] = n[:, r]
        return b

    coef = np.linalg.lstsq(basis(t.astype(float)), v, rcond=None)[0]
    return basis(at.astype(float)) @ coef


def gpd_fit(peaks: np.ndarray, roots: int = 10) -> tuple[float, float]:
    """(gamma, sigma) of a generalized Pareto fit of excesses: the likeliest of the profile equation's roots and the exponential case."""
    y = np.asarray(peaks, float)
    if not len(y):
        return 0.0, 1e-8
    lo, hi, mean = y.min(), y.max(), y.mean()

    def profile(t):
        s = 1 + np.multiply.outer(t, y)
        return (1 + np.log(s).mean(-1)) * (1 / s).mean(-1) - 1

    def likelihood(g, s):
        if s <= 0:
            return -math.inf
        if g == 0:
            return -len(y) * (math.log(s) + mean / s)
        z = 1 + g / s * y
        return -math.inf if (z <= 0).any() else float(-len(y) * math.log(s) - (1 + 1 / g) * np.log(z).sum())

    best = (likelihood(0.0, mean), 0.0, mean)
    eps = min(1e-8, 0.5 / hi) if hi > 0 else 1e-8
    grids = [np.linspace(-1 / hi + eps, -eps, 4 * roots + 1)] if hi > 0 else []
    if lo > 0 and mean > lo:
        # Positive roots lie below 2 (mean - min) / min^2, which may be far off: a geometric grid.
        grids.append(np.geomspace(1e-6 / mean, max(2 * (mean - lo) / lo**2, 2e-6 / mean), 8 * roots))
    for grid in grids:
        f = profile(grid)
        for k in np.flatnonzero(np.sign(f[:-1]) * np.sign(f[1:]) < 0).tolist():
            u, w, fu = grid[k], grid[k + 1], f[k]
            for _ in range(60):
                mid = (u + w) / 2
                fm = profile(np.array([mid]))[0]
                u, w, fu = (mid, w, fm) if np.sign(fm) == np.sign(fu) else (u, mid, fu)
            t = (u + w) / 2
            g = float(np.log(1 + t * y).mean())
            if t != 0 and g / t > 0:
                best = max(best, (likelihood(g, g / t), g, g / t))
    return best[1], best[2]


def tail_level(q: float, n: int, peaks: int, t: float, gamma: float, sigma: float, side: int = 1) -> float:
    """Level that a share q of n values passes beyond threshold t; side -1 mirrors it."""
    r = n * q / max(peaks, 1)
    if gamma == 0:
        return t - side * sigma * math.log(r)
    return t + side * sigma / gamma * (r**-gamma - 1)
