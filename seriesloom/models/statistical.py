"""Statistical models in numpy: theta, Holt-Winters, seasonal ARIMA, structural, STL bagging, trend plus Fourier."""

from __future__ import annotations

import numpy as np

from .base import Model, register
from .optimise import simplex

SEED = 20240


def _logistic(v: float) -> float:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def seasonal_means(y: np.ndarray, m: int) -> np.ndarray:
    """Additive season: means of the detrended series by place in the season, centred."""
    k = np.ones(m) / m if m % 2 else np.concatenate([[0.5], np.ones(m - 1), [0.5]]) / m
    half = len(k) // 2
    trend = np.convolve(np.pad(y, half, mode="edge"), k, mode="valid")
    left = y - trend
    s = np.array([left[i::m].mean() for i in range(m)])
    return s - s.mean()


@register
class Theta(Model):
    """Exponential smoothing of the deseasonalised series plus half the linear slope."""

    name = "theta"

    def _fit(self, y, x):
        n, m = len(y), self.period
        self.season = seasonal_means(y, m) if n >= 2 * m and m > 1 else np.zeros(max(1, m))
        d = y - self.season[np.arange(n) % len(self.season)]
        self.slope = np.polyfit(np.arange(n), d, 1)[0] if n > 2 else 0.0

        def run(a: float) -> tuple[float, float]:
            level, sse = d[0], 0.0
            for v in d[1:]:
                sse += (v - level) ** 2
                level += a * (v - level)
            return sse, level

        grid = np.linspace(0.02, 0.98, 25)
        self.alpha = float(grid[int(np.argmin([run(a)[0] for a in grid]))])
        sse, self.level = run(self.alpha)
        self.sd, self.n = np.sqrt(sse / max(1, n - 1)), n

    def _forecast(self, h, x):
        k = np.arange(1, h + 1)
        trend = 0.5 * self.slope * (k - 1 + (1 - (1 - self.alpha) ** self.n) / self.alpha)
        season = self.season[(self.n + k - 1) % len(self.season)]
        return self.level + trend + season, self.sd * np.sqrt(1 + (k - 1) * self.alpha**2)


@register
class HoltWinters(Model):
    """Additive level, trend and season; intervals from residuals."""

    name = "holtwinters"

    def _run(self, p, y, m):
        a, b, g = (_logistic(v) for v in p)
        level, trend = self.start
        season = self.first.copy()
        res = np.empty(len(y))
        for t, v in enumerate(y):
            s = season[t % m]
            res[t] = v - (level + trend + s)
            new = a * (v - s) + (1 - a) * (level + trend)
            trend = b * (new - level) + (1 - b) * trend
            season[t % m] = g * (v - new) + (1 - g) * s if self.seasonal else 0.0
            level = new
        return res, level, trend, season

    def _fit(self, y, x):
        m = max(1, self.period)
        self.seasonal = len(y) >= 2 * m and m > 1
        self.first = seasonal_means(y, m) if self.seasonal else np.zeros(m)
        d = y - self.first[np.arange(len(y)) % m]
        k = min(len(d), 2 * m)
        slope = (d[k - 1] - d[0]) / max(1, k - 1)
        self.start = (d[0] - slope, slope)
        given = [self.params.get(k) for k in ("alpha", "beta", "gamma")]
        if None in given:
            best = simplex(lambda p: float((self._run(p, y, m)[0] ** 2).sum()), [-1.0, -3.0, -2.0], 1.0, 60)
        else:
            best = [float(np.log(v / (1 - v))) for v in given]  # smoothing weights as given, between 0 and 1
        self.res, self.level, self.trend, self.season = self._run(best, y, m)
        self.n = len(y)

    def predict(self, h, x=None, quantiles=(0.1, 0.5, 0.9)):
        k = np.arange(1, h + 1)
        mid = self.level + self.trend * k + self.season[(self.n + k - 1) % len(self.season)]
        return {q: mid + (np.quantile(self.res, q) - np.median(self.res)) for q in sorted(quantiles)}


class _Css:
    """Seasonal ARIMA by conditional least squares on the differenced series."""

    def __init__(self, y, order, seasonal, m, x=None):
        (self.p, self.d, self.q), (self.P, self.D, self.Q), self.m = order, seasonal, m
        self.beta = None
        if x is not None:
            z = np.column_stack([np.ones(len(y)), np.arange(len(y)), x])
            self.beta = np.linalg.lstsq(z, y, rcond=None)[0][2:]
            y = y - x @ self.beta
        self.y = y
        w = y
        for _ in range(self.D):
            w = w[m:] - w[:-m]
        for _ in range(self.d):
            w = np.diff(w)
        self.mean = w.mean() if self.d + self.D == 0 else 0.0
        self.w = w - self.mean
        self.theta = simplex(lambda v: float((self._errors(v) ** 2).sum()), [0.1] * (self.p + self.q + self.P + self.Q), 0.2, 80) if self.p + self.q + self.P + self.Q else np.zeros(0)
        self.e = self._errors(self.theta)
        self.sd = float(np.sqrt((self.e**2).mean())) if len(self.e) else 0.0

    def _polys(self, v):
        v = np.tanh(v)
        p, q, big_p = self.p, self.q, self.P
        ar = np.concatenate([[1.0], -v[:p]])
        ma = np.concatenate([[1.0], v[p : p + q]])
        sar, sma = np.zeros(self.m * self.P + 1), np.zeros(self.m * self.Q + 1)
        sar[0] = sma[0] = 1.0
        for i in range(self.P):
            sar[self.m * (i + 1)] = -v[p + q + i]
        for i in range(self.Q):
            sma[self.m * (i + 1)] = v[p + q + big_p + i]
        return np.convolve(ar, sar), np.convolve(ma, sma)

    def _errors(self, v):
        ar, ma = self._polys(v)
        u = np.convolve(self.w, ar)[: len(self.w)]
        lags = [(int(k) + 1, float(ma[k + 1])) for k in np.flatnonzero(ma[1:])]
        far = max((k for k, _ in lags), default=0)
        e = [0.0] * far
        for t, v in enumerate(u.tolist(), far):
            for k, c in lags:
                v -= c * e[t - k]
            e.append(v)
        return np.array(e[far:])

    def forecast(self, h, x=None):
        ar, ma = self._polys(self.theta)
        w, e = list(self.w), list(self.e)
        for _ in range(h):
            t = len(w)
            w.append(sum(-ar[k] * w[t - k] for k in range(1, len(ar)) if k <= t) + sum(ma[k] * e[t - k] for k in range(1, len(ma)) if k <= t))
            e.append(0.0)
        diff = np.ones(1)
        for _ in range(self.d):
            diff = np.convolve(diff, [1, -1])
        for _ in range(self.D):
            diff = np.convolve(diff, np.concatenate([[1], np.zeros(self.m - 1), [-1]]))
        y = list(self.y)
        for i in range(h):
            y.append(w[len(self.w) + i] + self.mean - sum(diff[k] * y[len(y) - k] for k in range(1, len(diff))))
        whole = np.convolve(ar, diff)
        psi = np.zeros(h)
        for j in range(h):
            psi[j] = (ma[j] if j < len(ma) else 0.0) - sum(whole[k] * psi[j - k] for k in range(1, min(j, len(whole) - 1) + 1))
        mid = np.array(y[-h:])
        if x is not None and self.beta is not None:
            mid = mid + x @ self.beta
        return mid, self.sd * np.sqrt(np.cumsum(psi**2))

    @property
    def aic(self):
        n = max(1, len(self.e))
        return n * np.log(max(self.sd, 1e-12) ** 2) + 2 * (len(self.theta) + 1)


@register
class Sarimax(Model):
    """(p, d, q) with a seasonal (P, D, Q), as a rule (0, 1, 1), if there are two seasons; the tuned order is used."""

    name, supports_exog, least = "sarimax", True, 3

    def _fit(self, y, x):
        order = (self.params.get("p", 1), self.params.get("d", 1), self.params.get("q", 1))
        seasonal = len(y) >= 2 * self.period + 2 and self.period > 1
        by_season = (self.params.get("P", 0), self.params.get("D", 1), self.params.get("Q", 1))
        self.fitted = _Css(y, order, by_season if seasonal else (0, 0, 0), self.period if seasonal else 1, x)

    def _forecast(self, h, x):
        return self.fitted.forecast(h, x)

    def search_space(self):
        return {"p": [0, 1, 2], "d": [0, 1], "q": [0, 1, 2]}


@register
class ArimaAic(Model):
    """The order of least AIC over a small grid, for all series alike."""

    name, family, least = "arima_plus", "native", 3

    def _fit(self, y, x):
        seasonal = len(y) >= 2 * self.period + 4 and self.period > 1
        tries = [_Css(y, (p, 1, q), (0, 1, 1) if seasonal else (0, 0, 0), self.period if seasonal else 1) for p, q in ((0, 1), (1, 0), (1, 1))]
        self.fitted = min(tries, key=lambda t: t.aic)

    def _forecast(self, h, x):
        return self.fitted.forecast(h)


@register
class Structural(Model):
    """Local linear trend and seasonal dummies by a Kalman filter; variances by the whole series' likelihood."""

    name, supports_exog, least = "ucm", True, 3

    def _filter(self, p, y):
        q = np.exp(np.clip(p, -20, 8))
        m = self.m
        k = 2 + (m - 1 if m > 1 else 0)
        f = np.zeros((k, k))
        f[0, 0] = f[0, 1] = f[1, 1] = 1
        z = np.zeros(k)
        z[0] = 1
        noise = np.zeros(k)
        noise[0], noise[1] = q[1], q[2]
        if m > 1:
            f[2, 2:] = -1
            for i in range(3, k):
                f[i, i - 1] = 1
            z[2], noise[2] = 1, q[3]
        a, cov = np.zeros(k), np.eye(k) * 1e4
        a[0] = y[0]
        score = 0.0
        for t, v in enumerate(y):
            pz = cov @ z
            s = z @ pz + q[0]
            e = v - z @ a
            if t >= k:
                score += np.log(s) + e * e / s
            gain = pz / s
            a = a + gain * e
            cov = cov - np.outer(gain, pz)
            a = f @ a
            cov = f @ cov @ f.T
            cov.flat[:: k + 1] += noise
        return score, a, cov, f, z, q[0], noise

    def _fit(self, y, x):
        self.m = self.period if self.period > 1 and len(y) >= 2 * self.period else 1
        self.beta = None
        if x is not None:
            d = np.column_stack([np.ones(len(y)), np.arange(len(y)), x])
            self.beta = np.linalg.lstsq(d, y, rcond=None)[0][2:]
            y = y - x @ self.beta
        self.scale = float(np.std(y)) or 1.0
        y = y / self.scale
        best = simplex(lambda p: self._filter(p, y)[0], [-1.0, -3.0, -8.0, -5.0], 1.0, 200)
        self.state = self._filter(best, y)[1:]

    def _forecast(self, h, x):
        a, cov, f, z, obs, noise = self.state
        mid, sd = np.zeros(h), np.zeros(h)
        for i in range(h):
            mid[i], sd[i] = z @ a, np.sqrt(max(0.0, z @ cov @ z + obs))
            a, cov = f @ a, f @ cov @ f.T
            cov.flat[:: len(a) + 1] += noise
        mid, sd = mid * self.scale, sd * self.scale
        return (mid + x @ self.beta if x is not None and self.beta is not None else mid), sd


def loess(y: np.ndarray, q: int, weight: np.ndarray | None = None, ends: bool = False) -> np.ndarray:
    """Local lines over the q nearest points at each point; with ends, also one place before and one after."""
    n = len(y)
    at = np.arange(-1, n + 1) if ends else np.arange(n)
    width = min(q, n)
    left = np.clip(at - (q - 1) // 2, 0, n - width)
    j = left[:, None] + np.arange(width)
    h = np.maximum(at - left, left + width - 1 - at) + max(0, (q - n) // 2)
    r = np.abs(j - at[:, None]) / np.maximum(h, 1)[:, None]
    w = np.where(r <= 0.001, 1.0, np.where(r <= 0.999, (1 - np.minimum(r, 1) ** 3) ** 3, 0.0))
    if weight is not None:
        w = w * weight[j]
    total = w.sum(axis=1)
    lost = total <= 0
    w = w / np.where(lost, 1, total)[:, None]
    mid = (w * j).sum(axis=1)
    off = j - mid[:, None]
    var = (w * off**2).sum(axis=1)
    wide = np.sqrt(var) > 0.001 * (n - 1)
    w = w * (1 + np.where(wide, (at - mid) / np.where(wide, var, 1), 0)[:, None] * off)
    return np.where(lost, y[np.clip(at, 0, n - 1)], (w * y[j]).sum(axis=1))


def stl(y: np.ndarray, m: int, inner: int = 2, outer: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Robust seasonal-trend decomposition by LOESS (Cleveland et al., 1990): season, trend, remainder.

    Spans are the usual ones: 7 for the season, the least odd one over 1.5 m / (1 - 1.5 / 7) for the trend.
    """
    n = len(y)
    span = int(np.ceil(1.5 * m / (1 - 1.5 / 7)))
    span, low = span + (span % 2 == 0), m + 1 + m % 2
    trend, weight = np.zeros(n), None
    for k in range(outer + 1):
        for _ in range(inner):
            cycle, d = np.zeros(n + 2 * m), y - trend
            for i in range(m):
                cycle[i::m] = loess(d[i::m], 7, None if weight is None else weight[i::m], ends=True)
            means = cycle
            for size in (m, m, 3):
                means = np.convolve(means, np.ones(size) / size, mode="valid")
            season = cycle[m : m + n] - loess(means, low)
            trend = loess(y - season, span, weight)
        left = np.abs(y - season - trend)
        if k < outer:
            bound = 6 * np.median(left)
            r = left / bound if bound > 0 else np.zeros(n)
            weight = np.where(r <= 0.001, 1.0, np.where(r <= 0.999, (1 - np.minimum(r, 1) ** 2) ** 2, 0.0))
    return season, trend, y - season - trend


@register
class StlBagging(Model):
    """Robust STL; an ARIMA of the deseasonalised series, the last season repeated, remainders drawn independently."""

    name = "stl_bagging"
    paths = 40

    def _fit(self, y, x):
        from ..errors import ModelError

        m = self.period
        if m < 2:
            raise ModelError(f"stl_bagging needs a season of two points or more, got {m}")
        if len(y) < 2 * m:
            raise ModelError(f"stl_bagging needs two seasons, got {len(y)} points")
        season, _, self.rest = stl(y, m)
        self.season = season[-m:]
        self.fitted = _Css(y - season, (1, 1, 1), (0, 0, 0), 1)

    def predict(self, h, x=None, quantiles=(0.1, 0.5, 0.9)):
        mid, _ = self.fitted.forecast(h)
        rng = np.random.default_rng(SEED)
        draws = mid + np.resize(self.season, h) + rng.choice(self.rest, (self.paths, h))
        return {q: np.quantile(draws, q, axis=0) for q in sorted(quantiles)}


@register
class TrendFourier(Model):
    """Ridge on a piecewise linear trend, weekly and yearly cycles and regressors."""

    name, supports_exog = "prophet", True

    def _design(self, t, x):
        u = t / self.n
        cols = [np.ones_like(u), u, *(np.maximum(0, u - c) for c in self.knots)]
        for period, order in ((self.period, 3), (365.25, self.params.get("fourier_order", 3))):
            if period > 1 and self.n >= 2 * period:
                cols += [g(2 * np.pi * k * t / period) for k in range(1, order + 1) for g in (np.sin, np.cos) if 2 * k < period or g is np.cos]
        if x is not None:
            cols += list(x.T)
        return np.column_stack(cols)

    def _fit(self, y, x):
        self.n = len(y)
        self.knots = np.linspace(0, 0.8, self.params.get("knots", 10) + 2)[1:-1]
        d = self._design(np.arange(self.n, dtype=float), x)
        weight = np.full(d.shape[1], 1e-3)
        weight[2 : 2 + len(self.knots)] = 1 / self.params.get("changepoint_prior", 0.5)
        weight[0] = 0
        self.beta = np.linalg.lstsq(np.vstack([d, np.diag(np.sqrt(weight))]), np.concatenate([y, np.zeros(len(weight))]), rcond=None)[0]
        self.sd = float(np.std(y - d @ self.beta))

    def _forecast(self, h, x):
        return self._design(self.n + np.arange(h, dtype=float), x) @ self.beta, np.full(h, self.sd)

    def search_space(self):
        return {"changepoint_prior": [0.05, 0.5, 5.0], "fourier_order": [2, 3, 6], "knots": [5, 10, 20]}
