"""Closed-form baselines behind the model contract; SQL can say the same."""

from __future__ import annotations

import numpy as np

from .base import Model, register


@register
class SeasonalNaive(Model):
    """The last season again."""

    name = "seasonal_naive"

    @property
    def season(self) -> int:
        return int(self.params.get("season", self.period))

    def _fit(self, y, x):
        m = min(self.season, len(y))
        self.last = y[-m:]
        self.sd = float(np.std(y[m:] - y[:-m])) if len(y) > m else 0.0

    def _forecast(self, h, x):
        k = np.arange(h)
        return self.last[k % len(self.last)], self.sd * np.sqrt(k // len(self.last) + 1)

    def search_space(self):
        return {"season": [self.period, 2 * self.period, 4 * self.period]}


@register
class Mean(Model):
    name = "mean"

    def _fit(self, y, x):
        self.level, self.sd = float(y.mean()), float(y.std())

    def _forecast(self, h, x):
        return np.full(h, self.level), np.full(h, self.sd)


@register
class Drift(Model):
    """The last value and the mean step."""

    name = "drift"

    def _fit(self, y, x):
        self.last, self.step = float(y[-1]), float((y[-1] - y[0]) / (len(y) - 1))
        self.sd = float(np.std(np.diff(y)))

    def _forecast(self, h, x):
        k = np.arange(1, h + 1)
        return self.last + k * self.step, self.sd * np.sqrt(k)


@register
class LinearTrend(Model):
    """Least squares on time."""

    name = "linear_trend"

    def _fit(self, y, x):
        t = np.arange(len(y)) - (len(y) - 1) / 2
        self.slope, self.level, self.n = float(t @ y / (t @ t)), float(y.mean()), len(y)
        self.sd = float(np.std(y - self.level - self.slope * t))

    def _forecast(self, h, x):
        return self.level + self.slope * (self.n + np.arange(h) - (self.n - 1) / 2), np.full(h, self.sd)
