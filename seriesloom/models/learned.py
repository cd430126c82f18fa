"""Models on the lag design: ridge and boosted stumps here, library models if they are installed."""

from __future__ import annotations

import importlib.util

import numpy as np

from ..errors import ModelError
from ..operators.features import TREE_LAGS
from .base import Model, register


class LagModel(Model):
    """Recursive forecasts from lags and the place in the season; residual quantiles for intervals."""

    family = "ml"
    least = max(TREE_LAGS) + 2

    def _row(self, past: np.ndarray, t: int) -> np.ndarray:
        return np.array([*(past[-k] for k in TREE_LAGS), *np.eye(self.period)[t % self.period]])

    def _fit(self, y, x):
        lag = max(TREE_LAGS)
        d = np.array([self._row(y[:t], t) for t in range(lag, len(y))])
        self.learn(d, y[lag:])
        self.res, self.past = y[lag:] - self.guess(d), y.copy()

    def predict(self, h, x=None, quantiles=(0.1, 0.5, 0.9)):
        past = list(self.past)
        for _ in range(h):
            past.append(float(self.guess(self._row(np.array(past), len(past))[None])[0]))
        mid = np.array(past[-h:])
        return {q: mid + (np.quantile(self.res, q) - np.median(self.res)) for q in sorted(quantiles)}

    def learn(self, d, y):
        raise NotImplementedError

    def guess(self, d):
        raise NotImplementedError


@register
class LagRidge(LagModel):
    name = "lag_ridge"

    def learn(self, d, y):
        self.mean, self.middle = y.mean(), d.mean(0)
        self.scale = np.maximum(d.std(0), 1e-9)
        z = (d - self.middle) / self.scale
        self.beta = np.linalg.solve(z.T @ z + self.params.get("alpha", 10.0) * np.eye(z.shape[1]), z.T @ (y - self.mean))

    def guess(self, d):
        return self.mean + (d - self.middle) / self.scale @ self.beta

    def search_space(self):
        return {"alpha": [0.1, 1.0, 10.0, 100.0]}


@register
class LagBoost(LagModel):
    """Gradient boosting of one-split trees."""

    name = "lag_boost"
    rounds = 60

    def learn(self, d, y):
        self.base, self.rate, self.cuts = y.mean(), self.params.get("rate", 0.2), []
        left = y - self.base
        grid = [np.unique(np.quantile(c, np.linspace(0.1, 0.9, 9))) for c in d.T]
        masks = [(j, c, d[:, j] <= c) for j, cs in enumerate(grid) for c in cs if 0 < (d[:, j] <= c).sum() < len(d)]
        low = np.array([m for _, _, m in masks], float)
        n1 = low.sum(1) if len(masks) else np.zeros(0)
        for _ in range(self.rounds if masks else 0):
            s1, total = low @ left, left.sum()
            k = int(np.argmax(s1**2 / n1 + (total - s1) ** 2 / (len(left) - n1)))
            j, c, m = masks[k]
            a, b = s1[k] / n1[k] * self.rate, (total - s1[k]) / (len(left) - n1[k]) * self.rate
            self.cuts.append((j, c, a, b))
            left = left - np.where(m, a, b)

    def guess(self, d):
        out = np.full(len(d), self.base)
        for j, c, a, b in self.cuts:
            out += np.where(d[:, j] <= c, a, b)
        return out

    def search_space(self):
        return {"rate": [0.05, 0.1, 0.2, 0.4]}


class Plugin(LagModel):
    """A model of a library that may be absent; fitting then says so."""

    library = ""

    def regressor(self):
        raise NotImplementedError

    def learn(self, d, y):
        if importlib.util.find_spec(self.library) is None:
            raise ModelError(f"{self.name} needs the library {self.library}, which is not installed")
        self.fitted = self.regressor().fit(d, y)

    def guess(self, d):
        return self.fitted.predict(d)


@register
class LightGbm(Plugin):
    name = library = "lightgbm"

    def regressor(self):
        import lightgbm

        return lightgbm.LGBMRegressor(**{"n_estimators": 300, "learning_rate": 0.05, "subsample": 0.9, "verbosity": -1, "random_state": 0, "n_jobs": 1, **self.params})


@register
class XgBoost(Plugin):
    name = library = "xgboost"

    def regressor(self):
        import xgboost

        return xgboost.XGBRegressor(**{"n_estimators": 300, "learning_rate": 0.05, "subsample": 0.9, "max_depth": 6, "random_state": 0, "n_jobs": 1, **self.params})


class Slot(Model):
    """A place for a network or closed service that cannot run here."""

    def _fit(self, y, x):
        raise ModelError(f"{self.name} is a slot: register a subclass that implements it")


@register
class NeuralProphet(Slot):
    name, family = "neuralprophet", "deep_learning"


@register
class TimesFm(Slot):
    name, family = "timesfm", "native"
