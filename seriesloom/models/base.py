"""The model contract, the registry of models, and interval placement."""

from __future__ import annotations

import pickle
from statistics import NormalDist
from typing import Any, ClassVar

import numpy as np

from ..errors import ModelError

QUANTILES = (0.1, 0.5, 0.9)
_MODELS: dict[str, type[Model]] = {}


class Model:
    """fit(y, x) then predict(h, x) -> {quantile: values}."""

    name: ClassVar[str] = ""
    family: ClassVar[str] = "statistical"
    supports_exog: ClassVar[bool] = False
    least: ClassVar[int] = 2

    def __init__(self, period: int = 7, **params: Any):
        self.period, self.params = period, params

    def fit(self, y: np.ndarray, x: np.ndarray | None = None) -> Model:
        y = np.asarray(y, float)
        if len(y) < self.least:
            raise ModelError(f"{self.name} needs {self.least} points, got {len(y)}")
        if not np.isfinite(y).all():
            raise ModelError(f"{self.name} needs finite values")
        self._fit(y, x if self.supports_exog else None)
        return self

    def predict(self, h: int, x: np.ndarray | None = None, quantiles: tuple[float, ...] = QUANTILES) -> dict[float, np.ndarray]:
        mid, sd = self._forecast(h, x if self.supports_exog else None)
        normal = NormalDist()
        return {q: mid + (normal.inv_cdf(q) * sd if q != 0.5 else 0.0) for q in sorted(quantiles)}

    def _fit(self, y: np.ndarray, x: np.ndarray | None) -> None:
        raise NotImplementedError

    def _forecast(self, h: int, x: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def search_space(self) -> dict[str, list]:
        """Values of each tunable parameter."""
        return {}

    def get_params(self) -> dict[str, Any]:
        return {"period": self.period, **self.params}

    def serialize(self) -> bytes:
        return pickle.dumps(self)


def register(cls: type[Model]) -> type[Model]:
    if not cls.name or cls.name in _MODELS:
        raise ModelError(f"the model name {cls.name!r} is missing or taken")
    _MODELS[cls.name] = cls
    return cls


def registered() -> dict[str, type[Model]]:
    return dict(_MODELS)


def create(name: str, **params: Any) -> Model:
    if name not in _MODELS:
        raise ModelError(f"no model {name!r}; there are {', '.join(sorted(_MODELS))}")
    return _MODELS[name](**params)
