"""Forecasting of large fleets of time series on Spark.

The names below are the public ones; each is imported when it is first used.
"""

from __future__ import annotations

import importlib
from typing import Any

_PUBLIC = {
    "Forecaster": "plans.sdk",
    "RunConfig": "plans.config",
    "bakeoff": "plans.sdk",
    "from_dict": "plans.config",
    "generate_panel": "sources.generator",
    "load_config": "plans.config",
    "model_catalog": "plans.sdk",
    "register": "models",
    "run_model": "plans.sdk",
    "sample_data": "plans.sdk",
    "seed_tables": "sources.generator",
    "stream_ensemble": "streaming.ready",
    "validate_panel": "operators.validate",
}
__all__ = sorted(_PUBLIC)


def __getattr__(name: str) -> Any:
    if name not in _PUBLIC:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{_PUBLIC[name]}"), name)


def __dir__() -> list[str]:
    return __all__
