"""Forecast models that are fitted one series at a time."""

from .base import Model, create, register, registered

__all__ = ["Model", "create", "register", "registered"]

from . import baseline, learned, statistical  # noqa: E402, F401  (register their models)
