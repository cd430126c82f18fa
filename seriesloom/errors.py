"""Errors a caller can tell apart."""


class EngineError(Exception):
    """Base of all errors raised on purpose."""


class ConfigError(EngineError):
    """A configuration that cannot be run."""


class PanelError(EngineError):
    """A panel that fails a check; the message names the first offender."""


class ModelError(EngineError):
    """A model that cannot be fitted or found."""
