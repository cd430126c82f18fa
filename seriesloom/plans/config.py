"""The run configuration: frozen, strict about unknown keys, normalised on load."""

from __future__ import annotations

import datetime as dt
import json
import logging
from pathlib import Path
from typing import Any, Literal

from pydantic import BaseModel, ConfigDict, Field, ValidationError, model_validator

from ..errors import ConfigError
from . import ids

LEARNED = {"ridge", "nnls", "xgb"}
#: compute settings that a family may have of its own
PER_FAMILY = ("max_parallelism", "bucket_target_cells", "persist_models")


#: fixed values: the names of all fields below, and their defaults, are the configuration format


class Block(BaseModel):
    model_config = ConfigDict(frozen=True, extra="forbid")


class Data(Block):
    source_table: str = ""
    ts_id_col: str = "ts_id"
    date_col: str = "ds"
    target_col: str = "y"
    freq: str = "D"
    horizon: int = Field(28, gt=0)
    series_limit: int | None = Field(None, gt=0)


class Features(Block):
    holidays: tuple[str, ...] = ()
    calendars: dict[str, tuple[dt.date, ...]] = {}
    transform: Literal["none", "log1p", "boxcox"] = "none"
    exog: tuple[str, ...] = ()
    lags: tuple[int, ...] = ()
    fourier: bool = False
    level_shift: bool = False


class BacktestBlock(Block):
    enabled: bool = False
    scheme: Literal["expanding", "sliding"] = "expanding"
    n_folds: int = Field(3, gt=0)
    horizon: int = Field(28, gt=0)
    step: int = Field(28, gt=0)
    min_train: int = Field(180, gt=0)
    decision_metric: str = "wape"


class Hpo(Block):
    enabled: bool = False
    engine: str = "random"
    n_trials: int = Field(20, gt=0)
    granularity: Literal["fleetwide", "per_series"] = "fleetwide"
    sample_size: int = Field(20, gt=0)


class Ensemble(Block):
    enabled: bool = False
    strategies: tuple[Literal["mean", "median", "inverse_error", "nnls", "ridge", "xgb"], ...] = ("median",)
    prune_threshold: float = Field(0.0, ge=0)

    @model_validator(mode="before")
    @classmethod
    def one_strategy(cls, data: Any) -> Any:
        if isinstance(data, dict) and "strategy" in data:
            data = dict(data)
            data["strategies"] = (data.pop("strategy"),)
        return data


class Compute(Block):
    max_parallelism: int = Field(1000, gt=0)
    bucket_target_cells: int = Field(8, gt=0)
    persist_models: bool = False
    read_max_streams: int = 0
    families: dict[str, dict[str, Any]] = {}
    ensemble_mode: Literal["barrier", "microbatch"] = "barrier"
    microbatch_interval_s: int = Field(60, gt=0)


class RunConfig(Block):
    run_name: str = "run"
    data: Data = Data()
    python_runtime: Literal["spark"] = "spark"
    models: tuple[str, ...] = Field(min_length=1)
    features: Features = Features()
    backtest: BacktestBlock = BacktestBlock()
    hpo: Hpo = Hpo()
    ensemble: Ensemble = Ensemble()
    compute: Compute = Compute()

    @model_validator(mode="before")
    @classmethod
    def learned_need_backtest(cls, data: Any) -> Any:
        """Learned strategies go, with a warning, if there is no backtest to learn from."""
        if not isinstance(data, dict):
            return data
        block, ens = data.get("backtest") or {}, data.get("ensemble")
        on = block.get("enabled", False) if isinstance(block, dict) else block.enabled
        if isinstance(ens, dict) and ens.get("enabled") and not on:
            names = ens.get("strategies") or ([ens["strategy"]] if "strategy" in ens else ["median"])
            kept = tuple(s for s in names if s not in LEARNED)
            if len(kept) < len(names):
                logging.getLogger(__name__).warning("learned ensemble strategies need a backtest; dropped")
                data = {**data, "ensemble": {**{k: v for k, v in ens.items() if k != "strategy"}, "strategies": kept or ("median",)}}
        return data

    @model_validator(mode="after")
    def consistent(self) -> RunConfig:
        if len(set(self.models)) < len(self.models):
            raise ValueError("models are listed twice")
        if self.hpo.enabled and not self.backtest.enabled:
            raise ValueError("hpo needs a backtest")
        return self

    @model_validator(mode="after")
    def ignored(self) -> RunConfig:
        """Options that nothing reads here are named, not passed over."""
        unread = {"compute.read_max_streams": self.compute.read_max_streams, "features.level_shift": self.features.level_shift, "hpo.engine": self.hpo.engine not in ("random", "grid")}
        for family, own in self.compute.families.items():
            unread |= {f"compute.families.{family}.{k}": True for k in own if k not in PER_FAMILY}
        for name in (k for k, on in unread.items() if on):
            logging.getLogger(__name__).warning("the option %s has no effect in this engine", name)
        return self

    def for_family(self, family: str) -> RunConfig:
        """The configuration with a family's own compute settings over the common ones."""
        own = {k: v for k, v in self.compute.families.get(family, {}).items() if k in PER_FAMILY}
        return self.model_copy(update={"compute": self.compute.model_copy(update=own)}) if own else self

    def with_series_limit(self, n: int | None) -> RunConfig:
        return self.model_copy(update={"data": self.data.model_copy(update={"series_limit": n})}) if n else self

    @property
    def run_id(self) -> str:
        return ids.run_id(self.run_name, self.model_dump(mode="json"))

    def fanout(self, n_series: int | None) -> int | None:
        """Fits of a run, if the number of series is known."""
        n = n_series or self.data.series_limit
        return n * len(self.models) * (self.backtest.n_folds if self.backtest.enabled else 1) if n else None


def from_dict(data: dict[str, Any]) -> RunConfig:
    try:
        return RunConfig.model_validate(data)
    except ValidationError as e:
        raise ConfigError(str(e)) from e


def load_config(path: str | Path) -> RunConfig:
    try:
        data = json.loads(Path(path).read_text())
    except (OSError, ValueError) as e:
        raise ConfigError(f"{path}: {e}") from e
    return from_dict(data)


def load_config_uri(spark, uri: str) -> RunConfig:
    """From any file system that Spark reads."""
    try:
        return from_dict(json.loads("\n".join(r[0] for r in spark.read.text(uri, wholetext=True).collect())))
    except ValueError as e:
        raise ConfigError(f"{uri}: {e}") from e
