"""Cells: every series with every model, fitted, backtested and forecast in one grouped map.

A cell's history is packed into one row before models multiply it, so the
cross with the model list copies rows and not points, and the exchange before
fitting moves whole series.  Results come back as nested rows and are exploded
into the three cell tables; nothing is written from inside a task.
"""

from __future__ import annotations

import datetime as dt
import itertools
import json
import math
import socket
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.holidays import us_holidays
from ..functions.metrics import NAMES
from ..plans.config import RunConfig
from ..sources.panel import periods_per_year, seasonal_period
from .folds import Backtest

SPAN = "ds timestamp_ntz, yhat double, yhat_lower double, yhat_upper double, quantiles string"
CELL = (
    "ts_id string, model_type string, status string, error string, fit_seconds double, predict_seconds double, "
    f"best_params string, worker_id string, cell_started_at timestamp, cell_ended_at timestamp, model_artifact binary, "
    f"predictions array<struct<{SPAN.replace(' ', ':').replace(',:', ',')}>>, "
    "oof array<struct<fold_id:int,ds:timestamp_ntz,y_true:double,yhat:double>>, "
    f"folds array<struct<fold_id:int,{','.join(f'{n}:double' for n in NAMES)}>>"
)


def bucket_count(cfg: RunConfig, n_series: int | None, n_models: int | None = None) -> int:
    """Partitions for the fits: cells over the target for each, 1 to 100,000."""
    if not n_series:
        return cfg.compute.max_parallelism
    return min(100_000, max(1, math.ceil(n_series * (n_models or len(cfg.models)) / cfg.compute.bucket_target_cells)))


def variants(models: list[str], params: dict[str, dict | list[dict]] | None) -> list[tuple[str, dict]]:
    """(model, parameters) of every fit of a series: one for each model, or one for each of a list of trials."""
    own = {m: (params or {}).get(m, {}) for m in models}
    return [(m, p) for m, ps in own.items() for p in (ps if isinstance(ps, list) else [ps])]


def cross_models(spark: SparkSession, packed: DataFrame, models: list[str], params: dict[str, dict | list[dict]] | None = None) -> DataFrame:
    rows = [(m, json.dumps(p)) for m, p in variants(models, params)]
    return packed.crossJoin(F.broadcast(spark.createDataFrame(rows, "model_type string, params string")))  # the config's list


def pack(panel: DataFrame, exog: tuple[str, ...] = ()) -> DataFrame:
    """One row for each series, its points sorted by date."""
    point = F.struct("ds", "y", *exog)
    return panel.groupBy("ts_id").agg(F.sort_array(F.collect_list(point)).alias("points"))


def packed_panel(panel: DataFrame, exog: tuple[str, ...] = ()) -> DataFrame:
    """What run_cells packs by itself; pack once and write it where several runs read it."""
    return pack(panel.select("ts_id", F.col("ds").cast("timestamp_ntz").alias("ds"), "y", *exog), exog)


def metric_values(y: np.ndarray, yhat: np.ndarray, train: np.ndarray) -> dict[str, float]:
    """The panel of one fold, for rows that never leave the worker; undefined is NaN."""
    e, nan = yhat - y, float("nan")
    d = np.diff(train)
    mae, mse = np.abs(e).mean(), (e * e).mean()
    size = np.abs(y) + np.abs(yhat)
    return dict(
        zip(
            NAMES,
            (
                mae,
                mse,
                math.sqrt(mse),
                e.mean(),
                nan if (y == 0).any() else (np.abs(e) / np.abs(y)).mean(),
                np.where(size == 0, 0, 2 * np.abs(e) / np.where(size == 0, 1, size)).mean(),
                np.abs(e).sum() / np.abs(y).sum() if np.abs(y).sum() else nan,
                mae / np.abs(d).mean() if len(d) and np.abs(d).mean() else nan,
                math.sqrt(mse) / math.sqrt((d * d).mean()) if len(d) and (d * d).mean() else nan,
                nan,
                nan,
            ),
            strict=True,
        )
    )


def transform(y: np.ndarray, kind: str, lam: float | None) -> np.ndarray:
    if kind == "log1p":
        return np.log1p(y)
    return y if kind == "none" else np.log(y) if lam == 0 else (y**lam - 1) / lam


def restore(v: np.ndarray, kind: str, lam: float | None) -> np.ndarray:
    if kind == "log1p":
        return np.expm1(v)
    return v if kind == "none" else np.exp(v) if lam == 0 else np.maximum(lam * v + 1, 1e-12) ** (1 / lam)


def fit_lambda(y: np.ndarray) -> float:
    """The Box-Cox parameter of greatest likelihood, by golden section on [-2, 2]."""
    if (y <= 0).any():
        raise ValueError("boxcox needs positive values")
    logs = np.log(y).sum()
    f = lambda k: (k - 1) * logs - len(y) / 2 * np.log(max(transform(y, "boxcox", 0 if abs(k) < 1e-9 else k).var(), 1e-300))
    lo, hi, g = -2.0, 2.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if f(a) > f(b) else (a, hi)
    return (lo + hi) / 2


def future_dates(last: pd.Timestamp, freq: str, h: int) -> pd.DatetimeIndex:
    if freq == "W":  # weeks keep the series' own weekday
        return pd.date_range(last, periods=h + 1, freq="7D")[1:]
    return pd.date_range(last, periods=h + 1, freq=freq)[1:]


def design(ds: pd.DatetimeIndex, y: np.ndarray, exog: np.ndarray | None, cfg: RunConfig, days: frozenset) -> tuple[np.ndarray | None, np.ndarray | None]:
    """Regressors of the history and of the horizon.

    Holidays and Fourier terms are the dates' own; later exog values repeat the
    first ones; lags shorter than the horizon would need values that a
    forecast does not have, so they are left out.
    """
    f, h, n = cfg.features, cfg.data.horizon, len(ds)
    reach = max(h, cfg.backtest.horizon if cfg.backtest.enabled else 0)
    dates = ds.append(future_dates(ds[-1], cfg.data.freq, h))
    cols = [] if exog is None else [np.concatenate([c, np.resize(c, h)]) for c in exog.T]
    if f.holidays:
        cols.append(np.array([d.date() in days for d in dates], float))
    if f.fourier:
        t = (dates - pd.Timestamp(0)).days.to_numpy(float) if cfg.data.freq == "D" else np.arange(n + h, dtype=float)
        cols += [g(2 * np.pi * k * t / periods_per_year(cfg.data.freq)) for k in (1, 2, 3) for g in (np.sin, np.cos)]
    for k in f.lags:
        if k >= reach:
            cols.append(np.concatenate([np.full(k, y[0]), y, np.full(h, y[-1])])[: n + h])
    if not cols:
        return None, None
    x = np.column_stack(cols)
    return x[:n], x[n:]


def run_cell(ts_id: str, model: str, params: dict, ds: pd.DatetimeIndex, y: np.ndarray, exog: np.ndarray | None, cfg: RunConfig, days: frozenset = frozenset()) -> dict:
    """Fit, backtest and forecast one cell.  A failure becomes status 'error', never an exception."""
    from ..models import create

    started, clock = dt.datetime.now(), time.perf_counter()
    out = {"ts_id": ts_id, "model_type": model, "status": "ok", "error": None, "fit_seconds": None, "predict_seconds": None, "best_params": json.dumps(params) if params else None, "worker_id": socket.gethostname(), "cell_started_at": started, "model_artifact": None, "predictions": [], "oof": [], "folds": []}
    try:
        kind, period = cfg.features.transform, seasonal_period(cfg.data.freq)
        lam = fit_lambda(y) if kind == "boxcox" else None
        v = transform(y, kind, lam)
        x, later = design(ds, v, exog, cfg, days)
        new = lambda: create(model, **{"period": period, **params})
        if cfg.backtest.enabled:
            b = cfg.backtest
            for k, lo, hi, start, end in Backtest(b.n_folds, b.horizon, b.step, b.min_train, b.scheme).ranges(len(y)):
                fold = new().fit(v[lo:hi], None if x is None else x[lo:hi])
                yhat = restore(fold.predict(end - start, None if x is None else x[start:end])[0.5], kind, lam)
                out["oof"] += [{"fold_id": k, "ds": d.to_pydatetime(), "y_true": float(t), "yhat": float(p)} for d, t, p in zip(ds[start:end], y[start:end], yhat, strict=True)]
                out["folds"].append({"fold_id": k, **{n: float(m) for n, m in metric_values(y[start:end], yhat, y[lo:hi]).items()}})
        fitted = new().fit(v, x)
        out["fit_seconds"] = time.perf_counter() - clock
        clock, h = time.perf_counter(), cfg.data.horizon
        q = {k: restore(a, kind, lam) for k, a in fitted.predict(h, later).items()}
        lo, hi = min(q), max(q)
        for i, d in enumerate(future_dates(ds[-1], cfg.data.freq, h)):
            text = json.dumps({str(k): float(a[i]) for k, a in q.items() if math.isfinite(a[i])})
            out["predictions"].append({"ds": d.to_pydatetime(), "yhat": float(q[0.5][i]), "yhat_lower": float(q[lo][i]), "yhat_upper": float(q[hi][i]), "quantiles": text})
        out["predict_seconds"] = time.perf_counter() - clock
        if cfg.compute.persist_models:
            try:
                out["model_artifact"] = fitted.serialize()
            except Exception:  # noqa: BLE001  a model that cannot be stored still forecasts
                out["model_artifact"] = None
    except Exception as e:  # noqa: BLE001  a cell's failure is data
        out |= {"status": "error", "error": f"{type(e).__name__}: {e}"[:500], "predictions": [], "oof": [], "folds": []}
    out["cell_ended_at"] = dt.datetime.now()
    return out


def holiday_days(codes: tuple[str, ...], tables: dict[str, tuple] | None = None) -> frozenset:
    """Dates of the countries, by rule or from the configuration's own calendars."""
    days: set[dt.date] = set()
    for c in codes:
        if tables and c in tables:
            days |= set(tables[c])
        elif c == "US":
            days |= {d for d, _ in us_holidays()}
        else:
            raise ConfigError(f"unknown holiday country code {c!r}")
    return frozenset(days)


def run_cells(panel: DataFrame, cfg: RunConfig, params: dict[str, dict | list[dict]] | None = None, n_series: int | None = None, by_series: DataFrame | None = None) -> DataFrame:
    """One row for each cell.  by_series: (ts_id, model_type, best_params) that overrides the models' params."""
    from ..sources.workers import on_workers

    spark, exog = panel.sparkSession, cfg.features.exog
    on_workers(spark)
    packed = panel if "points" in panel.columns else packed_panel(panel, exog)
    todo = cross_models(spark, packed, list(cfg.models), params)
    if by_series is not None:
        todo = todo.join(by_series, ["ts_id", "model_type"], "left").withColumn("params", F.coalesce("best_params", "params")).drop("best_params")
    days = holiday_days(cfg.features.holidays, cfg.features.calendars)
    n_variants = len(variants(list(cfg.models), params))
    todo = todo.repartition(bucket_count(cfg, n_series or cfg.data.series_limit, n_variants), "ts_id", "model_type", "params")

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                pts = list(r.points)
                get = (lambda p, k: p[k]) if isinstance(pts[0], dict) else getattr
                ds = pd.DatetimeIndex([get(p, "ds") for p in pts])
                x = np.array([[get(p, k) for k in exog] for p in pts], float) if exog else None
                rows.append(run_cell(r.ts_id, r.model_type, json.loads(r.params), ds, np.array([get(p, "y") for p in pts], float), x, cfg, days))
            yield pd.DataFrame(rows, columns=[c.strip().split()[0] for c in _top_level(CELL)])

    return todo.mapInPandas(fit, CELL)


def _top_level(schema: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def predictions(cells: DataFrame) -> DataFrame:
    return cells.select("ts_id", "model_type", F.inline("predictions")).withColumnRenamed("ds", "forecast_date")


def out_of_fold(cells: DataFrame) -> DataFrame:
    return cells.select("ts_id", "model_type", F.inline("oof")).withColumnRenamed("ds", "forecast_date")


def metadata(cells: DataFrame) -> DataFrame:
    """One summary row for each cell, its metrics averaged over folds where defined."""
    def mean(n: str):
        kept = F.filter(F.transform("folds", lambda f: f[n]), lambda v: v.isNotNull() & ~F.isnan(v))
        return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, v: a + v) / F.size(kept)).alias(n)

    plain = ["ts_id", "model_type", "status", "error", "fit_seconds", "predict_seconds", "best_params", "worker_id", "cell_started_at", "cell_ended_at"]
    plain.append(F.col("model_artifact").isNotNull().alias("has_artifact"))
    return cells.select(*plain, F.lit("spark").alias("compute_engine"), *(mean(n) for n in NAMES))


def trials_of(cfg: RunConfig, seed: int) -> dict[str, list[dict]]:
    """Each model's trials: its whole search space if that is no more than n_trials or the engine is 'grid', else seeded draws, each once."""
    from ..models import registered

    rng, out = np.random.default_rng(seed), {}
    for m in cfg.models:
        if space := registered()[m]().search_space():
            size = math.prod(map(len, space.values()))
            if cfg.hpo.engine == "grid" or size <= cfg.hpo.n_trials:  # the whole space fits the trials
                drawn = [tuple(sorted(zip(space, v, strict=True))) for v in itertools.product(*space.values())]
            else:
                drawn = [tuple(sorted((k, v[int(rng.integers(len(v)))]) for k, v in space.items())) for _ in range(cfg.hpo.n_trials)]
            out[m] = [dict(t) for t in sorted(set(drawn))]
    return out


def scored_trials(panel: DataFrame, cfg: RunConfig, seed: int, n_series: int | None) -> DataFrame | None:
    """Metadata of every trial: (ts_id, model_type, best_params, metrics); one scan and one exchange for all of them."""
    trials = trials_of(cfg, seed)
    return metadata(run_cells(panel, cfg.model_copy(update={"models": tuple(trials)}), trials, n_series)) if trials else None


def _score(cfg: RunConfig):
    """What a trial is ranked by, the least best; undefined comes last."""
    metric = cfg.backtest.decision_metric
    mean = F.avg(metric)
    return F.coalesce({"coverage": -mean, "bias": F.abs(mean)}.get(metric, mean), F.lit(float("inf")))


def tune(panel: DataFrame, cfg: RunConfig, seed: int = 11) -> dict[str, dict]:
    """Each model's parameters with the best mean decision metric over sampled series."""
    ids = panel.select("ts_id").distinct().orderBy("ts_id").limit(cfg.hpo.sample_size)  # a packed panel has one row for each series
    sample = panel.join(F.broadcast(ids), "ts_id", "leftsemi")  # sample_size ids
    rows = scored_trials(sample, cfg, seed, cfg.hpo.sample_size)
    if rows is None:
        return {}
    each = rows.groupBy("model_type", "best_params").agg(_score(cfg).alias("s"))
    best = each.groupBy("model_type").agg(F.min_by("best_params", F.struct("s", "best_params")).alias("p")).collect()  # a row for each model
    return {r.model_type: json.loads(r.p) for r in best}


def tune_by_series(panel: DataFrame, cfg: RunConfig, seed: int = 11, n_series: int | None = None) -> DataFrame | None:
    """(ts_id, model_type, best_params): every series' own best trial."""
    rows = scored_trials(panel, cfg, seed, n_series)
    if rows is None:
        return None
    each = rows.groupBy("ts_id", "model_type", "best_params").agg(_score(cfg).alias("s"))
    return each.groupBy("ts_id", "model_type").agg(F.min_by("best_params", F.struct("s", "best_params")).alias("best_params"))
