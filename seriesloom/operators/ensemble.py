"""Blends of base forecasts as grouped weighted sums: no pivot, no collect of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.metrics import clean

AT = ["ts_id", "ds"]
BOUNDS = ("yhat_lower", "yhat_upper")
RIDGE = 1.0
#: complete rows that boosted trees are fitted on, at most
TREE_ROWS = 100_000


def mean(preds: DataFrame, at: list[str] = AT, values: tuple[str, ...] = ("yhat",)) -> DataFrame:
    return preds.groupBy(*at).agg(*(F.avg(clean(F.col(v))).alias(v) for v in values)).filter("yhat IS NOT NULL")


def median(preds: DataFrame, at: list[str] = AT, values: tuple[str, ...] = ("yhat",)) -> DataFrame:
    return preds.groupBy(*at).agg(*(F.median(clean(F.col(v))).alias(v) for v in values)).filter("yhat IS NOT NULL")


def prune(preds: DataFrame, scores: DataFrame, threshold: float, metric: str = "wape") -> DataFrame:
    """Drop models whose mean metric is over the threshold; 0 keeps all, and so does an undefined mean."""
    if threshold <= 0:
        return preds
    bad = scores.groupBy("model_type").agg(F.avg(clean(F.col(metric))).alias("m")).filter(F.col("m") > threshold)
    return preds.join(F.broadcast(bad.select("model_type")), "model_type", "leftanti")  # a row for each model


def inverse_error_weights(scores: DataFrame, metric: str = "wape", keys: list[str] | None = None) -> DataFrame:
    """Weight in proportion to 1 / mean metric; models without error share all; none finite: equal."""
    from pyspark.sql import Window

    keys = keys or []
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    m = scores.groupBy(*keys, "model_type").agg(F.avg(clean(F.col(metric))).alias("m"))
    zeros, known = F.count_if(F.col("m") == 0).over(w), F.count("m").over(w)
    raw = F.when(known == 0, 1.0).when(zeros > 0, F.when(F.col("m") == 0, 1.0).otherwise(0.0)).otherwise(F.coalesce(F.try_divide(F.lit(1.0), F.col("m")), F.lit(0.0)))
    m = m.withColumn("raw", raw)
    return m.select(*keys, "model_type", (F.col("raw") / F.sum("raw").over(w)).alias("weight"))


def apply_weights(preds: DataFrame, weights: DataFrame, at: list[str] = AT, values: tuple[str, ...] = ("yhat",)) -> DataFrame:
    """Weighted mean of each value over the models that have it, weights renormalised; points without weight go."""
    keys = [c for c in weights.columns if c != "weight"]
    small = F.broadcast(weights) if keys == ["model_type"] else weights  # fleet weights: a row for each model
    joined = preds.join(small, keys).filter(F.col("yhat").isNotNull() & ~F.isnan("yhat"))

    def share(v: str):
        has = F.col(v).isNotNull() & ~F.isnan(v)
        total = F.sum(F.when(has, F.col("weight")))
        return F.when(total > 0, F.try_divide(F.sum(F.when(has, F.col("weight") * F.col(v))), total)).alias(v)

    sums = [share(v) for v in values]
    return joined.groupBy(*at).agg(F.sum("weight").alias("total"), *sums).filter("total > 0").drop("total")


def complete_rows(oof: DataFrame, models: list[str], at: list[str] = (*AT, "fold_id")) -> DataFrame:
    """y and x0, x1, ...: the truth and all models' forecasts, where all are present."""
    cols = [F.first(F.when(F.col("model_type") == m, clean(F.col("yhat"))), ignorenulls=True).alias(f"x{i}") for i, m in enumerate(models)]
    return oof.groupBy(*at).agg(F.first("y").alias("y"), *cols).dropna(subset=[f"x{i}" for i in range(len(models))])


def gram(oof: DataFrame, models: list[str], at: list[str] = (*AT, "fold_id")) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X and X'y over rows where all models are present: one aggregation, k by k sums to the driver."""
    wide = complete_rows(oof, models, at)
    k = len(models)
    pairs = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    row = wide.agg(F.count("*").alias("n"), *pairs, *(F.sum(F.col(f"x{i}") * F.col("y")).alias(f"b{i}") for i in range(k))).first()
    if not row["n"]:
        raise EngineError("no row has forecasts of all models")
    g = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return g, np.array([row[f"b{i}"] for i in range(k)]), row["n"]


def ridge(g: np.ndarray, b: np.ndarray, alpha: float = RIDGE) -> np.ndarray:
    return np.linalg.solve(g + alpha * np.eye(len(b)), b)


def nnls(g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares with non-negative weights on the Gram form: active sets."""
    k = len(b)
    w, free = np.zeros(k), np.zeros(k, bool)
    for _ in range(3 * k + 10):
        slope = b - g @ w
        if free.all() or slope[~free].max() <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        free[np.where(free, -np.inf, slope).argmax()] = True
        while True:
            s = np.zeros(k)
            s[free] = np.linalg.lstsq(g[np.ix_(free, free)], b[free], rcond=None)[0]
            if s[free].min() > 0:
                w = s
                break
            low = free & (s <= 0)
            step = (w[low] / (w[low] - s[low])).min()
            w = w + step * (s - w)
            free &= w > 1e-12
            w[~free] = 0
            if not free.any():
                break
    return w


def tree_weights(oof: DataFrame, models: list[str], rows: int = TREE_ROWS) -> np.ndarray:
    """The models' importances in boosted trees, fitted on `rows` complete rows at most (those of the smallest hash)."""
    try:
        import xgboost
    except ImportError:
        raise EngineError("the xgb strategy needs the library xgboost: blend with ridge or nnls instead") from None
    at = [*AT, "fold_id"]
    wide = complete_rows(oof, models, at)
    table = wide.withColumn("h", F.xxhash64(*at)).orderBy("h", *at).limit(rows).drop("h", *at).toArrow()
    if not table.num_rows:
        raise EngineError("no row has forecasts of all models")
    x = np.column_stack([table.column(f"x{i}").to_numpy() for i in range(len(models))])
    found = xgboost.XGBRegressor(n_estimators=200, max_depth=3, learning_rate=0.1, random_state=0, n_jobs=1).fit(x, table.column("y").to_numpy())
    w = np.clip(np.asarray(found.feature_importances_, float), 0, None)
    return w / w.sum() if w.sum() > 0 else np.full(len(models), 1 / len(models))


def learned_weights(oof: DataFrame, strategy: str, models: list[str]) -> DataFrame:
    """(model_type, weight) of ridge, nnls or xgb over the run's out-of-fold rows."""
    if strategy == "xgb":
        w = tree_weights(oof, models)
    else:
        g, b, _ = gram(oof, models)
        w = ridge(g, b) if strategy == "ridge" else nnls(g, b)
    return oof.sparkSession.createDataFrame(list(zip(models, map(float, w), strict=True)), "model_type string, weight double")


def ready_series(preds: DataFrame, models: list[str]) -> DataFrame:
    """Series for which every base model has landed."""
    return preds.filter(F.col("model_type").isin(models)).groupBy("ts_id").agg(F.count_distinct("model_type").alias("n_models")).filter(F.col("n_models") == len(models))


def blend(strategy: str, preds: DataFrame, oof: DataFrame, scores: DataFrame, models: list[str], at: list[str] = AT) -> DataFrame:
    """One strategy's forecasts: mean, median, inverse_error, ridge, nnls or xgb; bounds, where preds has them, by the same weights."""
    values = ("yhat", *(c for c in BOUNDS if c in preds.columns))
    if strategy == "mean":
        return mean(preds, at, values)
    if strategy == "median":
        return median(preds, at, values)
    if strategy == "inverse_error":
        return apply_weights(preds, inverse_error_weights(scores), at, values)
    if strategy in ("ridge", "nnls", "xgb"):
        return apply_weights(preds, learned_weights(oof, strategy, models), at, values)
    raise EngineError(f"unknown ensemble strategy {strategy!r}")
