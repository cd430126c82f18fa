"""The panel of eleven metrics as aggregate expressions over (y, yhat[, lower, upper])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed order of the panel
NAMES = ("mae", "mse", "rmse", "bias", "mape", "smape", "wape", "mase", "rmsse", "coverage", "pinball")


def clean(c: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def _pinball(y: Column, q_hat: Column, q: float) -> Column:
    d = y - q_hat
    return F.when(d >= 0, q * d).otherwise((q - 1) * d)


def metric_aggregates(y: str = "y", yhat: str = "yhat", lower: str | None = None, upper: str | None = None, naive_mae: str | None = None, naive_mse: str | None = None) -> list[Column]:
    """One aggregate for each metric; NULL where it is undefined.

    naive_mae and naive_mse are the training series' mean absolute and squared
    one-step differences, constant within a group.
    """
    t, p = F.col(y), F.col(yhat)
    e = p - t
    mae, mse = F.avg(F.abs(e)), F.avg(e * e)
    none = F.lit(None).cast("double")
    total = F.abs(t) + F.abs(p)
    out = {
        "mae": mae,
        "mse": mse,
        "rmse": F.sqrt(mse),
        "bias": F.avg(e),
        "mape": F.when(F.count_if(t == 0) == 0, F.avg(F.try_divide(F.abs(e), F.abs(t)))),
        "smape": F.avg(F.when(total == 0, 0.0).otherwise(F.try_divide(2 * F.abs(e), total))),
        "wape": F.try_divide(F.sum(F.abs(e)), F.sum(F.abs(t))),
        "mase": F.try_divide(mae, F.max(naive_mae)) if naive_mae else none,
        "rmsse": F.try_divide(F.sqrt(mse), F.sqrt(F.max(naive_mse))) if naive_mse else none,
        "coverage": none,
        "pinball": none,
    }
    if lower and upper:
        lo, hi = F.col(lower), F.col(upper)
        out["coverage"] = F.avg(F.when((t >= lo) & (t <= hi), 1.0).otherwise(0.0))
        out["pinball"] = (F.avg(_pinball(t, lo, 0.1)) + F.avg(_pinball(t, hi, 0.9))) / 2
    return [out[n].alias(n) for n in NAMES]


def naive_scale(train: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute and squared one-step difference of each training series."""
    d = F.col("y") - F.lag("y").over(Window.partitionBy(*keys).orderBy("ds"))
    return train.withColumn("d", d).groupBy(*keys).agg(F.avg(F.abs("d")).alias("naive_mae"), F.avg(F.col("d") * F.col("d")).alias("naive_mse"))


def rollup(folds: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of each metric over folds, undefined folds left out."""
    return folds.groupBy(*keys).agg(*(F.avg(clean(F.col(n))).alias(n) for n in NAMES))


def residual_quantiles(oof: DataFrame, keys: list[str], quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Exact, linearly interpolated quantiles of y - yhat."""
    q = F.percentile(F.col("y") - F.col("yhat"), F.array(*map(F.lit, quantiles)))
    return oof.groupBy(*keys).agg(q.alias("q")).select(*keys, *(F.col("q")[i].alias(f"q{round(100 * v):02d}") for i, v in enumerate(quantiles)))
