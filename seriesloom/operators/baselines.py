"""Forecast models that are pure expressions over the rows of a fold split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["ts_id", "fold_id"]


def _train(rows: DataFrame) -> DataFrame:
    return rows.filter("part = 'train'")


def _val(rows: DataFrame) -> DataFrame:
    return rows.filter("part = 'val'")


def _out(rows: DataFrame, name: str, yhat) -> DataFrame:
    return rows.select("ts_id", F.lit(name).alias("model_type"), "fold_id", "ds", "step", "y", yhat.alias("yhat"))


def seasonal_naive(rows: DataFrame, period: int = 7) -> DataFrame:
    """The last season again: step h repeats the training row at step ((h - 1) mod period) + 1 - period."""
    last = _train(rows).filter(F.col("step") > -period).select(*KEYS, F.col("step").alias("s"), F.col("y").alias("last"))
    val = _val(rows).withColumn("s", F.pmod(F.col("step") - 1, F.lit(period)) + 1 - period)
    return _out(val.join(last, [*KEYS, "s"]), "seasonal_naive", F.col("last"))


def _by_fold(rows: DataFrame, name: str, stats: list, yhat) -> DataFrame:
    return _out(_val(rows).join(_train(rows).groupBy(*KEYS).agg(*stats), KEYS), name, yhat)


def naive(rows: DataFrame) -> DataFrame:
    return _by_fold(rows, "naive", [F.max_by("y", "ds").alias("last")], F.col("last"))


def mean(rows: DataFrame) -> DataFrame:
    return _by_fold(rows, "mean", [F.avg("y").alias("m")], F.col("m"))


def drift(rows: DataFrame) -> DataFrame:
    stats = [F.min_by("y", "ds").alias("a"), F.max_by("y", "ds").alias("b"), F.count("*").alias("n")]
    return _by_fold(rows, "drift", stats, F.col("b") + F.col("step") * (F.col("b") - F.col("a")) / (F.col("n") - 1))


def linear_trend(rows: DataFrame) -> DataFrame:
    stats = [F.regr_slope("y", "pos").alias("b"), F.regr_intercept("y", "pos").alias("a")]
    return _by_fold(rows, "linear_trend", stats, F.col("a") + F.col("b") * F.col("pos"))


def ses(rows: DataFrame, alpha: float = 0.2) -> DataFrame:
    """Simple exponential smoothing with a fixed weight, as a fold over the sorted history."""
    ordered = F.sort_array(F.collect_list(F.struct("ds", "y")))
    values = F.transform(ordered, lambda r: r["y"])
    level = F.aggregate(F.slice(F.col("v"), F.lit(2), F.size("v")), F.col("v")[0], lambda acc, x: acc * (1 - alpha) + x * alpha)
    stats = _train(rows).groupBy(*KEYS).agg(values.alias("v")).select(*KEYS, level.alias("level"))
    return _out(_val(rows).join(stats, KEYS), "ses", F.col("level"))


ALL = {"seasonal_naive": seasonal_naive, "naive": naive, "mean": mean, "drift": drift, "linear_trend": linear_trend, "ses": ses}


def out_of_fold(rows: DataFrame, models: tuple[str, ...], period: int = 7) -> DataFrame:
    """Forecasts of several models in one pass: one aggregation of each fold's training rows, one join, one row for each model."""
    y, step, n = F.col("y"), F.col("step"), F.col("n")
    last = F.map_from_entries(F.collect_list(F.when(step > -period, F.struct("step", "y"))))
    every = {
        "seasonal_naive": ([last.alias("last")], F.try_element_at("last", F.pmod(step - 1, F.lit(period)) + 1 - period)),
        "naive": ([F.max_by("y", "ds").alias("b")], F.col("b")),
        "mean": ([F.avg("y").alias("m")], F.col("m")),
        "drift": ([F.min_by("y", "ds").alias("a"), F.max_by("y", "ds").alias("b"), F.count("*").alias("n")], F.col("b") + step * (F.col("b") - F.col("a")) / (n - 1)),
        "linear_trend": ([F.regr_slope("y", "pos").alias("slope"), F.regr_intercept("y", "pos").alias("icpt")], F.col("icpt") + F.col("slope") * F.col("pos")),
    }
    others = [m for m in models if m not in every]
    stats = {str(c): c for m in models if m in every for c in every[m][0]}
    out = None
    if stats:
        each = [F.struct(F.lit(m).alias("model_type"), every[m][1].cast("double").alias("yhat")) for m in models if m in every]
        joined = _val(rows).join(_train(rows).groupBy(*KEYS).agg(*stats.values()), KEYS)
        out = joined.select("ts_id", "fold_id", "ds", "step", y, F.inline(F.array(*each))).filter("model_type <> 'seasonal_naive' OR yhat IS NOT NULL")
        out = out.select("ts_id", "model_type", "fold_id", "ds", "step", "y", "yhat")
    for m in others:
        out = ALL[m](rows) if out is None else out.unionByName(ALL[m](rows))
    return out
