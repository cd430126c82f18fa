"""Features as columns: calendar parts, Fourier terms, lags and the design of lag models."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.panel import periods_per_year

#: fixed values: lags of the tree models' design
TREE_LAGS = (1, 2, 3, 7, 14, 28)


def calendar(panel: DataFrame) -> DataFrame:
    return panel.select("*", F.weekday("ds").alias("dow"), F.dayofmonth("ds").alias("dom"), F.month("ds").alias("month"), F.dayofyear("ds").alias("doy"))


def fourier(panel: DataFrame, freq: str = "D", order: int = 3) -> DataFrame:
    """Yearly sine and cosine pairs; the step is the day for daily series, else the series' own step."""
    period = periods_per_year(freq)
    t = F.unix_date("ds") if freq == "D" else F.row_number().over(Window.partitionBy("ts_id").orderBy("ds")) - 1
    angle = lambda k: t * (2 * math.pi * k / period)
    return panel.select("*", *(f(angle(k)).alias(f"{n}_{k}") for k in range(1, order + 1) for n, f in (("sin", F.sin), ("cos", F.cos))))


def lags(panel: DataFrame, steps: tuple[int, ...], target: str = "y") -> DataFrame:
    w = Window.partitionBy("ts_id").orderBy("ds")
    return panel.select("*", *(F.lag(target, k).over(w).alias(f"lag_{k}") for k in steps))


def tree_design(panel: DataFrame) -> DataFrame:
    """Lags and calendar parts, complete rows only."""
    return calendar(lags(panel, TREE_LAGS)).dropna(subset=[f"lag_{k}" for k in TREE_LAGS])
