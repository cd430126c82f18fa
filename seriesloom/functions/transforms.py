"""Target transforms as expressions, and the Box-Cox parameter by a set-based search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PanelError

#: the searched range of lambda, and the step of each pass
SEARCH = (-2.0, 2.0)


def forward(y: Column, kind: str, lam: Column | float | None = None) -> Column:
    if kind == "none":
        return y
    if kind == "log1p":
        return F.log1p(y)
    lam = lam if isinstance(lam, Column) else F.lit(lam)
    return F.when(lam == 0, F.ln(y)).otherwise((F.pow(y, lam) - 1) / lam)


def inverse(v: Column, kind: str, lam: Column | float | None = None) -> Column:
    if kind == "none":
        return v
    if kind == "log1p":
        return F.expm1(v)
    lam = lam if isinstance(lam, Column) else F.lit(lam)
    return F.when(lam == 0, F.exp(v)).otherwise(F.pow(lam * v + 1, 1 / lam))


def check_domain(panel: DataFrame, kind: str) -> None:
    """Raise if a series has values the transform does not take."""
    bad = {"log1p": "y < -1", "boxcox": "y <= 0"}.get(kind)
    if bad and (row := panel.filter(bad).orderBy("ts_id", "ds").select("ts_id").first()):
        raise PanelError(f"series {row[0]!r} has values that {kind} does not take")


def boxcox_likelihood(panel: DataFrame, grid: list[float]) -> DataFrame:
    """Log-likelihood of each lambda of the grid for each series, in one aggregation."""
    logs = panel.withColumn("ln_y", F.ln("y"))
    each = [F.struct(F.lit(g).alias("lam"), ((g - 1) * F.sum("ln_y") - F.count("*") / 2 * F.ln(F.var_pop(forward(F.col("y"), "boxcox", g)))).alias("llf")) for g in grid]
    return logs.groupBy("ts_id").agg(F.array(*each).alias("g")).select("ts_id", F.inline("g"))


def boxcox_lambda(panel: DataFrame, passes: int = 3, points: int = 17) -> DataFrame:
    """(ts_id, lam) of the greatest likelihood: a grid for all series, then finer ones around the fleet's range."""
    lo, hi = SEARCH
    best = None
    for _ in range(passes):
        grid = [float(g) for g in np.round(np.linspace(lo, hi, points), 6)]
        best = boxcox_likelihood(panel, grid).groupBy("ts_id").agg(F.max_by("lam", "llf").alias("lam"))
        a, b = best.agg(F.min("lam"), F.max("lam")).first()
        if a is None:
            break
        step = (hi - lo) / (points - 1)
        lo, hi = max(SEARCH[0], a - step), min(SEARCH[1], b + step)
    return best
