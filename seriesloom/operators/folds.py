"""Backtest folds by position from the end of each series, in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError


@dataclass(frozen=True)
class Backtest:
    n_folds: int = 3
    horizon: int = 28
    step: int = 28
    min_train: int = 180
    scheme: str = "expanding"

    def back_steps(self) -> list[tuple[int, int]]:
        """(fold, points from the end at which its validation starts)."""
        return [(k, self.horizon + (self.n_folds - 1 - k) * self.step) for k in range(self.n_folds)]

    def ranges(self, n: int) -> list[tuple[int, int, int, int, int]]:
        """(fold, train start, train end, validation start, validation end) for n points."""
        out = []
        for k, back in self.back_steps():
            start = n - back
            if k == 0 and start < self.min_train:
                raise ConfigError(f"{n} points are too few: the first fold would train on {start}")
            first = max(0, start - self.min_train) if self.scheme == "sliding" else 0
            out.append((k, first, start, start, start + self.horizon))
        return out


def split(panel: DataFrame, plan: Backtest) -> DataFrame:
    """Rows of every fold they take part in: ts_id, ds, y, fold_id, part (train or val), step (1 first in val)."""
    w = Window.partitionBy("ts_id")
    placed = panel.withColumn("pos", F.row_number().over(w.orderBy("ds"))).withColumn("n", F.count("*").over(w))
    folds = F.array(*(F.struct(F.lit(k).alias("fold_id"), F.lit(b).alias("back")) for k, b in plan.back_steps()))
    rows = placed.select("ts_id", "ds", "y", "pos", "n", F.inline(folds))
    step = F.col("pos") - (F.col("n") - F.col("back"))
    train = (step <= 0) & ((step > -plan.min_train) if plan.scheme == "sliding" else F.lit(True))
    val = (step > 0) & (step <= plan.horizon)
    return rows.withColumn("step", step).withColumn("part", F.when(train, "train").when(val, "val")).filter("part IS NOT NULL").select("ts_id", "fold_id", "ds", "y", "part", "step", "pos")
