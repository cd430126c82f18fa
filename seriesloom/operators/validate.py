"""Panel checks as set operations; every check returns its offenders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PanelError
from ..sources.panel import FREQS, grid


def duplicates(panel: DataFrame) -> DataFrame:
    return panel.groupBy("ts_id", "ds").agg(F.count("*").alias("n")).filter("n > 1")


def undated(panel: DataFrame) -> DataFrame:
    return panel.filter("ds IS NULL")


def off_grid(panel: DataFrame, freq: str = "D") -> DataFrame:
    """Points that no step from the series' first point reaches."""
    return panel.select("ts_id", "ds").join(grid(panel, freq), ["ts_id", "ds"], "leftanti")


def gaps(panel: DataFrame, freq: str = "D") -> DataFrame:
    """Steps without a point."""
    return grid(panel, freq).join(panel.select("ts_id", "ds"), ["ts_id", "ds"], "leftanti")


def required_history(horizon: int, backtest: dict | None = None) -> int:
    if not backtest:
        return horizon + 2
    return backtest["min_train"] + backtest["horizon"] + (backtest["n_folds"] - 1) * backtest["step"]


def short_series(panel: DataFrame, least: int) -> DataFrame:
    return panel.groupBy("ts_id").agg(F.count("*").alias("n")).filter(F.col("n") < least)


def report(panel: DataFrame) -> DataFrame:
    each = panel.groupBy("ts_id").agg(F.count("*").alias("n"), F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    return each.agg(F.count("*").alias("n_series"), F.sum("n").alias("n_rows"), F.min("lo").alias("first_ds"), F.max("hi").alias("last_ds"), F.min("n").alias("min_history"))


def parse_rows(raw: DataFrame, ts_id: str, date: str, target: str) -> DataFrame:
    """Rows whose date or number does not parse."""
    bad_date = F.expr(f"try_cast({date} AS timestamp_ntz)").isNull()
    bad_y = F.col(target).isNotNull() & F.expr(f"try_cast({target} AS double)").isNull()
    return raw.select(F.col(ts_id).alias("ts_id"), bad_date.alias("bad_date"), bad_y.alias("bad_target")).filter("bad_date OR bad_target")


def validate_panel(panel: DataFrame, freq: str = "D", least: int = 2) -> DataFrame:
    """Raise PanelError for the first failing check (smallest ts_id); else the report."""
    if freq not in FREQS:
        raise PanelError(f"frequency {freq!r} is not supported")
    if panel.isEmpty():
        raise PanelError("the panel has no rows")
    missing = {"ts_id", "ds", "y"} - set(panel.columns)
    if missing:
        raise PanelError(f"missing columns: {', '.join(sorted(missing))}")
    checks = ((undated(panel), "a date that is null"), (duplicates(panel), "a repeated date"), (off_grid(panel, freq), "a date off its grid"), (gaps(panel, freq), "a gap"), (short_series(panel, least), f"fewer than {least} points"))
    for found, what in checks:
        if row := found.orderBy("ts_id").select("ts_id").first():
            raise PanelError(f"series {row[0]!r} has {what}")
    return report(panel)
