"""Panels: long (ts_id, ds, y) frames, their scans, subsets and calendars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError

#: fixed values: step of each frequency as a Spark interval, seasonal period, periods in a year
FREQS = {
    "D": ("INTERVAL 1 DAY", 7, 365.25),
    "W": ("INTERVAL 7 DAY", 52, 52.18),
    "MS": ("INTERVAL 1 MONTH", 12, 12.0),
    "ME": ("INTERVAL 1 MONTH", 12, 12.0),
    "h": ("INTERVAL 1 HOUR", 24, 8766.0),
}


def seasonal_period(freq: str) -> int:
    return FREQS.get(freq, ("", 7, 365.25))[1]


def periods_per_year(freq: str) -> float:
    return FREQS.get(freq, ("", 7, 365.25))[2]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_panel(df: DataFrame, ts_id: str = "ts_id", date: str = "ds", target: str = "y", exog: tuple[str, ...] = (), freq: str = "D") -> DataFrame:
    """Business columns under their roles; only these reach the scan."""
    ds = F.col(date).cast("timestamp_ntz" if freq == "h" else "date")
    return df.select(F.col(ts_id).cast("string").alias("ts_id"), ds.alias("ds"), F.col(target).cast("double").alias("y"), *exog)


def limit_series(panel: DataFrame, n: int) -> DataFrame:
    """The first n series by id."""
    ids = panel.select("ts_id").distinct().orderBy("ts_id").limit(n)
    return panel.join(ids, "ts_id", "leftsemi")


def series_ids(panel: DataFrame) -> DataFrame:
    return panel.select("ts_id").distinct().orderBy("ts_id")


def history(panel: DataFrame) -> DataFrame:
    return panel.select("ts_id", "ds", "y").orderBy("ts_id", "ds")


def grid(panel: DataFrame, freq: str = "D") -> DataFrame:
    """Every step from each series' first to last point."""
    ends = panel.groupBy("ts_id").agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    if freq == "ME":  # month ends are stepped by month and clamped, never by 28 or 30 days
        months = F.expr("sequence(trunc(lo, 'MM'), trunc(hi, 'MM'), INTERVAL 1 MONTH)")
        return ends.select("ts_id", F.explode(F.transform(months, F.last_day)).alias("ds"))
    return ends.select("ts_id", F.explode(F.expr(f"sequence(lo, hi, {FREQS[freq][0]})")).alias("ds"))


def fill_calendar(panel: DataFrame, freq: str = "D", value: float = 0.0) -> DataFrame:
    """The panel on its whole grid; missing targets get `value`."""
    return grid(panel, freq).join(panel, ["ts_id", "ds"], "left").withColumn("y", F.coalesce("y", F.lit(value)))


def resolve(spark: SparkSession, name: str) -> DataFrame:
    """A source by name: a path (with a slash), else a table or view of the session's catalog."""
    return spark.read.parquet(name) if "/" in name and "`" not in name else spark.table(name)


def snapshot_files(df: DataFrame) -> list[str]:
    """The files a scan reads now; none if it reads no files."""
    return sorted(df.inputFiles())


def read_snapshot(spark: SparkSession, files: list[str]) -> DataFrame:
    """Exactly the recorded files, whatever was added to the folder since."""
    return spark.read.parquet(*files)


def sample_series(panel: DataFrame, n: int, limit: int = 1000) -> pa.Table:
    """The points of the first n series (`limit` at most) on the driver."""
    if not 0 < n <= limit:
        raise ConfigError(f"a sample has 1 to {limit} series, not {n}")
    return history(limit_series(panel, n)).toArrow()


def daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity shipped each day, by return flag."""
    rows = load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("ts_id"), F.to_date("l_shipdate").alias("ds"))
    return rows.agg(F.sum("l_quantity").alias("y"))


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders each month, by priority."""
    rows = load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("ts_id"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("ds"))
    return rows.agg(F.count("*").cast("double").alias("y"))


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events each day, by type."""
    rows = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("ts_id"), F.to_date("ts").alias("ds"))
    return rows.agg(F.count("*").cast("double").alias("y"))
