"""Synthetic panels as expressions: five archetypes, each value from a hash of seed, series and step.

A series is made in the JVM from arrays over its steps, so it depends on (seed,
index) alone, whatever partition makes it, and nothing is shuffled.  Noise is a
moving average of hashed uniform shocks with geometric weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions import holidays
from .panel import FREQS, periods_per_year, seasonal_period

#: fixed values: archetypes in the order that a series' index picks them
ARCHETYPES = ("trend", "seasonal", "intermittent", "level_shift", "noise")
#: shocks that a point's noise remembers
MEMORY = 8
#: effect of a holiday and of a spike on a value, and of the price index on the level
HOLIDAY, SPIKE, PRICE = 1.2, 1.5, -0.1


def uniform(seed: int, *key: Column | str) -> Column:
    """A number in [0, 1) from 32 bits of an md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k if isinstance(k, Column) else F.lit(k) for k in key))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 2**32


def partitions_for(n_series: int) -> int:
    """About two thousand series a task, 512 tasks at most."""
    return min(512, max(1, math.ceil(n_series / 2000)))


def generate_panel(spark: SparkSession, n_series: int, periods: int = 1460, seed: int = 20260726, start: str = "2022-01-01", freq: str = "D", exog: bool = False, spike_rate: float = 0.0, holiday_effect: bool = False) -> DataFrame:
    """ts_id, archetype, ds, y (and price_index): `periods` points of each series."""
    if freq not in FREQS:
        raise ConfigError(f"frequency {freq!r} is not supported")
    season, year = seasonal_period(freq), periods_per_year(freq)
    i = F.col("id").cast("string")
    own = lambda name: uniform(seed, i, name)
    kinds = F.array(*map(F.lit, ARCHETYPES))
    series = spark.range(0, n_series, 1, partitions_for(n_series)).select(
        "id",
        F.format_string("s_%06d", "id").alias("ts_id"),
        F.element_at(kinds, (F.col("id") % len(ARCHETYPES)).cast("int") + 1).alias("archetype"),
        (20 + 180 * own("level")).alias("level"),
        (0.05 + 0.25 * own("amp")).alias("amp"),
        F.floor(own("phase") * season).alias("phase"),
        (0.1 + 0.5 * own("phi")).alias("phi"),
        (0.02 + 0.18 * own("slope")).alias("slope"),
        F.floor(periods / 4 + own("jump") * periods / 2).alias("jump"),
    )
    shocks = F.transform(F.sequence(F.lit(1 - MEMORY), F.lit(periods - 1)), lambda t: uniform(seed, i, t.cast("string"), "e") - 0.5)
    rows = series.withColumn("shocks", shocks)
    rows = rows.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(periods - 1))))
    noise = sum((F.pow("phi", F.lit(k)) * F.element_at("shocks", F.col("t") + MEMORY - k) for k in range(MEMORY)), F.lit(0.0))
    week = F.col("amp") * F.col("level") * F.sin(2 * math.pi * (F.col("t") + F.col("phase")) / season)
    y = F.col("level") + 0.17 * F.col("level") * noise
    keep = uniform(seed, i, F.col("t").cast("string"), "keep") < 0.3
    y = (
        F.when(F.col("archetype") == "trend", y + F.col("slope") * F.col("level") * F.col("t") / 100 + week)
        .when(F.col("archetype") == "seasonal", y + 2 * week + 0.2 * F.col("level") * F.sin(2 * math.pi * F.col("t") / year))
        .when(F.col("archetype") == "intermittent", F.when(keep, y).otherwise(0.0))
        .when(F.col("archetype") == "level_shift", y + F.when(F.col("t") > F.col("jump"), 0.5 * F.col("level")).otherwise(0.0) + week)
        .otherwise(y)
    )
    price = 1 + 0.1 * F.cos(2 * math.pi * F.col("t") / 30)
    if exog:
        y = y + PRICE * F.col("level") * (price - 1) * 10
    if spike_rate:
        y = y * F.when(uniform(seed, i, F.col("t").cast("string"), "spike") < spike_rate, SPIKE).otherwise(1.0)
    at = {"D": F.date_add(F.lit(start).cast("date"), F.col("t")), "W": F.date_add(F.lit(start).cast("date"), 7 * F.col("t")), "MS": F.add_months(F.trunc(F.lit(start), "month"), F.col("t")), "ME": F.last_day(F.add_months(F.trunc(F.lit(start), "month"), F.col("t")))}
    ds = at[freq] if freq in at else F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("t"))
    out = rows.select("ts_id", "archetype", ds.alias("ds"), y.alias("y"), price.alias("price_index"))
    if holiday_effect:
        days = holidays.holiday_frame(spark, ["US"])
        out = holidays.flag(out.withColumn("day", F.to_date("ds")), days, "day").withColumn("y", F.col("y") * F.when(F.col("is_holiday"), HOLIDAY).otherwise(1.0)).drop("day", "is_holiday")
    return out.select("ts_id", "archetype", "ds", F.round(F.greatest("y", F.lit(0.0)), 3).alias("y"), *(["price_index"] if exog else []))


def source_rows(panel: DataFrame, codes: tuple[str, ...] = ("US",)) -> DataFrame:
    """The source table's columns from a panel, whatever their types: keys as text, days as dates, a holiday flag; rows without a key go."""
    rows = panel.select(F.col("ts_id").cast("string").alias("ts_id"), F.to_date("ds").alias("ds"), F.col("y").cast("double").alias("y"), *([F.col("archetype").cast("string").alias("archetype")] if "archetype" in panel.columns else [F.lit(None).cast("string").alias("archetype")]))
    return holidays.flag(rows.filter("ts_id IS NOT NULL AND ds IS NOT NULL"), holidays.holiday_frame(panel.sparkSession, list(codes))).select("ts_id", "ds", "y", "archetype", "is_holiday")


def seed_tables(spark: SparkSession, root: str, n_series: int = 100_000, periods: int = 1460, seed: int = 20260726, formats: tuple[str, ...] = ("parquet", "orc"), reseed: bool = False) -> dict[str, str]:
    """Write one generated source table in every format, made once; {format: path}.  A table that is there stays, unless reseeded."""
    rows = source_rows(generate_panel(spark, n_series, periods, seed)).persist()
    try:
        out = {f: f"{root.rstrip('/')}/source_{f}" for f in formats}
        for f, path in out.items():
            rows.write.mode("overwrite" if reseed else "errorifexists").format(f).save(path)
    finally:
        rows.unpersist()
    return out
