"""Holiday calendars: United States federal holidays by rule, others from a table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError

#: fixed values: the years a calendar covers
YEARS = range(2015, 2036)
#: fixed values: (name, month, day, first year)
FIXED = [("New Year's Day", 1, 1, 0), ("Juneteenth National Independence Day", 6, 19, 2021), ("Independence Day", 7, 4, 0), ("Veterans Day", 11, 11, 0), ("Christmas Day", 12, 25, 0)]
#: fixed values: (name, month, weekday with Monday 0, which one, -1 the last)
MOVING = [("Martin Luther King Jr. Day", 1, 0, 3), ("Washington's Birthday", 2, 0, 3), ("Memorial Day", 5, 0, -1), ("Labor Day", 9, 0, 1), ("Columbus Day", 10, 0, 2), ("Thanksgiving Day", 11, 3, 4)]


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
    return last - dt.timedelta((last.weekday() - weekday) % 7)


def us_holidays(years: range = YEARS) -> list[tuple[dt.date, str]]:
    """Federal holidays, with the Friday or Monday on which a weekend's one is observed."""
    out = []
    for y in (years.start - 1, *years, years.stop):
        for name, month, day, since in FIXED:
            if y >= since:
                d = dt.date(y, month, day)
                out.append((d, name))
                if d.weekday() >= 5:
                    out.append((d + dt.timedelta(-1 if d.weekday() == 5 else 1), f"{name} (observed)"))
        out += [(_nth(y, *rule), name) for name, *rule in MOVING]
    return sorted(x for x in out if x[0].year in years)


def holiday_frame(spark: SparkSession, codes: list[str], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """(ds, holiday) of all countries; `tables` brings calendars that have no rule here."""
    out = spark.createDataFrame([], "ds date, holiday string")
    for code in codes:
        if tables and code in tables:
            out = out.union(tables[code].select("ds", "holiday"))
        elif code == "US":
            out = out.union(spark.createDataFrame(us_holidays(), "ds date, holiday string"))
        else:
            raise ConfigError(f"unknown holiday country code {code!r}")
    return out


def flag(panel: DataFrame, holidays: DataFrame, date: str = "ds") -> DataFrame:
    """is_holiday for each row, by its date; a calendar has a few hundred days."""
    days = F.broadcast(holidays.select(F.col("ds").alias(date)).distinct().withColumn("is_holiday", F.lit(True)))
    return panel.join(days, date, "left").withColumn("is_holiday", F.coalesce("is_holiday", F.lit(False)))


def windows(holidays: DataFrame, days: int = 1) -> DataFrame:
    """Each holiday with the days before and after it."""
    around = F.sequence(F.date_sub("ds", days), F.date_add("ds", days))
    return holidays.select("holiday", F.col("ds").alias("of"), F.explode(around).alias("ds"))
