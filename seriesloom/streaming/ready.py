"""Ensembles as base forecasts land: a file stream that keeps each series until all its models are there."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..operators import ensemble

PREDICTIONS = "ts_id string, model_type string, ds date, yhat double"
POINT = ["ts_id", "model_type", "ds", "yhat"]


def complete_series(arrivals: DataFrame, models: list[str]) -> DataFrame:
    """Each series' points (ts_id, model_type, ds, yhat), once, when the last of `models` has landed.

    The state holds the points of series that still wait, by ts_id; of a
    series that went out only a mark stays, so what lands again is ignored.
    """
    wanted = sorted(models)

    def wait(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, names, days, values = state.get if state.exists else (False, [], [], [])
        if done:
            return
        held = {(m, d): v for m, d, v in zip(names, days, values, strict=True)}
        for frame in frames:
            for m, d, v in zip(frame["model_type"], frame["ds"], frame["yhat"], strict=True):
                if m in wanted:
                    held.setdefault((m, d.isoformat()), None if pd.isna(v) else float(v))
        if {m for m, _ in held} != set(wanted):
            names, days = [m for m, _ in held], [d for _, d in held]
            state.update((False, names, days, list(held.values())))
            return
        state.update((True, [], [], []))
        rows = [(key[0], m, pd.Timestamp(d), v) for (m, d), v in held.items()]
        yield pd.DataFrame(rows, columns=POINT)

    kept = "done boolean, names array<string>, days array<string>, vals array<double>"
    points = arrivals.select("ts_id", "model_type", F.col("ds").cast("timestamp_ntz").alias("ds"), F.col("yhat").cast("double").alias("yhat"))
    return points.groupBy("ts_id").applyInPandasWithState(wait, "ts_id string, model_type string, ds timestamp_ntz, yhat double", kept, "append", "NoTimeout")


def stream_ensemble(spark: SparkSession, source: str, sink: str, checkpoint: str, models: list[str], weights: DataFrame | None = None) -> StreamingQuery:
    """Blend every series whose base models have all landed, each once.

    `weights` are the run's own, so a series' rows do not depend on the batch
    that it completes in.  Each batch writes its own folder, so a repeated
    batch replaces its rows; nothing that landed before is read again.
    """

    def blend(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("ds", F.col("ds").cast("date"))
        out = ensemble.apply_weights(rows, weights) if weights is not None else ensemble.mean(rows)
        out.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = complete_series(spark.readStream.schema(PREDICTIONS).parquet(source), models)
    return stream.writeStream.foreachBatch(blend).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_run(spark: SparkSession, reg, run_id: str, models: list[str], blend: Callable[[DataFrame], None], interval_s: int) -> StreamingQuery:
    """Follow a run's predictions table; `blend` gets the ids of the series that became complete."""
    from ..plans.registry import TABLES

    columns = ", ".join(c for c in TABLES["forecast_predictions"].split(", ") if not c.startswith("run_id "))
    rows = spark.readStream.schema(columns).parquet(f"{reg.path('forecast_predictions')}/run_id={run_id}")
    base = rows.filter("ensemble_id IS NULL").withColumnRenamed("forecast_date", "ds")

    def batch(df: DataFrame, number: int) -> None:
        ids = df.select("ts_id").distinct().persist()
        try:
            if not ids.isEmpty():
                blend(ids)
        finally:
            ids.unpersist()

    stream = complete_series(base, models).writeStream.foreachBatch(batch)
    return stream.option("checkpointLocation", f"{reg.root}/_follow/{run_id}").trigger(processingTime=f"{interval_s} seconds").start()


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Event counts by tumbling window, bounded by a watermark; also runs on a batch."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
