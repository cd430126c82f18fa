"""Python workers find this package where the driver has it."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def on_workers(spark: SparkSession) -> None:
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(":"):
        env["PYTHONPATH"] = f"{root}:{have}" if have else root
