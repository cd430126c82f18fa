"""Result tables, their append-only writes, and the views that read the latest rows."""

from __future__ import annotations

import contextlib
import datetime as dt
import json
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METRICS = "mae double, mse double, rmse double, bias double, mape double, smape double, wape double, mase double, rmsse double, coverage double, pinball double"
#: fixed column names and types of the result tables
TABLES = {
    "run_registry": "run_id string, created_at timestamp, status string, python_runtime string, n_series long, n_models long, backtest_on boolean, models array<string>, strategies array<string>, config string, job_telemetry string, runtime_seconds double, dataset_ref string",
    "run_jobs": "run_id string, family string, job_id string, attempt int, runtime string, status string, created_at timestamp, started_at timestamp, ended_at timestamp, runtime_seconds double, job_telemetry string",
    "forecast_metadata": f"run_id string, ts_id string, model_type string, fold_id int, ensemble_id string, model_hash string, created_at timestamp, {METRICS}, fit_seconds double, predict_seconds double, best_params string, model_artifact string, compute_engine string, worker_id string, cell_started_at timestamp, cell_ended_at timestamp, status string, error string",
    "forecast_predictions": "run_id string, ts_id string, model_type string, ensemble_id string, forecast_date timestamp_ntz, yhat double, yhat_lower double, yhat_upper double, quantiles string, created_at timestamp",
    "backtest_oof": "run_id string, ts_id string, model_type string, ensemble_id string, fold_id int, forecast_date timestamp_ntz, y_true double, yhat double, created_at timestamp",
    "model_artifacts": "run_id string, ts_id string, model_type string, model_hash string, artifact binary, created_at timestamp",
}
CELL_KEY = ["run_id", "ts_id", "model_type", "fold_id", "ensemble_id"]


def clean_json(d: dict | None) -> str | None:
    """Finite entries as JSON; NULL if none is left of a non-empty map."""
    if d is None:
        return None
    kept = {k: v for k, v in d.items() if not (isinstance(v, float) and not math.isfinite(v))}
    return json.dumps(kept, sort_keys=True) if kept or not d else None


def latest(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key by the order given; null keys count as equal, ties go by the other columns in turn."""
    ties = [F.col(c).asc_nulls_last() for c, kind in df.dtypes if c not in keys and not kind.startswith(("map", "array", "struct"))]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *ties))).filter("_n = 1").drop("_n")


def run_summary(runs: DataFrame) -> DataFrame:
    t = lambda k, kind: F.get_json_object("job_telemetry", f"$.{k}").cast(kind).alias(k)
    rows = latest(runs, ["run_id"], F.desc("created_at"))
    rows = rows.select("run_id", "created_at", "status", "python_runtime", "n_series", "n_models", "backtest_on", "runtime_seconds", t("total_wall_s", "double"), *(t(k, "long") for k in ("executor_instances", "executor_cores", "max_executors", "dcu_milli_seconds")), t("runtime_version", "string"))
    over = F.col("total_wall_s") - F.col("runtime_seconds")
    return rows.withColumn("overhead_seconds", over).withColumn("overhead_fraction", F.try_divide(over, F.col("total_wall_s")))


def current_jobs(jobs: DataFrame) -> DataFrame:
    return latest(jobs, ["run_id", "family"], F.desc("attempt"), F.desc("created_at"))


def deduped_cells(meta: DataFrame) -> DataFrame:
    return latest(meta, CELL_KEY, F.desc("created_at"))


def leaderboard(meta: DataFrame) -> DataFrame:
    """Summary rows of the deduplicated cells, by run, model and ensemble."""
    bare = F.count_if(F.col("model_artifact").isNull())
    return (
        deduped_cells(meta)
        .filter("fold_id IS NULL")
        .groupBy("run_id", "model_type", "ensemble_id")
        .agg(
            F.any_value("compute_engine", True).alias("compute_engine"),
            F.count("*").alias("n_cells"),
            bare.alias("n_no_artifact"),
            F.try_divide(bare, F.count("*")).alias("no_artifact_rate"),
            F.try_divide(F.count_if(F.col("status") == "error"), F.count("*")).alias("error_rate"),
            F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY fit_seconds)").alias("median_fit_seconds"),
            F.avg("wape").alias("mean_wape"),
            F.avg("mae").alias("mean_mae"),
        )
    )


def status_rollup(cells: DataFrame, keys: list[str]) -> DataFrame:
    """COMPLETED, PARTIAL or FAILED from the cells' own statuses."""
    bad = F.count_if(F.col("status") == "error")
    status = F.when(F.col("n_errors") == 0, "COMPLETED").when(F.col("n_errors") < F.col("n_cells"), "PARTIAL").otherwise("FAILED")
    return cells.groupBy(*keys).agg(F.count("*").alias("n_cells"), bad.alias("n_errors"), F.count_distinct("ts_id").alias("n_series")).withColumn("status", status)


def trace(jobs: DataFrame, cells: DataFrame) -> DataFrame:
    """Job and cell spans, one under the other."""
    j = jobs.select(F.lit("job").alias("kind"), F.col("family").alias("name"), "status", F.col("started_at").alias("start"), F.col("ended_at").alias("end"))
    c = cells.select(F.lit("cell").alias("kind"), F.concat_ws("/", "ts_id", "model_type").alias("name"), "status", F.col("cell_started_at").alias("start"), F.col("cell_ended_at").alias("end"))
    return j.unionByName(c).withColumn("seconds", (F.unix_micros("end") - F.unix_micros("start")) / 1e6)


class Registry:
    """The five tables as Parquet folders; rows are only ever appended."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str, run_id: str | None = None) -> DataFrame:
        """All rows of a table, with later columns of the schema as nulls in older files."""
        try:
            df = self.spark.read.schema(TABLES[table]).parquet(self.path(table))
            df.schema  # noqa: B018
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            df = self.spark.createDataFrame([], TABLES[table])
        return df.filter(F.col("run_id") == run_id) if run_id else df

    def append(self, table: str, df: DataFrame) -> None:
        """Rows under the table's columns; missing ones are null, non-finite numbers too."""
        cols = []
        for f in self.spark.createDataFrame([], TABLES[table]).schema:
            c = F.col(f.name) if f.name in df.columns else F.lit(None)
            c = c.cast(f.dataType)
            if f.dataType.simpleString() == "double":
                c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
            cols.append(c.alias(f.name))
        df.select(*cols).write.mode("append").partitionBy("run_id").parquet(self.path(table))

    def append_row(self, table: str, **row) -> None:
        row.setdefault("created_at", dt.datetime.now())
        schema = self.spark.createDataFrame([], TABLES[table]).schema
        own = [f for f in schema if f.name in row]
        self.append(table, self.spark.createDataFrame([tuple(row[f.name] for f in own)], type(schema)(own)))

    def create_views(self) -> None:
        """v_run_summary, v_run_jobs and v_model_leaderboard of this session."""
        run_summary(self.read("run_registry")).createOrReplaceTempView("v_run_summary")
        current_jobs(self.read("run_jobs")).createOrReplaceTempView("v_run_jobs")
        leaderboard(self.read("forecast_metadata")).createOrReplaceTempView("v_model_leaderboard")

    def create(self, table: str, run_id: str) -> None:
        """A run's empty folder of a table, for readers that come before its first rows."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(table)}/run_id={run_id}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(p)

    def create_tables(self, database: str) -> None:
        """The result tables in the catalog, over this registry's folders."""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        for name, columns in TABLES.items():
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet PARTITIONED BY (run_id) LOCATION '{self.path(name)}'")

    def migrate(self, database: str) -> list[str]:
        """Add the columns that an older catalog table lacks; returns the statements."""
        done = []
        for name in TABLES:
            for statement in self.missing_columns(name, self.spark.table(f"{database}.{name}").columns, database):
                self.spark.sql(statement)
                done.append(statement)
        return done

    def drop_tables(self, database: str) -> None:
        """Take the tables out of the catalog; their files stay."""
        for name in TABLES:
            self.spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")

    def missing_columns(self, table: str, found: list[str], database: str | None = None) -> list[str]:
        """ALTER TABLE statements that bring an older table up to the schema."""
        want = self.spark.createDataFrame([], TABLES[table]).schema
        full = f"{database}.{table}" if database else table
        return [f"ALTER TABLE {full} ADD COLUMNS ({f.name} {f.dataType.simpleString()})" for f in want if f.name not in found]

    def recent_runs(self, limit: int = 25) -> DataFrame:
        """The latest runs, newest first: a report."""
        return run_summary(self.read("run_registry")).orderBy(F.desc("created_at"), "run_id").limit(limit)

    def status(self, run_id: str) -> str | None:
        row = latest(self.read("run_registry", run_id), ["run_id"], F.desc("created_at")).select("status").first()
        return row[0] if row else None

    def next_attempt(self, run_id: str, family: str, force: bool = False) -> int:
        """1 for a new job; the last attempt again, or one more if forced."""
        last = self.read("run_jobs", run_id).filter(F.col("family") == family).agg(F.max("attempt")).first()[0]
        return 1 if last is None else last + 1 if force else last

    def prediction_counts(self, run_id: str) -> DataFrame:
        return self.read("forecast_predictions", run_id).groupBy("model_type").count()

    def cell_timing(self, run_id: str, limit: int = 5000) -> DataFrame:
        """A report of the run's first cells by start."""
        return deduped_cells(self.read("forecast_metadata", run_id)).filter("fold_id IS NULL").orderBy("cell_started_at", "ts_id", "model_type").limit(limit)

    def telemetry(self) -> dict:
        """What the session says of its size and version."""
        conf = self.spark.sparkContext.getConf()
        found = {k: conf.get(c, None) for k, c in (("executor_instances", "spark.executor.instances"), ("executor_cores", "spark.executor.cores"), ("max_executors", "spark.dynamicAllocation.maxExecutors"))}
        return {k: int(v) for k, v in found.items() if v} | {"runtime_version": self.spark.version}

    @contextlib.contextmanager
    def run(self, run_id: str, **header) -> Iterator[dict]:
        """A RUNNING header, then COMPLETED (or the status set in what is yielded), or FAILED."""
        began, state = dt.datetime.now(), {"status": "COMPLETED"}
        self.append_row("run_registry", run_id=run_id, status="RUNNING", **header)
        try:
            yield state
        except BaseException:
            state["status"] = "FAILED"
            raise
        finally:
            took = (dt.datetime.now() - began).total_seconds()
            self.append_row("run_registry", run_id=run_id, status=state["status"], runtime_seconds=took, job_telemetry=clean_json({"total_wall_s": took, **self.telemetry(), **state.get("telemetry", {})}), **header)

    @contextlib.contextmanager
    def job(self, run_id: str, family: str, job_id: str, attempt: int) -> Iterator[dict]:
        began, state = dt.datetime.now(), {"status": "COMPLETED"}
        common = {"run_id": run_id, "family": family, "job_id": job_id, "attempt": attempt, "runtime": "spark", "started_at": began}
        self.append_row("run_jobs", status="RUNNING", **common)
        try:
            yield state
        except BaseException:
            state["status"] = "FAILED"
            raise
        finally:
            now = dt.datetime.now()
            self.append_row("run_jobs", status=state["status"], ended_at=now, runtime_seconds=(now - began).total_seconds(), **common)
