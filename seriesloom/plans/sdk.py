"""The facade: plan, run, review and trace."""

from __future__ import annotations

import argparse
import json
import pickle
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..operators import cells as C
from ..operators import ensemble
from ..sources import generator
from ..sources import panel as P
from ..streaming import ready
from . import config, dag, ids, registry


class Forecaster:
    """One configuration over one registry folder."""

    def __init__(self, cfg: config.RunConfig, spark: SparkSession, root: str):
        self.cfg, self.spark = cfg, spark
        self.registry = registry.Registry(spark, root)

    @classmethod
    def from_dict(cls, data: dict[str, Any], spark: SparkSession, root: str) -> Forecaster:
        return cls(config.from_dict(data), spark, root)

    @classmethod
    def from_file(cls, path: str, spark: SparkSession, root: str) -> Forecaster:
        return cls(config.load_config(path), spark, root)

    @property
    def run_id(self) -> str:
        return self.cfg.run_id

    def dry_run(self) -> dict[str, Any]:
        plan = dag.plan_dag(self.cfg)
        return {"run_id": self.run_id, "families": plan.families, "nodes": plan.nodes(), "jobs": [ids.job_key(self.run_id, f) for f in plan.families]}

    def dag(self) -> list[tuple[str, tuple[str, ...]]]:
        return dag.plan_dag(self.cfg).nodes()

    def source(self, panel: DataFrame | None = None) -> DataFrame:
        d = self.cfg.data
        df = panel if panel is not None else P.resolve(self.spark, d.source_table)
        out = P.as_panel(df, d.ts_id_col, d.date_col, d.target_col, self.cfg.features.exog, d.freq)
        return P.limit_series(out, d.series_limit) if d.series_limit else out

    @property
    def staged(self) -> str:
        return f"{self.registry.root}/_staged/{self.run_id}"

    def stage(self, panel: DataFrame | None = None) -> DataFrame:
        """Pack the source once, one row for each series, and write it: every family reads the same rows."""
        packed = C.packed_panel(self.source(panel), self.cfg.features.exog)
        packed.write.mode("overwrite").parquet(self.staged)
        return self.spark.read.schema(packed.schema).parquet(self.staged)

    def snapshot(self) -> DataFrame:
        """The rows that the run was made from, whatever the source holds now."""
        return self.spark.read.parquet(self.staged).select("ts_id", F.inline("points"))

    def run(self, panel: DataFrame | None = None, force: bool = False) -> str:
        """Fit all families, blend, and record; a completed run is not repeated unless forced."""
        cfg, reg = self.cfg, self.registry
        if not force and reg.status(self.run_id) == "COMPLETED":
            return "COMPLETED"
        source = self.stage(panel)
        n = source.count()
        header = {"python_runtime": "spark", "n_series": n, "n_models": len(cfg.models), "backtest_on": cfg.backtest.enabled, "models": list(cfg.models), "strategies": list(cfg.ensemble.strategies) if cfg.ensemble.enabled else [], "config": ids.canonical(cfg.model_dump(mode="json")), "dataset_ref": self.staged}
        with reg.run(self.run_id, **header) as state:
            each = cfg.hpo.enabled and cfg.hpo.granularity == "per_series"
            params = C.tune(source, cfg) if cfg.hpo.enabled and not each else None
            own_params = C.tune_by_series(source, cfg, n_series=n) if each else None
            outcomes, arrivals = {}, None
            micro = cfg.ensemble.enabled and cfg.compute.ensemble_mode == "microbatch"
            jobs = dag.plan_dag(cfg).jobs
            if micro:
                reg.create("forecast_predictions", self.run_id)
                arrivals = ready.follow_run(self.spark, reg, self.run_id, [m for j in jobs for m in j.models], self._blend_ready, cfg.compute.microbatch_interval_s)
            try:
                for job in jobs:
                    attempt = reg.next_attempt(self.run_id, job.family, force)
                    with reg.job(self.run_id, job.family, ids.job_key(self.run_id, job.family, attempt), attempt) as own:
                        done = C.run_cells(source, cfg.for_family(job.family).model_copy(update={"models": job.models}), params, n, own_params).persist()
                        try:
                            self._record(done)
                            own["status"] = outcomes[job.family] = done.transform(lambda x: registry.status_rollup(x, [])).first()["status"]
                        finally:
                            done.unpersist()
                if arrivals:
                    arrivals.processAllAvailable()
            finally:
                if arrivals:
                    arrivals.stop()
            if micro:
                outcomes["ensemble"] = "COMPLETED" if self.registry.read("forecast_predictions", self.run_id).filter("ensemble_id IS NOT NULL").limit(1).count() else "FAILED"
            elif cfg.ensemble.enabled:
                outcomes["ensemble"] = self.blend()
            state["status"] = dag.combined_status(outcomes)
        return state["status"]

    def _stamped(self, df: DataFrame) -> DataFrame:
        return df.withColumn("run_id", F.lit(self.run_id)).withColumn("created_at", F.current_timestamp())

    def _record(self, done: DataFrame) -> None:
        """A family's cells: artifacts, scores and out-of-fold rows first, so that who sees its forecasts finds them."""
        cfg_text = ids.canonical(self.cfg.model_dump(mode="json"))
        hashed = ids.model_hash_column(F.lit(self.run_id), F.col("ts_id"), F.col("model_type"), F.lit(cfg_text))
        stored = done.filter("model_artifact IS NOT NULL").select("ts_id", "model_type", hashed.alias("model_hash"), F.col("model_artifact").alias("artifact"))
        self.registry.append("model_artifacts", self._stamped(stored))
        where = F.when(F.col("has_artifact"), F.concat(F.lit("model_artifacts/"), F.col("model_hash")))
        self.registry.append("backtest_oof", self._stamped(C.out_of_fold(done)))
        self.registry.append("forecast_metadata", self._stamped(C.metadata(done)).withColumn("model_hash", hashed).withColumn("model_artifact", where))
        self.registry.append("forecast_predictions", self._stamped(C.predictions(done)))

    def load_model(self, ts_id: str, model: str):
        """A stored model of this run, fitted; None if there is none.  Artifacts are pickles: load only from registries you trust."""
        rows = registry.latest(self.registry.read("model_artifacts", self.run_id), ["ts_id", "model_type"], F.desc("created_at"))
        row = rows.filter((F.col("ts_id") == ts_id) & (F.col("model_type") == model)).select("artifact").first()
        return pickle.loads(row[0]) if row else None

    def base(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Deduplicated predictions, out-of-fold rows and scores of the base models."""
        own = lambda t, keys: registry.latest(self.registry.read(t, self.run_id).filter("ensemble_id IS NULL"), keys, F.desc("created_at"))
        preds = own("forecast_predictions", ["ts_id", "model_type", "forecast_date"]).withColumnRenamed("forecast_date", "ds")
        oof = own("backtest_oof", ["ts_id", "model_type", "fold_id", "forecast_date"]).withColumnsRenamed({"forecast_date": "ds", "y_true": "y"})
        return preds, oof, own("forecast_metadata", ["ts_id", "model_type"])

    def blend(self, strategies: tuple[str, ...] | None = None) -> str:
        """Every strategy over the run's base forecasts; scored on out-of-fold rows if there are any."""
        return self._blend(*self.base(), strategies or self.cfg.ensemble.strategies)

    def _blend_ready(self, ready_ids: DataFrame) -> None:
        """The same for some series, by the weights of what has landed."""
        only = lambda df: df.join(ready_ids, "ts_id", "leftsemi")
        preds, oof, scores = self.base()
        self._blend(only(preds), oof, scores, self.cfg.ensemble.strategies, only(oof))

    def _blend(self, preds: DataFrame, oof: DataFrame, scores: DataFrame, names: tuple[str, ...], own_oof: DataFrame | None = None) -> str:
        from ..functions import metrics

        e = self.cfg.ensemble
        eid = ids.ensemble_id(list(names), e.prune_threshold)
        preds, oof, own = (ensemble.prune(x, scores, e.prune_threshold) for x in (preds, oof, oof if own_oof is None else own_oof))
        models = [m for m in self.cfg.models if m in {r[0] for r in preds.select("model_type").distinct().collect()}]
        if not models:
            return "FAILED"
        cfg_text = ids.canonical(self.cfg.model_dump(mode="json"))
        for s in names:
            tag = lambda df, s=s: self._stamped(df.withColumn("model_type", F.lit(f"ensemble_{s}")).withColumn("ensemble_id", F.lit(eid)))
            if self.cfg.backtest.enabled:
                at = ["ts_id", "fold_id", "ds"]
                truth = own.groupBy(*at).agg(F.max("y").alias("y"))
                scored = ensemble.blend(s, own, oof, scores, models, at).join(truth, at)
                folds = scored.groupBy("ts_id", "fold_id").agg(*metrics.metric_aggregates())
                self.registry.append("backtest_oof", tag(scored.withColumnsRenamed({"ds": "forecast_date", "y": "y_true"})))
                board = tag(metrics.rollup(folds, ["ts_id"]).withColumn("status", F.lit("ok")))
                hashed = ids.model_hash_column(F.lit(self.run_id), F.col("ts_id"), F.col("model_type"), F.lit(eid), F.lit(cfg_text))
                self.registry.append("forecast_metadata", board.withColumn("model_hash", hashed))
            out = ensemble.blend(s, preds, oof, scores, models)
            self.registry.append("forecast_predictions", tag(out.withColumnRenamed("ds", "forecast_date")))
        return "COMPLETED"

    def status(self) -> str | None:
        return self.registry.status(self.run_id)

    def wait(self, timeout: float = 3600.0, poll: float = 15.0) -> str:
        end = time.monotonic() + timeout
        while (s := self.status()) in (None, "RUNNING"):
            if time.monotonic() > end:
                raise TimeoutError(self.run_id)
            time.sleep(poll)
        return s

    def results(self) -> DataFrame:
        return registry.leaderboard(self.registry.read("forecast_metadata", self.run_id)).orderBy(F.col("mean_wape").asc_nulls_last(), "model_type")

    def review(self) -> dict[str, Any]:
        """The run at a glance: status, header, jobs, ranked models, failures by message and forecasts by model."""
        cells = registry.deduped_cells(self.registry.read("forecast_metadata", self.run_id))
        errors = cells.filter("status = 'error'").groupBy("model_type", "error").count().orderBy(F.desc("count"), "model_type", "error").limit(20)
        summary = registry.run_summary(self.registry.read("run_registry", self.run_id)).first()
        return {
            "status": self.status(),
            "run": summary.asDict() if summary else None,
            "jobs": [r.asDict() for r in self.jobs().collect()],
            "models": [r.asDict() for r in self.results().collect()],
            "errors": [r.asDict() for r in errors.collect()],
            "predictions": {r.model_type: r["count"] for r in self.registry.prediction_counts(self.run_id).collect()},
        }

    def jobs(self) -> DataFrame:
        return registry.current_jobs(self.registry.read("run_jobs", self.run_id))

    def trace(self) -> DataFrame:
        return registry.trace(self.jobs(), registry.deduped_cells(self.registry.read("forecast_metadata", self.run_id)).filter("fold_id IS NULL AND ensemble_id IS NULL"))


def model_catalog() -> list[dict[str, Any]]:
    from ..models import registered

    return [{"model": n, "family": m.family, "exog": m.supports_exog, "least": m.least} for n, m in sorted(registered().items())]


def bakeoff(spark: SparkSession, panel: DataFrame, models: list[str], horizon: int = 28, folds: int = 3, min_train: int = 180) -> DataFrame:
    """Models on a panel, best mean wape first, without a registry."""
    cfg = config.from_dict({"models": models, "data": {"horizon": horizon}, "backtest": {"enabled": True, "n_folds": folds, "horizon": horizon, "step": horizon, "min_train": min_train}})
    board = C.metadata(C.run_cells(panel, cfg)).groupBy("model_type").agg(F.count_if(F.col("status") == "error").alias("n_errors"), F.avg("wape").alias("wape"), F.avg("mae").alias("mae"))
    return board.orderBy(F.col("wape").asc_nulls_last(), "model_type")


def sample_data(spark: SparkSession, n_series: int = 5, periods: int = 365) -> DataFrame:
    """A small generated panel: ts_id, ds, y."""
    return generator.generate_panel(spark, n_series, periods).select("ts_id", "ds", "y")


def run_model(panel: DataFrame, model: str, horizon: int = 28, **params: Any) -> DataFrame:
    """One model's forecasts of every series, without a registry; a failing series is an error."""
    cfg = config.from_dict({"models": [model], "data": {"horizon": horizon}})
    cells = C.run_cells(panel, cfg, {model: params}).persist()
    try:
        if bad := cells.filter("status = 'error'").select("ts_id", "error").orderBy("ts_id").first():
            raise EngineError(f"series {bad[0]!r}: {bad[1]}")
        rows = C.predictions(cells).toArrow()
    finally:
        cells.unpersist()
    return panel.sparkSession.createDataFrame(rows)


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(description="Run a forecasting configuration.")
    which = a.add_mutually_exclusive_group(required=True)
    which.add_argument("--config", help="a local file")
    which.add_argument("--config-uri", help="a file on any file system that Spark reads")
    a.add_argument("--registry", required=True)
    a.add_argument("--dry-run", action="store_true", help="print the plan")
    a.add_argument("--stage-only", action="store_true", help="pack and write the source, fit nothing")
    a.add_argument("--strategies", help="comma-separated: blend the run's forecasts again")
    a.add_argument("--force", action="store_true")
    args = a.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    cfg = config.load_config(args.config) if args.config else config.load_config_uri(spark, args.config_uri)
    f = Forecaster(cfg, spark, args.registry)
    if args.dry_run:
        print(json.dumps(f.dry_run()))
    elif args.stage_only:
        print(f.stage().count())
    elif args.strategies:
        print(f.blend(tuple(args.strategies.split(","))))
    else:
        print(f.run(force=args.force))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
