"""Queries of fitted models, whole runs and streams; those with a closed form have their SQL beside them."""

from __future__ import annotations

import pickle
import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions import transforms
from ..operators import cells as C
from ..sources import generator
from ..sources import panel as P
from ..sources import workers as sources
from . import catalog, config, dag, ids, sdk

query = catalog.query


def _fitted(models: list[str], tune: bool = False):
    return config.from_dict({"models": models, "data": {"horizon": 28}, "backtest": {"enabled": True, "n_folds": 2, "min_train": 365}, "hpo": {"enabled": tune}})


NUMBERED = catalog.FILLED + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY ts_id ORDER BY ds) - 1 AS t, count(*) OVER (PARTITION BY ts_id) AS n FROM filled)"""
#: the additive season: means of the series less its centred moving average (ends repeated), by place in the week
SEASON = NUMBERED + """,
smooth AS (SELECT p.ts_id, p.t, any_value(p.y) AS y, any_value(p.n) AS n, avg(q.y) AS trend
  FROM placed p, (SELECT unnest(range(-3, 4)) AS j) o, placed q WHERE q.ts_id = p.ts_id AND q.t = greatest(0, least(p.n - 1, p.t + j)) GROUP BY 1, 2),
means AS (SELECT ts_id, t % 7 AS i, avg(y - trend) AS s FROM smooth GROUP BY 1, 2),
season AS (SELECT ts_id, i, s - avg(s) OVER (PARTITION BY ts_id) AS s FROM means),
flat AS (SELECT p.ts_id, p.t, p.n, p.ds, p.y, s.s, p.y - s.s AS d FROM placed p JOIN season s ON s.ts_id = p.ts_id AND s.i = p.t % 7)"""
THETA_SQL = f"""WITH RECURSIVE {SEASON},
slopes AS (SELECT ts_id, regr_slope(d, t) AS slope, max(ds) AS last, max(n) AS n FROM flat GROUP BY 1),
walk AS (SELECT ts_id, 0.02 + 0.04 * g AS a, t, d AS level, 0.0::DOUBLE AS sse FROM flat, (SELECT unnest(range(25)) AS g) WHERE t = 0
  UNION ALL SELECT w.ts_id, a, f.t, level + a * (d - level), sse + (d - level) * (d - level) FROM walk w JOIN flat f ON f.ts_id = w.ts_id AND f.t = w.t + 1),
ends AS (SELECT w.* FROM walk w JOIN slopes s ON s.ts_id = w.ts_id AND w.t = s.n - 1 QUALIFY row_number() OVER (PARTITION BY w.ts_id ORDER BY sse, a) = 1),
ahead AS (SELECT e.ts_id, last, k, level + 0.5 * slope * (k - 1 + (1 - power(1 - a, s.n)) / a) + q.s AS mid, sqrt(sse / (s.n - 1)) * sqrt(1 + (k - 1) * a * a) AS sd
  FROM ends e JOIN slopes s ON s.ts_id = e.ts_id, (SELECT unnest(range(1, 29)) AS k) h, season q WHERE q.ts_id = e.ts_id AND q.i = (s.n + k - 1) % 7)
SELECT ts_id, 'theta' AS model_type, CAST(last + CAST(k AS INTEGER) AS TIMESTAMP) AS forecast_date, round(mid, 6) AS yhat, round(mid - 1.2815515655446008 * sd, 6) AS yhat_lower, round(mid + 1.2815515655446008 * sd, 6) AS yhat_upper FROM ahead"""
SMOOTHING = {"alpha": 0.3, "beta": 0.05, "gamma": 0.1}
HOLT_SQL = f"""WITH RECURSIVE {SEASON},
seasons AS (SELECT ts_id, list(s ORDER BY i) AS s FROM season GROUP BY 1),
start AS (SELECT ts_id, max(n) AS n, max(ds) AS last, (max(d) FILTER (t = 13) - max(d) FILTER (t = 0)) / 13 AS slope, max(d) FILTER (t = 0) AS d0 FROM flat GROUP BY 1),
walk AS (SELECT b.ts_id, -1::BIGINT AS t, d0 - slope AS level, slope AS trend, s AS season FROM start b JOIN seasons q ON q.ts_id = b.ts_id
  UNION ALL SELECT ts_id, t, new, 0.05 * (new - level) + 0.95 * trend, list_transform(range(7), lambda i: CASE WHEN i = t % 7 THEN 0.1 * (y - new) + 0.9 * season[i + 1] ELSE season[i + 1] END)
  FROM (SELECT w.ts_id, f.t, f.y, level, trend, season, 0.3 * (y - season[f.t % 7 + 1]) + 0.7 * (level + trend) AS new FROM walk w JOIN flat f ON f.ts_id = w.ts_id AND f.t = w.t + 1)),
ends AS (SELECT w.*, b.n, b.last FROM walk w JOIN start b ON b.ts_id = w.ts_id AND w.t = b.n - 1)
SELECT ts_id, 'holtwinters' AS model_type, CAST(last + CAST(k AS INTEGER) AS TIMESTAMP) AS forecast_date, round(level + trend * k + season[(n + k - 1) % 7 + 1], 6) AS yhat FROM ends, (SELECT unnest(range(1, 29)) AS k) h"""


def _model_query(model: str, sql: str | None = None):
    def run(spark, d):
        out = C.predictions(C.run_cells(catalog.filled(spark, d), _fitted([model]), n_series=3)).drop("quantiles")
        return catalog.rounded(out, ["yhat", "yhat_lower", "yhat_upper"])

    catalog.QUERIES[f"{model}_udf"] = run
    if sql:
        catalog.SQL[f"{model}_udf"] = sql


for _m in ("theta", "holtwinters", "sarimax", "ucm", "stl_bagging", "arima_plus", "prophet", "lag_ridge", "lag_boost"):
    _model_query(_m, THETA_SQL if _m == "theta" else None)


@query(HOLT_SQL)
def holtwinters_given(spark, d):
    """Holt-Winters under given smoothing weights."""
    cells = C.run_cells(catalog.filled(spark, d), _fitted(["holtwinters"]), {"holtwinters": SMOOTHING}, 3)
    return catalog.rounded(C.predictions(cells).select("ts_id", "model_type", "forecast_date", "yhat"), ["yhat"])


@query(f"""WITH {NUMBERED}, ends AS (SELECT ts_id, max(n) AS n, max(ds) AS last, max(y) FILTER (t = n - 1) - max(y) FILTER (t = n - 8) AS step FROM placed GROUP BY 1)
SELECT e.ts_id, 'sarimax' AS model_type, CAST(last + CAST(k AS INTEGER) AS TIMESTAMP) AS forecast_date, round(p.y + ((k + 6) // 7) * step, 6) AS yhat
FROM ends e, (SELECT unnest(range(1, 29)) AS k) h, placed p WHERE p.ts_id = e.ts_id AND p.t = e.n - 7 + (k - 1) % 7""")
def sarimax_given(spark, d):
    """The order (0, 1, 0) (0, 1, 0): both differences stay at zero."""
    order = {"p": 0, "d": 1, "q": 0, "P": 0, "D": 1, "Q": 0}
    cells = C.run_cells(catalog.filled(spark, d), _fitted(["sarimax"]), {"sarimax": order}, 3)
    return catalog.rounded(C.predictions(cells).select("ts_id", "model_type", "forecast_date", "yhat"), ["yhat"])


# --- one run of the closed-form models, and what its tables hold -----------------------
STRATEGIES = ("mean", "median", "inverse_error")
_RUNS: dict[tuple[str, str], sdk.Forecaster] = {}


def finished(spark, d) -> sdk.Forecaster:
    """The run behind the queries below, made once for each session and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _RUNS:
        cfg = {
            "run_name": "closed forms",
            "models": list(catalog.MODELS),
            "data": {"horizon": 28},
            "backtest": {"enabled": True, "n_folds": 3, "horizon": 28, "step": 28, "min_train": 365},
            "ensemble": {"enabled": True, "strategies": list(STRATEGIES)},
            "compute": {"persist_models": True, "families": {"statistical": {"bucket_target_cells": 3}}},
        }
        run = sdk.Forecaster.from_dict(cfg, spark, f"{scratch(spark)}/registry-{uuid.uuid4().hex}")
        run.run(catalog.filled(spark, d))
        _RUNS[key] = run
    return _RUNS[key]


def scratch(spark) -> str:
    """The folder that the session names for written tables; its own if a local session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ConfigError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (base or f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}").rstrip("/")


AHEAD = NUMBERED + """,
whole AS (SELECT ts_id, avg(y) AS m, min_by(y, ds) AS a, max_by(y, ds) AS b, max(n) AS n, max(ds) AS last, regr_slope(y, t) AS slope, regr_intercept(y, t) AS icpt FROM placed GROUP BY 1),
steps AS (SELECT w.*, k, CAST(last + CAST(k AS INTEGER) AS TIMESTAMP) AS forecast_date FROM whole w, (SELECT unnest(range(1, 29)) AS k) h),
ahead AS (SELECT s.ts_id, 'seasonal_naive' AS model_type, forecast_date, p.y AS yhat FROM steps s JOIN placed p ON p.ts_id = s.ts_id AND p.t = s.n - 7 + (k - 1) % 7
  UNION ALL SELECT ts_id, 'mean', forecast_date, m FROM steps
  UNION ALL SELECT ts_id, 'drift', forecast_date, b + k * (b - a) / (n - 1) FROM steps
  UNION ALL SELECT ts_id, 'linear_trend', forecast_date, icpt + slope * (n - 1 + k) FROM steps)"""


@query(f"WITH {AHEAD} SELECT ts_id, model_type, forecast_date, round(yhat, 6) AS yhat FROM ahead")
def run_predictions(spark, d):
    """Every cell's forecasts as the run stored them."""
    f = finished(spark, d)
    rows = f.registry.read("forecast_predictions", f.run_id).filter("ensemble_id IS NULL")
    return catalog.rounded(rows.select("ts_id", "model_type", "forecast_date", "yhat"), ["yhat"])


@query(f"WITH {AHEAD} SELECT ts_id, model_type, forecast_date, round(yhat, 6) AS yhat FROM ahead")
def run_artifacts(spark, d):
    """The same forecasts from the stored models."""
    f = finished(spark, d)
    sources.on_workers(spark)
    last = f.snapshot().groupBy("ts_id").agg(F.max("ds").alias("last"))
    rows = f.registry.read("model_artifacts", f.run_id).select("ts_id", "model_type", "artifact").join(last, "ts_id")

    def predict(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                yhat = pickle.loads(r.artifact).predict(28)[0.5]
                yield pd.DataFrame({"ts_id": r.ts_id, "model_type": r.model_type, "forecast_date": pd.date_range(r.last, periods=29)[1:], "yhat": yhat})

    out = rows.mapInPandas(predict, "ts_id string, model_type string, forecast_date timestamp_ntz, yhat double")
    return catalog.rounded(out, ["yhat"])


@query(f"WITH {catalog.OOF} SELECT ts_id, model_type, fold_id, CAST(ds AS TIMESTAMP) AS forecast_date, y AS y_true, round(yhat, 6) AS yhat FROM oof")
def run_oof(spark, d):
    """Every cell's out-of-fold rows as the run stored them."""
    f = finished(spark, d)
    rows = f.registry.read("backtest_oof", f.run_id).filter("ensemble_id IS NULL")
    return catalog.rounded(rows.select("ts_id", "model_type", "fold_id", "forecast_date", "y_true", "yhat"), ["yhat"])


CELL_METRICS = ("mae", "mse", "rmse", "bias", "mape", "smape", "wape", "mase", "rmsse")


@query(f"WITH {catalog.SCORES} SELECT ts_id, model_type, 'ok' AS status, true AS stored, " + ", ".join(f"round(avg({n}), 6) AS {n}" for n in CELL_METRICS) + " FROM scores GROUP BY 1, 2")
def run_metadata(spark, d):
    """Status, artifact and fold-averaged metrics of every cell."""
    f = finished(spark, d)
    rows = f.registry.read("forecast_metadata", f.run_id).filter("ensemble_id IS NULL")
    return catalog.rounded(rows.select("ts_id", "model_type", "status", F.col("model_artifact").isNotNull().alias("stored"), *CELL_METRICS), CELL_METRICS)


BLENDS = """,
own AS (SELECT model_type, avg(w) AS m FROM (SELECT ts_id, model_type, avg(wape) AS w FROM scores GROUP BY 1, 2) GROUP BY 1),
w AS (SELECT model_type, (1 / m) / sum(1 / m) OVER () AS weight FROM own)"""


@query(f"""WITH {catalog.SCORES}{BLENDS}, {AHEAD.split(catalog.FILLED, 1)[1].lstrip(',').lstrip().replace('placed', 'numbered').replace('steps', 'later')}
SELECT ts_id, 'ensemble_mean' AS model_type, forecast_date, round(avg(yhat), 6) AS yhat FROM ahead GROUP BY 1, 3
UNION ALL SELECT ts_id, 'ensemble_median', forecast_date, round(median(yhat), 6) FROM ahead GROUP BY 1, 3
UNION ALL SELECT ts_id, 'ensemble_inverse_error', forecast_date, round(sum(weight * yhat) / sum(weight), 6) FROM ahead a JOIN w ON w.model_type = a.model_type GROUP BY 1, 3""")
def run_ensembles(spark, d):
    """The run's blended forecasts."""
    f = finished(spark, d)
    rows = f.registry.read("forecast_predictions", f.run_id).filter("ensemble_id IS NOT NULL")
    return catalog.rounded(rows.select("ts_id", "model_type", "forecast_date", "yhat"), ["yhat"])


@query(f"""WITH {catalog.SCORES}{BLENDS},
mixed AS (SELECT ts_id, fold_id, ds, 'ensemble_mean' AS model_type, max(y) AS y, avg(yhat) AS yhat FROM oof GROUP BY 1, 2, 3
  UNION ALL SELECT ts_id, fold_id, ds, 'ensemble_median', max(y), median(yhat) FROM oof GROUP BY 1, 2, 3
  UNION ALL SELECT ts_id, fold_id, ds, 'ensemble_inverse_error', max(y), sum(weight * yhat) / sum(weight) FROM oof o JOIN w ON w.model_type = o.model_type GROUP BY 1, 2, 3),
folded AS (SELECT ts_id, model_type, wape, mae FROM scores
  UNION ALL SELECT ts_id, model_type, wape, mae FROM (SELECT ts_id, model_type, fold_id, {catalog.PANEL_METRICS} FROM mixed GROUP BY 1, 2, 3)),
each AS (SELECT ts_id, model_type, avg(wape) AS wape, avg(mae) AS mae FROM folded GROUP BY 1, 2)
SELECT model_type, count(*) AS n_cells, round(avg(wape), 6) AS mean_wape, round(avg(mae), 6) AS mean_mae, CAST(row_number() OVER (ORDER BY avg(wape), model_type) AS INTEGER) AS place FROM each GROUP BY 1""")
def run_leaderboard(spark, d):
    """The run's ranked board, base models and ensembles."""
    board = finished(spark, d).results().withColumn("place", F.row_number().over(Window.orderBy(F.col("mean_wape").asc_nulls_last(), "model_type")))  # a row for each model
    return catalog.rounded(board.select("model_type", "n_cells", "mean_wape", "mean_mae", "place"), ["mean_wape", "mean_mae"])


@query("SELECT model_type, 84 AS n FROM (VALUES ('seasonal_naive'), ('mean'), ('drift'), ('linear_trend'), ('ensemble_mean'), ('ensemble_median'), ('ensemble_inverse_error')) v(model_type)")
def run_prediction_counts(spark, d):
    f = finished(spark, d)
    return f.registry.prediction_counts(f.run_id).select("model_type", F.col("count").cast("int").alias("n"))


@query("SELECT 'statistical' AS family, 1 AS attempt, 'COMPLETED' AS job_status, 'COMPLETED' AS run_status, 3::BIGINT AS n_series, 4::BIGINT AS n_models, true AS backtest_on")
def run_status(spark, d):
    """The run's job and header, latest rows."""
    f = finished(spark, d)
    head = f.registry.recent_runs().select("run_id", F.col("status").alias("run_status"), "n_series", "n_models", "backtest_on")
    return f.jobs().select("run_id", "family", "attempt", F.col("status").alias("job_status")).join(head, "run_id").drop("run_id")


@query(f"WITH {catalog.PANEL}, {catalog.FILLED.split(catalog.PANEL, 1)[1].lstrip(',').lstrip()} SELECT ts_id, CAST(ds AS TIMESTAMP) AS ds, y FROM filled")
def run_snapshot(spark, d):
    """The rows that the run was made from."""
    return finished(spark, d).snapshot()


@query(f"""WITH {AHEAD}, actual AS (SELECT ts_id, ds + 28 AS ds, y FROM filled), paired AS (SELECT a.ts_id, model_type, yhat, y FROM ahead a JOIN actual t ON t.ts_id = a.ts_id AND CAST(t.ds AS TIMESTAMP) = a.forecast_date)
SELECT ts_id, model_type, count(*) AS n, round(avg(abs(yhat - y)), 6) AS mae FROM paired GROUP BY 1, 2""")
def run_against_actuals(spark, d):
    """Forecasts joined with what came (here the last 28 days moved on), and their error."""
    f = finished(spark, d)
    actual = f.snapshot().select("ts_id", F.date_add(F.to_date("ds"), 28).alias("day"), "y")
    rows = f.registry.read("forecast_predictions", f.run_id).filter("ensemble_id IS NULL").withColumn("day", F.to_date("forecast_date")).join(actual, ["ts_id", "day"])
    return catalog.rounded(rows.groupBy("ts_id", "model_type").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("yhat") - F.col("y"))).alias("mae")), ["mae"])


@query(f"""WITH {catalog.SCORES} SELECT ts_id, model_type, 'ok' AS status, round(avg(mae), 6) AS mae, round(avg(wape), 6) AS wape, round(avg(mase), 6) AS mase
  FROM scores WHERE model_type IN ('mean', 'drift') AND fold_id > 0 GROUP BY 1, 2
UNION ALL SELECT DISTINCT ts_id, 'timesfm', 'error', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM scores""")
def cell_metadata(spark, d):
    """Status and fold-averaged metrics of cells, one model of which cannot run here."""
    out = C.metadata(C.run_cells(catalog.filled(spark, d), _fitted(["mean", "drift", "timesfm"]), n_series=3))
    return catalog.rounded(out.select("ts_id", "model_type", "status", "mae", "wape", "mase"), ["mae", "wape", "mase"])


@query()
def hpo_fleetwide(spark, d):
    best = C.tune(catalog.filled(spark, d), _fitted(["lag_ridge"], True))
    return spark.createDataFrame([(m, config.ids.canonical(p)) for m, p in best.items()], "model_type string, best_params string")


def _lambda_pass(k: int) -> str:
    lo, hi = ("-2.0::DOUBLE", "2.0::DOUBLE") if k == 1 else ("lo", "hi")
    source = "(SELECT unnest(range(17)) AS i)" if k == 1 else f"r{k - 1}, (SELECT unnest(range(17)) AS i)"
    return f"""
g{k} AS (SELECT round({lo} + i * ({hi} - {lo}) / 16, 6) AS lam FROM {source}),
l{k} AS (SELECT ts_id, lam, (lam - 1) * sum(ly) - count(*) / 2.0 * ln(var_pop(CASE WHEN lam = 0 THEN ly ELSE (power(y, lam) - 1) / lam END)) AS llf FROM logs, g{k} GROUP BY 1, 2),
b{k} AS (SELECT ts_id, max_by(lam, llf) AS lam FROM l{k} GROUP BY 1),
r{k} AS (SELECT greatest(-2.0::DOUBLE, min(lam) - max(step)) AS lo, least(2.0::DOUBLE, max(lam) + max(step)) AS hi FROM b{k}, (SELECT ({hi} - {lo}) / 16 AS step{"" if k == 1 else f" FROM r{k - 1}"}))"""


@query(f"WITH {catalog.PANEL}, logs AS (SELECT ts_id, y, ln(y) AS ly FROM panel WHERE y > 0)," + ",".join(map(_lambda_pass, (1, 2, 3))) + " SELECT ts_id, round(lam, 4) AS lam FROM b3")
def boxcox_lambda_mle(spark, d):
    return transforms.boxcox_lambda(P.as_panel(P.daily_sales(spark, d)).filter("y > 0")).select("ts_id", F.round("lam", 4).alias("lam"))


@query("SELECT 3 * count(DISTINCT l_returnflag) AS n_cells, 3 * count(DISTINCT l_returnflag) AS n_distinct, true AS within FROM lineitem")
def bucket_spread(spark, d):
    """Cells over the partitions of the fit: all are there, each once, in the buckets asked for."""
    packed = C.pack(catalog.filled(spark, d))
    cells = C.cross_models(spark, packed, ["theta", "ucm", "sarimax"]).repartition(6, "ts_id", "model_type")
    cells = cells.select("ts_id", "model_type", F.spark_partition_id().alias("bucket"))
    return cells.agg(F.count("*").alias("n_cells"), F.count_distinct("ts_id", "model_type").alias("n_distinct"), (F.max("bucket") < 6).alias("within"))


@query("SELECT c_custkey AS n_series, least(100000, CAST(CASE WHEN c_custkey = 0 THEN 1000 ELSE greatest(1, ceil(c_custkey * 4 / 8.0)) END AS INTEGER)) AS buckets FROM customer")
def bucket_plan(spark, d):
    """Partitions of a fit by the number of series."""
    cfg = _fitted(["theta", "ucm", "sarimax", "lag_ridge"])
    rows = [(r.n, C.bucket_count(cfg, r.n)) for r in P.load(spark, d, "customer").select(F.col("c_custkey").alias("n")).toLocalIterator()]
    return spark.createDataFrame(rows, "n_series long, buckets int")


@query("SELECT c_custkey AS n_series, CAST(least(512, greatest(1, ceil(c_custkey * 100 / 2000.0))) AS INTEGER) AS tasks FROM customer")
def generator_plan(spark, d):
    """Tasks of the generator by the number of series."""
    rows = [(r.n, generator.partitions_for(100 * r.n)) for r in P.load(spark, d, "customer").select(F.col("c_custkey").alias("n")).toLocalIterator()]
    return spark.createDataFrame(rows, "n_series long, tasks int")


@query("SELECT 'statistical' AS node, CAST(NULL AS VARCHAR) AS waits_for UNION ALL SELECT 'ml', NULL UNION ALL SELECT 'native', NULL UNION ALL SELECT 'ensemble', unnest(['statistical', 'ml', 'native'])")
def run_dag(spark, d):
    """The jobs of a plan, and what each waits for."""
    cfg = config.from_dict({"models": ["theta", "lag_ridge", "arima_plus", "mean"], "ensemble": {"enabled": True}})
    rows = [(node, w) for node, waits in dag.plan_dag(cfg).nodes() for w in (waits or (None,))]
    return spark.createDataFrame(rows, "node string, waits_for string")


@query("""SELECT r_name, regexp_replace(lower(r_name), '[^a-z0-9]+', '-', 'g') || '-' || substr(sha256('{"of":"' || r_name || '"}'), 1, 12) AS run_id,
  'job-' || regexp_replace(lower(r_name), '[^a-z0-9]+', '-', 'g') || '-ml-a' || CAST(r_regionkey + 1 AS VARCHAR) AS job,
  substr(sha256('{"prune_threshold":0.5,"strategies":["' || least(r_name, 'MEAN') || '","' || greatest(r_name, 'MEAN') || '"]}'), 1, 12) AS ensemble_id FROM region""")
def run_ids(spark, d):
    """Identities of runs, jobs and ensembles, and back."""
    rows = []
    for r in P.load(spark, d, "region").select("r_name", "r_regionkey").toLocalIterator():
        job = ids.job_key(ids.slug(r.r_name), "ml", r.r_regionkey + 1)
        run, family, attempt = ids.parse_job_key(job)
        rows.append((r.r_name, ids.run_id(r.r_name, {"of": r.r_name}), ids.job_key(run, family, attempt), ids.ensemble_id([r.r_name, "MEAN"], 0.5)))
    return spark.createDataFrame(rows, "r_name string, run_id string, job string, ensemble_id string")


@query(f"WITH {NUMBERED}, w AS (SELECT ts_id, avg(y) AS m, stddev_pop(y) AS s, max(ds) AS last FROM placed GROUP BY 1) SELECT ts_id, CAST(last + CAST(k AS INTEGER) AS TIMESTAMP) AS forecast_date, q, round(m + z * s, 6) AS v FROM w, (SELECT unnest(range(1, 29)) AS k) h, (VALUES ('0.1', -1.2815515655446008::DOUBLE), ('0.5', 0.0::DOUBLE), ('0.9', 1.2815515655446008::DOUBLE)) z(q, z)")
def run_quantiles(spark, d):
    """The stored quantiles of one model, as a map."""
    f = finished(spark, d)
    rows = f.registry.read("forecast_predictions", f.run_id).filter("model_type = 'mean'")
    return catalog.rounded(rows.select("ts_id", "forecast_date", F.explode(F.from_json("quantiles", "map<string,double>")).alias("q", "v")), ["v"])


@query("SELECT DISTINCT l_returnflag AS ts_id, model_type, true AS timed FROM lineitem, (VALUES ('seasonal_naive'), ('mean'), ('drift'), ('linear_trend'), ('ensemble_mean'), ('ensemble_median'), ('ensemble_inverse_error')) v(model_type)")
def run_cell_timing(spark, d):
    """The report of a run's cells by start; an ensemble's rows have none."""
    f = finished(spark, d)
    timed = (F.col("cell_ended_at") >= F.col("cell_started_at")) | F.col("ensemble_id").isNotNull()
    return f.registry.cell_timing(f.run_id).select("ts_id", "model_type", timed.alias("timed"))


@query("SELECT 'statistical' AS family, 1 AS again, 2 AS forced UNION ALL SELECT 'ml', 1, 1")
def run_attempts(spark, d):
    """The next attempt of a job that ran, and of one that did not, as it is and forced."""
    f = finished(spark, d)
    rows = [(x, f.registry.next_attempt(f.run_id, x), f.registry.next_attempt(f.run_id, x, True)) for x in ("statistical", "ml")]
    return spark.createDataFrame(rows, "family string, again int, forced int")


def _season_sql(m: int) -> str:
    return f"SELECT {m} AS m, v.ts_id, v.fold_id, sum(abs(t.y - v.y)) / sum(abs(v.y)) AS wape FROM val v JOIN train t ON t.ts_id = v.ts_id AND t.fold_id = v.fold_id AND t.step = (v.step - 1) % {m} - {m - 1} GROUP BY 2, 3"


@query(f"""WITH {catalog.STATS}, tried AS ({" UNION ALL ".join(_season_sql(m) for m in (7, 14, 28))}),
each AS (SELECT m, ts_id, avg(wape) AS wape FROM tried GROUP BY 1, 2), scored AS (SELECT m, avg(wape) AS s FROM each GROUP BY 1)
SELECT 'seasonal_naive' AS model_type, min_by(m, (s, m)) AS season FROM scored""")
def hpo_seasons(spark, d):
    """The whole search space of a closed-form model, tried on all series at once."""
    cfg = config.from_dict({"models": ["seasonal_naive"], "data": {"horizon": 28}, "backtest": {"enabled": True, "n_folds": 3, "horizon": 28, "step": 28, "min_train": 365}, "hpo": {"enabled": True}})
    return spark.createDataFrame([(m, p["season"]) for m, p in C.tune(catalog.filled(spark, d), cfg).items()], "model_type string, season int")


def _uniform(*key: str) -> str:
    return f"(CAST(('0x' || substr(md5('20260726:' || {" || ':' || ".join(key)}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


_ID, _T = "CAST(id AS VARCHAR)", "CAST(t AS VARCHAR)"
GENERATED = f"""WITH s AS (SELECT id, printf('s_%06d', id) AS ts_id, ['trend', 'seasonal', 'intermittent', 'level_shift', 'noise'][id % 5 + 1] AS archetype,
  20 + 180 * {_uniform(_ID, "'level'")} AS level, 0.05::DOUBLE + 0.25::DOUBLE * {_uniform(_ID, "'amp'")} AS amp, floor({_uniform(_ID, "'phase'")} * 7) AS phase,
  0.1::DOUBLE + 0.5::DOUBLE * {_uniform(_ID, "'phi'")} AS phi, 0.02::DOUBLE + 0.18::DOUBLE * {_uniform(_ID, "'slope'")} AS slope, floor(365 + {_uniform(_ID, "'jump'")} * 730) AS jump FROM (SELECT unnest(range(10)) AS id)),
e AS (SELECT s.*, t, {_uniform(_ID, _T, "'e'")} - 0.5::DOUBLE AS e FROM s, (SELECT unnest(range(-7, 1460)) AS t)),
n AS (SELECT *, {" + ".join(f"power(phi, {k}) * lag(e, {k}) OVER w" if k else "e" for k in range(8))} AS noise FROM e WINDOW w AS (PARTITION BY id ORDER BY t)),
p AS (SELECT *, level + 0.17::DOUBLE * level * noise AS base, amp * level * sin(2 * pi() * (t + phase) / 7) AS week FROM n WHERE t >= 0),
y AS (SELECT *, CASE archetype WHEN 'trend' THEN base + slope * level * t / 100 + week
  WHEN 'seasonal' THEN base + 2 * week + 0.2::DOUBLE * level * sin(2 * pi() * t / 365.25::DOUBLE)
  WHEN 'intermittent' THEN CASE WHEN {_uniform(_ID, _T, "'keep'")} < 0.3::DOUBLE THEN base ELSE 0 END
  WHEN 'level_shift' THEN base + CASE WHEN t > jump THEN 0.5::DOUBLE * level ELSE 0 END + week ELSE base END AS v FROM p)
SELECT ts_id, archetype, CAST(DATE '2022-01-01' + CAST(t AS INTEGER) AS DATE) AS ds, round(greatest(v, 0), 3) AS y FROM y"""


@query(GENERATED)
def generator_panel(spark, d):
    return generator.generate_panel(spark, 10)


@query(f"WITH {catalog.HOLIDAYS}, {catalog.PANEL} SELECT ts_id, ds, y, CAST(NULL AS VARCHAR) AS archetype, ds IN (SELECT ds FROM hol) AS is_holiday FROM panel")
def source_rows(spark, d):
    """A panel as rows of the source table."""
    return generator.source_rows(P.daily_sales(spark, d))


@query("""SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2""")
def windowed_event_counts(spark, d):
    from ..streaming import ready

    e = P.load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ready.windowed_counts(e).select("event_type", F.to_date("start").alias("day"), "n")


@query(f"WITH {catalog.OOF}, last AS (SELECT * FROM oof WHERE fold_id = 2) SELECT ts_id, ds, round(avg(yhat), 6) AS yhat FROM last GROUP BY 1, 2")
def stream_ensemble(spark, d):
    """The file stream's blend of the last fold's forecasts, model by model."""
    from ..streaming import ready

    root = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    rows = catalog.oof(spark, d).filter("fold_id = 2").select("ts_id", "model_type", "ds", "yhat")
    for m in catalog.MODELS:
        rows.filter(F.col("model_type") == m).coalesce(1).write.mode("append").parquet(f"{root}/in")
    ready.stream_ensemble(spark, f"{root}/in", f"{root}/out", f"{root}/state", list(catalog.MODELS)).awaitTermination()
    return catalog.rounded(spark.read.parquet(f"{root}/out").select("ts_id", "ds", "yhat"), ["yhat"])
