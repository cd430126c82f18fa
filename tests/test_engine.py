import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.errors import ConfigError, EngineError, ModelError, PanelError
from seriesloom.functions import holidays, metrics, transforms
from seriesloom.models import create, register, registered
from seriesloom.models.base import Model
from seriesloom.operators import cells, ensemble, folds, validate
from seriesloom.plans import config, dag, ids, registry
from seriesloom.plans.sdk import Forecaster
from seriesloom.sources import generator
from seriesloom.sources import panel as P

DAY = dt.date(2023, 1, 1)


def panel(spark, rows):
    return spark.createDataFrame([(s, DAY + dt.timedelta(d), float(y)) for s, d, y in rows], "ts_id string, ds date, y double")


# --- metrics: exact values of a window of three points ---
def test_metric_values(spark):
    rows = [(8.0, 10.0, 6.0, 11.0), (16.0, 12.0, 15.0, 15.5), (50.0, 51.0, 40.0, 60.0)]
    df = spark.createDataFrame([(*r, 2.0, 4.0) for r in rows], "y double, yhat double, lo double, hi double, naive_mae double, naive_mse double")
    r = df.agg(*metrics.metric_aggregates(lower="lo", upper="hi", naive_mae="naive_mae", naive_mse="naive_mse")).first()
    assert r.mae == pytest.approx(7 / 3) and r.mse == 7.0 and r.bias == pytest.approx(-1 / 3)
    assert r.wape == pytest.approx(7 / 74) and r.mape == pytest.approx((0.25 + 0.25 + 0.02) / 3)
    assert r.mase == pytest.approx(7 / 6) and r.rmsse == pytest.approx(7**0.5 / 2)
    assert r.coverage == pytest.approx(2 / 3)
    assert r.pinball == pytest.approx((0.1 * (2 + 1 + 10) / 3 + (0.1 * 3 + 0.9 * 0.5 + 0.1 * 10) / 3) / 2)
    own = cells.metric_values(*(np.array(x) for x in ([8.0, 16, 50], [10.0, 12, 51], [1.0, 3, 5, 7])))
    assert own["mase"] == pytest.approx(r.mase) and own["smape"] == pytest.approx(r.smape)


def test_undefined_metrics_are_null(spark):
    df = spark.createDataFrame([(0.0, 0.0)], "y double, yhat double")
    r = df.agg(*metrics.metric_aggregates()).first()
    assert r.mape is None and r.wape is None and r.mase is None and r.coverage is None and r.smape == 0.0


# --- folds ---
def test_fold_geometry():
    for scheme in ("expanding", "sliding"):
        r = folds.Backtest(3, 7, 5, 20, scheme).ranges(60)
        assert [x[3] for x in r] == [43, 48, 53] and r[-1][4] == 60 and all(x[2] == x[3] for x in r)
        assert all(x[1] == (max(0, x[3] - 20) if scheme == "sliding" else 0) for x in r)
    with pytest.raises(ConfigError):
        folds.Backtest(3, 7, 5, 50).ranges(60)


# --- validation ---
@pytest.mark.parametrize(
    ("rows", "what"),
    [([("a", 0, 1), ("a", 0, 2)], "repeated"), ([("a", 0, 1), ("a", 2, 2)], "gap"), ([("a", 0, 1)], "fewer"), ([], "no rows"), ([("a", 0, 1), (None, 1, 1)], "None")],
)
def test_offenders(spark, rows, what):
    with pytest.raises(PanelError, match=what):
        validate.validate_panel(panel(spark, rows), "D", 2)


def test_off_grid_and_month_ends(spark):
    rows = spark.createDataFrame([("a", dt.date(2024, m, d), 1.0) for m, d in ((1, 31), (2, 29), (3, 31), (4, 30))], "ts_id string, ds date, y double")
    assert validate.gaps(rows, "ME").count() == 0 and validate.off_grid(rows, "ME").count() == 0
    assert validate.off_grid(panel(spark, [("a", 0, 1), ("a", 3, 1), ("a", 7, 1)]), "W").count() == 1
    with pytest.raises(PanelError):
        validate.validate_panel(rows, "Q")


# --- transforms, holidays ---
def test_boxcox_lambda_of_lognormal_is_near_zero(spark):
    rng = np.random.default_rng(1)
    df = panel(spark, [("a", i, v) for i, v in enumerate(np.exp(rng.normal(2, 0.5, 400)))])
    lam = transforms.boxcox_lambda(df).first().lam
    assert abs(lam) < 0.15 and abs(cells.fit_lambda(np.array([r.y for r in df.collect()])) - lam) < 0.05
    with pytest.raises(PanelError):
        transforms.check_domain(panel(spark, [("a", 0, 0)]), "boxcox")


def test_us_holidays():
    days = dict(holidays.us_holidays())
    assert days[dt.date(2024, 11, 28)] == "Thanksgiving Day" and days[dt.date(2021, 12, 24)].endswith("(observed)")
    assert dt.date(2020, 6, 19) not in days and dt.date(2021, 12, 31) in days


# --- ensembles ---
def preds(spark, rows):
    return spark.createDataFrame([(s, m, DAY, float(v)) for s, m, v in rows], "ts_id string, model_type string, ds date, yhat double")


def test_weights(spark):
    score = lambda rows: spark.createDataFrame(rows, "model_type string, wape double")
    w = lambda rows: {r.model_type: r.weight for r in ensemble.inverse_error_weights(score(rows)).collect()}
    assert w([("a", 0.1), ("b", 0.3)]) == pytest.approx({"a": 0.75, "b": 0.25})
    assert w([("a", 0.0), ("b", 0.3)]) == {"a": 1.0, "b": 0.0}
    assert w([("a", None), ("b", None)]) == {"a": 0.5, "b": 0.5}
    p = preds(spark, [("s", "a", 10), ("s", "b", 20), ("t", "b", 20)])
    got = {r.ts_id: r.yhat for r in ensemble.apply_weights(p, ensemble.inverse_error_weights(score([("a", 0.1), ("b", 0.3)]))).collect()}
    assert got == pytest.approx({"s": 12.5, "t": 20.0})
    assert ensemble.prune(p, score([("a", 0.1), ("b", 0.9)]), 0.5).count() == 1


def test_bounds_are_blended(spark):
    rows = [("s", "a", DAY, 10.0, 8.0, 14.0), ("s", "b", DAY, 20.0, 16.0, None), ("t", "b", DAY, 20.0, None, float("nan"))]
    p = spark.createDataFrame(rows, "ts_id string, model_type string, ds date, yhat double, yhat_lower double, yhat_upper double")
    scores = spark.createDataFrame([("a", 0.1), ("b", 0.3)], "model_type string, wape double")
    for strategy, want in (("mean", (15.0, 12.0, 14.0)), ("median", (15.0, 12.0, 14.0)), ("inverse_error", (12.5, 10.0, 14.0))):
        got = {r.ts_id: (r.yhat, r.yhat_lower, r.yhat_upper) for r in ensemble.blend(strategy, p, p, scores, ["a", "b"]).collect()}
        assert got["s"] == pytest.approx(want) and got["t"] == (20.0, None, None)


def test_nnls_against_search():
    rng = np.random.default_rng(2)
    for _ in range(30):
        x = rng.normal(size=(40, 3))
        y = x @ np.array([1.0, -0.5, 0.3]) + rng.normal(size=40)
        w = ensemble.nnls(x.T @ x, x.T @ y)
        slope = x.T @ (y - x @ w)
        assert (w >= 0).all() and (slope <= 1e-6).all() and abs(slope @ w) < 1e-6


def test_no_complete_rows_raise(spark):
    oof = preds(spark, [("s", "a", 1)]).withColumn("fold_id", F.lit(0)).withColumn("y", F.lit(1.0))
    with pytest.raises(EngineError):
        ensemble.gram(oof, ["a", "b"])


# --- models: contract and properties ---
@pytest.mark.parametrize("name", [n for n, m in registered().items() if n not in ("lightgbm", "xgboost", "neuralprophet", "timesfm")])
def test_model_contract(name):
    t = np.arange(140)
    y = np.linspace(10, 40, 140) + 4 * np.sin(2 * np.pi * t / 7) + np.random.default_rng(3).normal(0, 0.5, 140)
    q = create(name, period=7).fit(y).predict(14)
    again = create(name, period=7).fit(y).predict(14)
    assert sorted(q) == [0.1, 0.5, 0.9] and all(len(v) == 14 and np.isfinite(v).all() for v in q.values())
    assert (q[0.1] <= q[0.5] + 1e-9).all() and (q[0.5] <= q[0.9] + 1e-9).all()
    assert all((q[k] == again[k]).all() for k in q)
    truth = 10 + 30 * (140 + np.arange(14)) / 139 + 4 * np.sin(2 * np.pi * (140 + np.arange(14)) / 7)
    assert np.abs(q[0.5] - truth).mean() < (20 if name == "mean" else 4)


def test_structural_fits_all_points_and_long_seasons(monkeypatch):
    from seriesloom.models.statistical import Structural

    seen, own = set(), Structural._filter
    monkeypatch.setattr(Structural, "_filter", lambda self, p, y: seen.add(len(y)) or own(self, p, y))
    t, noise = np.arange(450), np.random.default_rng(4).normal(0, 1, 450)
    week = lambda t: 50 + 5 * np.sin(2 * np.pi * t / 7)
    q = create("ucm", period=7).fit(week(t) + noise).predict(14)
    assert seen == {450} and np.abs(q[0.5] - week(450 + np.arange(14))).mean() < 0.5
    assert ((q[0.9] - q[0.1]) / 2.563 < 1.3).all()  # the noise has a deviation of 1
    year = lambda t: 50 + 5 * np.sin(2 * np.pi * t / 52)
    q = create("ucm", period=52).fit(year(t[:160]) + 0.3 * noise[:160]).predict(52)
    assert np.abs(q[0.5] - year(160 + np.arange(52))).mean() < 1


def plain_loess(y, q, at, weight):
    """One local line, point by point."""
    n = len(y)
    near = sorted(range(n), key=lambda j: (abs(j - at), j))[: min(q, n)]
    h = max(abs(j - at) for j in near) + max(0, (q - n) // 2)
    w = {j: weight[j] * (1 - (abs(j - at) / h) ** 3) ** 3 if abs(j - at) <= 0.999 * h else 0.0 for j in near}
    z = np.array([[1.0, j - at] for j in near]) * np.sqrt([[w[j]] for j in near])
    return np.linalg.lstsq(z, np.array([y[j] for j in near]) * np.sqrt([w[j] for j in near]), rcond=None)[0][0]


def test_loess_and_stl():
    from seriesloom.models.statistical import loess, stl

    rng = np.random.default_rng(5)
    y, weight = rng.normal(size=30), rng.uniform(0.2, 1, 30)
    for q in (7, 15, 41):
        got = loess(y, q, weight, ends=True)
        assert got == pytest.approx([plain_loess(y, q, at, weight) for at in range(-1, 31)], abs=1e-6)
    t = np.arange(280)
    wave = (1 + t / 140) * np.sin(2 * np.pi * t / 7)  # a season that grows
    y = 20 + t / 50 + wave + rng.normal(0, 0.05, 280)
    y[[40, 41, 150, 220]] += 20
    season, trend, rest = stl(y, 7)
    clean = np.delete(np.arange(280), [40, 41, 150, 220])
    assert np.abs(season - wave)[clean].mean() < 0.1 and np.abs(trend - 20 - t / 50)[clean].mean() < 0.1 and (rest[[40, 41, 150, 220]] > 18).all()
    assert season + trend + rest == pytest.approx(y)
    assert stl(np.full(20, 3.0), 7)[2] == pytest.approx(np.zeros(20), abs=1e-9)


def test_stl_bagging_follows_its_season():
    t = np.arange(420)
    wave = lambda t: 10 + (1 + t / 60) * np.sin(2 * np.pi * t / 7)
    y = wave(t) + np.random.default_rng(6).normal(0, 0.1, 420)
    q = create("stl_bagging", period=7).fit(y).predict(7)
    assert np.abs(q[0.5] - wave(420 + np.arange(7))).mean() < 0.5
    with pytest.raises(ModelError):
        create("stl_bagging", period=1).fit(y)


def test_model_errors():
    with pytest.raises(ModelError):
        create("nothing")
    with pytest.raises(ModelError):
        create("theta").fit([1.0])
    with pytest.raises(ModelError):
        create("timesfm").fit(np.arange(50.0))
    with pytest.raises(ModelError):
        register(type("X", (Model,), {"name": "theta"}))


# --- config, identity, plan ---
def test_config():
    c = config.from_dict({"models": ["theta"], "ensemble": {"enabled": True, "strategies": ["nnls", "mean"]}})
    assert c.ensemble.strategies == ("mean",) and c.run_id.startswith("run-") and c.fanout(10) == 10
    for bad in ({"models": []}, {"models": ["a", "a"]}, {"models": ["a"], "x": 1}, {"models": ["a"], "hpo": {"enabled": True}}):
        with pytest.raises(ConfigError):
            config.from_dict(bad)
    assert config.from_dict({"models": ["theta"], "ensemble": {"strategy": "mean"}}).ensemble.strategies == ("mean",)


def test_ids():
    assert ids.parse_job_key(ids.job_key("run-1-native-a2", "ml", 3)) == ("run-1-native-a2", "ml", 3)
    assert ids.ensemble_id(["a", "b"], 0.0) == ids.ensemble_id(["b", "a"], 0.0) != ids.ensemble_id(["a"], 0.0)
    for bad in ("job-x-unknown-a1", "job-x-ml-a0", "job-x-ml-a01", "job-x-ml-b1", "other-x-ml-a1", "job-ml-a1", ""):
        with pytest.raises(ValueError):
            ids.parse_job_key(bad)


def test_dag():
    c = config.from_dict({"models": ["theta", "lag_ridge", "arima_plus"], "ensemble": {"enabled": True}})
    d = dag.plan_dag(c)
    assert d.families == ["statistical", "ml", "native"] and d.nodes()[-1] == ("ensemble", ("statistical", "ml", "native"))
    assert dag.by_runtime(c) == (["theta", "lag_ridge"], ["arima_plus"])
    assert dag.combined_status({"a": "COMPLETED", "b": "FAILED"}) == "PARTIAL"


def test_clean_json():
    assert registry.clean_json({"a": float("nan")}) is None and json.loads(registry.clean_json({"a": 1.0, "b": float("inf")})) == {"a": 1.0}


# --- generator ---
def test_generator_is_partition_free(spark):
    a = {(r.ts_id, r.ds): r.y for r in generator.generate_panel(spark, 7, 30).collect()}
    b = {(r.ts_id, r.ds): r.y for r in generator.generate_panel(spark, 5, 30).collect()}
    assert len(a) == 210 and all(a[k] == v for k, v in b.items())


# --- cells ---
def test_regressors_and_tuning(spark):
    source = generator.generate_panel(spark, 2, 150).select("ts_id", "ds", "y").withColumn("price", F.dayofmonth("ds").cast("double"))
    base = {"models": ["prophet"], "data": {"horizon": 7}, "features": {"holidays": ["US"], "fourier": True, "lags": [1, 7, 14], "exog": ["price"], "transform": "log1p"}, "backtest": {"enabled": True, "n_folds": 2, "horizon": 7, "step": 7, "min_train": 60}, "hpo": {"enabled": True, "n_trials": 2, "granularity": "per_series"}}
    cfg = config.from_dict(base)
    import pandas as pd

    ds = pd.date_range("2023-12-20", periods=20)
    x, later = cells.design(ds, np.arange(20.0), None, cfg, cells.holiday_days(("US",)))
    assert x.shape == (20, 9) and later.shape == (7, 9)  # a flag, six terms, lags of 7 and 14
    assert x[:, 0].sum() == 2 and (later[:, 7] == np.arange(13.0, 20.0)).all()
    best = cells.tune_by_series(source, cfg, n_series=2)
    assert best.count() == 2
    out = cells.run_cells(source, cfg, n_series=2, by_series=best)
    assert {r.status for r in out.select("status").collect()} == {"ok"} and cells.metadata(out).filter("wape IS NOT NULL AND best_params IS NOT NULL").count() == 2
    with pytest.raises(ConfigError):
        cells.holiday_days(("XX",))
    own = config.from_dict({"models": ["theta"], "features": {"holidays": ["XX"], "calendars": {"XX": ["2024-02-29"]}}})
    assert cells.holiday_days(own.features.holidays, own.features.calendars) == {dt.date(2024, 2, 29)}


def test_registered_tuning_covers_all_series_and_values(spark, sf):
    from seriesloom.plans import catalog

    cfg = config.from_dict({"models": ["lag_ridge"], "data": {"horizon": 28}, "backtest": {"enabled": True, "n_folds": 2, "min_train": 365}})
    scores = {}
    for alpha in create("lag_ridge").search_space()["alpha"]:
        rows = cells.metadata(cells.run_cells(catalog.filled(spark, sf), cfg, {"lag_ridge": {"alpha": alpha}}, 3)).collect()
        assert {r.ts_id for r in rows} == {"A", "N", "R"}
        scores[alpha] = np.mean([r.wape for r in rows])
    got = catalog.QUERIES["hpo_fleetwide"](spark, sf).collect()
    assert [(r.model_type, json.loads(r.best_params)) for r in got] == [("lag_ridge", {"alpha": min(scores, key=scores.get)})]


def test_registered_generator_has_four_years(spark, sf):
    from seriesloom.plans import catalog

    assert {r["count"] for r in catalog.QUERIES["generator_panel"](spark, sf).groupBy("ts_id").count().collect()} == {1460}


# --- a whole run ---
def test_run_end_to_end(spark, tmp_path):
    source = generator.generate_panel(spark, 3, 120).select("ts_id", "ds", "y")
    f = Forecaster.from_dict(
        {"models": ["theta", "lag_ridge", "timesfm"], "data": {"horizon": 7}, "backtest": {"enabled": True, "n_folds": 2, "horizon": 7, "step": 7, "min_train": 60}, "ensemble": {"enabled": True, "strategies": ["mean", "inverse_error", "nnls"]}},
        spark,
        f"file://{tmp_path}/registry",
    )
    assert f.dry_run()["families"] == ["statistical", "ml", "native"]
    assert f.run(source) == "PARTIAL" == f.status()
    board = {r.model_type: r for r in f.results().collect()}
    assert set(board) == {"theta", "lag_ridge", "timesfm", "ensemble_mean", "ensemble_inverse_error", "ensemble_nnls"}
    assert board["timesfm"].error_rate == 1.0 and board["theta"].n_cells == 3 and board["ensemble_mean"].mean_wape > 0
    counts = {r.model_type: r["count"] for r in f.registry.prediction_counts(f.run_id).collect()}
    assert counts["theta"] == 21 and counts["ensemble_nnls"] == 21
    assert f.trace().filter("kind = 'cell'").count() == 9 and f.jobs().count() == 3
    f.blend(("mean",))
    assert f.results().filter("model_type = 'ensemble_mean'").count() == 2  # another ensemble, other id
    f.registry.create_views()
    assert spark.table("v_run_summary").count() == 1


def test_hourly_run_keeps_every_hour(spark, tmp_path):
    start = dt.datetime(2023, 1, 1)
    rows = [(s, start + dt.timedelta(hours=k), 10.0 + k % 24 + k / 50) for s in ("a", "b") for k in range(144)]
    source = spark.createDataFrame(rows, "ts_id string, ds timestamp_ntz, y double")
    f = Forecaster.from_dict(
        {"models": ["theta", "prophet"], "data": {"horizon": 24, "freq": "h"}, "backtest": {"enabled": True, "n_folds": 2, "horizon": 24, "step": 24, "min_train": 72}, "ensemble": {"enabled": True, "strategies": ["mean"]}},
        spark,
        f"file://{tmp_path}/registry",
    )
    assert f.run(source) == "COMPLETED"
    counts = {r.model_type: r["count"] for r in f.registry.prediction_counts(f.run_id).collect()}
    assert counts == {"theta": 48, "prophet": 48, "ensemble_mean": 48}
    hours = f.registry.read("backtest_oof", f.run_id).groupBy("model_type").agg(F.count_distinct("ts_id", "forecast_date").alias("n"))
    assert {r.model_type: r.n for r in hours.collect()} == {"theta": 96, "prophet": 96, "ensemble_mean": 96}
    first = f.registry.read("forecast_predictions", f.run_id).agg(F.min("forecast_date"), F.max("forecast_date")).first()
    assert tuple(first) == (start + dt.timedelta(hours=144), start + dt.timedelta(hours=167))


def test_older_tables_with_dates_are_read(spark, tmp_path):
    r = registry.Registry(spark, f"file://{tmp_path}")
    spark.sql("SELECT 'a' AS ts_id, DATE'2023-01-02' AS forecast_date, 'r' AS run_id").write.partitionBy("run_id").parquet(r.path("forecast_predictions"))
    assert r.read("forecast_predictions", "r").first().forecast_date == dt.datetime(2023, 1, 2)


def test_fill_and_limit(spark):
    p = panel(spark, [("b", 0, 1), ("b", 3, 2), ("a", 0, 1)])
    assert P.fill_calendar(p).count() == 5 and [r.ts_id for r in P.series_ids(P.limit_series(p, 1)).collect()] == ["a"]


RUN = {"models": ["drift", "mean"], "data": {"horizon": 7}, "backtest": {"enabled": True, "n_folds": 2, "horizon": 7, "step": 7, "min_train": 60}, "ensemble": {"enabled": True, "strategies": ["mean", "inverse_error"]}}


def test_artifacts_review_and_snapshot(spark, tmp_path):
    source = generator.generate_panel(spark, 3, 120).select("ts_id", "ds", "y")
    f = Forecaster.from_dict({**RUN, "compute": {"persist_models": True}}, spark, f"file://{tmp_path}/registry")
    f.run(source)
    rows = {r.forecast_date: r.yhat for r in f.registry.read("forecast_predictions", f.run_id).filter("ts_id = 's_000001' AND model_type = 'drift'").collect()}
    model = f.load_model("s_000001", "drift")
    assert model.predict(7)[0.5].tolist() == pytest.approx([rows[k] for k in sorted(rows)]) and f.load_model("s_000009", "drift") is None
    meta = f.registry.read("forecast_metadata", f.run_id)
    assert meta.filter("model_artifact IS NULL AND ensemble_id IS NULL").count() == 0 and meta.filter("model_hash IS NULL").count() == 0
    assert {r.no_artifact_rate for r in f.results().filter("ensemble_id IS NULL").collect()} == {0.0}
    assert f.snapshot().count() == 360
    look = f.review()
    assert look["status"] == "COMPLETED" and look["predictions"]["ensemble_mean"] == 21 and look["errors"] == [] and len(look["models"]) == 4 and look["run"]["runtime_version"] == spark.version
    assert f.registry.recent_runs().count() == 1 and f.registry.cell_timing(f.run_id, 3).count() == 3


def test_microbatch_run_blends_every_series_once(spark, tmp_path):
    source = generator.generate_panel(spark, 3, 120).select("ts_id", "ds", "y")
    same = {}
    for mode in ("barrier", "microbatch"):
        cfg = {**RUN, "models": ["drift", "lag_ridge"], "run_name": mode, "compute": {"ensemble_mode": mode, "microbatch_interval_s": 1}}
        f = Forecaster.from_dict(cfg, spark, f"file://{tmp_path}/registry")
        assert f.run(source) == "COMPLETED"
        rows = f.registry.read("forecast_predictions", f.run_id).filter("ensemble_id IS NOT NULL").collect()
        same[mode] = sorted((r.model_type, r.ts_id, r.forecast_date, round(r.yhat, 9)) for r in rows)
        assert f.results().count() == 4
    assert len(same["barrier"]) == 42 and same["barrier"] == same["microbatch"]


def test_stream_waits_for_all_models(spark, tmp_path):
    from seriesloom.streaming import ready

    root = f"file://{tmp_path}"
    rows = lambda m, ids: preds(spark, [(s, m, 1) for s in ids]).coalesce(1).write.mode("append").parquet(f"{root}/in")
    go = lambda: ready.stream_ensemble(spark, f"{root}/in", f"{root}/out", f"{root}/state", ["a", "b"]).awaitTermination()
    rows("a", "xy"), go()
    assert spark.read.schema("ts_id string").parquet(f"{root}/out").count() == 0
    rows("b", "x"), go()
    assert [r.ts_id for r in spark.read.parquet(f"{root}/out").collect()] == ["x"]
    rows("b", "xy"), go()  # x again: it went out already
    assert sorted(r.ts_id for r in spark.read.parquet(f"{root}/out").collect()) == ["x", "y"]


def test_catalog_tables(spark, tmp_path):
    r = registry.Registry(spark, f"file://{tmp_path}/r")
    r.create_tables("loom_test")
    assert {t.name for t in spark.catalog.listTables("loom_test") if not t.isTemporary} == set(registry.TABLES) and r.migrate("loom_test") == []
    spark.sql("DROP TABLE loom_test.run_jobs")
    spark.sql(f"CREATE TABLE loom_test.run_jobs (family string, run_id string) USING parquet PARTITIONED BY (run_id) LOCATION '{r.path('run_jobs')}'")
    assert len(r.migrate("loom_test")) == 9 and r.migrate("loom_test") == []
    assert set(spark.table("loom_test.run_jobs").columns) == {c.split()[0] for c in registry.TABLES["run_jobs"].split(", ")}
    r.drop_tables("loom_test")
    assert not any(not t.isTemporary for t in spark.catalog.listTables("loom_test"))
    spark.sql("DROP DATABASE loom_test")


def test_command_line(spark, tmp_path, capsys):
    from seriesloom.plans import sdk

    generator.generate_panel(spark, 2, 120).write.parquet(f"{tmp_path}/panel")
    (tmp_path / "c.json").write_text(json.dumps({**RUN, "data": {"horizon": 7, "source_table": f"file://{tmp_path}/panel"}}))
    said = lambda *args: (sdk.main([*args, "--registry", f"file://{tmp_path}/r"]), capsys.readouterr().out.strip())[1]
    assert json.loads(said("--config", f"{tmp_path}/c.json", "--dry-run"))["families"] == ["statistical"]
    assert said("--config-uri", f"file://{tmp_path}/c.json", "--stage-only") == "2"
    assert said("--config", f"{tmp_path}/c.json") == "COMPLETED" and said("--config", f"{tmp_path}/c.json", "--strategies", "median") == "COMPLETED"
    with pytest.raises(ConfigError):
        sdk.main(["--config-uri", f"file://{tmp_path}/panel", "--registry", "x"])


def test_helpers_and_exports(spark):
    import seriesloom

    panel_ = seriesloom.sample_data(spark, 2, 60)
    out = seriesloom.run_model(panel_, "seasonal_naive", horizon=3, season=7)
    assert out.count() == 6 and out.columns[:3] == ["ts_id", "model_type", "forecast_date"]
    with pytest.raises(EngineError, match="slot"):
        seriesloom.run_model(panel_, "timesfm")
    assert set(seriesloom.__all__) == set(dir(seriesloom)) and all(getattr(seriesloom, n) for n in seriesloom.__all__)
    with pytest.raises(AttributeError):
        seriesloom.nothing  # noqa: B018
    assert P.sample_series(panel_, 1).num_rows == 60 and [r.ts_id for r in P.history(panel_).limit(1).collect()] == ["s_000000"]
    with pytest.raises(ConfigError):
        P.sample_series(panel_, 10**6)


def test_sources_by_name_and_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    panel(spark, [("a", 0, 1), ("a", 1, 2)]).coalesce(1).write.parquet(path)
    files = P.snapshot_files(P.resolve(spark, path))
    panel(spark, [("b", 0, 1)]).coalesce(1).write.mode("append").parquet(path)
    assert P.resolve(spark, path).count() == 3 and P.read_snapshot(spark, files).count() == 2
    P.resolve(spark, path).createOrReplaceTempView("named_panel")
    assert P.resolve(spark, "named_panel").count() == 3


def test_unparsed_rows(spark):
    raw = spark.createDataFrame([("a", "2024-01-01", "1.5"), ("b", "x", "2"), ("c", "2024-01-02", "y"), ("d", "2024-01-03", None)], "k string, day string, v string")
    assert {(r.ts_id, r.bad_date, r.bad_target) for r in validate.parse_rows(raw, "k", "day", "v").collect()} == {("b", True, False), ("c", False, True)}


def test_options_without_effect_are_named(caplog):
    config.from_dict({"models": ["theta"], "compute": {"read_max_streams": 4, "families": {"ml": {"gpu": 1, "max_parallelism": 3}}}, "features": {"level_shift": True}, "hpo": {"engine": "tpe"}})
    said = caplog.text
    assert all(x in said for x in ("read_max_streams", "ml.gpu", "level_shift", "hpo.engine")) and "max_parallelism" not in said
    cfg = config.from_dict({"models": ["theta"], "compute": {"families": {"ml": {"bucket_target_cells": 2}}}})
    assert cells.bucket_count(cfg.for_family("ml"), 10) == 5 and cells.bucket_count(cfg.for_family("statistical"), 10) == 2


def test_generator_options(spark):
    plain = {(r.ts_id, r.ds): r for r in generator.generate_panel(spark, 5, 60, start="2023-12-01", exog=True).collect()}
    busy = {(r.ts_id, r.ds): r for r in generator.generate_panel(spark, 5, 60, start="2023-12-01", exog=True, holiday_effect=True, spike_rate=1.0).collect()}
    noel = ("s_000000", dt.date(2023, 12, 25))
    assert busy[noel].y == pytest.approx(plain[noel].y * generator.HOLIDAY * generator.SPIKE, abs=0.01) and plain[noel].price_index == pytest.approx(1 + 0.1 * np.cos(2 * np.pi * 24 / 30))
    for freq, last in (("W", dt.date(2022, 1, 15)), ("MS", dt.date(2022, 3, 1)), ("ME", dt.date(2022, 3, 31)), ("h", dt.datetime(2022, 1, 1, 2))):
        assert generator.generate_panel(spark, 1, 3, freq=freq).agg(F.max("ds")).first()[0] == last
    kinds = {r.archetype: r.sd for r in generator.generate_panel(spark, 10, 400).groupBy("archetype").agg(F.stddev("y").alias("sd")).collect()}
    assert set(kinds) == set(generator.ARCHETYPES) and all(v > 0 for v in kinds.values())
    with pytest.raises(ConfigError):
        generator.generate_panel(spark, 1, freq="Q")


def test_seeded_tables(spark, tmp_path):
    paths = generator.seed_tables(spark, f"file://{tmp_path}", 3, 40)
    a, b = (sorted(map(tuple, spark.read.format(f).load(p).select("ts_id", "ds", "y", "archetype", "is_holiday").collect())) for f, p in paths.items())
    assert len(a) == 120 and a == b and sum(r[4] for r in a) == 3 * 2
    with pytest.raises(Exception, match="exist"):
        generator.seed_tables(spark, f"file://{tmp_path}", 3, 40)
    generator.seed_tables(spark, f"file://{tmp_path}", 2, 40, reseed=True)
    assert spark.read.parquet(paths["parquet"]).count() == 80


class FakeTrees:
    """Stands for a library's regressor: a least-squares fit with the library's surface."""

    def __init__(self, **params):
        self.params = params

    def fit(self, x, y):
        self.beta = np.linalg.lstsq(np.column_stack([x, np.ones(len(x))]), y, rcond=None)[0]
        self.feature_importances_ = np.abs(self.beta[:-1])
        return self

    def predict(self, x):
        return np.column_stack([x, np.ones(len(x))]) @ self.beta


@pytest.mark.parametrize(("library", "name"), [("lightgbm", "LGBMRegressor"), ("xgboost", "XGBRegressor")])
def test_plugins_with_a_stub(library, name, monkeypatch):
    import importlib.machinery
    import sys
    import types

    t = np.arange(140)
    y = 10 + t / 10 + 4 * np.sin(2 * np.pi * t / 7)
    with pytest.raises(ModelError, match=library):
        create(library).fit(y)
    stub = types.ModuleType(library)
    stub.__spec__ = importlib.machinery.ModuleSpec(library, None)
    setattr(stub, name, FakeTrees)
    monkeypatch.setitem(sys.modules, library, stub)
    m = create(library, max_depth=2).fit(y)
    assert m.fitted.params["max_depth"] == 2 and m.fitted.params["n_jobs"] == 1
    assert np.abs(m.predict(7)[0.5] - (10 + (140 + np.arange(7)) / 10 + 4 * np.sin(2 * np.pi * (140 + np.arange(7)) / 7))).mean() < 1


def test_tree_weights_with_a_stub(spark, monkeypatch):
    import sys
    import types

    rows = [("s", m, DAY + dt.timedelta(d), 0, float(d), float(d * k + d % 3)) for d in range(1, 30) for m, k in (("a", 1), ("b", 3))]
    oof = spark.createDataFrame(rows, "ts_id string, model_type string, ds date, fold_id int, y double, yhat double")
    with pytest.raises(EngineError, match="xgboost"):
        ensemble.blend("xgb", oof, oof, oof, ["a", "b"])
    stub = types.ModuleType("xgboost")
    stub.XGBRegressor = FakeTrees
    monkeypatch.setitem(sys.modules, "xgboost", stub)
    w = {r.model_type: r.weight for r in ensemble.learned_weights(oof, "xgb", ["a", "b"]).collect()}
    assert sum(w.values()) == pytest.approx(1) and min(w.values()) >= 0
    assert ensemble.tree_weights(oof, ["a", "b"], rows=5).sum() == pytest.approx(1)
    assert ensemble.blend("xgb", oof, oof, oof, ["a", "b"]).count() == 29
