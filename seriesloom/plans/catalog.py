"""All registered queries of the forecasting engine, each beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import holidays, metrics, transforms
from ..operators import baselines, ensemble, features, folds, validate
from ..sources import panel as P
from . import registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PLAN = folds.Backtest(n_folds=3, horizon=28, step=28, min_train=365)
SLIDING = folds.Backtest(n_folds=3, horizon=28, step=28, min_train=365, scheme="sliding")
MODELS = ("seasonal_naive", "mean", "drift", "linear_trend")
TWO = ("seasonal_naive", "mean")

# --- SQL parts -----------------------------------------------------------------
PANEL = "panel AS (SELECT l_returnflag AS ts_id, CAST(l_shipdate AS DATE) AS ds, sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2)"
FILLED = PANEL + """,
spine AS (SELECT ts_id, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM panel GROUP BY ts_id),
filled AS (SELECT s.ts_id, s.ds, coalesce(p.y, 0) AS y FROM spine s LEFT JOIN panel p ON p.ts_id = s.ts_id AND p.ds = s.ds)"""
EVENTS = "panel AS (SELECT event_type AS ts_id, CAST(ts AS DATE) AS ds, CAST(count(*) AS DOUBLE) AS y FROM events GROUP BY 1, 2)"


def _split_sql(scheme: str = "expanding") -> str:
    low = "AND step > -365" if scheme == "sliding" else ""
    return FILLED + f""",
placed AS (SELECT *, row_number() OVER (PARTITION BY ts_id ORDER BY ds) AS pos, count(*) OVER (PARTITION BY ts_id) AS n FROM filled),
steps AS (SELECT p.*, fold_id, pos - (n - back) AS step FROM placed p, (VALUES (0, 84), (1, 56), (2, 28)) f(fold_id, back)),
folds AS (SELECT ts_id, fold_id, ds, y, CASE WHEN step <= 0 THEN 'train' ELSE 'val' END AS part, step, pos
  FROM steps WHERE step <= 28 {low})"""


FOLDS = _split_sql()
STATS = FOLDS + """,
train AS (SELECT * FROM folds WHERE part = 'train'), val AS (SELECT * FROM folds WHERE part = 'val'),
stats AS (SELECT ts_id, fold_id, avg(y) AS m, min_by(y, ds) AS a, max_by(y, ds) AS b, count(*) AS n,
  regr_slope(y, pos) AS slope, regr_intercept(y, pos) AS icpt FROM train GROUP BY 1, 2)"""
OOF = STATS + """,
oof AS (
  SELECT v.ts_id, 'seasonal_naive' AS model_type, v.fold_id, v.ds, v.step, v.y, t.y AS yhat
    FROM val v JOIN train t ON t.ts_id = v.ts_id AND t.fold_id = v.fold_id AND t.step = (v.step - 1) % 7 - 6
  UNION ALL SELECT v.ts_id, 'mean', v.fold_id, ds, step, y, m FROM val v JOIN stats s ON s.ts_id = v.ts_id AND s.fold_id = v.fold_id
  UNION ALL SELECT v.ts_id, 'drift', v.fold_id, ds, step, y, b + step * (b - a) / (n - 1) FROM val v JOIN stats s ON s.ts_id = v.ts_id AND s.fold_id = v.fold_id
  UNION ALL SELECT v.ts_id, 'linear_trend', v.fold_id, ds, step, y, icpt + slope * pos FROM val v JOIN stats s ON s.ts_id = v.ts_id AND s.fold_id = v.fold_id)"""
SCALE = """,
diffs AS (SELECT ts_id, fold_id, y - lag(y) OVER (PARTITION BY ts_id, fold_id ORDER BY ds) AS d FROM train),
scale AS (SELECT ts_id, fold_id, avg(abs(d)) AS naive_mae, avg(d * d) AS naive_mse FROM diffs GROUP BY 1, 2)"""
PANEL_METRICS = """avg(abs(yhat - y)) AS mae, avg((yhat - y) * (yhat - y)) AS mse, sqrt(avg((yhat - y) * (yhat - y))) AS rmse, avg(yhat - y) AS bias,
  CASE WHEN count(*) FILTER (y = 0) = 0 THEN avg(CASE WHEN y <> 0 THEN abs(yhat - y) / abs(y) END) END AS mape,
  avg(CASE WHEN abs(y) + abs(yhat) = 0 THEN 0 ELSE 2 * abs(yhat - y) / (abs(y) + abs(yhat)) END) AS smape,
  CASE WHEN sum(abs(y)) <> 0 THEN sum(abs(yhat - y)) / sum(abs(y)) END AS wape"""
SCORES = OOF + SCALE + f""",
scores AS (SELECT o.ts_id, model_type, o.fold_id, {PANEL_METRICS},
  CASE WHEN max(naive_mae) <> 0 THEN avg(abs(yhat - y)) / max(naive_mae) END AS mase,
  CASE WHEN max(naive_mse) <> 0 THEN sqrt(avg((yhat - y) * (yhat - y))) / sqrt(max(naive_mse)) END AS rmsse,
  CAST(NULL AS DOUBLE) AS coverage, CAST(NULL AS DOUBLE) AS pinball
  FROM oof o JOIN scale s ON s.ts_id = o.ts_id AND s.fold_id = o.fold_id GROUP BY 1, 2, 3)"""


def _rounded(names: tuple[str, ...] | list[str]) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def rounded(df: DataFrame, names: tuple[str, ...] | list[str]) -> DataFrame:
    """Comparable doubles: six places."""
    return df.select(*(F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns))


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# --- panels ----------------------------------------------------------------------
@query(f"WITH {PANEL} SELECT ts_id, ds, y FROM panel")
def panel_daily(spark, d):
    return P.as_panel(P.daily_sales(spark, d))


@query("SELECT o_orderpriority AS ts_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds, CAST(count(*) AS DOUBLE) AS y FROM orders GROUP BY 1, 2")
def panel_monthly(spark, d):
    return P.as_panel(P.monthly_orders(spark, d), freq="MS")


@query(f"WITH {FILLED} SELECT ts_id, ds, y FROM filled")
def panel_spine_filled(spark, d):
    return filled(spark, d)


def filled(spark, d):
    return P.fill_calendar(P.as_panel(P.daily_sales(spark, d))).select("ts_id", "ds", "y")


def events(spark, d):
    return P.as_panel(P.daily_events(spark, d))


@query(f"WITH {PANEL} SELECT ts_id, ds, y FROM panel WHERE ts_id IN (SELECT DISTINCT ts_id FROM panel ORDER BY ts_id LIMIT 2)")
def series_limit(spark, d):
    return P.limit_series(P.as_panel(P.daily_sales(spark, d)), 2)


@query(f"WITH {PANEL} SELECT DISTINCT ts_id FROM panel")
def series_ids(spark, d):
    return P.series_ids(P.as_panel(P.daily_sales(spark, d)))


@query(f"WITH {PANEL} SELECT ts_id, ds, y FROM panel WHERE ds <= (SELECT max(ds) - 28 FROM panel)")
def training_window(spark, d):
    p = P.as_panel(P.daily_sales(spark, d))
    last = p.agg(F.date_sub(F.max("ds"), 28).alias("cut"))
    return p.join(F.broadcast(last), F.col("ds") <= F.col("cut")).drop("cut")  # one row


# --- validation ------------------------------------------------------------------
@query("SELECT event_type AS ts_id, CAST(ts AS DATE) AS ds, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def validate_duplicates(spark, d):
    return validate.duplicates(P.as_panel(P.load(spark, d, "events"), "event_type", "ts", "value"))


@query(f"WITH {FILLED} SELECT ts_id, ds FROM spine s ANTI JOIN panel p ON p.ts_id = s.ts_id AND p.ds = s.ds")
def validate_gaps(spark, d):
    return validate.gaps(P.as_panel(P.daily_sales(spark, d)))


WEEKLY_SQL = f"""WITH {PANEL},
ends AS (SELECT ts_id, min(ds) AS lo, max(ds) AS hi FROM panel GROUP BY ts_id),
grid AS (SELECT ts_id, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS ds FROM ends)
SELECT ts_id, ds FROM panel p ANTI JOIN grid g ON g.ts_id = p.ts_id AND g.ds = p.ds"""


@query(WEEKLY_SQL)
def validate_off_grid(spark, d):
    return validate.off_grid(P.as_panel(P.daily_sales(spark, d)), "W")


@query(f"WITH {EVENTS} SELECT ts_id, count(*) AS n FROM panel GROUP BY ts_id HAVING count(*) < 449")
def validate_min_history(spark, d):
    return validate.short_series(events(spark, d), validate.required_history(28, {"min_train": 365, "horizon": 28, "n_folds": 3, "step": 28}))


@query(f"WITH {PANEL}, e AS (SELECT ts_id, count(*) AS n, min(ds) AS lo, max(ds) AS hi FROM panel GROUP BY 1) SELECT count(*) AS n_series, CAST(sum(n) AS BIGINT) AS n_rows, min(lo) AS first_ds, max(hi) AS last_ds, min(n) AS min_history FROM e")
def panel_report(spark, d):
    return validate.report(P.as_panel(P.daily_sales(spark, d)))


@query("SELECT l_returnflag AS ts_id, CAST(l_shipdate AS DATE) AS ds, l_quantity AS y FROM lineitem")
def panel_by_path(spark, d):
    """A source named by its path, under its roles."""
    return P.as_panel(P.resolve(spark, f"{d}/lineitem.parquet"), "l_returnflag", "l_shipdate", "l_quantity")


@query("SELECT l_returnflag AS ts_id, CAST(l_shipdate AS DATE) AS ds, l_quantity AS y FROM lineitem")
def panel_snapshot(spark, d):
    """The same from the recorded list of its files."""
    files = P.snapshot_files(P.resolve(spark, f"{d}/lineitem.parquet"))
    return P.as_panel(P.read_snapshot(spark, files), "l_returnflag", "l_shipdate", "l_quantity")


@query(f"WITH {PANEL} SELECT ts_id, ds, y FROM panel")
def panel_history(spark, d):
    """All points, by series and date."""
    return P.history(P.as_panel(P.daily_sales(spark, d)))


@query(f"WITH {PANEL} SELECT ts_id, ds, y FROM panel WHERE ts_id = (SELECT min(ts_id) FROM panel)")
def panel_sample(spark, d):
    """The first series as it reaches the driver."""
    return spark.createDataFrame(P.sample_series(P.as_panel(P.daily_sales(spark, d)), 1))


@query(f"WITH {FILLED}, e AS (SELECT ts_id, count(*) AS n, min(ds) AS lo, max(ds) AS hi FROM filled GROUP BY 1) SELECT count(*) AS n_series, CAST(sum(n) AS BIGINT) AS n_rows, min(lo) AS first_ds, max(hi) AS last_ds, min(n) AS min_history FROM e")
def validate_whole_panel(spark, d):
    """All checks in order, on a panel that passes them."""
    return validate.validate_panel(filled(spark, d), "D", validate.required_history(28, {"min_train": 365, "horizon": 28, "n_folds": 3, "step": 28}))


RAW = "raw AS (SELECT CAST(event_id AS VARCHAR) AS k, CASE WHEN event_id % 7 = 0 THEN 'day ' || event_type ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS day, CASE WHEN event_id % 5 = 0 THEN event_type WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS v FROM events)"


@query(f"WITH {RAW} SELECT k AS ts_id, TRY_CAST(day AS TIMESTAMP) IS NULL AS bad_date, v IS NOT NULL AND TRY_CAST(v AS DOUBLE) IS NULL AS bad_target FROM raw WHERE TRY_CAST(day AS TIMESTAMP) IS NULL OR (v IS NOT NULL AND TRY_CAST(v AS DOUBLE) IS NULL)")
def validate_unparsed(spark, d):
    """Rows whose date or number does not parse."""
    e = F.col("event_id")
    day = F.when(e % 7 == 0, F.concat(F.lit("day "), "event_type")).otherwise(F.to_date("ts").cast("string"))
    v = F.when(e % 5 == 0, F.col("event_type")).when(e % 11 == 0, None).otherwise(e.cast("string"))
    return validate.parse_rows(P.load(spark, d, "events").select(e.cast("string").alias("k"), day.alias("day"), v.alias("v")), "k", "day", "v")


@query("SELECT n_name AS ts_id FROM nation WHERE n_nationkey % 2 = 0")
def validate_null_dates(spark, d):
    """Points without a date."""
    n = P.load(spark, d, "nation")
    panel = n.select(F.col("n_name").alias("ts_id"), F.when(F.col("n_nationkey") % 2 == 1, F.lit("2024-01-01").cast("date")).alias("ds"), F.lit(1.0).alias("y"))
    return validate.undated(panel).select("ts_id")


# --- features and transforms -----------------------------------------------------
@query(f"WITH {FILLED} SELECT ts_id, ds, y, CAST(isodow(ds) - 1 AS INTEGER) AS dow, CAST(day(ds) AS INTEGER) AS dom, CAST(month(ds) AS INTEGER) AS month, CAST(dayofyear(ds) AS INTEGER) AS doy FROM filled")
def calendar_features(spark, d):
    return features.calendar(filled(spark, d))


@query("WITH " + FILLED + " SELECT ts_id, ds, y, " + ", ".join(f"lag(y, {k}) OVER w AS lag_{k}" for k in (1, 7, 28)) + " FROM filled WINDOW w AS (PARTITION BY ts_id ORDER BY ds)")
def lag_features(spark, d):
    return features.lags(filled(spark, d), (1, 7, 28))


@query("WITH " + FILLED + ", l AS (SELECT *, " + ", ".join(f"lag(y, {k}) OVER w AS lag_{k}" for k in features.TREE_LAGS) + " FROM filled WINDOW w AS (PARTITION BY ts_id ORDER BY ds)) SELECT *, CAST(isodow(ds) - 1 AS INTEGER) AS dow, CAST(day(ds) AS INTEGER) AS dom, CAST(month(ds) AS INTEGER) AS month, CAST(dayofyear(ds) AS INTEGER) AS doy FROM l WHERE lag_28 IS NOT NULL")
def tree_design(spark, d):
    return features.tree_design(filled(spark, d))


FOURIER = [f"{n}_{k}" for k in (1, 2, 3) for n in ("sin", "cos")]


@query(f"WITH {FILLED} SELECT ts_id, ds, y, " + ", ".join(f"round({n}(date_diff('day', DATE '1970-01-01', ds) * (2 * pi() * {k} / 365.25)), 6) AS {n}_{k}" for k in (1, 2, 3) for n in ("sin", "cos")) + " FROM filled")
def fourier_terms(spark, d):
    return rounded(features.fourier(filled(spark, d)), FOURIER)


def _holiday_values() -> str:
    return ", ".join(f"(DATE '{x}', '{n.replace(chr(39), chr(39) * 2)}')" for x, n in holidays.us_holidays())


HOLIDAYS = f"hol(ds, holiday) AS (VALUES {_holiday_values()})"


@query(f"WITH {HOLIDAYS}, {FILLED} SELECT ts_id, ds, y, ds IN (SELECT ds FROM hol) AS is_holiday FROM filled")
def holiday_flag(spark, d):
    return holidays.flag(filled(spark, d), holidays.holiday_frame(spark, ["US"])).select("ts_id", "ds", "y", "is_holiday")


@query(f"WITH {HOLIDAYS} SELECT ds, holiday FROM hol UNION ALL SELECT DISTINCT CAST(o_orderdate AS DATE), 'order day' FROM orders WHERE o_orderkey % 1000 = 1")
def holiday_calendars(spark, d):
    """A country by rule, and one from a table."""
    own = P.load(spark, d, "orders").filter("o_orderkey % 1000 = 1").select(F.to_date("o_orderdate").alias("ds"), F.lit("order day").alias("holiday")).distinct()
    return holidays.holiday_frame(spark, ["US", "XX"], {"XX": own})


@query(f"WITH {HOLIDAYS} SELECT holiday, ds AS \"of\", CAST(ds + k AS DATE) AS ds FROM hol, (VALUES (-1), (0), (1)) v(k)")
def holiday_windows(spark, d):
    return holidays.windows(holidays.holiday_frame(spark, ["US"]))


@query(f"WITH {FILLED} SELECT ts_id, ds, round(ln(1 + y), 6) AS v, round(exp(ln(1 + y)) - 1, 6) AS y FROM filled")
def log1p_roundtrip(spark, d):
    v = transforms.forward(F.col("y"), "log1p")
    return filled(spark, d).select("ts_id", "ds", F.round(v, 6).alias("v"), F.round(transforms.inverse(v, "log1p"), 6).alias("y"))


@query(f"WITH {PANEL} SELECT ts_id, ds, round((power(y, 0.5) - 1) / 0.5, 6) AS v, round(power(0.5 * ((power(y, 0.5) - 1) / 0.5) + 1, 2), 6) AS y FROM panel WHERE y > 0")
def boxcox_fixed_lambda(spark, d):
    p = P.as_panel(P.daily_sales(spark, d)).filter("y > 0")
    v = transforms.forward(F.col("y"), "boxcox", 0.5)
    return p.select("ts_id", "ds", F.round(v, 6).alias("v"), F.round(transforms.inverse(v, "boxcox", 0.5), 6).alias("y"))


LAMBDAS = [-1.0, -0.5, 0.0, 0.5, 1.0]


@query("WITH " + PANEL + ", g(lam) AS (VALUES (-1.0), (-0.5), (0.0), (0.5), (1.0)), b AS (SELECT ts_id, CAST(lam AS DOUBLE) AS lam, ln(y) AS ly, CASE WHEN lam = 0 THEN ln(y) ELSE (power(y, lam) - 1) / lam END AS v FROM panel, g WHERE y > 0) SELECT ts_id, lam, round((lam - 1) * sum(ly) - count(*) / 2.0 * ln(var_pop(v)), 4) AS llf FROM b GROUP BY 1, 2")
def boxcox_lambda_grid(spark, d):
    p = P.as_panel(P.daily_sales(spark, d)).filter("y > 0")
    return transforms.boxcox_likelihood(p, LAMBDAS).select("ts_id", "lam", F.round("llf", 4).alias("llf"))


# --- folds and out-of-fold forecasts ------------------------------------------------
SPLIT_COLS = "ts_id, fold_id, ds, y, part, step, pos"


@query(f"WITH {FOLDS} SELECT {SPLIT_COLS} FROM folds")
def folds_expanding(spark, d):
    return split(spark, d)


@query(f"WITH {_split_sql('sliding')} SELECT {SPLIT_COLS} FROM folds")
def folds_sliding(spark, d):
    return split(spark, d, SLIDING)


def split(spark, d, plan=PLAN):
    rows = folds.split(filled(spark, d), plan)
    return rows.select("ts_id", "fold_id", "ds", "y", "part", F.col("step").cast("long").alias("step"), F.col("pos").cast("long").alias("pos"))


def _oof_query(model: str):
    @query(f"WITH {OOF} SELECT ts_id, model_type, fold_id, ds, step, y, round(yhat, 6) AS yhat FROM oof WHERE model_type = '{model}'")
    def oof(spark, d):
        return rounded(baselines.ALL[model](split(spark, d)), ["yhat"])

    QUERIES[f"oof_{model}"], SQL[f"oof_{model}"] = QUERIES.pop("oof"), SQL.pop("oof")


for _m in MODELS:
    _oof_query(_m)

SES_SQL = f"""WITH RECURSIVE {STATS},
walk AS (SELECT ts_id, fold_id, pos, y AS level FROM train WHERE pos = 1
  UNION ALL SELECT t.ts_id, t.fold_id, t.pos, w.level * 0.8 + t.y * 0.2 FROM walk w JOIN train t ON t.ts_id = w.ts_id AND t.fold_id = w.fold_id AND t.pos = w.pos + 1),
ends AS (SELECT ts_id, fold_id, max_by(level, pos) AS level FROM walk GROUP BY 1, 2)
SELECT v.ts_id, 'ses' AS model_type, v.fold_id, ds, step, y, round(level, 6) AS yhat FROM val v JOIN ends e ON e.ts_id = v.ts_id AND e.fold_id = v.fold_id"""


@query(SES_SQL)
def oof_ses_fixed(spark, d):
    return rounded(baselines.ses(split(spark, d)), ["yhat"])


def oof(spark, d, models=MODELS):
    return baselines.out_of_fold(split(spark, d), models)


def scores(spark, d, models=MODELS):
    rows = split(spark, d)
    scale = metrics.naive_scale(rows.filter("part = 'train'"), ["ts_id", "fold_id"])
    joined = baselines.out_of_fold(rows, models).join(scale, ["ts_id", "fold_id"])
    return joined.groupBy("ts_id", "model_type", "fold_id").agg(*metrics.metric_aggregates(naive_mae="naive_mae", naive_mse="naive_mse"))


# --- metrics -------------------------------------------------------------------------
@query(f"WITH {SCORES} SELECT ts_id, model_type, fold_id, {_rounded(metrics.NAMES)} FROM scores")
def metrics_panel(spark, d):
    return rounded(scores(spark, d), metrics.NAMES)


EVENTS_ZERO = "rows AS (SELECT event_type AS ts_id, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value END AS y, CASE WHEN event_id % 6 = 0 THEN 0.0 ELSE value + 1 END AS yhat FROM events UNION ALL SELECT 'zeros', 0.0, 0.0 FROM events)"


@query(f"WITH {EVENTS_ZERO} SELECT ts_id, " + _rounded(("mae", "mape", "smape", "wape", "mase")) + f" FROM (SELECT ts_id, {PANEL_METRICS}, CAST(NULL AS DOUBLE) AS mase FROM rows GROUP BY ts_id)")
def metrics_undefined(spark, d):
    e = P.load(spark, d, "events")
    rows = e.select(F.col("event_type").alias("ts_id"), F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.col("value")).alias("y"), F.when(F.col("event_id") % 6 == 0, 0.0).otherwise(F.col("value") + 1).alias("yhat"))
    rows = rows.union(e.select(F.lit("zeros"), F.lit(0.0), F.lit(0.0)))
    return rounded(rows.groupBy("ts_id").agg(*metrics.metric_aggregates()).select("ts_id", "mae", "mape", "smape", "wape", "mase"), metrics.NAMES)


@query(f"""WITH {OOF}, b AS (SELECT *, yhat - 200 AS lo, yhat + 200 AS hi FROM oof)
SELECT ts_id, model_type, round(avg(CASE WHEN y >= lo AND y <= hi THEN 1.0 ELSE 0.0 END), 6) AS coverage,
  round((avg(CASE WHEN y >= lo THEN 0.1 * (y - lo) ELSE -0.9 * (y - lo) END) + avg(CASE WHEN y >= hi THEN 0.9 * (y - hi) ELSE -0.1 * (y - hi) END)) / 2, 6) AS pinball
FROM b GROUP BY 1, 2""")
def metrics_intervals(spark, d):
    rows = oof(spark, d).withColumn("lo", F.col("yhat") - 200).withColumn("hi", F.col("yhat") + 200)
    out = rows.groupBy("ts_id", "model_type").agg(*metrics.metric_aggregates(lower="lo", upper="hi"))
    return rounded(out.select("ts_id", "model_type", "coverage", "pinball"), metrics.NAMES)


@query(f"WITH {SCORES} SELECT ts_id, model_type, " + ", ".join(f"round(avg({n}), 6) AS {n}" for n in metrics.NAMES) + " FROM scores GROUP BY 1, 2")
def metrics_rollup(spark, d):
    return rounded(metrics.rollup(scores(spark, d), ["ts_id", "model_type"]), metrics.NAMES)


@query(f"WITH {OOF} SELECT ts_id, model_type, " + ", ".join(f"round(quantile_cont(y - yhat, {q}), 6) AS q{round(100 * q):02d}" for q in (0.1, 0.5, 0.9)) + " FROM oof GROUP BY 1, 2")
def residual_quantiles(spark, d):
    return rounded(metrics.residual_quantiles(oof(spark, d), ["ts_id", "model_type"]), ["q10", "q50", "q90"])


RANKED = "SELECT model_type, count(*) AS n_cells, round(avg(wape), 6) AS mean_wape, round(avg(mae), 6) AS mean_mae, CAST(row_number() OVER (ORDER BY avg(wape) NULLS LAST, model_type) AS INTEGER) AS place FROM scores GROUP BY model_type"


@query(f"WITH {SCORES} {RANKED}")
def leaderboard(spark, d):
    """Panel, folds, forecasts, metrics and rank in one plan."""
    board = scores(spark, d).groupBy("model_type").agg(F.count("*").alias("n_cells"), F.avg("wape").alias("mean_wape"), F.avg("mae").alias("mean_mae"))
    place = F.row_number().over(Window.orderBy(F.col("mean_wape").asc_nulls_last(), "model_type"))  # a row for each model
    return rounded(board.withColumn("place", place), ["mean_wape", "mean_mae"])


# --- ensembles ------------------------------------------------------------------------
AT = ["ts_id", "fold_id", "ds"]


def _ensemble(sql_tail: str):
    return query(f"WITH {SCORES}, {sql_tail}")


@query(f"WITH {OOF} SELECT ts_id, fold_id, ds, round(avg(yhat), 6) AS yhat FROM oof GROUP BY 1, 2, 3")
def ensemble_mean(spark, d):
    return rounded(ensemble.mean(oof(spark, d), AT), ["yhat"])


@query(f"WITH {OOF} SELECT ts_id, fold_id, ds, round(median(yhat), 6) AS yhat FROM oof GROUP BY 1, 2, 3")
def ensemble_median(spark, d):
    return rounded(ensemble.median(oof(spark, d), AT), ["yhat"])


WEIGHTS = "inv AS (SELECT model_type, 1 / avg(wape) AS raw FROM scores GROUP BY 1), w AS (SELECT model_type, raw / sum(raw) OVER () AS weight FROM inv)"


@_ensemble(f"{WEIGHTS} SELECT model_type, round(weight, 6) AS weight FROM w")
def ensemble_weights(spark, d):
    return rounded(ensemble.inverse_error_weights(scores(spark, d)), ["weight"])


@_ensemble(f"{WEIGHTS} SELECT ts_id, fold_id, ds, round(sum(weight * yhat) / sum(weight), 6) AS yhat FROM oof o JOIN w ON w.model_type = o.model_type GROUP BY 1, 2, 3")
def ensemble_inverse_error(spark, d):
    return rounded(ensemble.apply_weights(oof(spark, d), ensemble.inverse_error_weights(scores(spark, d)), AT), ["yhat"])


@_ensemble("inv AS (SELECT ts_id, model_type, 1 / (sum(abs(yhat - y)) / sum(abs(y))) AS raw FROM oof GROUP BY 1, 2), w AS (SELECT *, raw / sum(raw) OVER (PARTITION BY ts_id) AS weight FROM inv) SELECT o.ts_id, fold_id, ds, round(sum(weight * yhat) / sum(weight), 6) AS yhat FROM oof o JOIN w ON w.model_type = o.model_type AND w.ts_id = o.ts_id GROUP BY 1, 2, 3")
def ensemble_inverse_error_by_series(spark, d):
    rows = oof(spark, d)
    wape = rows.groupBy("ts_id", "model_type").agg(F.try_divide(F.sum(F.abs(F.col("yhat") - F.col("y"))), F.sum(F.abs("y"))).alias("wape"))
    return rounded(ensemble.apply_weights(rows, ensemble.inverse_error_weights(wape, keys=["ts_id"]), AT), ["yhat"])


PRUNE_AT = 0.6


@_ensemble(f"bad AS (SELECT model_type FROM scores GROUP BY 1 HAVING avg(wape) > {PRUNE_AT}) SELECT ts_id, model_type, fold_id, ds, round(yhat, 6) AS yhat FROM oof WHERE model_type NOT IN (SELECT model_type FROM bad)")
def ensemble_prune(spark, d):
    kept = ensemble.prune(oof(spark, d), scores(spark, d), PRUNE_AT)
    return rounded(kept.select("ts_id", "model_type", "fold_id", "ds", "yhat"), ["yhat"])


GRAM = "x AS (SELECT ts_id, fold_id, ds, max(y) AS y, max(yhat) FILTER (model_type = 'seasonal_naive') AS a, max(yhat) FILTER (model_type = 'mean') AS b FROM oof GROUP BY 1, 2, 3), g AS (SELECT sum(a * a) {r} AS aa, sum(a * b) AS ab, sum(b * b) {r} AS bb, sum(a * y) AS ay, sum(b * y) AS byy FROM x WHERE a IS NOT NULL AND b IS NOT NULL)"
FREE = "(ay * bb - byy * ab) / (aa * bb - ab * ab) AS wa, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS wb, ay / aa AS oa, byy / bb AS ob, ay, byy, aa, bb"


@query(f"WITH {OOF}, {GRAM.format(r='+ 1')}, s AS (SELECT {FREE} FROM g) SELECT 'seasonal_naive' AS model_type, round(wa, 6) AS weight FROM s UNION ALL SELECT 'mean', round(wb, 6) FROM s")
def ensemble_ridge_2model(spark, d):
    return rounded(ensemble.learned_weights(oof(spark, d, TWO), "ridge", list(TWO)), ["weight"])


@query(f"""WITH {OOF}, {GRAM.format(r='')}, s AS (SELECT {FREE} FROM g),
w AS (SELECT CASE WHEN wa >= 0 AND wb >= 0 THEN wa WHEN ay * oa >= byy * ob THEN greatest(oa, 0) ELSE 0 END AS p, CASE WHEN wa >= 0 AND wb >= 0 THEN wb WHEN ay * oa >= byy * ob THEN 0 ELSE greatest(ob, 0) END AS q FROM s)
SELECT 'seasonal_naive' AS model_type, round(p, 6) AS weight FROM w UNION ALL SELECT 'mean', round(q, 6) FROM w""")
def ensemble_nnls_2model(spark, d):
    return rounded(ensemble.learned_weights(oof(spark, d, TWO), "nnls", list(TWO)), ["weight"])


@_ensemble(f"{WEIGHTS}, part AS (SELECT * FROM oof WHERE NOT (model_type = 'mean' AND step % 2 = 0)) SELECT ts_id, fold_id, ds, round(sum(weight * yhat) / sum(weight), 6) AS yhat FROM part p JOIN w ON w.model_type = p.model_type GROUP BY 1, 2, 3")
def ensemble_renormalize(spark, d):
    part = oof(spark, d).filter("NOT (model_type = 'mean' AND step % 2 = 0)")
    return rounded(ensemble.apply_weights(part, ensemble.inverse_error_weights(scores(spark, d)), AT), ["yhat"])


OOF_SCORED = [n for n in metrics.NAMES if n not in ("mase", "rmsse", "coverage", "pinball")]


@query(f"WITH {OOF}, blend AS (SELECT ts_id, fold_id, ds, max(y) AS y, avg(yhat) AS yhat FROM oof GROUP BY 1, 2, 3), f AS (SELECT ts_id, fold_id, {PANEL_METRICS} FROM blend GROUP BY 1, 2) SELECT ts_id, " + ", ".join(f"round(avg({n}), 6) AS {n}" for n in OOF_SCORED) + " FROM f GROUP BY 1")
def ensemble_oof_score(spark, d):
    blend = oof(spark, d).groupBy(*AT).agg(F.max("y").alias("y"), F.avg("yhat").alias("yhat"))
    by_fold = blend.groupBy("ts_id", "fold_id").agg(*metrics.metric_aggregates())
    return rounded(metrics.rollup(by_fold, ["ts_id"]).select("ts_id", *OOF_SCORED), OOF_SCORED)


@query(f"WITH {OOF}, part AS (SELECT * FROM oof WHERE NOT (ts_id = 'A' AND model_type = 'drift')) SELECT ts_id, count(DISTINCT model_type) AS n_models FROM part GROUP BY 1 HAVING count(DISTINCT model_type) = 4")
def ready_series(spark, d):
    return ensemble.ready_series(oof(spark, d).filter("NOT (ts_id = 'A' AND model_type = 'drift')"), list(MODELS))


# --- registry -------------------------------------------------------------------------
#: cells of two runs as the registry holds them, each cell written twice or thrice
CELLS = """cells AS (SELECT 'run' || CAST(l_suppkey % 2 AS VARCHAR) AS run_id, 's' || CAST(l_partkey AS VARCHAR) AS ts_id, 'm' || CAST(l_linenumber AS VARCHAR) AS model_type,
  CASE WHEN l_suppkey % 3 = 0 THEN 1 END AS fold_id, CAST(NULL AS VARCHAR) AS ensemble_id, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS created_at,
  l_discount AS wape, l_extendedprice AS mae, l_quantity AS fit_seconds, CASE WHEN l_tax > 0.04 THEN 'a' END AS model_artifact,
  CASE WHEN l_returnflag = 'R' THEN 'error' ELSE 'ok' END AS status, 'spark' AS compute_engine FROM lineitem)"""
KEY = "run_id, ts_id, model_type, fold_id, ensemble_id"
DEDUPED = f"{CELLS}, deduped AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY created_at DESC, wape, mae, fit_seconds, model_artifact, status) = 1)"


def cells(spark, d):
    text = F.col
    return P.load(spark, d, "lineitem").select(
        F.concat(F.lit("run"), (text("l_suppkey") % 2).cast("string")).alias("run_id"),
        F.concat(F.lit("s"), text("l_partkey").cast("string")).alias("ts_id"),
        F.concat(F.lit("m"), text("l_linenumber").cast("string")).alias("model_type"),
        F.when(text("l_suppkey") % 3 == 0, 1).alias("fold_id"),
        F.lit(None).cast("string").alias("ensemble_id"),
        (text("l_orderkey") * 10 + text("l_linenumber")).cast("long").alias("created_at"),
        text("l_discount").alias("wape"),
        text("l_extendedprice").alias("mae"),
        text("l_quantity").alias("fit_seconds"),
        F.when(text("l_tax") > 0.04, "a").alias("model_artifact"),
        F.when(text("l_returnflag") == "R", "error").otherwise("ok").alias("status"),
        F.lit("spark").alias("compute_engine"),
    )


@query(f"WITH {DEDUPED} SELECT {KEY}, created_at, wape, mae FROM deduped")
def dedupe_cells(spark, d):
    return registry.deduped_cells(cells(spark, d)).select(*registry.CELL_KEY, "created_at", "wape", "mae")


@query(f"""WITH {DEDUPED} SELECT run_id, model_type, ensemble_id, any_value(compute_engine) AS compute_engine, count(*) AS n_cells, count(*) FILTER (model_artifact IS NULL) AS n_no_artifact,
  round(count(*) FILTER (model_artifact IS NULL) / count(*), 6) AS no_artifact_rate, round(count(*) FILTER (status = 'error') / count(*), 6) AS error_rate, quantile_disc(fit_seconds, 0.5) AS median_fit_seconds, round(avg(wape), 6) AS mean_wape, round(avg(mae), 6) AS mean_mae
FROM deduped WHERE fold_id IS NULL GROUP BY 1, 2, 3""")
def model_leaderboard(spark, d):
    return rounded(registry.leaderboard(cells(spark, d)), ["no_artifact_rate", "error_rate", "mean_wape", "mean_mae"])


@query(f"WITH {CELLS}, s AS (SELECT run_id, model_type, count(*) AS n_cells, count(*) FILTER (status = 'error') AS n_errors, count(DISTINCT ts_id) AS n_series FROM cells GROUP BY 1, 2) SELECT *, CASE WHEN n_errors = 0 THEN 'COMPLETED' WHEN n_errors < n_cells THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM s")
def status_rollup(spark, d):
    return registry.status_rollup(cells(spark, d), ["run_id", "model_type"])


@query("SELECT 'u' || CAST(user_id AS VARCHAR) AS run_id, event_type AS status, event_id AS created_at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_header(spark, d):
    rows = P.load(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_type").alias("status"), F.col("event_id").alias("created_at"))
    return registry.latest(rows, ["run_id"], F.desc("created_at"))


@query("SELECT user_id AS run_id, event_type AS family, CAST(event_id % 4 AS INTEGER) AS attempt, event_id AS created_at FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 4 DESC, event_id DESC) = 1")
def current_job_attempt(spark, d):
    rows = P.load(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("family"), (F.col("event_id") % 4).cast("int").alias("attempt"), F.col("event_id").alias("created_at"))
    return registry.current_jobs(rows)


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, CASE WHEN CAST(props->>'$.k' AS BIGINT) <> 0 THEN round(value / CAST(props->>'$.k' AS BIGINT), 9) END AS per_k FROM events")
def telemetry_unpack(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return P.load(spark, d, "events").select("event_id", k.alias("k"), F.round(F.try_divide(F.col("value"), k), 9).alias("per_k"))


@query("SELECT o_orderkey, sha256('run' || chr(31) || CAST(o_custkey AS VARCHAR) || chr(31) || o_orderpriority || chr(31) || o_orderstatus) AS model_hash FROM orders")
def cell_hash_ids(spark, d):
    from .ids import model_hash_column

    return P.load(spark, d, "orders").select("o_orderkey", model_hash_column(F.lit("run"), F.col("o_custkey").cast("string"), F.col("o_orderpriority"), F.col("o_orderstatus")).alias("model_hash"))


@query("""SELECT 'job' AS kind, event_type AS name, 'ok' AS status, count(*) AS n, round(date_diff('microsecond', min(ts), max(ts)) / 1000000.0, 6) AS seconds FROM events GROUP BY event_type
UNION ALL SELECT 'cell', CAST(user_id AS VARCHAR) || '/' || event_type, 'ok', count(*), round(date_diff('microsecond', min(ts), max(ts)) / 1000000.0, 6) FROM events GROUP BY user_id, event_type""")
def trace_spans(spark, d):
    e = P.load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    span = [F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("n"), F.lit("ok").alias("status")]
    jobs = e.groupBy(F.col("event_type").alias("family")).agg(*span)
    own = e.groupBy(F.col("user_id").cast("string").alias("ts_id"), F.col("event_type").alias("model_type")).agg(*span)
    own = own.withColumnsRenamed({"started_at": "cell_started_at", "ended_at": "cell_ended_at"})
    counts = jobs.select(F.lit("job").alias("kind"), F.col("family").alias("name"), "n").union(own.select(F.lit("cell"), F.concat_ws("/", "ts_id", "model_type"), "n"))
    return registry.trace(jobs, own).join(counts, ["kind", "name"]).select("kind", "name", "status", "n", F.round("seconds", 6).alias("seconds"))


from . import model_queries  # noqa: E402, F401  (registers the queries of fitted models)
