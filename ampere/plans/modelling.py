"""Metric, forecast and model queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..config import ModelConfig, ModelType
from ..operators import features as fe
from ..operators import model as ml
from ..operators import stats, trade
from ..operators.series import Lag, Lookback, Rolling, Series, apply_series
from ..sources.driver_tables import table
from .common import EVENT_SERIES, MARKET_COLUMNS, MARKET_SERIES, QD, D, P1, P2, mv, scratch, sql_with_mv
from .features import (FEATURE_SET_ROUNDED, FEATURE_SET_SQL, LAGS, PRICE_COLS, SYSTEM_COLS, TRIG, VOLUME_COLS,
                       order_sql, rolling_names)
from .registry import register
from .trading import rows_sql, totals_sql

MV_ORDER = order_sql([QD])
METRICS = ["rmse", "mae", "r2", "smape", "mape"]

# three SQL-expressible forecasters of the first price
FORECASTERS = {
    "lag_1": (lambda: Lag(P1, 1, "predicted"), f"LAG({P1}, 1) OVER (ORDER BY {MV_ORDER})"),
    "lag_24": (lambda: Lag(P1, 24, "predicted"), f"LAG({P1}, 24) OVER (ORDER BY {MV_ORDER})"),
    "mean_24": (lambda: Rolling(P1, 24, "mean", "predicted", exclude_current=True),
                f"CASE WHEN COUNT({P1}) OVER (ORDER BY {MV_ORDER} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) >= 24 "
                f"THEN AVG({P1}) OVER (ORDER BY {MV_ORDER} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) END"),
}


def _forecasts(spark, sf):
    """Long table (model, timestamp, actual, predicted) over complete pairs;
    all forecasters share one framing of the series."""
    m = mv(spark, sf).select(F.col(f"`{D}`"), P1)
    ops = []
    for name, (op, _) in FORECASTERS.items():
        o = op()
        ops.append(type(o)(**{**o.__dict__, "name": f"__f_{name}"}))
    x = apply_series(m, MARKET_SERIES, ops)
    pairs = F.inline(F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"__f_{n}").alias("predicted"))
                               for n in FORECASTERS]))
    out = x.select(F.col(f"`{D}`"), F.col(P1).alias("actual"), pairs)
    out = out.select("model", F.col(f"`{D}`"), "actual", "predicted")
    return out.where(F.col("actual").isNotNull() & F.col("predicted").isNotNull())


FORECAST_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS model, {QD}, {P1} AS actual, {expr} AS predicted FROM mv" for n, (_, expr) in FORECASTERS.items())
PAIRS_SQL = f"SELECT * FROM ({FORECAST_SQL}) f WHERE actual IS NOT NULL AND predicted IS NOT NULL"
METRIC_SQL = f"""SELECT model, SQRT(AVG((actual - predicted) * (actual - predicted))) AS rmse,
  AVG(ABS(actual - predicted)) AS mae,
  1.0 - SUM((actual - predicted) * (actual - predicted)) / (VAR_POP(actual) * COUNT(actual)) AS r2,
  AVG(2.0 * ABS(predicted - actual) / (ABS(actual) + ABS(predicted) + CAST(1e-8 AS DOUBLE))) * 100 AS smape,
  AVG(CASE WHEN actual <> 0 THEN ABS((actual - predicted) / actual) END) * 100 AS mape,
  COUNT(actual) AS n FROM ({PAIRS_SQL}) p GROUP BY model"""


def _metric_table(spark, sf):
    return ml.evaluate(_forecasts(spark, sf), "actual", "predicted", ["model"])


@register("forecast_metrics", sql_with_mv(METRIC_SQL), rounded=METRICS)
def forecast_metrics(spark, sf):
    """M11-M15 for three persistence-type forecasts, one aggregation."""
    return _metric_table(spark, sf)


@register("persistence_metrics", sql_with_mv(f"SELECT * FROM ({METRIC_SQL}) m WHERE model = 'lag_1'"),
          rounded=METRICS)
def persistence_metrics(spark, sf):
    """M11-M15 of the lag-1 forecast."""
    return _metric_table(spark, sf).where(F.col("model") == "lag_1")


@register("rounded_metrics", sql_with_mv(f"""SELECT model, ROUND_EVEN(rmse, 4) AS rmse, ROUND_EVEN(mae, 4) AS mae,
  ROUND_EVEN(r2, 4) AS r2, ROUND_EVEN(smape, 2) AS smape, ROUND_EVEN(mape, 2) AS mape, n FROM ({METRIC_SQL}) m"""))
def rounded_metrics(spark, sf):
    """4/4/4/2/2 decimals, half to even."""
    return ml.rounded_metrics(_metric_table(spark, sf))


@register("residual_stats", sql_with_mv(f"""SELECT model, AVG(actual - predicted) AS mean_residual,
  STDDEV_POP(actual - predicted) AS std_residual, MIN(actual - predicted) AS min_residual,
  MAX(actual - predicted) AS max_residual, COUNT(actual - predicted) AS n FROM ({PAIRS_SQL}) p GROUP BY model"""),
          rounded=["mean_residual", "std_residual", "min_residual", "max_residual"])
def residual_stats(spark, sf):
    """Residual mean, population std, extremes per model."""
    return stats.residual_stats(_forecasts(spark, sf), "actual", "predicted", ["model"])


@register("axis_range", sql_with_mv(f"""SELECT model, LEAST(MIN(actual), MIN(predicted)) AS lo,
  GREATEST(MAX(actual), MAX(predicted)) AS hi FROM ({PAIRS_SQL}) p GROUP BY model"""), rounded=["lo", "hi"])
def axis_range(spark, sf):
    """Common axis range of actual and predicted, per model."""
    return stats.axis_range(_forecasts(spark, sf), "actual", "predicted", ["model"])


@register("best_model", sql_with_mv(f"""SELECT arg_min(model, (rmse, model)) AS best_rmse_model,
  arg_min(model, (mae, model)) AS best_mae_model, arg_min(model, (-r2, model)) AS best_r2_model
  FROM ({METRIC_SQL}) m"""))
def best_model(spark, sf):
    """Best model per metric."""
    return stats.best_per_metric(_metric_table(spark, sf))


@register("normalised_metrics", sql_with_mv(f"""SELECT model,
  {', '.join(f"CASE WHEN MAX({c}) OVER () = MIN({c}) OVER () THEN 1.0 ELSE 1.0 - ({c} - MIN({c}) OVER ()) / (MAX({c}) OVER () - MIN({c}) OVER ()) END AS {c}_score" for c in ['rmse', 'mae', 'smape', 'mape'])},
  (r2 - MIN(r2) OVER ()) / (MAX(r2) OVER () - MIN(r2) OVER () + CAST(1e-8 AS DOUBLE)) AS r2_score
  FROM ({METRIC_SQL}) m"""), rounded=["rmse_score", "mae_score", "smape_score", "mape_score", "r2_score"])
def normalised_metrics(spark, sf):
    """0-1 scores per model (1 = best)."""
    return stats.normalised_metrics(_metric_table(spark, sf))


@register("prediction_frame", sql_with_mv(f"SELECT model, {QD}, actual, predicted, actual - predicted AS residual "
                                          f"FROM ({PAIRS_SQL}) p"), rounded=["predicted", "residual"])
def prediction_frame(spark, sf):
    """Long table keyed by timestamp (no index shift)."""
    return _forecasts(spark, sf).withColumn("residual", F.col("actual") - F.col("predicted"))


# ------------------------------------------------------ regression oracles


@register("ols_one_feature", """SELECT regr_slope(l_extendedprice, l_quantity) AS slope,
  regr_intercept(l_extendedprice, l_quantity) AS intercept FROM lineitem
  WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL""", rounded=["slope", "intercept"], digits=4)
def ols_one_feature(spark, sf):
    """M3: one-feature least squares through Spark ML (normal equations)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    li = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice").dropna()
    x = VectorAssembler(inputCols=["l_quantity"], outputCol="f").transform(li)
    m = LinearRegression(featuresCol="f", labelCol="l_extendedprice", regParam=0.0, solver="normal").fit(x)
    return spark.range(1).select(F.lit(float(m.coefficients[0])).alias("slope"),
                                 F.lit(float(m.intercept)).alias("intercept"))


@register("cv_fold_sizes", """SELECT fold, COUNT(*) AS n FROM (SELECT NTILE(5) OVER (ORDER BY ts NULLS FIRST,
  event_id NULLS FIRST) AS fold FROM events) t GROUP BY fold""")
def cv_fold_sizes(spark, sf):
    """M20 folds: 5 contiguous, unshuffled, larger folds first."""
    ev = table(spark, sf, "events").select("ts", "event_id")
    x = ml.add_position(ev, EVENT_SERIES)
    n = x.count()
    return x.select(ml.fold_column(F.col("__pos"), n, 5).cast("long").alias("fold")).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"))


@register("split_sizes", sql_with_mv(f"""SELECT COUNT(*) - CAST(CEIL(COUNT(*) * 0.2) AS BIGINT) AS n_train,
  CAST(CEIL(COUNT(*) * 0.2) AS BIGINT) AS n_test FROM mv"""))
def split_sizes(spark, sf):
    """M1: chronological split sizes (test = ceil(n * 0.2))."""
    _, _, n_train, n_test = ml.chronological_split(mv(spark, sf).select(F.col(f"`{D}`")), MARKET_SERIES, 0.2)
    return spark.range(1).select(F.lit(n_train).cast("long").alias("n_train"),
                                 F.lit(n_test).cast("long").alias("n_test"))


@register("lookback_windows", sql_with_mv(f"""SELECT {QD}, {", ".join(f"LAG({c}, {11 - k}) OVER (ORDER BY {MV_ORDER}) AS {c}_{k}" for k in range(1, 11) for c in (P1, P2))}
  FROM mv QUALIFY ROW_NUMBER() OVER (ORDER BY {MV_ORDER}) > 10"""))
def lookback_windows(spark, sf):
    """The previous 10 rows' prices, oldest first, where there are 10."""
    m = mv(spark, sf).select(F.col(f"`{D}`"), P1, P2)
    x = apply_series(m, MARKET_SERIES, [Lookback((P1, P2), 10, "seq")]).where(F.col("seq").isNotNull())
    return x.select(F.col(f"`{D}`"), *[F.col("seq")[k - 1][c].alias(f"{c}_{k}") for k in range(1, 11) for c in (P1, P2)])


# ---------------------------------------------------------- trained models

CFG = ModelConfig()
TARGET = P2
TIME_NAMES = ["hour", "day_of_week", "month", "day_of_month", "day_of_year", "week_of_year", *TRIG, "is_weekend"]
ALL_NAMES = [*MARKET_COLUMNS, *TIME_NAMES, *PRICE_COLS, *VOLUME_COLS, *SYSTEM_COLS,
             *[f"{c}_lag_{n}" for c in (P1, P2) for n in LAGS], *rolling_names(P1)]
MODEL_NAMES = [n for n in fe.select_model_features(ALL_NAMES) if n != TARGET]


def complete_sql(names, target=TARGET):
    """Complete rows with their position ``i`` and number ``n``."""
    keep = " AND ".join(f"{c} IS NOT NULL" for c in [*names, target])
    return (f"SELECT {QD}, {target} AS actual, {', '.join(names)}, ROW_NUMBER() OVER (ORDER BY {MV_ORDER}) - 1 AS i, "
            f"COUNT(*) OVER () AS n FROM ({FEATURE_SET_SQL}) fs WHERE {keep}")


TEST_ROWS = "i >= n - CAST(CEIL(n * 0.2) AS BIGINT)"


def _training_frame(spark, sf):
    fs = fe.create_feature_set(mv(spark, sf), MARKET_SERIES, target_column=TARGET)
    names = [n for n in fe.select_model_features(fs.features.columns) if n != TARGET]
    return fe.prepare_training_data(fs.features, names, TARGET)


@register("training_rows", f"SELECT {QD}, {', '.join(MODEL_NAMES)}, actual AS {TARGET} FROM ({complete_sql(MODEL_NAMES)}) c",
          rounded=[n for n in MODEL_NAMES if n in FEATURE_SET_ROUNDED])
def training_rows(spark, sf):
    """The selected features and target of the complete rows."""
    data, names = _training_frame(spark, sf)
    return data.select(F.col(f"`{D}`"), *names, TARGET)


# The slots are trained on the raw events in time order, on targets whose right predictions are known.
EVENT_NAMES = ["hour", "day", "value"]
EVENTS_SQL = """SELECT event_id, CAST(EXTRACT(hour FROM ts) AS DOUBLE) AS hour, CAST(EXTRACT(isodow FROM ts) AS DOUBLE) AS day, value,
  ROW_NUMBER() OVER (ORDER BY ts NULLS FIRST, event_id NULLS FIRST) - 1 AS i, COUNT(*) OVER () AS n FROM events WHERE value IS NOT NULL AND ts IS NOT NULL"""
STEP, LINE, WAVE = "CASE WHEN hour < 12 THEN 40.0 ELSE 60.0 END", "3.0 * hour - 0.5 * value + 7.0", "50.0 + 10.0 * cos(hour * 0.2617993877991494)"
#: share of the last mean that the exponential mean of the events before a row keeps, and the rows it is summed over
KEEP, BACK = 0.9, 300
LEARNT = {ModelType.LINEAR_REGRESSION: LINE, ModelType.RANDOM_FOREST: STEP, ModelType.GRADIENT_BOOSTING: STEP, ModelType.XGBOOST: STEP,
          ModelType.SVR: WAVE, ModelType.MLP: WAVE, ModelType.ELASTIC_NET: LINE.replace("- 0.5 * value ", ""), ModelType.LSTM: None}
#: predictions this near to a smooth target count as right
NEAR = {ModelType.SVR: 0.2, ModelType.MLP: 1.0}
SLOT_CONFIG = {ModelType.LSTM: ModelConfig(memories=(KEEP,), mixtures=0, recurrent_ridge=0.0), ModelType.MLP: ModelConfig(mlp_iters=80)}


def _event_rows(spark, sf):
    ev = table(spark, sf, "events").where("value is not null and ts is not null")
    return ev.select("ts", "event_id", "value", F.hour("ts").cast("double").alias("hour"), (F.weekday("ts") + 1).cast("double").alias("day"))


def _mean_of_before(rows):
    """The exponential mean of the values before a row, over a plain window.
    It takes ``BACK`` steps a row, so it is written once and read back."""
    weight = (1 - KEEP) * KEEP ** np.arange(BACK - 1.0, -1, -1)  # oldest first

    def mean(before: pa.ListArray) -> pa.Array:
        size = np.asarray(before.value_lengths(), np.int64)
        value = np.asarray(before.flatten().field(0), np.float64)
        if (size == BACK).all():
            return pa.array(value.reshape(-1, BACK) @ weight)
        ends = np.cumsum(size)
        return pa.array([float(value[e - n : e] @ weight[BACK - n :]) for n, e in zip(size, ends)], pa.float64())

    return apply_series(rows, EVENT_SERIES, [Lookback(("value",), BACK, "target", whole=False, fold=mean)]).checkpoint(eager=True)


def _known_rows(spark, sf, m: ModelType):
    rows = _event_rows(spark, sf)
    return _mean_of_before(rows) if m is ModelType.LSTM else rows.withColumn("target", F.expr(LEARNT[m]))


def _model_query(m: ModelType):
    names = {ModelType.ELASTIC_NET: ["hour"], ModelType.SVR: ["hour", "day"], ModelType.LSTM: ["value"]}.get(m, EVENT_NAMES)

    def build(spark, sf):
        """Train on a target whose right predictions are
        known, save, load and predict. One row per test row: its actual, its
        answer (the prediction; where only nearness is asked, the actual if the
        prediction is near it), and whether the stored model predicts the same."""
        data = _known_rows(spark, sf, m)
        # scaled but for the recurrent slot: its target is a mean of the values as they are
        r = ml.train(data, names, "target", EVENT_SERIES, m, m is not ModelType.LSTM, None, SLOT_CONFIG.get(m, CFG))
        path = scratch(spark, f"model-{m.value}")
        r.save(path)
        test = ml.add_position(data, EVENT_SERIES).where(F.col("__pos") >= r.extra["n_train"])
        again = ml.predict(ml.TrainingResult.load(path), test).select("event_id", F.col("__pos"), F.col(ml.PRED).alias("__again"))
        same = F.abs(F.col(ml.PRED) - F.col("__again")) <= F.lit(1e-9) * (F.lit(1.0) + F.abs(F.col(ml.PRED)))
        joined = r.predictions.join(again, "event_id", "full")
        if m is ModelType.LSTM:  # the test rows' own memory must have filled
            joined = joined.where(F.col("__pos") >= r.extra["n_train"] + BACK)
        answer = F.col(ml.PRED)
        if m in NEAR:
            answer = F.when(F.abs(answer - F.col("label")) <= NEAR[m], F.col("label")).otherwise(answer)
        return joined.select(F.lit(m.value).alias("model"), "event_id", F.col("label").alias("actual"), answer.alias("answer"),
                             F.coalesce(same & ~F.isnan(ml.PRED), F.lit(False)).alias("reloads"))
    return build


def _answers_sql(m: ModelType) -> str:
    """What a slot must predict on the test rows of its target."""
    ev, test = f"({EVENTS_SQL}) e", TEST_ROWS
    if m is ModelType.LSTM:
        ev = (f"(SELECT *, list_sum(list_transform(range(1, len(b) + 1), lambda k: b[len(b) - k + 1] * {1 - KEEP} * pow({KEEP}, k - 1))) AS y FROM ("
              f"SELECT *, list(value) OVER (ORDER BY i ROWS BETWEEN {BACK} PRECEDING AND 1 PRECEDING) AS b FROM ({EVENTS_SQL}) e) w) e")
        return f"SELECT event_id, y AS actual, y AS answer FROM {ev} WHERE i >= n - CAST(CEIL(n * 0.2) AS BIGINT) + {BACK}"
    rows = f"SELECT event_id, hour, i, n, {LEARNT[m]} AS y FROM {ev}"
    train = f"SELECT * FROM ({rows}) r WHERE NOT ({test})"
    if m is ModelType.XGBOOST:  # each round takes away the same share of a side's error
        left = f"(1 - {CFG.boost_step} * side / (side + {CFG.boost_penalty}))"
        return (f"SELECT event_id, y AS actual, y - (y - base) * POWER({left}, {CFG.boost_iters}) AS answer FROM ({rows}) r JOIN "
                f"(SELECT y AS of_y, COUNT(*) AS side FROM ({train}) t GROUP BY y) s ON y = of_y CROSS JOIN (SELECT AVG(y) AS base FROM ({train}) t) b WHERE {test}")
    if m is ModelType.ELASTIC_NET:
        return f"""SELECT event_id, y AS actual, my + w * (hour - mx) / sx AS answer FROM ({rows}) r CROSS JOIN (
  SELECT mx, my, sx, SIGN(cov) * GREATEST(ABS(cov) - {CFG.elastic_alpha * CFG.elastic_l1_ratio}, 0) / (vz + {CFG.elastic_alpha * (1 - CFG.elastic_l1_ratio)}) AS w
  FROM (SELECT AVG(hour) AS mx, AVG(y) AS my, STDDEV_SAMP(hour) AS sx, COVAR_POP(hour, y) / STDDEV_SAMP(hour) AS cov,
          VAR_POP(hour) / VAR_SAMP(hour) AS vz FROM ({train}) t) s) l WHERE {test}"""
    return f"SELECT event_id, y AS actual, y AS answer FROM ({rows}) r WHERE {test}"


for _m in ModelType:
    register(f"model_{_m.value}", f"SELECT '{_m.value}' AS model, *, TRUE AS reloads FROM ({_answers_sql(_m)}) a",
             rounded=["actual", "answer"], digits=4)(_model_query(_m))


# parts of the slots that SQL states exactly

ROUND_NAMES = ["l_quantity", "l_linenumber", "l_discount"]
ROUND_SQL = f"""
WITH rows AS (SELECT l_extendedprice - AVG(l_extendedprice) OVER () AS g, {', '.join(ROUND_NAMES)} FROM lineitem),
total AS (SELECT SUM(g) AS g, COUNT(*) AS h FROM rows),
bins AS ({' UNION ALL '.join(f"SELECT {k} AS place, '{c}' AS feature, {c} AS cut, SUM(g) AS g, COUNT(*) AS h FROM rows GROUP BY {c}" for k, c in enumerate(ROUND_NAMES))}),
sides AS (SELECT place, feature, cut, SUM(b.g) OVER w AS gl, SUM(b.h) OVER w AS hl, t.g AS g, t.h AS h, t.h - SUM(b.h) OVER w AS hr
  FROM bins b CROSS JOIN total t WINDOW w AS (PARTITION BY place ORDER BY cut)),
gains AS (SELECT *, 0.5 * (gl * gl / (hl + 1) + (g - gl) * (g - gl) / (hr + 1) - g * g / (h + 1)) AS gain FROM sides WHERE hr > 0)
SELECT feature, CAST(cut AS DOUBLE) AS cut, gain / 1e6 AS gain, gl / (hl + 1) AS left_value, (g - gl) / (hr + 1) AS right_value
FROM gains ORDER BY gain DESC, place, cut LIMIT 1"""


@register("boosting_round", ROUND_SQL, rounded=["gain", "left_value", "right_value"], digits=3)
def boosting_round(spark, sf):
    """M6: one round of second-order boosting, one level deep: the split with
    the greatest regularised gain and its leaf weights."""
    from pyspark.ml.feature import VectorAssembler

    from ..operators.boosting import BoostParams, SecondOrderBoosting

    li = table(spark, sf, "lineitem").select("l_extendedprice", *[F.col(c).cast("double") for c in ROUND_NAMES])
    x = VectorAssembler(inputCols=ROUND_NAMES, outputCol="f").transform(li)
    a = SecondOrderBoosting(BoostParams(rounds=1, depth=1, eta=1.0), "f", "l_extendedprice").fit(x).arrays()
    row = (ROUND_NAMES[int(a["feature"][0, 0])], float(a["cut"][0, 0]), float(a["gains"].sum()) / 1e6, float(a["value"][0, 1]), float(a["value"][0, 2]))
    return spark.createDataFrame([row], "feature string, cut double, gain double, left_value double, right_value double")


STATES_SQL = f"""SELECT event_id, list_sum(list_transform(range(1, len(b) + 1), lambda k: b[len(b) - k + 1] * {1 - KEEP} * pow({KEEP}, k - 1))) AS state
  FROM (SELECT event_id, i, list(value) OVER (ORDER BY i ROWS BETWEEN 400 PRECEDING AND 1 PRECEDING) AS b FROM ({EVENTS_SQL}) e) w WHERE i >= 10"""


@register("recurrent_states", STATES_SQL, rounded=["state"])
def recurrent_states(spark, sf):
    """One linear unit's states over the whole series, scanned in blocks:
    the exponential mean of all values before a row."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from ..operators.recurrent import ReservoirStates

    rows = VectorAssembler(inputCols=["value"], outputCol="f").transform(_event_rows(spark, sf))
    x = ReservoirStates(10, EVENT_SERIES.order_by, (KEEP,), 0, block_rows=777, in_col="f", out_col="s").transform(rows)
    return x.select("event_id", vector_to_array("s")[0].alias("state"))


CV_SQL = f"""
WITH r AS (SELECT value AS y, hour AS x, NTILE(5) OVER (ORDER BY i) AS fold FROM ({EVENTS_SQL}) e),
fits AS (SELECT k.fold, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM (SELECT DISTINCT fold FROM r) k JOIN r ON r.fold <> k.fold GROUP BY k.fold),
scores AS (SELECT r.fold, AVG((y - b - a * x) * (y - b - a * x)) AS mse FROM r JOIN fits f ON r.fold = f.fold GROUP BY r.fold)
SELECT CAST(fold AS INTEGER) AS fold, SQRT(mse) AS rmse, SQRT(AVG(mse) OVER ()) AS cv_rmse_mean, STDDEV_POP(SQRT(mse)) OVER () AS cv_rmse_std FROM scores"""


@register("cv_scores", CV_SQL, rounded=["rmse", "cv_rmse_mean", "cv_rmse_std"])
def cv_scores(spark, sf):
    """Five contiguous folds of the events, least squares of the value on
    the hour: each fold's error by the fit on the other four, from one scan."""
    rows = _event_rows(spark, sf).withColumnRenamed("value", "target")
    c = ml.cross_validate(rows, ["hour"], "target", EVENT_SERIES, ModelType.LINEAR_REGRESSION, 5)
    out = [(k, v, c["cv_rmse_mean"], c["cv_rmse_std"]) for k, v in enumerate(c["cv_scores"], 1)]
    return spark.createDataFrame(out, "fold int, rmse double, cv_rmse_mean double, cv_rmse_std double")


# one feature: the fitted line has a closed form, so metrics can be compared

ONE = complete_sql([P1])
TRAIN = f"SELECT actual AS y, {P1} AS x FROM ({ONE}) c WHERE NOT ({TEST_ROWS})"
METRICS_SQL = """SQRT(AVG((y - p) * (y - p))) AS rmse, AVG(ABS(y - p)) AS mae,
  1.0 - SUM((y - p) * (y - p)) / (VAR_POP(y) * COUNT(y)) AS r2,
  AVG(2.0 * ABS(p - y) / (ABS(y) + ABS(p) + CAST(1e-8 AS DOUBLE))) * 100 AS smape,
  AVG(CASE WHEN y <> 0 THEN ABS((y - p) / y) END) * 100 AS mape, COUNT(y) AS n"""
OLS_TEST = f"""SELECT {QD}, {P1}, actual AS y, b + a * {P1} AS p FROM ({ONE}) c
  CROSS JOIN (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM ({TRAIN}) t) l WHERE {TEST_ROWS}"""


def _one_feature(spark, sf, model_type, scaled=True, cfg=CFG):
    fs = fe.create_feature_set(mv(spark, sf), MARKET_SERIES, target_column=TARGET).features.select(F.col(f"`{D}`"), P1, TARGET)
    data, names = fe.prepare_training_data(fs, [P1], TARGET)
    return ml.train(data, names, TARGET, MARKET_SERIES, model_type, scaled, None, cfg, keep=[])


def _metric_row(spark, r):
    return spark.createDataFrame([tuple(r.metrics[k] for k in (*METRICS, "n"))], ", ".join(f"{m} double" for m in METRICS) + ", n long")


@register("model_ols_split", f"SELECT {METRICS_SQL} FROM ({OLS_TEST}) t", rounded=METRICS)
def model_ols_split(spark, sf):
    """Split, scaler, least squares and metrics of one feature."""
    return _metric_row(spark, _one_feature(spark, sf, ModelType.LINEAR_REGRESSION))


ENET_TEST = f"""SELECT actual AS y, my + w * ({P1} - mx) / sx AS p FROM ({ONE}) c CROSS JOIN (
  SELECT mx, my, sx, SIGN(cov) * GREATEST(ABS(cov) - {CFG.elastic_alpha * CFG.elastic_l1_ratio}, 0)
    / (vz + {CFG.elastic_alpha * (1 - CFG.elastic_l1_ratio)}) AS w
  FROM (SELECT AVG(x) AS mx, AVG(y) AS my, STDDEV_SAMP(x) AS sx, COVAR_POP(x, y) / STDDEV_SAMP(x) AS cov,
          VAR_POP(x) / VAR_SAMP(x) AS vz FROM ({TRAIN}) t) s) l WHERE {TEST_ROWS}"""


@register("model_elastic_net_closed", f"SELECT {METRICS_SQL} FROM ({ENET_TEST}) t", rounded=METRICS, digits=4)
def model_elastic_net_closed(spark, sf):
    """M7: elastic net of one feature against its closed form."""
    return _metric_row(spark, _one_feature(spark, sf, ModelType.ELASTIC_NET))


PLANTED = "5 * l_quantity + 400 * l_discount + 100 * l_tax"
PLANTED_NAMES = ["l_quantity", "l_discount", "l_tax"]


@register("importance_topk", f"""SELECT feature, CAST(ROW_NUMBER() OVER (ORDER BY c DESC) AS BIGINT) AS place FROM (
  {' UNION ALL '.join(f"SELECT '{n}' AS feature, ABS(corr({n}, {PLANTED})) AS c FROM lineitem" for n in PLANTED_NAMES)}) t
  ORDER BY c DESC LIMIT 2""")
def importance_topk(spark, sf):
    """M4 + M17 + T3 / V6: the largest forest importances on a planted target."""
    from pyspark.sql import Window

    li = table(spark, sf, "lineitem").withColumn("planted", F.expr(PLANTED))
    r = ml.train(li, PLANTED_NAMES, "planted", Series(order_by=("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")),
                 ModelType.RANDOM_FOREST, True, None, ModelConfig(forest_trees=10, forest_depth=6))
    top = stats.top_n(ml.importance_frame(spark, r.feature_importance), "importance", 2, "feature")
    return top.select("feature", F.row_number().over(Window.orderBy(F.desc("importance"))).cast("long").alias("place"))


@register("top_importances", f"""SELECT feature, importance FROM (
  {' UNION ALL '.join(f"SELECT '{n}' AS feature, ABS(corr({n}, {PLANTED})) AS importance FROM lineitem" for n in PLANTED_NAMES)}) t
  ORDER BY importance DESC, feature LIMIT 2""", rounded=["importance"])
def top_importances(spark, sf):
    """The n largest values of an importance table."""
    li = table(spark, sf, "lineitem")
    rows = li.agg(*[F.abs(F.corr(n, F.expr(PLANTED))).alias(n) for n in PLANTED_NAMES])
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("importance")) for n in PLANTED_NAMES])))
    return stats.top_n(long, "importance", 2, "feature")


@register("mlp_without_layers", f"SELECT {METRICS_SQL} FROM ({OLS_TEST}) t", rounded=METRICS, digits=4)
def mlp_without_layers(spark, sf):
    """M9: the network trained by back-propagation, without a hidden layer, is
    least squares."""
    return _metric_row(spark, _one_feature(spark, sf, ModelType.MLP, cfg=ModelConfig(hidden_layers=(), mlp_alpha=0.0)))


#: what each slot must reach on a step of one two-valued feature; the recurrent slot sees earlier rows only
STEPS_SQL = f"""
WITH r AS (SELECT {STEP} AS y, CASE WHEN hour < 12 THEN 0.0 ELSE 1.0 END AS x, {TEST_ROWS} AS test FROM ({EVENTS_SQL}) e),
train AS (SELECT AVG(y) AS base, AVG(x) AS mx, STDDEV_SAMP(x) AS sx, COVAR_POP(x, y) / STDDEV_SAMP(x) AS cov, VAR_POP(x) / VAR_SAMP(x) AS vz FROM r WHERE NOT test),
sides AS (SELECT y AS of_y, COUNT(*) AS side FROM r WHERE NOT test GROUP BY y),
scores AS (SELECT COUNT(*) AS n,
    SQRT(AVG(POWER((y - base) * POWER(1 - {CFG.boost_step} * side / (side + {CFG.boost_penalty}), {CFG.boost_iters}), 2))) AS boosted,
    SQRT(AVG(POWER(y - base - SIGN(cov) * GREATEST(ABS(cov) - {CFG.elastic_alpha * CFG.elastic_l1_ratio}, 0)
      / (vz + {CFG.elastic_alpha * (1 - CFG.elastic_l1_ratio)}) * (x - mx) / sx, 2))) AS netted
  FROM r CROSS JOIN train JOIN sides ON y = of_y WHERE test)
SELECT model, 'ok' AS status, CASE model WHEN 'lstm' THEN n - {CFG.lookback} ELSE n END AS n,
  CASE model WHEN 'xgboost' THEN boosted WHEN 'elastic_net' THEN netted WHEN 'lstm' THEN NULL ELSE 0.0 END AS rmse
FROM scores CROSS JOIN (VALUES {', '.join(f"('{m.value}')" for m in ModelType)}) v(model)"""


@register("metric_rows", STEPS_SQL, rounded=["rmse"], digits=4)
def metric_rows(spark, sf):
    """``train_all`` over all eight types; the errors on a step
    of one feature are known (to 0.2 for the tube and the network, not at all
    for the slot that sees earlier rows only)."""
    rows = _event_rows(spark, sf).withColumns({"target": F.expr(STEP), "late": F.expr("CASE WHEN hour < 12 THEN 0.0 ELSE 1.0 END")})
    _, t = ml.train_all(rows, ["late"], "target", EVENT_SERIES, cfg=CFG)
    model, rmse = F.col("model"), F.col("rmse")
    known = F.when(model == "lstm", F.lit(None)).when(model.isin("svr", "mlp") & (rmse <= 0.2), F.lit(0.0)).otherwise(rmse)
    return t.select("model", "status", "n", known.alias("rmse"))


def _model_signals(forecast_second: str) -> str:
    """B1/B3 of a forecast of the second price beside the real first price."""
    return rows_sql(f"({OLS_TEST}) t", P1, forecast_second, P1, "y", QD)


BACKTEST_SQL = f"""SELECT *, total_profit / CAST(GREATEST(total_trades, 1) AS DOUBLE) AS avg_profit_per_trade FROM ({totals_sql(
    f"SELECT 'linear_regression' AS label, action, profit FROM ({_model_signals('p')}) a UNION ALL "
    f"SELECT 'Oracle (Perfect)' AS label, action, profit FROM ({_model_signals('y')}) b", 'label')}) t"""


@register("model_backtest", BACKTEST_SQL, rounded=["total_profit", "win_rate", "avg_profit_per_trade"])
def model_backtest(spark, sf):
    """B5/B6 with a trained model: its test-set forecasts of the second price
    against the real first price; the oracle on the same hours beside it."""
    r = _one_feature(spark, sf, ModelType.LINEAR_REGRESSION)
    first = mv(spark, sf).select(F.col(f"`{D}`"), P1)
    pred = r.predictions.join(first, on=D)
    model_rows = trade.model_backtest(pred, ml.PRED, "label", first=P1).withColumn("label", F.lit("linear_regression"))
    oracle_rows = trade.model_backtest(pred, "label", "label", first=P1).withColumn("label", F.lit("Oracle (Perfect)"))
    return trade.compare_strategies(model_rows.unionByName(oracle_rows))
