"""Price-forecast models on Spark ML.

Everything stays a DataFrame: the chronological split is a row-position
predicate, the scaler is fitted on the training rows only inside a
``Pipeline``, metrics are one aggregation over the predictions. Only metric
rows and feature importances (one value per feature) reach the driver.
"""

from __future__ import annotations

import json
import math
import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ModelConfig, ModelType
from ..functions.scalar import py_round
from .blocks import list_matrix, summed
from .boosting import BoostParams, SecondOrderBoosting
from .kernel import TubeRegression
from .neural import MultilayerRegression
from .recurrent import ReservoirStates
from .series import IDX, Series, global_index

FEATURES = "features"
SCALED = "scaled_features"
PRED = "prediction"


# ------------------------------------------------------------------ split


def add_position(df: DataFrame, s: Series, name: str = "__pos") -> DataFrame:
    """0-based position in series order (global series: blocked, no single
    partition)."""
    if s.keys:
        raise ValueError("model splits work on one series")
    return global_index(df, s).withColumnRenamed(IDX, name)


def chronological_split(df: DataFrame, s: Series, test_size: float = 0.2,
                        pos: str = "__pos") -> tuple[DataFrame, DataFrame, int, int]:
    """M1: the last ceil(n * test_size) rows are the test set (unshuffled)."""
    x = add_position(df, s, pos) if pos not in df.columns else df
    n = x.count()
    n_test = int(math.ceil(n * test_size))
    cut = n - n_test
    return x.where(F.col(pos) < cut), x.where(F.col(pos) >= cut), n - n_test, n_test


def fold_bounds(n: int, k: int) -> list[int]:
    """Start positions of k contiguous folds; the first n % k folds get one
    extra row (unshuffled k-fold; equals SQL NTILE)."""
    base, extra = divmod(n, k)
    starts, s = [], 0
    for i in range(k):
        starts.append(s)
        s += base + (1 if i < extra else 0)
    return starts


def fold_column(pos: Column, n: int, k: int) -> Column:
    starts = fold_bounds(n, k)
    f = F.lit(1)
    for b in starts[1:]:
        f = f + F.when(pos >= F.lit(b), 1).otherwise(0)
    return f


# -------------------------------------------------------------- estimators


def model_type_of(model_type: ModelType | str) -> ModelType:
    """M8: an unlisted type falls back to linear regression, with a warning."""
    try:
        return ModelType(model_type)
    except ValueError:
        warnings.warn(f"unknown model type {model_type!r}: linear regression is used", stacklevel=3)
        return ModelType.LINEAR_REGRESSION


def make_regressor(model_type: ModelType | str, cfg: ModelConfig = ModelConfig(), features: str = SCALED,
                   label: str = "label", label_std: float = 1.0):
    """The regressor of a slot with the reference's hyper-parameters.

    Elastic net: Spark works on the label divided by its standard deviation,
    which leaves the absolute part as stated and weakens the squared part by
    that factor; ``label_std`` of the training rows puts it back."""
    m = model_type_of(model_type)
    common = dict(featuresCol=features, labelCol=label, predictionCol=PRED)
    if m is ModelType.RANDOM_FOREST:
        return RandomForestRegressor(numTrees=cfg.forest_trees, maxDepth=cfg.forest_depth,
                                     featureSubsetStrategy="all", seed=cfg.seed, **common)
    own = (features, label, PRED)
    if m is ModelType.XGBOOST:
        return SecondOrderBoosting(BoostParams(cfg.boost_iters, cfg.boost_depth, cfg.boost_step, cfg.boost_penalty, cfg.boost_gain,
                                               cfg.boost_child, cfg.boost_bins), *own)
    if m is ModelType.GRADIENT_BOOSTING:
        return GBTRegressor(maxIter=cfg.boost_iters, maxDepth=cfg.boost_depth, stepSize=cfg.boost_step,
                            seed=cfg.seed, **common)
    if m is ModelType.ELASTIC_NET:
        absolute = cfg.elastic_alpha * cfg.elastic_l1_ratio
        squared = cfg.elastic_alpha * (1 - cfg.elastic_l1_ratio) * label_std
        total = absolute + squared
        return LinearRegression(regParam=total, elasticNetParam=absolute / total if total else 0.0,
                                standardization=False, maxIter=500, tol=1e-10, **common)
    if m is ModelType.SVR:
        return TubeRegression(cfg.svr_c, cfg.svr_epsilon, cfg.landmarks, cfg.svr_iters, *own)
    if m is ModelType.MLP:
        return MultilayerRegression(cfg.hidden_layers, cfg.mlp_alpha, cfg.mlp_iters, 10 if cfg.hidden_layers else 0, 10, cfg.seed, *own)
    if m is ModelType.LSTM:
        return LinearRegression(regParam=cfg.recurrent_ridge, elasticNetParam=0.0, solver="normal", **common)
    return LinearRegression(regParam=0.0, solver="normal", **common)


def model_pipeline(model_type: ModelType | str, names: Sequence[str], s: Series, scaled: bool,
                   cfg: ModelConfig = ModelConfig(), label_std: float = 1.0) -> Pipeline:
    """The whole pipeline of a slot: the one builder behind ``train``,
    ``predict``, save/load and ``cross_validate``."""
    m = model_type_of(model_type)
    stages: list = [VectorAssembler(inputCols=list(names), outputCol=FEATURES, handleInvalid="error")]
    feat = FEATURES
    if scaled:
        stages.append(StandardScaler(inputCol=FEATURES, outputCol=SCALED, withMean=True, withStd=True))
        feat = SCALED
    if m is ModelType.LSTM:
        stages.append(ReservoirStates(cfg.lookback, s.order_by, cfg.memories, cfg.mixtures, seed=cfg.seed, in_col=feat))
        feat = stages[-1].getOutputCol()
    return Pipeline(stages=[*stages, make_regressor(m, cfg, feat, label_std=label_std)])


def _fit(model_type: ModelType, train_df: DataFrame, names: Sequence[str], s: Series, scaled: bool, cfg: ModelConfig) -> PipelineModel:
    std = 1.0
    if model_type is ModelType.ELASTIC_NET:
        std = train_df.agg(F.stddev_pop("label")).first()[0] or 1.0
    return model_pipeline(model_type, names, s, scaled, cfg, std).fit(train_df)


# ------------------------------------------------------------------ metrics


def metric_columns(actual: str = "label", predicted: str = PRED) -> list[Column]:
    """M11-M15 as aggregate expressions."""
    a, p = F.col(actual), F.col(predicted)
    e = a - p
    sse, sst = F.sum(e * e), F.var_pop(a) * F.count(a)
    # a constant target: 1.0 for a perfect fit, else 0.0 (the finite convention)
    r2 = F.when(sst > 0, F.lit(1.0) - F.try_divide(sse, sst)).when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return [
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.when(F.count(a) > 0, r2).alias("r2"),
        (F.avg(F.lit(2.0) * F.abs(p - a) / (F.abs(a) + F.abs(p) + F.lit(1e-8))) * 100).alias("smape"),
        (F.avg(F.when(a != 0, F.abs(F.try_divide(a - p, a)))) * 100).alias("mape"),
        F.count(a).alias("n"),
    ]


def evaluate(pred: DataFrame, actual: str = "label", predicted: str = PRED,
             group_by: Sequence[str] = ()) -> DataFrame:
    return pred.groupBy(*group_by).agg(*metric_columns(actual, predicted))


def rounded_metrics(metrics: DataFrame) -> DataFrame:
    """4/4/4/2/2 decimals with Python's rounding."""
    return metrics.withColumns({c: py_round(c, d) for c, d in
                                (("rmse", 4), ("mae", 4), ("r2", 4), ("smape", 2), ("mape", 2))})


# ------------------------------------------------------------------ train


@dataclass
class TrainingResult:
    model: PipelineModel
    model_type: ModelType
    metrics: dict | None
    feature_names: list[str]
    feature_importance: dict | None = None
    predictions: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    def save(self, path: str) -> None:
        """Spark ML writer plus a JSON side-car (metrics kept)."""
        self.model.write().overwrite().save(f"{path}/model")
        meta = {"model_type": self.model_type.value, "feature_names": self.feature_names, "metrics": self.metrics,
                "extra": self.extra}
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(
            f"{path}/meta")

    @classmethod
    def load(cls, path: str) -> "TrainingResult":
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        return cls(PipelineModel.load(f"{path}/model"), ModelType(meta["model_type"]), meta["metrics"],
                   meta["feature_names"], extra=meta.get("extra", {}))


def _importance(model: PipelineModel, names: list[str]) -> dict | None:
    """Tree importances, else |coefficients|, else None."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        vals = last.featureImportances.toArray()
    elif hasattr(last, "coefficients"):
        vals = [abs(v) for v in last.coefficients.toArray()]
    else:
        return None
    if len(vals) != len(names):
        return None
    return {n: float(v) for n, v in zip(names, vals)}


def _model_frame(df: DataFrame, names: Sequence[str], target: str, s: Series, keep: Sequence[str] = ()) -> DataFrame:
    """Order, kept and feature columns, the target as ``label``, and the row
    position ``__pos`` (taken over where ``df`` has it already)."""
    extra = [c for c in (*keep, *s.order_by) if c in df.columns and c not in names]
    if "__pos" in df.columns:
        extra.append("__pos")
    data = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(extra)],
                     *[F.col(f"`{c}`").cast("double").alias(c) for c in names],
                     F.col(f"`{target}`").cast("double").alias("label"))
    return data if "__pos" in df.columns else add_position(data, s)


def train(df: DataFrame, feature_names: Sequence[str], target: str, s: Series,
          model_type: ModelType | str = ModelType.LINEAR_REGRESSION, scale_features: bool = True,
          test_size: float | None = None, cfg: ModelConfig = ModelConfig(),
          keep: Sequence[str] = ()) -> TrainingResult:
    """Split -> (scale) -> fit -> predict -> metrics.

    ``df`` holds complete rows (see ``prepare_training_data``). Runs jobs:
    the row positions (unless ``df`` has ``__pos``), the fit and the metrics.
    LSTM slot: recurrent states from all rows before a row feed a ridge
    read-out; the first ``lookback`` rows of train and test are lost, as in
    the reference."""
    m = model_type_of(model_type)
    names = list(feature_names)
    keep = [c for c in keep if c not in names and c != target]
    data = _model_frame(df, names, target, s, keep)
    train_df, test_df, n_train, n_test = chronological_split(data, s, cfg.test_size if test_size is None else test_size)
    model = _fit(m, train_df, names, s, scale_features, cfg)
    pred = model.transform(test_df)
    metrics = evaluate(pred).first().asDict()
    shown = dict.fromkeys((*keep, *s.order_by, "label", PRED))
    return TrainingResult(model, m, metrics, names, _importance(model, names), pred.select(*[F.col(f"`{c}`") for c in shown]),
                          {"n_train": n_train, "n_test": n_test, "order_by": list(s.order_by)})


def predict(result: TrainingResult, df: DataFrame, scale: bool = True) -> DataFrame:
    """Apply a fitted pipeline (features must be present; the look-back
    slot also needs the series' order columns). ``scale=False``: the features
    are scaled already, so the fitted scaler is skipped."""
    if result.model is None:
        raise ValueError("Model not fitted. Call train() first.")
    for stage in result.model.stages:
        if isinstance(stage, StandardScalerModel) and not scale:
            df = df.withColumn(stage.getOutputCol(), F.col(stage.getInputCol()))
        else:
            df = stage.transform(df)
    return df


def _fold_errors(data: DataFrame, names: list[str], cv: int, m: ModelType, cfg: ModelConfig) -> list[float]:
    """Mean squared error of each fold's linear fit on the other folds, from
    one scan: sums of products of the features and the label per fold, taken
    about the means of all rows, so that little is lost to cancellation."""
    d = len(names) + 1
    centre = data.agg(*[F.avg(c).alias(f"c{k}") for k, c in enumerate([*names, "label"])]).first()
    centre = np.array([float(v or 0.0) for v in centre])
    columns = data.select(F.array(*[F.col(f"`{c}`") for c in names], F.col("label")).alias("x"), F.col("__fold").cast("double").alias("y"))
    size = d * d + d + 1

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            yield list_matrix(batch.column("x")) - centre, np.asarray(batch.column("y"), np.int64)

    def per_task(rows) -> np.ndarray:
        out = np.zeros((cv, size))
        for z, fold in rows:
            for k in np.unique(fold):
                own = z[fold == k]
                out[k - 1] += np.concatenate(((own.T @ own).ravel(), own.sum(axis=0), [len(own)]))
        return out

    sums = summed(columns, cv * size, per_task, products).reshape(cv, size)
    total, errors = sums.sum(axis=0), []
    for own in sums:
        gram, first, n = _parts(total - own, d)
        mean = first / n
        cov = gram / n - np.outer(mean, mean)
        w = _linear_weights(cov, m, cfg)
        gram, first, held = _parts(own, d)
        # residual = label - offset - w x, its squares summed from the held fold's own products
        v = np.append(-w, 1.0)
        offset = v @ mean
        errors.append(float(v @ gram @ v - 2 * offset * (v @ first) + held * offset**2) / held)
    return [max(e, 0.0) for e in errors]


def _parts(sums: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, float]:
    return sums[: d * d].reshape(d, d), sums[d * d : -1], sums[-1]


def _linear_weights(cov: np.ndarray, m: ModelType, cfg: ModelConfig) -> np.ndarray:
    """Weights from the covariances of features and label (the last column):
    least squares (the shortest solution where features depend on each other),
    or the elastic net by coordinate descent."""
    xx, xy = cov[:-1, :-1], cov[:-1, -1]
    if m is ModelType.LINEAR_REGRESSION:
        return np.linalg.lstsq(xx, xy, rcond=1e-12)[0]
    absolute, squared = cfg.elastic_alpha * cfg.elastic_l1_ratio, cfg.elastic_alpha * (1 - cfg.elastic_l1_ratio)
    w = np.zeros(len(xy))
    for _ in range(10_000):
        before = w.copy()
        for j in range(len(w)):
            if xx[j, j] > 0:
                c = xy[j] - xx[j] @ w + xx[j, j] * w[j]
                w[j] = np.sign(c) * max(abs(c) - absolute, 0.0) / (xx[j, j] + squared)
        if np.abs(w - before).max(initial=0.0) <= 1e-12 * max(1.0, np.abs(w).max(initial=0.0)):
            break
    return w


def cross_validate(df: DataFrame, feature_names: Sequence[str], target: str, s: Series,
                   model_type: ModelType | str = ModelType.LINEAR_REGRESSION, cv: int | None = None,
                   cfg: ModelConfig = ModelConfig()) -> dict:
    """Contiguous unshuffled folds, unscaled, every slot with its own
    pipeline; mean = sqrt(mean MSE), std of per-fold RMSE (population).

    The linear slots take one scan: each fold's sums of products give both its
    fit (all folds less its own) and its score. The others fit their folds as
    concurrent jobs over the cached rows."""
    m = model_type_of(model_type)
    names, cv = list(feature_names), cfg.cv_folds if cv is None else cv
    data = _model_frame(df, names, target, s)
    n = data.count()
    data = data.withColumn("__fold", fold_column(F.col("__pos"), n, cv))
    if m in (ModelType.LINEAR_REGRESSION, ModelType.ELASTIC_NET):
        mses = _fold_errors(data, names, cv, m, cfg)
    else:
        data = data.persist()

        def error(k: int) -> float:
            model = _fit(m, data.where(F.col("__fold") != k), names, s, False, cfg)
            p = model.transform(data.where(F.col("__fold") == k))
            return p.agg(F.avg((F.col("label") - F.col(PRED)) ** 2)).first()[0]

        try:
            data.count()
            with ThreadPoolExecutor(cv) as pool:
                mses = list(pool.map(inheritable_thread_target(data.sparkSession)(error), range(1, cv + 1)))
        finally:
            data.unpersist()
    rm = [math.sqrt(x) for x in mses]
    mean_rm = sum(rm) / len(rm)
    return {"cv_rmse_mean": math.sqrt(sum(mses) / len(mses)),
            "cv_rmse_std": math.sqrt(sum((r - mean_rm) ** 2 for r in rm) / len(rm)),
            "cv_scores": rm}


def train_all(df: DataFrame, feature_names: Sequence[str], target: str, s: Series,
              model_types: Sequence[ModelType | str] = tuple(ModelType), cfg: ModelConfig = ModelConfig(),
              test_size: float | None = None) -> tuple[dict, DataFrame]:
    """Every model on one frame, positioned once; a failure becomes
    a status row with a 50-character message. Returns results and the metric
    table (one row per model)."""
    spark = df.sparkSession
    placed = _model_frame(df, list(feature_names), target, s)
    results, rows = {}, []
    for mt in model_types:
        m = model_type_of(mt)
        try:
            r = train(placed, feature_names, "label", s, m, True, test_size, cfg)
            results[m.value] = r
            mt_ = r.metrics
            rows.append((m.value, "ok", mt_["rmse"], mt_["mae"], mt_["r2"], mt_["smape"], mt_["mape"], mt_["n"]))
        except Exception as e:  # noqa: BLE001 - reported as a status row, like the reference
            rows.append((m.value, f"error: {str(e)[:50]}", None, None, None, None, None, None))
    table = spark.createDataFrame(rows, "model string, status string, rmse double, mae double, r2 double, "
                                        "smape double, mape double, n long")
    return results, table


def importance_frame(spark: SparkSession, importance: dict | None) -> DataFrame:
    rows = sorted((importance or {}).items())
    return spark.createDataFrame(rows, "feature string, importance double")
