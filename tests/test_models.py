"""Every model slot beats a mean predictor on planted data; metric formulas
against numpy."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampere.config import ModelConfig, ModelType
from ampere.operators import model as ml
from ampere.operators.series import Series

CFG = ModelConfig(forest_trees=10, boost_iters=10, landmarks=64, mlp_iters=50, svr_iters=15)
S = Series(order_by=("ts",))


@pytest.fixture(scope="module")
def planted(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(400):
        a, b = rnd.uniform(-2, 2), rnd.uniform(-2, 2)
        y = 3 * a - 2 * b + 0.5 * a * b + rnd.gauss(0, 0.1) + 50
        rows.append((dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), a, b, y))
    return spark.createDataFrame(rows, "ts timestamp_ntz, a double, b double, y double")


@pytest.fixture(scope="module")
def lagged(spark):
    """y depends only on earlier rows' features (what the look-back slot sees)."""
    rnd = random.Random(2)
    a = [rnd.uniform(-2, 2) for _ in range(400)]
    b = [rnd.uniform(-2, 2) for _ in range(400)]
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), a[i], b[i],
             (4 * a[i - 1] - 3 * b[i - 2] if i >= 2 else 0.0) + rnd.gauss(0, 0.1) + 50) for i in range(400)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, a double, b double, y double")


@pytest.mark.parametrize("mt", [m for m in ModelType if m is not ModelType.LSTM] + ["lstm_lagged"])
def test_model_beats_mean(planted, lagged, mt):
    if mt == "lstm_lagged":
        planted, mt = lagged, ModelType.LSTM
    r = ml.train(planted, ["a", "b"], "y", S, mt, True, 0.2, CFG)
    pdf = planted.orderBy("ts").toPandas()
    test = pdf["y"].to_numpy()[-80:]
    train_mean = pdf["y"].to_numpy()[:-80].mean()
    mean_rmse = float(np.sqrt(np.mean((test - train_mean) ** 2)))
    assert r.metrics["rmse"] < 0.8 * mean_rmse, (mt, r.metrics["rmse"], mean_rmse)
    assert r.predictions.count() == r.metrics["n"]
    if mt is ModelType.LSTM:  # the first look-back rows of the test part have no sequence
        assert r.metrics["n"] == 80 - CFG.lookback


def test_metric_formulas(spark):
    a = np.array([1.0, 2.0, 0.0, 4.0, 5.5])
    p = np.array([1.5, 1.0, 0.5, 4.0, 6.0])
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, p)], "label double, prediction double")
    m = ml.evaluate(df).first()
    e = a - p
    assert m.rmse == pytest.approx(np.sqrt(np.mean(e ** 2)))
    assert m.mae == pytest.approx(np.mean(np.abs(e)))
    assert m.r2 == pytest.approx(1 - np.sum(e ** 2) / np.sum((a - a.mean()) ** 2))
    assert m.smape == pytest.approx(100 * np.mean(2 * np.abs(p - a) / (np.abs(a) + np.abs(p) + 1e-8)))
    nz = a != 0
    assert m.mape == pytest.approx(100 * np.mean(np.abs((a[nz] - p[nz]) / a[nz])))


def test_folds_match_unshuffled_kfold():
    for n in (10, 11, 14, 99):
        starts = ml.fold_bounds(n, 5)
        sizes = [b - a for a, b in zip(starts, starts[1:] + [n])]
        assert sum(sizes) == n and sizes == sorted(sizes, reverse=True) and max(sizes) - min(sizes) <= 1


def test_split_is_chronological(planted):
    tr, te, n_tr, n_te = ml.chronological_split(planted, S, 0.2)
    assert (n_tr, n_te) == (320, 80)
    assert tr.agg(F.max("ts")).first()[0] < te.agg(F.min("ts")).first()[0]


@pytest.mark.parametrize("mt", list(ModelType))
def test_save_load_predict_round_trip(planted, tmp_path, mt):
    r = ml.train(planted, ["a", "b"], "y", S, mt, True, 0.2, CFG)
    r.save(str(tmp_path / "m"))
    back = ml.TrainingResult.load(str(tmp_path / "m"))
    assert back.model_type is mt and back.metrics == r.metrics
    first = r.predictions.agg(F.min("ts")).first()[0] - dt.timedelta(hours=CFG.lookback if mt is ModelType.LSTM else 0)
    got = {x.ts: x.prediction for x in ml.predict(back, planted.where(F.col("ts") >= F.lit(first))).select("ts", "prediction").collect()}
    want = {x.ts: x.prediction for x in r.predictions.collect()}
    assert want and {t: got[t] for t in want} == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("mt", [ModelType.SVR, ModelType.MLP, ModelType.LSTM])
def test_cross_validation_uses_the_slots_own_features(planted, lagged, mt):
    df = lagged if mt is ModelType.LSTM else planted
    own = ml.cross_validate(df, ["a", "b"], "y", S, mt, 3, CFG)["cv_rmse_mean"]
    std = df.agg(F.stddev_pop("y")).first()[0]
    assert own < 0.6 * std
    if mt is not ModelType.LSTM:  # a plain line cannot follow the product term
        line = ml.cross_validate(df, ["a", "b"], "y", S, ModelType.LINEAR_REGRESSION, 3, CFG)["cv_rmse_mean"]
        assert own < line


def test_elastic_net_has_the_stated_penalty(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    y = 100 * x + rng.normal(size=300)
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))],
                               "ts timestamp_ntz, x double, y double")
    r = ml.train(df, ["x"], "y", S, ModelType.ELASTIC_NET, True, 0.2)
    xt, yt = x[:240], y[:240]
    z = (xt - xt.mean()) / xt.std(ddof=1)
    c = (z * (yt - yt.mean())).mean()
    closed = (c - 0.5) / ((z * z).mean() + 0.5)
    assert r.model.stages[-1].coefficients[0] == pytest.approx(closed, rel=1e-6)


def test_unknown_type_is_linear_with_a_warning(planted):
    with pytest.warns(UserWarning, match="unknown model type"):
        r = ml.train(planted, ["a", "b"], "y", S, "mystery", True, 0.2, CFG)
    assert r.model_type is ModelType.LINEAR_REGRESSION


def test_predict_without_the_scaler(planted):
    r = ml.train(planted, ["a", "b"], "y", S, ModelType.LINEAR_REGRESSION, True, 0.2, CFG)
    scaler = r.model.stages[1]
    scaled = planted.select("ts", *[((F.col(c) - float(scaler.mean[i])) / float(scaler.std[i])).alias(c) for i, c in enumerate(["a", "b"])])
    got = sorted(x.prediction for x in ml.predict(r, scaled, scale=False).collect())
    assert got == pytest.approx(sorted(x.prediction for x in ml.predict(r, planted).collect()), rel=1e-9)
