"""Streaming twin of the market view, and driver-side API pieces (save/load,
cross-validation, train-all, dashboard, loaders)."""

import uuid

import pytest
from pyspark.sql import functions as F

from ampere import config as C
from ampere.config import ModelConfig, ModelType
from ampere.operators import features as fe
from ampere.operators import model as ml
from ampere.operators import stats
from ampere.operators.series import Series
from ampere.session import ensure_checkpoint_dir
from ampere.sources import csv as src
from ampere.sources.driver_tables import market_view, table
from ampere.streaming import market_view_stream, signal_stream

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    ev = table(spark, SF, "events")
    stream = spark.readStream.schema(ev.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    name = f"mv_{uuid.uuid4().hex[:8]}"
    q = market_view_stream(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table(name)
    n = got.count()
    assert n > 0
    batch = market_view(ev)
    # every hour emitted by the stream equals the batch view exactly
    assert got.exceptAll(batch.join(got.select(C.DATE_COLUMN), C.DATE_COLUMN, "left_semi")).count() == 0
    sig = signal_stream(got)
    assert set(r.action for r in sig.collect()) <= {"hold", "buy_first_sell_second", "sell_first_buy_second"}


@pytest.mark.parametrize("files_per_trigger", [None, 20])
def test_stream_over_many_files_in_any_order(spark, tmp_path, files_per_trigger):
    """Events dealt at random over files: late rows must not be lost."""
    from ampere.plans.stream import streamed_view

    ev = table(spark, SF, "events")
    ev.withColumn("r", F.rand(3)).repartition(90, "r").drop("r").write.parquet(str(tmp_path / "events"))
    got = streamed_view(spark, str(tmp_path / "events"), ev.schema, files_per_trigger)
    want = market_view(ev)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def _training(spark):
    fs = fe.create_feature_set(market_view(table(spark, "/root/testdata/sf0.01", "events")),
                               Series(order_by=(C.DATE_COLUMN,)), target_column=C.PRICE_SECOND,
                               include_rolling=False)
    names = [n for n in fe.select_model_features(fs.features.columns) if n != C.PRICE_SECOND]
    return fe.prepare_training_data(fs.features, names, C.PRICE_SECOND)


def test_ols_matches_numpy_and_save_load(spark):
    import numpy as np

    data, names = _training(spark)
    s = Series(order_by=(C.DATE_COLUMN,))
    r = ml.train(data, names, C.PRICE_SECOND, s, ModelType.LINEAR_REGRESSION, scale_features=False, test_size=0.2)
    pdf = data.orderBy(C.DATE_COLUMN).toPandas()
    n_test = int(np.ceil(len(pdf) * 0.2))
    tr = pdf.iloc[: len(pdf) - n_test]
    X = np.column_stack([tr[names].to_numpy(float), np.ones(len(tr))])
    coef, *_ = np.linalg.lstsq(X, tr[C.PRICE_SECOND].to_numpy(float), rcond=None)
    te = pdf.iloc[len(pdf) - n_test:]
    pred = np.column_stack([te[names].to_numpy(float), np.ones(len(te))]) @ coef
    rmse = float(np.sqrt(np.mean((te[C.PRICE_SECOND].to_numpy(float) - pred) ** 2)))
    assert r.metrics["n"] == n_test
    assert r.metrics["rmse"] == pytest.approx(rmse, rel=1e-4)
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    r.save(path)
    back = ml.TrainingResult.load(path)
    assert back.feature_names == names and back.metrics["rmse"] == pytest.approx(r.metrics["rmse"])
    assert ml.predict(back, data.limit(5)).count() == 5


def test_cross_validate_and_train_all(spark):
    data, names = _training(spark)
    s = Series(order_by=(C.DATE_COLUMN,))
    cv = ml.cross_validate(data, names[:5], C.PRICE_SECOND, s, ModelType.LINEAR_REGRESSION, cv=5)
    assert len(cv["cv_scores"]) == 5 and cv["cv_rmse_mean"] > 0
    cfg = ModelConfig(forest_trees=5, boost_iters=3)
    res, table_ = ml.train_all(data, names, C.PRICE_SECOND, s,
                               [ModelType.LINEAR_REGRESSION, ModelType.ELASTIC_NET, ModelType.RANDOM_FOREST], cfg)
    rows = {r.model: r for r in table_.collect()}
    assert all(r.status == "ok" for r in rows.values())
    best = stats.best_per_metric(table_).first()
    assert best.best_rmse_model in rows
    assert res["random_forest"].feature_importance is not None


def test_dashboard_and_loaders(spark, tmp_path):
    mv = market_view(table(spark, SF, "events"))
    dash = stats.summary_dashboard(mv)
    assert set(dash) >= {"timeseries", "missing", "correlation", "distribution"}
    assert dash["correlation"].count() == 64
    d = tmp_path / "data"
    d.mkdir()
    (d / C.AUCTION_FILE).write_text("Date (WET);price_first_auction\n;GBP/MWh\n[01/01/2021 00:00];1,5\n")
    res = src.load_all_from_directory(spark, str(d))
    assert res.is_valid and res.warnings and res.forecast_inputs is None
    summary = res.get_summary()
    assert summary["auction_data"]["rows"] == 1
    ok, missing = src.validate_dataframe(res.auction_data, [C.DATE_COLUMN, C.PRICE_SECOND])
    assert not ok and missing == [C.PRICE_SECOND]
    bad = src.load_all_from_directory(spark, str(tmp_path / "nowhere"))
    assert not bad.is_valid and "auction_data" in bad.errors
    assert F is not None
