"""The trained slots' own algorithms against plain versions: back-propagation,
second-order boosting, the tube's optimality conditions, recurrent states and
one-scan cross-validation. Small operators without a query of their own."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ampere.config import ModelConfig, ModelType
from ampere.functions import scalar
from ampere.operators import clean, kernel, model, neural, recurrent, stats
from ampere.operators.boosting import BoostParams, SecondOrderBoosting
from ampere.operators.series import Series

S = Series(order_by=("i",))


def frame(spark, x, y):
    names = [f"x{k}" for k in range(x.shape[1])]
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], ["i", *names, "label"]).repartition(3)
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(df), names


def predictions(model_, df):
    return np.array([r.prediction for r in model_.transform(df).orderBy("i").select("prediction").collect()])


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(1)
    for layers in ((3, 1), (3, 5, 1), (2, 6, 4, 1)):
        x, y = rng.normal(size=(30, layers[0])), rng.normal(size=30)
        params = neural.start_weights(layers, 2) + 0.01 * rng.normal(size=sum(a * b for a, b in neural.shapes(layers)))
        _, grad = neural.loss_and_gradient(params, layers, x, y)
        for k in rng.choice(len(params), min(25, len(params)), replace=False):
            step = np.zeros(len(params))
            step[k] = 1e-6
            numeric = (neural.loss_and_gradient(params + step, layers, x, y)[0] - neural.loss_and_gradient(params - step, layers, x, y)[0]) / 2e-6
            assert grad[k] == pytest.approx(numeric, rel=1e-4, abs=1e-5)


def test_no_hidden_layer_is_least_squares(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 4 + rng.normal(size=200)
    df, _ = frame(spark, x, y)
    got = predictions(neural.MultilayerRegression((), 0.0, validation=0).fit(df), df)
    w = np.linalg.lstsq(np.c_[x, np.ones(200)], y, rcond=None)[0]
    assert got == pytest.approx(np.c_[x, np.ones(200)] @ w, abs=1e-4)


def plain_boosting(x, y, p):
    """Greedy trees over all distinct values, missing ones on the better side."""
    margin = np.full(len(y), y.mean())

    def grow(rows, depth):
        g, h = (margin - y)[rows].sum(), len(rows)
        score = lambda a, b: a * a / (b + p.penalty)
        best = (1e-9, None)
        if depth < p.depth:
            for f in range(x.shape[1]):
                v = x[rows, f]
                for cut in np.unique(v[~np.isnan(v)])[:-1] if np.isnan(v).sum() == 0 else np.unique(v[~np.isnan(v)]):
                    for missing_left in (False, True) if np.isnan(v).any() else (False,):
                        left = np.where(np.isnan(v), missing_left, v <= cut)
                        gl, hl = (margin - y)[rows[left]].sum(), left.sum()
                        if hl < p.child or h - hl < p.child:
                            continue
                        gain = 0.5 * (score(gl, hl) + score(g - gl, h - hl) - score(g, h)) - p.least_gain
                        if gain > best[0] + 1e-9:
                            best = (gain, left)
        if best[1] is None:
            return [(rows, -g / (h + p.penalty))]
        return grow(rows[best[1]], depth + 1) + grow(rows[~best[1]], depth + 1)

    for _ in range(p.rounds):
        step = np.zeros(len(y))
        for rows, value in grow(np.arange(len(y)), 0):
            step[rows] = value
        margin = margin + p.eta * step
    return margin


def test_boosting_equals_greedy_trees(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.uniform(0, 10, size=(160, 3)), 1)
    x[rng.random((160, 3)) < 0.15] = np.nan
    y = np.where(np.nan_to_num(x[:, 0], nan=9.0) > 5, 10.0, 0.0) + np.nan_to_num(x[:, 1]) ** 2 + rng.normal(size=160)
    df, _ = frame(spark, x, y)
    for p in (BoostParams(rounds=4, depth=3, eta=0.3), BoostParams(rounds=2, depth=2, eta=1.0, penalty=5.0, least_gain=20.0, child=10.0, checkpoint_every=1)):
        fitted = SecondOrderBoosting(p).fit(df)
        assert predictions(fitted, df) == pytest.approx(plain_boosting(x, y, p), abs=1e-6)
        assert fitted.featureImportances.toArray().sum() == pytest.approx(1.0) and fitted.featureImportances[2] < 0.2


def test_tube_meets_the_conditions_of_its_optimum(spark):
    """On 500 rows that are all landmarks, so that the kernel is exact, against
    the dense dual problem."""
    rng = np.random.default_rng(4)
    x = rng.uniform(-2, 2, size=(500, 2))
    y = np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] + rng.normal(0, 0.15, 500)
    df, _ = frame(spark, x, y)
    c, epsilon = 2.0, 0.1
    fitted = kernel.TubeRegression(c, epsilon, landmarks=500, max_iter=60).fit(df)
    a = fitted.arrays()
    errors = predictions(fitted, df) - y
    assert (np.abs(errors) < epsilon).sum() > 100 and (np.abs(errors) > epsilon).sum() > 50
    # any feasible dual point bounds the optimum from below: the gap to the primal value is small
    gram = kernel.rbf(x, x, float(a["gamma"][0]))
    own = kernel.rbf(a["landmarks"], a["landmarks"], float(a["gamma"][0]))
    primal = 0.5 * a["weights"] @ own @ a["weights"] + c * np.maximum(np.abs(errors) - epsilon, 0).sum()
    beta = -c * kernel.tube_loss(errors, epsilon, 0.001 * y.std())[1]
    beta -= beta.sum() / len(beta)
    beta *= min(1.0, c / np.abs(beta).max())
    dual = -0.5 * beta @ gram @ beta + y @ beta - epsilon * np.abs(beta).sum()
    assert 0.93 * primal < dual <= primal * (1 + 1e-6), (dual, primal)
    loss, slope = kernel.tube_loss(np.array([-0.3, -0.1, 0.0, 0.1, 0.105, 0.5]), 0.1, 0.01)
    assert loss[1:4].tolist() == [0, 0, 0] and slope[[0, -1]].tolist() == [-1, 1] and loss[-1] == pytest.approx(0.395)


def states_of(x, memory, mixtures=0):
    u = recurrent.unit_inputs(x, mixtures, 42)
    state, out = np.zeros(len(memory) * u.shape[1]), []
    for row in u:
        out.append(state)
        state = np.concatenate([m * state[k * u.shape[1] : (k + 1) * u.shape[1]] + (1 - m) * row for k, m in enumerate(memory)])
    return np.array(out)


@pytest.mark.parametrize("block_rows", [1, 7, 64, 1000])
def test_states_do_not_depend_on_blocks(spark, block_rows):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 2))
    df, _ = frame(spark, x, np.zeros(150))
    memory = (0.0, 0.5, 0.95)
    out = recurrent.ReservoirStates(3, ("i",), memory, 4, block_rows=block_rows).transform(df).orderBy("i").select("i", vector_to_array("states").alias("s")).collect()
    assert [r.i for r in out] == list(range(3, 150))
    assert np.array([r.s for r in out]) == pytest.approx(states_of(x, memory, 4)[3:], abs=1e-9)


def test_memory_beyond_ten_rows(spark):
    """A target that remembers a hundred rows: ten rows side by side cannot
    follow it, the recurrent slot does."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 1))
    y = np.array([0.0])
    for v in x[:-1, 0]:
        y = np.append(y, 0.97 * y[-1] + 0.3 * v)
    df, names = frame(spark, x, y)
    r = model.train(df.drop("features"), names, "label", S, ModelType.LSTM, False, 0.2, ModelConfig())
    assert r.metrics["r2"] > 0.9 and r.metrics["n"] == 300 - 10
    flat = np.array([x[t - 10 : t, 0] for t in range(10, 1500)])
    train, test = slice(0, 1190), slice(1190, 1490)
    w = np.linalg.lstsq(np.c_[flat[train], np.ones(1190)], y[10:][train], rcond=None)[0]
    held = y[10:][test]
    assert 1 - ((np.c_[flat[test], np.ones(300)] @ w - held) ** 2).sum() / ((held - held.mean()) ** 2).sum() < 0.7


@pytest.mark.parametrize("mt", [ModelType.LINEAR_REGRESSION, ModelType.ELASTIC_NET])
def test_one_scan_cross_validation_equals_a_fit_per_fold(spark, mt):
    rng = np.random.default_rng(7)
    x = rng.normal(100, [1, 30], size=(203, 2))
    y = 3 * x[:, 0] - 2 * x[:, 1] + rng.normal(0, 5, 203) + 1e5
    df, names = frame(spark, x, y)
    df = df.drop("features")
    got = model.cross_validate(df, names, "label", S, mt, 4)["cv_scores"]
    bounds = [*model.fold_bounds(203, 4), 203]
    data = df.withColumn("__pos", F.col("i"))
    for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        held = (F.col("i") >= lo) & (F.col("i") < hi)
        fitted = model._fit(mt, data.where(~held), names, S, False, ModelConfig())
        mse = fitted.transform(data.where(held)).agg(F.avg((F.col("label") - F.col("prediction")) ** 2)).first()[0]
        assert got[k] == pytest.approx(np.sqrt(mse), rel=1e-5)


def test_small_operators(spark):
    assert scalar.title_label("price_first_auction") == "Price First Auction"
    df = spark.createDataFrame([("31/10/2021 23:00",), ("[2021-10-31 23:00:00]",), ("no date",)], "s string")
    stamp = dt.datetime(2021, 10, 31, 23)
    assert [r.t for r in df.select(scalar.parse_timestamp("s").alias("t")).collect()] == [stamp, None, None]
    assert [r.t for r in df.select(scalar.parse_timestamp("s", fallback=True).alias("t")).collect()] == [stamp, stamp, None]
    assert stats.first_available(None, df, None) is df and stats.first_available(None, None) is None
    wide = spark.createDataFrame([(1, 2, 3)], "c int, a int, b int")
    assert stats.first_columns(wide, 2) == ["c", "a"] and stats.first_columns(wide, 9) == ["c", "a", "b"]
    table = spark.createDataFrame([(m, 1.0) for m in "abcdef"], "model string, rmse double")
    assert sorted(r.model for r in stats.first_models(table, list("fbdace")).collect()) == ["a", "b", "d", "f"]


def test_cleaned_table_is_in_order(spark):
    from ampere import config as C

    stamps = [f"{d:02d}/01/2024 {h:02d}:00" for d in range(1, 9) for h in range(24)]
    random.Random(8).shuffle(stamps)
    df = spark.createDataFrame([(s, str(k)) for k, s in enumerate(stamps)], f"`{C.DATE_COLUMN}` string, {C.PRICE_FIRST} string").repartition(7)
    cleaned, _ = clean.clean_auction_data(df, remove_dupes=False)
    got = [r[0] for r in cleaned.select(f"`{C.DATE_COLUMN}`").collect()]
    assert got == sorted(got) and len(got) == len(stamps)


@pytest.mark.parametrize("run", [1, 3, 256])
def test_scanned_states_equal_the_plain_recurrence(run):
    rng = np.random.default_rng(11)
    u, memory, start = rng.normal(size=(700, 3)), np.array([0.0, 0.5, 0.99]), rng.normal(size=9)
    out = recurrent.scan(u, memory, start, run)
    keep, state = np.repeat(memory, 3), start
    for t, row in enumerate(u):
        assert out[t] == pytest.approx(state, abs=1e-12)
        state = keep * state + (1 - keep) * np.tile(row, 3)
    assert out[-1] == pytest.approx(state, abs=1e-12)


def test_the_recurrent_slots_target_is_made_once(spark):
    """Its 300 steps a row must not be repeated by every pass over the rows:
    the plan behind it reads what was written. The values are those of the
    formula, over more rows than a frame."""
    from ampere.plans import modelling as m

    values = np.random.default_rng(12).uniform(0, 9, 700).round(2).tolist()
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i // 2), i, v) for i, v in enumerate(values)],
                                 "ts timestamp_ntz, event_id long, value double").repartition(3)
    out = m._mean_of_before(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Python" not in plan and "ExistingRDD" in plan, plan
    got = {r.event_id: r.target for r in out.collect()}
    for i in (0, 1, 5, 299, 300, 301, 699):
        before = values[max(0, i - m.BACK) : i]
        assert got[i] == pytest.approx(sum(v * (1 - m.KEEP) * m.KEEP ** k for k, v in enumerate(reversed(before))), abs=1e-12)


def test_equal_rows_are_held_once(spark):
    from ampere.operators.blocks import counted, packed

    x, y = np.array([[1.0, 2.0], [3.0, -0.0], [3.0, 0.0], [1.0, 2.0], [1.0, 2.0]]), np.array([5.0, 6.0, 6.0, 5.0, 7.0])
    df, _ = frame(spark, np.tile(x, (40, 1)), np.tile(y, 40))
    blocks = packed(df, "features", "label", alike=True)
    try:
        got = {(*map(float, a), float(b)): float(c) for rows in counted(blocks.toArrow().to_batches()) for a, b, c in zip(*rows)}
        assert got == {(1.0, 2.0, 5.0): 80.0, (3.0, 0.0, 6.0): 80.0, (1.0, 2.0, 7.0): 40.0}
        assert sum(len(np.frombuffer(r.y)) for r in blocks.collect()) == 3
    finally:
        blocks.unpersist()


def test_tube_counts_rows_that_come_again(spark, monkeypatch):
    """Three copies of the rows at a third of C take the same steps, in parts of
    any size."""
    rng = np.random.default_rng(13)
    x = rng.uniform(-2, 2, size=(90, 2))
    y = np.sin(2 * x[:, 0]) + rng.normal(0, 0.1, 90)
    once, _ = frame(spark, x, y)
    thrice, _ = frame(spark, np.tile(x, (3, 1)), np.tile(y, 3))
    want = predictions(kernel.TubeRegression(3.0, 0.1, 90, 5).fit(once), once)
    monkeypatch.setattr(kernel, "_PART", 90 * 7)
    got = predictions(kernel.TubeRegression(1.0, 0.1, 90, 5).fit(thrice), once)
    assert got == pytest.approx(want, abs=1e-4)
