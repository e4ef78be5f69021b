"""Properties of the ordered-series core: the blocked shape equals the
plain keyed window for any block size, input order does not matter, fills
never touch non-null cells."""

import random

import pytest
from pyspark.sql import functions as F

from ampere.operators.series import (Fill, Lag, Lookback, Rolling, RowIndex, RunningSum, Series, apply_series,
                                     global_index, IDX)

OPS = [Lag("v", 1, "lag1"), Lag("v", 7, "lag7"), Rolling("v", 5, "mean", "m5"), Rolling("v", 4, "std", "s4"),
       Rolling("v", 6, "median", "med6", min_periods=1), Rolling("v", 3, "max", "mx3", exclude_current=True),
       Fill("v", "ffill", "ff"), Fill("v", "bfill", "bf"), Fill("v", "interpolate", "ip"),
       RunningSum("v", "cs"), RowIndex("ix")]
NAMES = [o.name for o in OPS]


def _data(spark, n=700, keys=3, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = rnd.choice(range(keys)) if rnd.random() > 0.5 else 0  # key 0 is hot
        v = None if rnd.random() < 0.3 else round(rnd.uniform(-50, 50), 2)
        rows.append((k, i, v))
    return spark.createDataFrame(rows, "k int, t long, v double")


def _rows(df):
    return {(r.k, r.t): tuple(None if r[c] is None else float(r[c]) for c in NAMES) for r in df.collect()}


def _same(got, want):
    """Equal keys and nulls; values equal up to float re-association (a
    running sum carried across blocks adds in a different order)."""
    assert got.keys() == want.keys()
    for k in want:
        for name, a, b in zip(NAMES, got[k], want[k]):
            assert (a is None) == (b is None), (k, name, a, b)
            if a is not None:
                assert a == pytest.approx(b, rel=1e-9, abs=1e-9), (k, name, a, b)


@pytest.fixture(scope="module")
def expected(spark):
    df = _data(spark)
    return _rows(apply_series(df, Series(order_by=("t",), keys=("k",), strategy="keyed"), OPS))


@pytest.mark.parametrize("block", [8, 13, 64, 10_000])
def test_blocked_equals_keyed(spark, expected, block):
    df = _data(spark)
    got = _rows(apply_series(df, Series(order_by=("t",), keys=("k",), strategy="blocked", block_rows=block), OPS))
    _same(got, expected)


def test_order_independent(spark, expected):
    df = _data(spark).repartition(5, F.rand(3)).orderBy(F.rand(5))
    got = _rows(apply_series(df, Series(order_by=("t",), keys=("k",), strategy="blocked", block_rows=16), OPS))
    _same(got, expected)


def test_global_index_dense(spark):
    df = _data(spark, n=500)
    idx = sorted(r[0] for r in global_index(df, Series(order_by=("t",))).select(IDX).collect())
    assert idx == list(range(500))


def test_fills_keep_values(spark):
    df = _data(spark)
    out = apply_series(df, Series(order_by=("t",), keys=("k",), block_rows=32, strategy="blocked"),
                       [Fill("v", "ffill", "f"), Fill("v", "interpolate", "i")])
    bad = out.where(F.col("v").isNotNull() & ((F.col("f") != F.col("v")) | (F.col("i") != F.col("v")))).count()
    assert bad == 0


def test_lookback_sequence(spark):
    df = spark.range(15).select(F.col("id").alias("t"), (F.col("id") * 1.5).alias("v"))
    out = apply_series(df, Series(order_by=("t",), block_rows=4), [Lookback(("v",), 3, "seq")])
    rows = {r.t: r.seq for r in out.collect()}
    assert rows[2] is None
    assert [x.v for x in rows[3]] == [0.0, 1.5, 3.0]
    assert [x.v for x in rows[14]] == [16.5, 18.0, 19.5]


def test_reach_must_fit_block(spark):
    df = spark.range(10).select(F.col("id").alias("t"), F.col("id").cast("double").alias("v"))
    with pytest.raises(ValueError):
        apply_series(df, Series(order_by=("t",), block_rows=4), [Lag("v", 5, "x")])


def test_hot_key_routes_to_blocked(spark, expected):
    from ampere.operators.series import use_blocked

    df = _data(spark)
    hot = Series(order_by=("t",), keys=("k",), max_key_rows=100, block_rows=32)
    cool = Series(order_by=("t",), keys=("k",))
    assert use_blocked(df, hot) and not use_blocked(df, cool)
    _same(_rows(apply_series(df, hot, OPS)), expected)


@pytest.mark.parametrize("blocks", [None, 70, 133, 10_000])
def test_long_frames_equal_frames_read_again(spark, monkeypatch, blocks):
    """Frames put together from runs of rows, for every statistic, with and
    without the current row, against the plain windows."""
    from ampere.operators import series

    df = _data(spark, n=400).withColumn("v", F.col("v") * 1e3 + 1e7)
    ops = [Rolling("v", n, st, f"{st}_{n}_{int(ex)}", need, ex) for n in (2, 7, 64) for st in ("mean", "std", "min", "max", "sum")
           for need, ex in ((1, False), (None, True))]
    s = Series(order_by=("t",), keys=("k",), strategy="keyed" if blocks is None else "blocked", block_rows=blocks or 1)

    def rows(long):
        monkeypatch.setattr(series, "_LONG_FRAME", long)
        return {(r.k, r.t): r for r in apply_series(df, s, ops).collect()}

    want, got = rows(10**9), rows(2)
    assert want.keys() == got.keys() and set(want[0, min(t for k, t in want if k == 0)].asDict()) == set(got[0, min(t for k, t in got if k == 0)].asDict())
    for key, r in want.items():
        for o in ops:
            a, b = r[o.name], got[key][o.name]
            assert (a is None) == (b is None) and (a is None or b == pytest.approx(a, rel=1e-9, abs=1e-6)), (key, o, a, b)


@pytest.mark.parametrize("strategy,blocks", [("keyed", 1), ("blocked", 30), ("blocked", 10_000)])
def test_gap_medians_equal_plain_windows(spark, strategy, blocks):
    from pyspark.sql import Window

    df = _data(spark, n=500).withColumn("x", F.when(F.col("t") % 11 == 0, F.col("t").cast("int")))
    s = Series(order_by=("t",), keys=("k",), strategy=strategy, block_rows=blocks)
    ops = [Rolling(c, n, "median", f"{c}_{n}_{need}", need, fill_only=True) for c in ("v", "x") for n in (3, 24) for need in (1, 2)]
    got = {(r.k, r.t): r for r in apply_series(df, s, ops).collect()}
    for o in ops:
        w = Window.partitionBy("k").orderBy("t").rowsBetween(-(o.n - 1), 0)
        plain = F.coalesce(F.col(o.column), F.when(F.count(o.column).over(w) >= o.min_periods, F.percentile(o.column, F.lit(0.5)).over(w)))
        for r in df.select("k", "t", plain.alias("m")).collect():
            m = got[r.k, r.t][o.name]
            assert (m is None) == (r.m is None) and (m is None or m == pytest.approx(r.m, rel=1e-12)), (o, r, m)


@pytest.mark.parametrize("strategy", ["auto", "blocked"])
def test_tasks_follow_the_rows(spark, monkeypatch, strategy):
    """The rows of one task do not grow with the input: 60 keys or blocks of
    2,000 rows, few bytes each, are not joined into a few tasks."""
    from ampere.operators import series

    df = spark.range(120_000).select((F.col("id") % 60).alias("k"), F.col("id").alias("t"), (F.col("id") % 7).cast("double").alias("v"))
    monkeypatch.setattr(series, "_TASK_ROWS", 2_000, raising=False)
    out = apply_series(df, Series(order_by=("t",), keys=("k",), strategy=strategy, block_rows=2_000), [Rolling("v", 100, "mean", "m", 1)])
    tasks = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(tasks) == 120_000 and len(tasks) >= 30 and max(tasks) <= 12_000, tasks


@pytest.mark.parametrize("series", [
    Series(order_by=("t",), keys=("k",), strategy="keyed"),
    Series(order_by=("t",), keys=("k",), strategy="blocked", block_rows=90),
    Series(order_by=("t",), block_rows=71),
])
def test_long_look_backs_and_folds(spark, series):
    """Frames copied from the rows that stream past, and one number made of
    each, against plain lists; nulls, strings and several frames at once."""
    import pyarrow as pa

    df = _data(spark, n=400).withColumn("s", F.concat(F.lit("r"), "t"))

    def total(frames):
        return pa.array([None if x is None else float(sum(r["t"] for r in x)) for x in frames.to_pylist()], pa.float64())

    ops = [Lookback(("v", "s"), 64, "whole"), Lookback(("t",), 70, "some", whole=False), Lookback(("t",), 5, "sum", fold=total),
           Lookback(("t",), 66, "sums", whole=False, fold=total), Lookback(("v",), 3, "short"), Lag("v", 2, "lag")]
    out = apply_series(df, series, ops)
    assert out.columns == ["k", "t", "v", "s", *[o.name for o in ops]]
    got = out.collect()
    assert len(got) == 400
    before = {}
    for r in sorted(got, key=lambda r: r.t):
        seen = before.setdefault(r.k if series.keys else 0, [])
        assert (r.whole and [(x.v, x.s) for x in r.whole]) == ([(x.v, x.s) for x in seen[-64:]] if len(seen) >= 64 else None)
        assert [x.t for x in r.some] == [x.t for x in seen[-70:]]
        assert r.sum == (sum(x.t for x in seen[-5:]) if len(seen) >= 5 else None)
        assert r.sums == sum(x.t for x in seen[-66:])
        assert (r.short and [x.v for x in r.short]) == ([x.v for x in seen[-3:]] if len(seen) >= 3 else None)
        assert r.lag == (seen[-2].v if len(seen) >= 2 else None)
        seen.append(r)
