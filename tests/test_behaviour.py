"""Cases that were wrong once: fills, duplicates, loaders, chooser, quantiles, plans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ampere.config import CleaningConfig, ImputationMethod
from ampere.operators import clean, stats
from ampere.operators.series import Fill, Lag, Rolling, RunningSum, Series, apply_series
from ampere.sources import csv as src

T0 = dt.datetime(2024, 1, 1)


def hours(spark, values, kind="double"):
    return spark.createDataFrame([(T0 + dt.timedelta(hours=i), v) for i, v in enumerate(values)], f"ts timestamp_ntz, v {kind}")


@pytest.mark.parametrize("strategy", ["blocked", "keyed"])
@pytest.mark.parametrize("kind, a, b", [("bigint", 2**53 + 1, 7), ("string", "x", "y"), ("date", dt.date(2024, 1, 1), dt.date(2024, 2, 1)),
                                        ("decimal(38,2)", None, None)])
def test_fills_keep_the_type(spark, strategy, kind, a, b):
    from decimal import Decimal

    a, b = (Decimal("123456789012345678901234.56"), Decimal("1.00")) if kind.startswith("dec") else (a, b)
    df = hours(spark, [None, a, None, None, b, None], kind).withColumn("k", F.lit("one"))
    s = Series(order_by=("ts",), keys=("k",), strategy=strategy, block_rows=2)
    out = apply_series(df, s, [Fill("v", "ffill", "f"), Fill("v", "bfill", "b")]).orderBy("ts").collect()
    assert [r.f for r in out] == [None, a, a, a, b, b] and [r.b for r in out] == [a, a, b, b, b, None]


def test_dateless_table_drops_equal_rows_and_imputes_in_ingest_order(spark):
    df = spark.createDataFrame([(0, "1", "x"), (1, "1", "x"), (2, None, "x"), (3, "3", "y")], f"{clean.INGEST_ORDER} long, v string, name string")
    out, rep = clean.clean_table(df.drop("name"), methods={"v": "forward_fill"}, auto_impute=False)
    assert rep.duplicates_removed == 1 and rep.missing_values_filled == {"v": 1}
    assert sorted(r.v for r in out.collect()) == [1.0, 1.0, 3.0]
    with pytest.raises(ValueError, match="needs an order"):
        clean.clean_table(df.drop(clean.INGEST_ORDER), report=False)


def test_manual_methods_and_outliers(spark):
    values = [10.0, 11.0, None, 9.0, 10.5, 1000.0, None, 10.0, 9.5, 10.2, 11.0, 9.9]
    df = hours(spark, values).select(F.date_format("ts", "[dd/MM/yyyy HH:mm]").alias("Date (WET)"), "v")
    out, rep = clean.clean_table(df, methods={"v": ImputationMethod.INTERPOLATE_LINEAR}, auto_impute=False,
                                 outliers="zscore", outlier_threshold=2.0, remove_dupes=False)
    assert rep.outliers_handled == {"v": 1} and rep.missing_values_filled == {"v": 3}
    assert rep.methods == {"v": ImputationMethod.INTERPOLATE_LINEAR.value}
    got = [r.v for r in out.collect()]
    assert got[2] == 10.0 and got[5] == pytest.approx(10.5 - 0.5 / 3) and max(got) < 12
    out, rep = clean.clean_table(df, auto_impute=False, outliers="iqr", outlier_threshold=3.0, outlier_action="drop", remove_dupes=False)
    assert rep.final_rows == 11 and out.count() == 11 and rep.to_dict()["rows_removed"] == 1


def test_chooser_policies(spark):
    # a straight line: interpolation is exact inside, impossible in the last gap
    df = hours(spark, [float(i) for i in range(200)])
    s = Series(order_by=("ts",))
    assert clean.find_best_imputation_method(df, "v", s)[0] is ImputationMethod.FORWARD_FILL
    best, rmse = clean.find_best_imputation_method(df, "v", s, policy="interior")
    assert best is ImputationMethod.INTERPOLATE_LINEAR and rmse == pytest.approx(0)
    with pytest.raises(ValueError):
        clean.imputation_scores(df, ["v"], s, policy="other")


def test_chooser_plan_does_not_depend_on_its_size(spark):
    df = hours(spark, [float(i % 7) for i in range(5000)])
    scores = clean.imputation_scores(df, ["v"], Series(order_by=("ts",)), CleaningConfig(imputation_test_size=1500))
    assert scores.where("rmse is not null").count() >= 1
    assert "TakeOrderedAndProject" in scores._jdf.queryExecution().executedPlan().toString()


def test_given_columns_are_never_cut(spark):
    names = [f"c{i}" for i in range(18)]
    df = spark.range(50).select(*[(F.col("id") * (i + 1) % 11).cast("double").alias(n) for i, n in enumerate(names)])
    count = lambda d: d.select("column_a").distinct().count()
    assert count(stats.correlation_matrix(df, names)) == 18
    assert count(stats.correlation_matrix(df)) == 15 and count(stats.correlation_matrix(df, max_columns=None)) == 18


@pytest.mark.parametrize("qs", [[0.0, 0.25, 0.5, 0.9, 1.0]])
def test_quantiles_with_many_ties(spark, qs):
    import numpy as np

    rng = np.random.default_rng(1)
    values = np.where(rng.random(4000) < 0.9, 0.0, rng.normal(size=4000))
    df = spark.createDataFrame([(float(v), i % 3) for i, v in enumerate(values)], "v double, g int")
    got = {r.quantile: r.value for r in stats.exact_quantiles(df, "v", qs).collect()}
    assert [got[q] for q in qs] == pytest.approx(list(np.quantile(values, qs)))
    by = {(r.g, r.quantile): r.value for r in stats.exact_quantiles(df, "v", qs, ["g"]).collect()}
    for g in range(3):
        assert [by[g, q] for q in qs] == pytest.approx(list(np.quantile(values[g::3], qs)))


def test_grouped_histogram_never_broadcasts_the_data(spark):
    df = spark.range(9000).selectExpr("id % 3 as g", "cast(id % 97 as double) as v")
    plan = stats.histogram(df, "v", 10, group_by=["g"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "BuildLeft" not in plan
    assert sum(r["count"] for r in stats.histogram(df, "v", 10, group_by=["g"]).collect()) == 9000


def test_window_and_carry_share_one_shuffle(spark):
    df = spark.range(2000).selectExpr("id as t", "id % 2 as k", "if(id % 5 = 0, null, cast(id as double)) as v")
    s = Series(order_by=("t",), keys=("k",), strategy="blocked", block_rows=100)
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = apply_series(df, s, [Fill("v", "ffill", "f"), RunningSum("v", "sum"), Lag("v", 1, "l")])
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    # rows once; the summary's partial sums, and the carries for the join
    assert plan.count("Exchange hashpartitioning(__ampere_blk") == 3, plan
    assert out.count() == 2000


def test_frame_counts_are_planned_once(spark):
    df = spark.range(100).selectExpr("id as t", "1 as k", "if(id % 9 = 0, null, cast(id as double)) as v")
    s = Series(order_by=("t",), keys=("k",), strategy="keyed")
    out = apply_series(df, s, [Rolling("v", 3, st, st) for st in ("mean", "std", "min", "max")])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("count(v") == 1, plan
    assert out.columns == ["t", "k", "v", "mean", "std", "min", "max"]


def test_skipped_lines_keep_options_and_check_headers(spark, tmp_path):
    one = tmp_path / "one"
    one.mkdir()
    (one / "1.csv").write_text("note\na;b\n1;NA\n")
    (one / "2.csv").write_text("other\na;b\n2;x\n")
    rows = src.load_csv(spark, str(one), skip_rows=1, nullValue="NA").select("a", "b").collect()
    assert sorted(map(tuple, rows), key=str) == [("1", None), ("2", "x")]
    (one / "3.csv").write_text("third\nb;a\n3;7\n")
    with pytest.raises(ValueError, match="different headers"):
        src.load_csv(spark, str(one), skip_rows=1)


def test_units_row_is_found_in_one_pass(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date (WET);price\n;GBP/MWh\n[01/01/2024 00:00];1,5\n[01/01/2024 01:00];GBP\n")
    (tmp_path / "b.csv").write_text("Date (WET);price\n[02/01/2024 00:00];2,5\n")
    df = src.load_auction_data(spark, str(tmp_path))
    assert sorted(r.price for r in df.collect()) == ["1,5", "2,5", "GBP"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
