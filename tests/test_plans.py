"""Plan guards: no single-partition exchange gathers raw rows, and ordered
queries keep their shuffles bounded."""

import re

import pytest

from ampere.plans import REGISTRY

SF = "/root/testdata/sf0.001"
GUARDED = ["lag_features", "rolling_features", "rolling_features_keyed", "rolling_features_keyed_blocked",
           "interpolate_events", "backtest_cumulative", "strategy_cumulative", "running_total_by_status",
           "interpolate_by_status", "fill_missing", "imputation_scores", "dedupe_first", "residual_box",
           "feature_set", "merge_left", "correlation"]
# operators that may feed a single-partition exchange: outputs bounded by
# groups, partitions or a limit
BOUNDED = re.compile(r"^(HashAggregate|SortAggregate|ObjectHashAggregate|LocalLimit|GlobalLimit|TakeOrdered|"
                     r"WindowGroupLimit)")
PASS_THROUGH = re.compile(r"^(Project|Filter|Sort|WholeStageCodegen|InputAdapter|\*\(\d+\))")


def _ops(plan: str):
    for line in plan.split("\n"):
        m = re.match(r"^([\s:|+\-]*)(.*)$", line)
        yield len(m.group(1)), m.group(2).strip()


def single_partition_feeds(plan: str) -> list[str]:
    lines = list(_ops(plan))
    feeds = []
    for i, (depth, op) in enumerate(lines):
        if op.startswith("Exchange SinglePartition"):
            for d2, op2 in lines[i + 1:]:
                if d2 <= depth:
                    break
                op2 = re.sub(r"^\*\(\d+\)\s*", "", op2)
                if PASS_THROUGH.match(op2):
                    continue
                feeds.append(op2)
                break
    return feeds


@pytest.mark.parametrize("name", GUARDED)
def test_no_single_partition_over_rows(spark, name):
    df = REGISTRY[name].run(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    bad = [f for f in single_partition_feeds(plan) if not BOUNDED.match(f)]
    assert not bad, (name, bad)


def test_keyed_window_single_shuffle(spark):
    df = REGISTRY["rolling_features_keyed"].run(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in plan


def test_scan_prunes_columns(spark):
    df = REGISTRY["backtest_oracle_totals"].run(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert sorted(f.split(":")[0] for f in schema.split(",")) == ["event_type", "ts", "value"]


def test_guard_flags_keyless_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    ev = spark.read.parquet(f"{SF}/events.parquet")
    df = ev.select("ts", F.lag("value", 1).over(Window.orderBy("ts")).alias("x"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert [f for f in single_partition_feeds(plan) if not BOUNDED.match(f)]
