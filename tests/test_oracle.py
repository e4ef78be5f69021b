"""Every registered query with SQL must equal its DuckDB twin on the
smallest driver tables (the driver repeats this at sf0.01)."""

import pytest

from ampere.config import ModelType
from ampere.plans import REGISTRY
from oracle_compare import compare

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"

#: the trained slots need more complete rows than the smallest tables have
TRAINED = {f"model_{m.value}" for m in ModelType}
SQL_QUERIES = sorted(n for n, q in REGISTRY.items() if q.sql is not None and n not in TRAINED)


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_query_matches_sql(spark, duck_small, name):
    q = REGISTRY[name]
    r = compare(spark, name, q.run, q.oracle(), SF_SMALL, duck_small)
    assert r["status"] == "match", r


def test_entry_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["total_profit", "total_trades", "winning_trades", "win_rate"]
    assert df.count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["model_linear_regression", "model_elastic_net", "model_mlp", "model_lstm"])
def test_trained_slots_match_sql(spark, duck_check, name):
    r = compare(spark, name, REGISTRY[name].run, REGISTRY[name].oracle(), SF_CHECK, duck_check)
    assert r["status"] == "match" and r["rows"], r


def test_every_query_has_sql():
    assert [n for n, q in REGISTRY.items() if q.sql is None] == []
