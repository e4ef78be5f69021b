"""The checkpoint folder of a session that runs on a cluster, and the package
that its workers need."""

import os
import subprocess
import sys

import duckdb
import pytest

from ampere import session
from ampere.plans import REGISTRY
from oracle_compare import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture
def cluster(spark, monkeypatch):
    """The session as one of a standalone cluster sees itself."""
    session.ensure_checkpoint_dir(spark)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere:7077")
    monkeypatch.setattr(session, "_SHARED", set())
    return spark


def test_a_mounted_folder_is_used_as_named(cluster):
    folder = cluster.sparkContext.getCheckpointDir()
    assert folder.startswith("file:")
    assert session.ensure_checkpoint_dir(cluster) == folder
    assert session._SHARED == {(cluster.sparkContext.applicationId, folder)}
    for name in ("bfill", "csv_roundtrip_clean", "axis_range"):
        assert REGISTRY[name].run(cluster, SF).count() > 0


def test_a_folder_that_the_driver_does_not_see_raises(cluster, monkeypatch):
    seen = session._part_files
    monkeypatch.setattr(session, "_part_files", lambda spark, path: seen(spark, path) - 1)
    with pytest.raises(RuntimeError, match="all machines share"):
        session.ensure_checkpoint_dir(cluster)


def test_without_the_setting_the_warehouse_has_the_folder(cluster):
    warehouse = cluster.conf.get("spark.sql.warehouse.dir").rstrip("/")
    assert session._unnamed_folder(cluster) == f"{warehouse}/ampere-checkpoints"


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    """Events of 200 hours, some without every type, with repeated stamps;
    orders and lineitem rows."""
    folder, con = tmp_path_factory.mktemp("made"), duckdb.connect()
    tables = {
        "events": """SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * (i // 2 * 601 % 720000) AS ts, i % 40 AS user_id,
            ['click', 'purchase', 'view', 'error', 'signup'][1 + (i * 7 + i // 11) % 5] AS event_type,
            (i * 7919 % 20011) / 100.0::DOUBLE AS value, '{}' AS props FROM range(2400) t(i)""",
        "orders": """SELECT i AS o_orderkey, i % 30 AS o_custkey, ['F', 'O', 'P'][1 + i % 3] AS o_orderstatus, (i * 7919 % 200003) / 100.0::DOUBLE AS o_totalprice,
            TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * (i * 31 % 900) AS o_orderdate, '5-LOW' AS o_orderpriority FROM range(300) t(i)""",
        "lineitem": """SELECT i // 4 AS l_orderkey, i % 50 AS l_partkey, i % 10 AS l_suppkey, (1 + i % 4)::INT AS l_linenumber, (1 + i * 13 % 50)::DOUBLE AS l_quantity,
            (i * 7919 % 200003) / 100.0::DOUBLE AS l_extendedprice, (i % 11) / 100.0::DOUBLE AS l_discount, (i % 9) / 100.0::DOUBLE AS l_tax,
            ['A', 'N', 'R'][1 + i % 3] AS l_returnflag, ['F', 'O'][1 + i % 2] AS l_linestatus,
            TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * (i * 31 % 900) AS l_shipdate FROM range(1200) t(i)""",
    }
    for name, rows in tables.items():
        con.execute(f"COPY ({rows}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS FROM '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", [
    "backtest_cumulative",
    "backtest_ratio_proxy",
    "best_model",
    "best_strategy",
    "bfill",
    "bfill_by_status",
    "bfill_events",
    "clean_outliers",
    "boosting_round",
    "csv_clean_imputed",
    "csv_clean_report",
    "csv_directory_summary",
    "csv_export_roundtrip",
    "csv_forecast_clean",
    "csv_roundtrip_clean",
    "csv_system_clean",
    "csv_skip_rows",
    "csv_units_row",
    "cv_fold_sizes",
    "cv_scores",
    "feature_set",
    "ffill",
])
def test_queries_are_whole_on_a_mounted_folder(cluster, made, name):
    folder, con = made
    q = REGISTRY[name]
    r = compare(cluster, name, q.run, q.oracle(), folder, con)
    assert r["status"] == "match" and r["rows"], r


AWAY = """import sys
sys.path[:0] = sys.argv[1:3]
import duckdb
from ampere.plans import REGISTRY
from ampere.session import local_session
from oracle_compare import compare
folder, name = sys.argv[3:]
con = duckdb.connect()
for t in ("events", "orders", "lineitem"):
    con.execute(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
r = compare(local_session(2), name, REGISTRY[name].run, REGISTRY[name].oracle(), folder, con)
assert r["status"] == "match" and r["rows"], r
"""


@pytest.mark.parametrize("name", [
    "boosting_round",
    "cv_scores",
])
def test_workers_that_do_not_find_the_repository(made, tmp_path, name):
    tests = os.path.dirname(os.path.abspath(__file__))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"AMPERE_DRIVER_MEMORY": "2g"}
    run = subprocess.run([sys.executable, "-c", AWAY, os.path.dirname(tests), tests, made[0], name], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
