"""Keyed ordered-series queries with carries across blocks (W10-W13 per key).

``orders`` per ``o_orderstatus`` has three keys, each holding a third of
all rows -- the hot-key case -- so these queries run the blocked shape
(equal blocks across the keys, carries per key); the lineitem running sum
uses the default policy (plain keyed window once every supplier is
measured small enough), the sparse forward fill the blocked shape.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.series import Fill, RunningSum, Series, apply_series
from ..sources.driver_tables import LINEITEM_ORDER, table
from .common import LINEITEM_SERIES
from .features import order_sql
from .registry import register

STATUS_SERIES = Series(order_by=("o_orderdate", "o_orderkey"), keys=("o_orderstatus",), strategy="blocked")
ST_ORDER = order_sql(["o_orderdate", "o_orderkey"])


@register("running_total_by_status", f"""SELECT o_orderkey, o_orderstatus, o_orderdate, o_totalprice,
  SUM(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY {ST_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING
  AND CURRENT ROW) AS running_total FROM orders""", rounded=["running_total"], digits=2)
def running_total_by_status(spark, sf):
    """W13 per hot key: running order value per status."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    return apply_series(o, STATUS_SERIES, [RunningSum("o_totalprice", "running_total")])


URGENT = "CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END"


def _status_fill(method):
    def build(spark, sf):
        o = table(spark, sf, "orders").select(
            "o_orderkey", "o_orderstatus", "o_orderdate",
            F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")).alias("urgent_price"))
        return apply_series(o, STATUS_SERIES, [Fill("urgent_price", method, "urgent_price")])
    return build


def _status_fill_sql(method: str) -> str:
    upto = f"OVER (PARTITION BY o_orderstatus ORDER BY {ST_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    after = (f"OVER (PARTITION BY o_orderstatus ORDER BY {ST_ORDER} ROWS BETWEEN CURRENT ROW AND "
             f"UNBOUNDED FOLLOWING)")
    c = "urgent_price"
    if method == "ffill":
        e = f"COALESCE({c}, LAST_VALUE({c} IGNORE NULLS) {upto})"
    elif method == "bfill":
        e = f"COALESCE({c}, FIRST_VALUE({c} IGNORE NULLS) {after})"
    else:
        pi = f"LAST_VALUE(CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS) {upto}"
        pv = f"LAST_VALUE({c} IGNORE NULLS) {upto}"
        ni = f"FIRST_VALUE(CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS) {after}"
        nv = f"FIRST_VALUE({c} IGNORE NULLS) {after}"
        e = f"COALESCE({c}, {pv} + ({nv} - {pv}) * (i - {pi}) / ({ni} - {pi}))"
    return (f"SELECT o_orderkey, o_orderstatus, o_orderdate, {e} AS {c} FROM (SELECT o_orderkey, o_orderstatus, "
            f"o_orderdate, {URGENT} AS {c}, ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY {ST_ORDER}) - 1 "
            f"AS i FROM orders) x")


for _m in ("ffill", "bfill", "interpolate"):
    register(f"{_m}_by_status", _status_fill_sql(_m), rounded=["urgent_price"], digits=2)(_status_fill(_m))


LI_ORDER = order_sql(LINEITEM_ORDER)


@register("running_quantity_keyed", f"""SELECT l_suppkey, {', '.join(LINEITEM_ORDER)}, l_quantity,
  SUM(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY {LI_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  AS running_quantity FROM lineitem""", rounded=["running_quantity"], digits=2)
def running_quantity_keyed(spark, sf):
    """W13 per supplier."""
    li = table(spark, sf, "lineitem").select("l_suppkey", *LINEITEM_ORDER, "l_quantity")
    return apply_series(li, LINEITEM_SERIES, [RunningSum("l_quantity", "running_quantity")])


@register("ffill_returns_keyed", f"""SELECT l_suppkey, {', '.join(LINEITEM_ORDER)},
  COALESCE(r, LAST_VALUE(r IGNORE NULLS) OVER (PARTITION BY l_suppkey ORDER BY {LI_ORDER}
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS returned_price
  FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN l_extendedprice END AS r FROM lineitem) x""")
def ffill_returns_keyed(spark, sf):
    """W10 per supplier over a sparse column (returned items only)."""
    li = table(spark, sf, "lineitem").select(
        "l_suppkey", *LINEITEM_ORDER,
        F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).alias("returned_price"))
    return apply_series(li, LINEITEM_SERIES.with_(strategy="blocked"),
                        [Fill("returned_price", "ffill", "returned_price")])
