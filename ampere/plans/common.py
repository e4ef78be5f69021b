"""Shared inputs of the registered queries: the market view, the keyed
lineitem series and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .. import config as C
from ..operators.series import Series
from ..session import delete_on_exit, ensure_checkpoint_dir
from ..sources.driver_tables import LINEITEM_ORDER, market_view, market_view_sql, table

D = C.DATE_COLUMN
QD = f'"{D}"'
P1, P2, V1, V2, F1 = C.PRICE_FIRST, C.PRICE_SECOND, C.VOLUME_FIRST, C.VOLUME_SECOND, C.FORECAST_FIRST
SP, SL, SH = C.SYSTEM_PRICE, C.SYSTEM_LOW, C.SYSTEM_HIGH
MARKET_COLUMNS = (D, P1, P2, V1, V2, F1, SP, SL, SH)

# one global series: the hourly market view
MARKET_SERIES = Series(order_by=(D,), block_rows=1_000_000)
# one global series over raw events (tests cross blocks with smaller ones)
EVENT_SERIES = Series(order_by=("ts", "event_id"))
# keyed series: lineitem per supplier in ship order
LINEITEM_SERIES = Series(order_by=LINEITEM_ORDER, keys=("l_suppkey",))
LINEITEM_ORDER_SQL = ", ".join(LINEITEM_ORDER)


def mv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market_view(table(spark, sf_dir, "events"))


def mv_cte() -> str:
    return f"mv AS ({market_view_sql(D)})"


def sql_with_mv(body: str, *ctes: str) -> str:
    extra = "".join(f", {c}" for c in ctes)
    return f"WITH {mv_cte()}{extra} {body}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local
    on a cluster); removed when the application ends."""
    return delete_on_exit(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
