"""Adapters from the shared driver tables to the market data model.

*Market view*: the ``events`` table folded into one row per hour with the
auction / system-price columns of the data model. Prices are quoted in
pence, so hourly averages are exact integer sums divided once -- any SQL
engine computes the identical double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C

# Which event type plays which market quantity.
FIRST_AUCTION_EVENT = "click"
SECOND_AUCTION_EVENT = "purchase"
FORECAST_EVENT = "view"
SYSTEM_EVENT = "error"

LINEITEM_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pence_avg(cond: Column) -> Column:
    pence = F.when(cond, F.round(F.col("value") * 100).cast("long"))
    return F.try_divide(F.sum(pence).cast("double"), F.count(pence).cast("double") * F.lit(100.0))


def market_view(events: DataFrame, date_col: str = C.DATE_COLUMN) -> DataFrame:
    """One row per hour: first/second auction price and volume, first-auction
    forecast, system price with its low/high band (partial + final hash agg)."""
    et = F.col("event_type")
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias(date_col)
    return events.groupBy(hour).agg(
        _pence_avg(et == FIRST_AUCTION_EVENT).alias(C.PRICE_FIRST),
        _pence_avg(et == SECOND_AUCTION_EVENT).alias(C.PRICE_SECOND),
        F.count_if(et == FIRST_AUCTION_EVENT).cast("double").alias(C.VOLUME_FIRST),
        F.count_if(et == SECOND_AUCTION_EVENT).cast("double").alias(C.VOLUME_SECOND),
        _pence_avg(et == FORECAST_EVENT).alias(C.FORECAST_FIRST),
        _pence_avg(et == SYSTEM_EVENT).alias(C.SYSTEM_PRICE),
        F.min(F.when(et == SYSTEM_EVENT, F.col("value"))).alias(C.SYSTEM_LOW),
        F.max(F.when(et == SYSTEM_EVENT, F.col("value"))).alias(C.SYSTEM_HIGH),
    )


def market_view_sql(date_col: str = C.DATE_COLUMN) -> str:
    """The same view in ANSI SQL over a table named ``events`` (oracle side)."""

    def pence(t: str) -> str:
        return (f"CAST(SUM(CASE WHEN event_type = '{t}' THEN CAST(ROUND(value * 100) AS BIGINT) END) AS DOUBLE)"
                f" / (CAST(COUNT(CASE WHEN event_type = '{t}' THEN 1 END) AS DOUBLE) * 100.0)")

    return f"""
      SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS "{date_col}",
             {pence(FIRST_AUCTION_EVENT)} AS {C.PRICE_FIRST},
             {pence(SECOND_AUCTION_EVENT)} AS {C.PRICE_SECOND},
             CAST(COUNT(CASE WHEN event_type = '{FIRST_AUCTION_EVENT}' THEN 1 END) AS DOUBLE) AS {C.VOLUME_FIRST},
             CAST(COUNT(CASE WHEN event_type = '{SECOND_AUCTION_EVENT}' THEN 1 END) AS DOUBLE) AS {C.VOLUME_SECOND},
             {pence(FORECAST_EVENT)} AS {C.FORECAST_FIRST},
             {pence(SYSTEM_EVENT)} AS {C.SYSTEM_PRICE},
             MIN(CASE WHEN event_type = '{SYSTEM_EVENT}' THEN value END) AS {C.SYSTEM_LOW},
             MAX(CASE WHEN event_type = '{SYSTEM_EVENT}' THEN value END) AS {C.SYSTEM_HIGH}
      FROM events GROUP BY 1"""


def load_market_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market_view(table(spark, sf_dir, "events"))
