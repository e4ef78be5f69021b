"""The hourly market view and its trading signals over an event stream.

The reference only reads finite files; this is the same aggregation and
the same signal projection (``sources.driver_tables.market_view`` and
``operators.trade.signal_columns``) expressed for Structured Streaming, so
hours are finalised once the watermark passes them and state stays
bounded by the watermark delay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import TradingConfig
from ..operators.trade import signal_columns
from ..sources.driver_tables import (FIRST_AUCTION_EVENT, FORECAST_EVENT, SECOND_AUCTION_EVENT, SYSTEM_EVENT,
                                     _pence_avg)


def market_view_stream(events: DataFrame, watermark: str = "2 hours", date_col: str = C.DATE_COLUMN) -> DataFrame:
    """Streaming twin of ``market_view``: tumbling 1-hour event-time
    windows behind a watermark (append mode emits each hour once)."""
    et = F.col("event_type")
    ev = events.withColumn("__t", F.col("ts").cast("timestamp")).withWatermark("__t", watermark)
    agg = ev.groupBy(F.window("__t", "1 hour").alias("w")).agg(
        _pence_avg(et == FIRST_AUCTION_EVENT).alias(C.PRICE_FIRST),
        _pence_avg(et == SECOND_AUCTION_EVENT).alias(C.PRICE_SECOND),
        F.count_if(et == FIRST_AUCTION_EVENT).cast("double").alias(C.VOLUME_FIRST),
        F.count_if(et == SECOND_AUCTION_EVENT).cast("double").alias(C.VOLUME_SECOND),
        _pence_avg(et == FORECAST_EVENT).alias(C.FORECAST_FIRST),
        _pence_avg(et == SYSTEM_EVENT).alias(C.SYSTEM_PRICE),
        F.min(F.when(et == SYSTEM_EVENT, F.col("value"))).alias(C.SYSTEM_LOW),
        F.max(F.when(et == SYSTEM_EVENT, F.col("value"))).alias(C.SYSTEM_HIGH),
    )
    return agg.select(F.col("w.start").cast("timestamp_ntz").alias(date_col),
                      *[c for c in agg.columns if c != "w"])


def signal_stream(market: DataFrame, cfg: TradingConfig = TradingConfig(),
                  date_col: str = C.DATE_COLUMN) -> DataFrame:
    """B1 on every finalised hour with both prices (stateless projection)."""
    both = market.where(F.col(C.PRICE_FIRST).isNotNull() & F.col(C.PRICE_SECOND).isNotNull())
    sig = signal_columns(C.PRICE_FIRST, C.PRICE_SECOND, cfg)
    return both.select(F.col(f"`{date_col}`"), *[v.alias(k) for k, v in sig.items()])
