"""Threshold spread-trading rule and its backtest.

Signals and profits are column expressions; totals are one aggregation;
the running profit is an ordered-series running sum.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TradingConfig
from ..functions.scalar import py_float_text
from .series import RunningSum, Series, apply_series

# Action names and reason texts of the naive strategy.
BUY_FIRST = "buy_first_sell_second"
SELL_FIRST = "sell_first_buy_second"
HOLD = "hold"
REASON_UP = ("Price expected to increase by ", " GBP/MWh")
REASON_DOWN = ("Price expected to decrease by ", " GBP/MWh")
REASON_HOLD = ("Price difference (", ") below threshold (", ")")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _two_dp(x: Column) -> Column:
    """Two-decimal text rounded on the exact binary value, half to even --
    the same digits as Python's ``f"{x:.2f}"``."""
    return F.call_function("format_number", x, F.lit("0.00"))


def signal_columns(forecast_first, forecast_second, cfg: TradingConfig = TradingConfig()) -> dict[str, Column]:
    """B1: the naive signal for each row; a null forecast gives a null signal."""
    ff, fs = _c(forecast_first), _c(forecast_second)
    t, v = F.lit(float(cfg.price_diff_threshold)), F.lit(float(cfg.max_volume_per_trade))
    cost = F.lit(float(cfg.transaction_cost) * 2 * float(cfg.max_volume_per_trade))
    d = fs - ff
    up, down = d > t, d < -t
    known = d.isNotNull()
    ratio = F.try_divide(F.abs(d), t)
    action = F.when(up, F.lit(BUY_FIRST)).when(down, F.lit(SELL_FIRST)).when(known, F.lit(HOLD))
    trade = up | down
    return {
        "action": action,
        "confidence": F.when(trade, F.least(ratio, F.lit(1.0))).when(known, F.lit(1.0) - ratio),
        "volume": F.when(trade, v).when(known, F.lit(0.0)),
        "price": F.when(trade, ff.cast("double")).when(known, F.lit(0.0)),
        "expected_profit": F.when(trade, F.abs(d) * v - cost).when(known, F.lit(0.0)),
        "reason": F.when(up, F.concat(F.lit(REASON_UP[0]), _two_dp(d), F.lit(REASON_UP[1])))
        .when(down, F.concat(F.lit(REASON_DOWN[0]), _two_dp(-d), F.lit(REASON_DOWN[1])))
        .when(known, F.concat(F.lit(REASON_HOLD[0]), _two_dp(d), F.lit(REASON_HOLD[1]),
                              F.lit(py_float_text(cfg.price_diff_threshold)), F.lit(REASON_HOLD[2]))),
    }


def with_signals(df: DataFrame, forecast_first: str, forecast_second: str,
                 cfg: TradingConfig = TradingConfig()) -> DataFrame:
    return df.withColumns(signal_columns(forecast_first, forecast_second, cfg))


def realised_profit(action, actual_first, actual_second, cfg: TradingConfig = TradingConfig(),
                    volume: Column | None = None) -> Column:
    """Profit of an action at the actual prices; hold earns 0."""
    a, a1, a2 = _c(action), _c(actual_first), _c(actual_second)
    v = F.lit(float(cfg.max_volume_per_trade)) if volume is None else volume
    cost = F.lit(float(cfg.transaction_cost) * 2) * v
    return (F.when(a == HOLD, F.lit(0.0))
            .when(a == BUY_FIRST, (a2 - a1) * v - cost)
            .when(a == SELL_FIRST, (a1 - a2) * v - cost))


def backtest_rows(df: DataFrame, forecast_first: str, forecast_second: str,
                  actual_first: str, actual_second: str,
                  cfg: TradingConfig = TradingConfig(), keep: Sequence[str] = ()) -> DataFrame:
    """B3 per row: signal on forecasts, profit on actuals. Rows where any of
    the four inputs is null are dropped pairwise (the reference compacts the
    series independently, which misaligns them; see README)."""
    inputs = [forecast_first, forecast_second, actual_first, actual_second]
    cond = None
    for c in dict.fromkeys(inputs):
        e = F.col(c).isNotNull()
        cond = e if cond is None else cond & e
    sig = signal_columns(forecast_first, forecast_second, cfg)
    return df.where(cond).select(
        *keep,
        sig["action"].alias("action"),
        realised_profit(sig["action"], actual_first, actual_second, cfg).alias("profit"),
    )


def backtest_totals(rows: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """B3 totals: win rate in percent over max(1, trades)."""
    trades = F.count_if(F.col("action") != HOLD)
    wins = F.count_if(F.col("profit") > 0)
    return rows.groupBy(*group_by).agg(
        F.coalesce(F.sum("profit"), F.lit(0.0)).alias("total_profit"),
        trades.alias("total_trades"),
        wins.alias("winning_trades"),
        (wins.cast("double") / F.greatest(trades, F.lit(1)).cast("double") * 100.0).alias("win_rate"),
    )


def calculate_profit(signals: DataFrame, actual_first: str, actual_second: str,
                     cfg: TradingConfig = TradingConfig(), group_by: Sequence[str] = ()) -> DataFrame:
    """B2: profit of existing signals (each with its own ``volume``);
    win rate as a 0-1 fraction, average per trade 0 when no trades."""
    p = realised_profit("action", actual_first, actual_second, cfg, volume=F.col("volume"))
    trade = (F.col("action") != HOLD)
    x = signals.select(*group_by, F.when(trade, p).alias("p"), trade.alias("t"))
    trades = F.count_if(F.col("t"))
    wins = F.count_if(F.col("p") > 0)
    total = F.coalesce(F.sum("p"), F.lit(0.0))
    return x.groupBy(*group_by).agg(
        total.alias("total_profit"),
        trades.alias("total_trades"),
        wins.alias("winning_trades"),
        F.when(trades > 0, wins.cast("double") / trades.cast("double")).otherwise(F.lit(0.0)).alias("win_rate"),
        F.when(trades > 0, total / trades.cast("double")).otherwise(F.lit(0.0)).alias("average_profit_per_trade"),
    )


def cumulative_profit(rows: DataFrame, s: Series, name: str = "cumulative_profit") -> DataFrame:
    """Running profit in series order (per key when the series is keyed)."""
    return apply_series(rows, s, [RunningSum("profit", name)])


def oracle_backtest(df: DataFrame, first: str, second: str, cfg: TradingConfig = TradingConfig(),
                    keep: Sequence[str] = ()) -> DataFrame:
    """Perfect foresight -- forecasts are the actual prices."""
    return backtest_rows(df, first, second, first, second, cfg, keep)


def ratio_proxy_backtest(df: DataFrame, predicted: str, actual: str, first_ratio: float = 0.95,
                         cfg: TradingConfig = TradingConfig(), keep: Sequence[str] = ()) -> DataFrame:
    """Model mode -- the second price is forecast by a model and the first
    price is taken as ``first_ratio`` times the second, for forecast and
    actual alike."""
    x = df.withColumns({
        "__ff": F.col(predicted) * F.lit(first_ratio), "__fs": F.col(predicted),
        "__af": F.col(actual) * F.lit(first_ratio), "__as": F.col(actual),
    })
    return backtest_rows(x, "__ff", "__fs", "__af", "__as", cfg, keep)


def model_backtest(df: DataFrame, predicted: str, actual: str, first: str | None = None, first_ratio: float = 0.95,
                   cfg: TradingConfig = TradingConfig(), keep: Sequence[str] = ()) -> DataFrame:
    """A model's forecast of the second price. ``first``: the column of
    the real first price, known when the trade is placed; without it the
    first price is ``first_ratio`` times the second (the reference's proxy)."""
    if first is None:
        return ratio_proxy_backtest(df, predicted, actual, first_ratio, cfg, keep)
    return backtest_rows(df, first, predicted, first, actual, cfg, keep)


def compare_strategies(labelled_rows: DataFrame) -> DataFrame:
    """One row per strategy label with totals and average profit per
    trade over max(1, trades)."""
    t = backtest_totals(labelled_rows, ["label"])
    return t.withColumn("avg_profit_per_trade",
                        F.col("total_profit") / F.greatest(F.col("total_trades"), F.lit(1)).cast("double"))


def best_strategy(comparison: DataFrame) -> DataFrame:
    """The label with the largest total profit (ties: smallest label);
    a top-1, planned as TakeOrderedAndProject."""
    return (comparison.orderBy(F.col("total_profit").desc(), F.col("label").asc())
            .limit(1).select(F.col("label").alias("best_label"), "total_profit"))


def spread_summary(df: DataFrame, first: str, second: str, threshold: float = 10.0) -> DataFrame:
    """Counts of spreads above +t, below -t and inside the band."""
    d = F.col(second) - F.col(first)
    x = df.where(d.isNotNull())
    return x.agg(
        F.count_if(d > threshold).alias("above"),
        F.count_if(d < -threshold).alias("below"),
        F.count_if((d >= -threshold) & (d <= threshold)).alias("inside"),
        F.count(F.lit(1)).alias("n"),
    )


def run_backtest(df: DataFrame, forecast_first: str, forecast_second: str, actual_first: str,
                 actual_second: str, s: Series, cfg: TradingConfig = TradingConfig(),
                 label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """B3 end to end: per-row actions, profits and running profit in series
    order, plus the one-row totals (win rate in percent)."""
    keep = [*s.keys, *s.order_by]
    rows = backtest_rows(df, forecast_first, forecast_second, actual_first, actual_second, cfg, keep)
    if label is not None:
        rows = rows.withColumn("label", F.lit(label))
    return cumulative_profit(rows, s), backtest_totals(rows, ["label"] if label is not None else [])
