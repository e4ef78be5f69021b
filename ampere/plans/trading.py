"""Backtest queries (B1-B8, W13, T7) on the hourly market view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import TradingConfig
from ..operators import stats, trade
from ..operators.series import Lag, apply_series
from .common import MARKET_SERIES, P1, P2, QD, D, mv, sql_with_mv
from .registry import register

CFG = TradingConfig()
T = CFG.price_diff_threshold


def _action_sql(ff: str, fs: str) -> str:
    d = f"({fs} - {ff})"
    return (f"CASE WHEN {d} > {T} THEN 'buy_first_sell_second' WHEN {d} < -{T} THEN 'sell_first_buy_second' "
            f"ELSE 'hold' END")


def _profit_sql(ff: str, fs: str, af: str, as_: str) -> str:
    d = f"({fs} - {ff})"
    v, cost = CFG.max_volume_per_trade, CFG.transaction_cost * 2 * CFG.max_volume_per_trade
    return (f"CASE WHEN {d} > {T} THEN ({as_} - {af}) * {v} - {cost} "
            f"WHEN {d} < -{T} THEN ({af} - {as_}) * {v} - {cost} ELSE 0.0 END")


def rows_sql(src: str, ff: str, fs: str, af: str, as_: str, keep: str) -> str:
    cond = " AND ".join(f"{c} IS NOT NULL" for c in dict.fromkeys([ff, fs, af, as_]))
    return (f"SELECT {keep}, {_action_sql(ff, fs)} AS action, {_profit_sql(ff, fs, af, as_)} AS profit "
            f"FROM {src} WHERE {cond}")


def totals_sql(rows: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    return (f"SELECT {g}COALESCE(SUM(profit), 0.0) AS total_profit, "
            f"COUNT(CASE WHEN action <> 'hold' THEN 1 END) AS total_trades, "
            f"COUNT(CASE WHEN profit > 0 THEN 1 END) AS winning_trades, "
            f"CAST(COUNT(CASE WHEN profit > 0 THEN 1 END) AS DOUBLE) / "
            f"CAST(GREATEST(COUNT(CASE WHEN action <> 'hold' THEN 1 END), 1) AS DOUBLE) * 100.0 AS win_rate "
            f"FROM ({rows}) AS r{tail}")


ORACLE_ROWS = rows_sql("mv", P1, P2, P1, P2, QD)


def oracle_rows(spark, sf):
    return trade.oracle_backtest(mv(spark, sf), P1, P2, CFG, keep=[D])


@register("backtest_oracle_totals", sql_with_mv(totals_sql(ORACLE_ROWS)), rounded=["total_profit", "win_rate"])
def backtest_oracle_totals(spark, sf):
    return trade.backtest_totals(oracle_rows(spark, sf))


def _fmt_sql(x: str) -> str:
    return f"printf('%.2f', {x})"


SIGNAL_SQL = sql_with_mv(f"""
  SELECT {QD}, action, confidence, volume, price, expected_profit, reason FROM (
    SELECT {QD}, ({P2} - {P1}) AS d, {P1} AS p1,
      {_action_sql(P1, P2)} AS action
    FROM mv WHERE {P1} IS NOT NULL AND {P2} IS NOT NULL) s,
  LATERAL (SELECT
      CASE WHEN action <> 'hold' THEN LEAST(abs(d) / {T}, 1.0) ELSE 1.0 - abs(d) / {T} END AS confidence,
      CASE WHEN action <> 'hold' THEN CAST({CFG.max_volume_per_trade} AS DOUBLE) ELSE 0.0 END AS volume,
      CASE WHEN action <> 'hold' THEN p1 ELSE 0.0 END AS price,
      CASE WHEN action <> 'hold' THEN abs(d) * {CFG.max_volume_per_trade} - {CFG.transaction_cost * 2 * CFG.max_volume_per_trade} ELSE 0.0 END AS expected_profit,
      CASE WHEN action = 'buy_first_sell_second' THEN 'Price expected to increase by ' || {_fmt_sql('d')} || ' GBP/MWh'
           WHEN action = 'sell_first_buy_second' THEN 'Price expected to decrease by ' || {_fmt_sql('-d')} || ' GBP/MWh'
           ELSE 'Price difference (' || {_fmt_sql('d')} || ') below threshold ({T})' END AS reason) x""")


@register("backtest_signals", SIGNAL_SQL, rounded=["confidence", "volume", "price", "expected_profit"])
def backtest_signals(spark, sf):
    """B1: every signal field for each hour with both prices."""
    m = mv(spark, sf).where(F.col(P1).isNotNull() & F.col(P2).isNotNull())
    sig = trade.signal_columns(P1, P2, CFG)
    return m.select(F.col(f"`{D}`"), *[v.alias(k) for k, v in sig.items()])


@register("backtest_rows", sql_with_mv(ORACLE_ROWS), rounded=["profit"])
def backtest_rows(spark, sf):
    """B3/B4 per row: action and realised profit."""
    return oracle_rows(spark, sf)


@register("backtest_cumulative",
          sql_with_mv(f"SELECT {QD}, profit, SUM(profit) OVER (ORDER BY {QD} ROWS BETWEEN UNBOUNDED PRECEDING "
                      f"AND CURRENT ROW) AS cumulative_profit FROM ({ORACLE_ROWS}) r"),
          rounded=["profit", "cumulative_profit"])
def backtest_cumulative(spark, sf):
    """Running profit over the global (blocked) series."""
    rows = oracle_rows(spark, sf)
    return trade.cumulative_profit(rows, MARKET_SERIES).select(f"`{D}`", "profit", "cumulative_profit")


@register("profit_fractional_winrate", sql_with_mv(f"""
  SELECT COALESCE(SUM(p), 0.0) AS total_profit, COUNT(CASE WHEN t THEN 1 END) AS total_trades,
         COUNT(CASE WHEN p > 0 THEN 1 END) AS winning_trades,
         CASE WHEN COUNT(CASE WHEN t THEN 1 END) > 0 THEN CAST(COUNT(CASE WHEN p > 0 THEN 1 END) AS DOUBLE)
              / COUNT(CASE WHEN t THEN 1 END) ELSE 0.0 END AS win_rate,
         CASE WHEN COUNT(CASE WHEN t THEN 1 END) > 0 THEN COALESCE(SUM(p), 0.0) / COUNT(CASE WHEN t THEN 1 END)
              ELSE 0.0 END AS average_profit_per_trade
  FROM (SELECT action <> 'hold' AS t, CASE WHEN action <> 'hold' THEN profit END AS p FROM ({ORACLE_ROWS}) r) z"""),
          rounded=["total_profit", "win_rate", "average_profit_per_trade"])
def profit_fractional_winrate(spark, sf):
    """B2: profit of the oracle signals, win rate as a fraction."""
    m = mv(spark, sf).where(F.col(P1).isNotNull() & F.col(P2).isNotNull())
    sig = trade.with_signals(m, P1, P2, CFG)
    return trade.calculate_profit(sig, P1, P2, CFG)


PERSIST_CTE = (f"pf AS (SELECT {QD}, {P2}, LAG({P2}, 1) OVER (ORDER BY {QD}) AS pred FROM mv)")
PROXY_ROWS = rows_sql("(SELECT *, pred * 0.95 AS ff, {p2} * 0.95 AS af FROM pf) x".format(p2=P2),
                      "ff", "pred", "af", P2, QD)


def persistence(spark, sf):
    m = mv(spark, sf)
    return apply_series(m, MARKET_SERIES, [Lag(P2, 1, "pred")])


@register("backtest_ratio_proxy", sql_with_mv(totals_sql(PROXY_ROWS), PERSIST_CTE),
          rounded=["total_profit", "win_rate"])
def backtest_ratio_proxy(spark, sf):
    """Model mode with a lag-1 persistence forecast of the second price."""
    rows = trade.ratio_proxy_backtest(persistence(spark, sf), "pred", P2, 0.95, CFG, keep=[D])
    return trade.backtest_totals(rows)


def _labelled(spark, sf):
    o = oracle_rows(spark, sf).withColumn("label", F.lit("Oracle (Perfect)"))
    p = trade.ratio_proxy_backtest(persistence(spark, sf), "pred", P2, 0.95, CFG, keep=[D]) \
        .withColumn("label", F.lit("persistence"))
    return o.unionByName(p)


LABELLED_SQL = (f"SELECT 'Oracle (Perfect)' AS label, action, profit FROM ({ORACLE_ROWS}) a UNION ALL "
                f"SELECT 'persistence' AS label, action, profit FROM ({PROXY_ROWS}) b")
COMPARE_SQL = (f"SELECT *, total_profit / CAST(GREATEST(total_trades, 1) AS DOUBLE) AS avg_profit_per_trade "
               f"FROM ({totals_sql(LABELLED_SQL, 'label')}) t")


@register("strategy_compare", sql_with_mv(COMPARE_SQL, PERSIST_CTE),
          rounded=["total_profit", "win_rate", "avg_profit_per_trade"])
def strategy_compare(spark, sf):
    """Oracle and persistence strategies side by side."""
    return trade.compare_strategies(_labelled(spark, sf))


@register("best_strategy",
          sql_with_mv(f"SELECT label AS best_label, total_profit FROM ({COMPARE_SQL}) c "
                      f"ORDER BY total_profit DESC, label LIMIT 1", PERSIST_CTE),
          rounded=["total_profit"])
def best_strategy(spark, sf):
    """Strategy with the largest total profit."""
    return trade.best_strategy(trade.compare_strategies(_labelled(spark, sf)))


SPREAD_SQL = sql_with_mv(f"""
  SELECT bin, lo + (bin - 1) * w AS lower, lo + bin * w AS upper, count FROM (
    SELECT CAST(LEAST(FLOOR((d - lo) / (hi - lo) * 50) + 1, 50) AS BIGINT) AS bin, lo, (hi - lo) / 50 AS w,
           COUNT(*) AS count
    FROM (SELECT {P2} - {P1} AS d FROM mv WHERE {P2} - {P1} IS NOT NULL) s,
         (SELECT MIN({P2} - {P1}) AS lo, MAX({P2} - {P1}) AS hi FROM mv) r
    GROUP BY 1, 2, 3) b""")


@register("spread_histogram", SPREAD_SQL, rounded=["lower", "upper"])
def spread_histogram(spark, sf):
    """50-bin histogram of second - first price."""
    return stats.histogram(mv(spark, sf), "spread", 50, expr=F.col(P2) - F.col(P1))


@register("spread_summary", sql_with_mv(f"""
  SELECT COUNT(CASE WHEN d > {T} THEN 1 END) AS above, COUNT(CASE WHEN d < -{T} THEN 1 END) AS below,
         COUNT(CASE WHEN d >= -{T} AND d <= {T} THEN 1 END) AS inside, COUNT(*) AS n
  FROM (SELECT {P2} - {P1} AS d FROM mv) s WHERE d IS NOT NULL"""))
def spread_summary(spark, sf):
    """Spreads beyond the +/- threshold lines."""
    return trade.spread_summary(mv(spark, sf), P1, P2, T)


@register("profit_box", sql_with_mv(f"""
  SELECT label, MIN(profit) AS min, MAX(profit) AS max, COUNT(profit) AS n,
         quantile_cont(profit, 0.25) AS q1, quantile_cont(profit, 0.5) AS median, quantile_cont(profit, 0.75) AS q3
  FROM ({LABELLED_SQL}) l WHERE profit <> 0 GROUP BY label""", PERSIST_CTE),
          rounded=["min", "max", "q1", "median", "q3"])
def profit_box(spark, sf):
    """Quartiles of the non-zero profits per strategy."""
    nz = _labelled(spark, sf).where(F.col("profit") != 0)
    return stats.box_summary(nz, "profit", ["label"]).select("label", "min", "max", "n", "q1", "median", "q3")
