"""Feature queries (E1-E5, W1-W7, F6-F14) on events, lineitem and the
market view."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import features as fe
from ..operators.series import Lag, Rolling, apply_series
from ..sources.driver_tables import LINEITEM_ORDER, table
from .common import (EVENT_SERIES, LINEITEM_SERIES, MARKET_COLUMNS, MARKET_SERIES, QD, D, F1, P1, P2, SH, SL, V1,
                     V2, mv, sql_with_mv)
from .registry import register

LAGS = C.DEFAULT_LAGS
WINDOWS = C.DEFAULT_ROLLING_WINDOWS
STATS = ("mean", "std", "min", "max")
SQL_STAT = {"mean": "AVG", "std": "STDDEV_SAMP", "min": "MIN", "max": "MAX"}


def over(order: str, part: str | None = None, frame: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"OVER ({p}ORDER BY {order} {frame})"


def order_sql(cols) -> str:
    return ", ".join(f"{c} NULLS FIRST" for c in cols)


def lag_sql(col: str, n: int, order: str, part: str | None = None) -> str:
    return f"LAG({col}, {n}) {over(order, part)}"


def roll_sql(col: str, n: int, stat: str, order: str, part: str | None = None, need: int | None = None) -> str:
    o = over(order, part, f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW")
    return f"CASE WHEN COUNT({col}) {o} >= {need or n} THEN {SQL_STAT[stat]}({col}) {o} END"


def rolling_names(col: str) -> list[str]:
    return [f"{col}_rolling_{st}_{n}" for n in WINDOWS for st in STATS]


def rolling_sql_cols(col: str, order: str, part: str | None = None) -> str:
    return ", ".join(f"{roll_sql(col, n, st, order, part)} AS {col}_rolling_{st}_{n}" for n in WINDOWS for st in STATS)


def lag_sql_cols(col: str, order: str, part: str | None = None) -> str:
    return ", ".join(f"{lag_sql(col, n, order, part)} AS {col}_lag_{n}" for n in LAGS)


# ----------------------------------------------------------------- time


def time_sql(ts: str) -> str:
    h = f"hour({ts})"
    m = f"month({ts})"
    return (f"CAST({h} AS INTEGER) AS hour, CAST(isodow({ts}) AS INTEGER) AS day_of_week, "
            f"CAST({m} AS INTEGER) AS month, CAST(day({ts}) AS INTEGER) AS day_of_month, "
            f"CAST(dayofyear({ts}) AS INTEGER) AS day_of_year, CAST(weekofyear({ts}) AS INTEGER) AS week_of_year, "
            f"sin(2 * pi() * {h} / 24) AS hour_sin, cos(2 * pi() * {h} / 24) AS hour_cos, "
            f"sin(2 * pi() * {m} / 12) AS month_sin, cos(2 * pi() * {m} / 12) AS month_cos, "
            f"CAST(isodow({ts}) >= 5 AS TINYINT) AS is_weekend")


TRIG = ["hour_sin", "hour_cos", "month_sin", "month_cos"]


@register("time_features", f"SELECT event_id, ts, {time_sql('ts')} FROM events", rounded=TRIG)
def time_features(spark, sf):
    """E1 / F6-F13 on every event timestamp."""
    ev = table(spark, sf, "events").select("event_id", "ts")
    return fe.add_time_features(ev, "ts")


# ------------------------------------------------------------ lags, rolling

EV_ORDER = order_sql(["ts", "event_id"])


@register("lag_features",
          f"SELECT event_id, ts, value, {lag_sql_cols('value', EV_ORDER)} FROM events")
def lag_features(spark, sf):
    """W1 on one global series (blocked: no single-partition window)."""
    ev = table(spark, sf, "events").select("event_id", "ts", "value")
    return apply_series(ev, EVENT_SERIES, [Lag("value", n, f"value_lag_{n}") for n in LAGS])


@register("rolling_features",
          f"SELECT event_id, ts, value, {rolling_sql_cols('value', EV_ORDER)} FROM events",
          rounded=rolling_names("value"))
def rolling_features(spark, sf):
    """W2-W5 on one global series (blocked)."""
    ev = table(spark, sf, "events").select("event_id", "ts", "value")
    ops = [Rolling("value", n, st, f"value_rolling_{st}_{n}") for n in WINDOWS for st in STATS]
    return apply_series(ev, EVENT_SERIES, ops)


LI_COLS = ["l_suppkey", *LINEITEM_ORDER]
LI_ORDER = order_sql(LINEITEM_ORDER)
LI_SELECT = ", ".join(LI_COLS)


def _lineitem(spark, sf):
    return table(spark, sf, "lineitem").select(*LI_COLS)


@register("lag_features_keyed",
          f"SELECT {LI_SELECT}, {lag_sql_cols('l_extendedprice', LI_ORDER, 'l_suppkey')} FROM lineitem")
def lag_features_keyed(spark, sf):
    """W1 per supplier (keyed window; largest key measured first)."""
    ops = [Lag("l_extendedprice", n, f"l_extendedprice_lag_{n}") for n in LAGS]
    return apply_series(_lineitem(spark, sf), LINEITEM_SERIES, ops)


KEYED_ROLLING_SQL = f"SELECT {LI_SELECT}, {rolling_sql_cols('l_extendedprice', LI_ORDER, 'l_suppkey')} FROM lineitem"


def _keyed_rolling(spark, sf, series):
    ops = [Rolling("l_extendedprice", n, st, f"l_extendedprice_rolling_{st}_{n}") for n in WINDOWS for st in STATS]
    return apply_series(_lineitem(spark, sf), series, ops)


# prices here reach 1e5, so 4 decimals keep ~9 significant digits
@register("rolling_features_keyed", KEYED_ROLLING_SQL, rounded=rolling_names("l_extendedprice"), digits=4)
def rolling_features_keyed(spark, sf):
    """W2-W5 per supplier."""
    return _keyed_rolling(spark, sf, LINEITEM_SERIES)


@register("rolling_features_keyed_blocked", KEYED_ROLLING_SQL, rounded=rolling_names("l_extendedprice"), digits=4)
def rolling_features_keyed_blocked(spark, sf):
    """W2-W5 per supplier on the hot-key-safe shape (equal blocks across keys)."""
    return _keyed_rolling(spark, sf, LINEITEM_SERIES.with_(strategy="blocked"))


LONG_KEYED_SQL = (f"SELECT l_suppkey, {', '.join(LINEITEM_ORDER)}, "
                  + ", ".join(f"{roll_sql('l_extendedprice', n, st, order_sql(LINEITEM_ORDER), 'l_suppkey', need)} AS {st}_{n}"
                              for n, need in ((100, 100), (250, 1)) for st in STATS) + " FROM lineitem")


@register("rolling_long_keyed", LONG_KEYED_SQL, rounded=[f"{st}_{n}" for n in (100, 250) for st in STATS], digits=3)
def rolling_long_keyed(spark, sf):
    """W2-W5 over long frames per supplier, in linear time."""
    li = table(spark, sf, "lineitem").select("l_suppkey", *LINEITEM_ORDER)
    ops = [Rolling("l_extendedprice", n, st, f"{st}_{n}", need) for n, need in ((100, 100), (250, 1)) for st in STATS]
    return apply_series(li, LINEITEM_SERIES, ops)


@register("rolling_long_events", f"""SELECT event_id, {', '.join(
    f"{roll_sql('v', 1000, st, 'ts NULLS FIRST, event_id NULLS FIRST', None, 100)} AS {st}_1000" for st in STATS)}
  FROM (SELECT *, CASE WHEN event_type = 'click' THEN value END AS v FROM events) e""", rounded=[f"{st}_1000" for st in STATS], digits=4)
def rolling_long_events(spark, sf):
    """W2-W5 over frames of 1,000 rows, most of them null, of one series in blocks."""
    ev = table(spark, sf, "events").select("event_id", "ts", F.when(F.col("event_type") == "click", F.col("value")).alias("v"))
    x = apply_series(ev, EVENT_SERIES.with_(block_rows=3000), [Rolling("v", 1000, st, f"{st}_1000", 100) for st in STATS])
    return x.select("event_id", *[f"{st}_1000" for st in STATS])


# ------------------------------------------------------------ market view

MV_ORDER = order_sql([QD])


@register("price_volatility",
          sql_with_mv(f"SELECT {QD}, {P1}, {roll_sql(P1, 24, 'std', MV_ORDER)} AS price_volatility_24h FROM mv"),
          rounded=["price_volatility_24h"])
def price_volatility(spark, sf):
    """24-row rolling std of the first price."""
    m = mv(spark, sf).select(F.col(f"`{D}`"), P1)
    return apply_series(m, MARKET_SERIES, [Rolling(P1, 24, "std", "price_volatility_24h")])


PRICE_SQL = (f"{P2} - {P1} AS price_diff, ({P2} - {P1}) / NULLIF({P1}, 0) * 100 AS price_diff_pct, "
             f"{P1} - {F1} AS forecast_error_first, abs({P1} - {F1}) / NULLIF({P1}, 0) * 100 AS forecast_error_pct, "
             f"{roll_sql(P1, 24, 'std', MV_ORDER)} AS price_volatility_24h")
PRICE_COLS = ["price_diff", "price_diff_pct", "forecast_error_first", "forecast_error_pct", "price_volatility_24h"]
VOLUME_SQL = (f"{V1} + {V2} AS total_volume, {V2} / NULLIF({V1}, 0) AS volume_ratio, "
              f"{roll_sql(V1, 24, 'mean', MV_ORDER)} AS volume_rolling_mean_24h")
VOLUME_COLS = ["total_volume", "volume_ratio", "volume_rolling_mean_24h"]
SYSTEM_SQL = f"({SL} + {SH}) / 2 AS forecast_system_avg, {SH} - {SL} AS system_price_spread"
SYSTEM_COLS = ["forecast_system_avg", "system_price_spread"]


@register("price_features", sql_with_mv(f"SELECT {QD}, {P1}, {P2}, {F1}, {PRICE_SQL} FROM mv"), rounded=PRICE_COLS)
def price_features(spark, sf):
    """Differences, percentages (null for a zero first price), volatility."""
    m = mv(spark, sf).select(F.col(f"`{D}`"), P1, P2, F1)
    return fe.add_price_features(m, MARKET_SERIES)


@register("volume_features", sql_with_mv(f"SELECT {QD}, {V1}, {V2}, {VOLUME_SQL} FROM mv"), rounded=VOLUME_COLS)
def volume_features(spark, sf):
    """Total, ratio (null for zero first volume), 24-row mean."""
    m = mv(spark, sf).select(F.col(f"`{D}`"), V1, V2)
    return fe.add_volume_features(m, MARKET_SERIES)


@register("system_features", sql_with_mv(f"SELECT {QD}, {SL}, {SH}, {SYSTEM_SQL} FROM mv"), rounded=SYSTEM_COLS)
def system_features(spark, sf):
    """Mid and spread of the system price band."""
    m = mv(spark, sf).select(F.col(f"`{D}`"), SL, SH)
    return fe.add_system_price_features(m)


FEATURE_SET_SQL = sql_with_mv(
    f"SELECT {', '.join(QD if c == D else c for c in MARKET_COLUMNS)}, {time_sql(QD)}, {PRICE_SQL}, {VOLUME_SQL}, "
    f"{SYSTEM_SQL}, {lag_sql_cols(P1, MV_ORDER)}, {lag_sql_cols(P2, MV_ORDER)}, {rolling_sql_cols(P1, MV_ORDER)} "
    f"FROM mv")
FEATURE_SET_ROUNDED = TRIG + PRICE_COLS + VOLUME_COLS + SYSTEM_COLS + rolling_names(P1)


@register("feature_set", FEATURE_SET_SQL, rounded=FEATURE_SET_ROUNDED)
def feature_set(spark, sf):
    """E5: every feature of the reference's feature set in one plan."""
    return fe.create_feature_set(mv(spark, sf), MARKET_SERIES).features
