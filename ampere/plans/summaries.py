"""Chart-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import stats, trade
from ..operators.series import Series
from ..sources.driver_tables import table
from .cleaning import _missing_sql
from .common import MARKET_COLUMNS, QD, D, F1, P1, P2, mv, sql_with_mv
from .modelling import PAIRS_SQL, _forecasts
from .registry import register
from .trading import CFG, ORACLE_ROWS, PERSIST_CTE, PROXY_ROWS, _labelled

NUMERIC = [c for c in MARKET_COLUMNS if c != D]


@register("hourly_pattern", sql_with_mv(f"SELECT CAST(hour({QD}) AS INTEGER) AS hour, AVG({P1}) AS avg_{P1} "
                                        f"FROM mv GROUP BY 1"), rounded=[f"avg_{P1}"])
def hourly_pattern(spark, sf):
    """A5 / V9: mean first price per hour of day."""
    return stats.hourly_pattern(fe.add_time_features(mv(spark, sf), D), P1, "hour")


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(NUMERIC):
        for b in NUMERIC[i:]:
            parts.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, CORR({a}, {b}) AS correlation FROM mv")
            if a != b:
                parts.append(f"SELECT '{b}' AS column_a, '{a}' AS column_b, CORR({a}, {b}) AS correlation FROM mv")
    return " UNION ALL ".join(parts)


@register("correlation", sql_with_mv(_corr_sql()), rounded=["correlation"])
def correlation(spark, sf):
    """Pairwise-complete Pearson matrix of the numeric columns."""
    return stats.correlation_matrix(mv(spark, sf), NUMERIC)


#: lineitem's numbers and ratios of them, with gaps
WIDE = {f"c{k}": f"CASE WHEN (l_orderkey + {k}) % {k + 3} > 0 THEN l_extendedprice * {k} + l_quantity * {k * k} - l_discount * {1000 * (k % 7)} + l_tax * {500 * (k % 5)} END"
        for k in range(1, 41)}


@register("correlation_wide", f"WITH w AS (SELECT {', '.join(f'{e} AS {c}' for c, e in WIDE.items())} FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, CORR({a}, {b}) AS correlation FROM w" for a in list(WIDE)[:6] for b in WIDE), rounded=["correlation"])
def correlation_wide(spark, sf):
    """The matrix of 40 columns with gaps, by blocks; the rows of six."""
    x = table(spark, sf, "lineitem").select(*[F.expr(e).alias(c) for c, e in WIDE.items()])
    return stats.correlation_matrix(x, list(WIDE)).where(F.col("column_a").isin(list(WIDE)[:6]))


PIXELS = 120
PIXELS_SQL = f"""
WITH r AS (SELECT epoch(ts) AS place, ts AS x, value AS y FROM events WHERE value IS NOT NULL AND ts IS NOT NULL),
p AS (SELECT CAST(LEAST(FLOOR((place - lo) / (hi - lo) * {PIXELS}), {PIXELS - 1}) AS INTEGER) AS pixel, x, y FROM r CROSS JOIN (SELECT MIN(place) AS lo, MAX(place) AS hi FROM r) b)
SELECT DISTINCT 'value' AS series, pixel, x, y FROM p
QUALIFY ROW_NUMBER() OVER (PARTITION BY pixel ORDER BY x, y) = 1 OR ROW_NUMBER() OVER (PARTITION BY pixel ORDER BY x DESC, y DESC) = 1
  OR ROW_NUMBER() OVER (PARTITION BY pixel ORDER BY y, x) = 1 OR ROW_NUMBER() OVER (PARTITION BY pixel ORDER BY y DESC, x) = 1"""


@register("timeseries_pixels", PIXELS_SQL)
def timeseries_pixels(spark, sf):
    """V1 / V3 down-sampled: the points of each pixel column that draw its line."""
    return stats.downsample(table(spark, sf, "events"), "ts", ["value"], PIXELS)


SKETCHED = (0.05, 0.25, 0.5, 0.75, 0.95)


@register("sketched_quantiles", f"""SELECT o_orderstatus, quantile, COUNT(*) AS n, TRUE AS within
  FROM orders CROSS JOIN (VALUES {', '.join(f'(CAST({p} AS DOUBLE))' for p in SKETCHED)}) v(quantile) GROUP BY 1, 2""")
def sketched_quantiles(spark, sf):
    """Quantiles of two loads' merged sketches per status; whether
    the value's exact rank is within 1 % of the wanted one."""
    o = table(spark, sf, "orders").select("o_orderstatus", "o_totalprice", "o_orderkey")
    loads = [stats.quantile_sketches(o.where(F.col("o_orderkey") % 2 == k), "o_totalprice", ["o_orderstatus"]) for k in (0, 1)]
    found = stats.sketched_quantiles(stats.merged_sketches(loads[0].unionByName(loads[1]), ["o_orderstatus"]), SKETCHED)
    ranks = o.join(F.broadcast(found), "o_orderstatus").groupBy("o_orderstatus", "quantile", "n").agg(  # a few rows per status
        F.avg((F.col("o_totalprice") <= F.col("value")).cast("double")).alias("upto"), F.avg((F.col("o_totalprice") < F.col("value")).cast("double")).alias("below"))
    return ranks.select("o_orderstatus", "quantile", "n", ((F.col("upto") >= F.col("quantile") - 0.01) & (F.col("below") <= F.col("quantile") + 0.01)).alias("within"))


@register("price_bins", sql_with_mv(f"""
  SELECT bin, lo + (bin - 1) * w AS lower, lo + bin * w AS upper, count FROM (
    SELECT CAST(LEAST(FLOOR(({P1} - lo) / (hi - lo) * 50) + 1, 50) AS BIGINT) AS bin, lo, (hi - lo) / 50 AS w,
           COUNT(*) AS count
    FROM mv, (SELECT MIN({P1}) AS lo, MAX({P1}) AS hi FROM mv) r WHERE {P1} IS NOT NULL GROUP BY 1, 2, 3) b"""),
          rounded=["lower", "upper"])
def price_bins(spark, sf):
    """50 equal-width bins of the first price."""
    return stats.histogram(mv(spark, sf), P1, 50)


DASHBOARD_SQL = sql_with_mv(f"""SELECT 'correlation' AS part, column_a AS a, column_b AS b, correlation AS value FROM ({_corr_sql()}) c
  UNION ALL SELECT 'missing', column_name, '', CAST(null_count AS DOUBLE) FROM ({_missing_sql()}) m WHERE null_count > 0
  UNION ALL SELECT 'distribution', CAST(CAST(LEAST(FLOOR(({P1} - lo) / (hi - lo) * 50) + 1, 50) AS BIGINT) AS VARCHAR), '', CAST(COUNT(*) AS DOUBLE)
    FROM mv, (SELECT MIN({P1}) AS lo, MAX({P1}) AS hi FROM mv) r WHERE {P1} IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'timeseries', 'rows', '', CAST(COUNT(*) AS DOUBLE) FROM mv""")


@register("dashboard", DASHBOARD_SQL, rounded=["value"])
def dashboard(spark, sf):
    """The parts of the summary page in one table."""
    parts = stats.summary_dashboard(mv(spark, sf), D)
    row = lambda df, part, a, b, value: df.select(F.lit(part).alias("part"), a.alias("a"), b.alias("b"), value.cast("double").alias("value"))
    none = F.lit("")
    out = row(parts["correlation"], "correlation", F.col("column_a"), F.col("column_b"), F.col("correlation"))
    out = out.unionAll(row(parts["missing"], "missing", F.col("column_name"), none, F.col("null_count")))
    out = out.unionAll(row(parts["distribution"], "distribution", F.col("bin").cast("string"), none, F.col("count")))
    return out.unionAll(row(parts["timeseries"].agg(F.count(F.lit(1)).alias("n")), "timeseries", F.lit("rows"), none, F.col("n")))


@register("timeseries", sql_with_mv(f"SELECT {QD}, {P1}, {P2}, {F1} FROM mv"))
def timeseries(spark, sf):
    """V1 / V3: the price series, sorted."""
    return stats.timeseries(mv(spark, sf), D)


@register("timeseries_daily", sql_with_mv(f"""SELECT CAST(date_trunc('day', {QD}) AS TIMESTAMP) AS {QD},
  AVG({P1}) AS {P1}, AVG({P2}) AS {P2}, AVG({F1}) AS {F1} FROM mv GROUP BY 1"""), rounded=[P1, P2, F1])
def timeseries_daily(spark, sf):
    """V1 down-sampled to daily means."""
    return stats.timeseries(mv(spark, sf), D, every="day")


@register("signal_masks", sql_with_mv(f"""SELECT {QD}, action, COALESCE(contains(lower(action), 'buy'), false) AS is_buy,
  COALESCE(contains(lower(action), 'sell'), false) AS is_sell, split_part(action, '_', 1) AS first_leg
  FROM ({ORACLE_ROWS}) r"""))
def signal_masks(spark, sf):
    """buy/sell masks of the oracle signals (both hit every trade)."""
    rows = trade.oracle_backtest(mv(spark, sf), P1, P2, CFG, keep=[D]).select(F.col(f"`{D}`"), "action")
    return stats.signal_masks(rows)


@register("custom_chart", sql_with_mv(f"SELECT {P1}, {P2} FROM mv"))
def custom_chart(spark, sf):
    """An (x, y) pair of columns."""
    return stats.custom_chart(mv(spark, sf), P1, P2)


@register("strategy_cumulative", sql_with_mv(f"""SELECT label, {QD}, profit, SUM(profit) OVER (PARTITION BY label
  ORDER BY {QD} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative_profit
  FROM (SELECT 'Oracle (Perfect)' AS label, * FROM ({ORACLE_ROWS}) a UNION ALL
        SELECT 'persistence' AS label, * FROM ({PROXY_ROWS}) b) x""",
                                               PERSIST_CTE), rounded=["profit", "cumulative_profit"])
def strategy_cumulative(spark, sf):
    """Running profit per strategy (series keyed by label)."""
    rows = _labelled(spark, sf).select("label", F.col(f"`{D}`"), "profit")
    return trade.cumulative_profit(rows, Series(order_by=(D,), keys=("label",)))


@register("residual_box", sql_with_mv(f"""SELECT model, MIN(r) AS min, MAX(r) AS max, COUNT(r) AS n,
  quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.5) AS median, quantile_cont(r, 0.75) AS q3
  FROM (SELECT model, actual - predicted AS r FROM ({PAIRS_SQL}) p) z GROUP BY model"""),
          rounded=["min", "max", "q1", "median", "q3"])
def residual_box(spark, sf):
    """Residual quartiles per model (exact, skew-safe ranking)."""
    f = _forecasts(spark, sf).withColumn("r", F.col("actual") - F.col("predicted"))
    return stats.box_summary(f, "r", ["model"]).select("model", "min", "max", "n", "q1", "median", "q3")



@register("residual_histogram", sql_with_mv(f"""
  SELECT model, bin, lo + (bin - 1) * w AS lower, lo + bin * w AS upper, count FROM (
    SELECT model, CASE WHEN hi = lo THEN 1 ELSE CAST(LEAST(FLOOR((r - lo) / (hi - lo) * 50) + 1, 50) AS BIGINT) END
           AS bin, lo, (hi - lo) / 50 AS w, COUNT(*) AS count
    FROM (SELECT model, actual - predicted AS r FROM ({PAIRS_SQL}) p) z
    JOIN (SELECT model AS m2, MIN(actual - predicted) AS lo, MAX(actual - predicted) AS hi FROM ({PAIRS_SQL}) p
          GROUP BY 1) g ON g.m2 = z.model
    GROUP BY 1, 2, 3, 4) b"""), rounded=["lower", "upper"])
def residual_histogram(spark, sf):
    """50-bin residual histogram per model."""
    f = _forecasts(spark, sf)
    return stats.histogram(f, "r", 50, expr=F.col("actual") - F.col("predicted"), group_by=["model"])


def _dist_sql() -> str:
    longs = " UNION ALL ".join(f"SELECT '{c}' AS series, {c} AS value FROM mv" for c in (P1, P2, F1))
    return f"""
  SELECT series, bin, lo + (bin - 1) * w AS lower, lo + bin * w AS upper, count FROM (
    SELECT series, CASE WHEN hi = lo THEN 1 ELSE CAST(LEAST(FLOOR((value - lo) / (hi - lo) * 50) + 1, 50) AS BIGINT)
           END AS bin, lo, (hi - lo) / 50 AS w, COUNT(*) AS count
    FROM ({longs}) l JOIN (SELECT series AS s2, MIN(value) AS lo, MAX(value) AS hi FROM ({longs}) x
                           WHERE value IS NOT NULL GROUP BY 1) g ON g.s2 = l.series
    WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4) b"""


@register("price_distribution", sql_with_mv(_dist_sql()), rounded=["lower", "upper"])
def price_distribution(spark, sf):
    """V2: 50-bin histograms of the first, second and forecast price."""
    return stats.price_distribution(mv(spark, sf), [P1, P2, F1])
