"""Cleaning queries (W8-W12, C3-C7, A1-A4, A10, T2) on the market view,
events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import CleaningConfig
from ..operators import clean
from ..operators.series import Fill, Rolling, apply_series
from ..sources.driver_tables import LINEITEM_ORDER, table
from .common import EVENT_SERIES, LINEITEM_SERIES, MARKET_COLUMNS, MARKET_SERIES, QD, D, F1, P1, P2, SH, SL, SP, mv, sql_with_mv
from .features import order_sql
from .registry import register

CFG = CleaningConfig()
W = CFG.rolling_window
TEST = CFG.imputation_test_size
MV_ORDER = order_sql([QD])
EV_ORDER = order_sql(["ts", "event_id"])
IMPUTE_COLUMNS = [P1, P2, F1, SP, SL, SH]


def fill_sql(c: str, method: str, order: str, idx: str | None = None) -> str:
    """SQL for one fill; ``idx`` names a 0-based position column (interpolation)."""
    trail = f"OVER (ORDER BY {order} ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW)"
    upto = f"OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    after = f"OVER (ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    if method == "rolling_median":
        return f"COALESCE({c}, MEDIAN({c}) {trail})"
    if method == "rolling_mean":
        return f"COALESCE({c}, AVG({c}) {trail})"
    if method == "forward_fill":
        return f"COALESCE({c}, LAST_VALUE({c} IGNORE NULLS) {upto})"
    if method == "backward_fill":
        return f"COALESCE({c}, FIRST_VALUE({c} IGNORE NULLS) {after})"
    pi = f"LAST_VALUE(CASE WHEN {c} IS NOT NULL THEN {idx} END IGNORE NULLS) {upto}"
    pv = f"LAST_VALUE({c} IGNORE NULLS) {upto}"
    ni = f"FIRST_VALUE(CASE WHEN {c} IS NOT NULL THEN {idx} END IGNORE NULLS) {after}"
    nv = f"FIRST_VALUE({c} IGNORE NULLS) {after}"
    return f"COALESCE({c}, {pv} + ({nv} - {pv}) * ({idx} - {pi}) / ({ni} - {pi}))"


def _mv_fill(method: str):
    def build(spark, sf):
        m = mv(spark, sf).select(F.col(f"`{D}`"), P1)
        return clean.impute_rolling(m, P1, MARKET_SERIES, method, W)
    return build


for _name, _method in [("impute_median", "rolling_median"), ("impute_mean", "rolling_mean"),
                       ("ffill", "forward_fill"), ("bfill", "backward_fill"),
                       ("interpolate", "interpolate_linear")]:
    _sql = sql_with_mv(
        f"SELECT {QD}, {fill_sql(P1, _method, MV_ORDER, '__i')} AS {P1} FROM "
        f"(SELECT *, ROW_NUMBER() OVER (ORDER BY {MV_ORDER}) - 1 AS __i FROM mv) x")
    register(_name, _sql, rounded=[P1])(_mv_fill(_method))


EV_CLICK = "CASE WHEN event_type = 'click' THEN value END"


def _events_fill(method: str):
    def build(spark, sf):
        ev = table(spark, sf, "events").select(
            "event_id", "ts", F.when(F.col("event_type") == "click", F.col("value")).alias("v"))
        op = {"forward_fill": Fill("v", "ffill", "v"), "backward_fill": Fill("v", "bfill", "v"),
              "interpolate_linear": Fill("v", "interpolate", "v"),
              "rolling_median": Rolling("v", W, "median", "v", min_periods=1, fill_only=True)}[method]
        return apply_series(ev, EVENT_SERIES, [op])
    return build


for _name, _method in [("ffill_events", "forward_fill"), ("bfill_events", "backward_fill"),
                       ("interpolate_events", "interpolate_linear"), ("impute_median_events", "rolling_median")]:
    _sql = (f"SELECT event_id, ts, {fill_sql('v', _method, EV_ORDER, '__i')} AS v FROM "
            f"(SELECT event_id, ts, {EV_CLICK} AS v, ROW_NUMBER() OVER (ORDER BY {EV_ORDER}) - 1 AS __i "
            f"FROM events) x")
    register(_name, _sql, rounded=["v"])(_events_fill(_method))


# ----------------------------------------------------------- C4 / C5

CAND = ["rolling_mean", "rolling_median", "forward_fill", "interpolate_linear"]


def scores_sql(columns) -> str:
    parts = []
    for c in columns:
        w = "OVER (ORDER BY o ROWS BETWEEN {} PRECEDING AND CURRENT ROW)".format(W - 1)
        upto = "OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        after = "OVER (ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        pv, nv = f"LAST_VALUE(mv IGNORE NULLS) {upto}", f"FIRST_VALUE(mv IGNORE NULLS) {after}"
        pi = f"LAST_VALUE(CASE WHEN mv IS NOT NULL THEN CAST(i AS DOUBLE) END IGNORE NULLS) {upto}"
        ni = f"FIRST_VALUE(CASE WHEN mv IS NOT NULL THEN CAST(i AS DOUBLE) END IGNORE NULLS) {after}"
        preds = [f"AVG(mv) {w}", f"MEDIAN(mv) {w}", f"LAST_VALUE(mv IGNORE NULLS) {upto}",
                 f"{pv} + ({nv} - {pv}) * (i - {pi}) / ({ni} - {pi})"]
        rm = ", ".join(f"CASE WHEN COUNT(p{j}) = {TEST} THEN SQRT(AVG(POW(v - p{j}, 2))) END AS r{j}"
                       for j in range(4))
        rows = " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{m}' AS method, {j} AS position, r{j} AS rmse FROM s"
                                  for j, m in enumerate(CAND))
        parts.append(f"""(WITH t AS (SELECT {QD} AS o, CAST({c} AS DOUBLE) AS v FROM mv WHERE {c} IS NOT NULL
                              ORDER BY {QD} DESC LIMIT {TEST + W}),
               x AS (SELECT o, v, ROW_NUMBER() OVER (ORDER BY o) - 1 AS i, COUNT(*) OVER () AS k FROM t),
               m AS (SELECT *, CASE WHEN i < k - {TEST} THEN v END AS mv FROM x),
               p AS (SELECT i, k, v, {', '.join(f'{e} AS p{j}' for j, e in enumerate(preds))} FROM m),
               s AS (SELECT {rm} FROM p WHERE i >= k - {TEST})
             SELECT * FROM ({rows}) u
             WHERE (SELECT COUNT({c}) FROM mv) >= {2 * TEST})""")
    return " UNION ALL ".join(parts)


SCORES_SQL = scores_sql(IMPUTE_COLUMNS)


@register("imputation_scores", sql_with_mv(SCORES_SQL), rounded=["rmse"])
def imputation_scores(spark, sf):
    """C4 scoring: RMSE of each candidate fill on the last 24 masked values."""
    return clean.imputation_scores(mv(spark, sf), IMPUTE_COLUMNS, MARKET_SERIES, CFG)


def choice_sql(columns) -> str:
    return f"""
  SELECT c.column_name, COALESCE(b.method, '{CFG.default_imputation.value}') AS method,
         COALESCE(b.rmse, CAST('inf' AS DOUBLE)) AS rmse
  FROM (SELECT UNNEST([{', '.join(f"'{c}'" for c in columns)}]) AS column_name) c
  LEFT JOIN (SELECT column_name, arg_min(method, (rmse, position)) AS method, MIN(rmse) AS rmse
             FROM ({scores_sql(columns)}) z WHERE rmse IS NOT NULL GROUP BY column_name) b
  ON b.column_name = c.column_name"""


CHOICE_SQL = choice_sql(IMPUTE_COLUMNS)


@register("best_imputation", sql_with_mv(CHOICE_SQL), rounded=["rmse"])
def best_imputation(spark, sf):
    """C4 decision per column (forward fill wins under the default settings)."""
    return clean.choose_imputation(clean.imputation_scores(mv(spark, sf), IMPUTE_COLUMNS, MARKET_SERIES, CFG),
                                   IMPUTE_COLUMNS, CFG)


def filled_sql(columns=MARKET_COLUMNS, impute=IMPUTE_COLUMNS) -> str:
    """Each imputed column filled with the method its scores choose (a
    column without nulls is unchanged by any method)."""
    cols = []
    for c in columns:
        if c == D:
            cols.append(QD)
        elif c in impute:
            cases = " ".join(f"WHEN '{m}' THEN {fill_sql(c, m, MV_ORDER, '__i')}"
                             for m in ["rolling_median", "rolling_mean", "forward_fill", "interpolate_linear"])
            cols.append(f"CASE (SELECT method FROM choice WHERE column_name = '{c}') {cases} END AS {c}")
        else:
            cols.append(c)
    return (f"SELECT {', '.join(cols)} FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {MV_ORDER}) - 1 AS __i FROM mv) x")


@register("fill_missing", sql_with_mv(filled_sql(), f"choice AS ({CHOICE_SQL})"), rounded=IMPUTE_COLUMNS)
def fill_missing(spark, sf):
    """Every price column imputed with its chosen method in one framing
    (volumes are counts and have no nulls)."""
    out, _ = clean.fill_missing_values(mv(spark, sf), MARKET_SERIES, IMPUTE_COLUMNS, True, CFG)
    return out


# ------------------------------------------- C4 / C5 per key: returned items of each supplier

LI_ORDER = order_sql(LINEITEM_ORDER)
RETURNED = f"(SELECT l_suppkey, {', '.join(LINEITEM_ORDER)}, CASE WHEN l_returnflag = 'R' THEN l_extendedprice END AS returned FROM lineitem)"


def keyed_scores_sql() -> str:
    by = "PARTITION BY l_suppkey ORDER BY i"
    w, upto, after = (f"OVER ({by} ROWS BETWEEN {f})" for f in (f"{W - 1} PRECEDING AND CURRENT ROW", "UNBOUNDED PRECEDING AND CURRENT ROW",
                                                               "CURRENT ROW AND UNBOUNDED FOLLOWING"))
    pv, nv = f"LAST_VALUE(mv IGNORE NULLS) {upto}", f"FIRST_VALUE(mv IGNORE NULLS) {after}"
    pi = f"LAST_VALUE(CASE WHEN mv IS NOT NULL THEN CAST(i AS DOUBLE) END IGNORE NULLS) {upto}"
    ni = f"FIRST_VALUE(CASE WHEN mv IS NOT NULL THEN CAST(i AS DOUBLE) END IGNORE NULLS) {after}"
    preds = [f"AVG(mv) {w}", f"MEDIAN(mv) {w}", pv, f"{pv} + ({nv} - {pv}) * (i - {pi}) / ({ni} - {pi})"]
    newest = ", ".join(f"{c} DESC" for c in LINEITEM_ORDER)
    rows = " UNION ALL ".join(f"SELECT l_suppkey, 'returned' AS column_name, '{m}' AS method, {j} AS position, r{j} AS rmse FROM scored" for j, m in enumerate(CAND))
    rm = ", ".join(f"CASE WHEN COUNT(p{j}) = {TEST} THEN SQRT(AVG(POW(v - p{j}, 2))) END AS r{j}" for j in range(4))
    return f"""WITH newest AS (SELECT l_suppkey, returned AS v, {', '.join(LINEITEM_ORDER)} FROM {RETURNED} r WHERE returned IS NOT NULL
    QUALIFY ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY {newest}) <= {max(TEST + W, 2 * TEST)}),
  placed AS (SELECT l_suppkey, v, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY {LI_ORDER}) - 1 AS i, COUNT(*) OVER (PARTITION BY l_suppkey) AS k FROM newest),
  masked AS (SELECT *, CASE WHEN i < k - {TEST} THEN v END AS mv FROM placed WHERE k >= {2 * TEST}),
  tried AS (SELECT l_suppkey, i, k, v, {', '.join(f'{e} AS p{j}' for j, e in enumerate(preds))} FROM masked),
  scored AS (SELECT l_suppkey, {rm} FROM tried WHERE i >= k - {TEST} GROUP BY l_suppkey)
  SELECT * FROM ({rows}) u"""


def keyed_fill_sql() -> str:
    part = lambda sql: sql.replace("OVER (ORDER BY", "OVER (PARTITION BY l_suppkey ORDER BY")
    cases = " ".join(f"WHEN '{m}' THEN {part(fill_sql('returned', m, LI_ORDER, '__i'))}" for m in CAND)
    return f"""SELECT l_suppkey, {', '.join(LINEITEM_ORDER)}, CASE COALESCE(method, '{CFG.default_imputation.value}') {cases} END AS returned
  FROM (SELECT r.*, c.method, ROW_NUMBER() OVER (PARTITION BY r.l_suppkey ORDER BY {LI_ORDER}) - 1 AS __i FROM {RETURNED} r
    LEFT JOIN (SELECT l_suppkey AS s, arg_min(method, (rmse, position)) AS method FROM ({keyed_scores_sql()}) z WHERE rmse IS NOT NULL GROUP BY l_suppkey) c
    ON c.s = r.l_suppkey) x"""


def _returned(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_suppkey", *LINEITEM_ORDER, F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).alias("returned"))


@register("imputation_scores_keyed", keyed_scores_sql(), rounded=["rmse"], digits=4)
def imputation_scores_keyed(spark, sf):
    """C4 scoring of a keyed series: every supplier's newest values in one job."""
    return clean.imputation_scores(_returned(spark, sf), ["returned"], LINEITEM_SERIES, CFG)


@register("fill_missing_keyed", keyed_fill_sql(), rounded=["returned"], digits=4)
def fill_missing_keyed(spark, sf):
    """C5 of a keyed series: each supplier's gaps by the supplier's own choice."""
    out, _ = clean.fill_missing_values(_returned(spark, sf), LINEITEM_SERIES, ["returned"], True, CFG, materialize=False)
    return out


# ---------------------------------------------------------- C6 / C7

ZSCORE_SQL = """SELECT o_orderkey, o_totalprice,
  ABS((o_totalprice - (SELECT AVG(o_totalprice) FROM orders)) / (SELECT STDDEV_SAMP(o_totalprice) FROM orders))
  > {t} AS o_totalprice_outlier FROM orders"""


def _zscore(t):
    def build(spark, sf):
        o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
        return clean.detect_outliers(o, "o_totalprice", "zscore", t, CFG)
    return build


register("zscore_outliers", ZSCORE_SQL.format(t=CFG.outlier_std_threshold))(_zscore(None))
register("zscore_outliers_t1", ZSCORE_SQL.format(t=1.0))(_zscore(1.0))


def _nearest_sql(q: float) -> str:
    return (f"(SELECT v FROM (SELECT o_totalprice AS v, ROW_NUMBER() OVER (ORDER BY o_totalprice) - 1 AS r, "
            f"COUNT(*) OVER () AS n FROM orders WHERE o_totalprice IS NOT NULL) z "
            f"WHERE r = FLOOR((n - 1) * {q} + 0.5))")


IQR_SQL = """SELECT o_orderkey, o_totalprice,
  (o_totalprice < q1 - {t} * (q3 - q1)) OR (o_totalprice > q3 + {t} * (q3 - q1)) AS o_totalprice_outlier
  FROM orders, (SELECT {q1} AS q1, {q3} AS q3) b"""


def _iqr(t):
    def build(spark, sf):
        o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
        return clean.detect_outliers(o, "o_totalprice", "iqr", t, CFG)
    return build


register("iqr_outliers", IQR_SQL.format(t=CFG.outlier_std_threshold, q1=_nearest_sql(0.25),
                                        q3=_nearest_sql(0.75)))(_iqr(None))
register("iqr_outliers_t05", IQR_SQL.format(t=0.5, q1=_nearest_sql(0.25), q3=_nearest_sql(0.75)))(_iqr(0.5))


# ------------------------------------------------------------- A10

ORDER_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
DEDUPE_KEY = ["o_custkey", "o_orderdate"]


def _dedupe(keep):
    def build(spark, sf):
        out, _ = clean.remove_duplicates(table(spark, sf, "orders"), DEDUPE_KEY, keep, ["o_orderkey"], count=False)
        return out
    return build


register("dedupe_first", f"SELECT {ORDER_COLS} FROM orders QUALIFY ROW_NUMBER() OVER "
                         f"(PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) = 1")(_dedupe("first"))
register("dedupe_last", f"SELECT {ORDER_COLS} FROM orders QUALIFY ROW_NUMBER() OVER "
                        f"(PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1")(_dedupe("last"))
register("dedupe_none", f"SELECT {ORDER_COLS} FROM orders QUALIFY COUNT(*) OVER "
                        f"(PARTITION BY o_custkey, o_orderdate) = 1")(_dedupe("none"))


@register("dedupe_counts", """SELECT (SELECT COUNT(*) FROM orders) AS rows_before,
  (SELECT COUNT(*) FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders) d) AS rows_after,
  (SELECT COUNT(*) FROM orders) - (SELECT COUNT(*) FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders) d)
  AS duplicates_removed""")
def dedupe_counts(spark, sf):
    """A10 count of removed rows (keep first)."""
    o = table(spark, sf, "orders")
    out, _ = clean.remove_duplicates(o, DEDUPE_KEY, "first", ["o_orderkey"], count=False)
    before = o.agg(F.count(F.lit(1)).alias("rows_before"))
    after = out.agg(F.count(F.lit(1)).alias("rows_after"))
    return (before.withColumn("__k", F.lit(1)).join(after.withColumn("__k", F.lit(1)), "__k").drop("__k")
            .withColumn("duplicates_removed", F.col("rows_before") - F.col("rows_after")))


# -------------------------------------------------------- A1, A2, T2

def _missing_sql() -> str:
    cols = list(MARKET_COLUMNS)
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {i} AS position, COUNT(*) - COUNT({QD if c == D else c}) AS null_count, "
        f"COUNT(*) AS n FROM mv" for i, c in enumerate(cols))
    return (f"SELECT column_name, position, null_count, CASE WHEN n > 0 THEN ROUND(CAST(null_count AS DOUBLE) / n * 100, 2) "
            f"ELSE 0.0 END AS null_percentage, n - null_count AS non_null_count FROM ({parts}) s")


@register("missing_stats", sql_with_mv(_missing_sql()))
def missing_stats(spark, sf):
    """A1: null count / percentage / non-null count per column, one aggregation."""
    return clean.missing_value_stats(mv(spark, sf))


@register("missing_ranked", sql_with_mv(f"SELECT * FROM ({_missing_sql()}) m WHERE null_count > 0 "
                                        f"ORDER BY null_count DESC, position"))
def missing_ranked(spark, sf):
    """Columns with gaps, most first."""
    return clean.missing_ranked(mv(spark, sf))


def _quality_sql() -> str:
    cols = list(MARKET_COLUMNS)
    nulls = " + ".join(f"(COUNT(*) - COUNT({QD if c == D else c}))" for c in cols)
    width = len(cols)
    return (f"SELECT CASE WHEN COUNT(*) * {width} > 0 THEN ROUND((1.0 - CAST({nulls} AS DOUBLE) / (COUNT(*) * {width})) "
            f"* 100, 2) ELSE 0.0 END AS completeness, COUNT(*) AS total_rows, {width} AS total_columns, "
            f"CAST({nulls} AS BIGINT) AS null_cells, 8 AS numeric_columns FROM mv")


@register("quality_score", sql_with_mv(_quality_sql()))
def quality_score(spark, sf):
    """A2: completeness and counts in one row."""
    return clean.data_quality_score(mv(spark, sf))
