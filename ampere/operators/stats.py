"""Summary tables behind the charts.

Each returns a bounded DataFrame; rendering is left to the caller.
"""

from __future__ import annotations

from typing import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from .clean import missing_ranked, missing_value_stats
from ..session import ensure_checkpoint_dir
from .blocks import summed
from .series import RunningSum, Series, apply_series

CORR_TYPES = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType)
PICK_TYPES = (T.DoubleType, T.LongType)
MAX_BROADCAST_GROUPS = 100_000
#: columns whose pairs are still expressions of one aggregation
MAX_PAIRWISE_COLUMNS = 24


def q(c: str) -> Column:
    return F.col(f"`{c}`")


def hourly_pattern(df: DataFrame, value_column: str, hour_column: str = "hour") -> DataFrame | None:
    """A5 / V9: mean value per hour of day, sorted by hour; None when a column
    is missing."""
    if hour_column not in df.columns or value_column not in df.columns:
        return None
    return df.groupBy(q(hour_column)).agg(F.avg(q(value_column)).alias(f"avg_{value_column}")).orderBy(hour_column)


def correlation_columns(df: DataFrame, max_columns: int | None = 15) -> list[str]:
    """The first ``max_columns`` numeric columns (None: all)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, CORR_TYPES)][:max_columns]


def _pearson(a: Column, b: Column) -> Column:
    """Correlation over the complete pairs; null where a side is constant
    (``corr`` itself divides by zero there, which ANSI mode refuses)."""
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), spread)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None,
                       max_columns: int | None = 15) -> DataFrame | None:
    """Pairwise-complete Pearson correlation for every ordered pair
    of the given columns, or else of the first ``max_columns`` numeric ones
    (None: all), from one aggregation; tidy rows (column_a, column_b,
    correlation), null for a constant column. None with fewer than 2 columns.
    Many columns are worked off as products of whole blocks of rows instead of
    an expression for every pair (jobs run while the plan is built)."""
    cols = list(columns) if columns else correlation_columns(df, max_columns)
    if len(cols) < 2:
        return None
    if len(cols) > MAX_PAIRWISE_COLUMNS:
        return _correlation_by_blocks(df, cols)
    x = df.select(*[F.when(~F.isnan(q(c).cast("double")), q(c).cast("double")).alias(f"c{i}")
                    for i, c in enumerate(cols)])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    agg = x.agg(*[_pearson(F.col(f"c{i}"), F.col(f"c{j}")).alias(f"r{i}_{j}") for i, j in pairs])
    rows = []
    for i, j in pairs:
        rows.append(F.struct(F.lit(cols[i]).alias("column_a"), F.lit(cols[j]).alias("column_b"),
                             F.col(f"r{i}_{j}").alias("correlation")))
        if i != j:
            rows.append(F.struct(F.lit(cols[j]).alias("column_a"), F.lit(cols[i]).alias("column_b"),
                                 F.col(f"r{i}_{j}").alias("correlation")))
    return agg.select(F.inline(F.array(*rows)))


def _correlation_by_blocks(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete correlations from masked matrix products: for blocks
    of rows X (nulls as zero, about the columns' means) with presence M the
    sums X'X, X'M, (X*X)'M and M'M, added up over all tasks; as many numbers
    as four matrices of the columns reach the driver."""
    d = len(cols)
    x = df.select(*[F.when(~F.isnan(q(c).cast("double")), q(c).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])
    means = np.array([float(v or 0.0) for v in x.agg(*[F.avg(f"c{i}").alias(f"m{i}") for i in range(d)]).first()])

    def matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            values = np.column_stack([np.asarray(c.fill_null(np.nan), np.float64) for c in batch.columns]) if batch.num_rows else np.zeros((0, d))
            here = ~np.isnan(values)
            yield np.where(here, values - means, 0.0), here.astype(np.float64)

    def products(rows) -> np.ndarray:
        out = np.zeros((4, d, d))
        for v, m in rows:
            out += np.stack((v.T @ v, v.T @ m, (v * v).T @ m, m.T @ m))
        return out

    xy, x1, x2, n = summed(x, 4 * d * d, products, matrices).reshape(4, d, d)
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = xy / n - (x1 / n) * (x1.T / n)
        var = x2 / n - (x1 / n) ** 2
        # a side is constant where its variance is what rounding leaves of its squares
        var = np.where(var > 1e-14 * np.maximum(x2 / n, 1e-300), var, np.nan)
        r = cov / np.sqrt(var * var.T)
    rows = [(cols[i], cols[j], None if np.isnan(r[i, j]) else float(r[i, j])) for i in range(d) for j in range(d)]
    return df.sparkSession.createDataFrame(rows, "column_a string, column_b string, correlation double")


def residual_stats(df: DataFrame, actual: str, predicted: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Mean, population std, min and max of actual - predicted."""
    r = q(actual) - q(predicted)
    return df.groupBy(*group_by).agg(
        F.avg(r).alias("mean_residual"), F.stddev_pop(r).alias("std_residual"),
        F.min(r).alias("min_residual"), F.max(r).alias("max_residual"), F.count(r).alias("n"))


def axis_range(df: DataFrame, a: str, b: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Common range of two series (per group)."""
    return df.groupBy(*group_by).agg(F.least(F.min(q(a)), F.min(q(b))).alias("lo"), F.greatest(F.max(q(a)), F.max(q(b))).alias("hi"))


def bin_expr(c: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin 1..bins; the maximum falls into the last bin."""
    if hi == lo:
        return F.when(c.isNotNull(), F.lit(1).cast("long"))
    return F.least(F.floor((c - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)) + 1, F.lit(bins)).cast("long")


def histogram(df: DataFrame, column: str, bins: int = 50, expr: Column | None = None,
              group_by: Sequence[str] = ()) -> DataFrame:
    """Counts per equal-width bin over [min, max] (per
    group when ``group_by`` is given); the maximum falls into the last bin.

    Global: the range is two scalars from one aggregation. Grouped: the
    ranges are one row per group, joined back on the group keys. Runs the
    range aggregation when called."""
    keys = list(group_by)
    v = expr if expr is not None else q(column)
    x = df.select(*[q(k) for k in keys], v.cast("double").alias("v")).where(F.col("v").isNotNull())
    if keys:
        rng = x.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        rng = rng.select(F.struct(*[q(k) for k in keys]).alias("__g"), "lo", "hi")
        # one row per group: broadcast up to a checked number, so that a few large groups are not
        # dealt to a few tasks; many groups are spread by their keys
        ensure_checkpoint_dir(df.sparkSession)
        rng = rng.checkpoint(eager=True)
        rng = F.broadcast(rng) if rng.count() <= MAX_BROADCAST_GROUPS else rng.hint("merge")
        j = x.withColumn("__g", F.struct(*[q(k) for k in keys])).join(rng, "__g").select(*[q(k) for k in keys], "v", "lo", "hi")
        lo, hi = F.col("lo"), F.col("hi")
        b = F.when(hi == lo, F.lit(1).cast("long")).otherwise(
            F.least(F.floor(F.try_divide(F.col("v") - lo, hi - lo) * F.lit(bins)) + 1, F.lit(bins)).cast("long"))
        w = (hi - lo) / F.lit(bins)
        counted = j.groupBy(*keys, b.alias("bin"), "lo", w.alias("w")).agg(F.count(F.lit(1)).alias("count"))
        return counted.select(*keys, "bin", (F.col("lo") + (F.col("bin") - 1) * F.col("w")).alias("lower"),
                              (F.col("lo") + F.col("bin") * F.col("w")).alias("upper"), "count")
    r = x.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if r["lo"] is None:
        return x.select(F.lit(0).cast("long").alias("bin"), F.lit(0.0).alias("lower"),
                        F.lit(0.0).alias("upper"), F.lit(0).cast("long").alias("count")).limit(0)
    lo, hi = float(r["lo"]), float(r["hi"])
    width = (hi - lo) / bins if hi > lo else 0.0
    b = bin_expr(F.col("v"), lo, hi, bins)
    counted = x.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counted.select("bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("lower"),
                          (F.lit(lo) + F.col("bin") * F.lit(width)).alias("upper"), "count")


def exact_quantiles(df: DataFrame, column: str, qs: Sequence[float], group_by: Sequence[str] = (),
                    interpolation: str = "linear") -> DataFrame:
    """Exact quantiles per group without gathering a group in one task.

    Equal values are counted first (map-side), so a value that most rows
    share is one row; distinct values get their rank range from a running
    sum of the counts over a blocked series, so a hot group spans many tasks;
    only the values that cover a wanted rank are kept.

    linear: v[f] + (v[c] - v[f]) * (p - f), p = (n-1) q.
    nearest: v[round(p)] with halves away from zero.
    Rows: group columns, quantile, value. Runs the counting when called.
    """
    keys = list(group_by)
    x = df.select(F.struct(*[q(k) for k in keys], F.lit(0).alias("__none")).alias("__g"), q(column).cast("double").alias("__v"))
    counts = x.where(F.col("__v").isNotNull()).groupBy("__g", "__v").agg(F.count(F.lit(1)).alias("__c"))
    ranked = apply_series(counts, Series(order_by=("__v",), keys=("__g",), strategy="blocked"), [RunningSum("__c", "__end")])
    per = ranked.groupBy("__g").agg(F.sum("__c").alias("__n"))
    pos = (F.col("__n") - 1).cast("double") * F.col("quantile")
    wanted = per.select("__g", "__n", F.explode(F.array(*[F.lit(float(v)) for v in qs])).alias("quantile"))
    if interpolation == "nearest":
        wanted = wanted.withColumns({"__lo": F.floor(pos + 0.5).cast("long"), "__w": F.lit(0.0)}).withColumn("__hi", F.col("__lo"))
    else:
        wanted = wanted.withColumns({"__lo": F.floor(pos).cast("long"), "__hi": F.ceil(pos).cast("long"),
                                     "__w": pos - F.floor(pos)})
    # few rows per group beside its distinct values
    each = wanted.groupBy("__g").agg(F.collect_list(F.struct("quantile", "__lo", "__hi", "__w")).alias("__wanted"))
    covers = lambda w, r: (w[r] < F.col("__end")) & (w[r] >= F.col("__end") - F.col("__c"))
    hits = ranked.join(each, "__g").select("__g", "__v", "__end", "__c", F.explode(
        F.filter("__wanted", lambda w: covers(w, "__lo") | covers(w, "__hi"))).alias("w"))
    lo = F.max(F.when(covers(F.col("w"), "__lo"), F.col("__v")))
    hi = F.max(F.when(covers(F.col("w"), "__hi"), F.col("__v")))
    out = hits.groupBy("__g", "w.quantile", F.col("w.__w").alias("__w")).agg(lo.alias("__va"), hi.alias("__vb"))
    value = F.col("__va") + (F.col("__vb") - F.col("__va")) * F.col("__w")
    return out.select(*[F.col("__g")[k].alias(k) for k in keys], "quantile", value.alias("value"))


def box_summary(df: DataFrame, column: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Quartiles (linear) and extremes per group."""
    keys = list(group_by)
    qs = exact_quantiles(df, column, [0.25, 0.5, 0.75], keys)
    wide = qs.groupBy(*keys).agg(
        F.max(F.when(F.col("quantile") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("quantile") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("quantile") == 0.75, F.col("value"))).alias("q3"))
    ext = df.groupBy(*keys).agg(F.min(q(column)).alias("min"), F.max(q(column)).alias("max"),
                                F.count(q(column)).alias("n"))
    return ext.join(wide, keys, "left") if keys else _one_row_merge(ext, wide)


def _one_row_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Merge two one-row frames side by side (equi-join on a constant key)."""
    return a.withColumn("__k", F.lit(1)).join(b.withColumn("__k", F.lit(1)), "__k", "left").drop("__k")


def top_n(df: DataFrame, value: str, n: int = 15, label: str | None = None) -> DataFrame:
    """The n largest values (ties: label order); TakeOrderedAndProject."""
    order = [q(value).desc()] + ([q(label).asc()] if label else [])
    return df.orderBy(*order).limit(n)


def best_per_metric(metrics: DataFrame, model: str = "model") -> DataFrame:
    """Best model by RMSE, MAE (smallest) and R2 (largest); ties go
    to the smallest model name."""
    m = q(model)
    return metrics.agg(
        F.min_by(m, F.struct(F.col("rmse"), m)).alias("best_rmse_model"),
        F.min_by(m, F.struct(F.col("mae"), m)).alias("best_mae_model"),
        F.min_by(m, F.struct(-F.col("r2"), m)).alias("best_r2_model"),
    )


def normalised_metrics(metrics: DataFrame, model: str = "model") -> DataFrame:
    """0-1 scores, 1 = best. Errors: 1 - (x - min)/(max - min),
    1.0 when all equal; R2: (x - min)/(max - min + 1e-8). The metric table
    has one row per model, so the unpartitioned window is bounded by it."""
    w = Window.partitionBy(F.lit(1))
    cols = [q(model)]
    for c in ("rmse", "mae", "smape", "mape"):
        if c in metrics.columns:
            lo, hi = F.min(c).over(w), F.max(c).over(w)
            cols.append(F.when(hi == lo, F.lit(1.0)).otherwise(F.lit(1.0) - F.try_divide(F.col(c) - lo, hi - lo))
                        .alias(f"{c}_score"))
    if "r2" in metrics.columns:
        lo, hi = F.min("r2").over(w), F.max("r2").over(w)
        cols.append(F.try_divide(F.col("r2") - lo, hi - lo + F.lit(1e-8)).alias("r2_score"))
    return metrics.select(*cols)


def timeseries(df: DataFrame, date_column: str = C.DATE_COLUMN, columns: Sequence[str] | None = None,
               every: str | None = None) -> DataFrame:
    """V1: (timestamp, existing price columns), sorted; ``every`` ('hour',
    'day', ...) averages into coarser steps."""
    cols = [c for c in (columns or (C.PRICE_FIRST, C.PRICE_SECOND, C.FORECAST_FIRST)) if c in df.columns]
    if every:
        t = F.date_trunc(every, q(date_column)).cast("timestamp_ntz").alias(date_column)
        return df.groupBy(t).agg(*[F.avg(q(c)).alias(c) for c in cols]).orderBy(date_column)
    return df.select(q(date_column), *[q(c) for c in cols]).orderBy(date_column)


def downsample(df: DataFrame, x: str, columns: Sequence[str], pixels: int = 800) -> DataFrame:
    """V1 / V3 for a chart ``pixels`` wide: of each series the first, last,
    least and greatest point of every pixel column, so at most 4 x pixels
    points that draw the same line. Rows (series, pixel, x, y); equal extremes
    go to the earliest point; rows without x or y are left out, and of points
    that share an x the least y counts as first and the greatest as last. One
    aggregation for the range (run when called), one for the points: both are
    combined before the shuffle."""
    if pixels < 1:
        raise ValueError("pixels must be at least 1")
    at = q(x).cast("timestamp").cast("double") if isinstance(df.schema[x].dataType, (T.TimestampType, T.TimestampNTZType)) else q(x).cast("double")
    long = df.select(q(x).alias("x"), at.alias("__at"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("series"), q(c).cast("double").alias("y")) for c in columns]))).where(F.col("y").isNotNull() & F.col("__at").isNotNull())
    lo, hi = long.agg(F.min("__at"), F.max("__at")).first()
    pixel = F.lit(0) if lo is None or lo == hi else F.least(F.floor((F.col("__at") - lo) / (hi - lo) * pixels), F.lit(pixels - 1))
    point = F.struct("x", "y")
    ends = long.groupBy("series", pixel.cast("int").alias("pixel")).agg(
        F.min(point).alias("a"), F.max(point).alias("b"),
        F.min(F.struct("y", "x")).alias("c"), F.min(F.struct((-F.col("y")).alias("y"), "x")).alias("d"))
    points = F.array("a", "b", F.struct(F.col("c.x").alias("x"), F.col("c.y").alias("y")), F.struct(F.col("d.x").alias("x"), (-F.col("d.y")).alias("y")))
    return ends.select("series", "pixel", F.inline(F.array_distinct(points)))


def quantile_sketches(df: DataFrame, column: str, group_by: Sequence[str] = (), k: int = 800) -> DataFrame:
    """A4 / A12 for growing tables: one mergeable quantile sketch (KLL) per
    group, a few KB each, combined before the shuffle. Sketches of several
    loads are stored and merged by ``merged_sketches``; with ``k`` = 800 a
    rank is off by less than 0.6 % of the rows at 99 % confidence."""
    return df.where(q(column).isNotNull()).groupBy(*[q(g) for g in group_by]).agg(
        F.kll_sketch_agg_double(q(column).cast("double"), F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def merged_sketches(sketches: DataFrame, group_by: Sequence[str] = (), k: int = 800) -> DataFrame:
    """The sketches of several loads as one per group."""
    return sketches.groupBy(*[q(g) for g in group_by]).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"))


def sketched_quantiles(sketches: DataFrame, qs: Sequence[float]) -> DataFrame:
    """Rows (groups ..., quantile, value, n) of a table of sketches."""
    groups = [c for c in sketches.columns if c not in ("sketch", "n")]
    each = F.inline(F.array(*[F.struct(F.lit(float(p)).alias("quantile"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value")) for p in qs]))
    return sketches.select(*[q(g) for g in groups], "n", each)


def signal_masks(df: DataFrame, action: str = "action") -> DataFrame:
    """The reference's case-insensitive 'buy' / 'sell' masks (both
    action names contain both words) plus the first leg of the action."""
    a = F.lower(q(action))
    return df.withColumns({
        "is_buy": F.coalesce(a.contains("buy"), F.lit(False)),
        "is_sell": F.coalesce(a.contains("sell"), F.lit(False)),
        "first_leg": F.split(q(action), "_").getItem(0),
    })


def custom_chart(df: DataFrame, x: str, y: str, limit: int | None = None) -> DataFrame:
    """Any (x, y) pair, optionally a first-n preview."""
    out = df.select(q(x), q(y))
    return out.limit(limit) if limit else out


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    """First n rows."""
    return df.limit(n)


def home_summary(df: DataFrame, price_column: str = C.PRICE_FIRST) -> DataFrame:
    """Rows, width, completeness and mean first price in one aggregation."""
    cols = df.columns
    nulls = sum((F.count_if(q(c).isNull()) for c in cols), F.lit(0))
    agg = [F.count(F.lit(1)).alias("rows"), nulls.cast("long").alias("null_cells")]
    if price_column in cols:
        agg.append(F.avg(q(price_column)).alias("mean_price"))
    out = df.agg(*agg)
    cells = F.col("rows") * len(cols)
    return out.select("*", F.lit(len(cols)).alias("columns"),
                      F.when(cells > 0, (F.lit(1.0) - F.try_divide(F.col("null_cells"), cells)) * 100)
                      .alias("completeness"))


def summary_dashboard(df: DataFrame, date_column: str = C.DATE_COLUMN,
                      max_columns: int | None = 10) -> dict[str, DataFrame | None]:
    """Time series, first-price distribution, missing values and the
    correlation of the first ``max_columns`` 64-bit numeric columns (None: all)."""
    picks = [f.name for f in df.schema.fields if isinstance(f.dataType, PICK_TYPES)][:max_columns]
    out = {
        "timeseries": timeseries(df, date_column),
        "missing": missing_ranked(df),
        "missing_stats": missing_value_stats(df),
        "correlation": correlation_matrix(df, picks) if len(picks) >= 2 else None,
    }
    if C.PRICE_FIRST in df.columns:
        out["distribution"] = histogram(df, C.PRICE_FIRST)
    return out


def first_available(*frames: DataFrame | None) -> DataFrame | None:
    """The first table that exists (merged, then cleaned, then raw)."""
    return next((f for f in frames if f is not None), None)


def first_models(metrics: DataFrame, models: list[str], k: int = 4, model: str = "model") -> DataFrame:
    """The comparison rows of the first ``k`` models in the given order."""
    return metrics.where(q(model).isin(list(models)[:k]))


def first_columns(df: DataFrame, k: int) -> list[str]:
    """T5: the first ``k`` column names (metadata only)."""
    return list(df.columns)[:k]


def price_distribution(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 50) -> DataFrame:
    """V2: one equal-width histogram per price column, from one unpivot and
    one grouped histogram (rows: series, bin, lower, upper, count)."""
    cols = [c for c in (columns or (C.PRICE_FIRST, C.PRICE_SECOND, C.FORECAST_FIRST)) if c in df.columns]
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("series"), q(c).cast("double").alias("value"))
                                        for c in cols])))
    return histogram(long, "value", bins, group_by=["series"])
