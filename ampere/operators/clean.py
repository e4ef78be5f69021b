"""Cleaning: parsing, numeric conversion, duplicates, missing-value
statistics, imputation (C1-C11, A1-A4, A10)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..config import CleaningConfig, ImputationMethod
from ..functions.scalar import lenient_double, parse_timestamp
from ..session import ensure_checkpoint_dir
from .series import Fill, Rolling, Series, apply_series

NUMERIC_TYPES = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType)
# numeric in the quality score / pickers: 64-bit only
SCORE_NUMERIC_TYPES = (T.DoubleType, T.LongType)
# candidate order of the imputation chooser; backward fill is never tried
CANDIDATES = (ImputationMethod.ROLLING_MEAN, ImputationMethod.ROLLING_MEDIAN,
              ImputationMethod.FORWARD_FILL, ImputationMethod.INTERPOLATE_LINEAR)


def q(c: str) -> Column:
    return F.col(f"`{c}`")


# ----------------------------------------------------------------- C1, C2


def parse_datetime(df: DataFrame, column: str, date_format: str | None = None,
                   cfg: CleaningConfig = CleaningConfig(), fallback: bool = False) -> DataFrame:
    """Strip brackets, parse day-first stamps; failures become null."""
    return df.withColumn(column, parse_timestamp(q(column), date_format or cfg.date_format, fallback))


def convert_to_numeric(df: DataFrame, columns: Sequence[str] | None = None, errors: str = "null",
                       date_column: str = C.DATE_COLUMN) -> tuple[DataFrame, list[str]]:
    """String columns -> double (first comma as decimal point); values
    that are not numbers become null. Non-string columns are skipped, or
    raise with ``errors='raise'``."""
    types = dict(df.dtypes)
    if columns is None:
        columns = [c for c in df.columns if types[c] == "string" and c != date_column]
    converted, exprs = [], {}
    for c in columns:
        if c not in types:
            continue
        if types[c] != "string":
            if errors == "raise":
                raise TypeError(f"column {c} is {types[c]}, not string")
            continue
        exprs[c] = lenient_double(q(c))
        converted.append(c)
    return df.withColumns(exprs), converted


# ------------------------------------------------------------ A1, A2, T2


def missing_value_stats(df: DataFrame) -> DataFrame:
    """A1: per column null count, null percentage (2 dp; 0 when empty) and
    non-null count, from one aggregation."""
    cols = df.columns
    counts = df.agg(F.count(F.lit(1)).alias("__n"),
                    *[F.count_if(q(c).isNull()).alias(f"__m{i}") for i, c in enumerate(cols)])
    stacked = counts.select(
        "__n", F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"),
                                           F.col(f"__m{i}").alias("null_count")) for i, c in enumerate(cols)])))
    n = F.col("__n")
    return stacked.select(
        "column_name", "position", "null_count",
        F.when(n > 0, F.round(F.col("null_count") / n * 100, 2)).otherwise(F.lit(0.0)).alias("null_percentage"),
        (n - F.col("null_count")).alias("non_null_count"),
    )


def missing_ranked(df: DataFrame) -> DataFrame:
    """Columns with missing values, most missing first."""
    return missing_value_stats(df).where(F.col("null_count") > 0).orderBy(F.col("null_count").desc(), "position")


def data_quality_score(df: DataFrame) -> DataFrame:
    """A2: completeness percentage (2 dp), rows, columns, null cells and the
    number of 64-bit numeric columns, as one row."""
    cols = df.columns
    width = len(cols)
    numeric = sum(isinstance(f.dataType, SCORE_NUMERIC_TYPES) for f in df.schema.fields)
    nulls = sum((F.count_if(q(c).isNull()) for c in cols), F.lit(0)) if cols else F.lit(0)
    agg = df.agg(F.count(F.lit(1)).alias("total_rows"), nulls.cast("long").alias("null_cells"))
    cells = F.col("total_rows") * width
    return agg.select(
        F.when(cells > 0, F.round((F.lit(1.0) - F.col("null_cells") / cells) * 100, 2))
        .otherwise(F.lit(0.0)).alias("completeness"),
        "total_rows", F.lit(width).alias("total_columns"), "null_cells",
        F.lit(numeric).alias("numeric_columns"),
    )


# ------------------------------------------------------------------- A3, A4


def quantiles(df: DataFrame, column: str, qs: Sequence[float], interpolation: str = "nearest") -> list:
    """A4: quantiles of one column. ``nearest`` returns the element at rank
    round((n-1) q) (halves away from zero); ``linear`` interpolates;
    ``approx`` uses Spark's percentile sketch.
    Values are ranked by a range shuffle, never gathered in one task; only
    one row per requested quantile reaches the driver."""
    from .stats import exact_quantiles

    if interpolation == "approx":  # bounded-memory sketch, for very large columns
        row = df.agg(F.percentile_approx(q(column), [float(x) for x in qs], 10_000).alias("p")).first()
        return list(row["p"]) if row["p"] is not None else [None] * len(qs)
    rows = {r["quantile"]: r["value"] for r in exact_quantiles(df, column, qs, (), interpolation).collect()}
    return [rows.get(float(x)) for x in qs]


# -------------------------------------------------------------- C6, C7


def detect_outliers(df: DataFrame, column: str, method: str = "zscore", threshold: float | None = None,
                    cfg: CleaningConfig = CleaningConfig(), name: str | None = None) -> DataFrame:
    """Append a boolean outlier flag (null where the value is null).

    zscore: |x - mean| / sample std > t. A zero or undefined std flags
    nothing. iqr: outside [q1 - t iqr, q3 + t iqr] with 'nearest' quartiles.
    The default t is the configured 3.0 for both, and a zero threshold falls
    back to it.
    """
    t = float(threshold or cfg.outlier_std_threshold)
    c = q(column)
    name = name or f"{column}_outlier"
    if method == "zscore":
        st = df.agg(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).first()
        if st["s"] is None or st["s"] == 0 or st["m"] is None:
            return df.withColumn(name, F.when(c.isNotNull(), F.lit(False)))
        flag = F.abs((c - F.lit(st["m"])) / F.lit(st["s"])) > F.lit(t)
        return df.withColumn(name, flag)
    if method == "iqr":
        q1, q3 = quantiles(df, column, [0.25, 0.75])
        if q1 is None:
            return df.withColumn(name, F.lit(None).cast("boolean"))
        iqr = q3 - q1
        lo, hi = q1 - t * iqr, q3 + t * iqr
        return df.withColumn(name, (c < F.lit(lo)) | (c > F.lit(hi)))
    raise ValueError(f"Unknown outlier detection method: {method}")


# ------------------------------------------------------------------- A10


def remove_duplicates(df: DataFrame, subset: Sequence[str] | None = None, keep: str = "first",
                      order_by: Sequence[str] | None = None, count: bool = True) -> tuple[DataFrame, int | None]:
    """A10: one row per key. ``first``/``last`` keep the row with the
    smallest/largest ``order_by`` value; any other ``keep`` drops every key
    that occurs more than once. Planned as an aggregation with a map-side
    partial step (sort-based for the row struct, so it spills), so a hot key
    is combined before the shuffle."""
    cols = list(df.columns)
    subset = list(subset) if subset else cols
    others = [c for c in cols if c not in subset]
    if keep in ("first", "last") and not others:
        out = df.dropDuplicates(subset)
    elif keep in ("first", "last"):
        if not order_by:
            raise ValueError("keep='first'/'last' needs order_by (a column giving the ingest order)")
        rank = F.struct(*[q(c) for c in order_by])
        row = F.struct(*[q(c) for c in others])
        pick = F.min_by(row, rank) if keep == "first" else F.max_by(row, rank)
        out = df.groupBy(*[q(c) for c in subset]).agg(pick.alias("__row")).select(
            *[q(c) for c in subset], *[F.col("__row")[c].alias(c) for c in others]).select(*[q(c) for c in cols])
    else:
        row = F.struct(*[q(c) for c in others]) if others else F.lit(None)
        out = (df.groupBy(*[q(c) for c in subset])
               .agg(F.count(F.lit(1)).alias("__n"), F.first(row).alias("__row"))
               .where(F.col("__n") == 1)
               .select(*[q(c) for c in subset], *[F.col("__row")[c].alias(c) for c in others])
               .select(*[q(c) for c in cols]))
    removed = None
    if count:
        removed = df.count() - out.count()
    return out, removed


# ------------------------------------------------------------ C3, C4, C5


def imputation_op(column: str, method: ImputationMethod | str, window: int):
    m = ImputationMethod(method)
    if m is ImputationMethod.ROLLING_MEDIAN:
        return Rolling(column, window, "median", column, min_periods=1, fill_only=True)
    if m is ImputationMethod.ROLLING_MEAN:
        return Rolling(column, window, "mean", column, min_periods=1, fill_only=True)
    if m is ImputationMethod.FORWARD_FILL:
        return Fill(column, "ffill", column)
    if m is ImputationMethod.BACKWARD_FILL:
        return Fill(column, "bfill", column)
    if m is ImputationMethod.INTERPOLATE_LINEAR:
        return Fill(column, "interpolate", column)
    raise ValueError(f"Unknown imputation method: {method}")


def impute_rolling(df: DataFrame, column: str, s: Series,
                   method: ImputationMethod | str = ImputationMethod.ROLLING_MEDIAN,
                   window_size: int | None = None, cfg: CleaningConfig = CleaningConfig()) -> DataFrame:
    """Fill nulls of one column (non-null cells are kept)."""
    return apply_series(df, s, [imputation_op(column, method, window_size or cfg.rolling_window)])


def imputation_scores(df: DataFrame, columns: Sequence[str], s: Series, cfg: CleaningConfig = CleaningConfig(),
                      counts: dict | None = None, policy: str = "reference") -> DataFrame:
    """C4 scoring for many columns in one pass: for each column, its non-null
    values in series order, the last ``test_size`` masked, each candidate
    scored by RMSE on the masked cells (null when a cell stays unfilled).

    Only the last ``test_size + rolling_window`` non-null values can affect
    the masked cells, so each column keeps its newest k by an ordered limit
    (k rows per partition, whatever k is). Columns with fewer than
    ``2 * test_size`` non-null values get no rows (caller uses the default).
    ``counts`` may pass the non-null counts when the caller already has them.

    ``policy``: ``reference`` masks the newest values in one gap, so that at
    the default sizes only forward fill reaches all of them; ``interior``
    masks every second of the newest ``2 * test_size`` values but the last,
    so that every candidate has neighbours to work with.
    A keyed series is scored key by key, all keys in one job: a ranked limit
    keeps each key's and column's newest values before the shuffle already,
    so no key is gathered (``counts`` is not used then).
    Rows: (keys ..., column_name, method, position, rmse).
    """
    if policy not in ("reference", "interior"):
        raise ValueError(f"unknown imputation policy {policy!r}")
    test, win = cfg.imputation_test_size, cfg.rolling_window
    keep = test + win if policy == "reference" else 2 * test + win
    if s.keys:
        return _keyed_scores(df, columns, s, max(keep, 2 * test), cfg, policy)
    order = list(s.order_by)
    if counts is None:
        row = df.agg(*[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
        counts = {c: row[f"n{i}"] for i, c in enumerate(columns)}
    enough = [c for c in columns if counts.get(c, 0) >= 2 * test]
    spark = df.sparkSession
    if not enough:
        return spark.createDataFrame([], "column_name string, method string, position int, rmse double")
    o = F.struct(*[q(c) for c in order])
    longf = None
    for c in enough:
        one = df.select(F.lit(c).alias("column_name"), o.alias("o"), q(c).cast("double").alias("v"))
        one = one.where(F.col("v").isNotNull()).orderBy(F.col("o").desc()).limit(keep)
        longf = one if longf is None else longf.unionAll(one)
    return _scored(longf, ["column_name"], cfg, policy)


def _keyed_scores(df: DataFrame, columns: Sequence[str], s: Series, keep: int, cfg: CleaningConfig, policy: str) -> DataFrame:
    """Scores per key and column: the newest ``keep`` values of each."""
    by = [*s.keys, "column_name"]
    if "column_name" in s.keys:
        raise ValueError("a key column may not be named column_name")
    long = df.select(*[q(k) for k in s.keys], F.struct(*[q(c) for c in s.order_by]).alias("o"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), q(c).cast("double").alias("v")) for c in columns]))).where(F.col("v").isNotNull())
    newest = F.row_number().over(Window.partitionBy(*[q(c) for c in by]).orderBy(F.col("o").desc()))
    long = long.withColumn("__r", newest).where(F.col("__r") <= keep).drop("__r")
    return _scored(long, by, cfg, policy, least=2 * cfg.imputation_test_size)


def _scored(longf: DataFrame, by: list[str], cfg: CleaningConfig, policy: str, least: int = 0) -> DataFrame:
    """RMSE of each candidate per group of ``(by ..., o, v)`` rows, which hold
    the newest values of each column; groups of fewer than ``least`` have none."""
    test, win = cfg.imputation_test_size, cfg.rolling_window
    w = Window.partitionBy(*[q(c) for c in by]).orderBy("o")
    # rows in each column's frame
    x = longf.withColumn("__k", F.count(F.lit(1)).over(Window.partitionBy(*[q(c) for c in by]))).where(F.col("__k") >= least)
    x = x.withColumn("__i", F.row_number().over(w) - 1)
    masked = F.col("__i") >= F.col("__k") - test
    if policy == "interior":
        back = F.col("__k") - 1 - F.col("__i")  # 0 for the newest value, which stays
        masked = (back < 2 * test) & (F.pmod(back, F.lit(2)) == 1)
    x = x.withColumn("mv", F.when(~masked, F.col("v")))
    ops = {
        ImputationMethod.ROLLING_MEAN: F.avg("mv").over(w.rowsBetween(-(win - 1), 0)),
        ImputationMethod.ROLLING_MEDIAN: F.percentile(F.col("mv"), F.lit(0.5)).over(w.rowsBetween(-(win - 1), 0)),
        ImputationMethod.FORWARD_FILL: F.last("mv", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    }
    pt = F.when(F.col("mv").isNotNull(), F.struct(F.col("__i").cast("double").alias("i"), F.col("mv").alias("v")))
    prev = F.last(pt, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    w_rev = Window.partitionBy(*[q(c) for c in by]).orderBy(F.col("o").desc())
    nxt = F.last(pt, ignorenulls=True).over(w_rev.rowsBetween(Window.unboundedPreceding, 0))
    ops[ImputationMethod.INTERPOLATE_LINEAR] = prev["v"] + F.try_divide(
        (nxt["v"] - prev["v"]) * (F.col("__i") - prev["i"]), nxt["i"] - prev["i"])
    x = x.withColumns({f"p{j}": e for j, e in enumerate(ops[m] for m in CANDIDATES)})
    x = x.where(masked)
    scored = x.groupBy(*[q(c) for c in by]).agg(*[
        F.when(F.count(f"p{j}") == test, F.sqrt(F.avg(F.pow(F.col("v") - F.col(f"p{j}"), 2)))).alias(f"r{j}")
        for j in range(len(CANDIDATES))])
    return scored.select(*[q(c) for c in by], F.inline(F.array(*[
        F.struct(F.lit(m.value).alias("method"), F.lit(j).alias("position"), F.col(f"r{j}").alias("rmse"))
        for j, m in enumerate(CANDIDATES)])))


def choose_imputation(scores: DataFrame, columns: Sequence[str], cfg: CleaningConfig = CleaningConfig(),
                      keys: Sequence[str] = ()) -> DataFrame:
    """C4 decision: smallest non-null RMSE, earlier candidate on ties; the
    configured default (and an infinite score) when nothing scored. With
    ``keys`` one decision per key and column that has a score."""
    if keys:
        return (scores.where(F.col("rmse").isNotNull()).groupBy(*[q(k) for k in keys], "column_name")
                .agg(F.min(F.struct("rmse", "position", "method")).alias("b")).where(F.col("column_name").isin(list(columns)))
                .select(*[q(k) for k in keys], "column_name", F.col("b.method").alias("method"), F.col("b.rmse").alias("rmse")))
    best = (scores.where(F.col("rmse").isNotNull())
            .groupBy("column_name").agg(F.min_by(F.struct("method", "rmse"), F.struct("rmse", "position")).alias("b")))
    all_cols = scores.sparkSession.createDataFrame([(c,) for c in columns], "column_name string") if columns else None
    if all_cols is None:
        return best.select("column_name", F.col("b.method").alias("method"), F.col("b.rmse").alias("rmse"))
    return all_cols.join(best, "column_name", "left").select(
        "column_name",
        F.coalesce(F.col("b.method"), F.lit(cfg.default_imputation.value)).alias("method"),
        F.coalesce(F.col("b.rmse"), F.lit(float("inf"))).alias("rmse"),
    )


def find_best_imputation_method(df: DataFrame, column: str, s: Series, cfg: CleaningConfig = CleaningConfig(),
                                policy: str = "reference") -> tuple[ImputationMethod, float]:
    row = choose_imputation(imputation_scores(df, [column], s, cfg, policy=policy), [column], cfg).first()
    return ImputationMethod(row["method"]), row["rmse"]


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def fill_missing_values(df: DataFrame, s: Series, columns: Sequence[str] | None = None,
                        auto_select_method: bool = True, cfg: CleaningConfig = CleaningConfig(),
                        methods: dict | None = None, materialize: bool = True,
                        policy: str = "reference") -> tuple[DataFrame, dict[str, str]]:
    """Impute every numeric column that has nulls, each with the chosen
    (or default, or given) method, all in one shared framing. Returns the
    filled frame and the method used per column.

    The null counts, the method scores and the ranking each read the input;
    ``materialize`` writes it once to the checkpoint folder first so an
    expensive upstream (parsing, aggregation) runs once."""
    if materialize:
        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
    if columns is None:
        columns = numeric_columns(df, exclude=[*s.keys, *s.order_by])
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df, {}
    stats_row = df.agg(*[F.count_if(q(c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)],
                       *[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    todo = [c for i, c in enumerate(columns) if stats_row[f"m{i}"] > 0]
    counts = {c: stats_row[f"n{i}"] for i, c in enumerate(columns)}
    if not todo:
        return df, {}
    chosen: dict[str, str] = {}
    if methods:
        chosen.update({c: ImputationMethod(m).value for c, m in methods.items() if c in todo})
    rest = [c for c in todo if c not in chosen]
    if rest and auto_select_method and s.keys:
        given = [imputation_op(c, chosen[c], cfg.rolling_window) for c in todo if c in chosen]
        out = _filled_by_key(apply_series(df, s, given), rest, s, cfg, policy)
        return out, chosen | {c: "by key" for c in rest}
    if rest and auto_select_method:
        for r in choose_imputation(imputation_scores(df, rest, s, cfg, counts, policy), rest, cfg).collect():
            chosen[r["column_name"]] = r["method"]
    for c in rest:
        chosen.setdefault(c, cfg.default_imputation.value)
    ops = [imputation_op(c, chosen[c], cfg.rolling_window) for c in todo]
    return apply_series(df, s, ops), chosen


def _filled_by_key(df: DataFrame, columns: Sequence[str], s: Series, cfg: CleaningConfig, policy: str) -> DataFrame:
    """Each key's nulls filled by the key's own choice: all candidate fills in
    one framing, then the choices (one row per key) joined on the keys."""
    best = choose_imputation(imputation_scores(df, columns, s, cfg, policy=policy), columns, cfg, s.keys)
    best = best.groupBy(F.struct(*[q(k) for k in s.keys]).alias("__key")).agg(
        F.map_from_entries(F.collect_list(F.struct("column_name", "method"))).alias("__methods"))
    ops = [replace(imputation_op(c, m, cfg.rolling_window), name=f"__fill_{i}_{j}") for i, c in enumerate(columns) for j, m in enumerate(CANDIDATES)]
    x = apply_series(df, s, ops).withColumn("__key", F.struct(*[q(k) for k in s.keys])).join(best, "__key", "left")
    filled = {}
    for i, c in enumerate(columns):
        method = F.coalesce(F.try_element_at("__methods", F.lit(c)), F.lit(cfg.default_imputation.value))
        value = F.lit(None)
        for j, m in enumerate(CANDIDATES):
            value = F.when(method == m.value, F.col(f"__fill_{i}_{j}")).otherwise(value)
        filled[c] = value
    return x.withColumns(filled).select(*[q(c) for c in df.columns])


# ------------------------------------------------------------ C8-C11


@dataclass
class CleaningReport:
    original_rows: int
    final_rows: int
    columns_converted: list[str]
    missing_values_filled: dict[str, int]
    outliers_handled: dict[str, int] = field(default_factory=dict)
    duplicates_removed: int = 0
    errors: list[str] = field(default_factory=list)
    methods: dict[str, str] = field(default_factory=dict)

    def to_dict(self) -> dict:
        return {
            "original_rows": self.original_rows,
            "final_rows": self.final_rows,
            "rows_removed": self.original_rows - self.final_rows,
            "columns_converted": self.columns_converted,
            "missing_values_filled": self.missing_values_filled,
            "outliers_handled": self.outliers_handled,
            "duplicates_removed": self.duplicates_removed,
            "errors": self.errors,
        }

    def to_frame(self, spark: SparkSession) -> DataFrame:
        d = self.to_dict()
        return spark.createDataFrame([(
            d["original_rows"], d["final_rows"], d["rows_removed"], d["columns_converted"],
            d["missing_values_filled"], d["outliers_handled"], d["duplicates_removed"], d["errors"])],
            "original_rows long, final_rows long, rows_removed long, columns_converted array<string>, "
            "missing_values_filled map<string,long>, outliers_handled map<string,long>, "
            "duplicates_removed long, errors array<string>")


INGEST_ORDER = "_ingest_order"


def clean_table(df: DataFrame, auto_impute: bool = True, date_column: str = C.DATE_COLUMN,
                cfg: CleaningConfig = CleaningConfig(), order_by: Sequence[str] | None = None,
                remove_dupes: bool = True, report: bool = True, block_rows: int = 1_000_000,
                methods: dict[str, str] | None = None, policy: str = "reference",
                outliers: str | None = None, outlier_threshold: float | None = None,
                outlier_action: str = "null") -> tuple[DataFrame, CleaningReport | None]:
    """Parse the timestamp, convert strings to numbers, keep the first
    row per timestamp (ingest order; without a timestamp: of equal rows),
    treat outliers, impute, sort by timestamp. Runs jobs when it reports,
    imputes or treats outliers.

    ``order_by`` is the ingest order for "first"; by default the loader's
    ``_ingest_order`` column, which is dropped from the result. It also
    orders the imputation of a table without the timestamp column; without
    either, imputation raises. ``methods``: imputation method by column, the
    others are chosen under ``policy``; with ``auto_impute`` off only those
    columns are imputed. ``outliers``: ``zscore`` or ``iqr``; flagged cells
    become null before imputation (``null``) or their rows go (``drop``).
    """
    has_date = date_column in df.columns
    ingest = list(order_by) if order_by else ([INGEST_ORDER] if INGEST_ORDER in df.columns else None)
    impute = auto_impute or bool(methods)
    if impute and not has_date and not ingest:
        raise ValueError(f"imputation needs an order: no column {date_column!r}, no order_by and no {INGEST_ORDER}")
    if outlier_action not in ("null", "drop"):
        raise ValueError(f"unknown outlier action {outlier_action!r}")
    original = df.count() if report else None
    if has_date:
        df = parse_datetime(df, date_column, cfg=cfg)
    df, converted = convert_to_numeric(df, date_column=date_column)
    if remove_dupes:
        subset = [date_column] if has_date else [c for c in df.columns if c != INGEST_ORDER]
        df, _ = remove_duplicates(df, subset, "first", ingest, count=False)
    series_order = (date_column,) if has_date else tuple(ingest or ())
    if INGEST_ORDER in df.columns and INGEST_ORDER not in series_order:
        df = df.drop(INGEST_ORDER)
    if report or impute or outliers:
        # the report counts and the choices (null counts, method scores, ranking)
        # are data-dependent; write the parsed, de-duplicated table once so each
        # reads it instead of re-parsing
        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
    deduped = df.count() if report else None
    numbers = numeric_columns(df, [date_column])
    handled: dict = {}
    if outliers:
        df, handled = treat_outliers(df, numbers, outliers, outlier_threshold, outlier_action, cfg)
    used: dict = {}
    filled: dict = {}
    if impute:
        s = Series(order_by=series_order, block_rows=block_rows)
        before = None
        if report:
            before = df.agg(*[F.count_if(q(c).isNull()).alias(c) for c in numbers]).first()
        columns = None if auto_impute else [c for c in numbers if c in methods]
        df, used = fill_missing_values(df, s, columns, cfg=cfg, methods=methods, materialize=False, policy=policy)
        if report and used:
            after = df.agg(*[F.count_if(q(c).isNull()).alias(c) for c in used]).first()
            filled = {c: int(before[c] - after[c]) for c in used}
    if INGEST_ORDER in df.columns:
        df = df.drop(INGEST_ORDER)
    if has_date:
        df = df.orderBy(q(date_column).asc_nulls_first())
    rep = None
    if report:
        removed = (original - deduped) if remove_dupes else 0
        gone = handled.pop("__rows", 0)
        rep = CleaningReport(original, deduped - gone, converted, filled, handled, int(removed), [], used)
    return df, rep


def treat_outliers(df: DataFrame, columns: Sequence[str], method: str, threshold: float | None = None,
                   action: str = "null", cfg: CleaningConfig = CleaningConfig()) -> tuple[DataFrame, dict[str, int]]:
    """Null the flagged cells of ``columns``, or drop the rows that have any.
    Returns the number of flagged cells per column (and of dropped rows under
    ``__rows``); flags follow from the untreated columns."""
    flags = {c: f"__outlier_{i}" for i, c in enumerate(columns)}
    flagged = df
    for c, name in flags.items():
        flagged = detect_outliers(flagged, c, method, threshold, cfg, name)
    any_flag = F.greatest(*[F.coalesce(F.col(n), F.lit(False)) for n in flags.values()]) if len(flags) > 1 else F.lit(False)
    if len(flags) == 1:
        any_flag = F.coalesce(F.col(next(iter(flags.values()))), F.lit(False))
    counts = flagged.agg(*[F.count_if(F.col(n)).alias(n) for n in flags.values()], F.count_if(any_flag).alias("__rows")).first()
    handled = {c: int(counts[n]) for c, n in flags.items() if counts[n]}
    if action == "drop":
        handled["__rows"] = int(counts["__rows"])
        return flagged.where(~any_flag).select(*[q(c) for c in df.columns]), handled
    cells = {c: F.when(~F.coalesce(F.col(n), F.lit(False)), q(c)) for c, n in flags.items()}
    return flagged.withColumns(cells).select(*[q(c) for c in df.columns]), handled


def clean_auction_data(df: DataFrame, auto_impute: bool = True, cfg: CleaningConfig = CleaningConfig(),
                       **kw) -> tuple[DataFrame, CleaningReport | None]:
    """C8 under its familiar name."""
    return clean_table(df, auto_impute, cfg=cfg, **kw)


def clean_forecast_data(df: DataFrame, auto_impute: bool = True, cfg: CleaningConfig = CleaningConfig(),
                        **kw) -> tuple[DataFrame, CleaningReport | None]:
    """The same steps as the auction table."""
    return clean_table(df, auto_impute, cfg=cfg, **kw)


def clean_system_prices(df: DataFrame, auto_impute: bool = True, cfg: CleaningConfig = CleaningConfig(),
                        **kw) -> tuple[DataFrame, CleaningReport | None]:
    """The same steps as the auction table."""
    return clean_table(df, auto_impute, cfg=cfg, **kw)


get_missing_value_stats = missing_value_stats
calculate_data_quality_score = data_quality_score
