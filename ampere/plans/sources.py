"""Source/sink and merge queries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from .. import config as C
from ..functions.scalar import lenient_double
from ..operators import clean, stats
from ..operators.features import merge_datasets
from ..sources import csv as src
from ..sources.driver_tables import table
from .cleaning import choice_sql, filled_sql
from .common import QD, D, F1, P1, P2, SH, SL, SP, V1, V2, mv, scratch, sql_with_mv
from .registry import register

AUCTION = [D, P1, P2, V1, V2, F1]
SYSTEM = [D, SP, SL, SH]
# The units row of the auction file.
AUCTION_UNITS = {P1: "GBP/MWh", P2: "GBP/MWh", V1: "MW", V2: "MW", F1: "GBP/MWh"}


def _roundtrip(spark, sf):
    """Write the auction slice of the market view as a market file (units
    row, bracketed day-first stamps, decimal commas), read it back."""
    path = scratch(spark, "auction_csv")
    src.write_market_file(mv(spark, sf).select(*[F.col(f"`{c}`") for c in AUCTION]), path, AUCTION_UNITS)
    return src.load_auction_data(spark, path)


AUCTION_SQL = sql_with_mv(f"SELECT {QD}, {P1}, {P2}, {V1}, {V2}, {F1} FROM mv")


@register("csv_roundtrip_clean", AUCTION_SQL)
def csv_roundtrip_clean(spark, sf):
    """S1/S2/S9 + C1/C2/C8: units row dropped, stamps parsed, decimal commas
    converted, first row per stamp kept, sorted -- equal to the source."""
    raw = _roundtrip(spark, sf)
    cleaned, _ = clean.clean_table(raw, auto_impute=False, report=False)
    return cleaned


AUCTION_NUMERIC = [P1, P2, V1, V2, F1]


@register("csv_clean_imputed", sql_with_mv(filled_sql(AUCTION, AUCTION_NUMERIC),
                                           f"choice AS ({choice_sql(AUCTION_NUMERIC)})"), rounded=AUCTION_NUMERIC)
def csv_clean_imputed(spark, sf):
    """C8 end to end on the market file: parse, convert, keep the first row
    per stamp, choose and apply an imputation per column, sort."""
    cleaned, _ = clean.clean_table(_roundtrip(spark, sf), auto_impute=True, report=False)
    return cleaned


@register("csv_units_row", sql_with_mv(f"""SELECT strftime({QD}, '[%d/%m/%Y %H:%M]') AS stamp,
  CAST({V1} AS BIGINT) AS volume, COALESCE({P1}, 0) AS price FROM mv"""), rounded=["price"])
def csv_units_row(spark, sf):
    """The data rows survive the units-row filter, each with its text."""
    raw = _roundtrip(spark, sf)
    number = lambda c: F.coalesce(lenient_double(c), F.lit(0.0))
    return raw.select(F.col(f"`{D}`").alias("stamp"), number(V1).cast("long").alias("volume"), number(P1).alias("price"))


@register("csv_skip_rows", "SELECT event_id, event_type, value FROM events")
def csv_skip_rows(spark, sf):
    """Several files, each with two lines before its header."""
    ev = table(spark, sf, "events").select(F.concat_ws(";", "event_id", "event_type", F.coalesce(F.col("value").cast("string"), F.lit(""))).alias("value"))

    def with_head(batches):
        head = ["exported;2024", "two lines before the header", "event_id;event_type;value"]
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(head, batch.schema.field(0).type)], schema=batch.schema)
                head = []
            yield batch

    path = scratch(spark, "skip_csv")
    ev.repartition(5).mapInArrow(with_head, "value string").write.text(path)
    raw = src.load_csv(spark, path, skip_rows=2)
    return raw.select(F.col("event_id").cast("long").alias("event_id"), "event_type", lenient_double("value").alias("value"))


FORECAST_UNITS = {"demand": "MW", "wind": "%"}
SYSTEM_UNITS = {SP: "GBP/MWh", SL: "GBP/MWh", SH: "GBP/MWh"}


def _directory(spark, sf):
    """The three market files of one directory, as text."""
    base = scratch(spark, "market_dir")
    m = mv(spark, sf)
    tables = {"auction_data": (AUCTION, AUCTION_UNITS), "system_prices": (SYSTEM, SYSTEM_UNITS)}
    files = {"auction_data": C.AUCTION_FILE, "forecast_inputs": C.FORECAST_FILE, "system_prices": C.SYSTEM_FILE}
    for name, (columns, units) in tables.items():
        src.write_market_file(m.select(*[F.col(f"`{c}`") for c in columns]), f"{base}/{files[name]}", units)
    forecast = m.select(F.col(f"`{D}`"), (F.col(V1) + F.col(V2)).alias("demand"), F.try_divide(F.col(V1), F.col(V2)).alias("wind"))
    src.write_market_file(forecast, f"{base}/{files['forecast_inputs']}", FORECAST_UNITS)
    return src.load_all_from_directory(spark, base)


@register("csv_forecast_clean", sql_with_mv(f"SELECT {QD}, {V1} + {V2} AS demand, {V1} / NULLIF({V2}, 0) AS wind FROM mv"),
          rounded=["wind"])
def csv_forecast_clean(spark, sf):
    """The forecast file of a directory, loaded and cleaned."""
    return clean.clean_forecast_data(_directory(spark, sf).forecast_inputs, auto_impute=False, report=False)[0]


@register("csv_system_clean", sql_with_mv(f"SELECT {QD}, {SP}, {SL}, {SH} FROM mv"))
def csv_system_clean(spark, sf):
    """The system-price file of a directory, loaded and cleaned."""
    return clean.clean_system_prices(_directory(spark, sf).system_prices, auto_impute=False, report=False)[0]


@register("csv_directory_summary", sql_with_mv("""SELECT name, COUNT(*) AS rows, width AS columns, TRUE AS valid FROM mv,
  (VALUES ('auction_data', 6), ('forecast_inputs', 3), ('system_prices', 4)) t(name, width) GROUP BY name, width"""))
def csv_directory_summary(spark, sf):
    """Rows and width of every table of a directory."""
    found = _directory(spark, sf)
    rows = [(n, t["rows"], t["columns"], found.is_valid) for n, t in found.get_summary().items()]
    return spark.createDataFrame(rows, "name string, rows long, columns int, valid boolean")


@register("csv_clean_report", sql_with_mv(f"""
  SELECT COUNT(*) AS original_rows, COUNT(*) AS final_rows, 0 AS rows_removed, 0 AS duplicates_removed,
         5 AS columns_converted, {', '.join(f"COUNT(*) - COUNT({c}) - COUNT(CASE WHEN i < f_{c} THEN 1 END) AS filled_{c}" for c in (P1, P2, F1))}
  FROM (SELECT *, {', '.join(f"MIN(CASE WHEN {c} IS NOT NULL THEN i END) OVER () AS f_{c}" for c in (P1, P2, F1))}
        FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {QD}) AS i FROM mv) a) b"""))
def csv_clean_report(spark, sf):
    """The cleaning report of the round trip with forward fill, which
    leaves only the cells before a column's first value."""
    raw = _roundtrip(spark, sf)
    fill = {c: "forward_fill" for c in (P1, P2, F1)}
    _, rep = clean.clean_table(raw, auto_impute=False, methods=fill, report=True)
    d = rep.to_dict()
    return spark.range(1).select(
        *[F.lit(d[k]).cast("long").alias(k) for k in ("original_rows", "final_rows")],
        *[F.lit(d[k]).cast("int").alias(k) for k in ("rows_removed", "duplicates_removed")],
        F.lit(len(d["columns_converted"])).cast("int").alias("columns_converted"),
        *[F.lit(d["missing_values_filled"].get(c, 0)).cast("long").alias(f"filled_{c}") for c in fill])


@register("clean_outliers", sql_with_mv(f"""SELECT {QD}, CASE WHEN ABS(({P1} - m1) / s1) > 2 THEN NULL ELSE {P1} END AS {P1},
  CASE WHEN ABS(({P2} - m2) / s2) > 2 THEN NULL ELSE {P2} END AS {P2}
  FROM mv, (SELECT AVG({P1}) AS m1, STDDEV_SAMP({P1}) AS s1, AVG({P2}) AS m2, STDDEV_SAMP({P2}) AS s2 FROM mv) s"""),
          rounded=[P1, P2])
def clean_outliers(spark, sf):
    """C6 within C8: cells over two standard deviations become null."""
    path = scratch(spark, "outlier_csv")
    src.write_market_file(mv(spark, sf).select(F.col(f"`{D}`"), P1, P2), path, AUCTION_UNITS)
    return clean.clean_table(src.load_auction_data(spark, path), False, report=False, outliers="zscore", outlier_threshold=2.0)[0]


@register("csv_export_roundtrip", sql_with_mv(f"SELECT {QD}, {P1}, {P2} FROM mv"))
def csv_export_roundtrip(spark, sf):
    """Export with a header, read back and re-typed."""
    path = scratch(spark, "export_csv")
    src.write_csv(mv(spark, sf).select(F.col(f"`{D}`"), P1, P2), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col(f"`{D}`").cast("timestamp_ntz").alias(D), F.col(P1).cast("double").alias(P1),
                       F.col(P2).cast("double").alias(P2))


# ------------------------------------------------------------------ merge

SIGNUP = "signup"


def _forecast_slice(spark, sf):
    ev = table(spark, sf, "events").where(F.col("event_type") == SIGNUP)
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias(D)
    pence = F.round(F.col("value") * 100).cast("long")
    return ev.groupBy(hour).agg(
        F.count(F.lit(1)).cast("double").alias("demand"),
        F.try_divide(F.sum(pence).cast("double"), F.count(pence).cast("double") * F.lit(100.0)).alias(P1))


MERGE_SQL = sql_with_mv(f"""
  SELECT a.{QD}, a.{P1}, a.{P2}, a.{V1}, a.{V2}, a.{F1}, f.demand, f.{P1} AS {P1}_right, s.{SP}, s.{SL}, s.{SH}
  FROM mv a
  LEFT JOIN (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS {QD}, CAST(COUNT(*) AS DOUBLE) AS demand,
                    CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS DOUBLE) / (CAST(COUNT(*) AS DOUBLE) * 100.0) AS {P1}
             FROM events WHERE event_type = '{SIGNUP}' GROUP BY 1) f ON f.{QD} = a.{QD}
  LEFT JOIN (SELECT {QD}, {SP}, {SL}, {SH} FROM mv WHERE {SP} IS NOT NULL) s ON s.{QD} = a.{QD}""")


@register("merge_left", MERGE_SQL)
def merge_left(spark, sf):
    """Auction left-joined with forecast inputs and system prices on
    the timestamp; the clashing forecast column gets the _right suffix."""
    m = mv(spark, sf)
    auction = m.select(*[F.col(f"`{c}`") for c in AUCTION])
    system = m.where(F.col(SP).isNotNull()).select(*[F.col(f"`{c}`") for c in SYSTEM])
    return merge_datasets(auction, _forecast_slice(spark, sf), system, D)


# ---------------------------------------------------------------- S11/S12


@register("home_summary", sql_with_mv(f"""
  SELECT COUNT(*) AS rows, CAST({' + '.join(f'(COUNT(*) - COUNT({QD if c == D else c}))' for c in
                                 [D, P1, P2, V1, V2, F1, SP, SL, SH])} AS BIGINT) AS null_cells,
         AVG({P1}) AS mean_price, 9 AS columns,
         (1.0 - CAST({' + '.join(f'(COUNT(*) - COUNT({QD if c == D else c}))' for c in
                     [D, P1, P2, V1, V2, F1, SP, SL, SH])} AS DOUBLE) / (COUNT(*) * 9)) * 100 AS completeness
  FROM mv"""), rounded=["mean_price", "completeness"])
def home_summary(spark, sf):
    """Rows, width, completeness and mean first price."""
    return stats.home_summary(mv(spark, sf))


@register("preview_rows", """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
  ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def preview_rows(spark, sf):
    """A 100-row preview (the limit is the feature) of an ordered table."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return stats.preview(orders.orderBy(F.desc("o_totalprice"), "o_orderkey"), 100)
