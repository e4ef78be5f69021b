"""Delimited market files.

Files are read all-string (a units row under the header would make every
column a string anyway); cleaning converts them. Each row carries
``_ingest_order`` = (file, split start, position) so "keep the first
duplicate" means the first in the file, as in the reference.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.scalar import lenient_double, parse_timestamp
from ..operators.clean import INGEST_ORDER


def _ingest(df: DataFrame) -> DataFrame:
    return df.withColumn(INGEST_ORDER, F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("pos")))


def load_csv(spark: SparkSession, path: str | Sequence[str], delimiter: str = ";", skip_rows: int = 0,
             **options) -> DataFrame:
    """Header row, all columns as strings, plus ``_ingest_order``.

    ``skip_rows`` lines before the header are dropped per file: only the
    split at a file's beginning counts its lines, the others stream past, so
    nothing is shuffled. The reader options apply to the lines; empty lines
    after the header are left out; all files must share one header (compared
    when called, by one pass over the lines where there are several files),
    and the skipped lines must lie in a file's first split."""
    paths = [path] if isinstance(path, str) else list(path)
    if skip_rows <= 0:
        reader = spark.read.option("sep", delimiter).option("header", True).option("inferSchema", False)
        for k, v in options.items():
            reader = reader.option(k, v)
        return _ingest(reader.csv(paths))
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("pos"))
    first = lines.select("file").limit(1).collect()
    head = lines.where((F.col("file") == first[0]["file"]) & (F.col("start") == 0)).select("value").take(skip_rows + 1) if first else []
    if len(head) <= skip_rows:
        raise ValueError("no header line after the skipped rows")
    header = head[skip_rows]["value"]
    names = [n.strip('"') for n in header.split(delimiter)]
    ddl = ", ".join(f"`{n}` string" for n in names)

    def first_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
        """Batches with the rows of the lines up to the header, each with its
        number in its file; lines of a split come one after the other."""
        at, seen = None, 0  # the file whose first split is being read, its lines so far
        for batch in batches:
            files, starts, found = batch.column("file"), np.asarray(batch.column("start")), []
            row = 0
            while row < batch.num_rows:
                if starts[row] == 0:
                    file = files[row].as_py()
                    at, seen = (at, seen) if file == at else (file, 0)
                    if seen <= skip_rows:
                        found.append((row, seen))
                    elif files[batch.num_rows - 1].as_py() == file and starts[-1] == 0:
                        break  # the rest of the batch lies in the same split
                    seen += 1
                row += 1
            yield batch, found

    def headers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in first_lines(batches):
            rows = [row for row, number in found if number == skip_rows]
            yield pa.RecordBatch.from_arrays([batch.column("file").take(pa.array(rows, pa.int64())), batch.column("value").take(pa.array(rows, pa.int64()))], ["file", "value"])

    def body(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in first_lines(batches):
            keep = np.asarray(pc.greater(pc.binary_length(batch.column("value")), 0)).copy()
            keep[[row for row, _ in found]] = False
            yield batch.filter(pa.array(keep))

    files = lines.inputFiles()
    if len(files) > 1:
        heads = lines.mapInArrow(headers, "file string, value string")
        other = heads.where(F.col("value") != header).select("value").first()
        if other is not None:
            raise ValueError(f"files with different headers; load them one by one: {header!r}, {other['value']!r}")
    kept = lines.mapInArrow(body, lines.schema)
    parsed = kept.select(F.from_csv("value", ddl, {"sep": delimiter, **{k: str(v) for k, v in options.items()}}).alias("r"),
                         F.struct("file", "start", "pos").alias(INGEST_ORDER))
    return parsed.select(*[F.col("r")[n].alias(n) for n in names], INGEST_ORDER)


def drop_units_row(df: DataFrame, tokens: Sequence[str], date_column: str = C.DATE_COLUMN) -> DataFrame:
    """Drop the units record under the header: one where a cell holds a
    unit token and the date cell is no date (without a date column: no cell
    is a number). One pass, no join: it depends on the record alone."""
    cells = [F.col(f"`{c}`") for c in df.columns if c != INGEST_ORDER]
    token, number = F.lit(False), F.lit(False)
    for cell in cells:
        number = number | lenient_double(cell).isNotNull()
        for t in tokens:
            token = token | F.coalesce(cell.contains(t), F.lit(False))
    units = parse_timestamp(F.col(f"`{date_column}`")).isNull() if date_column in df.columns else ~number
    return df.where(~(token & units))


def load_auction_data(spark: SparkSession, path: str, delimiter: str = ";") -> DataFrame:
    return drop_units_row(load_csv(spark, path, delimiter), C.AUCTION_UNIT_TOKENS)


def load_forecast_inputs(spark: SparkSession, path: str, delimiter: str = ";") -> DataFrame:
    return drop_units_row(load_csv(spark, path, delimiter), C.FORECAST_UNIT_TOKENS)


def load_system_prices(spark: SparkSession, path: str, delimiter: str = ";") -> DataFrame:
    return drop_units_row(load_csv(spark, path, delimiter), C.SYSTEM_UNIT_TOKENS)


@dataclass
class DataLoadResult:
    """The three tables plus what went wrong."""

    auction_data: DataFrame | None = None
    forecast_inputs: DataFrame | None = None
    system_prices: DataFrame | None = None
    errors: dict = field(default_factory=dict)
    warnings: list = field(default_factory=list)

    @property
    def is_valid(self) -> bool:
        return self.auction_data is not None and not self.errors

    def tables(self) -> dict[str, DataFrame]:
        return {k: v for k, v in (("auction_data", self.auction_data), ("forecast_inputs", self.forecast_inputs),
                                  ("system_prices", self.system_prices)) if v is not None}

    def get_summary(self) -> dict:
        """Rows (one count job per table), width and column names."""
        return {k: {"rows": v.count(), "columns": len([c for c in v.columns if c != INGEST_ORDER]),
                    "column_names": [c for c in v.columns if c != INGEST_ORDER]} for k, v in self.tables().items()}


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


_LOADERS = {"auction_data": load_auction_data, "forecast_inputs": load_forecast_inputs,
            "system_prices": load_system_prices}


def load_tables(spark: SparkSession, paths: dict[str, str], delimiter: str = ";") -> DataLoadResult:
    """Any subset of the three tables; a missing auction file is an
    error, missing optional files are warnings; each table's error is kept."""
    res = DataLoadResult()
    for name, loader in _LOADERS.items():
        p = paths.get(name)
        if p is None or not path_exists(spark, p):
            if name == "auction_data":
                res.errors[name] = f"auction data not found: {p}"
            else:
                res.warnings.append(f"{name} not found: {p}")
            continue
        try:
            setattr(res, name, loader(spark, p, delimiter))
        except Exception as e:  # noqa: BLE001 - reported per table, like the reference
            res.errors[name] = str(e)
    return res


def load_all_from_directory(spark: SparkSession, directory: str, delimiter: str = ";") -> DataLoadResult:
    d = directory.rstrip("/")
    return load_tables(spark, {"auction_data": f"{d}/{C.AUCTION_FILE}",
                               "forecast_inputs": f"{d}/{C.FORECAST_FILE}",
                               "system_prices": f"{d}/{C.SYSTEM_FILE}"}, delimiter)


def validate_dataframe(df: DataFrame, required_columns: Sequence[str], name: str = "") -> tuple[bool, list[str]]:
    """(all present, missing names)."""
    missing = [c for c in required_columns if c not in df.columns]
    return not missing, missing


def write_csv(df: DataFrame, path: str, delimiter: str = ",", mode: str = "overwrite") -> None:
    """Every row with a header, written by the executors."""
    out = df.drop(INGEST_ORDER) if INGEST_ORDER in df.columns else df
    out.write.mode(mode).option("header", True).option("sep", delimiter).csv(path)


# ------------------------------------------------------------ fixture writer


def write_market_file(df: DataFrame, path: str, units: dict[str, str], date_column: str = C.DATE_COLUMN,
                      decimal_comma: bool = True, brackets: bool = True) -> None:
    """Write a table in the market-file layout: ``;`` separated, header,
    units row, ``[dd/mm/yyyy HH:MM]`` stamps, decimal commas. Each output
    file (one per partition) starts with its own header and units row."""
    cols = list(df.columns)
    fields = []
    for c in cols:
        if c == date_column:
            s = F.date_format(F.col(f"`{c}`"), "dd/MM/yyyy HH:mm")
            if brackets:
                s = F.concat(F.lit("["), s, F.lit("]"))
        else:
            s = F.col(f"`{c}`").cast("string")
            if decimal_comma:
                s = F.regexp_replace(s, r"\.", ",")
        fields.append(F.coalesce(s, F.lit("")))
    head = ";".join(cols)
    unit_line = ";".join(units.get(c, "") for c in cols)
    line = F.concat_ws(";", *fields)
    # the two lines go before the first row of each partition, which writes one file
    in_partition = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = df.select(F.explode(F.when(in_partition == 0, F.array(F.lit(head), F.lit(unit_line), line)).otherwise(F.array(line))).alias("value"))
    lines.write.mode("overwrite").text(path)
