"""Ordered-series operators (lags, rolling statistics, fills, running sums).

Every ordered operator is described by a :class:`Series`: the columns that
order a series (a total order; add tie-break columns), and optional key
columns that split the data into independent series.

Two physical shapes, both plain Spark windows:

* **keyed** -- ``Window.partitionBy(keys).orderBy(order)``. One shuffle on the
  keys. Used when every key holds at most ``max_key_rows`` rows (checked with
  one partial aggregation, never assumed).
* **blocked** -- for one key-less series, or when a key is hot. Rows get a
  global 0-based position: the input is range-partitioned on
  ``(keys, order)``, written once to the reliable checkpoint folder so the
  partition layout survives executor loss, and positions are
  ``offset(partition) + position in partition`` with offsets from a running
  sum over one count per partition. Positions are cut into equal blocks of
  ``block_rows`` rows; the last ``reach`` rows of each block are copied into
  the next block as a halo so bounded frames (lags, rolling windows) see
  their true predecessors; windows run ``partitionBy(block, keys)``.
  Unbounded frames (fills, running sums) combine the in-block result with a
  carry from earlier/later blocks, computed over one summary row per
  ``(block, key)``. Blocks have equal size by construction, so a hot key or
  a single global series never lands in one task.

Windows are dealt to a number of tasks that follows the measured rows
(``_TASK_ROWS`` each), so a task's memory does not grow with the input.

Rolling frames of 64 rows and more take linear time: rows fall into runs of the
frame's length, so a frame is the end of one run and the beginning of the next,
and both come from running aggregates (no frame is read again for every row, and
nothing is ever subtracted). A rolling median that only fills nulls streams the
sorted rows past and gathers the frames of null cells alone; so do look-backs of
64 rows and more, whose frames are then copied and not collected row by row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import accumulate
from typing import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, send_package

IDX = "__ampere_idx"
BLK = "__ampere_blk"
HALO = "__ampere_halo"
KEY = "__ampere_key"
PID = "__ampere_pid"
POS = "__ampere_pos"
OFF = "__ampere_off"
POSN, RUN = "__ampere_posn", "__ampere_run"
_MAX_BROADCAST_PARTITIONS = 1_000_000
#: rows that one task's windows get on average at most (its chained sorts all hold them), and at least where cores are free
_TASK_ROWS, _LEAST_ROWS = 250_000, 10_000


def _tuple(x) -> tuple[str, ...]:
    if x is None:
        return ()
    if isinstance(x, str):
        return (x,)
    return tuple(x)


@dataclass(frozen=True)
class Series:
    """How rows form ordered series.

    order_by: columns giving a total order inside a series (ascending, nulls first).
    keys: columns identifying independent series; empty = one global series.
    block_rows: rows per block in the blocked shape (largest lag/frame must fit).
    max_key_rows: largest key that may use a plain keyed window.
    strategy: "auto", "keyed" or "blocked".
    """

    order_by: tuple[str, ...]
    keys: tuple[str, ...] = ()
    block_rows: int = 250_000
    max_key_rows: int = 500_000
    strategy: str = "auto"

    def __post_init__(self):
        object.__setattr__(self, "order_by", _tuple(self.order_by))
        object.__setattr__(self, "keys", _tuple(self.keys))
        if not self.order_by:
            raise ValueError("a series needs at least one order column")
        if self.strategy not in ("auto", "keyed", "blocked"):
            raise ValueError(f"unknown strategy {self.strategy!r}")

    def with_(self, **kw) -> "Series":
        d = dict(order_by=self.order_by, keys=self.keys, block_rows=self.block_rows,
                 max_key_rows=self.max_key_rows, strategy=self.strategy)
        d.update(kw)
        return Series(**d)


# --------------------------------------------------------------------------- ops


@dataclass(frozen=True)
class Lag:
    """Value ``n`` rows back in the series."""

    column: str
    n: int
    name: str

    reach = property(lambda self: self.n)
    unbounded = False

    def expr(self, ctx: "_Ctx") -> Column:
        return F.lag(F.col(self.column), self.n).over(ctx.w)


_STATS = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
}


#: frames from this length on are put together from runs of rows
_LONG_FRAME = 64
#: running aggregates that each statistic of a frame is put together from
_PARTS = {"mean": ("count", "mean"), "std": ("count", "mean", "squares"), "min": ("min",), "max": ("max",), "sum": ("sum",)}
_PART = {"count": F.count, "mean": F.avg, "squares": F.var_pop, "min": F.min, "max": F.max, "sum": F.sum}


def _running(part: str, c: Column, over: WindowSpec) -> Column:
    """A running aggregate; ``squares``: the sum of squared deviations."""
    value = _PART[part](c).over(over)
    return value * F.count(c).over(over) if part == "squares" else value


@dataclass(frozen=True)
class Rolling:
    """Statistic over the trailing ``n`` rows (current row included
    unless ``exclude_current``); null while fewer than ``min_periods``
    non-null values are in the frame (default: ``n``)."""

    column: str
    n: int
    stat: str
    name: str
    min_periods: int | None = None
    exclude_current: bool = False
    fill_only: bool = False  # keep non-null cells, fill nulls with the statistic

    @property
    def reach(self) -> int:
        return self.n if self.exclude_current else self.n - 1

    unbounded = False

    @property
    def of_gaps(self) -> bool:
        """A median that only null cells need."""
        return self.stat == "median" and self.fill_only

    @property
    def by_runs(self) -> bool:
        """Frames long enough for running aggregates over runs of rows."""
        return self.n >= _LONG_FRAME and self.stat in _PARTS

    def expr(self, ctx: "_Ctx") -> Column:
        c = F.col(self.column)
        need = self.n if self.min_periods is None else self.min_periods
        inside = self.from_runs(ctx) if self.by_runs else _STATS[self.stat](c).over(self.frame(ctx))
        value = F.when(F.col(self.count_name) >= need, inside)
        return F.coalesce(c, value) if self.fill_only else value

    @property
    def gap_name(self) -> str:
        return f"__gap_{self.column}_{self.n}_{int(self.exclude_current)}_{self.min_periods}"

    def part_name(self, part: str, side: str) -> str:
        return f"__{side}_{part}_{self.column}_{self.n}"

    def from_runs(self, ctx: "_Ctx") -> Column:
        """The end of one run and the beginning of the next, put together. A
        frame that ends with its run is that run alone."""
        back = int(self.exclude_current)
        begin = lambda p: F.lag(F.col(self.part_name(p, "begin")), back).over(ctx.w) if back else F.col(self.part_name(p, "begin"))
        whole = F.pmod(F.col(POSN) - back + 1, F.lit(self.n)) == 0
        end = lambda p: F.when(~whole, F.lag(F.col(self.part_name(p, "end")), self.n - 1 + back).over(ctx.w))
        if self.stat in ("min", "max"):
            return (F.least if self.stat == "min" else F.greatest)(begin(self.stat), end(self.stat))  # both skip nulls
        if self.stat == "sum":
            return F.when(begin("sum").isNotNull() | end("sum").isNotNull(), F.coalesce(begin("sum"), F.lit(0)) + F.coalesce(end("sum"), F.lit(0)))
        n1, n2 = (F.coalesce(x("count"), F.lit(0)).cast("double") for x in (end, begin))
        m1, m2 = (F.coalesce(x("mean"), F.lit(0.0)) for x in (end, begin))
        n, apart = n1 + n2, m2 - m1
        if self.stat == "mean":
            return F.when(n > 0, m1 + F.try_divide(apart * n2, n))
        squares = F.coalesce(end("squares"), F.lit(0.0)) + F.coalesce(begin("squares"), F.lit(0.0)) + F.try_divide(apart * apart * n1 * n2, n)
        return F.when(n > 1, F.sqrt(F.try_divide(squares, n - 1)))

    def frame(self, ctx: "_Ctx") -> WindowSpec:
        return ctx.w.rowsBetween(-self.n, -1) if self.exclude_current else ctx.w.rowsBetween(-(self.n - 1), 0)

    @property
    def count_name(self) -> str:
        """Non-null values in the frame: one column for all statistics over it."""
        return f"__n_{self.column}_{self.n}_{int(self.exclude_current)}"


@dataclass(frozen=True)
class Fill:
    """Forward fill, backward fill or linear interpolation by row
    position; non-null cells are kept."""

    column: str
    method: str  # "ffill" | "bfill" | "interpolate"
    name: str

    reach = 0
    unbounded = True

    def needs(self) -> tuple[bool, bool]:
        return (self.method in ("ffill", "interpolate"), self.method in ("bfill", "interpolate"))

    def expr(self, ctx: "_Ctx") -> Column:
        c = F.col(self.column)
        point = F.when(c.isNotNull(), F.struct(ctx.idx.alias("i"), c.alias("v")))  # in the column's own type
        prev = F.coalesce(
            F.last(point, ignorenulls=True).over(ctx.w.rowsBetween(Window.unboundedPreceding, 0)),
            ctx.carry(self.column, "prev"),
        )
        # running frame over the reversed order: O(n), where a frame reaching
        # to unboundedFollowing is re-aggregated for every row (O(n^2))
        nxt = F.coalesce(
            F.last(point, ignorenulls=True).over(ctx.w_rev.rowsBetween(Window.unboundedPreceding, 0)),
            ctx.carry(self.column, "next"),
        )
        if self.method == "ffill":
            return F.coalesce(c, prev["v"])
        if self.method == "bfill":
            return F.coalesce(c, nxt["v"])
        span = (nxt["i"] - prev["i"]).cast("double")
        before, after = prev["v"].cast("double"), nxt["v"].cast("double")
        interp = before + F.try_divide((after - before) * (ctx.idx - prev["i"]).cast("double"), span)
        return F.coalesce(c.cast("double"), interp)


@dataclass(frozen=True)
class RunningSum:
    """Sum of the column from the first row of the series to this row."""

    column: str
    name: str

    reach = 0
    unbounded = True

    def expr(self, ctx: "_Ctx") -> Column:
        c = F.col(self.column)
        own = c if ctx.halo is None else F.when(~ctx.halo, c)
        inside = F.sum(own).over(ctx.w.rowsBetween(Window.unboundedPreceding, 0))
        before = ctx.carry(self.column, "sum")
        # null only while the whole series so far is null (as a plain running sum)
        return F.when(before.isNotNull() | inside.isNotNull(),
                      F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0)))


@dataclass(frozen=True)
class Lookback:
    """The previous ``n`` rows' values (current row excluded) as an
    array of structs, oldest first; null until ``n`` rows exist, unless fewer
    are wanted too (``whole`` false). ``fold`` makes one double of each frame
    (an Arrow list array goes in), so that frames need not leave the worker."""

    columns: tuple[str, ...]
    n: int
    name: str
    whole: bool = True
    fold: Callable[[pa.ListArray], pa.Array] | None = None

    reach = property(lambda self: self.n)
    unbounded = False
    #: a frame that is copied from the rows that stream past
    streamed = property(lambda self: self.n >= _LONG_FRAME or self.fold is not None)

    def expr(self, ctx: "_Ctx") -> Column:
        seq = F.collect_list(F.struct(*[F.col(c) for c in self.columns])).over(ctx.w.rowsBetween(-self.n, -1))
        return F.when(F.size(seq) == self.n, seq) if self.whole else seq


@dataclass(frozen=True)
class RowIndex:
    """0-based position in the series."""

    name: str

    reach = 0
    unbounded = False

    def expr(self, ctx: "_Ctx") -> Column:
        return ctx.idx - ctx.key_start


# ----------------------------------------------------------------------- context


@dataclass
class _Ctx:
    w: WindowSpec
    w_rev: WindowSpec
    idx: Column
    key_start: Column
    halo: Column | None
    carries: dict = field(default_factory=dict)
    parts: list[Column] = field(default_factory=list)  # what the windows partition by

    def carry(self, column: str, kind: str) -> Column:
        name = self.carries.get((column, kind))
        if name is None:
            return F.lit(None)
        return F.col(name)


def _order_cols(s: Series) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in (*s.keys, *s.order_by)]


def _shape(df: DataFrame, s: Series) -> tuple[bool, int | None]:
    """The physical shape (``auto`` measures the largest key), and the rows if they were counted."""
    if s.strategy == "blocked" or not s.keys:
        return True, None
    if s.strategy == "keyed":
        return False, None
    size = df.groupBy(*s.keys).count().agg(F.max("count").alias("m"), F.sum("count").alias("n")).first()
    return (size["m"] or 0) > s.max_key_rows, size["n"] or 0


def use_blocked(df: DataFrame, s: Series) -> bool:
    """Decide the physical shape; ``auto`` measures the largest key."""
    return _shape(df, s)[0]


def _dealt(df: DataFrame, rows: int, by: Sequence[Column]) -> DataFrame:
    """``df`` hashed for windows over ``by`` to a number of tasks that follows
    its rows. AQE joins tasks by shuffled bytes, which say little of the rows
    that a chain of sorts holds; a number that is given stays."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(2, -(-rows // _TASK_ROWS), min(cores, -(-rows // _LEAST_ROWS))), *by)


def global_index(df: DataFrame, s: Series) -> DataFrame:
    """Append ``IDX``: 0-based position over ``(keys, order_by)``.

    One range shuffle, one checkpoint write, one small count job; no
    single-partition stage over the data.
    """
    return _placed(df, s)[0]


def _placed(df: DataFrame, s: Series) -> tuple[DataFrame, int]:
    """``global_index`` and the number of rows."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    order = _order_cols(s)
    # no explicit count: the range exchange uses spark.sql.shuffle.partitions and
    # AQE coalesces it to the advisory partition size before the layout is frozen
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint(eager=True)
    pid = F.spark_partition_id()
    local = F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)
    with_pos = ranged.select("*", pid.alias(PID), local.alias(POS))
    # one row per partition
    counts = ranged.groupBy(F.spark_partition_id().alias(PID)).agg(F.count(F.lit(1)).alias("n")).orderBy(PID).collect()
    before = [0, *accumulate(r["n"] for r in counts)]
    offsets = spark.createDataFrame([(r[PID], n) for r, n in zip(counts, before)], f"`{PID}` int, `{OFF}` long")
    if ranged.rdd.getNumPartitions() <= _MAX_BROADCAST_PARTITIONS:
        offsets = F.broadcast(offsets)
    return with_pos.join(offsets, PID).select(*df.columns, (F.col(OFF) + F.col(POS)).alias(IDX)), before[-1]


def apply_series(df: DataFrame, s: Series, ops: Sequence, blocked: bool | None = None) -> DataFrame:
    """Append one column per op, all sharing one framing of the data."""
    ops = list(ops)
    if not ops:
        return df
    missing = [c for c in (*s.keys, *s.order_by) if c not in df.columns]
    if missing:
        raise ValueError(f"order/key columns not found: {missing}")
    rows = None
    if blocked is None:
        blocked, rows = _shape(df, s)
    if not blocked:
        return _apply_keyed(df, s, ops, df.count() if rows is None else rows)
    indexed, rows = _placed(df, s)
    return _apply_blocked(indexed, s, ops, df.columns, rows)


def _apply_keyed(df: DataFrame, s: Series, ops, rows: int) -> DataFrame:
    df = _dealt(df, rows, [F.col(k) for k in s.keys])
    order = [F.col(c).asc_nulls_first() for c in s.order_by]
    w = Window.partitionBy(*[F.col(k) for k in s.keys]).orderBy(*order)
    need_idx = any(isinstance(o, (Fill, RowIndex)) or isinstance(o, Rolling) and o.by_runs for o in ops)
    if need_idx:
        df = df.withColumn(IDX, F.row_number().over(w) - 1)
    w_rev = Window.partitionBy(*[F.col(k) for k in s.keys]).orderBy(F.col(IDX).desc())
    ctx = _Ctx(w=w, w_rev=w_rev, idx=F.col(IDX), key_start=F.lit(0), halo=None, parts=[F.col(k) for k in s.keys])
    columns = [*df.columns, *dict.fromkeys(o.name for o in ops if o.name not in df.columns)]
    return _with_ops(df, ops, ctx).select(*[F.col(f"`{c}`") for c in columns if c != IDX])


def _with_ops(df: DataFrame, ops, ctx: "_Ctx") -> DataFrame:
    """Add the op columns; frame counts that several statistics need come first."""
    frames = [o for o in ops if isinstance(o, Lookback) and o.streamed]
    if frames:  # last, on copies, as gaps
        source = {c: f"__back_{c}" for c in dict.fromkeys(c for o in frames for c in o.columns)}
        df = df.withColumns({copy: F.col(c) for c, copy in source.items()})
        others = [o for o in ops if o not in frames]
        df = _with_ops(df, others, ctx) if others else df
        df = _with_frames(df.withColumn(POSN, F.row_number().over(ctx.w) - 1), frames, source)
        return df.withColumns({o.name: F.when(F.col(POSN) >= o.n, F.col(o.name)) for o in frames if o.whole})
    gaps = [o for o in ops if isinstance(o, Rolling) and o.of_gaps]
    if gaps:  # last, on copies: the rows leave Spark's windows there
        df = df.withColumns({f"__src_{o.column}": F.col(o.column) for o in gaps})
        others = [o for o in ops if o not in gaps]
        df = _with_ops(df, others, ctx) if others else df
        df = _with_gap_medians(df.withColumn(POSN, F.row_number().over(ctx.w) - 1), gaps)
        return df.withColumns({o.name: F.coalesce(F.col(f"__src_{o.column}"), F.col(o.gap_name)) for o in gaps})
    rolling = [o for o in ops if isinstance(o, Rolling)]
    running = {}
    for o in rolling:
        if o.by_runs:  # counts are whole numbers: those up to the frame's end less those before it
            running[f"__upto_{o.column}"] = F.count(F.col(o.column)).over(ctx.w.rowsBetween(Window.unboundedPreceding, 0))
    if running:
        df = _with_runs(df.withColumns(running), [o for o in rolling if o.by_runs], ctx)

    def count(o: Rolling) -> Column:
        if not o.by_runs:
            return F.count(F.col(o.column)).over(o.frame(ctx))
        upto, back = F.col(f"__upto_{o.column}"), int(o.exclude_current)
        last = F.coalesce(F.lag(upto, back).over(ctx.w), F.lit(0)) if back else upto
        return last - F.coalesce(F.lag(upto, o.n + back).over(ctx.w), F.lit(0))

    counts = {o.count_name: count(o) for o in rolling}
    return (df.withColumns(counts) if counts else df).withColumns({o.name: o.expr(ctx) for o in ops})


def gap_medians(values: np.ndarray, place: np.ndarray, cells: np.ndarray, n: int, back: int, need: int) -> np.ndarray:
    """Median of the frame of each of ``cells`` (indexes into ``values``, NaN
    for null; ``place``: position of each value in its series); NaN where the
    frame holds fewer than ``need`` values."""
    out = np.full(len(cells), np.nan)
    step = max(1, (1 << 20) // n)
    for lo in range(0, len(cells), step):
        at = cells[lo : lo + step]
        ago = np.arange(n) + back
        frame = np.where(ago <= place[at, None], values[np.maximum(at[:, None] - ago, 0)], np.nan)
        frame.sort(axis=1)  # NaN last
        size = n - np.isnan(frame).sum(axis=1)
        rows, some = np.arange(len(at)), np.maximum(size, 1)
        middle = (frame[rows, (some - 1) // 2] + frame[rows, some // 2]) / 2
        out[lo : lo + step] = np.where(size >= max(need, 1), middle, np.nan)
    return out


def _with_gap_medians(df: DataFrame, ops: list[Rolling]) -> DataFrame:
    """Medians of the frames of null cells. Rows stream past in the order of
    their windows; only the last values of a column are held, and only null
    cells gather and sort a frame, so the work follows their number. NaN
    counts as null in a frame."""
    send_package(df.sparkSession)
    columns = list(dict.fromkeys(o.column for o in ops))
    longest = {c: max(o.n for o in ops if o.column == c) for c in columns}
    named = {o.gap_name: o for o in ops}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: np.zeros(0) for c in columns}
        for batch in batches:
            place = np.asarray(batch.column(POSN)).astype(np.int64)
            added = {}
            for c in columns:
                # values before the series' own first row are never in its frames: places say so
                own = np.asarray(batch.column(f"__as_{c}").fill_null(np.nan), np.float64)
                values = np.concatenate((held[c], own))
                first = len(held[c])
                cells = np.flatnonzero(np.isnan(own))
                places = np.concatenate((np.zeros(first, np.int64), place))
                for name, o in named.items():
                    if o.column == c:
                        found = np.full(len(own), np.nan)
                        need = o.n if o.min_periods is None else o.min_periods
                        found[cells] = gap_medians(values, places, cells + first, o.n, int(o.exclude_current), need)
                        added[name] = pa.array(found, mask=np.isnan(found))
                held[c] = values[-longest[c]:]
            kept = [k for k in batch.schema.names if not k.startswith("__as_")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *(added[k] for k in named)], [*kept, *named])

    schema = T.StructType([*df.schema.fields, *(T.StructField(k, T.DoubleType()) for k in named)])
    return df.withColumns({f"__as_{c}": F.col(f"__src_{c}").cast("double") for c in columns}).mapInArrow(run, schema)


def _with_frames(df: DataFrame, ops: list[Lookback], source: dict[str, str]) -> DataFrame:
    """The rows before each row, copied from the rows that stream past in the
    order of their windows: only the last ones are held. ``source``: the copy
    of each column; the ops' own columns, where they exist, are replaced."""
    send_package(df.sparkSession)
    longest = max(o.n for o in ops)
    fields = {c: T.StructField(c, df.schema[copy].dataType) for c, copy in source.items()}
    kept = [f for f in df.schema.fields if f.name not in {o.name for o in ops} | set(source.values())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, pa.Array] = {}
        for batch in batches:
            place = np.asarray(batch.column(POSN)).astype(np.int64)
            values = {c: pa.concat_arrays([held[c], batch.column(copy)]) if held else batch.column(copy) for c, copy in source.items()}
            first = len(next(iter(values.values()))) - len(place)
            step = max(1, (1 << 18) // longest)
            for lo in range(0, len(place), step):
                part, added = batch.slice(lo, step), []
                at = np.arange(lo, lo + part.num_rows) + first
                for o in ops:
                    size = np.minimum(place[lo : lo + step], o.n)
                    ends = np.cumsum(size)
                    rows = pa.array(np.arange(ends[-1]) + np.repeat(at - ends, size))
                    structs = pa.StructArray.from_arrays([values[c].take(rows) for c in o.columns], list(o.columns))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), structs)
                    added.append(o.fold(lists) if o.fold else lists)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *added], [*(f.name for f in kept), *(o.name for o in ops)])
            held = {c: v.slice(max(0, len(v) - longest)) for c, v in values.items()}

    made = [T.StructField(o.name, T.DoubleType() if o.fold else T.ArrayType(T.StructType([fields[c] for c in o.columns]))) for o in ops]
    return df.mapInArrow(run, T.StructType([*kept, *made]))


def _with_runs(df: DataFrame, ops: list[Rolling], ctx: "_Ctx") -> DataFrame:
    """Running aggregates over runs of ``n`` rows, from the run's beginning to
    a row and from a row to the run's end. Runs lie within the windows'
    partitions, so the rows are sorted again but not shuffled."""
    df = df.withColumn(POSN, F.row_number().over(ctx.w) - 1)
    for n in dict.fromkeys(o.n for o in ops):
        run = f"{RUN}_{n}"
        df = df.withColumn(run, F.floor(F.col(POSN) / n))
        for side, order in (("begin", ctx.idx.asc()), ("end", ctx.idx.desc())):
            over = Window.partitionBy(*ctx.parts, F.col(run)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
            df = df.withColumns({o.part_name(p, side): _running(p, F.col(o.column), over) for o in ops if o.n == n for p in _PARTS[o.stat]})
    return df


def _apply_blocked(indexed: DataFrame, s: Series, ops, columns, rows: int) -> DataFrame:
    B = int(s.block_rows)
    reach = max(int(o.reach) for o in ops)
    if reach >= B:
        raise ValueError(f"frame reach {reach} does not fit in block_rows={B}")
    blk = F.expr(f"`{IDX}` div {B}")
    if reach > 0:
        copies = F.when(F.pmod(F.col(IDX), F.lit(B)) >= B - reach, F.array(blk, blk + 1)).otherwise(F.array(blk))
        framed = indexed.select("*", F.explode(copies).alias(BLK))
        framed = framed.withColumn(HALO, F.col(BLK) != blk)
    else:
        framed = indexed.withColumn(BLK, blk).withColumn(HALO, F.lit(False))
    keys = [F.col(KEY)] if s.keys else []
    if s.keys:  # one column that is never null, so that window and join agree on its partitioning
        framed = framed.withColumn(KEY, F.struct(*[F.col(k) for k in s.keys]))
    w = Window.partitionBy(F.col(BLK), *keys).orderBy(F.col(IDX))

    need_start = any(isinstance(o, RowIndex) for o in ops) and s.keys
    key_start = F.lit(0)
    if need_start:
        starts = indexed.groupBy(F.struct(*[F.col(k) for k in s.keys]).alias(KEY)).agg(F.min(IDX).alias("__ampere_start"))
        framed = framed.join(starts, KEY, "left")
        key_start = F.col("__ampere_start")

    carries: dict = {}
    unbounded = [o for o in ops if getattr(o, "unbounded", False)]
    if unbounded:
        framed, carries = _with_carries(framed, s, unbounded)
    if not unbounded or any(isinstance(o, Rolling) and o.by_runs for o in ops):  # else the join of the carries deals the rows
        framed = _dealt(framed, rows, [F.col(BLK), *keys])
    w_rev = Window.partitionBy(F.col(BLK), *keys).orderBy(F.col(IDX).desc())
    ctx = _Ctx(w=w, w_rev=w_rev, idx=F.col(IDX), key_start=key_start, halo=F.col(HALO), carries=carries, parts=[F.col(BLK), *keys])
    out = _with_ops(framed, ops, ctx).where(~F.col(HALO))
    added = list(dict.fromkeys(o.name for o in ops if o.name not in columns))
    return out.select(*columns, *added)


def _with_carries(framed: DataFrame, s: Series, ops) -> tuple[DataFrame, dict]:
    """Per (block, key) summaries -> carries from earlier/later blocks.

    The summaries use max/max_by/min/min_by/sum over primitive columns, so
    they plan as hash aggregations with a map-side partial step (no sort of
    the rows); the carry windows then run over one row per (block, key)."""
    aggs, names, post = [], {}, []
    for o in ops:
        c = F.col(o.column)
        at = F.when(c.isNotNull() & ~F.col(HALO), F.col(IDX))  # position of a usable value
        if isinstance(o, Fill):
            want_prev, want_next = o.needs()
            for kind, want, pick_i, pick_v in (("prev", want_prev, F.max, F.max_by), ("next", want_next, F.min, F.min_by)):
                if not want or (o.column, kind) in names:
                    continue
                name = f"__c_{kind}_{len(names)}"
                names[(o.column, kind)] = name
                aggs += [pick_i(at).alias(name + "_i"), pick_v(c, at).alias(name + "_v")]
                post.append(F.when(F.col(name + "_i").isNotNull(),
                                   F.struct(F.col(name + "_i").alias("i"), F.col(name + "_v").alias("v")))
                            .alias(name + "_s"))
        elif isinstance(o, RunningSum) and (o.column, "sum") not in names:
            name = f"__c_sum_{len(names)}"
            names[(o.column, "sum")] = name
            aggs.append(F.sum(F.when(~F.col(HALO), c)).alias(name + "_s"))
            post.append(F.col(name + "_s"))
    by = [BLK, KEY] if s.keys else [BLK]
    summary = framed.groupBy(*by).agg(*aggs).select(*by, *post)
    sw = Window.partitionBy(*by[1:]).orderBy(BLK)
    sw_rev = Window.partitionBy(*by[1:]).orderBy(F.col(BLK).desc())
    sel = list(by)
    for (column, kind), name in names.items():
        src = F.col(name + "_s")
        if kind == "prev":
            sel.append(F.last(src, ignorenulls=True).over(sw.rowsBetween(Window.unboundedPreceding, -1)).alias(name))
        elif kind == "next":
            sel.append(F.last(src, ignorenulls=True).over(sw_rev.rowsBetween(Window.unboundedPreceding, -1))
                       .alias(name))
        else:
            sel.append(F.sum(src).over(sw.rowsBetween(Window.unboundedPreceding, -1)).alias(name))
    carry = summary.select(*sel)
    # plain equality on the columns that the windows partition by: one shuffle for both
    return framed.join(carry, by, "left"), names


# ------------------------------------------------------------- public wrappers


def with_row_index(df: DataFrame, s: Series, name: str = "index") -> DataFrame:
    return apply_series(df, s, [RowIndex(name)])


def add_lag_features(df: DataFrame, columns: Sequence[str], s: Series,
                     lags: Sequence[int] = (1, 2, 3, 24, 48, 168)) -> DataFrame:
    ops = [Lag(c, n, f"{c}_lag_{n}") for c in columns if c in df.columns for n in lags]
    return apply_series(df, s, ops)


def add_rolling_features(df: DataFrame, columns: Sequence[str], s: Series,
                         windows: Sequence[int] = (3, 6, 12, 24),
                         stats: Sequence[str] = ("mean", "std", "min", "max"),
                         exclude_current: bool = False) -> DataFrame:
    ops = [Rolling(c, n, st, f"{c}_rolling_{st}_{n}", exclude_current=exclude_current)
           for c in columns if c in df.columns for n in windows for st in stats]
    return apply_series(df, s, ops)


def forward_fill(df: DataFrame, column: str, s: Series) -> DataFrame:
    return apply_series(df, s, [Fill(column, "ffill", column)])


def backward_fill(df: DataFrame, column: str, s: Series) -> DataFrame:
    return apply_series(df, s, [Fill(column, "bfill", column)])


def interpolate_linear(df: DataFrame, column: str, s: Series) -> DataFrame:
    return apply_series(df, s, [Fill(column, "interpolate", column)])


def cumulative_sum(df: DataFrame, column: str, s: Series, name: str | None = None) -> DataFrame:
    return apply_series(df, s, [RunningSum(column, name or f"cumulative_{column}")])


def lookback_sequences(df: DataFrame, columns: Sequence[str], s: Series, n: int = 10,
                       name: str = "lookback") -> DataFrame:
    return apply_series(df, s, [Lookback(tuple(columns), n, name)])
