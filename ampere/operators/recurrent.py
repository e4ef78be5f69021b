"""Recurrent states of an ordered series.

A reservoir of leaky units: every unit keeps an exponential mean of one input
(a feature or a fixed random tanh mixture of all) at one of several time
scales, s_t = m * s_{t-1} + (1 - m) * u_t, so its memory has no end. The
recurrence is linear in the state: blocks of rows are scanned from zero in
parallel, their last states are chained over one small row per block, and each
block is scanned again from the state that it begins with. A linear read-out on
the states is then fitted by any regressor.
"""

from __future__ import annotations

from typing import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, send_package
from .blocks import list_matrix
from .series import IDX, Series, global_index

BLOCK = "__ampere_state_block"


def unit_inputs(x: np.ndarray, mixtures: int, seed: int) -> np.ndarray:
    """The features and ``mixtures`` fixed random tanh mixtures of them."""
    if not mixtures:
        return x
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, 1.0 / np.sqrt(max(1, x.shape[1])), (x.shape[1], mixtures))
    return np.hstack((x, np.tanh(x @ w + rng.uniform(-1, 1, mixtures))))


def scan(u: np.ndarray, memory: np.ndarray, start: np.ndarray, run: int = 256) -> np.ndarray:
    """States before each row and after the last: (rows + 1) x (units), the
    units being all inputs at the first time scale, then at the next. Within a
    run of rows the reach of the sums doubles: a few array steps a run."""
    keep = np.repeat(memory, u.shape[1])
    out = np.vstack((start, np.tile(u, len(memory)) * (1 - keep)))
    for lo in range(0, len(u), run):
        states = out[lo : lo + run + 1]  # the first one is whole already
        step, back = keep, 1
        while back < len(states):
            states[back:] += step * states[:-back]
            step, back = step * step, 2 * back
    return out


class ReservoirStates(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """For each row the states from all rows before it, as a vector; the first
    ``lookback`` rows of the frame it is given go, as in the reference. Runs
    the row positions and one job for the blocks' last states. The carried
    states travel by one row per block of ``blockRows`` rows."""

    lookback = Param(Params._dummy(), "lookback", "first rows without a state", TypeConverters.toInt)
    orderBy = Param(Params._dummy(), "orderBy", "columns that order the series", TypeConverters.toListString)
    memory = Param(Params._dummy(), "memory", "share of the old state that each time scale keeps", TypeConverters.toListFloat)
    mixtures = Param(Params._dummy(), "mixtures", "random tanh mixtures of the inputs", TypeConverters.toInt)
    blockRows = Param(Params._dummy(), "blockRows", "rows scanned by one task at a time", TypeConverters.toInt)

    def __init__(self, lookback: int = 10, order_by: Sequence[str] = (), memory: Sequence[float] = (0.0, 0.5, 0.75, 0.9, 0.97, 0.99), mixtures: int = 16,
                 block_rows: int = 20_000, seed: int = 42, in_col: str = "features", out_col: str = "states"):
        super().__init__()
        self._set(lookback=lookback, orderBy=list(order_by), memory=list(memory), mixtures=mixtures, blockRows=block_rows, seed=seed,
                  inputCol=in_col, outputCol=out_col)

    def _transform(self, df: DataFrame) -> DataFrame:
        get = self.getOrDefault
        memory, mixtures, seed, rows = np.array(get(self.memory)), get(self.mixtures), self.getSeed(), get(self.blockRows)
        ensure_checkpoint_dir(df.sparkSession)
        send_package(df.sparkSession)
        placed = global_index(df.withColumn("__x", vector_to_array(F.col(self.getInputCol()))), Series(order_by=tuple(get(self.orderBy))))
        placed = placed.withColumn(BLOCK, F.expr(f"`{IDX}` div {rows}"))
        inputs = placed.select(BLOCK, IDX, "__x")

        def in_blocks(rows: DataFrame) -> DataFrame:
            """A block's rows meet in one task, in order."""
            return rows.repartition(BLOCK).sortWithinPartitions(BLOCK, IDX)

        def whole_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[pa.Array]]]:
            """``(block, positions, rows)`` of each block."""
            at, ids, xs = None, [], []
            for batch in batches:
                block, idx = np.asarray(batch.column(BLOCK)), np.asarray(batch.column(IDX))
                cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    if hi == lo:
                        continue
                    if at is not None and block[lo] != at:
                        yield at, np.concatenate(ids), xs
                        ids, xs = [], []
                    at = block[lo]
                    ids.append(idx[lo:hi])
                    xs.append(batch.column("__x").slice(lo, hi - lo))
            if at is not None:
                yield at, np.concatenate(ids), xs

        def units(xs: list[pa.Array]) -> np.ndarray:
            return unit_inputs(np.vstack([list_matrix(x) for x in xs if len(x)]), mixtures, seed)

        def last_states(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, idx, xs in whole_blocks(batches):
                u = units(xs)
                last = scan(u, memory, np.zeros(len(memory) * u.shape[1]))[-1]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([len(idx)], pa.int64()), pa.array([last.tolist()])],
                                                 [BLOCK, "n", "last"])

        def chained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = None
            for batch in batches:  # one row per block, in order
                for r in batch.to_pylist():
                    last = np.array(r["last"])
                    start = np.zeros(len(last)) if state is None else state
                    yield pa.RecordBatch.from_arrays([pa.array([r[BLOCK]], pa.int64()), pa.array([start.tolist()])], [BLOCK, "start"])
                    state = np.repeat(memory ** r["n"], len(last) // len(memory)) * start + last

        ends = in_blocks(inputs).mapInArrow(last_states, f"{BLOCK} long, n long, last array<double>")
        starts = ends.repartition(1).sortWithinPartitions(BLOCK).mapInArrow(chained, f"{BLOCK} long, start array<double>").checkpoint(eager=True)

        def states(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, idx, xs in whole_blocks(batches):
                start = list_matrix(xs[0].slice(0, 1))[0]  # the block's first row holds its start
                own = scan(units([xs[0].slice(1), *xs[1:]]), memory, start)[:-1]
                for lo in range(0, len(own), 4096):
                    part = own[lo : lo + 4096]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * own.shape[1], pa.int32()), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(idx[lo + 1 : lo + 4097], pa.int64()), lists], [IDX, "__state"])

        begun = inputs.unionByName(starts.select(BLOCK, F.lit(-1).cast("long").alias(IDX), F.col("start").alias("__x")))
        carried = in_blocks(begun).mapInArrow(states, f"{IDX} long, __state array<double>")
        out = placed.where(F.col(IDX) >= get(self.lookback)).join(carried, IDX)
        return out.withColumn(self.getOutputCol(), array_to_vector(F.col("__state"))).drop("__x", "__state", IDX, BLOCK)
