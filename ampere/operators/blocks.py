"""Training rows as blocks of NumPy matrices, sums of small arrays over them,
and the optimiser and model base class that the trained slots share.

A trainer packs its rows once; every pass runs a function over the blocks of
each task and adds up the arrays that come out, slot by slot, in one small
aggregation. Only such a sum (as long as the parameters or histograms) ever
reaches the driver.
"""

from __future__ import annotations

import base64
import json
from typing import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import send_package

Rows = Iterator[tuple[np.ndarray, np.ndarray]]


def list_matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long rows as a matrix."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def packed(df: DataFrame, features: str, label: str, rows: int = 8192, alike: bool = False) -> DataFrame:
    """``(x, y, width)``: the rows' features and labels in blocks of at most
    ``rows`` rows, kept in memory or on the executors' disks until unpersisted.
    ``alike``: rows equal in all of that are held once, their number in a third
    array, ``times`` (``counted`` unpacks them)."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                x = list_matrix(part.column("x"))
                others = [pa.array([np.asarray(part.column(c), np.float64).tobytes()]) for c in names]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]), *others, pa.array([x.shape[1]], pa.int32())], ["x", *names, "width"])

    send_package(df.sparkSession)
    vectors = df.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"))
    if alike:
        vectors = vectors.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("times"))
    names = vectors.columns[1:]
    return vectors.mapInArrow(pack, f"x binary, {', '.join(f'{c} binary' for c in names)}, width int").persist(StorageLevel.MEMORY_AND_DISK)


def unpacked(batches: Iterable[pa.RecordBatch]) -> Rows:
    for batch in batches:
        for r in batch.to_pylist():
            yield np.frombuffer(r["x"]).reshape(-1, r["width"]), np.frombuffer(r["y"])


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features, labels and how often each row comes."""
    for batch in batches:
        for r in batch.to_pylist():
            yield np.frombuffer(r["x"]).reshape(-1, r["width"]), np.frombuffer(r["y"]), np.frombuffer(r["times"])


def summed(blocks: DataFrame, size: int, per_task: Callable[[Rows], np.ndarray],
           unpack: Callable[[Iterable[pa.RecordBatch]], Iterator] = unpacked) -> np.ndarray:
    """Sum over all tasks of the array (``size`` numbers) that ``per_task``
    makes from the task's blocks; zeros are not sent."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.asarray(per_task(unpack(batches)), np.float64).ravel()
        slots = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(own[slots])], ["slot", "value"])

    send_package(blocks.sparkSession)
    out = np.zeros(size)
    sums = blocks.mapInArrow(run, "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value")).toPandas()
    out[sums["slot"].to_numpy(np.int64)] = sums["value"].to_numpy(np.float64)
    return out


def lbfgs(fun: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, max_iter: int = 100, tol: float = 1e-7,
          history: int = 10, watch: Callable[[np.ndarray], bool] | None = None) -> np.ndarray:
    """Minimise ``fun`` (value and gradient, one pass over the data) by the
    limited-memory quasi-Newton method with backtracking; ``watch`` sees every
    accepted point and may stop the search."""
    w = start.copy()
    value, grad = fun(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.abs(grad).max(initial=0.0) <= tol * max(1.0, np.abs(w).max(initial=0.0)):
            break
        direction, alphas = -grad, []
        for s, y in reversed(steps):
            alphas.append((s @ direction) / (s @ y))
            direction = direction - alphas[-1] * y
        if steps:
            s, y = steps[-1]
            direction *= (s @ y) / (y @ y)
        else:
            direction /= max(1.0, np.linalg.norm(grad))
        for (s, y), alpha in zip(steps, reversed(alphas)):
            direction = direction + s * (alpha - (y @ direction) / (s @ y))
        slope = grad @ direction
        if slope >= 0:
            direction, slope, steps = -grad, -(grad @ grad), []
        step = 1.0
        for _ in range(30):
            new = w + step * direction
            new_value, new_grad = fun(new)
            if new_value <= value + 1e-4 * step * slope:
                break
            step *= 0.5
        else:
            break
        s, y = new - w, new_grad - grad
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            steps = [*steps[-(history - 1):], (s, y)]
        done = abs(value - new_value) <= 1e-13 * max(1.0, abs(value))
        w, value, grad = new, new_value, new_grad
        if watch is not None and watch(w) or done:
            break
    return w


class ArrayModel(Model, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted model whose state is a few arrays: they are kept in one
    parameter, so it saves, loads and predicts like any pipeline stage.
    Subclasses turn features into predictions with NumPy, per Arrow batch."""

    state = Param(Params._dummy(), "state", "arrays by name, as JSON", TypeConverters.toString)

    def __init__(self, arrays: dict[str, np.ndarray] | None = None, features: str = "features", label: str = "label",
                 prediction: str = "prediction"):
        super().__init__()
        self._set(featuresCol=features, labelCol=label, predictionCol=prediction)
        if arrays is not None:
            coded = {k: [str(a.dtype), list(a.shape), base64.b64encode(np.ascontiguousarray(a).tobytes()).decode()] for k, a in arrays.items()}
            self._set(state=json.dumps(coded))

    def arrays(self) -> dict[str, np.ndarray]:
        coded = json.loads(self.getOrDefault(self.state))
        return {k: np.frombuffer(base64.b64decode(data), kind).reshape(shape) for k, (kind, shape, data) in coded.items()}

    @staticmethod
    def values(arrays: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        arrays, values = self.arrays(), type(self).values
        send_package(df.sparkSession)

        @F.pandas_udf("double")
        def predicted(x: pd.Series) -> pd.Series:
            return pd.Series(values(arrays, np.vstack(x.to_numpy())) if len(x) else [], dtype="float64")

        return df.withColumn(self.getPredictionCol(), predicted(vector_to_array(F.col(self.getFeaturesCol()))))
