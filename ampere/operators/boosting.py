"""Second-order gradient boosting of regression trees (M6).

Features become quantile bins. Each round grows one tree level by level: every
task adds up gradients and hessians per (node, feature, bin), the sums over
all tasks give each node its best split by the regularised gain, and leaves
get the weight -G / (H + lambda). Missing values (NaN) go to the side of the
better gain.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, send_package
from .blocks import ArrayModel, list_matrix, summed

#: the last bin holds missing values
_MISSING = 255


@dataclass(frozen=True)
class BoostParams:
    """``rounds`` trees of at most ``depth`` levels; ``eta`` shrinks leaves,
    ``penalty`` (lambda) and ``least_gain`` (gamma) regularise, ``child``: least
    hessian of a child; ``bins``: at most 255 per feature. Lineage is cut by a
    checkpoint every ``checkpoint_every`` trees."""

    rounds: int = 100
    depth: int = 5
    eta: float = 0.1
    penalty: float = 1.0
    least_gain: float = 0.0
    child: float = 1.0
    bins: int = 255
    checkpoint_every: int = 10


def bin_edges(df: DataFrame, column: str, width: int, bins: int) -> list[np.ndarray]:
    """Cut values of each feature: distinct quantiles, less the greatest (a
    value goes left of a cut if it is at most the cut). One aggregation."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins + 1)])
    usable = lambda f: F.when(~F.isnan(F.col(column)[f]), F.col(column)[f])
    row = df.agg(*[F.percentile_approx(usable(f), shares, 100 * bins).alias(f"q{f}") for f in range(width)]).first()
    return [np.unique(np.array(q if q is not None else [], np.float64))[:-1] for q in row]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for f, cut in enumerate(edges):
        out[:, f] = np.where(np.isnan(x[:, f]), _MISSING, np.searchsorted(cut, x[:, f], side="left"))
    return out


@dataclass
class Tree:
    """A binary tree in heap order: node k has children 2k + 1 and 2k + 2;
    ``feature`` is -1 at leaves; a bin of at most ``cut`` goes left."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        at = np.zeros(len(bins), np.int64)
        while True:
            feature = self.feature[at]
            going = np.flatnonzero(feature >= 0)
            if len(going) == 0:
                return at
            b = bins[going, feature[going]]
            node = at[going]
            left = np.where(b == _MISSING, self.missing_left[node], b <= self.cut[node])
            at[going] = 2 * node + np.where(left, 1, 2)


def best_split(g: np.ndarray, h: np.ndarray, p: BoostParams) -> tuple[float, int, int, bool, float, float, float, float]:
    """``(gain, feature, cut, missing left, G left, H left, G right, H right)``
    from one node's sums per (feature, bin). Ties go to the first feature,
    cut, and to missing values on the right."""
    best = (p.least_gain, -1, 0, False, 0.0, 0.0, 0.0, 0.0)
    total_g, total_h = g[0].sum(), h[0].sum()
    score = lambda a, b: a * a / (b + p.penalty)
    for feature in range(len(g)):
        for missing_left in (False, True):
            if missing_left and h[feature, _MISSING] == 0:
                continue
            gl = np.cumsum(g[feature, :_MISSING]) + missing_left * g[feature, _MISSING]
            hl = np.cumsum(h[feature, :_MISSING]) + missing_left * h[feature, _MISSING]
            gr, hr = total_g - gl, total_h - hl
            gain = 0.5 * (score(gl, hl) + score(gr, hr) - score(total_g, total_h)) - p.least_gain
            gain = np.where((hl >= p.child) & (hr >= p.child), gain, -np.inf)
            cut = int(np.argmax(gain))
            if gain[cut] > max(best[0], 1e-12 * max(1.0, score(total_g, total_h))):
                best = (float(gain[cut]), feature, cut, missing_left, gl[cut], hl[cut], gr[cut], hr[cut])
    return best


def _unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bins and gradients (margin less label; the hessian of squares is 1)."""
    for batch in batches:
        for r in batch.to_pylist():
            yield np.frombuffer(r["bins"], np.uint8).reshape(-1, r["width"]), np.frombuffer(r["margin"]) - np.frombuffer(r["y"])


_BLOCK = "bins binary, y binary, margin binary, width int"


def grow_tree(blocks: DataFrame, width: int, p: BoostParams) -> tuple[Tree, list[tuple]]:
    """One tree, a pass over the data per level, and its splits as
    ``(node, gain, feature, cut, missing left, left value, right value)``."""
    tree, splits = Tree.empty(p.depth), []
    level = [0]
    for depth in range(p.depth):
        slots = np.full(len(tree.feature), -1)
        slots[level] = np.arange(len(level))

        def histograms(rows: Iterator, tree=tree, slots=slots, n=len(level)) -> np.ndarray:
            sums = np.zeros((2, n, width, 256))
            for bins, g in rows:
                slot = slots[tree.nodes(bins)]
                here = slot >= 0
                at = slot[here, None] * 256 + bins[here]
                for f in range(width):
                    sums[0, :, f] += np.bincount(at[:, f], g[here], n * 256).reshape(n, 256)
                    sums[1, :, f] += np.bincount(at[:, f], minlength=n * 256).reshape(n, 256)
            return sums

        sums = summed(blocks, 2 * len(level) * width * 256, histograms, _unpack).reshape(2, len(level), width, 256)
        following = []
        for k, node in enumerate(level):
            if depth == 0:
                tree.value[0] = -sums[0, 0, 0].sum() / (sums[1, 0, 0].sum() + p.penalty)
            gain, feature, cut, missing_left, gl, hl, gr, hr = best_split(sums[0, k], sums[1, k], p)
            if feature < 0:
                continue
            tree.feature[node], tree.cut[node], tree.missing_left[node] = feature, cut, missing_left
            tree.value[2 * node + 1], tree.value[2 * node + 2] = -gl / (hl + p.penalty), -gr / (hr + p.penalty)
            splits.append((node, gain, feature, cut, missing_left, tree.value[2 * node + 1], tree.value[2 * node + 2]))
            following += [2 * node + 1, 2 * node + 2]
        level = following
        if not level:
            break
    return tree, splits


class SecondOrderBoosting(Estimator):
    """Squared loss from the mean of the labels. Runs one aggregation for the
    bins and one job per tree level."""

    def __init__(self, params: BoostParams = BoostParams(), features: str = "features", label: str = "label", prediction: str = "prediction"):
        super().__init__()
        self.boost, self.columns = params, (features, label, prediction)

    def _fit(self, df: DataFrame) -> "SecondOrderBoostingModel":
        p, (features, label, prediction) = self.boost, self.columns
        send_package(df.sparkSession)
        rows = df.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"))
        first = rows.agg(F.max(F.size("x")).alias("width"), F.avg("y").alias("base")).first()
        if first.width is None:
            raise ValueError("no rows to fit")
        width, base = first.width, first.base
        edges = bin_edges(rows, "x", width, min(p.bins, _MISSING))

        def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 8192):
                    part = batch.slice(at, 8192)
                    y = np.asarray(part.column("y"), np.float64)
                    bins = binned(list_matrix(part.column("x")), edges)
                    yield pa.RecordBatch.from_arrays([pa.array([bins.tobytes()]), pa.array([y.tobytes()]), pa.array([np.full(len(y), base).tobytes()]),
                                                      pa.array([width], pa.int32())], _names())

        blocks = rows.mapInArrow(pack, _BLOCK).persist(StorageLevel.MEMORY_AND_DISK)
        ensure_checkpoint_dir(df.sparkSession)
        trees, gains, before = [], np.zeros(width), None
        for number in range(p.rounds):
            tree, splits = grow_tree(blocks, width, p)
            if before is not None:  # the blocks made from these are kept by now
                before.unpersist()
            trees.append(tree)
            for _, gain, feature, *_ in splits:
                gains[feature] += gain
            if number + 1 == p.rounds or not splits and abs(tree.value[0]) < 1e-12:
                break
            before, blocks = blocks, _moved(blocks, tree, p.eta)
            blocks = blocks.checkpoint(eager=True) if (number + 1) % p.checkpoint_every == 0 else blocks.persist(StorageLevel.MEMORY_AND_DISK)
        for kept in (before, blocks):
            if kept is not None:
                kept.unpersist()
        n = len(trees[0].feature)
        cuts = [np.array([edges[f][c] if f >= 0 and c < len(edges[f]) else np.inf for f, c in zip(t.feature, t.cut)]) for t in trees]
        arrays = {"feature": np.stack([t.feature for t in trees]).reshape(-1, n), "cut": np.stack(cuts), "missing_left": np.stack([t.missing_left for t in trees]),
                  "value": p.eta * np.stack([t.value for t in trees]), "base": np.array([base]), "gains": gains}
        return SecondOrderBoostingModel(arrays, features, label, prediction)


def _names() -> list[str]:
    return [c.split()[0] for c in _BLOCK.split(", ")]


def _moved(blocks: DataFrame, tree: Tree, eta: float) -> DataFrame:
    """Blocks with the margins after one more tree."""

    def move(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                bins = np.frombuffer(r["bins"], np.uint8).reshape(-1, r["width"])
                margin = np.frombuffer(r["margin"]) + eta * tree.value[tree.nodes(bins)]
                yield pa.RecordBatch.from_arrays([pa.array([r["bins"]]), pa.array([r["y"]]), pa.array([margin.tobytes()]),
                                                  pa.array([r["width"]], pa.int32())], _names())

    return blocks.mapInArrow(move, _BLOCK)


class SecondOrderBoostingModel(ArrayModel):
    """Trees with cuts in the features' own units."""

    @staticmethod
    def values(arrays: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), arrays["base"][0])
        for feature, cut, missing_left, value in zip(*(arrays[k] for k in ("feature", "cut", "missing_left", "value"))):
            at = np.zeros(len(x), np.int64)
            while True:
                going = np.flatnonzero(feature[at] >= 0)
                if len(going) == 0:
                    break
                node = at[going]
                v = x[going, feature[node]]
                at[going] = 2 * node + np.where(np.where(np.isnan(v), missing_left[node], v <= cut[node]), 1, 2)
            out += value[at]
        return out

    @property
    def featureImportances(self):
        """Share of the total gain by feature."""
        gains = self.arrays()["gains"]
        return Vectors.dense(gains / gains.sum() if gains.sum() > 0 else gains)
