"""Kernel regression with an epsilon-insensitive loss (M9).

Landmark features (Nystrom): a bounded sample of distinct training rows, the
kernel between every row and them, whitened by the Cholesky factor of the
landmarks' own kernel. On these features the support-vector objective
|w|^2 / 2 + C * sum(max(0, |error| - epsilon)) is minimised in the primal, its
gradients added up over all tasks. The features are never made: a pass takes the
kernel times the whitened weights, and whitens the summed gradient, so its work
per row follows the landmarks, not their square. Equal rows are held once.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ArrayModel, counted, lbfgs, packed, summed

Counted = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]
#: numbers in the part of the kernel that is held at a time: they stay in a core's cache
_PART = 1 << 17


def rbf(x: np.ndarray, landmarks: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma * squared distance) of every row to every landmark."""
    apart = (x * x).sum(axis=1)[:, None] + (landmarks * landmarks).sum(axis=1)
    apart -= 2 * x @ landmarks.T
    np.maximum(apart, 0.0, out=apart)
    apart *= -gamma
    return np.exp(apart, out=apart)


def whitening(landmarks: np.ndarray, gamma: float) -> np.ndarray:
    """The inverse transposed Cholesky factor of the landmarks' kernel: the
    features ``rbf @ whitening`` have the landmarks' exact inner products."""
    own = rbf(landmarks, landmarks, gamma)
    factor = np.linalg.cholesky(own + 1e-8 * np.eye(len(own)))
    return np.linalg.inv(factor).T


def tube_loss(errors: np.ndarray, epsilon: float, bend: float) -> tuple[np.ndarray, np.ndarray]:
    """Losses and derivatives: zero up to ``epsilon``, then a parabola over
    ``bend``, then a line."""
    over = np.maximum(np.abs(errors) - epsilon, 0.0)
    near = over < bend
    loss = np.where(near, over * over / (2 * bend), over - bend / 2)
    return loss, np.sign(errors) * np.where(near, over / bend, 1.0)


class TubeRegression(Estimator):
    """Support-vector regression with a Gaussian kernel. ``landmarks``: at
    most so many distinct training rows (least hashes); gamma is 1 / (features
    x variance). The loss is bent over a width that shrinks in three rounds to
    a thousandth of the labels' deviation."""

    def __init__(self, c: float = 100.0, epsilon: float = 0.1, landmarks: int = 256, max_iter: int = 60,
                 features: str = "features", label: str = "label", prediction: str = "prediction"):
        super().__init__()
        self.c, self.epsilon, self.landmarks, self.max_iter = c, epsilon, landmarks, max_iter
        self.columns = (features, label, prediction)

    def _fit(self, df: DataFrame) -> "TubeRegressionModel":
        features, label, prediction = self.columns
        rows = df.select(vector_to_array(F.col(features)).alias("x")).distinct()
        chosen = rows.orderBy(F.xxhash64("x"), "x").limit(self.landmarks).collect()  # bounded by ``landmarks``
        if not chosen:
            raise ValueError("no rows to fit")
        blocks = packed(df, features, label, alike=True)
        try:
            return TubeRegressionModel(self._trained(blocks, np.array([r.x for r in chosen])), features, label, prediction)
        finally:
            blocks.unpersist()

    def _trained(self, blocks: DataFrame, landmarks: np.ndarray) -> dict[str, np.ndarray]:
        def moments(rows: Counted) -> np.ndarray:
            return sum((np.array([x.shape[1] * k.sum(), (k @ x).sum(), (k @ (x * x)).sum(), k.sum(), k @ y, k @ (y * y)]) for x, y, k in rows), np.zeros(6))

        size, total, squares, n, y_total, y_squares = summed(blocks, 6, moments, counted)
        variance = squares / size - (total / size) ** 2
        gamma = 1.0 / (landmarks.shape[1] * variance) if variance > 0 else 1.0
        mean, spread = y_total / n, np.sqrt(max(y_squares / n - (y_total / n) ** 2, 0.0)) or 1.0
        white, c, epsilon, part = whitening(landmarks, gamma), self.c, self.epsilon, max(1, _PART // len(landmarks))
        params = np.append(np.zeros(len(landmarks)), mean)
        for bend in (0.1 * spread, 0.01 * spread, 0.001 * spread):
            def fun(params: np.ndarray, bend=bend) -> tuple[float, np.ndarray]:
                weights = white @ params[:-1]

                def task(rows: Counted) -> np.ndarray:
                    out = np.zeros(len(params) + 1)
                    for x, y, k in rows:
                        for lo in range(0, len(y), part):
                            at = slice(lo, lo + part)
                            near = rbf(x[at], landmarks, gamma)
                            loss, slope = tube_loss(near @ weights + params[-1] - y[at], epsilon, bend)
                            slope *= k[at]
                            out += np.concatenate(([loss @ k[at]], slope @ near, [slope.sum()]))
                    return out

                sums = summed(blocks, len(params) + 1, task, counted)
                sums[1:-1] = sums[1:-1] @ white
                free = np.append(params[:-1], 0.0)
                # divided by C and the rows: the same minimum, a steadier scale
                return 0.5 * float(free @ free) / (c * n) + sums[0] / n, free / (c * n) + sums[1:] / n

            params = lbfgs(fun, params, self.max_iter, tol=1e-10)
        return {"landmarks": landmarks, "weights": white @ params[:-1], "offset": params[-1:], "gamma": np.array([gamma])}


class TubeRegressionModel(ArrayModel):
    @staticmethod
    def values(arrays: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
        return rbf(x, arrays["landmarks"], float(arrays["gamma"][0])) @ arrays["weights"] + arrays["offset"][0]
