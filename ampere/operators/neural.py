"""A multi-layer regression network trained by back-propagation (M9).

Full-batch quasi-Newton steps: every pass computes loss and gradient of each
task's blocks with NumPy and adds them up over all tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Estimator
from pyspark.sql import DataFrame

from .blocks import ArrayModel, Rows, lbfgs, packed, summed


def shapes(layers: tuple[int, ...]) -> list[tuple[int, int]]:
    """Weight matrices (with a bias row each) of layer sizes, input first."""
    return [(a + 1, b) for a, b in zip(layers[:-1], layers[1:])]


def unflattened(params: np.ndarray, layers: tuple[int, ...]) -> list[np.ndarray]:
    out, at = [], 0
    for a, b in shapes(layers):
        out.append(params[at : at + a * b].reshape(a, b))
        at += a * b
    return out


def start_weights(layers: tuple[int, ...], seed: int) -> np.ndarray:
    """Uniform weights scaled by the layers' sizes; biases zero."""
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in shapes(layers):
        w = rng.uniform(-1, 1, (a, b)) * np.sqrt(6.0 / (a - 1 + b))
        w[-1] = 0
        parts.append(w.ravel())
    return np.concatenate(parts)


def forward(weights: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """Outputs of every layer (rectified but for the last), the input first."""
    outs = [x]
    for k, w in enumerate(weights):
        z = outs[-1] @ w[:-1] + w[-1]
        outs.append(np.maximum(z, 0) if k + 1 < len(weights) else z)
    return outs


def loss_and_gradient(params: np.ndarray, layers: tuple[int, ...], x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Half the sum of squared errors and its gradient by back-propagation."""
    weights = unflattened(params, layers)
    outs = forward(weights, x)
    delta = outs[-1][:, 0] - y
    loss, delta, grads = 0.5 * float(delta @ delta), delta[:, None], []
    for k in range(len(weights) - 1, -1, -1):
        grads.append(np.vstack((outs[k].T @ delta, delta.sum(axis=0))).ravel())
        if k:
            delta = (delta @ weights[k][:-1].T) * (outs[k] > 0)
    return loss, np.concatenate(grads[::-1])


class MultilayerRegression(Estimator):
    """``hidden`` layer sizes (none: least squares); ``alpha``: squared penalty
    of all weights but biases, divided by the rows; ``validation``: every
    such row is held out, and the search stops after ``patience`` steps without
    a better error on them (0: none is). The labels are standardised inside."""

    def __init__(self, hidden: tuple[int, ...] = (100, 50), alpha: float = 1e-4, max_iter: int = 200, validation: int = 10, patience: int = 10,
                 seed: int = 42, features: str = "features", label: str = "label", prediction: str = "prediction"):
        super().__init__()
        self.hidden, self.alpha, self.max_iter, self.validation, self.patience, self.seed = tuple(hidden), alpha, max_iter, validation, patience, seed
        self.columns = (features, label, prediction)

    def _fit(self, df: DataFrame) -> "MultilayerRegressionModel":
        features, label, prediction = self.columns
        blocks = packed(df, features, label)
        try:
            return MultilayerRegressionModel(self._trained(blocks), features, label, prediction)
        finally:
            blocks.unpersist()

    def _trained(self, blocks: DataFrame) -> dict[str, np.ndarray]:
        first = blocks.select("width").first()
        if first is None:
            raise ValueError("no rows to fit")
        n, total, squares = summed(blocks, 3, lambda rows: sum((np.array([len(y), y.sum(), y @ y]) for _, y in rows), np.zeros(3)))
        mean, std = total / n, np.sqrt(max(squares / n - (total / n) ** 2, 0.0)) or 1.0
        layers = (first.width, *self.hidden, 1)
        every, alpha = self.validation, self.alpha
        biases = np.concatenate([np.r_[np.zeros((a - 1) * b), np.ones(b)] for a, b in shapes(layers)]).astype(bool)
        last = {}

        def fun(params: np.ndarray) -> tuple[float, np.ndarray]:
            def task(rows: Rows) -> np.ndarray:
                loss, grad, used, held = 0.0, np.zeros(len(params)), 0, 0.0
                for x, y in rows:
                    z = (y - mean) / std
                    out = np.arange(len(z)) % every == every - 1 if every else np.zeros(len(z), bool)
                    one, g = loss_and_gradient(params, layers, x[~out], z[~out])
                    loss, grad, used = loss + one, grad + g, used + int((~out).sum())
                    if out.any():
                        e = forward(unflattened(params, layers), x[out])[-1][:, 0] - z[out]
                        held += float(e @ e)
                return np.concatenate(([loss, used, held], grad))

            sums = summed(blocks, len(params) + 3, task)
            used = max(1.0, sums[1])
            free = np.where(biases, 0.0, params)
            last["held"] = sums[2]
            return sums[0] / used + 0.5 * alpha * float(free @ free) / used, sums[3:] / used + alpha * free / used

        best = {"held": np.inf, "params": None, "since": 0}

        def watch(params: np.ndarray) -> bool:
            if last["held"] < best["held"] * (1 - 1e-4):
                best.update(held=last["held"], params=params.copy(), since=0)
            else:
                best["since"] += 1
            return best["since"] >= self.patience

        # few rows have none held out: then there is nothing to watch
        watched = watch if every and n > every else None
        params = lbfgs(fun, start_weights(layers, self.seed), self.max_iter, tol=1e-9, watch=watched)
        if watched and best["params"] is not None:
            params = best["params"]
        return {"params": params, "layers": np.array(layers), "scale": np.array([mean, std])}


class MultilayerRegressionModel(ArrayModel):
    @staticmethod
    def values(arrays: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
        mean, std = arrays["scale"]
        weights = unflattened(arrays["params"], tuple(arrays["layers"].tolist()))
        return mean + std * forward(weights, x)[-1][:, 0]
