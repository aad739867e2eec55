"""One-class SVM: Nystroem features of a bounded set of landmarks, trained in the primal.

The kernel machine of the dual form needs all pairs of rows. Here the kernel is evaluated only
against ``landmarks`` sampled rows (Williams and Seeger, 2001), which turns the problem into a
linear one over all training rows: an approximation whose quality grows with the landmarks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmarrow.operators.detectors.base import Detector, hash_draw, stacked
from flowmarrow.operators.detectors.training import averaged_training
from flowmarrow.operators.ordered import percentile_value


def kernel(kind: str, gamma: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if kind == "rbf":
        square = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2.0 * a @ b.T
        return np.exp(-gamma * np.maximum(square, 0.0))
    if kind == "poly":
        return (gamma * a @ b.T) ** 3
    if kind == "sigmoid":
        return np.tanh(gamma * a @ b.T)
    return a @ b.T


class OneClassSvm(Detector):
    name = "one_class_svm"

    def __init__(
        self,
        nu: float = 0.1,
        kernel: str = "rbf",
        gamma: str | float = "scale",
        landmarks: int = 128,
        epochs: int = 15,
        seed: int = 42,
    ) -> None:
        super().__init__()
        if kernel not in ("rbf", "linear", "poly", "sigmoid"):
            raise ValueError(f"unknown kernel {kernel!r}")
        self.nu, self.kernel, self.gamma = nu, kernel, gamma
        self.landmarks, self.epochs, self.seed = landmarks, epochs, seed
        self.points = np.zeros((0, 0))
        self.basis = np.zeros((0, 0))
        self.weights = np.zeros(0)
        self.rho = 0.0

    def _params(self) -> dict:
        return {n: getattr(self, n) for n in ("nu", "kernel", "gamma", "landmarks", "epochs", "seed")}

    def _arrays(self) -> dict[str, np.ndarray]:
        return {"points": self.points, "basis": self.basis, "weights": self.weights, "rho": np.array([self.rho])}

    def _restore(self, params, arrays) -> None:
        self.points, self.basis, self.weights = arrays["points"], arrays["basis"], arrays["weights"]
        self.rho = float(arrays["rho"][0])

    def _gamma(self) -> float:
        # scaled columns have variance 1, so 'scale' and 'auto' agree
        return 1.0 / max(len(self.columns), 1) if isinstance(self.gamma, str) else float(self.gamma)

    def _map(self):
        kind, g, points, basis = self.kernel, self._gamma(), self.points, self.basis
        if kind == "linear":
            return lambda x: x
        return lambda x: kernel(kind, g, x, points) @ basis

    def _choose_landmarks(self, rows: DataFrame, row_id: str, n: int) -> None:
        share = min(1.0, 4.0 * self.landmarks / n + 50.0 / n)
        near = rows.withColumn("draw", hash_draw(row_id, self.seed)).filter(F.col("draw") < share)
        picked = near.orderBy("draw", row_id).limit(self.landmarks).select("x").toPandas()
        self.points = stacked(picked["x"])
        values, vectors = np.linalg.eigh(kernel(self.kernel, self._gamma(), self.points, self.points))
        good = values > max(values.max(), 0.0) * 1e-8
        self.basis = vectors[:, good] / np.sqrt(values[good])

    def _fit(self, rows: DataFrame, row_id: str) -> None:
        n = rows.count()
        if n == 0:
            raise ValueError("no training rows")
        width = len(self.columns)
        if self.kernel != "linear":
            self._choose_landmarks(rows, row_id, n)
            width = self.basis.shape[1]
        phi, nu, seed = self._map(), self.nu, self.seed

        def step(w, batch, state):
            # the best rho is the nu-quantile of w.phi, so the gradient is w minus the mean of
            # the share nu of the rows with the lowest projection
            t = state.setdefault("carry", np.zeros(1))
            t += 1
            z = phi(batch)
            lowest = np.argsort(z @ w)[: max(1, round(nu * len(z)))]
            w += 2.0 / (t[0] + 20.0) * (z[lowest].mean(axis=0) - w)

        def loss(w, batch):
            margin = phi(batch) @ w
            rho = np.quantile(margin, nu)
            return 0.5 * w @ w - rho + np.maximum(rho - margin, 0.0) / nu

        held = rows.withColumn("held", hash_draw(row_id, seed + 1) >= 0.8)
        self.weights, self.history = averaged_training(
            held, np.zeros(width), step, loss, self.epochs, 128, row_id=row_id
        )
        self.rho = 0.0
        # the nu-property: a share nu of the training rows lies outside
        scored = rows.select(self._score(F.col("x")).alias("score"))
        self.rho = -percentile_value(scored, "score", 1.0 - self.nu)
        self.threshold = 0.0

    def _score(self, x: Column) -> Column:
        phi, w, rho = self._map(), self.weights, self.rho

        @F.pandas_udf("double")
        def outside(batch: pd.Series) -> pd.Series:
            if len(batch) == 0:
                return pd.Series([], dtype=float)
            return pd.Series(rho - phi(stacked(batch)) @ w)

        return outside(x)
