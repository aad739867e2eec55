"""What all detectors share: scaling, thresholds, predictions, persistence."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmarrow.operators.ordered import percentile_value
from flowmarrow.operators.scaling import fit_scaler, scaled_array
from flowmarrow.session import cached_spread

# Detector names and the order in which a missing one is replaced.
FALLBACK_ORDER = ["ensemble", "standard_ae", "isolation_forest", "one_class_svm", "lstm_ae"]


def hash_draw(row_id: str | Column, seed: int) -> Column:
    """A number in [0, 1) from the row id; the same on every run and every partitioning."""
    key = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def stacked(series) -> np.ndarray:
    """A batch of equally long arrays as a matrix."""
    return np.stack(series.to_numpy()).astype(float)


def in_blocks(work: Callable[[np.ndarray], np.ndarray], m: np.ndarray, rows: int) -> np.ndarray:
    """The work on a few rows at a time, so that what it needs on the way stays in the cache and small, whatever the batch."""
    return np.concatenate([work(m[k : k + rows]) for k in range(0, len(m), rows)])


class Detector:
    """Protocol: ``fit`` learns from a table, ``score`` adds a score (high is anomalous).

    ``predict`` adds the 0/1 decision ``score > threshold``; rows are scaled once, inside.
    """

    name = "detector"

    def __init__(self) -> None:
        self.columns: list[str] = []
        self.scaler: dict[str, tuple[float, float]] = {}
        self.threshold: float | None = None

    # -- to be given by each detector
    def _fit(self, rows: DataFrame, row_id: str) -> None:
        """Learn from ``rows`` with columns (row_id, x), x being the scaled features."""
        raise NotImplementedError

    def _score(self, x: Column) -> Column:
        raise NotImplementedError

    def _params(self) -> dict:
        return {}

    def _arrays(self) -> dict[str, np.ndarray]:
        return {}

    def _restore(self, params: dict, arrays: dict[str, np.ndarray]) -> None:
        raise NotImplementedError

    # -- shared
    def fit(self, df: DataFrame, columns: list[str], row_id: str = "conn_id") -> Detector:
        self.columns = list(columns)
        self.scaler = fit_scaler(df, self.columns)
        rows = cached_spread(df.select(row_id, scaled_array(self.scaler).alias("x")))
        try:
            self._fit(rows, row_id)
        finally:
            rows.unpersist()
        return self

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        absent = [c for c in self.columns if c not in df.columns]
        if absent:
            raise ValueError(f"missing feature columns: {absent}")
        return df.withColumn(name, self._score(scaled_array(self.scaler)))

    def predict(
        self, df: DataFrame, threshold: float | None = None, score: str = "score", prediction: str = "prediction"
    ) -> DataFrame:
        limit = self.threshold if threshold is None else threshold
        if limit is None:
            raise ValueError("no threshold: fit or calibrate first")
        return self.score(df, score).withColumn(prediction, (F.col(score) > limit).cast("int"))

    def calibrate(self, scored: DataFrame, share: float) -> None:
        """Threshold at a percentile of the scores in ``scored``."""
        self.threshold = percentile_value(scored, "score", share)

    def save(self, spark: SparkSession, path: str) -> None:
        """Parameters as JSON text, numbers as a parquet table (name, shape, chunk, values)."""
        head = {
            "kind": type(self).__name__,
            "columns": self.columns,
            "scaler": {c: list(v) for c, v in self.scaler.items()},
            "threshold": self.threshold,
            "params": self._params(),
        }
        one = spark.createDataFrame([(json.dumps(head),)], "value string")
        one.coalesce(1).write.mode("overwrite").text(f"{path}/params")
        rows = []
        for name, a in self._arrays().items():
            flat = np.asarray(a, dtype=float).ravel()
            for k in range(0, max(len(flat), 1), 50_000):
                rows.append((name, list(np.shape(a)), k, flat[k : k + 50_000].tolist()))
        schema = "name string, shape array<int>, start int, values array<double>"
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/arrays")


def load_detector(spark: SparkSession, path: str) -> Detector:
    from flowmarrow.operators import detectors

    head = json.loads(spark.read.text(f"{path}/params").first()["value"])
    chunks: dict[str, list] = {}
    shapes: dict[str, list[int]] = {}
    for r in spark.read.parquet(f"{path}/arrays").collect():
        chunks.setdefault(r["name"], []).append((r["start"], r["values"]))
        shapes[r["name"]] = r["shape"]
    arrays = {
        n: np.concatenate([np.asarray(v) for _, v in sorted(c)]).reshape(shapes[n]) for n, c in chunks.items()
    }
    made = getattr(detectors, head["kind"])(**head["params"])
    made.columns = head["columns"]
    made.scaler = {c: tuple(v) for c, v in head["scaler"].items()}
    made.threshold = head["threshold"]
    made._restore(head["params"], arrays)
    return made


def choose_detector(available: dict[str, Detector], requested: str | None = None) -> tuple[str, Detector]:
    """The requested detector, else the first one available in the fixed order."""
    for name in [(requested or "ensemble").lower(), *FALLBACK_ORDER]:
        if available.get(name) is not None:
            return name, available[name]
    raise LookupError("no detector is available")


def score_all(df: DataFrame, detectors: dict[str, Detector]) -> DataFrame:
    """``score_<name>`` and ``pred_<name>`` of every detector side by side on the same rows."""
    for name, d in detectors.items():
        df = d.predict(df, score=f"score_{name}", prediction=f"pred_{name}")
    return df
