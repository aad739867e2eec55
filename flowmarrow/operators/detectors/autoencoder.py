"""Dense and LSTM autoencoders: the score is the reconstruction error of the scaled row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmarrow.operators.detectors.base import Detector, hash_draw, in_blocks, stacked
from flowmarrow.operators.detectors.nets import dense_net, lstm_net
from flowmarrow.operators.detectors.training import SHARDS, Windows, adam, averaged_training
from flowmarrow.operators.features import blocked_rows, sliding_sequences
from flowmarrow.operators.scaling import fit_scaler, scaled_array

#: Rows that go through a net together.
BLOCK = 512
#: Consecutive rows that go to one shard together.
TRAINING_BLOCK = 1_000


class _Reconstructing(Detector):
    """Shared by both nets: training, scoring and calibration on flat arrays ``x``."""

    epochs, batch_size, patience, seed, rate = 50, 32, 10, 42, 1e-3
    calibration_share = 0.99

    def _net(self):
        raise NotImplementedError

    def _shape(self) -> tuple[int, ...]:
        raise NotImplementedError

    def _arrays(self) -> dict[str, np.ndarray]:
        return {"weights": self.weights}

    def _restore(self, params, arrays) -> None:
        self.weights = arrays["weights"]

    def _fit(self, rows: DataFrame, row_id: str) -> None:
        held = rows.withColumn("held", self._is_held(row_id))
        self._train(held, row_id=row_id)
        self._calibrate_held(held)

    def _is_held(self, row_id: str) -> Column:
        return hash_draw(row_id, self.seed) >= 0.8

    def _train(self, rows: DataFrame, **how) -> None:
        net, _ = self._net()
        shape, seed, rate = self._shape(), self.seed, self.rate

        def step(w, batch, state):
            if "rng" not in state:
                state["rng"] = np.random.default_rng([seed, state["epoch"], state["shard"]])
            g = net.gradient(w, batch.reshape(-1, *shape), state["rng"])
            norm = np.linalg.norm(g)
            adam(w, g if norm <= 5.0 else g * (5.0 / norm), state, rate)

        loss = lambda w, batch: net.row_loss(w, batch.reshape(-1, *shape))
        self.weights, self.history = averaged_training(
            rows, net.initial(seed), step, loss, self.epochs, self.batch_size, self.patience, **how
        )

    def _calibrate_held(self, rows: DataFrame) -> None:
        """Threshold from the held-out rows of (x, held)."""
        scores = lambda df: df.select(self._score(F.col("x")).alias("score"))
        self.calibrate(scores(rows.filter("held")), self.calibration_share)
        if self.threshold is None:  # too few rows to hold any out
            self.calibrate(scores(rows), self.calibration_share)

    def _score(self, x: Column) -> Column:
        net, _ = self._net()
        weights, shape = self.weights, self._shape()

        @F.pandas_udf("double")
        def error(batch: pd.Series) -> pd.Series:
            if len(batch) == 0:
                return pd.Series([], dtype=float)
            losses = lambda m: net.row_loss(weights, m)
            return pd.Series(in_blocks(losses, stacked(batch).reshape(-1, *shape), BLOCK))

        return error(x)

    def _mapped(self, x: Column, upto: int | None) -> Column:
        net, _ = self._net()
        weights, shape = self.weights, self._shape()

        @F.pandas_udf("array<double>")
        def out(batch: pd.Series) -> pd.Series:
            if len(batch) == 0:
                return pd.Series([], dtype=object)
            y = in_blocks(lambda m: net.forward(weights, m, upto=upto)[0], stacked(batch).reshape(-1, *shape), BLOCK)
            return pd.Series(list(y.reshape(len(y), -1)))

        return out(x)


class DenseAutoencoder(_Reconstructing):
    """width -> 2e -> e -> 2e -> width, relu inside, linear output."""

    name = "standard_ae"

    def __init__(
        self,
        encoding_dim: int = 12,
        hidden_multiplier: int = 2,
        dropout: float = 0.0,
        l2: float = 0.0,
        epochs: int = 50,
        batch_size: int = 32,
        patience: int = 10,
        seed: int = 42,
        rate: float = 1e-3,
    ) -> None:
        super().__init__()
        self.encoding_dim, self.hidden_multiplier, self.dropout, self.l2 = encoding_dim, hidden_multiplier, dropout, l2
        self.epochs, self.batch_size, self.patience, self.seed, self.rate = epochs, batch_size, patience, seed, rate
        self.weights = np.zeros(0)

    def _params(self) -> dict:
        names = ("encoding_dim", "hidden_multiplier", "dropout", "l2", "epochs", "batch_size", "patience", "seed", "rate")
        return {n: getattr(self, n) for n in names}

    def _net(self):
        return dense_net(len(self.columns), self.encoding_dim, self.hidden_multiplier, self.dropout, self.l2)

    def _shape(self) -> tuple[int, ...]:
        return (len(self.columns),)

    def _scaled(self) -> Column:
        return scaled_array(self.scaler)

    def encode(self, df: DataFrame, name: str = "latent") -> DataFrame:
        """The bottleneck vector of every row."""
        return df.withColumn(name, self._mapped(self._scaled(), self._net()[1]))

    def reconstruct(self, df: DataFrame, original: str = "original", expected: str = "expected") -> DataFrame:
        """Scaled input and output vectors, as the explainer takes them."""
        return df.withColumns({original: self._scaled(), expected: self._mapped(self._scaled(), None)})


class LstmAutoencoder(_Reconstructing):
    """Works on windows of consecutive rows; a window's label is that of its last row."""

    name = "lstm_ae"

    def __init__(
        self,
        sequence_length: int = 10,
        units: tuple[int, ...] = (64, 32),
        latent_dim: int = 16,
        dropout: float = 0.2,
        bidirectional: bool = False,
        epochs: int = 50,
        batch_size: int = 32,
        patience: int = 10,
        seed: int = 42,
        rate: float = 1e-3,
    ) -> None:
        super().__init__()
        self.sequence_length, self.units, self.latent_dim = sequence_length, tuple(units), latent_dim
        self.dropout, self.bidirectional = dropout, bidirectional
        self.epochs, self.batch_size, self.patience, self.seed, self.rate = epochs, batch_size, patience, seed, rate
        self.weights = np.zeros(0)

    def _params(self) -> dict:
        names = ("sequence_length", "units", "latent_dim", "dropout", "bidirectional", "epochs", "batch_size",
                 "patience", "seed", "rate")
        return {n: getattr(self, n) for n in names}

    def _net(self):
        return lstm_net(
            self.sequence_length, len(self.columns), self.units, self.latent_dim, self.dropout, self.bidirectional
        )

    def _shape(self) -> tuple[int, ...]:
        return (self.sequence_length, len(self.columns))

    def windows(
        self,
        df: DataFrame,
        order: list[str],
        host: str | None = None,
        label: str | None = None,
    ) -> DataFrame:
        """Sliding windows of the feature columns, global or per host."""
        return sliding_sequences(df, self.columns, order, self.sequence_length, host, label)

    def fit_windows(
        self, df: DataFrame, columns: list[str], order: list[str], host: str | None = None
    ) -> "LstmAutoencoder":
        """Scale on the rows, cut windows, train.

        Blocks of rows travel to the shards with the few rows before them; windows are cut inside the training tasks.
        """
        self.columns = list(columns)
        self.scaler = fit_scaler(df, self.columns)
        blocks = blocked_rows(df, self.columns, order, self.sequence_length, host, block=TRAINING_BLOCK)
        run = F.xxhash64("_block", *([host] if host else []))
        rows = blocks.select(
            F.pmod(F.xxhash64("_block"), F.lit(SHARDS)).cast("int").alias("shard"), F.struct("_block", "_ord").alias("place"), run.alias("run"),
            (F.col("_block") == F.col("_own")).alias("own"), self._is_held(order[-1]).alias("held"),
            self._scaled_row(F.col("cells")).alias("x"),
        )
        length = self.sequence_length
        self._train(rows, samples=lambda: Windows(length))
        flat = self.windows(df, order, host).select(self._flat(F.col("sequence")).alias("x"), self._is_held(order[-1]).alias("held"))
        self._calibrate_held(flat)
        return self

    def _scaled_row(self, row: Column) -> Column:
        mean = F.array(*[F.lit(m) for m, _ in self.scaler.values()])
        std = F.array(*[F.lit(s) for _, s in self.scaler.values()])
        return F.zip_with(F.zip_with(row, mean, lambda x, m: x - m), std, lambda x, s: x / s)

    def _flat(self, sequence: Column) -> Column:
        return F.flatten(F.transform(sequence, self._scaled_row))

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Score rows that carry a ``sequence`` column (see ``windows``)."""
        if "sequence" not in df.columns:
            raise ValueError("window rows with a 'sequence' column are needed")
        return df.withColumn(name, self._score(self._flat(F.col("sequence"))))
