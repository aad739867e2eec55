"""Data-parallel training: every epoch is one Spark job over all rows.

Rows are dealt by hash into a fixed number of shards, each in a fixed order. Every shard starts from the same weights, runs
mini-batches over its rows and returns its weights; their weighted mean starts the next epoch (parameter averaging,
as in parallel SGD by Zinkevich et al., 2010), and so does the mean of what the optimiser carries. Means are taken in the
order of the shards, so the result depends on their number but not on how the rows are partitioned. Only the weights
travel, cut into chunks that are averaged in parallel.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmarrow.operators.detectors.base import stacked

CHUNK = 4096
PART_SCHEMA = "shard int, chunk int, weights array<double>, n double"
SHARDS = 16


class Plain:
    """Every row is a sample."""

    def feed(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return stacked(rows["x"]), rows["held"].to_numpy(bool)


class Windows:
    """Samples are ``length`` consecutive rows of one ``run`` that end in an ``own`` row, flattened.

    The rows of a shard pass by in order and each is held once; windows are views of them.
    """

    def __init__(self, length: int):
        self.length, self.rest = length, None

    def feed(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        now = [stacked(rows["x"]), *(rows[c].to_numpy() for c in ("run", "own", "held"))]
        if self.rest is not None:
            now = [np.concatenate(pair) for pair in zip(self.rest, now)]
        x, run, own, held = now
        last = self.length - 1
        self.rest = [a[len(a) - last :] if last else a[:0] for a in now]
        if len(x) <= last:
            self.rest = now
            return np.zeros((0, self.length * x.shape[1])), np.zeros(0, bool)
        whole = (run[last:] == run[: len(x) - last]) & own[last:].astype(bool)
        views = np.lib.stride_tricks.sliding_window_view(x, self.length, axis=0)[whole]
        return views.transpose(0, 2, 1).reshape(len(views), self.length * x.shape[1]), held[last:][whole].astype(bool)


def dealt(rows: DataFrame, shards: int, row_id: str | None) -> DataFrame:
    """The rows by shard and in their order inside it; a row's id (else its values) decides both.

    Rows that have a ``shard`` and a ``place`` keep them.
    """
    if "shard" not in rows.columns:
        key = F.xxhash64(F.col(row_id or "x"))
        rows = rows.withColumns({"shard": F.pmod(key, F.lit(shards)).cast("int"), "place": F.xxhash64(key)})
    return rows.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "place", "x")


def averaged_training(
    rows: DataFrame,
    weights: np.ndarray,
    step: Callable[[np.ndarray, np.ndarray, dict], None],
    loss: Callable[[np.ndarray, np.ndarray], np.ndarray],
    epochs: int,
    batch_size: int = 32,
    patience: int | None = None,
    row_id: str | None = None,
    shards: int = SHARDS,
    samples: Callable[[], object] = Plain,
) -> tuple[np.ndarray, list[float]]:
    """Train on ``rows(x array<double>, held boolean)``; returns weights and validation losses.

    ``step(weights, batch, state)`` updates the weights in place; ``loss(weights, batch)`` gives one
    loss per row. ``state`` begins with the numbers of the ``epoch`` and the ``shard``; what a step leaves in
    ``state["carry"]`` (an array) is averaged like the weights and there again in the next epoch. Held-out rows only measure:
    they see the weights the epoch started with, so one
    job both trains and validates. The best weights win, or the newest ones if no row is held out;
    ``patience`` stops early. A loss that is not finite is an error.
    """
    kept = dealt(rows, shards, row_id).persist()
    best, best_loss, history, waited, carry = weights, np.inf, [], 0, None
    try:
        for epoch in range(epochs + 1):
            last = epoch == epochs  # the final pass only measures the last average
            mean, val = _epoch(kept, weights, carry, epoch, step, loss, batch_size, samples, train=not last)
            if val is None:  # nothing is held out: the newest average stands
                best = weights
            elif not np.isfinite(val):
                raise ValueError("the validation loss is not finite")
            elif val < best_loss - 1e-12:
                best, best_loss, waited = weights, val, 0
            else:
                waited += 1
            if val is not None:
                history.append(val)
            if mean is None or (patience is not None and waited >= patience):
                break
            weights, carry = mean[: len(weights)], mean[len(weights) :]
    finally:
        kept.unpersist()
    return best, history


class _Shard:
    """One shard on its way through an epoch; samples wait until a mini-batch is full, wherever Arrow cuts the rows."""

    def __init__(self, shard, start, carry, epoch, step, loss, batch_size, samples, train):
        self.shard, self.start, self.step, self.loss = shard, start, step, loss
        self.batch_size, self.samples, self.train = batch_size, samples(), train
        self.w, self.state = start.copy(), {"epoch": epoch, "shard": shard}
        if carry is not None and len(carry):
            self.state["carry"] = carry.copy()
        self.waiting, self.seen, self.held_n, self.held_loss = None, 0, 0, 0.0

    def feed(self, rows: pd.DataFrame) -> None:
        x, held = self.samples.feed(rows)
        if held.any():
            self.held_loss += float(self.loss(self.start, x[held]).sum())
            self.held_n += int(held.sum())
        fit = x[~held]
        self.seen += len(fit)
        if self.train:
            fit = fit if self.waiting is None else np.concatenate([self.waiting, fit])
            whole = len(fit) // self.batch_size * self.batch_size
            for k in range(0, whole, self.batch_size):
                self.step(self.w, fit[k : k + self.batch_size], self.state)
            self.waiting = fit[whole:]

    def end(self) -> list[tuple]:
        out = []
        if self.waiting is not None and len(self.waiting):
            self.step(self.w, self.waiting, self.state)
        if self.held_n:
            # NaN would arrive as null; infinity stays what it is
            value = self.held_loss / self.held_n if np.isfinite(self.held_loss) else np.inf
            out.append((self.shard, -1, [value], float(self.held_n)))
        if self.train and self.seen:
            told = np.concatenate([self.w, self.state.get("carry", np.zeros(0))])
            out += [(self.shard, k // CHUNK, told[k : k + CHUNK].tolist(), float(self.seen)) for k in range(0, len(told), CHUNK)]
        return out


def _epoch(rows, weights, carry, epoch, step, loss, batch_size, samples, train):
    start = np.array(weights, dtype=float)

    def run(batches):
        now = None
        for pdf in batches:
            shards = pdf["shard"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(shards)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                if now is None or now.shard != shards[lo]:
                    if now is not None:
                        yield pd.DataFrame(now.end(), columns=["shard", "chunk", "weights", "n"])
                    now = _Shard(int(shards[lo]), start, carry, epoch, step, loss, batch_size, samples, train)
                now.feed(pdf.iloc[lo:hi])
        if now is not None:
            yield pd.DataFrame(now.end(), columns=["shard", "chunk", "weights", "n"])

    def averaged(batches):
        """The mean of every chunk, added up in the order of the shards."""
        for pdf in batches:
            rows = []
            for chunk, parts in zip(pdf["chunk"], pdf["parts"]):
                total = sum(p["n"] for p in parts)
                mean = sum(np.asarray(p["weights"], dtype=float) * p["n"] for p in parts) / total
                rows.append((chunk, mean.tolist()))
            yield pd.DataFrame(rows, columns=["chunk", "mean"])

    parts = rows.drop("place").mapInPandas(run, PART_SCHEMA)
    ordered = F.sort_array(F.collect_list(F.struct("shard", "n", "weights")))  # one entry a shard
    means = parts.groupBy("chunk").agg(ordered.alias("parts")).mapInPandas(averaged, "chunk int, mean array<double>")
    found = {r["chunk"]: np.array(r["mean"]) for r in means.collect()}
    held = found.pop(-1, None)
    val = float(held[0]) if held is not None else None
    if not found:
        return None, val
    return np.concatenate([found[k] for k in sorted(found)]), val


def adam(w: np.ndarray, grad: np.ndarray, state: dict, rate: float = 1e-3) -> None:
    """One Adam update (Kingma and Ba, 2015) in place; its moments and step count are the carried array."""
    carry = state.setdefault("carry", np.zeros(2 * len(w) + 1))
    carry[-1] += 1
    m, v, t = carry[: len(w)], carry[len(w) : -1], carry[-1]
    m += 0.1 * (grad - m)
    v += 0.001 * (grad * grad - v)
    w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
