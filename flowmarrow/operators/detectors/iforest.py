"""Isolation forest (Liu, Ting and Zhou, 2008)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmarrow.operators.detectors.base import Detector, hash_draw, in_blocks, stacked
from flowmarrow.operators.ordered import percentile_value

#: Rows that go through the trees together.
BLOCK = 256
NODE_SCHEMA = "tree int, node int, feature int, split double, low int, high int, depth double"


def average_path(n) -> np.ndarray:
    """Expected path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    c = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def build_tree(x: np.ndarray, features: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Random splits until a point stands alone or the height limit; rows of node entries."""
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, None, 0)]
    while stack:
        rows, depth, parent, side = stack.pop()
        here = len(nodes)
        if parent is not None:
            nodes[parent][side] = here
        part = x[rows][:, features]
        spread = features[part.max(axis=0) > part.min(axis=0)] if len(rows) > 1 else []
        if depth >= limit or len(spread) == 0:
            nodes.append([-1, 0.0, -1, -1, depth + float(average_path(len(rows)))])
            continue
        f = int(rng.choice(spread))
        values = x[rows, f]
        split = rng.uniform(values.min(), values.max())
        nodes.append([f, float(split), -1, -1, 0.0])
        left = values < split
        stack.append((rows[left], depth + 1, here, 2))
        stack.append((rows[~left], depth + 1, here, 3))
    return [(i, *n) for i, n in enumerate(nodes)]


class IsolationForest(Detector):
    """Trees are built one group each from a bounded hash sample; scoring is a vectorised UDF.

    ``max_samples`` is the number of rows per tree, 'auto' for 256, so a tree's group never grows with the data;
    a share is refused.
    """

    name = "isolation_forest"

    def __init__(
        self,
        contamination: float = 0.1,
        n_estimators: int = 100,
        max_samples: str | int = "auto",
        max_features: float = 1.0,
        seed: int = 42,
    ) -> None:
        super().__init__()
        self.contamination = contamination
        self.n_estimators = n_estimators
        self.max_samples = max_samples
        self.max_features = max_features
        self.seed = seed
        self.nodes = np.zeros((0, 7))
        self.sample_size = 256
        self.offset = 0.0

    def _params(self) -> dict:
        names = ("contamination", "n_estimators", "max_samples", "max_features", "seed")
        return {n: getattr(self, n) for n in names}

    def _arrays(self) -> dict[str, np.ndarray]:
        return {"nodes": self.nodes, "scalars": np.array([self.sample_size, self.offset])}

    def _restore(self, params, arrays) -> None:
        self.nodes = arrays["nodes"]
        self.sample_size, self.offset = int(arrays["scalars"][0]), float(arrays["scalars"][1])

    def _samples(self, rows: DataFrame, row_id: str, n: int) -> DataFrame:
        """(tree, x): ``sample_size`` rows per tree without replacement, chosen by hash.

        One cheap draw first keeps the few rows any tree could want, then each tree draws about
        twice its need and takes the smallest draws.
        """
        size, trees = self.sample_size, self.n_estimators
        pool = min(1.0, 4.0 * size * trees / n)
        share = min(1.0, 2.0 * size / (n * pool) + 20.0 / (n * pool))
        kept = rows.filter(hash_draw(row_id, self.seed) < pool)
        each = kept.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        draw = F.pmod(F.xxhash64(F.col(row_id), F.col("tree"), F.lit(self.seed + 1)), F.lit(1 << 40))
        drawn = each.withColumn("draw", draw / float(1 << 40)).filter(F.col("draw") < share)
        first = Window.partitionBy("tree").orderBy("draw", row_id)
        return drawn.withColumn("rk", F.row_number().over(first)).filter(F.col("rk") <= size)

    def _fit(self, rows: DataFrame, row_id: str) -> None:
        n = rows.count()
        if n == 0:
            raise ValueError("no training rows")
        wanted = 256 if self.max_samples == "auto" else self.max_samples
        if not isinstance(wanted, int) or wanted < 2:
            raise ValueError("max_samples is a number of rows, at least 2, or 'auto'")
        self.sample_size = max(2, min(wanted, n))
        width = len(self.columns)
        picked = max(1, int(self.max_features * width))
        seed = self.seed

        def grow(group: pd.DataFrame) -> pd.DataFrame:
            tree = int(group["tree"].iloc[0])
            rng = np.random.default_rng([seed, tree])
            features = np.sort(rng.permutation(width)[:picked])
            nodes = build_tree(stacked(group.sort_values("rk")["x"]), features, rng)
            return pd.DataFrame(
                [(tree, *node) for node in nodes],
                columns=["tree", "node", "feature", "split", "low", "high", "depth"],
            )

        grown = self._samples(rows, row_id, n).groupBy("tree").applyInPandas(grow, NODE_SCHEMA)
        table = grown.orderBy("tree", "node").toPandas()  # trees times nodes, fixed by parameters
        self.nodes = table.to_numpy(dtype=float)
        self.offset = 0.0
        scored = rows.select(self._score(F.col("x")).alias("score"))
        self.offset = percentile_value(scored, "score", 1.0 - self.contamination)
        self.threshold = 0.0

    def _score(self, x: Column) -> Column:
        nodes, offset = self.nodes, self.offset
        starts = np.searchsorted(nodes[:, 0], np.unique(nodes[:, 0]))
        base = np.repeat(starts, np.diff([*starts, len(nodes)]))
        leaf, split, depth = nodes[:, 2] < 0, nodes[:, 3], nodes[:, 6]
        feature = np.where(leaf, 0, nodes[:, 2]).astype(np.int32)
        # places of the children, high then low; a leaf leads to itself, so every row takes as many steps as the deepest leaf
        ends, here = nodes[:, 4:6] + base[:, None], np.arange(len(nodes))
        child = np.stack([np.where(leaf, here, ends[:, 1]), np.where(leaf, here, ends[:, 0])], axis=1).astype(np.int32).ravel()
        steps, level = 0, starts
        while not leaf[level].all():
            steps, level = steps + 1, child.reshape(-1, 2)[level[~leaf[level]]].ravel()
        norm = float(average_path(self.sample_size)) or 1.0

        def mean_depth(m: np.ndarray) -> np.ndarray:
            cells, first = m.ravel(), (np.arange(len(m), dtype=np.int32) * m.shape[1])[:, None]
            at = np.tile(starts.astype(np.int32), (len(m), 1))
            for _ in range(steps):
                at = child.take(2 * at + (cells.take(feature.take(at) + first) < split.take(at)))
            return depth.take(at).mean(axis=1)

        @F.pandas_udf("double")
        def isolation(batch: pd.Series) -> pd.Series:
            if len(batch) == 0:
                return pd.Series([], dtype=float)
            return pd.Series(np.power(2.0, -in_blocks(mean_depth, stacked(batch), BLOCK) / norm) - offset)

        return isolation(x)
