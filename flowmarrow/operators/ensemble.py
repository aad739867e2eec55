"""Combining the predictions and scores of several detectors."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmarrow.functions.columns import flag
from flowmarrow.operators import metrics as mt
from flowmarrow.operators.ordered import percentiles
from flowmarrow.operators.scaling import stratified_folds
from flowmarrow.session import frozen

# Weights of the weighted score, and the sensitivity presets (factor, minimum score).
WEIGHTED_SCORE = {"isolation_forest": 0.70, "autoencoder": 0.30}
SENSITIVITY = {"high": (1.5, 0.8), "mid": (2.0, 1.0), "low": (3.0, 1.5)}
#: Fits that run side by side.
FITS = 3


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _decide(df: DataFrame, score: Column, prediction: Callable[[Column], Column]) -> DataFrame:
    scored = df.withColumn("score", score)
    return scored.withColumn("prediction", prediction(F.col("score")).cast("int"))


def vote(df: DataFrame, preds: list[str], threshold: float = 0.5) -> DataFrame:
    """Share of the 0/1 predictions that say anomaly; anomaly at or above ``threshold``."""
    share = _sum([F.col(p) for p in preds]) / F.lit(float(len(preds)))
    return _decide(df, share, lambda s: s >= threshold)


def weighted_vote(df: DataFrame, weights: dict[str, float], threshold: float = 0.5) -> DataFrame:
    total = sum(weights.values())
    share = _sum([F.col(p) * F.lit(float(w)) for p, w in weights.items()]) / F.lit(float(total))
    return _decide(df, share, lambda s: s >= threshold)


def any_vote(df: DataFrame, preds: list[str]) -> DataFrame:
    """Anomaly when at least one model says so."""
    top = F.greatest(*preds) if len(preds) > 1 else F.col(preds[0])
    return df.withColumn("prediction", top.cast("int"))


def average_scores(df: DataFrame, scores: list[str], threshold: float | None = None) -> DataFrame:
    """Mean score; anomaly above ``threshold``, by default above the 95th percentile."""
    mean = _sum([F.col(s) for s in scores]) / F.lit(float(len(scores)))
    scored = df.withColumn("score", mean)
    limit = F.lit(threshold)
    if threshold is None:
        limit = percentiles(scored.select("score"), "score", [0.95]).select("value").scalar()
    return scored.withColumn("prediction", (F.col("score") > limit).cast("int"))


def stack_fallback(df: DataFrame, scores: list[str]) -> DataFrame:
    """Without a meta-model: mean score above its median."""
    mean = _sum([F.col(s) for s in scores]) / F.lit(float(len(scores)))
    scored = df.withColumn("score", mean)
    median = percentiles(scored.select("score"), "score", [0.5]).select("value").scalar()
    return scored.withColumn("prediction", (F.col("score") > median).cast("int"))


def fit_stack(df: DataFrame, scores: list[str], y: str = "y"):
    """A logistic meta-model on the member scores; returns a DataFrame -> DataFrame scorer."""
    assemble = VectorAssembler(inputCols=scores, outputCol="_meta", handleInvalid="keep")
    meta = LogisticRegression(featuresCol="_meta", labelCol=y, probabilityCol="_prob", rawPredictionCol="_raw",
                              predictionCol="_pred").fit(assemble.transform(df))

    def score(rows: DataFrame) -> DataFrame:
        done = meta.transform(assemble.transform(rows))
        return done.withColumns(
            {"score": vector_to_array("_prob")[1], "prediction": F.col("_pred").cast("int")}
        ).drop("_meta", "_prob", "_raw", "_pred")

    return score


def out_of_fold(
    df: DataFrame, y: str, row_id: str, members: dict[str, Callable[[DataFrame], Callable[[DataFrame], DataFrame]]], k: int = 5
) -> DataFrame:
    """The rows with ``fold`` and the score of every member, each fitted on the other folds.

    A member is a function from training rows to a function that adds ``score``. These scores are what a meta-model may learn
    from: no member saw the row it scores. Fits are many small jobs, so ``FITS`` of them overlap.
    """
    folds = frozen(stratified_folds(df, y, row_id, k), "folds")
    wanted = [(fold, name) for fold in range(k) for name in members]
    with ThreadPoolExecutor(FITS) as pool:
        fits = pool.map(lambda w: members[w[1]](folds.filter(F.col("fold") != w[0])), wanted)
        fitted = dict(zip(wanted, fits))
    parts = []
    for fold in range(k):
        held = folds.filter(F.col("fold") == fold)
        for name in members:
            scored = fitted[fold, name](held)
            held = scored.select(*held.columns, F.col("score").alias(name))
        parts.append(held)
    return frozen(reduce(lambda a, b: a.unionByName(b), parts), "out-of-fold")


def min_max(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """(x - min) / (max - min + 1e-10) per column; one pass finds all bounds."""
    aggs = [f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    row = df.agg(*aggs).first()
    bounds = [(row[f"lo{i}"] or 0.0, row[f"hi{i}"] or 0.0) for i in range(len(columns))]
    return {c: (F.col(c) - F.lit(lo)) / F.lit(hi - lo + 1e-10) for c, (lo, hi) in zip(columns, bounds)}


def min_max_weighted(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of min-max normalised scores as ``score``."""
    normal = min_max(df, list(weights))
    return df.withColumn("score", _sum([normal[c] * F.lit(w) for c, w in weights.items()]))


def confidence_rule(df: DataFrame, primary: str, secondary: str) -> DataFrame:
    """The primary model decides; a secondary-only alarm is marked suspicious."""
    p, s = F.col(primary) == 1, F.col(secondary) == 1
    return df.withColumns({"prediction": flag(p), "suspicious": flag(~p & s)})


def live_vote(
    df: DataFrame, models: dict[str, tuple[str, str]], min_score: float | str = 1.0
) -> DataFrame:
    """Alert when at least two models agree (one model decides alone).

    ``models`` maps a name to its (prediction, score) columns; a vote needs the prediction and a
    score above ``min_score``. A model without a score on a row does not take part there.
    """
    floor = F.col(min_score) if isinstance(min_score, str) else F.lit(float(min_score))
    votes = _sum([flag((F.col(p) == 1) & (F.col(s) > floor)) for p, s in models.values()])
    present = _sum([F.col(s).isNotNull().cast("int") for _, s in models.values()])
    needed = F.when(present == 1, 1).otherwise(2)
    return df.withColumns({"votes": votes, "alert": (votes >= needed).cast("int")})


def sensitivity_threshold(base: float, level: str) -> tuple[float, float]:
    """(threshold, minimum score) of a preset."""
    factor, min_score = SENSITIVITY[level]
    return base * factor, min_score


class Ensemble:
    """Named members over prediction / score columns, combined by a chosen method."""

    def __init__(self, members: dict[str, tuple[str, str]] | None = None, weights: dict[str, float] | None = None):
        self.members = dict(members or {})
        self.weights = dict(weights or {})

    def add(self, name: str, prediction: str, score: str, weight: float = 1.0) -> "Ensemble":
        self.members[name] = (prediction, score)
        self.weights[name] = weight
        return self

    def remove(self, name: str) -> "Ensemble":
        self.members.pop(name, None)
        self.weights.pop(name, None)
        return self

    def predict(self, df: DataFrame, method: str = "voting", meta=None) -> DataFrame:
        if not self.members:
            raise ValueError("the ensemble has no members")
        absent = [c for pair in self.members.values() for c in pair if c not in df.columns]
        if absent:
            raise ValueError(f"missing member columns: {absent}")
        preds = [p for p, _ in self.members.values()]
        scores = [s for _, s in self.members.values()]
        if method == "voting":
            return vote(df, preds)
        if method == "weighted":
            return weighted_vote(df, {self.members[n][0]: self.weights.get(n, 1.0) for n in self.members})
        if method == "stacking":
            return meta(df) if meta is not None else stack_fallback(df, scores)
        if method == "averaging":
            return average_scores(df, scores)
        raise ValueError(f"unknown method {method!r}")

    def compare(self, df: DataFrame, y: str = "y", methods: tuple[str, ...] = ("voting", "weighted", "averaging", "stacking")) -> DataFrame:
        """Metrics of every method as rows, from one pass over the table."""
        own = df
        for m in methods:
            own = self.predict(own, m).withColumnRenamed("prediction", f"_p_{m}").drop("score")
        cells = [F.struct(F.lit(m).alias("model"), F.col(f"_p_{m}").alias("prediction")) for m in methods]
        long = own.select(y, F.inline(F.array(*cells)))
        return mt.binary_metrics(long, y, by=["model"])
