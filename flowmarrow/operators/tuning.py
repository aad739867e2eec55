"""Cross-validation and parameter search. Fits are Spark jobs; a small thread pool overlaps them."""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmarrow.operators import metrics as mt
from flowmarrow.operators import thresholds as th
from flowmarrow.operators.detectors import Detector, IsolationForest, LstmAutoencoder, OneClassSvm
from flowmarrow.operators.scaling import stratified_folds, stratified_split
from flowmarrow.session import frozen

# The searched parameters.
IFOREST_GRID = {
    "contamination": [0.05, 0.1, 0.15, 0.2],
    "n_estimators": [50, 100, 200],
    "max_samples": ["auto", 10_000, 16_000],
    "max_features": [0.5, 0.8, 1.0],
}
SVM_GRID = {
    "nu": [0.05, 0.1, 0.15, 0.2, 0.25],
    "kernel": ["rbf", "linear", "poly", "sigmoid"],
    "gamma": ["scale", "auto", 0.001, 0.01, 0.1],
}
LSTM_GRID = {
    "sequence_length": [5, 10, 15],
    "latent_dim": [8, 16, 32],
    "units": [[32, 16], [64, 32], [128, 64]],
    "dropout": [0.1, 0.2, 0.3],
}
RESULT_SCHEMA = "params string, fold int, f1 double, precision double, recall double"
RATES = ("f1", "precision", "recall")
#: Fits of a search that run side by side: each is some twenty small jobs.
FITS = 6


def candidates(grid: dict[str, list], n_iter: int | None = None, seed: int = 42) -> list[dict]:
    """All combinations, or ``n_iter`` of them drawn without repetition."""
    every = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    return every if n_iter is None else random.Random(seed).sample(every, min(n_iter, len(every)))


def cross_validate(
    df: DataFrame,
    columns: list[str],
    row_id: str = "conn_id",
    y: str = "y",
    k: int = 5,
    make: Callable[[], Detector] = IsolationForest,
    grid: list[float] = th.CV_GRID,
    threshold_on: str = "train",
) -> DataFrame:
    """Per fold: fit on the normals of the other folds, choose a percentile threshold, test.

    The threshold comes from the training folds; ``threshold_on='test'`` chooses it on the tested
    fold itself.
    """
    spark = df.sparkSession
    folds = stratified_folds(df.select(*dict.fromkeys([row_id, y, *columns])), y, row_id, k).persist()
    rows = []
    try:
        for fold in range(k):
            train, test = folds.filter(F.col("fold") != fold), folds.filter(F.col("fold") == fold)
            detector = make().fit(train.filter(F.col(y) == 0), columns, row_id)
            # the sweep and the metrics read the scores several times
            scored = frozen(detector.score(test if threshold_on == "test" else folds).select("fold", y, "score"), "fold-scores")
            tested = scored.filter(F.col("fold") == fold)
            judged = tested if threshold_on == "test" else scored.filter(F.col("fold") != fold)
            limit = th.best_f1(th.percentile_sweep(judged, grid, y)).first()["threshold"]
            m = mt.evaluate(tested, limit, y).first()
            rows.append((fold, limit, m["f1"], m["precision"], m["recall"], m["roc_auc"]))
    finally:
        folds.unpersist()
    return spark.createDataFrame(
        rows, "fold int, threshold double, f1 double, precision double, recall double, roc_auc double"
    )


def _fold_metrics(folds, fold, y, columns, row_id, detector, scorer):
    train, test = folds.filter(F.col("fold") != fold), folds.filter(F.col("fold") == fold)
    fitted = detector.fit(train.filter(F.col(y) == 0), columns, row_id)
    return scorer(fitted.predict(test), y).first()


def search(
    df: DataFrame,
    columns: list[str],
    make: Callable[..., Detector],
    grid: dict[str, list],
    row_id: str = "conn_id",
    y: str = "y",
    n_iter: int | None = None,
    k: int = 5,
    seed: int = 42,
    workers: int = FITS,
    scorer: Callable[[DataFrame, str], DataFrame] = mt.binary_metrics,
) -> DataFrame:
    """Grid (or random) search by F1 on held-out folds: one row per candidate and fold.

    ``scorer`` turns a predicted table into a row with f1, precision and recall.
    """
    spark = df.sparkSession
    folds = stratified_folds(df, y, row_id, k, seed).persist()
    tasks = [(p, f) for p in candidates(grid, n_iter, seed) for f in range(k)]

    def run(task):
        params, fold = task
        m = _fold_metrics(folds, fold, y, columns, row_id, make(**params), scorer)
        return (json.dumps(params), fold, *[m[r] for r in RATES])

    try:
        with ThreadPoolExecutor(workers) as pool:
            rows = list(pool.map(run, tasks))
    finally:
        folds.unpersist()
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def tune_isolation_forest(df, columns, n_iter=None, grid=IFOREST_GRID, **options) -> DataFrame:
    return search(df, columns, IsolationForest, grid, n_iter=n_iter, **options)


def tune_one_class_svm(df, columns, n_iter=None, grid=SVM_GRID, **options) -> DataFrame:
    return search(df, columns, OneClassSvm, grid, n_iter=n_iter, **options)


def tune_lstm(
    df: DataFrame,
    columns: list[str],
    order: list[str],
    y: str = "y",
    n_iter: int = 5,
    grid: dict[str, list] = LSTM_GRID,
    epochs: int = 10,
    patience: int = 3,
    seed: int = 42,
    host: str | None = None,
) -> DataFrame:
    """Random search of the LSTM autoencoder: F1 of window labels in the newest fifth of the rows."""
    spark = df.sparkSession
    rows = []
    train, test = split_by_time(df, order, 0.8)
    for params in candidates(grid, n_iter, seed):
        detector = LstmAutoencoder(**params, epochs=epochs, patience=patience, seed=seed)
        detector.fit_windows(train.filter(F.col(y) == 0), columns, order, host)
        windows = detector.windows(test, order, host, label=y)
        m = mt.binary_metrics(detector.predict(windows), y).first()
        rows.append((json.dumps(params), 0, *[m[r] for r in RATES]))
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def split_by_time(df: DataFrame, order: list[str], share: float) -> tuple[DataFrame, DataFrame]:
    """Older and newer rows around a percentile of the first order column."""
    at = F.unix_micros(F.col(order[0]).cast("timestamp"))
    cut = df.select(at.alias("t")).agg(F.percentile_approx("t", share, 10000).alias("c")).first()["c"]
    return df.filter(at <= cut), df.filter(at > cut)


def summarise(results: DataFrame) -> DataFrame:
    """Mean metrics per candidate, best F1 first."""
    means = [F.avg(r).alias(r) for r in RATES]
    return results.groupBy("params").agg(*means).orderBy(F.desc("f1"), "params")


def best_params(results: DataFrame) -> dict:
    return json.loads(summarise(results).first()["params"])


def tune_then_test(
    df: DataFrame,
    columns: list[str],
    makers: dict[str, tuple[Callable[..., Detector], dict[str, list]]],
    row_id: str = "conn_id",
    y: str = "y",
    n_iter: int | None = 5,
    k: int = 3,
) -> DataFrame:
    """Tune every model on 80 % of the rows and report its best version on the rest."""
    spark = df.sparkSession
    parts = stratified_split(df, y, row_id)
    train, test = parts.filter("split = 'train'").drop("split"), parts.filter("split = 'test'")
    rows = []
    for name, (make, grid) in makers.items():
        params = best_params(search(train, columns, make, grid, row_id, y, n_iter, k))
        fitted = make(**params).fit(train.filter(F.col(y) == 0), columns, row_id)
        m = mt.binary_metrics(fitted.predict(test), y).first()
        rows.append((name, json.dumps(params), *[m[r] for r in RATES]))
    return spark.createDataFrame(rows, "model string, params string, f1 double, precision double, recall double")
