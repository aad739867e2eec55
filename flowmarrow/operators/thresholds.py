"""Decision-threshold search. Every method reads the scores once or twice, never per threshold."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmarrow.functions.columns import safe_div
from flowmarrow.operators import metrics as mt
from flowmarrow.operators.ordered import percentile_values, with_range

# The percentile grids of the searches.
WIDE_GRID = [50, 60, 70, 75, 80, 85, 90, 95]
SVM_GRID = [70, 75, 80, 85, 90, 95]
AE_GRID = [90, 92, 94, 95, 96, 97, 98, 99]
CV_GRID = [60, 65, 70, 75, 80]
VOTE_STEPS = [round(0.30 + 0.05 * i, 2) for i in range(10)]


def at_thresholds(
    df: DataFrame,
    thresholds: list[float],
    y: str = "y",
    score: str = "score",
    strict: bool = False,
) -> DataFrame:
    """Confusion counts and rates at each of a bounded list of thresholds, in one pass.

    Scores fall into the ranges between thresholds (map-side combine leaves one row per range
    and task); running sums over the ranges then give every threshold. ``score > t`` is the
    same as ``score >= `` the next double after ``t``.
    """
    rows = df.filter(F.col(score).isNotNull()).select(
        F.col(score).cast("double").alias("threshold"),
        F.col(y).cast("long").alias("pos"),
        (1 - F.col(y)).cast("long").alias("neg"),
    )
    return table_rates(rows, thresholds, strict)


def table_rates(rows: DataFrame, thresholds: list[float], strict: bool = False) -> DataFrame:
    """The same on rows ``(threshold, pos, neg)``, such as a score table."""
    spark = rows.sparkSession
    distinct = sorted(set(float(t) for t in thresholds))
    bounds = [math.nextafter(t, math.inf) if strict else t for t in distinct]
    ranged = with_range(rows, "threshold", bounds)
    counts = ranged.groupBy(F.col("_range").cast("int").alias("i")).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    slots = [(i, t) for i, t in enumerate([None, *distinct])]
    grid = spark.createDataFrame(slots, "i int, threshold double")
    # as many rows as thresholds from here on
    above = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    overall = Window.partitionBy(F.lit(1))
    zero = lambda c: F.coalesce(c, F.lit(0))
    table = F.broadcast(grid).join(counts, "i", "left").select(
        "threshold",
        zero(F.sum("pos").over(above)).alias("tp"),
        zero(F.sum("neg").over(above)).alias("fp"),
        zero(F.sum("pos").over(overall)).alias("p"),
        zero(F.sum("neg").over(overall)).alias("n"),
    )
    rows = table.filter("threshold IS NOT NULL").select(
        "threshold", "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"),
        (F.col("n") - F.col("fp")).alias("tn"),
    )
    return mt.with_rates(rows)


def percentile_sweep(
    df: DataFrame, grid: list[float] = WIDE_GRID, y: str = "y", score: str = "score"
) -> DataFrame:
    """Metrics of ``score >= percentile`` for each percentile of the grid."""
    table = mt.score_table(df, y, score)
    values = table_percentiles(table, [p / 100 for p in grid])
    names = df.sparkSession.createDataFrame(
        [(float(p), v) for p, v in zip(grid, values)], "percentile double, threshold double"
    )
    return F.broadcast(names).join(table_rates(table, values), "threshold")


def table_percentiles(table: DataFrame, shares: list[float]) -> list[float]:
    """Percentiles of the scores behind a score table (at most one number per share)."""
    weighted = table.select("threshold", (F.col("pos") + F.col("neg")).alias("n"))
    return percentile_values(weighted, "threshold", shares, weight="n")


def step_sweep(
    df: DataFrame, steps: list[float] = VOTE_STEPS, y: str = "y", score: str = "score"
) -> DataFrame:
    return at_thresholds(df, steps, y, score)


def best_f1(sweep: DataFrame) -> DataFrame:
    """Highest F1; the lowest threshold wins a tie."""
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)


def _first(rows: DataFrame, best: Column, tie: Column) -> DataFrame:
    return rows.orderBy(best, tie).limit(1)


def youden(curve: DataFrame) -> DataFrame:
    """Largest tpr - fpr over the observed scores; the highest threshold wins a tie."""
    roc = mt.roc_of(curve).withColumn("j_score", F.col("tpr") - F.col("fpr"))
    return _first(roc, F.desc("j_score"), F.desc("threshold"))


def grid_rates(table: DataFrame, low: float = 0.0, high: float = 100.0, points: int = 1000) -> DataFrame:
    """Rates of ``score > t`` at an even grid of percentiles of a score table."""
    values = table_percentiles(table, list(np.linspace(low / 100, high / 100, points)))
    return table_rates(table, values, strict=True)


def f_beta(rates: DataFrame, beta: float = 1.0) -> DataFrame:
    """Largest F-beta over the rates at a grid of strict thresholds; lowest threshold on a tie."""
    p, r = F.col("precision"), F.col("recall")
    value = safe_div((1 + beta**2) * p * r, beta**2 * p + r)
    rows = rates.withColumn("f_beta", value).filter("tp > 0")
    return _first(rows.select("threshold", "f_beta", "precision", "recall"), F.desc("f_beta"), F.asc("threshold"))


def cost_sensitive(rates: DataFrame, fp_cost: float = 1, fn_cost: float = 10) -> DataFrame:
    """Smallest fp * fp_cost + fn * fn_cost; lowest threshold on a tie."""
    cost = (F.col("fp") * fp_cost + F.col("fn") * fn_cost).cast("double")
    rows = rates.withColumn("total_cost", cost)
    chosen = rows.select("threshold", "total_cost", F.col("fp").alias("fp_count"), F.col("fn").alias("fn_count"))
    return _first(chosen, F.asc("total_cost"), F.asc("threshold"))


def precision_target(curve: DataFrame, target: float = 0.95) -> DataFrame:
    """Highest recall among observed thresholds with enough precision; no row if none has."""
    rows = mt.pr_of(curve).filter(F.col("precision") >= target)
    return _first(rows, F.desc("recall"), F.asc("threshold"))


def recall_target(curve: DataFrame, target: float = 0.95) -> DataFrame:
    """Highest precision among observed thresholds with enough recall; no row if none has."""
    rows = mt.pr_of(curve).filter(F.col("recall") >= target)
    return _first(rows, F.desc("precision"), F.asc("threshold"))


def pr_f1_optimal(curve: DataFrame) -> DataFrame:
    """Observed threshold with the highest F1 on the precision-recall curve."""
    return _first(_pr_f1(curve), F.desc("f1"), F.asc("threshold"))


def pr_precision_rule(curve: DataFrame, floor: float = 0.7) -> DataFrame:
    """Highest recall with precision at or above ``floor``, with its F1."""
    rows = _pr_f1(curve).filter(F.col("precision") >= floor)
    return _first(rows, F.desc("recall"), F.asc("threshold"))


def _pr_f1(curve: DataFrame) -> DataFrame:
    p, r = F.col("precision"), F.col("recall")
    return mt.pr_of(curve).withColumn("f1", 2 * (p * r) / (p + r + 1e-10))


def percentile_rule(table: DataFrame, share: float = 99.0) -> DataFrame:
    """Metrics of ``score > percentile`` on a score table."""
    return table_rates(table, table_percentiles(table, [share / 100]), strict=True)


def compare_methods(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Seven methods in one layout: method, threshold, precision, recall, objective.

    The scored rows are read once; all methods work on the table of distinct scores.
    """
    table = mt.score_table(df, y, score)
    curve, rates = mt.curve_of(table), grid_rates(table)
    null = F.lit(None).cast("double")

    def row(method: str, rows: DataFrame, objective: str) -> DataFrame:
        cell = lambda c: F.col(c) if c in rows.columns else null
        return rows.select(
            F.lit(method).alias("method"), "threshold", cell("precision").alias("precision"),
            cell("recall").alias("recall"), F.col(objective).cast("double").alias("objective"),
        )

    parts = [
        row("Youden", youden(curve), "j_score"),
        row("F1.0-score", f_beta(rates, 1.0), "f_beta"),
        row("F2.0-score", f_beta(rates, 2.0), "f_beta"),
        row("Cost-sensitive", cost_sensitive(rates), "total_cost"),
        row("Precision-0.9", precision_target(curve, 0.90), "recall"),
        row("Recall-0.9", recall_target(curve, 0.90), "precision"),
        row("Percentile-99", percentile_rule(table, 99.0), "f1"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def f1_curve(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """F1 of strict thresholds at 100 even percentiles from 80 to 99.9."""
    return grid_rates(mt.score_table(df, y, score), 80.0, 99.9, 100).select("threshold", "f1")
