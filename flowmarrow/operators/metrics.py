"""Counts, confusion metrics, score curves and summaries."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmarrow.functions.columns import flag, safe_div
from flowmarrow.operators.ordered import first_rows, percentiles, prefix_sums, value_table
from flowmarrow.session import frozen


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per combination and their share of all rows in percent."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def confusion_columns(y: str = "y", pred: str = "prediction") -> list[Column]:
    """tn, fp, fn, tp as conditional sums, so one pass gives them all."""
    truth, said = F.col(y) == 1, F.col(pred) == 1
    cells = {"tn": ~truth & ~said, "fp": ~truth & said, "fn": truth & ~said, "tp": truth & said}
    return [F.coalesce(F.sum(flag(c)), F.lit(0)).alias(name) for name, c in cells.items()]


def with_rates(df: DataFrame) -> DataFrame:
    """accuracy, precision, recall, F1 (0 on an empty denominator), FPR (null if no normals)."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns(
        {
            "accuracy": safe_div(tp + tn, tp + tn + fp + fn),
            "precision": safe_div(tp, tp + fp),
            "recall": safe_div(tp, tp + fn),
            "f1": safe_div(2 * tp, 2 * tp + fp + fn),
            "false_positive_rate": F.when(fp + tn > 0, fp / F.greatest(fp + tn, F.lit(1.0))),
        }
    )


def binary_metrics(
    df: DataFrame, y: str = "y", pred: str = "prediction", by: list[str] | None = None
) -> DataFrame:
    """Confusion matrix and rates, overall or per group."""
    return with_rates(df.groupBy(*(by or [])).agg(*confusion_columns(y, pred)))


def score_table(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Distinct scores with their positive and negative rows: all that the curves and searches need."""
    rows = df.select(F.col(score).cast("double").alias("threshold"), F.col(y).cast("long").alias("y"))
    return value_table(rows, "threshold", {"pos": F.col("y"), "neg": 1 - F.col("y")})


def score_curve(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """One row per distinct score: tp / fp at ``>= score``, the tp / fp above it, and totals."""
    return curve_of(score_table(df, y, score))


def curve_of(table: DataFrame) -> DataFrame:
    sums = prefix_sums(table, "threshold", ["pos", "neg"])
    return sums.select(
        "threshold",
        (F.col("all_pos") - F.col("cum_pos") + F.col("pos")).alias("tp"),
        (F.col("all_neg") - F.col("cum_neg") + F.col("neg")).alias("fp"),
        (F.col("all_pos") - F.col("cum_pos")).alias("tp_above"),
        (F.col("all_neg") - F.col("cum_neg")).alias("fp_above"),
        F.col("all_pos").alias("positives"),
        F.col("all_neg").alias("negatives"),
    )


def roc_curve(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) for every observed score."""
    return roc_of(score_curve(df, y, score))


def roc_of(curve: DataFrame) -> DataFrame:
    return curve.select(
        "threshold",
        F.try_divide(F.col("fp").cast("double"), "negatives").alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), "positives").alias("tpr"),
    )


def roc_auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    return auc_of(score_curve(df, y, score))


def auc_of(curve: DataFrame) -> DataFrame:
    """Trapezoid area; each row holds both ends of its step. Null when a class is missing."""
    height = (F.col("tp") + F.col("tp_above")) / F.lit(2.0)
    step = (F.col("fp") - F.col("fp_above")) * height
    pairs = F.max("positives").cast("double") * F.max("negatives")
    return curve.agg(F.when(pairs > 0, F.sum(step) / pairs).alias("roc_auc"))


def _precision(tp: str, fp: str) -> Column:
    hits, alarms = F.col(tp).cast("double"), F.col(tp) + F.col(fp)
    return F.when(alarms == 0, F.lit(1.0)).otherwise(hits / alarms)


def pr_curve(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """(threshold, precision, recall) per observed score, and the end point (null, 1, 0)."""
    curve = pr_of(score_curve(df, y, score))
    end = curve.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return curve.unionByName(end)


def pr_of(curve: DataFrame) -> DataFrame:
    recall = F.try_divide(F.col("tp").cast("double"), "positives")
    return curve.select("threshold", _precision("tp", "fp").alias("precision"), recall.alias("recall"))


def pr_auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    curve = score_curve(df, y, score)
    width = F.try_divide((F.col("tp") - F.col("tp_above")).cast("double"), "positives")
    height = (_precision("tp", "fp") + _precision("tp_above", "fp_above")) / 2
    return curve.agg(F.sum(width * height).alias("pr_auc"))


def evaluate(df: DataFrame, threshold: float, y: str = "y", score: str = "score") -> DataFrame:
    """All metrics of the decision ``score >= threshold`` and the ROC-AUC, as one row."""
    decided = df.withColumn("prediction", (F.col(score) >= threshold).cast("int"))
    return binary_metrics(decided, y).withColumns(
        {"threshold": F.lit(float(threshold)), "roc_auc": roc_auc(df, y, score).scalar()}
    )


def class_report(df: DataFrame, y: str = "y", pred: str = "prediction") -> DataFrame:
    """precision / recall / F1 / support per class, plus macro and weighted averages.

    The pair counts (classes squared) are all that leaves the first aggregation.
    """
    pairs = df.groupBy(F.col(y).cast("string").alias("y"), F.col(pred).cast("string").alias("p")).agg(
        F.count("*").alias("n")
    )
    pairs = frozen(pairs, "class-pairs")
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said")),
                F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said")),
            )
        ).alias("s"),
        F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0)).alias("hit"),
    )
    classes = sides.groupBy("s.class").agg(
        F.sum("s.support").alias("support"),
        F.sum("s.said").alias("said"),
        (F.sum("hit") / 2).alias("hit"),  # counted once on each side
    )
    rated = classes.select(
        "class",
        safe_div(F.col("hit"), F.col("said")).alias("precision"),
        safe_div(F.col("hit"), F.col("support")).alias("recall"),
        safe_div(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"),
        "support",
    )
    names = ["precision", "recall", "f1"]
    macro = rated.agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in names],
                      F.sum("support").alias("support"))
    weighted = rated.agg(
        F.lit("weighted avg").alias("class"),
        *[safe_div(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names],
        F.sum("support").alias("support"),
    )
    return rated.unionByName(macro).unionByName(weighted)


def multiclass_confusion(df: DataFrame, y: str, pred: str, classes: list[str]) -> DataFrame:
    return df.groupBy(y).pivot(pred, classes).agg(F.count(F.lit(1))).fillna(0)


def accuracy(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"))


def per_attack_metrics(df: DataFrame, predictions: dict[str, str], y: str = "y") -> DataFrame:
    """Per attack type: row count and F1 / precision / recall of several models, in one pass.

    ``predictions`` maps a model name to its 0/1 column.
    """
    truth = F.col(y) == 1
    aggs = [F.count("*").alias("count")]
    for name, c in predictions.items():
        said = F.col(c) == 1
        tp = F.sum(flag(truth & said)).cast("double")
        fp, fn = F.sum(flag(~truth & said)), F.sum(flag(truth & ~said))
        aggs += [
            safe_div(2 * tp, 2 * tp + fp + fn).alias(f"{name}_f1"),
            safe_div(tp, tp + fp).alias(f"{name}_precision"),
            safe_div(tp, tp + fn).alias(f"{name}_recall"),
        ]
    return df.groupBy("attack_type").agg(*aggs)


def score_summary(df: DataFrame, score: str = "score", pred: str = "prediction") -> DataFrame:
    """Totals of a scored table; zeros when it is empty."""
    n, hits = F.count("*"), F.coalesce(F.sum(pred), F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.agg(
        n.alias("total"),
        hits.alias("anomalies"),
        safe_div(hits.cast("double"), n).alias("anomaly_ratio"),
        zero(F.min(score)).alias("score_min"),
        zero(F.max(score)).alias("score_max"),
        zero(F.avg(score)).alias("score_mean"),
    )


def imbalance(df: DataFrame, label: str = "label", limit: float = 10.0) -> DataFrame:
    """Anomaly to normal ratio and whether it exceeds ``limit`` (0 normals count as exceeding)."""
    bad, good = F.sum(flag(F.col(label) == "anomaly")), F.sum(flag(F.col(label) == "normal"))
    return df.agg(
        bad.alias("anomalies"),
        good.alias("normals"),
        F.try_divide(bad.cast("double"), good).alias("ratio"),
        ((good == 0) & (bad > 0) | (good > 0) & (bad > limit * good)).alias("imbalanced"),
    )


def baseline_stats(df: DataFrame, value: str) -> DataFrame:
    """Mean, population deviation, exact median and count."""
    median = percentiles(df, value, [0.5]).select("value").scalar()
    return df.agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("count")
    ).withColumn("median", median)


def median_threshold(df: DataFrame, value: str, factor: float = 3.0) -> DataFrame:
    """median + factor * population deviation."""
    return baseline_stats(df, value).select(
        "median", "std", (F.col("median") + factor * F.col("std")).alias("threshold")
    )


def histogram(df: DataFrame, value: str, by: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram per class over the common range; the last bin is closed."""
    ends = df.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    low = F.lit(ends["low"])
    width = (F.lit(ends["high"]) - low) / bins
    raw = F.floor(F.try_divide(F.col(value) - low, width))
    index = F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1))
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(by, index.cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
        .withColumn("left_edge", low + F.col("bin") * width)
    )


def histogram_on_edges(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts per bin of strictly increasing edges; the last bin is closed, outside is dropped."""
    inside = df.filter(F.col(value).between(edges[0], edges[-1]))
    binned = Bucketizer(splits=edges, inputCol=value, outputCol="_bin").transform(inside)
    return binned.groupBy(F.col("_bin").cast("int").alias("bin")).agg(F.count("*").alias("n"))


def cv_summary(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """Per metric over the folds: mean, population deviation, min, max, 95 % interval."""
    long = folds.select(
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
        ).alias("m")
    )
    half = 1.96 * F.stddev_pop("m.value") / F.sqrt(F.count("m.value"))
    return long.groupBy("m.metric").agg(
        F.avg("m.value").alias("mean"),
        F.stddev_pop("m.value").alias("std"),
        F.min("m.value").alias("min"),
        F.max("m.value").alias("max"),
        half.alias("ci95"),
    )


def dataset_info(df: DataFrame, n_features: int, split: str = "split", label: str = "label") -> DataFrame:
    return df.agg(
        F.count("*").alias("total"),
        F.sum(flag(F.col(split) == "train")).alias("train"),
        F.sum(flag(F.col(split) == "test")).alias("test"),
        F.sum(flag(F.col(label) == "normal")).alias("normal"),
        F.sum(flag(F.col(label) == "anomaly")).alias("anomaly"),
        F.lit(n_features).alias("features"),
    )


def best_model(metrics: DataFrame, by: str = "f1") -> DataFrame:
    """The model with the highest metric; the first name wins a tie."""
    return metrics.orderBy(F.desc(by), "model").limit(1)


def leaderboard(metrics: DataFrame, by: str = "f1") -> DataFrame:
    return metrics.orderBy(F.desc(by), "model")


def top_scores(df: DataFrame, score: str = "score", row_id: str = "conn_id", n: int = 50) -> DataFrame:
    return df.orderBy(F.desc(score), row_id).limit(n)


def last_rows(df: DataFrame, order: list[str], n: int | None = 1000) -> DataFrame:
    """The newest ``n`` rows (all when n is None)."""
    return df if n is None else first_rows(df, order, n, newest=True)


def trailing_count(df: DataFrame, ts: str, seconds: int = 3600) -> DataFrame:
    """Per distinct time: rows in the closed window from ``seconds`` before up to that time.

    The window is the difference of two running counts, so even a burst that puts most rows
    into one hour is spread over the time ranges.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    span = seconds * 1_000_000
    # one point for the rows themselves and one that reads the running count before the window
    own = F.struct((at * 2 + 1).alias("k"), F.lit(1).alias("n"), F.lit(0).alias("probe"))
    before = F.struct(((at - span) * 2).alias("k"), F.lit(0).alias("n"), F.lit(1).alias("probe"))
    points = df.filter(F.col(ts).isNotNull()).select(F.inline(F.array(own, before)))
    running = prefix_sums(value_table(points, "k", {"n": F.col("n")}), "k", ["n"])
    odd = F.pmod("k", F.lit(2)) == 1
    time = F.when(odd, (F.col("k") - 1) / 2).otherwise(F.col("k") / 2 + span).cast("long")
    signed = F.when(odd, F.col("cum_n")).otherwise(-F.col("cum_n"))
    both = running.groupBy(time.alias("t")).agg(F.sum(signed).alias("recent"), F.sum("n").alias("n"))
    # a probe of one time may coincide with the point of another; n > 0 keeps the real times
    return both.filter("n > 0").select(F.timestamp_micros("t").alias("ts"), "recent", "n")
