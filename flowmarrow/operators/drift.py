"""Distribution drift and performance decay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmarrow.operators import metrics as mt
from flowmarrow.operators.ordered import percentile_values, prefix_sums, value_table
from flowmarrow.session import frozen

EMPTY_SHARE = 0.0001


def ks_statistic(
    baseline: DataFrame, current: DataFrame, value: str, weight: str | None = None
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance with both sample sizes, as one row.

    ``weight`` names the row counts of a baseline given as a table of distinct values.
    """
    one = lambda df, nb, nc: df.select(F.col(value).alias("v"), nb.cast("long").alias("nb"), nc.cast("long").alias("nc"))
    rows = F.col(weight) if weight else F.lit(1)
    both = one(baseline, rows, F.lit(0)).unionByName(one(current, F.lit(0), F.lit(1)))
    table = value_table(both, "v", {c: F.col(c) for c in ("nb", "nc")})
    sums = prefix_sums(table, "v", ["nb", "nc"])
    gap = F.abs(
        F.try_divide(F.col("cum_nb").cast("double"), "all_nb")
        - F.try_divide(F.col("cum_nc").cast("double"), "all_nc")
    )
    return sums.agg(
        F.max(gap).alias("statistic"),
        F.max("all_nb").alias("n_baseline"),
        F.max("all_nc").alias("n_current"),
    )


def ks_p_value(statistic: str | Column, n: str | Column, m: str | Column) -> Column:
    """Two-sided p-value by Kolmogorov's series, for all sizes.

    Below a scaled distance of 0.2 the series needs more terms than it has; there p differs from 1 by less than 1e-12.
    """
    d, n, m = (F.col(c) if isinstance(c, str) else c for c in (statistic, n, m))
    lam = d * F.sqrt(n * m / (n + m).cast("double"))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + 2 * F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * k * k * lam * lam),
    )
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def ks_drift(
    baseline: DataFrame,
    current: DataFrame,
    value: str,
    order: list[str] | None = None,
    window: int | None = 1000,
    limit: float = 0.05,
    weight: str | None = None,
) -> DataFrame:
    """KS test on the newest ``window`` rows of each side; drift when p < limit."""
    if order and window:
        baseline, current = mt.last_rows(baseline, order, window), mt.last_rows(current, order, window)
    found = ks_statistic(baseline, current, value, weight)
    return found.withColumns(
        {
            "method": F.lit("KS-test"),
            "p_value": ks_p_value("statistic", "n_baseline", "n_current"),
            "threshold": F.lit(limit),
        }
    ).withColumn("drift_detected", F.col("p_value") < limit)


def quantile_edges(baseline: DataFrame, value: str, bins: int = 10) -> list[float]:
    return percentile_values(baseline, value, [i / bins for i in range(bins + 1)])


def bin_of(value: str, edges: list[float]) -> Column:
    """0-based bin; the last one is closed, values outside the edges get null.

    Edges may be tied; a tied bin is then empty, as in a histogram on those edges.
    """
    v, last = F.col(value), len(edges) - 2
    passed = F.lit(0)
    for e in edges[1:-1]:
        passed = passed + (v >= e).cast("int")
    return F.when(v.between(edges[0], edges[-1]), F.least(passed, F.lit(last)))


def _shares(
    df: DataFrame, value: str, edges: list[float], by: list[str], name: str, weight: str | None = None
) -> DataFrame:
    """Per group an array with the share of all its rows per bin, 0 replaced by a small constant.

    The rows are counted per bin first, so the bin is worked out once per row.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, bin_of(value, edges).alias("bin"))
        .agg((F.sum(weight) if weight else F.count("*")).alias("k"))
    )
    n = F.sum("k")
    share = lambda i: safe_share(F.coalesce(F.sum(F.when(F.col("bin") == i, F.col("k"))), F.lit(0)), n)
    return counts.groupBy(*by).agg(F.array(*[share(i) for i in range(len(edges) - 1)]).alias(name))


def safe_share(k: Column, n: Column) -> Column:
    return F.when(k == 0, F.lit(EMPTY_SHARE)).otherwise(k / n.cast("double"))


def psi_of(current: Column, baseline: Column) -> Column:
    parts = F.zip_with(current, baseline, lambda c, b: (c - b) * F.ln(c / b))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def psi_drift(
    baseline: DataFrame,
    current: DataFrame,
    value: str,
    bins: int = 10,
    limit: float = 0.2,
    by: list[str] | None = None,
    edges: list[float] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Population stability index of the current rows, overall or per group ``by``.

    ``weight`` is as in ``ks_statistic``; it needs ``edges``. Values outside the baseline range fall into no bin but stay in the denominator.
    """
    edges = edges or quantile_edges(baseline, value, bins)
    base = _shares(baseline, value, edges, [], "b", weight).scalar()
    shares = _shares(current, value, edges, by or [], "c")
    paired = shares.withColumn("b", base)
    rows = paired.select(*(by or []), psi_of(F.col("c"), F.col("b")).alias("psi_value"))
    severity = (
        F.when(F.col("psi_value") > 0.3, "CRITICAL")
        .when(F.col("psi_value") > limit, "WARNING")
        .otherwise("OK")
    )
    return rows.withColumns(
        {
            "method": F.lit("PSI"),
            "threshold": F.lit(limit),
            "drift_detected": F.col("psi_value") > limit,
            "severity": severity,
        }
    )


def score_counts(df: DataFrame, by: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """(by, score, pos, neg): how often each score stands for either class in every period; rows without a score are left out.

    Such tables add up: the AUC of any span follows from the sum of the tables of its periods.
    """
    rows = df.select(*by, F.col(y).cast("long").alias("y"), F.col(score).cast("double").alias("score")).filter("score IS NOT NULL")
    return rows.groupBy(*by, "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))


def auc_of_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, roc_auc) of added-up score counts; null where only one class occurs. Tied scores count half."""
    added = frozen(counts.groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "score-counts")
    sums = prefix_sums(added, "score", ["pos", "neg"], by)
    won = F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)
    pairs = F.max("all_pos").cast("double") * F.max("all_neg")
    return sums.groupBy(*by).agg(F.try_divide(F.sum(won), pairs).alias("roc_auc"))


def performance_records(
    df: DataFrame, by: list[str], y: str = "y", pred: str = "prediction", score: str = "score"
) -> DataFrame:
    """One monitoring record per period, with the AUC of its scores."""
    auc = auc_of_counts(score_counts(df, by, y, score), by)
    auc = auc.select(*[F.col(c).alias(f"_{c}") for c in by], "roc_auc")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return mt.binary_metrics(df, y, pred, by=by).join(auc, same, "left").drop(*[f"_{c}" for c in by])


def degradation(records: DataFrame, baseline_f1: float, order: str, limit: float = 0.1) -> DataFrame:
    """Drop of the newest record's F1 below the baseline."""
    newest = records.agg(F.max_by("f1", order).alias("current_f1")).filter("current_f1 IS NOT NULL")
    drop = F.lit(baseline_f1) - F.col("current_f1")
    return newest.select(
        F.lit(baseline_f1).alias("baseline_f1"),
        "current_f1",
        drop.alias("degradation"),
        F.lit(limit).alias("threshold"),
        (drop > limit).alias("degraded"),
    )


def combined_check(
    baseline: DataFrame,
    current: DataFrame,
    value: str,
    order: list[str] | None = None,
    window: int | None = 1000,
) -> DataFrame:
    """KS and PSI together: retrain when either reports drift."""
    ks = ks_drift(baseline, current, value, order, window)
    psi = psi_drift(baseline, current, value)
    row = ks.select(
        F.col("statistic").alias("ks_statistic"),
        "p_value",
        F.col("drift_detected").alias("ks_drift"),
        psi.select("psi_value").scalar().alias("psi_value"),
        psi.select("drift_detected").scalar().alias("psi_drift"),
        psi.select("severity").scalar().alias("severity"),
    )
    hit = F.col("ks_drift") | F.col("psi_drift")
    return row.withColumns(
        {
            "drift_detected": hit,
            "recommendation": F.when(hit, "RETRAIN MODEL").otherwise("OK"),
        }
    )


def ks_by_window(baseline: DataFrame, current: DataFrame, value: str, window: str, ranges: int = 64) -> DataFrame:
    """KS distance of every window against the baseline, for any number of windows.

    The distance is reached at one of the window's own values or just below it. The baseline's running count comes
    from one table of all values; the window's from counts per (window, value range), so a window with very many
    values is many groups.
    """
    both = baseline.select(F.col(value).alias("v"), F.lit(1).alias("b")).unionByName(
        current.select(F.col(value).alias("v"), F.lit(0).alias("b"))
    )
    base = prefix_sums(value_table(both, "v", {"b": F.col("b")}), "v", ["b"]).select("v", "b", "cum_b", "all_b")
    own = current.filter(F.col(value).isNotNull()).groupBy(window, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    cuts = own.agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], 1000).alias("q")).first()["q"] or []
    part = F.lit(0)
    for cut in sorted(set(cuts)):
        part = part + (F.col("v") >= cut).cast("int")
    own = frozen(own.withColumn("part", part), "window-values")
    totals = own.groupBy(window, "part").agg(F.sum("c").alias("n"))  # a row for each window and range
    earlier = Window.partitionBy(window).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col(window).alias("_window"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy(window)).alias("all_c"),
    )
    inside = F.sum("c").over(Window.partitionBy(window, "part").orderBy("v"))
    ranked = own.withColumn("cum_c", inside)
    ranked = ranked.join(totals, ranked[window].eqNullSafe(totals["_window"]) & (ranked["part"] == totals["_part"])).join(base, "v")
    share = lambda k, n: F.try_divide(k.cast("double"), F.col(n))
    at = share(F.col("cum_b"), "all_b") - share(F.col("before") + F.col("cum_c"), "all_c")
    below = share(F.col("cum_b") - F.col("b"), "all_b") - share(F.col("before") + F.col("cum_c") - F.col("c"), "all_c")
    return ranked.groupBy(window).agg(F.max(F.greatest(F.abs(at), F.abs(below))).alias("statistic"))


def history_summary(history: DataFrame) -> DataFrame:
    """Checks, alerts and the newest check per method of an append-only drift history."""
    return history.groupBy("method").agg(
        F.count("*").alias("checks"),
        F.sum(F.col("drift_detected").cast("int")).alias("alerts"),
        F.max("checked_at").alias("last_check"),
        F.max_by("drift_detected", "checked_at").alias("last_drift"),
    )
