import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmarrow.operators import drift as dr
from flowmarrow.operators import ensemble as en
from flowmarrow.operators import metrics as mt
from flowmarrow.operators import scaling as sc
from flowmarrow.operators import thresholds as th


def scored(spark, n=800, seed=4, decimals=2):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    s = np.round(rng.normal(0, 1, n) + y, decimals)
    return y, s, spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], "conn_id long, y int, score double")


def at(y, s, t, strict=False):
    p = s > t if strict else s >= t
    tp, fp, fn = int((p & (y == 1)).sum()), int((p & (y == 0)).sum()), int((~p & (y == 1)).sum())
    return tp, fp, fn, len(y) - tp - fp - fn


def f1(y, s, t, strict=False):
    tp, fp, fn, _ = at(y, s, t, strict)
    return 2 * tp / (2 * tp + fp + fn) if tp else 0.0


def test_auc(spark, many_ranges):
    y, s, df = scored(spark)
    pairs = (s[y == 1][:, None] - s[y == 0][None, :])
    want = ((pairs > 0) + 0.5 * (pairs == 0)).mean()
    assert mt.roc_auc(df).first()[0] == pytest.approx(want)
    one_class = df.filter("y = 1")
    assert mt.roc_auc(one_class).first()[0] is None


def test_curves(spark, many_ranges):
    y, s, df = scored(spark)
    roc = {r["threshold"]: r for r in mt.roc_curve(df).collect()}
    pr = {r["threshold"]: r for r in mt.pr_curve(df).collect()}
    assert len(roc) == len(np.unique(s)) and pr[None]["precision"] == 1.0 and pr[None]["recall"] == 0.0
    area, last = 0.0, (0.0, 1.0)
    for t in sorted(roc, reverse=True):
        tp, fp, fn, tn = at(y, s, t)
        assert roc[t]["tpr"] == pytest.approx(tp / (tp + fn)) and roc[t]["fpr"] == pytest.approx(fp / (fp + tn))
        point = (tp / (tp + fn), tp / (tp + fp))
        assert (pr[t]["recall"], pr[t]["precision"]) == pytest.approx(point)
        area += (point[0] - last[0]) * (point[1] + last[1]) / 2
        last = point
    assert mt.pr_auc(df).first()[0] == pytest.approx(area)


def test_thresholds_against_brute_force(spark):
    y, s, df = scored(spark)
    table = mt.score_table(df)
    grid = np.percentile(s, np.linspace(0, 100, 1000))
    rates = th.grid_rates(table).cache()
    best = th.f_beta(rates).first()
    values = [f1(y, s, t, strict=True) for t in grid]
    assert best["f_beta"] == pytest.approx(max(values))
    assert best["threshold"] == pytest.approx(grid[int(np.argmax(values))])
    costs = [(lambda c: c[1] + 10 * c[2])(at(y, s, t, strict=True)) for t in grid]
    cheap = th.cost_sensitive(rates).first()
    assert cheap["total_cost"] == min(costs) and cheap["threshold"] == pytest.approx(grid[int(np.argmin(costs))])
    curve = mt.curve_of(table).cache()
    seen = np.unique(s)
    rows = [at(y, s, t) for t in seen]
    j = [tp / (tp + fn) - fp / (fp + tn) for tp, fp, fn, tn in rows]
    assert th.youden(curve).first()["j_score"] == pytest.approx(max(j))
    precise = [(tp / (tp + fn), t) for (tp, fp, fn, tn), t in zip(rows, seen) if tp / (tp + fp) >= 0.6]
    assert th.precision_target(curve, 0.6).first()["recall"] == pytest.approx(max(precise)[0])
    assert th.precision_target(curve, 1.01).count() == 0
    wide = [(tp / (tp + fp), t) for (tp, fp, fn, tn), t in zip(rows, seen) if tp / (tp + fn) >= 0.9]
    assert th.recall_target(curve, 0.9).first()["precision"] == pytest.approx(max(wide)[0])
    sweep = {r["percentile"]: r["f1"] for r in th.percentile_sweep(df).collect()}
    for p, value in sweep.items():
        assert value == pytest.approx(f1(y, s, np.percentile(s, p)))


def test_threshold_edges(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.0), (1, 2.0)], "y int, score double")
    got = {r["threshold"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in th.at_thresholds(df, [0.5, 1.0, 2.0, 9.0]).collect()}
    assert got == {0.5: (2, 1, 0, 0), 1.0: (2, 1, 0, 0), 2.0: (1, 0, 1, 1), 9.0: (0, 0, 2, 1)}
    strict = {r["threshold"]: (r["tp"], r["fp"]) for r in th.at_thresholds(df, [1.0, 2.0], strict=True).collect()}
    assert strict == {1.0: (1, 0), 2.0: (0, 0)}
    assert th.compare_methods(df).columns == ["method", "threshold", "precision", "recall", "objective"]


def test_empty_denominators(spark):
    df = spark.createDataFrame([(1, 0), (1, 0)], "y int, prediction int")
    m = mt.binary_metrics(df).first()
    assert (m["precision"], m["recall"], m["f1"], m["accuracy"]) == (0.0, 0.0, 0.0, 0.0)
    assert m["false_positive_rate"] is None
    none = mt.score_summary(df.withColumn("score", F.lit(1.0)).filter("y = 7")).first()
    assert tuple(none) == (0, 0, 0.0, 0.0, 0.0, 0.0)


def test_trailing_count(spark, many_ranges):
    rng = np.random.default_rng(8)
    base = dt.datetime(2024, 1, 1)
    times = [base + dt.timedelta(seconds=int(v)) for v in rng.integers(0, 9000, 300)]
    times += [base + dt.timedelta(hours=1)] * 100  # a burst
    got = mt.trailing_count(spark.createDataFrame([(t,) for t in times], "ts timestamp"), "ts").collect()
    assert len(got) == len(set(times))
    for r in got:
        t = r["ts"]
        assert r["recent"] == sum(t - dt.timedelta(hours=1) <= u <= t for u in times)


def ks_exact(n, d):
    """Share of lattice paths that leave the band, by counting all of them."""
    from math import comb

    h = round(d * n)
    inside = {0: 1}
    for _ in range(2 * n):
        step = {}
        for k, ways in inside.items():
            for m in (k - 1, k + 1):
                if abs(m) < h:
                    step[m] = step.get(m, 0) + ways
        inside = step
    return 1 - inside.get(0, 0) / comb(2 * n, n)


@pytest.mark.parametrize("n, d", [(200, 0.1), (400, 0.1), (400, 0.05), (50, 1.0), (50, 0.0), (400, 0.0025)])
def test_ks_p_value_equal_sizes(spark, n, d):
    """The series for all sizes is close to the exact law, which it is the limit of."""
    df = spark.createDataFrame([(d, n, n)], "d double, n long, m long")
    exact = ks_exact(n, d) if d else 1.0
    assert df.select(dr.ks_p_value("d", "n", "m")).first()[0] == pytest.approx(exact, abs=0.06)


def test_ks_by_window_against_plain(spark, many_ranges):
    rng = np.random.default_rng(4)
    base = np.round(rng.normal(0, 1, 300), 1)
    rows = [(int(w), float(np.round(rng.normal(w / 40, 1), 1))) for w in rng.integers(0, 80, 900)] + [(7, 9.0), (7, -9.0), (None, 0.1)]
    frame = spark.createDataFrame([(float(v),) for v in base], "v double")
    got = {r["w"]: r["statistic"] for r in dr.ks_by_window(frame, spark.createDataFrame(rows, "w int, v double"), "v", "w", ranges=5).collect()}
    grid = np.unique(np.concatenate([base, [v for _, v in rows]]))
    cdf = lambda x: np.searchsorted(np.sort(x), grid, side="right") / len(x)
    assert len(got) > 60
    for w, stat in got.items():
        own = np.array([v for k, v in rows if k == w])
        assert stat == pytest.approx(np.abs(cdf(base) - cdf(own)).max())


def test_ks_against_brute_force(spark, many_ranges):
    rng = np.random.default_rng(9)
    a, b = np.round(rng.normal(0, 1, 300), 1), np.round(rng.normal(0.4, 1, 200), 1)
    frame = lambda x: spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double")
    grid = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= v).mean() - (b <= v).mean()) for v in grid)
    got = dr.ks_drift(frame(a), frame(b), "v").first()
    assert got["statistic"] == pytest.approx(want) and got["drift_detected"] is True
    same = dr.ks_drift(frame(a), frame(a), "v").first()
    assert same["statistic"] == 0.0 and same["p_value"] == 1.0
    last = dr.ks_drift(frame(a), frame(b), "v", order=["i"], window=50).first()
    assert last["n_baseline"] == 50 and last["n_current"] == 50


def test_psi_against_numpy(spark):
    rng = np.random.default_rng(10)
    a, b = np.round(rng.gamma(2, 1, 500), 1), np.round(rng.gamma(2, 1.5, 400), 1)
    a[:200] = 1.0  # tied edges and empty bins
    frame = lambda x: spark.createDataFrame([(float(v),) for v in x], "v double")
    edges = np.percentile(a, np.linspace(0, 100, 11))
    share = lambda x: np.where((h := np.histogram(x, bins=edges)[0]) == 0, 1e-4, h / len(x))
    want = ((share(b) - share(a)) * np.log(share(b) / share(a))).sum()
    got = dr.psi_drift(frame(a), frame(b), "v").first()
    assert got["psi_value"] == pytest.approx(want)
    assert got["severity"] == ("CRITICAL" if want > 0.3 else "WARNING" if want > 0.2 else "OK")
    both = dr.combined_check(frame(a), frame(b), "v").first()
    assert both["recommendation"] == "RETRAIN MODEL"


def test_degradation(spark):
    records = spark.createDataFrame([(1, 0.95), (2, 0.7)], "day int, f1 double")
    got = dr.degradation(records, 0.9, "day").first()
    assert got["degraded"] is True and got["degradation"] == pytest.approx(0.2)
    assert dr.degradation(records.filter("day > 5"), 0.9, "day").count() == 0


def test_live_votes(spark):
    rows = [(1, 2.0, None, None), (1, 2.0, 0, 2.0), (1, 2.0, 1, 2.0), (1, 0.5, None, None)]
    df = spark.createDataFrame(rows, "pa int, sa double, pb int, sb double")
    got = en.live_vote(df, {"a": ("pa", "sa"), "b": ("pb", "sb")}, 1.0)
    assert [r["alert"] for r in got.collect()] == [1, 0, 1, 0]


def test_ensemble_api(spark):
    made = en.Ensemble().add("a", "pa", "sa").add("b", "pb", "sb").remove("b")
    df = spark.createDataFrame([(1, 0.9), (0, 0.1)], "pa int, sa double")
    for method in ("voting", "weighted", "averaging", "stacking"):
        assert [r["prediction"] for r in made.predict(df, method).collect()] == ([1, 0])
    with pytest.raises(ValueError):
        made.predict(df, "unknown")
    with pytest.raises(ValueError):
        en.Ensemble().predict(df)
    with pytest.raises(ValueError):
        made.add("c", "absent", "absent").predict(df)


def test_splits(spark):
    df = spark.range(1000).select(F.col("id").alias("conn_id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    parts = sc.stratified_split(df, "y", "conn_id").groupBy("y", "split").count().collect()
    assert {(r["y"], r["split"]): r["count"] for r in parts} == {(0, "train"): 720, (0, "test"): 180, (1, "train"): 80, (1, "test"): 20}
    folds = sc.stratified_folds(df, "y", "conn_id").groupBy("fold", "y").count().collect()
    assert len(folds) == 10 and {r["count"] for r in folds} == {180, 20}
    again = sc.stratified_split(df.repartition(5), "y", "conn_id")
    assert again.join(sc.stratified_split(df, "y", "conn_id"), ["conn_id", "split"]).count() == 1000
    share = sc.hash_split(df, "conn_id").filter("split = 'train'").count()
    assert 740 < share < 860


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = sc.scale(df, sc.fit_scaler(df, ["a", "b"])).collect()
    assert [tuple(r) for r in got] == [(-1.0, 0.0), (1.0, 0.0)]
    vec = df.select(F.array("a", "b").alias("v"))
    done = sc.scale_vector(vec, "v", sc.fit_vector_scaler(vec, "v")).collect()
    np.testing.assert_allclose([r["v"] for r in done], [[-1, 0], [1, 0]])


def test_the_auc_of_a_span_from_the_tables_of_its_periods(spark):
    rng = np.random.default_rng(4)
    rows = [(f"p{i % 3}", int(rng.random() < 0.4), float(rng.integers(0, 12))) for i in range(600)] + [("one", 1, 2.0), (None, 0, 1.0), ("p0", 1, None)]
    df = spark.createDataFrame(rows, "period string, y int, score double").withColumn("prediction", (F.col("score") > 6).cast("int"))

    def plain(mine):
        pos, neg = [s for _, y, s in mine if y and s is not None], [s for _, y, s in mine if not y and s is not None]
        return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None

    counts = dr.score_counts(df, ["period"]).persist()
    got = {r.period: r.roc_auc for r in dr.auc_of_counts(counts, ["period"]).collect()}
    for p in ("p0", "p1", "p2", "one", None):
        want = plain([r for r in rows if r[0] == p])
        assert got[p] == (want if want is None else pytest.approx(want))
    span = dr.auc_of_counts(counts.filter("period IN ('p0', 'p1')").withColumn("period", F.lit("span")), ["period"]).first().roc_auc
    assert span == pytest.approx(plain([r for r in rows if r[0] in ("p0", "p1")]))
    records = {r.period: r for r in dr.performance_records(df, ["period"]).collect()}
    assert records["p1"].roc_auc == pytest.approx(got["p1"]) and records["one"].roc_auc is None and records[None].roc_auc is None
