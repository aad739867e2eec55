"""Queries on drift, ensembles and scaling."""

from pyspark.sql import functions as F

from flowmarrow.operators import drift as dr
from flowmarrow.operators import ensemble as en
from flowmarrow.operators import metrics as mt
from flowmarrow.operators import scaling as sc
from flowmarrow.operators import thresholds as th
from flowmarrow.plans.metric_queries import CELLS, F1, PRECISION, RATES, RATES_SQL, RECALL, rounded
from flowmarrow.plans.registry import query
from flowmarrow.plans.tables import CONN, conn, r6, table

# ---- drift --------------------------------------------------------------------------------

CUT = "TIMESTAMP '1998-01-01'"


def _halves(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_shipdate")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return rows.filter(F.col("l_shipdate") < cut), rows.filter(F.col("l_shipdate") >= cut)


def psi_sql(base: str, current: str, value: str, group: str = "") -> str:
    """CTEs ending in ``psi``: one row (per group) with psi_value."""
    key = f"{group}, " if group else ""
    inside = f"WHERE {value} BETWEEN e[1] AND e[11]"
    bin_no = f"least(len(list_filter(e[2:10], lambda x: x <= {value})), 9)"
    return f"""edges AS (SELECT quantile_cont({value}, {[i / 10 for i in range(11)]}) AS e FROM {base}),
  bins AS (SELECT unnest(range(10)) AS bin),
  bc AS (SELECT {bin_no} AS bin, count(*) AS k FROM {base}, edges {inside} GROUP BY 1),
  cc AS (SELECT {key}{bin_no} AS bin, count(*) AS k FROM {current}, edges {inside} GROUP BY ALL),
  cn AS (SELECT {key}count(*) AS n FROM {current} {'GROUP BY ALL' if group else ''}),
  sh AS (SELECT {f'cn.{group}, ' if group else ''}bins.bin,
      CASE WHEN coalesce(bc.k, 0) = 0 THEN 0.0001 ELSE bc.k / CAST((SELECT count(*) FROM {base}) AS DOUBLE) END AS b,
      CASE WHEN coalesce(cc.k, 0) = 0 THEN 0.0001 ELSE cc.k / CAST(cn.n AS DOUBLE) END AS c
    FROM bins CROSS JOIN cn LEFT JOIN bc ON bc.bin = bins.bin
      LEFT JOIN cc ON cc.bin = bins.bin {f'AND cc.{group} = cn.{group}' if group else ''}),
  psi AS (SELECT {key}sum((c - b) * ln(c / b)) AS psi_value FROM sh {'GROUP BY ALL' if group else ''})"""


PSI_OUT = """round(psi_value, 6) AS psi_value, psi_value > 0.2 AS drift_detected,
  CASE WHEN psi_value > 0.3 THEN 'CRITICAL' WHEN psi_value > 0.2 THEN 'WARNING' ELSE 'OK' END AS severity"""


@query(
    f"""WITH base AS (SELECT * FROM lineitem WHERE l_shipdate < {CUT}),
      cur AS (SELECT * FROM lineitem WHERE l_shipdate >= {CUT}),
      {psi_sql('base', 'cur', 'l_extendedprice')} SELECT {PSI_OUT} FROM psi"""
)
def psi_drift(spark, sf_dir):
    base, cur = _halves(spark, sf_dir)
    found = dr.psi_drift(base, cur, "l_extendedprice")
    return found.select(r6("psi_value").alias("psi_value"), "drift_detected", "severity")


@query(
    f"""WITH {CONN}, base AS (SELECT duration FROM conn WHERE label = 'normal'),
      cur AS (SELECT CAST(week(ts) AS INTEGER) AS wk, duration * (1 + week(ts) / 4.0) AS duration FROM conn WHERE label = 'anomaly'),
      {psi_sql('base', 'cur', 'duration', 'wk')} SELECT wk, {PSI_OUT} FROM psi"""
)
def drift_by_window(spark, sf_dir):
    base, cur = _weekly(spark, sf_dir)
    found = dr.psi_drift(base, cur, "duration", by=["wk"])
    return found.select("wk", r6("psi_value").alias("psi_value"), "drift_detected", "severity")


def _weekly(spark, sf_dir):
    rows = conn(spark, sf_dir).withColumn("wk", F.weekofyear("ts"))
    stretched = F.col("duration") * (1 + F.col("wk") / 4.0)
    base = rows.filter("label = 'normal'").select("duration")
    return base, rows.filter("label = 'anomaly'").select("wk", stretched.alias("duration"))


def _windows(spark, sf_dir):
    rows = conn(spark, sf_dir).withColumn("wk", F.dayofyear("ts") * 24 + F.hour("ts"))
    stretched = F.col("duration") * (1 + F.hour("ts") / 4.0)
    base = rows.filter("label = 'normal'").select("duration")
    return base, rows.filter("label = 'anomaly'").select("wk", stretched.alias("duration"))


KS = """v AS (SELECT duration AS x, 1 AS b, 0 AS c FROM base UNION ALL SELECT duration, 0, 1 FROM cur),
  g AS (SELECT x, sum(b) AS b, sum(c) AS c FROM v GROUP BY x),
  r AS (SELECT sum(b) OVER w AS cb, sum(c) OVER w AS cc, sum(b) OVER () AS nb, sum(c) OVER () AS nc
    FROM g WINDOW w AS (ORDER BY x)),
  ks AS (SELECT max(abs(cb / CAST(nb AS DOUBLE) - cc / CAST(nc AS DOUBLE))) AS d,
    CAST(max(nb) AS BIGINT) AS nb, CAST(max(nc) AS BIGINT) AS nc FROM r)"""
# Kolmogorov's series in plain SQL
P_SERIES = """(SELECT CASE WHEN d * sqrt(nb * nc / CAST(nb + nc AS DOUBLE)) < 0.2 THEN 1.0 ELSE least(greatest(sum(
    2 * CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * d * d * nb * nc / (nb + nc))), 0), 1) END
  FROM range(1, 101) t(k))"""
CONN_CUT = "TIMESTAMP '2024-01-16'"


def _conn_halves(spark, sf_dir):
    rows = conn(spark, sf_dir).select("conn_id", "ts", "duration", "label")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return rows.filter(F.col("ts") < cut), rows.filter(F.col("ts") >= cut)


@query(
    f"""WITH {CONN}, base AS (SELECT * FROM conn WHERE ts < {CONN_CUT}),
      cur AS (SELECT * FROM conn WHERE ts >= {CONN_CUT}), {KS}
    SELECT round(d, 6) AS statistic, nb AS n_baseline, nc AS n_current, round({P_SERIES}, 6) AS p_value FROM ks"""
)
def ks_drift(spark, sf_dir):
    """All rows of both halves."""
    base, cur = _conn_halves(spark, sf_dir)
    found = dr.ks_drift(base, cur, "duration", window=None)
    return rounded(found, ["statistic", "p_value"], ["n_baseline", "n_current"])


LAST = "SELECT * FROM conn WHERE {cond} ORDER BY ts DESC, conn_id DESC LIMIT 1000"


@query(
    f"""WITH {CONN}, base AS ({LAST.format(cond=f'ts < {CONN_CUT}')}), cur AS ({LAST.format(cond=f'ts >= {CONN_CUT}')}), {KS}
    SELECT round(d, 6) AS statistic, nb AS n_baseline, nc AS n_current, round({P_SERIES}, 6) AS p_value, {P_SERIES} < 0.05 AS drift_detected FROM ks"""
)
def ks_drift_last_rows(spark, sf_dir):
    base, cur = _conn_halves(spark, sf_dir)
    found = dr.ks_drift(base, cur, "duration", order=["ts", "conn_id"])
    return rounded(found, ["statistic", "p_value"], ["n_baseline", "n_current", "drift_detected"])


@query(
    f"""WITH {CONN}, base AS (SELECT duration FROM conn WHERE label = 'normal'),
      cur AS (SELECT CAST(dayofyear(ts) * 24 + hour(ts) AS INTEGER) AS wk, duration * (1 + hour(ts) / 4.0) AS duration FROM conn WHERE label = 'anomaly'),
      v AS (SELECT w.wk, duration AS x, 1 AS b, 0 AS c FROM base, (SELECT DISTINCT wk FROM cur) w
        UNION ALL SELECT wk, duration, 0, 1 FROM cur),
      g AS (SELECT wk, x, sum(b) AS b, sum(c) AS c FROM v GROUP BY wk, x),
      r AS (SELECT wk, sum(b) OVER w AS cb, sum(c) OVER w AS cc, sum(b) OVER (PARTITION BY wk) AS nb,
        sum(c) OVER (PARTITION BY wk) AS nc FROM g WINDOW w AS (PARTITION BY wk ORDER BY x))
    SELECT wk, round(max(abs(cb / CAST(nb AS DOUBLE) - cc / CAST(nc AS DOUBLE))), 6) AS statistic FROM r GROUP BY wk"""
)
def ks_by_window(spark, sf_dir):
    """Every hour of the weeks is a window, several hundred of them."""
    base, cur = _windows(spark, sf_dir)
    return rounded(dr.ks_by_window(base, cur, "duration", "wk"), ["statistic"], ["wk"])


@query(
    f"""WITH {CONN}, base AS (SELECT * FROM conn WHERE ts < {CONN_CUT}),
      cur AS (SELECT * FROM conn WHERE ts >= {CONN_CUT}), {KS}, {psi_sql('base', 'cur', 'duration')}
    SELECT round(d, 6) AS ks_statistic, {P_SERIES} < 0.05 AS ks_drift, round(psi_value, 6) AS psi_value,
      psi_value > 0.2 AS psi_drift, ({P_SERIES} < 0.05) OR psi_value > 0.2 AS drift_detected,
      CASE WHEN ({P_SERIES} < 0.05) OR psi_value > 0.2 THEN 'RETRAIN MODEL' ELSE 'OK' END AS recommendation
    FROM ks, psi"""
)
def combined_drift(spark, sf_dir):
    base, cur = _conn_halves(spark, sf_dir)
    found = dr.combined_check(base, cur, "duration", window=None)
    keep = ["ks_drift", "psi_drift", "drift_detected", "recommendation"]
    return rounded(found, ["ks_statistic", "psi_value"], keep)


WEEK_PRED = f"""{CONN}, wp AS (SELECT date_trunc('week', ts) AS wk, CASE WHEN label = 'anomaly' THEN 1 ELSE 0 END AS y,
  CASE WHEN (label = 'anomaly' AND event_day % 3 <> 0) OR conn_id % 10 = 0 THEN 1 ELSE 0 END AS prediction
  FROM (SELECT *, day(ts) AS event_day FROM conn)),
  rec AS (SELECT wk, {CELLS} FROM wp GROUP BY wk), rated AS (SELECT wk, {F1} AS f1 FROM rec)"""


def _weekly_rows(spark, sf_dir):
    bad = F.col("label") == "anomaly"
    hit = (bad & (F.dayofmonth("ts") % 3 != 0)) | (F.col("conn_id") % 10 == 0)
    return conn(spark, sf_dir).select(
        F.date_trunc("week", "ts").alias("wk"), bad.cast("int").alias("y"), hit.cast("int").alias("prediction"),
        (F.col("orig_bytes") + F.when(bad, 1500).otherwise(0)).alias("score"),
    )


@query(
    f"""WITH {WEEK_PRED}, sc AS (SELECT date_trunc('week', ts) AS wk, CASE WHEN label = 'anomaly' THEN 1 ELSE 0 END AS y,
        orig_bytes + CASE WHEN label = 'anomaly' THEN 1500 ELSE 0 END AS score FROM conn),
      v AS (SELECT wk, score, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY wk, score),
      c AS (SELECT *, sum(neg) OVER (PARTITION BY wk ORDER BY score) AS below FROM v),
      auc AS (SELECT wk, CAST(sum(pos * (below - neg / 2.0)) AS DOUBLE) / CAST(sum(pos) * sum(neg) AS DOUBLE) AS a FROM c GROUP BY wk)
    SELECT wk, tn, fp, fn, tp, {RATES_SQL}, round(a, 6) AS roc_auc FROM rec JOIN auc USING (wk)"""
)
def performance_records(spark, sf_dir):
    found = dr.performance_records(_weekly_rows(spark, sf_dir), ["wk"])
    return rounded(found, [*RATES, "roc_auc"], ["wk", "tn", "fp", "fn", "tp"])


def _weekly_records(spark, sf_dir):
    return mt.binary_metrics(_weekly_rows(spark, sf_dir), by=["wk"])


@query(
    f"""WITH {WEEK_PRED}, last AS (SELECT arg_max(f1, wk) AS f FROM rated)
    SELECT CAST(0.9 AS DOUBLE) AS baseline_f1, round(f, 6) AS current_f1, round(0.9 - f, 6) AS degradation, 0.9 - f > 0.1 AS degraded FROM last"""
)
def perf_degradation(spark, sf_dir):
    found = dr.degradation(_weekly_records(spark, sf_dir), 0.9, "wk")
    return rounded(found, ["baseline_f1", "current_f1", "degradation"], ["degraded"])


@query(
    f"""WITH {CONN}, base AS (SELECT duration FROM conn WHERE label = 'normal'),
      cur AS (SELECT CAST(week(ts) AS INTEGER) AS wk, duration * (1 + week(ts) / 4.0) AS duration FROM conn WHERE label = 'anomaly'),
      {psi_sql('base', 'cur', 'duration', 'wk')}
    SELECT 'PSI' AS method, count(*) AS checks, CAST(sum(CASE WHEN psi_value > 0.2 THEN 1 ELSE 0 END) AS BIGINT) AS alerts,
      max(wk) AS last_check, arg_max(psi_value > 0.2, wk) AS last_drift FROM psi"""
)
def drift_history_summary(spark, sf_dir):
    base, cur = _weekly(spark, sf_dir)
    history = dr.psi_drift(base, cur, "duration", by=["wk"]).withColumnRenamed("wk", "checked_at")
    return dr.history_summary(history)


# ---- ensembles ----------------------------------------------------------------------------

MEMBERS = f"""{CONN}, mem AS (SELECT conn_id, CASE WHEN label = 'anomaly' THEN 1 ELSE 0 END AS y,
    duration / 49.002 AS sa, (orig_pkts - 1) / 99.0 AS sb, (conn_id % 97) / 96.0 AS sc FROM conn),
  ens AS (SELECT *, CASE WHEN sa > 0.15 THEN 1 ELSE 0 END AS pa, CASE WHEN sb > 0.6 THEN 1 ELSE 0 END AS pb,
    CASE WHEN sc > 0.5 THEN 1 ELSE 0 END AS pc FROM mem)"""


def members(spark, sf_dir):
    rows = conn(spark, sf_dir).select(
        "conn_id",
        (F.col("label") == "anomaly").cast("int").alias("y"),
        (F.col("duration") / 49.002).alias("sa"),
        ((F.col("orig_pkts") - 1) / F.lit(99.0)).alias("sb"),
        (F.col("conn_id") % 97 / F.lit(96.0)).alias("sc"),
    )
    flag = lambda c, t: (F.col(c) > t).cast("int")
    return rows.withColumns({"pa": flag("sa", 0.15), "pb": flag("sb", 0.6), "pc": flag("sc", 0.5)})


def _scored(df):
    return df.select("conn_id", r6("score").alias("score"), "prediction")


VOTE = "(pa + pb + pc) / 3.0"
WVOTE = "(pa * 0.5 + pb * 0.3 + pc * 0.2) / 1.0"
MEAN = "(sa + sb + sc) / 3.0"


@query(
    f"""WITH {MEMBERS} SELECT conn_id, round({VOTE}, 6) AS score, CASE WHEN {VOTE} >= 0.5 THEN 1 ELSE 0 END AS prediction FROM ens"""
)
def vote(spark, sf_dir):
    return _scored(en.vote(members(spark, sf_dir), ["pa", "pb", "pc"]))


@query(
    f"""WITH {MEMBERS} SELECT conn_id, round({WVOTE}, 6) AS score, CASE WHEN {WVOTE} >= 0.45 THEN 1 ELSE 0 END AS prediction FROM ens"""
)
def weighted_vote(spark, sf_dir):
    return _scored(en.weighted_vote(members(spark, sf_dir), {"pa": 0.5, "pb": 0.3, "pc": 0.2}, 0.45))


@query(f"WITH {MEMBERS} SELECT conn_id, greatest(pa, pb) AS prediction FROM ens")
def any_vote(spark, sf_dir):
    return en.any_vote(members(spark, sf_dir), ["pa", "pb"]).select("conn_id", "prediction")


@query(
    f"""WITH {MEMBERS}, m AS (SELECT conn_id, {MEAN} AS s FROM ens)
    SELECT conn_id, round(s, 6) AS score, CASE WHEN s > (SELECT quantile_cont(s, 0.95) FROM m) THEN 1 ELSE 0 END AS prediction FROM m"""
)
def avg_scores(spark, sf_dir):
    return _scored(en.average_scores(members(spark, sf_dir), ["sa", "sb", "sc"]))


@query(
    f"""WITH {MEMBERS}, m AS (SELECT conn_id, {MEAN} AS s FROM ens)
    SELECT conn_id, round(s, 6) AS score, CASE WHEN s > (SELECT quantile_cont(s, 0.5) FROM m) THEN 1 ELSE 0 END AS prediction FROM m"""
)
def stacking_fallback(spark, sf_dir):
    return _scored(en.stack_fallback(members(spark, sf_dir), ["sa", "sb", "sc"]))


MINMAX = f"""{MEMBERS}, lim AS (SELECT min(sa) AS la, max(sa) AS ha, min(sb) AS lb, max(sb) AS hb FROM ens),
  mm AS (SELECT conn_id, y, (sa - la) / (ha - la + 1e-10) * 0.7 + (sb - lb) / (hb - lb + 1e-10) * 0.3 AS s FROM ens, lim)"""


@query(f"WITH {MINMAX} SELECT conn_id, round(s, 6) AS score FROM mm")
def minmax_weighted(spark, sf_dir):
    found = en.min_max_weighted(members(spark, sf_dir), {"sa": 0.70, "sb": 0.30})
    return found.select("conn_id", r6("score").alias("score"))


@query(
    f"""WITH {MINMAX}, thr AS (SELECT unnest(CAST({th.VOTE_STEPS} AS DOUBLE[])) AS threshold),
      rates AS (SELECT threshold, sum(CASE WHEN s >= threshold THEN y ELSE 0 END) AS tp,
        sum(CASE WHEN s >= threshold THEN 1 - y ELSE 0 END) AS fp,
        sum(CASE WHEN s >= threshold THEN 0 ELSE y END) AS fn FROM thr, mm GROUP BY threshold)
    SELECT threshold, round({F1}, 6) AS f1, round({PRECISION}, 6) AS precision, round({RECALL}, 6) AS recall
    FROM rates ORDER BY {F1} DESC, rates.threshold LIMIT 1"""
)
def minmax_weighted_best(spark, sf_dir):
    scored = en.min_max_weighted(members(spark, sf_dir), {"sa": 0.70, "sb": 0.30})
    best = th.best_f1(th.step_sweep(scored))
    return rounded(best, ["f1", "precision", "recall"], ["threshold"])


@query(
    f"""WITH {MEMBERS} SELECT pa AS prediction, CASE WHEN pa = 0 AND pb = 1 THEN 1 ELSE 0 END AS suspicious,
      count(*) AS n FROM ens GROUP BY ALL"""
)
def confidence_rule(spark, sf_dir):
    found = en.confidence_rule(members(spark, sf_dir), "pa", "pb")
    return found.groupBy("prediction", "suspicious").agg(F.count("*").alias("n"))


LIVE = """(CASE WHEN pa = 1 AND sa > 0.2 THEN 1 ELSE 0 END) + (CASE WHEN pb = 1 AND sb > 0.2 THEN 1 ELSE 0 END)
  + (CASE WHEN pc = 1 AND sc > 0.2 AND conn_id % 7 <> 0 THEN 1 ELSE 0 END)"""


@query(f"WITH {MEMBERS} SELECT conn_id, {LIVE} AS votes, CASE WHEN {LIVE} >= 2 THEN 1 ELSE 0 END AS alert FROM ens")
def live_vote(spark, sf_dir):
    rows = members(spark, sf_dir).withColumn("sc", F.when(F.col("conn_id") % 7 != 0, F.col("sc")))
    models = {"AE": ("pa", "sa"), "OCSVM": ("pb", "sb"), "IF": ("pc", "sc")}
    return en.live_vote(rows, models, min_score=0.2).select("conn_id", "votes", "alert")


@query(
    f"""WITH {MEMBERS}, lev AS (SELECT * FROM (VALUES ('high', 1.5, 0.8), ('mid', 2.0, 1.0), ('low', 3.0, 1.5)) t(level, factor, min_score))
    SELECT level, CAST(sum(CASE WHEN sa * 2 > 0.1 * factor AND sa * 2 > min_score THEN 1 ELSE 0 END) AS BIGINT) AS alarms
    FROM ens, lev GROUP BY level"""
)
def sensitivity_presets(spark, sf_dir):
    rows = members(spark, sf_dir)
    score = F.col("sa") * 2
    counts = []
    for level in en.SENSITIVITY:
        threshold, floor = en.sensitivity_threshold(0.1, level)
        hits = F.count_if((score > threshold) & (score > floor))
        counts.append(F.struct(F.lit(level).alias("level"), hits.alias("alarms")))
    return rows.agg(F.array(*counts).alias("a")).select(F.inline("a"))


@query(
    f"""WITH {MEMBERS}, m AS (SELECT *, {MEAN} AS s FROM ens),
      p AS (SELECT 'voting' AS model, y, CASE WHEN {VOTE} >= 0.5 THEN 1 ELSE 0 END AS prediction FROM m
        UNION ALL SELECT 'weighted', y, CASE WHEN (pa * 2.0 + pb + pc) / 4.0 >= 0.5 THEN 1 ELSE 0 END FROM m
        UNION ALL SELECT 'averaging', y, CASE WHEN s > (SELECT quantile_cont(s, 0.95) FROM m) THEN 1 ELSE 0 END FROM m
        UNION ALL SELECT 'stacking', y, CASE WHEN s > (SELECT quantile_cont(s, 0.5) FROM m) THEN 1 ELSE 0 END FROM m),
      c AS (SELECT model, {CELLS} FROM p GROUP BY model)
    SELECT model, tp, fp, fn, tn, round({F1}, 6) AS f1 FROM c"""
)
def ensemble_compare(spark, sf_dir):
    made = en.Ensemble().add("a", "pa", "sa", 2.0).add("b", "pb", "sb").add("c", "pc", "sc")
    found = made.compare(members(spark, sf_dir))
    return rounded(found, ["f1"], ["model", "tp", "fp", "fn", "tn"])


@query()
def stacking_meta(spark, sf_dir):
    """Rows that the meta-model has not seen; its members are formulas, which are fitted to nothing."""
    parts = sc.stratified_split(members(spark, sf_dir), "y", "conn_id")
    scorer = en.fit_stack(parts.filter("split = 'train'"), ["sa", "sb", "sc"])
    return _scored(scorer(parts.filter("split = 'test'")))


# ---- scaling and splits -------------------------------------------------------------------

SCALED = ["duration", "orig_bytes", "orig_pkts"]


@query(
    f"""WITH {CONN} SELECT conn_id, """
    + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in SCALED)
    + " FROM conn"
)
def scale_standard(spark, sf_dir):
    rows = conn(spark, sf_dir).select("conn_id", *SCALED)
    return rounded(sc.scale(rows, sc.fit_scaler(rows, SCALED)), SCALED, ["conn_id"])


@query(
    f"WITH {CONN} SELECT conn_id, "
    + ", ".join(f"round({c} / stddev_pop({c}) OVER (), 6) AS {c}" for c in SCALED)
    + " FROM conn"
)
def scale_nomean(spark, sf_dir):
    rows = conn(spark, sf_dir).select("conn_id", *SCALED)
    return rounded(sc.scale(rows, sc.fit_scaler(rows, SCALED, with_mean=False)), SCALED, ["conn_id"])


@query(
    """WITH c AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
      s AS (SELECT vec_id, pos, (x - avg(x) OVER (PARTITION BY pos)) / stddev_pop(x) OVER (PARTITION BY pos) AS z FROM c)
    SELECT vec_id, round(max(CASE WHEN pos = 1 THEN z END), 5) AS z_first, round(sum(z), 5) AS z_sum,
      round(sum(z * z), 5) AS z_square FROM s GROUP BY vec_id"""
)
def scale_embeddings(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding")
    )
    done = sc.scale_vector(rows, "embedding", sc.fit_vector_scaler(rows, "embedding"))
    fold = lambda f: F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + f(x))
    return done.select(
        "vec_id",
        F.round(F.col("embedding")[0], 5).alias("z_first"),
        F.round(fold(lambda x: x), 5).alias("z_sum"),
        F.round(fold(lambda x: x * x), 5).alias("z_square"),
    )


POSITIONS = f"""{CONN}, o AS (SELECT conn_id, label, row_number() OVER (PARTITION BY label ORDER BY conn_id) - 1 AS pos,
  count(*) OVER (PARTITION BY label) AS n FROM conn)"""


@query(
    f"WITH {POSITIONS} SELECT conn_id, label, CASE WHEN pos < floor(n * 0.8 + 0.5) THEN 'train' ELSE 'test' END AS split FROM o"
)
def stratified_split(spark, sf_dir):
    rows = conn(spark, sf_dir).select("conn_id", "label")
    return sc.stratified_split(rows, "label", "conn_id", seed=None).select("conn_id", "label", "split")


@query(f"WITH {POSITIONS} SELECT conn_id, label, CAST(pos % 5 AS INTEGER) AS fold FROM o")
def kfold(spark, sf_dir):
    rows = conn(spark, sf_dir).select("conn_id", "label")
    return sc.stratified_folds(rows, "label", "conn_id", seed=None).select("conn_id", "label", "fold")


@query()
def stratified_split_hashed(spark, sf_dir):
    rows = conn(spark, sf_dir).select("conn_id", "label")
    return sc.stratified_split(rows, "label", "conn_id").select("conn_id", "label", "split")
