"""Queries on metrics, score curves and thresholds."""

import numpy as np
from pyspark.sql import functions as F

from flowmarrow.functions.columns import f1_band, score_band, verdict, at_threshold, name_matches
from flowmarrow.operators import metrics as mt
from flowmarrow.operators import thresholds as th
from flowmarrow.operators.ordered import percentile_value, percentiles, prefix_sums
from flowmarrow.plans.registry import query
from flowmarrow.plans.tables import CONN, conn, r6, table
from flowmarrow.session import frozen

# ---- inputs -------------------------------------------------------------------------------

LINES = """sc AS (SELECT round(l_discount + l_tax, 4) AS score,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)"""


def scored_lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.round(F.col("l_discount") + F.col("l_tax"), 4).alias("score"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


DOCS = "d AS (SELECT toxic AS y, 1 - quality AS prediction FROM labels)"


def judged_docs(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(
        F.col("toxic").alias("y"), (1 - F.col("quality")).alias("prediction")
    )


SCORED = f"""{CONN}, sconn AS (SELECT *, round(orig_bytes / 49002.0, 6) AS score,
    CASE WHEN orig_bytes > 6000 THEN 1 ELSE 0 END AS prediction,
    CASE WHEN orig_pkts > 50 THEN 1 ELSE 0 END AS prediction2,
    CASE WHEN label = 'anomaly' THEN 1 ELSE 0 END AS y FROM conn)"""


def scored_conn(spark, sf_dir):
    return conn(spark, sf_dir).withColumns(
        {
            "score": r6(F.col("orig_bytes") / 49002.0),
            "prediction": (F.col("orig_bytes") > 6000).cast("int"),
            "prediction2": (F.col("orig_pkts") > 50).cast("int"),
            "y": (F.col("label") == "anomaly").cast("int"),
        }
    )


# ---- SQL pieces ---------------------------------------------------------------------------

CELLS = """CAST(sum(CASE WHEN y = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN y = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN y = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN y = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp"""


def div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


PRECISION, RECALL = div("tp", "tp + fp"), div("tp", "tp + fn")
F1 = div("2 * tp", "2 * tp + fp + fn")
RATES = {
    "accuracy": div("tp + tn", "tp + tn + fp + fn"),
    "precision": PRECISION,
    "recall": RECALL,
    "f1": F1,
    "false_positive_rate": "CASE WHEN fp + tn > 0 THEN CAST(fp AS DOUBLE) / (fp + tn) END",
}
RATES_SQL = ", ".join(f"round({e}, 6) AS {n}" for n, e in RATES.items())

CURVE = f"""{LINES}, g AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY score),
  curve AS (SELECT score AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, pos, neg,
    sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW w AS (ORDER BY score DESC)),
  roc AS (SELECT threshold, CAST(fp AS DOUBLE) / n AS fpr, CAST(tp AS DOUBLE) / p AS tpr FROM curve),
  pr AS (SELECT threshold, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / p AS recall FROM curve)"""


def grid_sql(shares) -> str:
    listed = ", ".join(repr(float(s)) for s in shares)
    return f"thr AS (SELECT DISTINCT unnest(quantile_cont(score, [{listed}])) AS threshold FROM sc)"


def rates_at(op: str) -> str:
    return f"""rates AS (SELECT threshold,
      CAST(sum(CASE WHEN score {op} threshold THEN pos ELSE 0 END) AS BIGINT) AS tp,
      CAST(sum(CASE WHEN score {op} threshold THEN neg ELSE 0 END) AS BIGINT) AS fp,
      CAST(sum(CASE WHEN score {op} threshold THEN 0 ELSE pos END) AS BIGINT) AS fn,
      CAST(sum(CASE WHEN score {op} threshold THEN 0 ELSE neg END) AS BIGINT) AS tn
    FROM thr, g GROUP BY threshold)"""


GRID_1000 = f"{CURVE}, {grid_sql(np.linspace(0, 1, 1000))}, {rates_at('>')}"


def rounded(df, columns, keep=()):
    return df.select(*keep, *[r6(c).alias(c) for c in columns])


# ---- counts and metrics -------------------------------------------------------------------


@query(
    f"""WITH {SCORED} SELECT count(*) AS total, CAST(sum(prediction) AS BIGINT) AS anomalies,
      round(avg(prediction), 6) AS anomaly_ratio, min(score) AS score_min, max(score) AS score_max,
      round(avg(score), 6) AS score_mean FROM sconn"""
)
def score_summary(spark, sf_dir):
    s = mt.score_summary(scored_conn(spark, sf_dir))
    return rounded(s, ["anomaly_ratio", "score_min", "score_max", "score_mean"], ["total", "anomalies"])


@query(
    f"""WITH {SCORED} SELECT CASE WHEN score < 0.3 THEN 'normal' WHEN score < 0.7 THEN 'suspicious'
      ELSE 'anomalous' END AS band, CASE WHEN prediction = 1 THEN 'ANOMALY' ELSE 'NORMAL' END AS verdict,
      count(*) AS n FROM sconn GROUP BY ALL"""
)
def score_bands(spark, sf_dir):
    rows = scored_conn(spark, sf_dir)
    banded = rows.select(score_band("score").alias("band"), verdict("prediction").alias("verdict"))
    return banded.groupBy("band", "verdict").agg(F.count("*").alias("n"))


@query(
    f"WITH {SCORED} SELECT conn_id, score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM sconn"
)
def user_threshold(spark, sf_dir):
    rows = scored_conn(spark, sf_dir).select("conn_id", "score")
    return rows.withColumn("prediction", at_threshold("score", 0.5))


@query(
    f"""WITH {SCORED}, c AS (SELECT CAST(sum(y) AS BIGINT) AS anomalies, CAST(sum(1 - y) AS BIGINT) AS normals FROM sconn)
    SELECT anomalies, normals, round(CAST(anomalies AS DOUBLE) / normals, 6) AS ratio,
      anomalies > 10 * normals AS imbalanced FROM c"""
)
def imbalance_flag(spark, sf_dir):
    found = mt.imbalance(conn(spark, sf_dir))
    return found.select("anomalies", "normals", r6("ratio").alias("ratio"), "imbalanced")


@query(f"WITH {DOCS}, m AS (SELECT {CELLS} FROM d) SELECT tn, fp, fn, tp, {RATES_SQL} FROM m")
def confusion_metrics(spark, sf_dir):
    return rounded(mt.binary_metrics(judged_docs(spark, sf_dir)), RATES, ["tn", "fp", "fn", "tp"])


@query(
    f"""WITH {SCORED}, m AS (SELECT orig_h, {CELLS} FROM sconn GROUP BY orig_h)
    SELECT orig_h, fp, tn, round({RATES['false_positive_rate']}, 6) AS false_positive_rate FROM m"""
)
def fpr(spark, sf_dir):
    found = mt.binary_metrics(scored_conn(spark, sf_dir), by=["orig_h"])
    return rounded(found, ["false_positive_rate"], ["orig_h", "fp", "tn"])


MULTI = f"""{CONN}, g AS (SELECT attack_type AS y,
  CASE conn_id % 3 WHEN 0 THEN attack_type WHEN 1 THEN 'normal' ELSE 'syn_flood' END AS p FROM conn)"""
KINDS = ["dns_amplification", "http_flood", "normal", "syn_flood", "udp_flood"]


def guessed(spark, sf_dir):
    kind = F.col("conn_id") % 3
    guess = F.when(kind == 0, F.col("attack_type")).when(kind == 1, "normal").otherwise("syn_flood")
    return conn(spark, sf_dir).select(F.col("attack_type").alias("y"), guess.alias("p"))


@query(
    f"""WITH {MULTI}, c AS (SELECT unnest({KINDS}) AS class),
      r AS (SELECT class, CAST((SELECT count(*) FROM g WHERE y = class) AS DOUBLE) AS support,
        CAST((SELECT count(*) FROM g WHERE p = class) AS DOUBLE) AS said,
        CAST((SELECT count(*) FROM g WHERE p = class AND y = class) AS DOUBLE) AS hit FROM c),
      s AS (SELECT class, CASE WHEN said = 0 THEN 0 ELSE hit / said END AS precision,
        CASE WHEN support = 0 THEN 0 ELSE hit / support END AS recall,
        2 * hit / (said + support) AS f1, support FROM r)
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
      CAST(support AS BIGINT) AS support FROM s
    UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
      CAST(sum(support) AS BIGINT) FROM s
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
      round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
      CAST(sum(support) AS BIGINT) FROM s"""
)
def class_report(spark, sf_dir):
    found = mt.class_report(guessed(spark, sf_dir), "y", "p")
    return rounded(found, ["precision", "recall", "f1"], ["class", "support"])


@query(
    f"""WITH {MULTI} SELECT y, {', '.join(f"CAST(sum(CASE WHEN p = '{k}' THEN 1 ELSE 0 END) AS BIGINT) AS {k}" for k in KINDS)}
    FROM g GROUP BY y"""
)
def multiclass_cm(spark, sf_dir):
    return mt.multiclass_confusion(guessed(spark, sf_dir), "y", "p", KINDS)


@query(f"WITH {MULTI} SELECT round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM g")
def multiclass_accuracy(spark, sf_dir):
    return rounded(mt.accuracy(guessed(spark, sf_dir), "y", "p"), ["accuracy"])


def _model_sql(pred: str, name: str) -> str:
    tp = f"sum(CASE WHEN y = 1 AND {pred} = 1 THEN 1 ELSE 0 END)"
    fp = f"sum(CASE WHEN y = 0 AND {pred} = 1 THEN 1 ELSE 0 END)"
    fn = f"sum(CASE WHEN y = 1 AND {pred} = 0 THEN 1 ELSE 0 END)"
    parts = {"f1": (f"2 * {tp}", f"2 * {tp} + {fp} + {fn}"), "precision": (tp, f"{tp} + {fp}"), "recall": (tp, f"{tp} + {fn}")}
    return ", ".join(f"round({div(a, b)}, 6) AS {name}_{k}" for k, (a, b) in parts.items())


@query(
    f"""WITH {SCORED} SELECT attack_type, count(*) AS count, {_model_sql('prediction', 'std')},
      {_model_sql('prediction2', 'seq')} FROM sconn GROUP BY attack_type"""
)
def per_attack_metrics(spark, sf_dir):
    rows = scored_conn(spark, sf_dir)
    found = mt.per_attack_metrics(rows, {"std": "prediction", "seq": "prediction2"})
    names = [f"{m}_{k}" for m in ("std", "seq") for k in ("f1", "precision", "recall")]
    return rounded(found, names, ["attack_type", "count"])


@query(
    f"""WITH {SCORED}, f AS (SELECT CAST(conn_id % 5 AS INTEGER) AS fold, {CELLS} FROM sconn GROUP BY 1),
      m AS (SELECT {F1} AS f1, {RECALL} AS recall FROM f),
      l AS (SELECT 'f1' AS metric, f1 AS v FROM m UNION ALL SELECT 'recall', recall FROM m)
    SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min,
      round(max(v), 6) AS max, round(1.96 * stddev_pop(v) / sqrt(count(v)), 6) AS ci95 FROM l GROUP BY metric"""
)
def cv_summary(spark, sf_dir):
    rows = scored_conn(spark, sf_dir).withColumn("fold", (F.col("conn_id") % 5).cast("int"))
    found = mt.cv_summary(mt.binary_metrics(rows, by=["fold"]), ["f1", "recall"])
    return rounded(found, ["mean", "std", "min", "max", "ci95"], ["metric"])


MODELS = f"""{SCORED}, two AS (
    SELECT 'size' AS model, {CELLS} FROM sconn
    UNION ALL SELECT 'packets', {CELLS} FROM (SELECT * REPLACE (prediction2 AS prediction) FROM sconn)),
  rated AS (SELECT model, {F1} AS f1 FROM two)"""


def _two_models(spark, sf_dir):
    rows = scored_conn(spark, sf_dir)
    size = mt.binary_metrics(rows).withColumn("model", F.lit("size"))
    pkts = mt.binary_metrics(rows, pred="prediction2").withColumn("model", F.lit("packets"))
    return size.unionByName(pkts).select("model", "f1")


BAND_SQL = "CASE WHEN f1 > 0.95 THEN 'excellent' WHEN f1 > 0.85 THEN 'good' ELSE 'needs_improvement' END"


@query(f"WITH {MODELS} SELECT model, round(f1, 6) AS f1, {BAND_SQL} AS band FROM rated ORDER BY rated.f1 DESC, model")
def model_leaderboard(spark, sf_dir):
    board = mt.leaderboard(_two_models(spark, sf_dir))
    return board.select("model", r6("f1").alias("f1"), f1_band("f1").alias("band"))


@query(f"WITH {MODELS} SELECT model, round(f1, 6) AS f1 FROM rated ORDER BY rated.f1 DESC, model LIMIT 1")
def best_model(spark, sf_dir):
    return rounded(mt.best_model(_two_models(spark, sf_dir)), ["f1"], ["model"])


@query(f"WITH {MODELS} SELECT model, contains(lower(model), 'pack') AS matches, NOT contains(lower(model), 'pack') AS others FROM rated")
def model_name_filter(spark, sf_dir):
    hit, others = name_matches("model", "PACK"), name_matches("model", "PACK", negate=True)
    return _two_models(spark, sf_dir).select("model", hit.alias("matches"), others.alias("others"))


@query(f"WITH {SCORED} SELECT conn_id, score FROM sconn ORDER BY score DESC, conn_id LIMIT 50")
def top50_anomalies(spark, sf_dir):
    return mt.top_scores(scored_conn(spark, sf_dir).select("conn_id", "score"))


@query(
    f"""WITH {SCORED} SELECT count(*) AS total, CAST(sum(CASE WHEN conn_id % 5 < 4 THEN 1 ELSE 0 END) AS BIGINT) AS train,
      CAST(sum(CASE WHEN conn_id % 5 = 4 THEN 1 ELSE 0 END) AS BIGINT) AS test,
      CAST(sum(1 - y) AS BIGINT) AS normal, CAST(sum(y) AS BIGINT) AS anomaly, 12 AS features FROM sconn"""
)
def dataset_info(spark, sf_dir):
    split = F.when(F.col("conn_id") % 5 < 4, "train").otherwise("test")
    return mt.dataset_info(conn(spark, sf_dir).withColumn("split", split), 12)


# ---- percentiles and histograms -----------------------------------------------------------

SHARES = [0.0, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]


@query(
    f"""WITH {CONN} SELECT unnest(CAST({SHARES} AS DOUBLE[])) AS share,
      round(unnest(quantile_cont(duration, {SHARES})), 6) AS value FROM conn"""
)
def score_percentiles(spark, sf_dir):
    found = percentiles(conn(spark, sf_dir).select("duration"), "duration", SHARES)
    return found.select("share", r6("value").alias("value"))


@query(
    f"""WITH {CONN} SELECT round(quantile_cont(duration, 0.5), 6) AS median,
      round(stddev_pop(duration), 6) AS std,
      round(quantile_cont(duration, 0.5) + 3.0 * stddev_pop(duration), 6) AS threshold
    FROM conn WHERE label = 'normal'"""
)
def median_3std(spark, sf_dir):
    normal = conn(spark, sf_dir).filter("label = 'normal'").select("duration")
    return rounded(mt.median_threshold(normal, "duration"), ["median", "std", "threshold"])


@query(
    f"""WITH {CONN} SELECT round(avg(duration), 6) AS mean, round(stddev_pop(duration), 6) AS std,
      round(quantile_cont(duration, 0.5), 6) AS median, count(duration) AS count FROM conn"""
)
def baseline_stats(spark, sf_dir):
    found = mt.baseline_stats(conn(spark, sf_dir).select("duration"), "duration")
    return rounded(found, ["mean", "std", "median"], ["count"])


@query(
    f"""WITH {SCORED}, b AS (SELECT min(score) AS lo, (max(score) - min(score)) / 50 AS w FROM sconn)
    SELECT label, CAST(least(floor((score - lo) / w), 49) AS INTEGER) AS bin, count(*) AS n,
      round(min(lo) + CAST(least(floor((score - lo) / w), 49) AS INTEGER) * min(w), 6) AS left_edge
    FROM sconn, b GROUP BY label, CAST(least(floor((score - lo) / w), 49) AS INTEGER)"""
)
def score_histogram(spark, sf_dir):
    found = mt.histogram(scored_conn(spark, sf_dir).select("label", "score"), "score", "label")
    return found.select("label", "bin", "n", r6("left_edge").alias("left_edge"))


@query(
    f"""WITH {SCORED} SELECT CASE WHEN score < 0.1 THEN 0 WHEN score < 0.25 THEN 1 ELSE 2 END AS bin, count(*) AS n
    FROM sconn WHERE score BETWEEN 0.01 AND 0.9 GROUP BY 1"""
)
def histogram_on_edges(spark, sf_dir):
    rows = scored_conn(spark, sf_dir).select("score")
    return mt.histogram_on_edges(rows, "score", [0.01, 0.1, 0.25, 0.9])


# ---- curves -------------------------------------------------------------------------------


@query(f"WITH {CURVE} SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc")
def roc_curve(spark, sf_dir):
    return rounded(mt.roc_curve(scored_lines(spark, sf_dir)), ["fpr", "tpr"], ["threshold"])


@query(
    f"""WITH {CURVE} SELECT round(CAST(sum(neg * (2 * tp - pos)) AS DOUBLE) / 2 / max(p) / max(n), 6) AS roc_auc FROM curve"""
)
def roc_auc(spark, sf_dir):
    return rounded(mt.roc_auc(scored_lines(spark, sf_dir)), ["roc_auc"])


@query(
    f"""WITH {CURVE} SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr
    UNION ALL SELECT NULL, 1.0, 0.0"""
)
def pr_curve(spark, sf_dir):
    return rounded(mt.pr_curve(scored_lines(spark, sf_dir)), ["precision", "recall"], ["threshold"])


@query(
    f"""WITH {CURVE}, seq AS (SELECT threshold, precision, recall FROM pr UNION ALL SELECT 1e9, 1.0, 0.0),
      steps AS (SELECT recall, precision, lead(recall) OVER (ORDER BY threshold) AS r2,
        lead(precision) OVER (ORDER BY threshold) AS p2 FROM seq)
    SELECT round(sum((recall - r2) * (precision + p2) / 2), 6) AS pr_auc FROM steps"""
)
def pr_auc(spark, sf_dir):
    return rounded(mt.pr_auc(scored_lines(spark, sf_dir)), ["pr_auc"])


@query(
    f"""WITH {CURVE}, m AS (SELECT {CELLS} FROM (SELECT y, CASE WHEN score >= 0.08 THEN 1 ELSE 0 END AS prediction FROM sc))
    SELECT tn, fp, fn, tp, {RATES_SQL}, CAST(0.08 AS DOUBLE) AS threshold,
      (SELECT round(CAST(sum(neg * (2 * tp - pos)) AS DOUBLE) / 2 / max(p) / max(n), 6) FROM curve) AS roc_auc FROM m"""
)
def evaluate_threshold(spark, sf_dir):
    found = mt.evaluate(scored_lines(spark, sf_dir), 0.08)
    return rounded(found, [*RATES, "threshold", "roc_auc"], ["tn", "fp", "fn", "tp"])


# ---- thresholds ---------------------------------------------------------------------------


@query(
    f"""WITH {CURVE}, names AS (SELECT unnest(CAST({[float(p) for p in th.WIDE_GRID]} AS DOUBLE[])) AS percentile,
        unnest(quantile_cont(score, {[p / 100 for p in th.WIDE_GRID]})) AS threshold FROM sc),
      thr AS (SELECT DISTINCT threshold FROM names), {rates_at('>=')}
    SELECT percentile, round(threshold, 6) AS threshold, tp, fp, fn, tn, {RATES_SQL}
    FROM names JOIN rates USING (threshold)"""
)
def thr_percentile_sweep(spark, sf_dir):
    found = th.percentile_sweep(scored_lines(spark, sf_dir))
    return rounded(found, ["threshold", *RATES], ["percentile", "tp", "fp", "fn", "tn"])


@query(
    f"""WITH {CURVE}, names AS (SELECT unnest(quantile_cont(score, {[p / 100 for p in th.WIDE_GRID]})) AS threshold FROM sc),
      thr AS (SELECT DISTINCT threshold FROM names), {rates_at('>=')}
    SELECT round(threshold, 6) AS threshold, round({F1}, 6) AS f1 FROM rates ORDER BY {F1} DESC, rates.threshold LIMIT 1"""
)
def thr_percentile_best(spark, sf_dir):
    best = th.best_f1(th.percentile_sweep(scored_lines(spark, sf_dir)))
    return rounded(best, ["threshold", "f1"])


STEPS = [0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.14]


@query(
    f"""WITH {CURVE}, thr AS (SELECT unnest(CAST({STEPS} AS DOUBLE[])) AS threshold), {rates_at('>=')}
    SELECT threshold, tp, fp, fn, tn, round({F1}, 6) AS f1 FROM rates"""
)
def thr_step_sweep(spark, sf_dir):
    found = th.step_sweep(scored_lines(spark, sf_dir), STEPS)
    return rounded(found, ["f1"], ["threshold", "tp", "fp", "fn", "tn"])


def _curve(spark, sf_dir):
    return mt.score_curve(scored_lines(spark, sf_dir))


def _grid_rates(spark, sf_dir):
    return th.grid_rates(mt.score_table(scored_lines(spark, sf_dir)))


YOUDEN = """SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr,
  round(tpr - fpr, 6) AS j_score FROM roc ORDER BY roc.tpr - roc.fpr DESC, roc.threshold DESC LIMIT 1"""


@query(f"WITH {CURVE} {YOUDEN}")
def thr_youden(spark, sf_dir):
    return rounded(th.youden(_curve(spark, sf_dir)), ["threshold", "fpr", "tpr", "j_score"])


def fbeta_sql(beta: float) -> str:
    b2 = beta * beta
    value = div(f"({1 + b2}) * ({PRECISION}) * ({RECALL})", f"{b2} * ({PRECISION}) + ({RECALL})")
    return f"""SELECT round(threshold, 6) AS threshold, round({value}, 6) AS f_beta, round({PRECISION}, 6) AS precision,
      round({RECALL}, 6) AS recall FROM rates WHERE tp > 0 ORDER BY {value} DESC, rates.threshold LIMIT 1"""


@query(f"WITH {GRID_1000} {fbeta_sql(1.0)}")
def thr_fbeta(spark, sf_dir):
    best = th.f_beta(_grid_rates(spark, sf_dir), 1.0)
    return rounded(best, ["threshold", "f_beta", "precision", "recall"])


@query(f"WITH {GRID_1000} {fbeta_sql(2.0)}")
def thr_f2(spark, sf_dir):
    best = th.f_beta(_grid_rates(spark, sf_dir), 2.0)
    return rounded(best, ["threshold", "f_beta", "precision", "recall"])


COST = """SELECT round(threshold, 6) AS threshold, CAST(fp + 10 * fn AS DOUBLE) AS total_cost, fp AS fp_count, fn AS fn_count
  FROM rates ORDER BY fp + 10 * fn, rates.threshold LIMIT 1"""


@query(f"WITH {GRID_1000} {COST}")
def thr_cost(spark, sf_dir):
    best = th.cost_sensitive(_grid_rates(spark, sf_dir))
    return rounded(best, ["threshold", "total_cost"], ["fp_count", "fn_count"])


def target_sql(given: str, floor: float, best: str) -> str:
    return f"""SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall
      FROM pr WHERE pr.{given} >= {floor} ORDER BY pr.{best} DESC, pr.threshold LIMIT 1"""


@query(f"WITH {CURVE} {target_sql('precision', 0.34, 'recall')}")
def thr_precision(spark, sf_dir):
    best = th.precision_target(_curve(spark, sf_dir), 0.34)
    return rounded(best, ["threshold", "precision", "recall"])


@query(f"WITH {CURVE} {target_sql('recall', 0.9, 'precision')}")
def thr_recall(spark, sf_dir):
    best = th.recall_target(_curve(spark, sf_dir), 0.9)
    return rounded(best, ["threshold", "precision", "recall"])


PR_F1 = "2 * (precision * recall) / (precision + recall + 1e-10)"


@query(
    f"""WITH {CURVE}, f AS (SELECT *, {PR_F1} AS f1 FROM pr)
    SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
    FROM f ORDER BY f.f1 DESC, f.threshold LIMIT 1"""
)
def thr_pr_optimal(spark, sf_dir):
    best = th.pr_f1_optimal(_curve(spark, sf_dir))
    return rounded(best, ["threshold", "precision", "recall", "f1"])


@query(
    f"""WITH {CURVE}, f AS (SELECT *, {PR_F1} AS f1 FROM pr WHERE precision >= 0.33)
    SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
    FROM f ORDER BY f.recall DESC, f.threshold LIMIT 1"""
)
def thr_pr_precision_rule(spark, sf_dir):
    best = th.pr_precision_rule(_curve(spark, sf_dir), 0.33)
    return rounded(best, ["threshold", "precision", "recall", "f1"])


def _in_layout(method: str, inner: str, precision: str, recall: str, objective: str) -> str:
    return f"""SELECT '{method}' AS method, threshold, {precision} AS precision, {recall} AS recall,
      {objective} AS objective FROM ({inner})"""


P99 = f"""SELECT round(threshold, 6) AS threshold, round({PRECISION}, 6) AS precision, round({RECALL}, 6) AS recall,
  round({F1}, 6) AS f1 FROM (SELECT q AS threshold,
    sum(CASE WHEN score > q THEN pos ELSE 0 END) AS tp, sum(CASE WHEN score > q THEN neg ELSE 0 END) AS fp,
    sum(CASE WHEN score > q THEN 0 ELSE pos END) AS fn
  FROM g, (SELECT quantile_cont(score, 0.99) AS q FROM sc) GROUP BY q)"""


@query(
    f"WITH {GRID_1000} "
    + " UNION ALL ".join(
        [
            _in_layout("Youden", YOUDEN, "NULL", "NULL", "j_score"),
            _in_layout("F1.0-score", fbeta_sql(1.0), "precision", "recall", "f_beta"),
            _in_layout("F2.0-score", fbeta_sql(2.0), "precision", "recall", "f_beta"),
            _in_layout("Cost-sensitive", COST, "NULL", "NULL", "total_cost"),
            _in_layout("Precision-0.9", target_sql("precision", 0.9, "recall"), "precision", "recall", "recall"),
            _in_layout("Recall-0.9", target_sql("recall", 0.9, "precision"), "precision", "recall", "precision"),
            _in_layout("Percentile-99", P99, "precision", "recall", "f1"),
        ]
    )
)
def thr_compare(spark, sf_dir):
    found = th.compare_methods(scored_lines(spark, sf_dir))
    return rounded(found, ["threshold", "precision", "recall", "objective"], ["method"])


@query(
    f"""WITH {CURVE}, {grid_sql(np.linspace(0.8, 0.999, 100))}, {rates_at('>')}
    SELECT round(threshold, 6) AS threshold, round({F1}, 6) AS f1 FROM rates"""
)
def f1_curve(spark, sf_dir):
    return rounded(th.f1_curve(scored_lines(spark, sf_dir)), ["threshold", "f1"])


@query(
    f"""WITH {CONN}, v AS (SELECT orig_bytes AS v, proto, count(*) AS n, CAST(sum(length) AS BIGINT) AS length FROM conn GROUP BY ALL)
    SELECT proto, CAST(v AS DOUBLE) AS value, n, CAST(sum(n) OVER w AS BIGINT) AS cum_n, CAST(sum(length) OVER w AS BIGINT) AS cum_length,
      CAST(sum(n) OVER (PARTITION BY proto) AS BIGINT) AS all_n FROM v WINDOW w AS (PARTITION BY proto ORDER BY v)"""
)
def running_totals(spark, sf_dir):
    """Running sums per protocol over all sizes, in ranges of 200 values and blocks of four ranges."""
    sizes = conn(spark, sf_dir).groupBy("proto", F.col("orig_bytes").cast("double").alias("value"))
    table = frozen(sizes.agg(F.count("*").alias("n"), F.sum("length").alias("length")), "sizes")
    sums = prefix_sums(table, "value", ["n", "length"], by=["proto"], range_rows=200, block=4)
    return sums.select("proto", "value", "n", "cum_n", "cum_length", "all_n")


@query(
    f"""WITH {CONN}, s AS (SELECT unnest([0.5, 0.95, 0.999]) AS share)
    SELECT CAST(share AS DOUBLE) AS share, round(CASE share WHEN 0.5 THEN (SELECT quantile_cont(duration, 0.5) FROM conn)
      WHEN 0.95 THEN (SELECT quantile_cont(duration, 0.95) FROM conn) ELSE (SELECT quantile_cont(duration, 0.999) FROM conn) END, 6) AS value FROM s"""
)
def narrowed_percentiles(spark, sf_dir):
    """Exact percentiles from brackets of a sketch, narrowed until a hundred values are left."""
    rows = conn(spark, sf_dir).select("duration")
    found = [(s, percentile_value(rows, "duration", s, rows=100)) for s in (0.5, 0.95, 0.999)]
    return spark.createDataFrame(found, "share double, value double").select("share", r6("value").alias("value"))
