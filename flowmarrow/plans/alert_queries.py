"""Queries on explanations and alerts. A connection is explained against the mean of its host."""

from pyspark.sql import functions as F

from flowmarrow.operators import explain as ex
from flowmarrow.operators import labeling as lb
from flowmarrow.operators.metrics import trailing_count
from flowmarrow.operators.ordered import with_group_stats
from flowmarrow.plans.registry import query
from flowmarrow.plans.tables import CONN, conn, r6

NAMES = ["duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "bytes_ratio"]
THRESHOLD = 200.0


def explained_input(spark, sf_dir):
    """Rows with ``original`` and ``expected`` arrays; all but normal traffic below 60 bytes counts."""
    ratio = F.when(F.col("resp_bytes") > 0, F.col("orig_bytes") / F.col("resp_bytes")).otherwise(0.0)
    rows = conn(spark, sf_dir).withColumn("bytes_ratio", ratio)
    means = rows.groupBy("orig_h").agg(
        F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(f"m_{c}") for c in NAMES]
    )
    joined = with_group_stats(rows, means, ["orig_h"], "n", ["conn_id"])
    return joined.select(
        "conn_id", "ts", "orig_h", "orig_p", "resp_h", "resp_p", "proto", "label",
        F.array(*[F.col(c).cast("double") for c in NAMES]).alias("original"),
        F.array(*[F.col(f"m_{c}") for c in NAMES]).alias("expected"),
    )


def explained(spark, sf_dir):
    return explanations(explained_input(spark, sf_dir))


def explanations(rows, **options):
    return ex.explain(rows, NAMES, THRESHOLD, info=["orig_h", "resp_h"], **options)


def _list(names, prefix=""):
    return ", ".join(f"'{n}'" if not prefix else f"CAST({prefix}{n} AS DOUBLE)" for n in names)


def _values(rows):
    return ", ".join(rows)


def _quoted(s):
    return "'" + s.replace("'", "''") + "'"


ACTION_ROWS = _values(
    f"({_quoted(f)}, {i + 1}, {_quoted(a)})" for f, (_, acts, _) in ex.ACTIONS.items() for i, a in enumerate(acts)
)
THREAT_ROWS = _values(
    f"({_quoted(f)}, {i + 1}, {_quoted(t)})" for f, (_, _, inds) in ex.ACTIONS.items() for i, t in enumerate(inds)
)

EXPLAINED = f"""{CONN},
  r AS (SELECT *, CASE WHEN resp_bytes > 0 THEN orig_bytes / CAST(resp_bytes AS DOUBLE) ELSE 0.0 END AS bytes_ratio FROM conn),
  o AS (SELECT conn_id, ts, orig_h, resp_h, label,
      [{', '.join(f'CAST({c} AS DOUBLE)' for c in NAMES)}] AS original,
      [{', '.join(f'round(avg({c}) OVER (PARTITION BY orig_h), 4)' for c in NAMES)}] AS expected FROM r),
  e AS (SELECT *, unnest(range(1, {len(NAMES) + 1})) AS i, unnest([{_list(NAMES)}]) AS name FROM o),
  f AS (SELECT conn_id, ts, label, i, name, original[i] AS ov, expected[i] AS ev, abs(original[i] - expected[i]) AS err FROM e),
  m AS (SELECT conn_id, any_value(ts) AS ts, any_value(label) AS label, list(err ORDER BY i) AS errs FROM f GROUP BY conn_id),
  sc AS (SELECT conn_id, ts, label, errs, (errs[1] + errs[2] + errs[3] + errs[4] + errs[5] + errs[6]) / 6 AS score FROM m),
  sv AS (SELECT *, score / {THRESHOLD} AS ratio, CASE WHEN score / {THRESHOLD} >= 5 THEN 'CRITICAL' WHEN score / {THRESHOLD} >= 3 THEN 'HIGH'
      WHEN score / {THRESHOLD} >= 1.5 THEN 'MEDIUM' WHEN score / {THRESHOLD} >= 1 THEN 'LOW' ELSE 'UNKNOWN' END AS severity FROM sc),
  pr AS (SELECT *, CAST(floor(least(ratio, 10) / 10 * 50
      + len(list_filter(errs, lambda x: x > score + list_stddev_pop(errs))) / 6.0 * 30
      + CASE severity WHEN 'LOW' THEN 5 WHEN 'MEDIUM' THEN 10 WHEN 'HIGH' THEN 15 WHEN 'CRITICAL' THEN 20 ELSE 0 END) AS INTEGER) AS priority_score FROM sv),
  top AS (SELECT f.conn_id, name, ov, ev, err, CASE WHEN score = 0 THEN 0 ELSE err / score * 100 END AS contribution,
      row_number() OVER (PARTITION BY f.conn_id ORDER BY CASE WHEN score = 0 THEN 0 ELSE err / score * 100 END DESC, i DESC) AS rk
    FROM f JOIN sc USING (conn_id) QUALIFY rk <= 3),
  act(feature, pos, action) AS (VALUES {ACTION_ROWS}),
  thr(feature, pos, threat) AS (VALUES {THREAT_ROWS})"""


@query(
    f"""WITH {EXPLAINED} SELECT conn_id, name, round(err / score * 100, 4) AS contribution_percent, round(err, 9) AS deviation
    FROM f JOIN sc USING (conn_id)"""
)
def explain_contrib(spark, sf_dir):
    rows = ex.with_errors(explained_input(spark, sf_dir), "original", "expected")
    names = F.array(*[F.lit(n) for n in NAMES])
    cells = F.arrays_zip(names.alias("name"), F.col("contributions").alias("c"), F.col("errors").alias("d"))
    return rows.select("conn_id", F.inline(cells)).select(
        "conn_id", F.col("name"), F.round("c", 4).alias("contribution_percent"), F.round("d", 9).alias("deviation")
    )


@query(f"WITH {EXPLAINED} SELECT conn_id, round(score, 9) AS anomaly_score, severity FROM sv")
def severity(spark, sf_dir):
    rows = ex.with_severity(ex.with_errors(explained_input(spark, sf_dir), "original", "expected"), THRESHOLD)
    return rows.select("conn_id", F.round("anomaly_score", 9).alias("anomaly_score"), "severity")


@query(f"WITH {EXPLAINED} SELECT conn_id, priority_score FROM pr")
def priority(spark, sf_dir):
    rows = ex.with_severity(ex.with_errors(explained_input(spark, sf_dir), "original", "expected"), THRESHOLD)
    return ex.with_priority(rows, THRESHOLD).select("conn_id", "priority_score")


@query(
    f"""WITH {EXPLAINED} SELECT conn_id, rk AS rank, name, round(contribution, 4) AS contribution_percent,
      round(ov, 9) AS original_value, ev AS expected_value, round(err, 9) AS deviation FROM top"""
)
def top3_features(spark, sf_dir):
    rows = explained(spark, sf_dir).select("conn_id", F.posexplode("anomalous_features").alias("pos", "x"))
    return rows.select(
        "conn_id",
        (F.col("pos") + 1).alias("rank"),
        "x.name",
        F.round("x.contribution_percent", 4).alias("contribution_percent"),
        F.round("x.original_value", 9).alias("original_value"),
        "x.expected_value",
        F.round("x.deviation", 9).alias("deviation"),
    )


@query(
    f"""WITH {EXPLAINED}, a AS (SELECT conn_id, action, name, rk, pos,
        row_number() OVER (PARTITION BY conn_id, action ORDER BY rk, pos) AS seen FROM top JOIN act ON feature = name),
      k AS (SELECT *, row_number() OVER (PARTITION BY conn_id ORDER BY rk, pos) AS nr FROM a WHERE seen = 1)
    SELECT conn_id, nr, action, name AS related_feature, CASE WHEN rk = 1 THEN 'HIGH' ELSE 'MEDIUM' END AS priority FROM k"""
)
def actions(spark, sf_dir):
    rows = explained(spark, sf_dir).select("conn_id", F.posexplode("recommended_actions").alias("pos", "x"))
    return rows.select("conn_id", (F.col("pos") + 1).alias("nr"), "x.*")


@query(
    f"""WITH {EXPLAINED}, t AS (SELECT DISTINCT conn_id, threat FROM top JOIN thr ON feature = name)
    SELECT conn_id, threat FROM t"""
)
def threats(spark, sf_dir):
    return explained(spark, sf_dir).select("conn_id", F.explode("potential_threats").alias("threat"))


@query(
    f"""WITH {EXPLAINED}, s AS (
      SELECT conn_id, unnest([1, 2, 3]) AS step, unnest([{', '.join(_quoted(a) for a, _ in ex.FIRST_STEPS)}]) AS action FROM sc
      UNION ALL SELECT conn_id, CAST(rk + 3 AS INTEGER), 'Investigate ' || name || ' anomaly' FROM top WHERE rk <= 2
      UNION ALL SELECT conn_id, 6, {_quoted(ex.LAST_STEP[0])} FROM sc)
    SELECT conn_id, step, action FROM s"""
)
def investigation_steps(spark, sf_dir):
    rows = explained(spark, sf_dir).select("conn_id", F.explode("investigation_steps").alias("s"))
    return rows.select("conn_id", "s.step", "s.action")


ALERTS = f"""{EXPLAINED}, en AS (SELECT *, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS recent
    FROM pr WHERE priority_score >= 30)"""


@query(f"WITH {ALERTS} SELECT DISTINCT ts, recent FROM en")
def alert_rate(spark, sf_dir):
    rows = explained(spark, sf_dir).filter("priority_score >= 30")
    found = trailing_count(rows.select("ts"), "ts")
    return found.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "recent")


@query(
    f"""WITH {ALERTS} SELECT conn_id, priority_score, recent, CAST(0 AS BIGINT) AS suppressed FROM en WHERE recent < 5
    UNION ALL (SELECT conn_id, priority_score, recent, greatest(n - 10, 0) AS suppressed FROM (SELECT *, count(*) OVER (PARTITION BY date_trunc('hour', ts)) AS n,
      row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY priority_score DESC, conn_id) AS rk FROM en WHERE recent >= 5) WHERE rk <= 10)"""
)
def alert_filter(spark, sf_dir):
    rows = explained(spark, sf_dir).select("conn_id", "ts", "priority_score")
    kept = ex.filter_alerts(rows, min_priority=30, max_per_hour=5)
    return kept.select("conn_id", "priority_score", "recent", "suppressed")


@query(
    f"""WITH {EXPLAINED}, t AS (SELECT conn_id, name, priority_score FROM pr JOIN top USING (conn_id) WHERE rk = 1)
    SELECT name AS top_feature, arg_max(conn_id, CAST(priority_score AS BIGINT) * 1000000000 - conn_id) AS conn_id,
      max(priority_score) AS priority_score, count(*) AS similar_alerts_count FROM t GROUP BY name"""
)
def alert_dedupe(spark, sf_dir):
    rows = explained(spark, sf_dir).select("conn_id", "priority_score", "anomalous_features")
    found = ex.deduplicate_alerts(rows)
    return found.select("top_feature", "conn_id", "priority_score", "similar_alerts_count")


@query(
    f"""WITH {EXPLAINED} SELECT pr.conn_id, priority_score, severity, name AS top_feature FROM pr JOIN top ON top.conn_id = pr.conn_id AND rk = 1
    WHERE label = 'anomaly' AND priority_score >= 50 ORDER BY priority_score DESC, pr.conn_id LIMIT 10"""
)
def explain_all(spark, sf_dir):
    rows = explained_input(spark, sf_dir).withColumn("prediction", (F.col("label") == "anomaly").cast("int"))
    found = ex.explain_all(rows, NAMES, THRESHOLD)
    return found.select("conn_id", "priority_score", "severity", ex.top_feature().alias("top_feature"))


@query(f"WITH {EXPLAINED} SELECT severity, count(*) AS n FROM sv GROUP BY severity")
def severity_distribution(spark, sf_dir):
    return ex.severity_distribution(explained(spark, sf_dir))


@query(f"WITH {EXPLAINED} SELECT name AS feature, count(*) AS n FROM top GROUP BY name ORDER BY n DESC, name LIMIT 5")
def top_feature_counts(spark, sf_dir):
    return ex.top_feature_counts(explained(spark, sf_dir))


@query(
    f"""WITH {EXPLAINED}, t AS (SELECT DISTINCT conn_id, threat FROM top JOIN thr ON feature = name)
    SELECT threat, count(*) AS n FROM t GROUP BY threat ORDER BY n DESC, threat LIMIT 10"""
)
def threat_counts(spark, sf_dir):
    return ex.threat_counts(explained(spark, sf_dir))


@query(
    f"""WITH {EXPLAINED} SELECT count(*) AS total_anomalies, round(avg(priority_score), 6) AS average_priority,
      CAST(sum(CASE WHEN severity = 'CRITICAL' THEN 1 ELSE 0 END) AS BIGINT) AS critical,
      (SELECT count(*) FROM top WHERE name = 'orig_bytes') AS orig_bytes_alerts FROM pr"""
)
def alert_report(spark, sf_dir):
    found = ex.alert_summary(explained(spark, sf_dir))
    entry = lambda m, k: F.coalesce(F.try_element_at(F.col(m), F.lit(k)), F.lit(0))
    return found.select(
        "total_anomalies",
        r6("average_priority").alias("average_priority"),
        entry("severity_distribution", "CRITICAL").alias("critical"),
        entry("top_anomalous_features", "orig_bytes").alias("orig_bytes_alerts"),
    )


@query(
    f"""WITH {EXPLAINED} SELECT pr.ts AS timestamp, severity, priority_score AS priority, round(score, 9) AS anomaly_score,
      name AS top_feature, coalesce(threat, 'Unknown') AS top_threat
    FROM pr JOIN top ON top.conn_id = pr.conn_id AND rk = 1 LEFT JOIN thr ON feature = name AND pos = 1"""
)
def alert_dashboard(spark, sf_dir):
    found = ex.dashboard(explained(spark, sf_dir))
    return found.withColumn("anomaly_score", F.round("anomaly_score", 9))


@query(
    f"""WITH {CONN} SELECT conn_id, 'ANOMALY | ' || orig_h || ':' || orig_p || ' -> ' || resp_h || ':' || resp_p || ' | proto=' || proto
      || ' | scores: ' || printf('AE=%.3f', duration / 7) || CASE WHEN conn_id % 2 = 0 THEN printf(', IF=%.3f', orig_pkts / 4.0) ELSE '' END AS line
    FROM conn WHERE label = 'anomaly'"""
)
def alert_lines(spark, sf_dir):
    rows = lb.only_anomalies(conn(spark, sf_dir)).withColumns(
        {
            "ae": F.col("duration") / 7,
            "iforest": F.when(F.col("conn_id") % 2 == 0, F.col("orig_pkts") / F.lit(4.0)),
        }
    )
    return rows.select("conn_id", ex.alert_line({"AE": "ae", "IF": "iforest"}).alias("line"))
