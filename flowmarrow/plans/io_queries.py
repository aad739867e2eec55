"""Sources and sinks: tables are written to the shared folder and read back."""

from pyspark.sql import functions as F

from flowmarrow.operators import metrics as mt
from flowmarrow.plans import alert_queries, label_queries, metric_queries
from flowmarrow.plans.metric_queries import CELLS, F1, PRECISION, SCORED, scored_conn
from flowmarrow.plans.registry import SQL_CHECKS, query
from flowmarrow.plans.tables import CONN, conn, r6, table
from flowmarrow.schemas import CONN_COLUMNS, CONN_COLUMNS_IP_PROTO, CONN_COLUMNS_MINIMAL
from flowmarrow.session import frozen, scratch_path
from flowmarrow.sources import readers, writers
from flowmarrow.streaming import live

LOG_SQL = """SELECT conn_id, ts, orig_h, CAST(orig_p AS INTEGER) AS orig_p, resp_h, CAST(resp_p AS INTEGER) AS resp_p, proto,
  CASE WHEN conn_id % 11 = 0 THEN NULL ELSE duration END AS duration, orig_bytes, resp_bytes, orig_pkts, resp_pkts,
  conn_id % 2 = 0 AS local_orig, length(orig_h) AS tunnel_chars"""


def _log_rows(spark, sf_dir):
    """Connections with the id as ``uid`` and some unset cells."""
    rows = conn(spark, sf_dir)
    return rows.select(
        "*",
        F.col("conn_id").cast("string").alias("uid"),
        (F.col("conn_id") % 2 == 0).alias("local_orig"),
        F.array("orig_h", "resp_h").alias("tunnel_parents"),
    ).withColumns(
        {
            "duration": F.when(F.col("conn_id") % 11 != 0, F.col("duration")),
            "local_resp": F.lit(None).cast("boolean"),
            "missed_bytes": F.lit(0),
            "service": F.lit(None).cast("string"),
            "conn_state": F.lit("SF"),
            "history": F.lit("ShADad"),
            "orig_ip_bytes": F.col("orig_bytes"),
            "resp_ip_bytes": F.col("resp_bytes"),
            "ip_proto": F.lit(6),
        }
    )


@query(f"WITH {CONN} {LOG_SQL} FROM conn")
def conn_log_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "conn-log")
    writers.write_conn_log(_log_rows(spark, sf_dir), path, CONN_COLUMNS)
    back = readers.read_conn_log(spark, path)
    return back.select(
        F.col("uid").cast("long").alias("conn_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        "orig_h", "orig_p", "resp_h", "resp_p", "proto", "duration",
        "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "local_orig",
        F.length(F.col("tunnel_parents")[0]).alias("tunnel_chars"),
    )


@query(
    f"""WITH {CONN} SELECT round(epoch_us(ts) / 1e6, 6) AS seconds, orig_h, CAST(orig_p AS INTEGER) AS orig_p, proto, orig_bytes, 'SF' AS conn_state FROM conn"""
)
def conn_log_by_header(spark, sf_dir):
    """The short log layout, whose columns come from its own header line."""
    path = scratch_path(spark, "short-log")
    writers.write_conn_log(_log_rows(spark, sf_dir), path, CONN_COLUMNS_MINIMAL)
    back = readers.read_conn_log_with_header(spark, path)
    seconds = F.unix_micros("ts") / F.lit(1e6)
    return back.select(r6(seconds).alias("seconds"), "orig_h", "orig_p", "proto", "orig_bytes", "conn_state")


@query(SQL_CHECKS["folder_label"])
def labelled_folders(spark, sf_dir):
    """One log per capture folder, read back with one glob and labelled by folder."""
    base = scratch_path(spark, "captures")
    rows = frozen(_log_rows(spark, sf_dir).join(label_queries._in_folders(spark, sf_dir), "conn_id"), "in-folders")
    for folder in ("logs_normal", "logs_syn", "logs_dns", "logs_http", "logs_other"):
        one = rows.filter(F.col("folder") == folder)
        writers.write_conn_log(one, f"{base}/{folder}/conn.log", CONN_COLUMNS_IP_PROTO)
    back = readers.read_labelled_folders(spark, base)
    return back.select(F.col("uid").cast("long").alias("conn_id"), "folder", "label", "attack_type")


@query(f"WITH {CONN} SELECT attack_type, count(*) AS n FROM conn WHERE label = 'anomaly' GROUP BY attack_type")
def labelled_table(spark, sf_dir):
    """Labelled rows partitioned by label: a filter on the label reads one folder."""
    path = scratch_path(spark, "labelled")
    writers.write_labelled(conn(spark, sf_dir), path)
    one = spark.read.parquet(path).filter("label = 'anomaly'")
    return one.groupBy("attack_type").agg(F.count("*").alias("n"))


@query(f"WITH {CONN} SELECT conn_id, duration, CAST(orig_bytes AS DOUBLE) AS orig_bytes FROM conn")
def feature_csv(spark, sf_dir):
    path = scratch_path(spark, "features")
    rows = conn(spark, sf_dir).select("conn_id", "duration", "orig_bytes")
    writers.write_features(rows, path, "csv")
    names = readers.feature_names(spark, path, "csv")
    back = readers.typed_cells(readers.read_csv(spark, path))
    return back.select(F.col(names[0]).cast("long").alias("conn_id"), *names[1:])


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
      CASE WHEN l_linenumber = 3 THEN 0.0 WHEN l_linenumber = 4 THEN 0.0 ELSE l_extendedprice END AS flow_bytes,
      CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS y FROM lineitem"""
)
def cicids_csv(spark, sf_dir):
    """Padded headers, infinities and NaN text, any-case label column."""
    path = scratch_path(spark, "cicids")
    line = F.col("l_linenumber")
    text = F.col("l_extendedprice").cast("string")
    odd = F.when(line == 3, "Infinity").when(line == 4, "NaN").otherwise(text)
    label = F.when(F.col("l_returnflag") == "N", "BENIGN").otherwise("DoS Hulk")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    rows = table(spark, sf_dir, "lineitem").select(*keys, odd.alias(" Flow Bytes/s"), label.alias(" Label"))
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    back = readers.read_cicids(spark, path)
    whole = [F.col(k).cast("long").alias(k) for k in keys[:4]]
    return back.select(*whole, "l_quantity", F.col("`Flow Bytes/s`").alias("flow_bytes"), "y")


@query(SQL_CHECKS["unsw_to_conn"])
def unsw_csv(spark, sf_dir):
    path = scratch_path(spark, "unsw")
    label_queries._unsw_rows(spark, sf_dir).drop("id").write.option("header", True).csv(path)
    back = readers.load_connections(spark, "unsw", path)
    long = lambda c: F.col(c).cast("long")
    return back.groupBy("label", "attack_type").agg(
        F.count("*").alias("n"),
        F.round(F.sum(F.col("duration").cast("double")), 4).alias("duration"),
        F.sum(long("orig_bytes")).alias("orig_bytes"),
        F.max(long("resp_bytes")).alias("resp_bytes"),
        F.sum(long("orig_pkts")).alias("orig_pkts"),
        F.max("ts").cast("timestamp_ntz").alias("last_ts"),
        F.max("orig_p").cast("int").alias("orig_p"),
        F.max("history").alias("history"),
    )


@query(SQL_CHECKS["interval_ip_label"])
def attack_log_csv(spark, sf_dir):
    """The attack log goes through its CSV form before it labels the connections."""
    path = scratch_path(spark, "attack-log")
    log = label_queries.attack_log(spark).coalesce(1).orderBy("interval_idx").drop("interval_idx")
    writers.write_attack_log(log, path)
    rows = conn(spark, sf_dir).select("conn_id", "ts", "orig_h", "resp_h")
    from flowmarrow.operators.labeling import label_by_intervals

    done = label_by_intervals(rows, readers.read_attack_log(spark, path), match_hosts=True)
    return done.select("conn_id", "label", "attack_type")


METRIC_SQL = f"""WITH {SCORED}, m AS (SELECT attack_type AS model, {CELLS} FROM sconn GROUP BY attack_type)
  SELECT model, round({F1}, 6) AS f1, round({PRECISION}, 6) AS precision,
    round(CASE WHEN fp + tn > 0 THEN CAST(fp AS DOUBLE) / (fp + tn) END, 6) AS false_positive_rate FROM m"""


def _metric_rows(spark, sf_dir):
    found = mt.binary_metrics(scored_conn(spark, sf_dir), by=["attack_type"])
    return found.select(F.col("attack_type").alias("model"), "f1", "precision", "false_positive_rate")


@query(METRIC_SQL)
def metric_csv(spark, sf_dir):
    """Missing numbers are written as ``nan`` and read back as null."""
    path = scratch_path(spark, "metrics")
    writers.write_metrics_csv(_metric_rows(spark, sf_dir), path)
    back = readers.read_metric_csv(spark, path)
    return metric_queries.rounded(back, ["f1", "precision", "false_positive_rate"], ["model"])


@query(METRIC_SQL)
def json_report(spark, sf_dir):
    """``{"model": {"f1": ..}}`` as one JSON text, and back to rows."""
    path = scratch_path(spark, "report")
    rows = _metric_rows(spark, sf_dir)
    fields = ["f1", "precision", "false_positive_rate"]
    entry = F.struct("model", F.struct(*fields))
    report = rows.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    report.write.text(path)
    back = readers.metrics_from_json(spark.read.text(path), "value", fields)
    return metric_queries.rounded(back, fields, ["model"])


@query(f"WITH {SCORED} SELECT conn_id, score FROM sconn WHERE prediction = 1")
def anomaly_csv(spark, sf_dir):
    path = scratch_path(spark, "anomalies")
    rows = scored_conn(spark, sf_dir).select("conn_id", "score", "prediction")
    writers.write_anomalies(rows, path)
    back = readers.read_csv(spark, path)
    return back.select(F.col("conn_id").cast("long").alias("conn_id"), F.col("score").cast("double").alias("score"))


@query(
    f"""WITH {alert_queries.EXPLAINED} SELECT severity, count(*) AS n, CAST(sum(priority_score) AS BIGINT) AS priorities,
      CAST(max((SELECT count(*) FROM pr)) AS BIGINT) AS total_anomalies FROM pr GROUP BY severity"""
)
def alert_report_files(spark, sf_dir):
    path = scratch_path(spark, "alert-report")
    rows = alert_queries.explained_input(spark, sf_dir)
    by_priority = alert_queries.explanations(rows, urgent_first=True)
    writers.write_alert_report(alert_queries.explanations(rows), path, by_priority)
    head = spark.read.json(f"{path}/summary", schema="total_anomalies long")
    alerts = spark.read.json(f"{path}/alerts", schema="severity string, priority_score long")
    total = head.select("total_anomalies").scalar()
    return alerts.groupBy("severity").agg(
        F.count("*").alias("n"), F.sum("priority_score").alias("priorities")
    ).withColumn("total_anomalies", total)


@query(
    f"""WITH {CONN}, d AS (SELECT CAST(week(ts) AS INTEGER) AS wk, count(*) AS n FROM conn WHERE label = 'anomaly' GROUP BY 1)
    SELECT 'baseline' AS kind, 1 AS records FROM conn HAVING count(*) > 0 UNION ALL SELECT 'check', count(*) FROM d
    UNION ALL SELECT 'summary', 1 FROM d HAVING count(*) > 0"""
)
def drift_report_files(spark, sf_dir):
    from flowmarrow.operators import drift as dr
    from flowmarrow.plans.drift_queries import _weekly

    path = scratch_path(spark, "drift-report")
    base, cur = _weekly(spark, sf_dir)
    history = dr.psi_drift(base, cur, "duration", by=["wk"]).withColumnRenamed("wk", "checked_at")
    writers.write_drift_report(history, mt.baseline_stats(base, "duration"), path)
    return spark.read.json(path).groupBy("kind").agg(F.count("*").alias("records"))


@query(
    f"""WITH {CONN} SELECT CAST(count(*) AS BIGINT) AS rows, round(avg(least(duration / 20, 1.0)), 6) AS mean_score FROM conn"""
)
def stream_csv_tail(spark, sf_dir):
    """New CSV files of a folder, one per micro-batch, scored as they arrive."""
    feed, out = scratch_path(spark, "feed"), scratch_path(spark, "tail")
    rows = conn(spark, sf_dir).select("conn_id", "duration")
    rows.repartition(3, "conn_id").write.option("header", True).csv(feed)
    tail = live.tail_csv(spark, feed, rows.schema)
    score = lambda df: df.withColumn("score", F.least(F.col("duration") / 20, F.lit(1.0)))
    live.score_batches(tail, score, out, availableNow=True).awaitTermination()
    done = live.read_batches(spark, out)
    mean = F.sum(F.col("mean_score") * F.col("rows")) / F.sum("rows")
    return done.agg(F.sum("rows").alias("rows"), r6(mean).alias("mean_score"))


@query(
    f"""WITH {CONN} SELECT CAST(conn_id AS VARCHAR) AS conn_id, CAST(duration AS DOUBLE) AS duration, CAST(orig_bytes AS DOUBLE) AS orig_bytes,
      CASE WHEN label = 'anomaly' THEN 1 ELSE 0 END AS y FROM conn WHERE proto <> 'icmp'"""
)
def labelled_matrix(spark, sf_dir):
    """Features of all connections and labels of most, written apart and read as one table by id."""
    base, df = scratch_path(spark, "matrix"), conn(spark, sf_dir)
    df.select("conn_id", "duration", "orig_bytes").write.option("header", True).csv(f"{base}/features")
    df.filter("proto <> 'icmp'").select("conn_id", "label").repartition(3).write.option("header", True).csv(f"{base}/labels")
    return readers.read_labelled_matrix(spark, f"{base}/features", f"{base}/labels")
