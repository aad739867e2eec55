"""Queries on labels, interval joins and label counts."""

import datetime as dt
from functools import reduce

from pyspark.sql import functions as F

from flowmarrow.operators import labeling as lb
from flowmarrow.operators import metrics as mt
from flowmarrow.plans.registry import query
from flowmarrow.plans.tables import CONN, conn, r6, table
from flowmarrow.sources.writers import attack_log_rows

# (type, source, target, start, end) in log order; rows 1 and 2 overlap, one has no source.
ATTACKS = [
    ("port_scan", "10.0.0.5", "srv-error", "2024-01-02 08:00:00", "2024-01-04 08:00:00"),
    ("udp_scan", "10.0.0.7", "srv-click", "2024-01-03 00:00:00", "2024-01-06 12:00:00"),
    ("syn_flood", None, None, "2024-01-08 00:00:00", "2024-01-08 18:30:00"),
    ("http_flood", "10.0.0.11", "srv-view", "2024-01-12 06:00:00", "2024-01-15 06:00:00"),
    ("slow_scan", "10.0.0.13", "srv-purchase", "2024-01-14 00:00:00", "2024-01-14 23:59:59"),
    ("service_detection", "10.0.0.17", "srv-signup", "2024-01-20 10:00:00", "2024-01-25 22:15:00"),
]
ATTACKS_SQL = "attacks(idx, attack, source_ip, target_ip, s, e) AS (VALUES " + ", ".join(
    f"({i}, '{a}', {repr(src) if src else 'NULL'}, {repr(dst) if dst else 'NULL'}, "
    f"TIMESTAMP '{s}', TIMESTAMP '{e}')"
    for i, (a, src, dst, s, e) in enumerate(ATTACKS)
) + ")"


def attack_log(spark):
    parse = dt.datetime.fromisoformat
    rows = [(i, a, src, dst, parse(s), parse(e)) for i, (a, src, dst, s, e) in enumerate(ATTACKS)]
    schema = (
        "interval_idx int, attack_type string, source_ip string, target_ip string, "
        "start_time timestamp_ntz, end_time timestamp_ntz"
    )
    return spark.createDataFrame(rows, schema)


INTERVAL_SQL = """WITH {conn}, {attacks}
  SELECT conn_id, CASE WHEN max(idx) IS NULL THEN 'normal' ELSE 'anomaly' END AS label,
    coalesce(arg_max(attack, idx), 'normal') AS attack_type
  FROM conn LEFT JOIN attacks ON ts >= s AND ts <= e {extra} GROUP BY conn_id"""
HOSTS_SQL = "AND (source_ip IS NULL OR orig_h = source_ip OR resp_h = target_ip)"


@query(INTERVAL_SQL.format(conn=CONN, attacks=ATTACKS_SQL, extra=""))
def interval_label(spark, sf_dir):
    rows = conn(spark, sf_dir).select("conn_id", "ts")
    return lb.label_by_intervals(rows, attack_log(spark)).select("conn_id", "label", "attack_type")


@query(INTERVAL_SQL.format(conn=CONN, attacks=ATTACKS_SQL, extra=HOSTS_SQL))
def interval_ip_label(spark, sf_dir):
    rows = conn(spark, sf_dir).select("conn_id", "ts", "orig_h", "resp_h")
    done = lb.label_by_intervals(rows, attack_log(spark), match_hosts=True)
    return done.select("conn_id", "label", "attack_type")


LONG_LOG_SQL = """attacks AS (SELECT conn_id AS idx, attack_type || '-' || conn_id % 10 AS attack,
    CASE WHEN conn_id % 7 > 0 THEN orig_h END AS source_ip, CASE WHEN conn_id % 3 > 0 THEN resp_h END AS target_ip,
    ts AS s, ts + INTERVAL 1 SECOND * CAST(orig_bytes % 86400 AS BIGINT) AS e FROM conn WHERE label = 'anomaly')"""


def long_attack_log(df):
    """Every anomalous connection opens an interval of up to a day: a fifth of the rows, many of them open at a time."""
    name = F.concat_ws("-", "attack_type", F.col("conn_id") % 10)
    return df.filter("label = 'anomaly'").select(
        F.col("conn_id").alias("interval_idx"),
        name.alias("attack_type"),
        F.when(F.col("conn_id") % 7 > 0, F.col("orig_h")).alias("source_ip"),
        F.when(F.col("conn_id") % 3 > 0, F.col("resp_h")).alias("target_ip"),
        F.col("ts").alias("start_time"),
        (F.col("ts") + F.make_dt_interval(secs=F.col("orig_bytes") % 86400)).alias("end_time"),
    )


@query(INTERVAL_SQL.format(conn=CONN, attacks=LONG_LOG_SQL, extra=HOSTS_SQL))
def interval_label_large_log(spark, sf_dir):
    """An attack log that grows with the connections."""
    df = conn(spark, sf_dir)
    rows = df.select("conn_id", "ts", "orig_h", "resp_h")
    done = lb.label_by_intervals(rows, long_attack_log(df), match_hosts=True)
    return done.select("conn_id", "label", "attack_type")


@query(
    f"""WITH {CONN}, {ATTACKS_SQL}, won AS (
      SELECT conn_id, arg_max(attack, idx) AS attack FROM conn JOIN attacks ON ts >= s AND ts <= e
      GROUP BY conn_id)
    SELECT a.attack, count(*) AS n_conns, round(CAST(epoch(max(e)) - epoch(max(s)) AS DOUBLE), 6) AS duration_seconds
    FROM won JOIN attacks a ON won.attack = a.attack GROUP BY a.attack"""
)
def attack_durations(spark, sf_dir):
    log = attack_log(spark)
    rows = lb.label_by_intervals(conn(spark, sf_dir).select("conn_id", "ts"), log)
    counts = rows.filter("label = 'anomaly'").groupBy("attack_type").agg(F.count("*").alias("n_conns"))
    return counts.join(F.broadcast(attack_log_rows(log)), "attack_type").select(
        F.col("attack_type").alias("attack"), "n_conns", r6("duration_seconds").alias("duration_seconds")
    )


FOLDERS_SQL = """folders AS (
  SELECT conn_id, CASE resp_h WHEN 'srv-view' THEN 'logs_normal' WHEN 'srv-error' THEN 'logs_syn'
    WHEN 'srv-click' THEN 'logs_dns' WHEN 'srv-signup' THEN 'logs_http' ELSE 'logs_other' END AS folder
  FROM conn),
labelled AS (SELECT conn_id, folder,
  CASE WHEN folder IN ('logs_syn', 'logs_dns', 'logs_http') THEN 'anomaly' ELSE 'normal' END AS label,
  CASE folder WHEN 'logs_syn' THEN 'syn_flood' WHEN 'logs_dns' THEN 'dns_amplification'
    WHEN 'logs_http' THEN 'http_flood' ELSE 'normal' END AS attack_type FROM folders)"""


def _in_folders(spark, sf_dir):
    resp = F.col("resp_h")
    folder = (
        F.when(resp == "srv-view", "logs_normal")
        .when(resp == "srv-error", "logs_syn")
        .when(resp == "srv-click", "logs_dns")
        .when(resp == "srv-signup", "logs_http")
        .otherwise("logs_other")
    )
    return conn(spark, sf_dir).select("conn_id", folder.alias("folder"))


@query(f"WITH {CONN}, {FOLDERS_SQL} SELECT conn_id, folder, label, attack_type FROM labelled")
def folder_label(spark, sf_dir):
    done = lb.label_by_folder(_in_folders(spark, sf_dir))
    return done.select("conn_id", "folder", "label", "attack_type")


@query(
    f"""WITH {CONN}, {FOLDERS_SQL} SELECT attack_type, label, count(*) AS n,
      round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct
    FROM labelled GROUP BY attack_type, label"""
)
def label_counts(spark, sf_dir):
    counts = mt.value_counts(lb.label_by_folder(_in_folders(spark, sf_dir)), ["attack_type", "label"])
    return counts.select("attack_type", "label", "n", r6("pct").alias("pct"))


#: What the log of every server has besides server and id.
SOURCES = {
    "srv-view": [], "srv-error": ["duration"], "srv-click": ["duration", "proto"], "srv-purchase": ["orig_bytes"],
    "srv-signup": ["proto", "orig_bytes", "resp_bytes"],
}
_HAS = lambda c: ", ".join(repr(h) for h, cells in SOURCES.items() if c in cells)


@query(
    f"WITH {CONN} SELECT resp_h, conn_id, "
    + ", ".join(f"CASE WHEN resp_h IN ({_HAS(c)}) THEN {c} END AS {c}" for c in ("duration", "proto", "orig_bytes", "resp_bytes"))
    + " FROM conn"
)
def union_logs(spark, sf_dir):
    """The logs of all servers, each with its own columns, as one table."""
    df = conn(spark, sf_dir)
    logs = [df.filter(F.col("resp_h") == h).select("resp_h", "conn_id", *cells) for h, cells in SOURCES.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)


def _unsw_rows(spark, sf_dir):
    """Order lines in the layout of the flow dataset."""
    kind = F.when(F.col("l_returnflag") == "R", "Exploits").when(F.col("l_returnflag") == "A", "Normal")
    return table(spark, sf_dir, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("id"),
        F.col("l_discount").alias("dur"),
        F.col("l_quantity").cast("long").alias("sbytes"),
        F.round("l_extendedprice").cast("long").alias("dbytes"),
        F.col("l_linenumber").alias("spkts"),
        (F.col("l_orderkey") % 7).alias("dpkts"),
        (F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber")).alias("stime"),
        kind.alias("attack_cat"),
    )


@query(
    """SELECT label, attack_type, count(*) AS n, round(sum(l_discount), 4) AS duration,
      CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS orig_bytes, max(CAST(round(l_extendedprice) AS BIGINT)) AS resp_bytes,
      CAST(sum(l_linenumber) AS BIGINT) AS orig_pkts, max(l_shipdate + INTERVAL 1 SECOND * l_linenumber) AS last_ts,
      0 AS orig_p, '-' AS history
    FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'anomaly' ELSE 'normal' END AS label,
      CASE WHEN l_returnflag = 'R' THEN 'Exploits' ELSE 'normal' END AS attack_type FROM lineitem)
    GROUP BY label, attack_type"""
)
def unsw_to_conn(spark, sf_dir):
    done = lb.unsw_to_connections(_unsw_rows(spark, sf_dir))
    return done.groupBy("label", "attack_type").agg(
        F.count("*").alias("n"),
        F.round(F.sum("duration"), 4).alias("duration"),
        F.sum("orig_bytes").alias("orig_bytes"),
        F.max("resp_bytes").alias("resp_bytes"),
        F.sum("orig_pkts").alias("orig_pkts"),
        F.max("ts").cast("timestamp_ntz").alias("last_ts"),
        F.max("orig_p").alias("orig_p"),
        F.max("history").alias("history"),
    )


@query(
    """SELECT doc_id, CASE toxic WHEN 0 THEN 'normal' WHEN 1 THEN 'anomaly' END AS label, toxic AS y
    FROM labels"""
)
def label_map(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return lb.binary_target(lb.label_from_dataset(rows), "label").select("doc_id", "label", "y")


@query(
    """SELECT event_id, CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END AS y FROM events"""
)
def truthy_label(spark, sf_dir):
    spelled = F.when(F.col("event_type") == "error", " Anomaly").when(
        F.col("event_type") == "purchase", "ATTACK"
    )
    rows = table(spark, sf_dir, "events").select("event_id", spelled.otherwise("benign").alias(" Label "))
    return lb.truth_column(rows).select("event_id", "y")


@query(
    f"""WITH {CONN} SELECT f.conn_id, duration, label FROM (SELECT conn_id, duration FROM conn) f
    JOIN (SELECT conn_id, label FROM conn WHERE proto <> 'icmp') l USING (conn_id)"""
)
def feature_label_join(spark, sf_dir):
    df = conn(spark, sf_dir)
    labels = df.filter("proto <> 'icmp'").select("conn_id", "label")
    return lb.feature_label_join(df.select("conn_id", "duration"), labels)
