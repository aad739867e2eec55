"""The given tables as the inputs of the queries, and the same views as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conn_of(events: DataFrame) -> DataFrame:
    """Connections as a fixed projection of the events table."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = (
        F.when(F.col("event_type") != "error", "normal")
        .when(F.col("user_id") % 4 == 0, "syn_flood")
        .when(F.col("user_id") % 4 == 1, "dns_amplification")
        .when(F.col("user_id") % 4 == 2, "http_flood")
        .otherwise("udp_flood")
    )
    proto = F.when(F.col("event_id") % 4 == 2, "udp").when(F.col("event_id") % 4 == 3, "icmp")
    return events.select(
        F.col("event_id").alias("conn_id"),
        "ts",
        F.concat(F.lit("10.0.0."), F.col("user_id")).alias("orig_h"),
        (1024 + k).alias("orig_p"),
        F.concat(F.lit("srv-"), F.col("event_type")).alias("resp_h"),
        (F.col("event_id") * 7919 % 50).alias("resp_p"),
        proto.otherwise("tcp").alias("proto"),
        (F.col("value") / 10).alias("duration"),
        F.round(F.col("value") * 100).cast("long").alias("orig_bytes"),
        F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("event_id") % 500).alias("resp_bytes"),
        (k + 1).alias("orig_pkts"),
        (F.col("event_id") % 5).alias("resp_pkts"),
        (F.col("event_id") % 32).alias("tcp_flags"),
        (40 + k).alias("length"),
        F.when(F.col("event_type") == "error", "anomaly").otherwise("normal").alias("label"),
        kind.alias("attack_type"),
    )


def conn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conn_of(table(spark, sf_dir, "events"))


CONN = """conn AS (
  SELECT event_id AS conn_id, ts, '10.0.0.' || user_id AS orig_h, 1024 + k AS orig_p,
         'srv-' || event_type AS resp_h, (event_id * 7919) % 50 AS resp_p,
         CASE event_id % 4 WHEN 2 THEN 'udp' WHEN 3 THEN 'icmp' ELSE 'tcp' END AS proto,
         value / 10 AS duration, CAST(round(value * 100) AS BIGINT) AS orig_bytes,
         CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 500 END AS resp_bytes,
         k + 1 AS orig_pkts, event_id % 5 AS resp_pkts, event_id % 32 AS tcp_flags,
         40 + k AS length,
         CASE WHEN event_type = 'error' THEN 'anomaly' ELSE 'normal' END AS label,
         CASE WHEN event_type <> 'error' THEN 'normal'
              WHEN user_id % 4 = 0 THEN 'syn_flood'
              WHEN user_id % 4 = 1 THEN 'dns_amplification'
              WHEN user_id % 4 = 2 THEN 'http_flood' ELSE 'udp_flood' END AS attack_type
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events))"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connections read as one packet each."""
    return packets_of(conn(spark, sf_dir))


def packets_of(df: DataFrame) -> DataFrame:
    return df.select(
        "conn_id",
        "ts",
        F.col("orig_h").alias("src_ip"),
        F.col("orig_p").alias("sport"),
        F.col("resp_h").alias("dst_ip"),
        F.col("resp_p").alias("dport"),
        "proto",
        "length",
        "tcp_flags",
        F.lit(True).alias("is_ip"),
    )


def r6(c):
    """A double rounded to six places for comparison."""
    return F.round(c, 6)
