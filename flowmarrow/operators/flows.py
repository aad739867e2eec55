"""Packets to flows and packet-window statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmarrow.functions.columns import has_syn, micros, non_negative_seconds
from flowmarrow.operators.features import with_totals_and_ratios
from flowmarrow.operators.ordered import with_ordinal
from flowmarrow.schemas import FEATURES, FLOW_KEY


def packets_to_connections(packets: DataFrame) -> DataFrame:
    """One connection row per IP packet, as a minimal converter writes them."""
    return packets.filter("is_ip").select(
        (micros("ts") / F.lit(1e6)).alias("ts"),
        F.col("src_ip").alias("orig_h"),
        F.coalesce("sport", F.lit(0)).alias("orig_p"),
        F.col("dst_ip").alias("resp_h"),
        F.coalesce("dport", F.lit(0)).alias("resp_p"),
        "proto",
        F.lit(0.0).alias("duration"),
        F.col("length").alias("orig_bytes"),
        F.lit(0).cast("long").alias("resp_bytes"),
        F.lit("S0").alias("conn_state"),
        F.lit("-").alias("service"),
    )


def as_connection(flows: DataFrame) -> DataFrame:
    return flows.select(
        F.col("src_ip").alias("orig_h"),
        F.col("sport").alias("orig_p"),
        F.col("dst_ip").alias("resp_h"),
        F.col("dport").alias("resp_p"),
        "proto",
        "ts_start",
        "ts_end",
        "orig_bytes",
        F.lit(0).cast("long").alias("resp_bytes"),
        "orig_pkts",
        F.lit(0).cast("long").alias("resp_pkts"),
    )


def flow_aggregates():
    return [
        F.min("ts").alias("ts_start"),
        F.max("ts").alias("ts_end"),
        F.sum("length").cast("long").alias("orig_bytes"),
        F.count("*").alias("orig_pkts"),
    ]


def assemble_flows(packets: DataFrame, timeout: float | None = None) -> DataFrame:
    """Unidirectional 5-tuple flows; with ``timeout`` a longer idle gap starts a new flow.

    Packets of one key within the same slot of ``timeout`` seconds are less than the timeout
    apart, so each slot is a piece of one flow. The pieces come from a plain aggregation with
    map-side combine; only their chaining needs an ordered window, whose size depends on the
    time span over the timeout and not on the number of packets of the key.
    """
    ip = packets.filter(F.col("src_ip").isNotNull())
    if timeout is None:
        return as_connection(ip.groupBy(*FLOW_KEY).agg(*flow_aggregates()))
    gap = int(timeout * 1_000_000)
    slot = F.floor(micros("ts") / F.lit(gap)).alias("slot")
    pieces = ip.groupBy(*FLOW_KEY, slot).agg(*flow_aggregates())
    by_time = Window.partitionBy(*FLOW_KEY).orderBy("slot")
    idle = micros("ts_start") - F.lag(micros("ts_end")).over(by_time)
    numbered = pieces.withColumn("opens", F.coalesce((idle > gap).cast("int"), F.lit(0))).withColumn(
        "nr", F.sum("opens").over(by_time)
    )
    flows = numbered.groupBy(*FLOW_KEY, "nr").agg(
        F.min("ts_start").alias("ts_start"),
        F.max("ts_end").alias("ts_end"),
        F.sum("orig_bytes").alias("orig_bytes"),
        F.sum("orig_pkts").alias("orig_pkts"),
    )
    return as_connection(flows)


def flow_features(flows: DataFrame, wanted: list[str] = FEATURES) -> DataFrame:
    """Flow rows to the feature vector; entropy and rate are 0 for assembled flows."""
    timed = flows.withColumn("duration", non_negative_seconds("ts_start", "ts_end"))
    full = with_totals_and_ratios(timed).withColumns(
        {
            "src_port_entropy": F.lit(0.0),
            "dst_port_entropy": F.lit(0.0),
            "connections_per_min": F.lit(0.0),
        }
    )
    cells = [
        F.col(c).cast("double").alias(c) if c in full.columns else F.lit(0.0).alias(c)
        for c in wanted
    ]
    return full.select("orig_h", "orig_p", "resp_h", "resp_p", "proto", "ts_start", "ts_end", *cells)


def packet_stat_columns() -> list:
    """The twelve packet statistics as aggregates; 0 where there is no packet."""
    n = F.count("*")
    size = F.col("length").cast("double")
    share = lambda cond: F.coalesce(F.avg(cond.cast("double")), F.lit(0.0))
    tcp, udp = F.col("proto") == "tcp", F.col("proto") == "udp"
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [
        n.alias("total_packets"),
        zero(F.sum(size)).alias("total_bytes"),
        share(tcp).alias("tcp_ratio"),
        share(udp).alias("udp_ratio"),
        share(~(tcp | udp)).alias("other_ratio"),
        F.count_distinct("src_ip").alias("unique_src"),
        F.count_distinct("dst_ip").alias("unique_dst"),
        zero(F.avg(size)).alias("mean_size"),
        zero(F.stddev_pop(size)).alias("std_size"),
        zero(F.max(size)).alias("max_size"),
        zero(F.min(size)).alias("min_size"),
        share(tcp & has_syn("tcp_flags")).alias("syn_ratio"),
    ]


def packet_stats(packets: DataFrame) -> DataFrame:
    """Statistics of a whole packet table as one row; twelve zeros when it is empty."""
    return packets.agg(*packet_stat_columns())


def packet_window_stats(packets: DataFrame, width: str = "5 seconds") -> DataFrame:
    return (
        packets.groupBy(F.window("ts", width).alias("w"))
        .agg(*packet_stat_columns())
        .select(F.col("w.start").alias("window_start"), "*")
        .drop("w")
    )


def oldest_tenth(flows: DataFrame) -> DataFrame:
    """The tenth of the flows that ended first, by a global position (no single-task ntile)."""
    keys = ["ts_end", "orig_h", "orig_p", "resp_h", "resp_p", "proto", "ts_start"]
    placed = with_ordinal(flows, keys, "_pos")
    n = placed.agg(F.count("*").alias("n")).scalar()
    return placed.filter(F.col("_pos") < F.ceil(n / F.lit(10))).drop("_pos")
