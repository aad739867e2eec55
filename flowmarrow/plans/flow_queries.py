"""Queries on packets, flows and packet windows."""

from pyspark.sql import functions as F

from flowmarrow.operators import flows as fl
from flowmarrow.plans.registry import query
from flowmarrow.plans.tables import CONN, packets, r6
from flowmarrow.schemas import FEATURES, PACKET_SCHEMA, WINDOW_FEATURES
from flowmarrow.session import scratch_path
from flowmarrow.sources import captures

KEY = "orig_h, orig_p, resp_h, resp_p, proto"


@query(
    f"""WITH {CONN} SELECT {KEY}, min(ts) AS ts_start, max(ts) AS ts_end,
      CAST(sum(length) AS BIGINT) AS orig_bytes, CAST(0 AS BIGINT) AS resp_bytes,
      count(*) AS orig_pkts, CAST(0 AS BIGINT) AS resp_pkts FROM conn GROUP BY {KEY}"""
)
def flow_assembly(spark, sf_dir):
    return fl.assemble_flows(packets(spark, sf_dir))


SESSIONS = """{conn}, p AS (SELECT {keys}, ts, length FROM conn),
  m AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > {gap} THEN 1 ELSE 0 END AS opens
    FROM p WINDOW w AS (PARTITION BY {keys} ORDER BY ts)),
  s AS (SELECT *, sum(opens) OVER (PARTITION BY {keys} ORDER BY ts) AS nr FROM m)"""


@query(
    f"""WITH {SESSIONS.format(conn=CONN, keys=KEY, gap=60_000_000)}
    SELECT {KEY}, min(ts) AS ts_start, max(ts) AS ts_end, CAST(sum(length) AS BIGINT) AS orig_bytes,
      CAST(0 AS BIGINT) AS resp_bytes, count(*) AS orig_pkts, CAST(0 AS BIGINT) AS resp_pkts
    FROM s GROUP BY {KEY}, nr"""
)
def flow_sessions_60s(spark, sf_dir):
    return fl.assemble_flows(packets(spark, sf_dir), timeout=60.0)


HOST_GAP = 6 * 3600


@query(
    f"""WITH {SESSIONS.format(conn=CONN, keys='orig_h', gap=HOST_GAP * 1_000_000)}
    SELECT orig_h, min(ts) AS ts_start, max(ts) AS ts_end, CAST(sum(length) AS BIGINT) AS orig_bytes,
      count(*) AS orig_pkts FROM s GROUP BY orig_h, nr"""
)
def host_sessions(spark, sf_dir):
    """The idle-gap rule per host, where sessions hold many packets."""
    one = packets(spark, sf_dir).withColumns(
        {"sport": F.lit(0), "dst_ip": F.lit("any"), "dport": F.lit(0), "proto": F.lit("any")}
    )
    flows = fl.assemble_flows(one, timeout=float(HOST_GAP))
    return flows.select("orig_h", "ts_start", "ts_end", "orig_bytes", "orig_pkts")


@query(
    f"""WITH {CONN}, f AS (SELECT {KEY}, min(ts) AS ts_start, max(ts) AS ts_end,
        CAST(sum(length) AS DOUBLE) AS b, CAST(count(*) AS DOUBLE) AS n FROM conn GROUP BY {KEY})
    SELECT {KEY}, ts_start, round((epoch_us(ts_end) - epoch_us(ts_start)) / 1e6, 6) AS duration,
      b AS orig_bytes, CAST(0 AS DOUBLE) AS resp_bytes, n AS orig_pkts, CAST(0 AS DOUBLE) AS resp_pkts, b AS total_bytes, n AS total_pkts,
      CAST(0 AS DOUBLE) AS bytes_ratio, CAST(0 AS DOUBLE) AS pkts_ratio, CAST(0 AS DOUBLE) AS src_port_entropy, CAST(0 AS DOUBLE) AS dst_port_entropy,
      CAST(0 AS DOUBLE) AS connections_per_min FROM f"""
)
def flow_features(spark, sf_dir):
    rows = fl.flow_features(fl.assemble_flows(packets(spark, sf_dir)))
    keys = ["orig_h", "orig_p", "resp_h", "resp_p", "proto", "ts_start"]
    return rows.select(*keys, *[r6(c).alias(c) for c in FEATURES])


WINDOW_CELLS = """count(*) AS total_packets, CAST(sum(length) AS DOUBLE) AS total_bytes,
  round(avg(CASE WHEN proto = 'tcp' THEN 1.0 ELSE 0 END), 6) AS tcp_ratio,
  round(avg(CASE WHEN proto = 'udp' THEN 1.0 ELSE 0 END), 6) AS udp_ratio,
  round(avg(CASE WHEN proto IN ('tcp', 'udp') THEN 0.0 ELSE 1 END), 6) AS other_ratio,
  count(DISTINCT orig_h) AS unique_src, count(DISTINCT resp_h) AS unique_dst,
  round(avg(length), 6) AS mean_size, round(stddev_pop(length), 6) AS std_size,
  CAST(max(length) AS DOUBLE) AS max_size, CAST(min(length) AS DOUBLE) AS min_size,
  round(avg(CASE WHEN proto = 'tcp' AND (tcp_flags & 2) <> 0 THEN 1.0 ELSE 0 END), 6) AS syn_ratio"""


@query(
    f"""WITH {CONN} SELECT time_bucket(INTERVAL '5 seconds', ts, TIMESTAMP '1970-01-01') AS window_start,
      {WINDOW_CELLS} FROM conn GROUP BY 1"""
)
def packet_window_stats_5s(spark, sf_dir):
    rows = fl.packet_window_stats(packets(spark, sf_dir))
    return rows.select("window_start", *[_cell(c) for c in WINDOW_FEATURES])


@query(f"WITH {CONN} SELECT {WINDOW_CELLS} FROM conn")
def packet_stats(spark, sf_dir):
    return fl.packet_stats(packets(spark, sf_dir)).select(*[_cell(c) for c in WINDOW_FEATURES])


@query(
    f"""WITH {CONN} SELECT 0 AS total_packets, CAST(0 AS DOUBLE) AS total_bytes, CAST(0 AS DOUBLE) AS syn_ratio, CAST(0 AS DOUBLE) AS std_size,
      count(*) AS rows_read FROM conn"""
)
def packet_stats_empty(spark, sf_dir):
    rows = packets(spark, sf_dir)
    none = fl.packet_stats(rows.filter("length < 0"))
    n = rows.agg(F.count("*").alias("n")).scalar()
    return none.select("total_packets", "total_bytes", "syn_ratio", "std_size", n.alias("rows_read"))


def _cell(name):
    whole = name in ("total_packets", "unique_src", "unique_dst")
    return F.col(name) if whole else r6(name).alias(name)


@query(
    f"""WITH {CONN} SELECT round(epoch_us(ts) / 1e6, 6) AS ts, {KEY}, CAST(0 AS DOUBLE) AS duration, length AS orig_bytes,
      CAST(0 AS BIGINT) AS resp_bytes, 'S0' AS conn_state, '-' AS service FROM conn"""
)
def packet_connections(spark, sf_dir):
    rows = fl.packets_to_connections(packets(spark, sf_dir))
    return rows.withColumn("ts", r6("ts"))


@query(
    f"""WITH {SESSIONS.format(conn=CONN, keys=KEY, gap=60_000_000)},
      f AS (SELECT {KEY}, min(ts) AS ts_start, max(ts) AS ts_end, count(*) AS n FROM s GROUP BY {KEY}, nr),
      t AS (SELECT *, ntile(10) OVER (ORDER BY ts_end, {KEY}, ts_start) AS decile FROM f)
    SELECT {KEY}, ts_end FROM t WHERE decile = 1"""
)
def oldest_flows(spark, sf_dir):
    """The oldest tenth of the open flows, which a full flow table gives up first."""
    flows = fl.assemble_flows(packets(spark, sf_dir), timeout=60.0)
    return fl.oldest_tenth(flows).select("orig_h", "orig_p", "resp_h", "resp_p", "proto", "ts_end")


@query(
    f"""WITH {CONN} SELECT ts, '10.1.' || (conn_id // 200 % 200) || '.' || (conn_id % 200) AS src_ip,
      CASE WHEN proto = 'icmp' THEN 0 ELSE orig_p END AS sport, '10.2.0.' || length(resp_h) AS dst_ip,
      CASE WHEN proto = 'icmp' THEN 0 ELSE resp_p END AS dport, proto,
      CASE WHEN proto = 'tcp' THEN tcp_flags END AS tcp_flags, length + 60 AS length FROM conn"""
)
def capture_packets(spark, sf_dir):
    """All packets written as capture files and read back, every file in many ranges of bytes."""
    part = lambda c, below: (F.floor(c) % below).cast("string")
    rows = packets(spark, sf_dir).withColumns(
        {
            "ts": F.col("ts").cast("timestamp"),
            "src_ip": F.concat(F.lit("10.1."), part(F.col("conn_id") / 200, 200), F.lit("."), part(F.col("conn_id"), 200)),
            "dst_ip": F.concat(F.lit("10.2.0."), F.length("dst_ip").cast("string")),
            "length": F.col("length") + 60,
        }
    )
    path = scratch_path(spark, "captures")
    cells = [F.col(f.name).cast(f.dataType).alias(f.name) for f in PACKET_SCHEMA.fields]
    captures.write_packets(rows.repartition(3, "conn_id").select(*cells), path)
    back = captures.read_packets(spark, path, range_bytes=1 << 16)
    return back.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "src_ip", "sport", "dst_ip", "dport", "proto", "tcp_flags", "length")
