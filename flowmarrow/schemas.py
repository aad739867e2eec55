"""Column lists and schemas of the data model."""

from pyspark.sql import types as T

# Connection-log columns and their log types.
CONN_COLUMNS = [
    "ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p",
    "proto", "service", "duration", "orig_bytes", "resp_bytes",
    "conn_state", "local_orig", "local_resp", "missed_bytes",
    "history", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes",
    "tunnel_parents",
]
CONN_COLUMNS_IP_PROTO = [*CONN_COLUMNS, "ip_proto"]
CONN_COLUMNS_MINIMAL = [
    "ts", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p",
    "proto", "duration", "orig_bytes", "resp_bytes", "conn_state", "service",
]
CONN_LOG_TYPES = {
    "ts": "time", "uid": "string",
    "id.orig_h": "addr", "id.orig_p": "port", "id.resp_h": "addr", "id.resp_p": "port",
    "proto": "enum", "service": "string", "duration": "interval",
    "orig_bytes": "count", "resp_bytes": "count", "conn_state": "string",
    "local_orig": "bool", "local_resp": "bool", "missed_bytes": "count",
    "history": "string", "orig_pkts": "count", "orig_ip_bytes": "count",
    "resp_pkts": "count", "resp_ip_bytes": "count",
    "tunnel_parents": "set[string]", "ip_proto": "count",
}
LOG_TYPE_TO_SPARK = {
    "time": "timestamp", "interval": "double", "addr": "string", "enum": "string",
    "string": "string", "port": "int", "count": "bigint", "bool": "boolean",
    "set[string]": "array<string>",
}

# The ordered feature vector and the packet-window vector.
FEATURES = [
    "duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts",
    "total_bytes", "total_pkts", "bytes_ratio", "pkts_ratio",
    "src_port_entropy", "dst_port_entropy", "connections_per_min",
]
BASE_NUMERIC = FEATURES[:5]
WINDOW_FEATURES = [
    "total_packets", "total_bytes", "tcp_ratio", "udp_ratio", "other_ratio",
    "unique_src", "unique_dst", "mean_size", "std_size", "max_size", "min_size", "syn_ratio",
]
FLOW_KEY = ["src_ip", "sport", "dst_ip", "dport", "proto"]

PACKET_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("sport", T.IntegerType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("dport", T.IntegerType()),
        T.StructField("proto", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("tcp_flags", T.IntegerType()),
        T.StructField("is_ip", T.BooleanType()),
    ]
)


def renamed(column: str) -> str:
    """Log column name to DataFrame column name (``id.orig_h`` becomes ``orig_h``)."""
    return column.removeprefix("id.")
