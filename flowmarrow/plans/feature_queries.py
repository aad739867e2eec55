"""Queries on flow features, projections and sequences."""

from pyspark.sql import functions as F

from flowmarrow.functions.columns import clipped_finite, numeric_or_zero, timestamp_of
from flowmarrow.operators import features as ft
from flowmarrow.operators import labeling as lb
from flowmarrow.plans.registry import query
from flowmarrow.plans.tables import CONN, conn, r6, table
from flowmarrow.schemas import FEATURES
from flowmarrow.sources.readers import drop_invalid_times

ENTROPY_SQL = """
  SELECT orig_h, greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0) AS h
  FROM (SELECT orig_h, {port}, count(*) AS n FROM conn GROUP BY ALL) GROUP BY orig_h"""

FEATURES_SQL = f"""
  src AS ({ENTROPY_SQL.format(port='orig_p')}),
  dst AS ({ENTROPY_SQL.format(port='resp_p')}),
  feat AS (
    SELECT conn_id, c.orig_h, c.ts, label, attack_type,
      duration, orig_bytes, resp_bytes, orig_pkts, resp_pkts,
      orig_bytes + resp_bytes AS total_bytes, orig_pkts + resp_pkts AS total_pkts,
      CASE WHEN resp_bytes > 0 THEN orig_bytes / CAST(resp_bytes AS DOUBLE) ELSE 0 END AS bytes_ratio,
      CASE WHEN resp_pkts > 0 THEN orig_pkts / CAST(resp_pkts AS DOUBLE) ELSE 0 END AS pkts_ratio,
      src.h AS src_port_entropy, dst.h AS dst_port_entropy,
      count(*) OVER (PARTITION BY c.orig_h, date_trunc('minute', c.ts)) AS connections_per_min
    FROM conn c JOIN src USING (orig_h) JOIN dst USING (orig_h))"""


@query(
    f"""WITH {CONN}, {FEATURES_SQL}
    SELECT conn_id, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in FEATURES)} FROM feat"""
)
def conn_features_12(spark, sf_dir):
    full = ft.connection_features(conn(spark, sf_dir))
    matrix = ft.feature_matrix(full, ["conn_id"])
    return matrix.select("conn_id", *[r6(c).alias(c) for c in FEATURES])


@query(
    f"""WITH {CONN}, src AS ({ENTROPY_SQL.format(port='orig_p')}),
      dst AS ({ENTROPY_SQL.format(port='resp_p')}),
      n AS (SELECT orig_h, count(*) AS n_conns FROM conn GROUP BY 1)
    SELECT orig_h, n_conns, round(src.h, 6) AS src_port_entropy, round(dst.h, 6) AS dst_port_entropy
    FROM n JOIN src USING (orig_h) JOIN dst USING (orig_h)"""
)
def port_entropy_by_host(spark, sf_dir):
    hosts = ft.port_entropy(conn(spark, sf_dir))
    return hosts.select(
        "orig_h",
        "n_conns",
        r6("src_port_entropy").alias("src_port_entropy"),
        r6("dst_port_entropy").alias("dst_port_entropy"),
    )


@query(
    f"""WITH {CONN} SELECT orig_h, date_trunc('minute', ts) AS minute, count(*) AS connections_per_min
    FROM conn GROUP BY 1, 2"""
)
def conns_per_minute(spark, sf_dir):
    return ft.connections_per_minute(conn(spark, sf_dir))


@query(
    f"""WITH {CONN}, src AS ({ENTROPY_SQL.format(port='orig_p')}),
      rate AS (SELECT orig_h, date_trunc('minute', ts) AS m, count(*) AS n FROM conn GROUP BY 1, 2),
      peak AS (SELECT orig_h, max(n) AS peak_rate, count(*) AS active_minutes FROM rate GROUP BY 1)
    SELECT orig_h, round(h, 6) AS src_port_entropy, peak_rate, active_minutes
    FROM src JOIN peak USING (orig_h) ORDER BY round(h, 6) DESC, orig_h LIMIT 20"""
)
def top_hosts(spark, sf_dir):
    df = conn(spark, sf_dir)
    peak = (
        ft.connections_per_minute(df)
        .groupBy("orig_h")
        .agg(F.max("connections_per_min").alias("peak_rate"), F.count("*").alias("active_minutes"))
    )
    entropy = ft.port_entropy(df).select("orig_h", r6("src_port_entropy").alias("src_port_entropy"))
    return entropy.join(peak, "orig_h").orderBy(F.desc("src_port_entropy"), "orig_h").limit(20)


@query(
    """SELECT event_id,
      CASE event_id % 4 WHEN 3 THEN NULL ELSE date_trunc('second', ts) END AS ts_clean
    FROM events WHERE event_id % 4 <> 3"""
)
def ts_normalise(spark, sf_dir):
    # the four spellings a log may hold: epoch number, ISO text, spaced text, unusable text
    whole = F.date_trunc("second", F.col("ts")).cast("timestamp")
    kind = F.col("event_id") % 4
    raw = (
        F.when(kind == 0, F.unix_timestamp(whole).cast("string"))
        .when(kind == 1, F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(kind == 2, F.date_format(whole, "yyyy-MM-dd HH:mm:ss"))
        .otherwise("not a time")
    )
    events = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    clean = events.select("event_id", timestamp_of("raw").cast("timestamp_ntz").alias("ts_clean"))
    return drop_invalid_times(clean, "ts_clean")


NUMERIC_TEXT_SQL = """CASE event_id % 5 WHEN 0 THEN {zero} WHEN 1 THEN {zero}
      WHEN 2 THEN {inf} WHEN 3 THEN {zero} ELSE value END"""


def _numeric_text():
    kind = F.col("event_id") % 5
    return (
        F.when(kind == 0, "-")
        .when(kind == 1, "NaN")
        .when(kind == 2, "-Infinity")
        .when(kind == 3, "")
        .otherwise(F.col("value").cast("string"))
    )


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 4 THEN round(value, 6) WHEN 2 THEN CAST('-Infinity' AS DOUBLE) ELSE 0 END AS duration
    FROM events"""
)
def numeric_coerce(spark, sf_dir):
    """Infinities are numbers and stay; what is no number counts as 0."""
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", r6(numeric_or_zero(_numeric_text())).alias("duration"))


@query(
    """SELECT event_id, round(CASE WHEN event_id % 5 = 4 THEN least(value * 1e8, 1e9) ELSE 0 END, 6) AS v
    FROM events"""
)
def clip_inf(spark, sf_dir):
    scaled = F.when(F.col("event_id") % 5 == 4, (F.col("value") * 1e8).cast("string"))
    text = F.coalesce(scaled, _numeric_text())
    return table(spark, sf_dir, "events").select("event_id", r6(clipped_finite(text)).alias("v"))


WANTED = ["duration", "orig_bytes", "throughput", "resp_pkts", "jitter"]


@query(
    f"""WITH {CONN} SELECT conn_id, duration, CAST(orig_bytes AS DOUBLE) AS orig_bytes,
      CAST(0 AS DOUBLE) AS throughput, CAST(resp_pkts AS DOUBLE) AS resp_pkts, CAST(0 AS DOUBLE) AS jitter
    FROM conn"""
)
def align_columns(spark, sf_dir):
    return ft.align_columns(conn(spark, sf_dir), WANTED, ["conn_id"])


@query(
    f"""WITH {CONN} SELECT n_rows, missing FROM (SELECT count(*) AS n_rows FROM conn),
      (SELECT unnest(['throughput', 'jitter']) AS missing)"""
)
def missing_columns(spark, sf_dir):
    df = conn(spark, sf_dir)
    wanted = F.array(*[F.lit(c) for c in WANTED])
    present = F.array(*[F.lit(c) for c in df.columns])
    return df.agg(F.count("*").alias("n_rows")).select(
        "n_rows", F.explode(F.array_except(wanted, present)).alias("missing")
    )


SIMPLE = ["duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts"]


@query(
    f"""WITH {CONN} SELECT conn_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in SIMPLE)} FROM conn"""
)
def simple_projection(spark, sf_dir):
    return ft.align_columns(conn(spark, sf_dir), SIMPLE, ["conn_id"])


@query(
    f"""WITH {CONN}, s AS (
      SELECT conn_id, ts, orig_h,
        list([duration, CAST(orig_bytes AS DOUBLE)]) OVER w AS sequence
      FROM conn WINDOW w AS (ORDER BY ts, conn_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
    SELECT conn_id, round(sequence[1][1], 6) AS first_duration, round(sequence[10][2], 6) AS last_bytes,
      round(list_sum([x[2] for x in sequence]), 6) AS sum_bytes
    FROM s WHERE len(sequence) = 10"""
)
def sequences(spark, sf_dir):
    df = conn(spark, sf_dir)
    return _sequence_digest(ft.sliding_sequences(df, SIMPLE[:2], ["ts", "conn_id"], 10, block=2000), 10)


@query(
    f"""WITH {CONN}, s AS (
      SELECT conn_id, ts, orig_h,
        list([duration, CAST(orig_bytes AS DOUBLE)]) OVER w AS sequence
      FROM conn WINDOW w AS
        (PARTITION BY orig_h ORDER BY ts, conn_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT conn_id, round(sequence[1][1], 6) AS first_duration, round(sequence[5][2], 6) AS last_bytes,
      round(list_sum([x[2] for x in sequence]), 6) AS sum_bytes
    FROM s WHERE len(sequence) = 5"""
)
def host_sequences(spark, sf_dir):
    df = conn(spark, sf_dir)
    made = ft.sliding_sequences(df, SIMPLE[:2], ["ts", "conn_id"], 5, host="orig_h", block=2000)
    return _sequence_digest(made, 5)


def _sequence_digest(df, length):
    total = F.aggregate("sequence", F.lit(0.0), lambda acc, row: acc + F.get(row, F.lit(1)))
    return df.select(
        "conn_id",
        r6(F.col("sequence")[0][0]).alias("first_duration"),
        r6(F.col("sequence")[length - 1][1]).alias("last_bytes"),
        r6(total).alias("sum_bytes"),
    )


@query(
    """SELECT event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * (row_number() OVER (ORDER BY event_id) - 1) AS ts
    FROM events"""
)
def sequential_ts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id")
    numbered = ft.with_ordinal(rows, ["event_id"], "row")
    return numbered.select("event_id", lb.sequential_timestamp("row").cast("timestamp_ntz").alias("ts"))
