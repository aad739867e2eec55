"""Streaming queries: the given events replayed as a file stream, compared with the batch result."""

import pyarrow as pa
from pyspark.sql import functions as F

from flowmarrow.plans import alert_queries, flow_queries
from flowmarrow.plans.registry import SQL_CHECKS, query
from flowmarrow.plans.tables import CONN, conn, conn_of, packets_of, r6, table
from flowmarrow.schemas import WINDOW_FEATURES
from flowmarrow.session import frozen, scratch_path
from flowmarrow.streaming import keyed, live, tail


def event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def packet_stream(spark, sf_dir):
    """Packets with a zoned timestamp (a watermark needs one), closed by a sentinel row."""
    packets = packets_of(conn_of(event_stream(spark, sf_dir))).withColumn("ts", F.col("ts").cast("timestamp"))
    last = table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp").alias("t")).first()["t"]
    return packets.unionByName(live.sentinel(spark, packets, last))


@query(SQL_CHECKS["flow_sessions_60s"])
def stream_flows(spark, sf_dir):
    flows = live.stream_flows(packet_stream(spark, sf_dir)).filter("orig_bytes >= 0")
    done = live.run_available(flows, "flows")
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts_start", "ts_end")})


#: A score of a window between 0 and 1: many packets, large ones, many connection requests.
WINDOW_SCORE = "least(1.0, 0.2 * ln(1 + {n}) + 0.3 * {top} / 1000.0 + 0.5 * {syn})"


def window_score(rows):
    cells = WINDOW_SCORE.format(n="total_packets", top="max_size", syn="syn_ratio")
    return rows.withColumn("score", F.expr(cells).cast("double"))


@query(
    f"""WITH w AS ({SQL_CHECKS["packet_window_stats_5s"]}), s AS (SELECT *,
      {WINDOW_SCORE.format(n='CAST(total_packets AS DOUBLE)', top='max_size', syn='syn_ratio')} AS raw FROM w)
    SELECT * EXCLUDE (raw), round(raw, 6) AS score,
      CASE WHEN raw < 0.3 THEN 'normal' WHEN raw < 0.7 THEN 'suspicious' ELSE 'anomalous' END AS band FROM s"""
)
def stream_windows(spark, sf_dir):
    """Every packet window with its statistics, its score and its band, in one stream."""
    stats = live.stream_window_stats(packet_stream(spark, sf_dir)).filter("total_bytes >= 0")
    done = live.run_available(keyed.scored_windows(stats, window_score), "windows")
    cells = [flow_queries._cell(c) for c in WINDOW_FEATURES]
    return done.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), *cells, r6("score").alias("score"), "band")


@query(
    f"""WITH {CONN}, m AS (SELECT count(*) AS rows, avg(least(orig_bytes / 20000.0, 1.0)) AS s FROM conn)
    SELECT rows, round(s, 6) AS mean_score,
      CASE WHEN s < 0.3 THEN 'normal' WHEN s < 0.7 THEN 'suspicious' ELSE 'anomalous' END AS band FROM m"""
)
def stream_file_score(spark, sf_dir):
    out = scratch_path(spark, "file-scores")
    score = lambda df: df.withColumn("score", F.least(F.col("orig_bytes") / 20000.0, F.lit(1.0)))
    live.score_batches(conn_of(event_stream(spark, sf_dir)), score, out, availableNow=True).awaitTermination()
    return live.read_batches(spark, out).select("rows", r6("mean_score").alias("mean_score"), "band")


DRIFT_SQL = f"""WITH {CONN}, base AS (SELECT duration AS v FROM conn WHERE label = 'normal'),
  span AS (SELECT min(ts) AS a, max(ts) AS b FROM conn),
  cur AS (SELECT duration * 1.02 AS v, least(CAST(floor(4 * (epoch_us(ts) - epoch_us(a)) / CAST(epoch_us(b) - epoch_us(a) AS DOUBLE)) AS BIGINT), 3) AS part
    FROM conn, span),
  ed AS (SELECT quantile_cont(v, [i / {live.DRIFT_RANGES}.0 FOR i IN range({live.DRIFT_RANGES + 1})]) AS e FROM base),
  bx AS (SELECT CASE WHEN v < e[1] THEN -1 WHEN v > e[-1] THEN {live.DRIFT_RANGES}
      ELSE len(list_filter(e[2:-2], lambda x: x <= v)) END AS k, NULL AS part FROM base, ed
    UNION ALL SELECT CASE WHEN v < e[1] THEN -1 WHEN v > e[-1] THEN {live.DRIFT_RANGES}
      ELSE len(list_filter(e[2:-2], lambda x: x <= v)) END, part FROM cur, ed),
  parts AS (SELECT DISTINCT part FROM cur),
  cnt AS (SELECT p.part, k, count(*) FILTER (bx.part IS NULL) AS nb, count(*) FILTER (bx.part <= p.part) AS nc FROM parts p, bx GROUP BY p.part, k),
  cum AS (SELECT part, k, abs(sum(nb) OVER w / CAST(sum(nb) OVER t AS DOUBLE) - sum(nc) OVER w / CAST(sum(nc) OVER t AS DOUBLE)) AS gap,
      sum(nb) OVER t AS tb, sum(nc) OVER t AS tc FROM cnt WINDOW w AS (PARTITION BY part ORDER BY k), t AS (PARTITION BY part)),
  ks AS (SELECT part, max(gap) FILTER (k < {live.DRIFT_RANGES}) AS d, any_value(CAST(tb AS DOUBLE)) AS n, any_value(CAST(tc AS DOUBLE)) AS m FROM cum GROUP BY part),
  dec AS (SELECT part, k // {live.DRIFT_RANGES // 10} AS bin, sum(nb) AS nb, sum(nc) AS nc FROM cnt WHERE k BETWEEN 0 AND {live.DRIFT_RANGES - 1} GROUP BY 1, 2),
  sh AS (SELECT dec.part, CASE WHEN nb = 0 THEN 0.0001 ELSE nb / n END AS b, CASE WHEN nc = 0 THEN 0.0001 ELSE nc / m END AS c FROM dec JOIN ks USING (part)),
  psi AS (SELECT part, sum((c - b) * ln(c / b)) AS x FROM sh GROUP BY part),
  both_ AS (SELECT part, 'KS-test' AS method, d AS statistic, d * sqrt(n * m / (n + m)) > 1.3581015157406195 AS drift_detected FROM ks
    UNION ALL SELECT part, 'PSI', x, x > 0.2 FROM psi)
SELECT part AS batch, method, round(statistic, 6) AS statistic, drift_detected FROM both_"""


@query(DRIFT_SQL)
def stream_drift(spark, sf_dir):
    """The connections in four files: every batch adds to the counts, and the history gets a check of all that came so far."""
    out, feed = scratch_path(spark, "drift"), scratch_path(spark, "durations")
    df = conn(spark, sf_dir)
    rows = df.select((F.col("duration") * 1.02).alias("duration"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    ends = rows.agg(F.min("us").alias("a"), F.max("us").alias("b")).first()
    part = F.least(F.floor(4 * (F.col("us") - ends["a"]) / F.lit(float(ends["b"] - ends["a"]))), F.lit(3))
    rows = frozen(rows.select("duration", part.alias("part")), "durations")
    for k in range(4):
        rows.filter(F.col("part") == k).select("duration").coalesce(1).write.mode("append").parquet(feed)
    stream = spark.readStream.schema("duration double").option("maxFilesPerTrigger", 1).parquet(feed)
    live.drift_batches(stream, df.filter("label = 'normal'").select("duration"), "duration", out, availableNow=True).awaitTermination()
    return live.read_batches(spark, out).select(
        F.col("batch_id").cast("long").alias("batch"), "method", r6("statistic").alias("statistic"), "drift_detected"
    )


@query(
    f"""WITH {alert_queries.EXPLAINED}, al AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, conn_id) AS nr,
        count(*) OVER (PARTITION BY date_trunc('hour', ts)) AS n FROM pr WHERE priority_score >= 30),
      late AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY priority_score DESC, conn_id) AS rk FROM al WHERE nr > 3)
    SELECT conn_id, priority_score, CAST(0 AS BIGINT) AS suppressed FROM al WHERE nr <= 3
    UNION ALL SELECT conn_id, priority_score, greatest(n - 5, 0) AS suppressed FROM late WHERE rk <= 2"""
)
def stream_rate_limit(spark, sf_dir):
    """All alerts in four batches, cut inside an hour: three of an hour pass at once, two more when it is over."""
    rows = alert_queries.explained(spark, sf_dir).select("conn_id", F.col("ts").cast("timestamp").alias("ts"), "priority_score")
    rows = frozen(rows, "alerts")
    ends = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    feed, step = scratch_path(spark, "alerts"), (ends["b"] - ends["a"]) / 4
    for k in range(4):
        start = ends["a"] + k * step
        part = rows.filter(F.col("ts") >= start) if k else rows
        part = part.filter(F.col("ts") < start + step) if k < 3 else part
        part.coalesce(1).write.mode("append").parquet(feed)
    # nothing follows the last hour, so a row without an id ends it
    late = rows.sparkSession.range(1).select(
        F.lit(None).cast("long").alias("conn_id"), (F.lit(ends["b"]) + F.expr("INTERVAL 2 HOURS")).alias("ts"), F.lit(0).alias("priority_score")
    )
    late.select([F.col(f.name).cast(f.dataType) for f in rows.schema.fields]).write.mode("append").parquet(feed)
    alerts = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    limited = keyed.limited_alerts(alerts, min_priority=30, max_per_hour=3, keep=2)
    return live.run_available(limited, "accepted", keyed=True).select("conn_id", "priority_score", "suppressed")


@query(f"WITH {CONN} SELECT conn_id, orig_h, duration, orig_bytes FROM conn")
def stream_growing_csv(spark, sf_dir):
    """All connections appended to four CSV files in three rounds; the stream is restarted after every round."""
    base = conn(spark, sf_dir).select("conn_id", "orig_h", "duration", "orig_bytes")
    folder, out, state = (scratch_path(spark, x) for x in ("growing", "tailed", "tailed-state"))
    schema = base.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    lines = base.withColumns({"part": F.pmod(F.xxhash64("conn_id"), F.lit(4)).cast("int"), "round": F.pmod(F.hash("conn_id"), F.lit(3))})
    lines = lines.select("part", "round", F.to_csv(F.struct(*base.columns)).alias("line"))
    for k in range(3):
        lines.filter(F.col("round") == k).groupBy("part").applyInArrow(append_lines(folder), "bytes long").count()
        rows = tail.tail_growing_csv(spark, folder, schema, header=False, range_bytes=1 << 16)
        done = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        done.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(out)


def append_lines(folder: str):
    """A function that appends the lines of a part to its file."""

    def run(lines):
        fs, at = tail.place(folder)
        fs.create_dir(at, recursive=True)
        data = "".join(f"{x}\n" for x in lines.column("line").to_pylist()).encode()
        with fs.open_append_stream(f"{at}/{lines.column('part')[0].as_py()}.csv") as out:
            out.write(data)
        return pa.table({"bytes": [len(data)]})

    return run


@query()
def stream_flow_alerts(spark, sf_dir):
    """Flows closed by the stream, scored by a forest fitted on batch flows, as alert lines."""
    from flowmarrow.operators.detectors import IsolationForest
    from flowmarrow.operators.flows import assemble_flows, flow_features
    from flowmarrow.plans.tables import packets

    columns = ["duration", "orig_bytes", "orig_pkts"]
    batch = flow_features(assemble_flows(packets(spark, sf_dir), 60.0))
    forest = IsolationForest(n_estimators=25, contamination=0.02).fit(
        batch.withColumn("flow_id", F.xxhash64("orig_h", "orig_p", "resp_h", "resp_p", "proto", "ts_start")),
        columns,
        "flow_id",
    )
    out = scratch_path(spark, "flow-alerts")
    flows = live.stream_flows(packet_stream(spark, sf_dir)).filter("orig_bytes >= 0")
    live.alert_closed_flows(flows, {"IF": forest}, out, min_score=0.0, availableNow=True).awaitTermination()
    return live.read_batches(spark, out).select("line", "votes")
