import datetime as dt
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmarrow.operators.detectors import IsolationForest, LstmAutoencoder
from flowmarrow.operators.flows import assemble_flows, flow_features, packet_window_stats
from flowmarrow.schemas import PACKET_SCHEMA, WINDOW_FEATURES
from flowmarrow.session import scratch_path
from flowmarrow.streaming import keyed, live, tail

T0 = dt.datetime(2024, 1, 1)


def packet_rows(n=400):
    hosts = ["a", "b", "c", "d"]
    rows = []
    for i in range(n):
        t = T0 + dt.timedelta(seconds=i * 7 + (i // 40) * 90)
        rows.append((t, hosts[i % 4], i % 2, "z", 80, "tcp" if i % 3 else "udp", 40 + i % 9, i % 32, True))
    return rows


@pytest.fixture(scope="module")
def packets(spark):
    return spark.createDataFrame(packet_rows(), PACKET_SCHEMA)


def replay(spark, packets):
    path = scratch_path(spark, "packets")
    packets.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(PACKET_SCHEMA).parquet(path)
    last = packets.agg(F.max("ts").alias("t")).first()["t"]
    return stream.unionByName(live.sentinel(spark, stream, last))


def test_flows_equal_the_batch_result(spark, packets):
    flows = live.run_available(live.stream_flows(replay(spark, packets)).filter("orig_bytes >= 0"), "flows")
    batch = assemble_flows(packets, 60.0)
    assert flows.count() == batch.count() and flows.exceptAll(batch.select(flows.columns)).count() == 0


def test_open_flows_wait_for_the_watermark(spark, packets):
    path = scratch_path(spark, "packets")
    packets.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(PACKET_SCHEMA).parquet(path)
    flows = live.run_available(live.stream_flows(stream), "open-flows")
    assert 0 < flows.count() < assemble_flows(packets, 60.0).count()


def test_windows_equal_the_batch_result(spark, packets):
    stats = live.run_available(live.stream_window_stats(replay(spark, packets)).filter("total_bytes >= 0"), "windows")
    batch = packet_window_stats(packets)
    digest = lambda df: sorted(tuple(round(float(r[c]), 9) for c in WINDOW_FEATURES) for r in df.collect())
    assert digest(stats) == digest(batch)


def test_alert_lines(spark, packets):
    columns = ["duration", "orig_bytes", "orig_pkts"]
    batch = flow_features(assemble_flows(packets, 60.0)).withColumn("flow_id", F.monotonically_increasing_id())
    forest = IsolationForest(n_estimators=10).fit(batch, columns, "flow_id")
    lstm = LstmAutoencoder(sequence_length=3, units=(4,), latent_dim=2, epochs=1)
    lstm.fit_windows(batch, columns, ["flow_id"])
    out = scratch_path(spark, "lines")
    flows = live.stream_flows(replay(spark, packets)).filter("orig_bytes >= 0")
    live.alert_closed_flows(
        flows, {"IF": forest}, out, lstm=lstm, min_score=-9.0, primary="IF", availableNow=True
    ).awaitTermination()
    lines = [r["line"] for r in live.read_batches(spark, out).collect()]
    assert all(line.startswith("ANOMALY | ") and "IF=" in line and "LSTM=" in line for line in lines)


def test_csv_tail(spark):
    feed, out = scratch_path(spark, "feed"), scratch_path(spark, "scores")
    spark.range(30).select(F.col("id").cast("double").alias("x")).repartition(3).write.option("header", True).csv(feed)
    rows = live.tail_csv(spark, feed, "x double")
    live.score_batches(rows, lambda df: df.withColumn("score", F.col("x") / 100), out, availableNow=True).awaitTermination()
    done = live.read_batches(spark, out)
    assert done.count() == 3 and done.agg(F.sum("rows")).first()[0] == 30
    assert {r["band"] for r in done.collect()} == {"normal"}


def test_drift_history(spark):
    feed, out = scratch_path(spark, "errors"), scratch_path(spark, "history")
    base = spark.range(500).select((F.col("id") % 100).cast("double").alias("v"))
    base.select((F.col("v") + 60).alias("v")).coalesce(1).write.parquet(feed)
    rows = spark.readStream.schema("v double").parquet(feed)
    live.drift_batches(rows, base, "v", out, availableNow=True).awaitTermination()
    found = {r["method"]: r["drift_detected"] for r in live.read_batches(spark, out).collect()}
    assert found == {"KS-test": True, "PSI": True}
    assert live.read_batches(spark, scratch_path(spark, "nothing")) is None


ALERT = "conn_id long, ts timestamp, priority_score int, note string"


def alert_rows(seed, n, hours):
    rng = np.random.default_rng(seed)
    seconds = np.sort(rng.integers(0, hours * 3600, n))
    return [(i, T0 + dt.timedelta(seconds=int(s)), int(rng.integers(30, 100)), f"n{i % 7}") for i, s in enumerate(seconds)]


def limited(rows, min_priority, max_per_hour, keep):
    """Plain version: the first alerts of every hour, then its most urgent others."""
    out, hours = [], {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        if r[2] >= min_priority:
            hours.setdefault(r[1].replace(minute=0, second=0, microsecond=0), []).append(r)
    for mine in hours.values():
        out += [(*r, 0) for r in mine[:max_per_hour]]
        late = sorted(mine[max_per_hour:], key=lambda r: (-r[2], r[0]))
        out += [(*r, len(late) - len(late[:keep])) for r in late[:keep]]
    return sorted(out)


def fed(spark, schema, batches, files=1):
    """A folder that is read batch by batch."""
    feed = scratch_path(spark, "feed")
    for rows in batches:
        spark.createDataFrame(rows, schema).repartition(files).write.mode("append").parquet(feed)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(feed)


END = (None, T0 + dt.timedelta(days=9), 0, None)


@pytest.mark.parametrize("batches", [1, 5])
def test_rate_limit_over_batches(spark, batches):
    """The limit counts over batches that begin and end inside an hour."""
    rows = alert_rows(1, 400, 6)
    cut = [rows[k * len(rows) // batches : (k + 1) * len(rows) // batches] for k in range(batches)]
    alerts = fed(spark, ALERT, [*cut, [END]])
    done = live.run_available(keyed.limited_alerts(alerts, min_priority=40, max_per_hour=20, keep=5), "limited")
    assert sorted(map(tuple, done.collect())) == limited(rows, 40, 20, 5)


def test_keyed_streams_run_in_a_session_with_another_state_store(spark):
    from flowmarrow.session import STORE

    was, other = spark.conf.get(STORE), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    rows = [(k, T0 + dt.timedelta(minutes=k), 50 + k, None) for k in range(6)]
    spark.conf.set(STORE, other)
    try:
        alerts = fed(spark, ALERT, [rows, [END]])
        done = live.run_available(keyed.limited_alerts(alerts, min_priority=0, max_per_hour=3, keep=2), "other-store", keyed=True)
        assert sorted((r["conn_id"], r["suppressed"]) for r in done.collect()) == [(0, 0), (1, 0), (2, 0), (4, 1), (5, 1)]
        assert spark.conf.get(STORE) == other
    finally:
        spark.conf.set(STORE, was)


def test_rate_limit_combines_inside_tasks(spark):
    """A busy hour in several tasks with many alerts each, and the number of those that no task sent on."""
    rows = alert_rows(2, 3000, 1)
    done = live.run_available(keyed.limited_alerts(fed(spark, ALERT, [rows, [END]], files=3), min_priority=0, max_per_hour=10, keep=4), "busy")
    assert sorted(map(tuple, done.collect())) == limited(rows, 0, 10, 4)
    assert {r.suppressed for r in done.collect()} == {0, 2986}


def test_rate_limit_after_a_restart(spark):
    rows, feed, out, state = alert_rows(3, 200, 3), *(scratch_path(spark, x) for x in ("feed", "out", "state"))
    for part in (rows[:90], rows[90:150], rows[150:], [END]):
        spark.createDataFrame(part, ALERT).coalesce(1).write.mode("append").parquet(feed)
        limit = keyed.limited_alerts(spark.readStream.schema(ALERT).parquet(feed), min_priority=0, max_per_hour=15, keep=3)
        query = limit.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        query.trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == limited(rows, 0, 15, 3)


def until(query, out, spark, n, seconds=90):
    """Wait for ``n`` rows of a running query, with no new input; then stop it."""
    try:
        for _ in range(seconds):
            time.sleep(1)
            if query.exception():
                raise query.exception()
            if Path(out).exists() and list(Path(out).glob("*.parquet")) and spark.read.schema(query_schema[out]).parquet(out).count() >= n:
                break
    finally:
        query.stop()
    return spark.read.schema(query_schema[out]).parquet(out)


query_schema = {}


def started(df, label):
    out = scratch_path(df.sparkSession, label).removeprefix("file:")
    query_schema[out] = df.schema
    writer = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state")
    return writer.trigger(processingTime="1 second").start(), out


def test_a_silent_stream_closes_its_flows(spark, packets):
    """No sentinel, no watermark: the last packets are old when they come, and nothing follows them."""
    rows = [tuple(r) for r in packets.collect()]
    stream = fed(spark, PACKET_SCHEMA, [rows[:250], rows[250:]])
    batch = assemble_flows(packets, 60.0)
    done = until(*started(keyed.live_flows(stream, 60.0, idle=4.0), "live-flows"), spark, batch.count())
    assert done.count() == batch.count() and done.exceptAll(batch.select(done.columns)).count() == 0


def test_a_silent_stream_closes_its_last_window_with_score_and_band(spark, packets):
    rows = [tuple(r) for r in packets.limit(60).collect()]
    batch = packet_window_stats(spark.createDataFrame(rows, PACKET_SCHEMA), "60 seconds")
    score = lambda df: df.withColumn("score", F.col("total_packets") / 10)
    windows = keyed.scored_windows(keyed.live_windows(fed(spark, PACKET_SCHEMA, [rows[:31], rows[31:]]), 60.0, idle=4.0), score)
    done = until(*started(windows, "live-windows"), spark, batch.count())
    digest = lambda df: sorted((r["window_start"], *(round(float(r[c]), 9) for c in WINDOW_FEATURES)) for r in df.collect())
    assert digest(done) == digest(batch)
    bands = {(r.total_packets, r.band) for r in done.collect()}
    assert all(band == ("normal" if n < 3 else "suspicious" if n < 7 else "anomalous") for n, band in bands) and len(bands) > 1


def test_a_detector_scores_the_windows_of_a_stream(spark, packets):
    batch = packet_window_stats(packets).withColumn("nr", F.monotonically_increasing_id())
    forest = IsolationForest(n_estimators=10).fit(batch, ["total_packets", "mean_size", "syn_ratio"], "nr")
    stats = live.stream_window_stats(replay(spark, packets)).filter("total_bytes >= 0")
    done = live.run_available(keyed.scored_windows(stats, forest.score), "scored")
    expected = forest.score(batch).select("window_start", F.round("score", 9))
    assert sorted(map(tuple, done.select("window_start", F.round("score", 9)).collect())) == sorted(map(tuple, expected.collect()))
    assert {r.band for r in done.collect()} <= {"normal", "suspicious", "anomalous"}


def test_a_file_that_grows(spark, tmp_path):
    feed, out, state = tmp_path / "feed", scratch_path(spark, "out"), scratch_path(spark, "state")
    feed.mkdir()
    log = feed / "a.csv"

    def run():
        rows = tail.tail_growing_csv(spark, str(feed), "i int, text string", range_bytes=64)
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        query.trigger(availableNow=True).start().awaitTermination()
        return sorted((r.i, r.text) for r in spark.read.schema("i int, text string").parquet(out).collect())

    lines = [(i, "x" + "é" * (i % 50)) for i in range(100)]
    text = "i,text\n" + "".join(f"{i},{t}\n" for i, t in lines)
    data = text.encode()
    for stop in (3, 700, 701, 2000, len(data) - 1, len(data), len(data)):
        have = log.stat().st_size if log.exists() else 0
        with log.open("ab") as f:
            f.write(data[have:stop])
        whole = data[:stop].count(b"\n") - 1
        assert run() == lines[: max(0, whole)]
    (feed / "b.csv").write_text("i,text\n1000,late\n")
    assert run() == [*lines, (1000, "late")]


def test_a_file_that_becomes_shorter_is_an_error(tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n2\n")
    reader = tail.GrowingReader(str(tmp_path), True, 100)
    taken = reader.latestOffset()
    (tmp_path / "a.csv").write_text("x\n")
    with pytest.raises(ValueError, match="shorter"):
        reader.partitions(taken, reader.latestOffset())
