"""Live detection with Structured Streaming: flows, packet windows, scoring, alerts, drift.

State leaves the store when the watermark passes: a flow is emitted once no packet of it can
arrive within the timeout. Rows later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowmarrow.functions.columns import has_syn, score_band
from flowmarrow.operators import drift as dr
from flowmarrow.operators import ensemble as en
from flowmarrow.operators import explain as ex
from flowmarrow.operators import flows as fl
from flowmarrow.operators.detectors import Detector, LstmAutoencoder
from flowmarrow.operators.ordered import percentile_values, value_table
from flowmarrow.schemas import FLOW_KEY, WINDOW_FEATURES
from flowmarrow.session import keyed_store, scratch_path

WATERMARK = "2 minutes"
TIMEOUT = "60 seconds"


def stream_flows(packets: DataFrame, timeout: str = TIMEOUT, watermark: str = WATERMARK) -> DataFrame:
    """5-tuple flows that end after ``timeout`` without packets (a gap of exactly that length does not)."""
    session = F.session_window("ts", timeout)
    flows = (
        packets.filter(F.col("src_ip").isNotNull())
        .withWatermark("ts", watermark)
        .groupBy(*FLOW_KEY, session.alias("session"))
        .agg(*fl.flow_aggregates())
    )
    return fl.as_connection(flows)


def stream_window_stats(packets: DataFrame, width: str = "5 seconds", watermark: str = WATERMARK) -> DataFrame:
    """Packet statistics per window.

    Two chained aggregations: the first is per window and address, so exact distinct counts need
    no set of addresses and a busy window is spread over its addresses.
    """
    size = F.col("length").cast("double")
    tcp, udp = F.col("proto") == "tcp", F.col("proto") == "udp"
    sides = F.array(
        F.struct(F.lit("src").alias("side"), F.col("src_ip").alias("addr")),
        F.struct(F.lit("dst").alias("side"), F.col("dst_ip").alias("addr")),
    )
    per_address = (
        packets.withWatermark("ts", watermark)
        .withColumn("s", F.explode(sides))
        .groupBy(F.window("ts", width).alias("w"), "s.side", "s.addr")
        .agg(
            F.count("*").alias("n"),
            F.sum(size).alias("bytes"),
            F.sum(size * size).alias("squares"),
            F.max(size).alias("top"),
            F.min(size).alias("low"),
            F.count_if(tcp).alias("tcp"),
            F.count_if(udp).alias("udp"),
            F.count_if(tcp & has_syn("tcp_flags")).alias("syn"),
        )
    )
    src = F.col("side") == "src"
    one_side = lambda c: F.sum(F.when(src, F.col(c)))
    total = per_address.groupBy(F.window("w", width).alias("w2")).agg(
        one_side("n").alias("n"),
        one_side("bytes").alias("bytes"),
        one_side("squares").alias("squares"),
        one_side("tcp").alias("tcp"),
        one_side("udp").alias("udp"),
        one_side("syn").alias("syn"),
        F.count_if(src & F.col("addr").isNotNull()).alias("unique_src"),
        F.count_if(~src & F.col("addr").isNotNull()).alias("unique_dst"),
        F.max("top").alias("max_size"),
        F.min("low").alias("min_size"),
    )
    n = F.col("n")
    mean = F.col("bytes") / n
    cells = {
        "total_packets": n,
        "total_bytes": F.col("bytes"),
        "tcp_ratio": F.col("tcp") / n,
        "udp_ratio": F.col("udp") / n,
        "other_ratio": (n - F.col("tcp") - F.col("udp")) / n,
        "mean_size": mean,
        "std_size": F.sqrt(F.greatest(F.col("squares") / n - mean * mean, F.lit(0.0))),
        "syn_ratio": F.col("syn") / n,
    }
    return total.withColumns(cells).select(F.col("w2.start").alias("window_start"), *WINDOW_FEATURES)


def sentinel(spark: SparkSession, packets: DataFrame, last_ts, lag: str = "1 hour") -> DataFrame:
    """A stream of one row late enough to push every real row past the watermark.

    Its ``length`` is -1, so the aggregates tell it apart. Used when a bounded replay has to close
    all groups; a live stream needs none.
    """
    path = scratch_path(spark, "sentinel")
    late = F.lit(last_ts).cast("timestamp") + F.expr(f"INTERVAL {lag}")
    special = {"ts": late, "length": F.lit(-1)}
    cells = [
        special.get(f.name, F.lit("sentinel") if f.name in ("src_ip", "dst_ip") else F.lit(None))
        .cast(f.dataType)
        .alias(f.name)
        for f in packets.schema.fields
    ]
    spark.range(1).select(*cells).write.parquet(path)
    return spark.readStream.schema(packets.schema).parquet(path)


def run_available(df: DataFrame, label: str, keyed: bool = False) -> DataFrame:
    """Process everything that is available into a parquet table and read it back.

    A stream with keyed state (``keyed``) starts with the state store it needs, also in a session that was set up elsewhere.
    """
    spark = df.sparkSession
    out = scratch_path(spark, label)
    writer = (
        df.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, f"{label}-state"))
        .outputMode("append")
        .trigger(availableNow=True)
    )
    with keyed_store(spark) if keyed else nullcontext():
        query = writer.start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def each_batch(
    df: DataFrame,
    out: str,
    make: Callable[[DataFrame, int], DataFrame | None],
    checkpoint: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Run ``make`` on every micro-batch; its result replaces the folder of that batch.

    Writing one folder per batch keeps a repeated batch from appearing twice.
    """
    spark = df.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            rows = make(batch, batch_id)
            if rows is not None:
                rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    writer = df.writeStream.foreachBatch(handle).option(
        "checkpointLocation", checkpoint or scratch_path(spark, "batches")
    )
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def read_batches(spark: SparkSession, out: str, before: int | None = None) -> DataFrame | None:
    """What earlier batches wrote, or None when there is nothing yet."""
    try:
        rows = spark.read.option("basePath", out).parquet(out)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return rows if before is None else rows.filter(F.col("batch_id") < before)


def last_window(flows: DataFrame, detector: LstmAutoencoder, order: list[str]) -> DataFrame:
    """The newest rows of a flush as one window, scored; empty when there are too few."""
    steps = detector.sequence_length
    newest = flows.orderBy(*[F.desc(c) for c in order]).limit(steps)
    cells = F.array(*[F.col(c).cast("double") for c in detector.columns])
    packed = newest.agg(F.array_sort(F.collect_list(F.struct(*order, cells.alias("_cells")))).alias("s"))
    window = packed.select(F.transform("s", lambda r: r["_cells"]).alias("sequence"))
    return detector.score(window.filter(F.size("sequence") == steps))


def alert_closed_flows(
    flows: DataFrame,
    detectors: dict[str, Detector],
    out: str,
    level: str = "mid",
    primary: str = "AE",
    lstm: LstmAutoencoder | None = None,
    min_score: float | None = None,
    **trigger,
) -> StreamingQuery:
    """Score the flows each batch closed, vote, and append the alert lines.

    The threshold of the primary model is raised by the sensitivity factor; every vote needs the
    minimum score of the level, or ``min_score`` when given. The optional LSTM contributes one score per batch.
    """
    factor, floor = en.SENSITIVITY[level]
    floor = floor if min_score is None else min_score

    def make(batch: DataFrame, batch_id: int) -> DataFrame:
        rows = fl.flow_features(batch)
        models, shown = {}, {}
        for name, d in detectors.items():
            limit = d.threshold * factor if name == primary else None
            rows = d.predict(rows, limit, f"score_{name}", f"pred_{name}")
            models[name], shown[name] = (f"pred_{name}", f"score_{name}"), f"score_{name}"
        if lstm is not None:
            value = last_window(rows, lstm, ["ts_end", "orig_h", "orig_p"]).select("score").scalar()
            rows = rows.withColumn("score_LSTM", value)
            rows = rows.withColumn("pred_LSTM", (F.col("score_LSTM") > lstm.threshold * factor).cast("int"))
            models["LSTM"], shown["LSTM"] = ("pred_LSTM", "score_LSTM"), "score_LSTM"
        fired = en.live_vote(rows, models, floor).filter("alert = 1")
        return fired.select("ts_end", "votes", ex.alert_line(shown).alias("line"))

    return each_batch(flows, out, make, **trigger)


def score_batches(rows: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, **trigger) -> StreamingQuery:
    """Mean score and band of every micro-batch of feature rows."""

    def make(batch: DataFrame, batch_id: int) -> DataFrame:
        mean = score(batch).agg(F.count("*").alias("rows"), F.avg("score").alias("mean_score"))
        return mean.filter("rows > 0").withColumn("band", score_band("mean_score"))

    return each_batch(rows, out, make, **trigger)


#: Value ranges of the drift state, by quantiles of the baseline; a multiple of the ten bins of the stability index.
DRIFT_RANGES = 80


def range_of(value: str, edges: list[float]) -> Column:
    """The range of a value between the edges: -1 below the first, their number less one above the last, null for null."""
    v, last = F.col(value), len(edges) - 1
    passed = F.lit(0)
    for e in edges[1:-1]:
        passed = passed + (v >= e).cast("int")
    return F.when(v < edges[0], -1).when(v > edges[-1], last).when(v.isNotNull(), F.least(passed, F.lit(last - 1)))


def range_counts(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(range, n): counts that can be added up over batches."""
    counts = rows.groupBy(range_of(value, edges).alias("range")).agg(F.count("*").alias("n"))
    return counts.filter("range IS NOT NULL")


def drift_of_counts(base: dict[int, int], counts: DataFrame, ranges: int) -> DataFrame:
    """KS distance at the edges of the ranges and PSI over ten bins, from the counts of both samples, as two rows.

    The distance between two edges is not seen, which is at most the share of one range.
    """
    known = F.create_map(*[F.lit(x) for k in range(-1, ranges + 1) for x in (k, base.get(k, 0))])
    all_ranges = counts.sparkSession.range(-1, ranges + 1).select(F.col("id").cast("int").alias("range"))
    both = all_ranges.join(counts.groupBy("range").agg(F.sum("n").alias("c")), "range", "left").select(
        "range", known[F.col("range")].alias("b"), F.coalesce("c", F.lit(0)).alias("c")
    )
    upto, overall = Window.partitionBy(F.lit(1)).orderBy("range"), Window.partitionBy(F.lit(1))  # as many rows as ranges
    share = lambda c: F.try_divide(F.sum(c).over(upto).cast("double"), F.sum(c).over(overall))
    placed = both.withColumn("gap", F.abs(share("b") - share("c"))).withColumns({f"all_{c}": F.sum(c).over(overall) for c in "bc"})
    ks = placed.filter(F.col("range") < ranges).agg(
        F.max("gap").alias("statistic"), dr.ks_p_value(F.max("gap"), F.max("all_b"), F.max("all_c")).alias("p")
    )
    bins = placed.filter(F.col("range").between(0, ranges - 1)).groupBy(F.floor(F.col("range") / (ranges // 10)).alias("bin"))
    shares = bins.agg(*[dr.safe_share(F.sum(c), F.max(f"all_{c}")).alias(c) for c in "bc"])
    psi = shares.agg(F.sum((F.col("c") - F.col("b")) * F.ln(F.col("c") / F.col("b"))).alias("statistic"))
    return ks.select(F.lit("KS-test").alias("method"), "statistic", (F.col("p") < 0.05).alias("drift_detected")).unionByName(
        psi.select(F.lit("PSI").alias("method"), "statistic", (F.col("statistic") > 0.2).alias("drift_detected"))
    )


def drift_batches(
    rows: DataFrame, baseline: DataFrame, value: str, out: str, ranges: int = DRIFT_RANGES, **trigger
) -> StreamingQuery:
    """Drift of all rows so far against the baseline, checked after every micro-batch and appended to a history.

    The baseline becomes edges and counts per range. A batch adds its counts, a row per range, to those of earlier batches in
    ``<out>-counts``; no batch is read again. A repeated batch replaces its own counts.
    """
    spark = rows.sparkSession
    table = value_table(baseline.select(value), value, {"n": F.lit(1)})
    edges = percentile_values(table, value, [i / ranges for i in range(ranges + 1)], weight="n")
    if not edges:
        raise ValueError("the baseline has no values")
    at = table.select(range_of(value, edges).alias("range"), "n").groupBy("range").agg(F.sum("n").alias("n"))
    base = {r["range"]: r["n"] for r in at.collect()}  # one row per range

    def make(batch: DataFrame, batch_id: int) -> DataFrame | None:
        if batch.isEmpty():
            return None
        range_counts(batch, value, edges).write.mode("overwrite").parquet(f"{out}-counts/batch_id={batch_id}")
        so_far = read_batches(spark, f"{out}-counts", batch_id + 1)
        return drift_of_counts(base, so_far, ranges).withColumn("checked_at", F.lit(batch_id))

    return each_batch(rows, out, make, **trigger)


def tail_csv(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """New CSV files of a folder as a stream; finished files are tracked by the checkpoint (``tail`` follows growing files)."""
    reader = spark.readStream.schema(schema).option("header", True)
    return reader.option("maxFilesPerTrigger", files_per_trigger).csv(path)
