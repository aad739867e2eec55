"""Keyed state for live streams: hourly alert limits, flows and packet windows that close when nothing comes any more.

Rows are combined inside the tasks before they are shuffled to their key, so a busy hour, flow or window sends a few rows per
task and batch to the one task that holds its state. State is small per key, lives in the state store, and leaves it by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from flowmarrow.functions.columns import score_band
from flowmarrow.operators.flows import as_connection
from flowmarrow.schemas import FLOW_KEY, WINDOW_FEATURES

HOUR = 3600


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_all().to_pandas()


class HourLimit(StatefulProcessor):
    """Of every hour the first alerts pass as they come; of all others the most urgent ones pass when the hour is over."""

    def __init__(self, columns: list[str], ts: str, row_id: str, max_per_hour: int, keep: int):
        self.columns, self.ts, self.row_id = columns, ts, row_id
        self.max_per_hour, self.keep = max_per_hour, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("hour", "passed long, others long, held binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows), ignore_index=True)
        got.columns = [*self.columns, "limit_hour", "limit_dropped"]  # Spark renames some
        before = self.state.get()
        if before is None:
            self.handle.registerTimer((int(key[0]) + 1) * HOUR * 1000)
        passed, others, held = before or (0, 0, None)
        alerts = got[got["limit_dropped"] == 0].sort_values([self.ts, self.row_id])[self.columns]
        others += int(got["limit_dropped"].clip(lower=0).sum())
        room = max(0, self.max_per_hour - passed)
        now, late = alerts.iloc[:room], alerts.iloc[room:]
        waiting = late if held is None else pd.concat([_unpacked(held), late])
        waiting = most_urgent(waiting, self.row_id, self.keep)
        held = _packed(waiting) if len(waiting) else None
        self.state.update((passed + len(now), others + len(late), held))
        yield now.assign(suppressed=0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, others, held = self.state.get()
        self.state.clear()
        if held is not None:
            rows = _unpacked(held)
            yield rows.assign(suppressed=others - len(rows))

    def close(self) -> None:
        pass


def most_urgent(rows: pd.DataFrame, row_id: str, n: int) -> pd.DataFrame:
    return rows.sort_values(["priority_score", row_id], ascending=[False, True]).iloc[:n]


def limited_alerts(
    alerts: DataFrame,
    ts: str = "ts",
    min_priority: int = 50,
    max_per_hour: int = 100,
    keep: int = 10,
    row_id: str = "conn_id",
    watermark: str = "0 seconds",
) -> DataFrame:
    """Alerts of enough priority, at most ``max_per_hour`` of a clock hour at once and its top ``keep`` others at its end.

    The limit counts over all batches of the stream, whatever a batch holds. Inside a batch alerts count by time and id.
    ``suppressed`` is 0 for those that pass at once, else the number of alerts of the hour that go. An hour ends
    when the watermark passes it; alerts later than that are dropped. Rows without an id are no alerts and only move the time.
    """
    enough = alerts.filter((F.col("priority_score") >= min_priority) | F.col(row_id).isNull())
    enough = enough.withColumn(ts, F.col(ts).cast("timestamp"))
    columns = enough.columns
    timed = enough.withColumn("limit_hour", F.floor(F.unix_timestamp(ts) / HOUR))

    def combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The alerts of a task that may pass, and one row per hour for the number and the last time of the others."""
        kept: dict[int, tuple] = {}
        for b in batches:
            b["limit_dropped"] = (-b[row_id].isna().astype("int64")).astype("int64")
            for hour, rows in b.groupby("limit_hour"):
                first, urgent, dropped, last = kept.get(hour, (None, None, 0, None))
                rows = rows if first is None else pd.concat([first, rows])
                rows = rows.sort_values([ts, row_id])
                late = rows.iloc[max_per_hour:]
                late = late if urgent is None else pd.concat([urgent, late])
                urgent = most_urgent(late, row_id, keep)
                gone = late.drop(urgent.index) if late.index.is_unique else late[~late[row_id].isin(urgent[row_id])]
                last = max([t for t in (last, gone[ts].max()) if t is not None and not pd.isna(t)], default=None)
                kept[hour] = rows.iloc[:max_per_hour], urgent, dropped + len(gone), last
        for first, urgent, dropped, last in kept.values():
            rows = pd.concat([first, urgent])
            if dropped:
                marker = rows.iloc[:1].assign(limit_dropped=dropped)
                marker[ts] = last
                rows = pd.concat([rows, marker])
            yield rows

    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in timed.schema.fields)
    near = timed.mapInPandas(combined, f"{spec}, limit_dropped long").withWatermark(ts, watermark)
    limit = HourLimit(columns, ts, row_id, max_per_hour, keep)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in enough.schema.fields)
    return near.groupBy("limit_hour").transformWithStateInPandas(limit, f"{out}, suppressed long", "Append", "EventTime")


PIECE = "first_us long, last_us long, bytes long, packets long"


class IdleFlows(StatefulProcessor):
    """The open flow of every 5-tuple; it closes with a gap in the packets' times, or when nothing came for a while."""

    def __init__(self, gap_us: int, idle_ms: int):
        self.gap_us, self.idle_ms = gap_us, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("flow", f"{PIECE}, timer long")

    def _rows(self, key, flows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(flows, columns=["first_us", "last_us", "bytes", "packets"])
        for c, value in zip(reversed(FLOW_KEY), reversed(key)):
            out.insert(0, c, value)
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pieces = pd.concat(list(rows), ignore_index=True)
        pieces = [tuple(int(v) for v in r) for r in pieces[["first_us", "last_us", "bytes", "packets"]].itertuples(index=False)]
        before = self.state.get()
        if before is not None:
            pieces.append(tuple(before[:4]))
            self.handle.deleteTimer(before[4])
        closed, open_ = [], None
        for first, last, size, n in sorted(pieces):
            if open_ is None or first - open_[1] > self.gap_us:
                closed += [open_] if open_ else []
                open_ = (first, last, size, n)
            else:
                open_ = (open_[0], max(open_[1], last), open_[2] + size, open_[3] + n)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(timer)
        self.state.update((*open_, timer))
        if closed:
            yield self._rows(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        flow = self.state.get()
        self.state.clear()
        yield self._rows(key, [tuple(flow[:4])])

    def close(self) -> None:
        pass


def live_flows(packets: DataFrame, timeout: float = 60.0, idle: float | None = None) -> DataFrame:
    """Flows of a live stream, without a watermark: a flow ends ``idle`` seconds (the timeout) after its last packet came in,
    also if the whole stream has fallen silent.

    Packets of a task that are less than the timeout apart travel as one piece. Packets that come after their flow was closed open a new one.
    """
    gap = int(timeout * 1_000_000)
    rows = packets.filter(F.col("src_ip").isNotNull()).select(
        *FLOW_KEY, F.unix_micros(F.col("ts").cast("timestamp")).alias("first_us"), F.col("length").cast("long").alias("bytes")
    )

    def combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            slots = b.groupby([*FLOW_KEY, b["first_us"] // gap], dropna=False, sort=False)
            pieces = slots.agg(first=("first_us", "min"), last=("first_us", "max"), bytes=("bytes", "sum"), packets=("bytes", "size"))
            pieces = pieces.droplevel(-1).reset_index().rename(columns={"first": "first_us", "last": "last_us"})
            yield pieces.astype({c: "Int32" for c in ("sport", "dport")})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*FLOW_KEY).schema.fields)
    pieces = rows.mapInPandas(combined, f"{kinds}, {PIECE}")
    state = IdleFlows(gap, int((timeout if idle is None else idle) * 1000))
    flows = pieces.groupBy(*FLOW_KEY).transformWithStateInPandas(state, f"{kinds}, {PIECE}", "Append", "ProcessingTime")
    return as_connection(
        flows.select(
            *FLOW_KEY, F.timestamp_micros("first_us").alias("ts_start"), F.timestamp_micros("last_us").alias("ts_end"),
            F.col("bytes").alias("orig_bytes"), F.col("packets").alias("orig_pkts"),
        )
    )


SUMS = ["n", "bytes", "squares", "tcp", "udp", "syn"]
WINDOW_SUMS = ", ".join(f"{c} double" for c in (*SUMS, "top", "low"))


class IdleWindows(StatefulProcessor):
    """Sums of a packet window, and its addresses as keys of the state store; it closes when nothing came for a while."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", f"{WINDOW_SUMS}, sources long, targets long, timer long")
        self.addresses = handle.getMapState("addresses", "side int, address string", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows), ignore_index=True)
        before = self.sums.get()
        sums = {c: float(got[c].sum()) for c in SUMS}
        top, low, distinct = float(got["top"].max()), float(got["low"].min()), [0, 0]
        if before is not None:
            self.handle.deleteTimer(before[-1])
            sums = {c: sums[c] + v for c, v in zip(SUMS, before)}
            top, low, distinct = max(top, before[6]), min(low, before[7]), list(before[8:10])
        for side, column in enumerate(("sources", "targets")):
            for address in {a for listed in got[column] for a in listed}:
                if not self.addresses.containsKey((side, address)):
                    self.addresses.updateValue((side, address), (True,))
                    distinct[side] += 1
        timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(timer)
        self.sums.update((*sums.values(), top, low, *distinct, timer))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = self.sums.get()
        self.sums.clear()
        self.addresses.clear()
        names = [*SUMS, "top", "low", "sources", "targets"]
        out = pd.DataFrame([found[:10]], columns=names)
        out.insert(0, "start_us", int(key[0]))
        yield out

    def close(self) -> None:
        pass


def live_windows(packets: DataFrame, width: float = 5.0, idle: float = 5.0) -> DataFrame:
    """Packet statistics of a live stream, without a watermark: a window closes ``idle`` seconds after its last packet came in,
    also if the whole stream has fallen silent."""
    step = int(width * 1_000_000)
    rows = packets.filter(F.col("ts").isNotNull()).select(
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("length").cast("double").alias("size"), "src_ip",
        "dst_ip", "proto", F.coalesce(F.col("tcp_flags").bitwiseAND(2) != 0, F.lit(False)).alias("syn"),
    )

    def combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(start_us=b["us"] // step * step, squares=b["size"] ** 2)
            b["tcp"], b["udp"] = (b["proto"] == "tcp").astype(float), (b["proto"] == "udp").astype(float)
            b["syn"] = b["tcp"] * b["syn"].astype(float)
            windows = b.groupby("start_us")
            out = windows.agg(
                n=("us", "size"), bytes=("size", "sum"), squares=("squares", "sum"), tcp=("tcp", "sum"), udp=("udp", "sum"),
                syn=("syn", "sum"), top=("size", "max"), low=("size", "min"),
            ).astype(float)
            for name, column in (("sources", "src_ip"), ("targets", "dst_ip")):
                out[name] = windows[column].agg(lambda c: sorted(set(c.dropna())))
            yield out.reset_index()

    pieces = rows.mapInPandas(combined, f"start_us long, {WINDOW_SUMS}, sources array<string>, targets array<string>")
    sums = pieces.groupBy("start_us").transformWithStateInPandas(
        IdleWindows(int(idle * 1000)), f"start_us long, {WINDOW_SUMS}, sources long, targets long", "Append", "ProcessingTime"
    )
    n, mean = F.col("n"), F.col("bytes") / F.col("n")
    cells = {
        "total_packets": n.cast("long"), "total_bytes": F.col("bytes"), "tcp_ratio": F.col("tcp") / n, "udp_ratio": F.col("udp") / n,
        "other_ratio": (n - F.col("tcp") - F.col("udp")) / n, "unique_src": F.col("sources"), "unique_dst": F.col("targets"),
        "mean_size": mean, "std_size": F.sqrt(F.greatest(F.col("squares") / n - mean * mean, F.lit(0.0))),
        "max_size": F.col("top"), "min_size": F.col("low"), "syn_ratio": F.col("syn") / n,
    }
    return sums.select(F.timestamp_micros("start_us").alias("window_start"), *[cells[c].alias(c) for c in WINDOW_FEATURES])


def scored_windows(windows: DataFrame, score) -> DataFrame:
    """Windows of a stream with the ``score`` that a function of rows adds, and its band; nothing is kept or shuffled."""
    return score(windows).withColumn("band", score_band("score"))
