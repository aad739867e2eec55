"""Labels by folder, by dataset column and by attack intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmarrow.functions.columns import is_truthy_label, micros
from flowmarrow.operators import ordered
from flowmarrow.operators.ordered import with_ordinal
from flowmarrow.schemas import CONN_COLUMNS, renamed
from flowmarrow.session import frozen

# Capture folder to (label, attack type).
FOLDER_LABELS = {
    "logs_normal": ("normal", "normal"),
    "logs_syn": ("anomaly", "syn_flood"),
    "logs_dns": ("anomaly", "dns_amplification"),
    "logs_http": ("anomaly", "http_flood"),
    "logs_udp": ("anomaly", "udp_flood"),
}
# Flow-dataset column to connection column.
UNSW_RENAMES = {
    "dur": "duration", "sbytes": "orig_bytes", "dbytes": "resp_bytes",
    "spkts": "orig_pkts", "dpkts": "resp_pkts", "sport": "orig_p",
    "dport": "resp_p", "srcip": "orig_h", "dstip": "resp_h",
    "proto": "proto", "state": "conn_state", "service": "service",
}
# Column names that hold a label.
LABEL_CANDIDATES = ["label", "class", "attack_cat"]
TRUTH_CANDIDATES = ["label", "Label", "y", "attack", "attack_cat"]
#: Blocks of 2 to this power of places and more count as long.
LONG_BLOCK = 10
CELL_SEGMENTS, CELL_PARTS = 64, 64
BROADCAST_CHARS = 4_000_000


def label_by_folder(df: DataFrame, folder: str = "folder") -> DataFrame:
    """Dimension lookup with default: unknown folders count as normal."""
    spark = df.sparkSession
    rows = [(f, label, kind) for f, (label, kind) in FOLDER_LABELS.items()]
    dim = spark.createDataFrame(rows, f"{folder} string, label string, attack_type string")
    normal = F.lit("normal")
    return df.join(F.broadcast(dim), folder, "left").withColumns(
        {"label": F.coalesce("label", normal), "attack_type": F.coalesce("attack_type", normal)}
    )


def label_from_dataset(df: DataFrame) -> DataFrame:
    """normal / anomaly from a 0/1 ``label``, else from ``attack_cat``, else all normal."""
    normal, anomaly = F.lit("normal"), F.lit("anomaly")
    kind = F.trim("attack_cat") if "attack_cat" in df.columns else F.lit(None).cast("string")
    is_kind = kind.isNotNull() & (kind != "Normal")
    if "label" in df.columns:
        number = F.col("label").try_cast("int")
        label = F.when(number == 0, normal).when(number == 1, anomaly)
    else:
        label = F.when(is_kind, anomaly).otherwise(normal)
    if "attack_cat" in df.columns:
        attack_type = F.when(is_kind, kind).otherwise(normal)
    else:
        attack_type = label
    return df.withColumns({"label": label, "attack_type": attack_type})


def unsw_to_connections(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Flow-dataset rows in the connection layout, with timestamps, labels and ``-`` fillers.

    Without ``stime`` rows get 2024-01-01 plus one second per row in ``row_id`` order.
    """
    lower = {c.lower().strip(): c for c in df.columns}
    cells: dict[str, Column] = {}
    for source, target in UNSW_RENAMES.items():
        if source in lower:
            cells[target] = F.col(lower[source])
        else:
            cells.setdefault(target, F.lit(0))
    kept = [F.col(f"`{lower[c]}`").alias(c) for c in ("label", "attack_cat") if c in lower]
    if "stime" in lower:
        cells["ts"] = F.timestamp_seconds(F.col(lower["stime"]).try_cast("double"))
    elif row_id is not None:
        df = with_ordinal(df, [row_id], "_row")
        cells["ts"] = sequential_timestamp("_row")
    else:
        raise ValueError("rows without stime need row_id to order them")
    ids = [row_id] if row_id else []
    conn = label_from_dataset(df.select(*ids, *[c.alias(n) for n, c in cells.items()], *kept))
    fillers = [renamed(c) for c in CONN_COLUMNS if renamed(c) not in conn.columns]
    return conn.drop("attack_cat").withColumns({c: F.lit("-") for c in fillers})


def sequential_timestamp(ordinal: str | Column, start: str = "2024-01-01 00:00:00") -> Column:
    base = F.lit(start).cast("timestamp")
    return F.timestamp_seconds(F.unix_timestamp(base) + F.col(ordinal))


def binary_target(df: DataFrame, column: str, negative: str | None = None) -> DataFrame:
    """``y``: 1 for 'anomaly', or for anything but ``negative`` when that is given."""
    value = F.trim(F.col(column).cast("string"))
    hit = value != negative if negative is not None else value == "anomaly"
    return df.withColumn("y", F.coalesce(hit, F.lit(False)).cast("int"))


def resolve_column(df: DataFrame, candidates: list[str]) -> str | None:
    """First column whose trimmed, lower-cased header is one of the candidates."""
    by_name = {c.strip().lower(): c for c in df.columns}
    return next((by_name[c.lower()] for c in candidates if c.lower() in by_name), None)


def truth_column(df: DataFrame) -> DataFrame:
    found = resolve_column(df, TRUTH_CANDIDATES)
    if found is None:
        raise ValueError("no label column found")
    return df.withColumn("y", is_truthy_label(found))


def _prepared(attacks: DataFrame, match_hosts: bool) -> DataFrame:
    """Intervals in microseconds with an id, one for each way a row can meet them: (side, host, w, s, e, iid).

    Side 0 is any row; sides 1 and 2 are rows whose origin or responder is ``host``. Rows with an unusable interval are dropped.
    """
    any_row = F.struct(F.lit(0).alias("side"), F.lit("").alias("host"))
    ways = F.array(any_row)
    if match_hosts:
        by_host = F.array(
            F.struct(F.lit(1).alias("side"), F.col("source_ip").alias("host")),
            F.struct(F.lit(2).alias("side"), F.col("target_ip").alias("host")),
        )
        ways = F.when(F.col("source_ip").isNull(), ways).otherwise(F.filter(by_host, lambda x: x["host"].isNotNull()))
    rows = attacks.select(
        F.explode(ways).alias("x"),
        F.struct(F.col("interval_idx").alias("idx"), "attack_type").alias("w"),
        micros("start_time").alias("s"),
        micros("end_time").alias("e"),
    ).filter("s <= e")
    return frozen(rows.select("x.*", "w", "s", "e", F.monotonically_increasing_id().alias("iid")), "intervals")


#: Intervals compete where these agree.
SIDE = ["side", "host"]


def _disjoint(intervals: DataFrame) -> DataFrame:
    """Overlapping intervals as disjoint segments [s, e] with the interval that wins there, the last of the log.

    All end points of all hosts are numbered by one range-partitioned sort, so an interval is a span of places. Spans are cut
    into aligned blocks whose lengths are powers of two (at most two of each length), and every block keeps its winner: a
    plain aggregation. Long blocks hand theirs to the pieces of the line they cover whole, where it is the offset of all
    intervals open from border to border; short ones hand theirs to their places. The rows on the way grow with the log and
    the logarithm of its size, however the intervals overlap.
    """
    ends = F.array(F.col("s"), F.col("e") + 1)
    points = with_ordinal(intervals.select(*SIDE, "iid", "w", F.explode(ends).alias("p")), [*SIDE, "p", "iid"], "pos")
    spans = points.groupBy("iid").agg(F.min("pos").alias("l"), F.max("pos").alias("r"), F.any_value("w").alias("w"))
    levels = max(1, points.count().bit_length())
    first, last = "shiftright(l + shiftleft(1L, k) - 1, k)", "shiftright(r, k)"
    blocks = F.expr(
        f"""flatten(transform(sequence(0, {levels}), k -> filter(
          array(named_struct('level', k, 'nr', {first}, 'own', {first} < {last} AND {first} % 2 = 1),
                named_struct('level', k, 'nr', {last} - 1, 'own', {first} < {last} AND {last} % 2 = 1)), x -> x.own)))"""
    )
    best = spans.select("w", F.explode(blocks).alias("b")).groupBy("b.level", "b.nr").agg(F.max("w").alias("w"))
    best = frozen(best, "interval-blocks")

    def handed(part: DataFrame, down: Column, name: str) -> DataFrame:
        """The winners of blocks at the smaller blocks, 2 to the power of ``down`` of them, that each one covers."""
        covered = F.sequence(F.call_function("shiftleft", "nr", down), F.call_function("shiftleft", F.col("nr") + 1, down) - 1)
        return part.select("w", F.explode(covered).alias(name)).groupBy(name).agg(F.max("w").alias(f"w_{name}"))

    at_place = handed(best.filter(F.col("level") < LONG_BLOCK), F.col("level"), "pos")
    at_piece = handed(best.filter(F.col("level") >= LONG_BLOCK), F.col("level") - LONG_BLOCK, "piece")
    following = points.select(
        (F.col("pos") - 1).alias("pos"), (F.col("p") - 1).alias("e"), *[F.col(k).alias(f"next_{k}") for k in SIDE]
    )
    segments = points.withColumnRenamed("p", "s").join(following, "pos")
    segments = segments.filter("s <= e AND side = next_side AND host = next_host")
    segments = segments.select(*SIDE, "s", "e", "pos", F.shiftright("pos", LONG_BLOCK).alias("piece"))
    won = segments.join(at_place, "pos", "left").join(at_piece, "piece", "left")
    won = won.select(*SIDE, "s", "e", F.greatest("w_pos", "w_piece").alias("w")).filter("w IS NOT NULL")
    return frozen(won, "segments")


def _cell_width(segments: DataFrame) -> int:
    """A width of time cells that multiplies the segments by five or so at most."""
    seen = segments.agg(F.count("*").alias("n"), F.sum((F.col("e") - F.col("s") + 1).cast("double")).alias("t")).first()
    return max(1, int((seen["t"] or 0) // (4 * max(seen["n"], 1))) + 1)


def _cells(segments: DataFrame) -> list[tuple[int, DataFrame]]:
    """Time cells with the few segments that lie in each, as written tables (side, host, cell, inside) by cell width.

    A cell that more than ``CELL_SEGMENTS`` segments touch is divided into ``CELL_PARTS`` narrower ones, so a time at which a
    great many intervals begin or end gets cells of its own; at one microsecond a cell has one segment.
    """
    width = _cell_width(segments)
    touched = lambda w: F.explode(F.sequence(F.floor(F.col("s") / w), F.floor(F.col("e") / w)))
    pieces = segments.withColumn("cell", touched(width))
    cell, found = [*SIDE, "cell"], []
    while True:
        counts = pieces.groupBy(*cell).agg(F.count("*").alias("n"))
        crowded = frozen(counts.filter(F.col("n") > (CELL_SEGMENTS if width > 1 else 1)).select(*cell), "crowded-cells")
        done = crowded.isEmpty()
        calm = pieces if done else pieces.join(crowded, cell, "left_anti")
        packed = calm.groupBy(*cell).agg(F.collect_list(F.struct("s", "e", "w")).alias("inside"))
        found.append((width, frozen(packed, "cells")))
        if done:
            return found
        start, narrow = F.col("cell") * width, max(1, width // CELL_PARTS)
        cut = pieces.join(crowded, cell, "left_semi").withColumns(
            {"s": F.greatest("s", start), "e": F.least("e", start + width - 1)}
        )
        pieces, width = frozen(cut.drop("cell").withColumn("cell", touched(narrow)), "cells"), narrow


def _small_cells(cells: DataFrame) -> bool:
    """Whether cells are proven small enough to broadcast, by their segments and the length of their texts."""
    names = F.aggregate("inside", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.length(x["w"]["attack_type"]), F.lit(0)))
    seen = cells.agg(F.sum(F.size("inside")).alias("n"), F.sum(F.length("host") + names).alias("chars")).first()
    return (seen["n"] or 0) <= ordered.BROADCAST_ROWS and (seen["chars"] or 0) <= BROADCAST_CHARS


def label_by_intervals(df: DataFrame, attacks: DataFrame, ts: str = "ts", match_hosts: bool = False) -> DataFrame:
    """Label rows inside a closed attack interval; the last interval of the log wins.

    ``attacks`` carries ``interval_idx``, its order in the log. With ``match_hosts`` an interval
    that names a source also needs ``orig_h = source_ip`` or ``resp_h = target_ip``.

    A log of any length is made disjoint first and put into time cells. A row meets one cell of each width (almost always
    there is one width) for any row, for its origin and for its responder, in equi-joins: broadcasts when the cells are
    checked to be small, so that the rows do not move, else shuffles that Spark splits where they are skewed.
    """
    rows = df.withColumn("_t", micros(ts))
    covers = lambda x: F.col("_t").between(x["s"], x["e"])
    found = []
    for width, cells in _cells(_disjoint(_prepared(attacks, match_hosts))):
        near = F.broadcast if _small_cells(cells) else lambda x: x
        for side, host in enumerate([None, "orig_h", "resp_h"] if match_hosts else [None]):
            own = cells.filter(F.col("side") == side)
            name = f"_w{len(found)}"
            right = own.select(F.col("cell").alias("_cell"), F.col("host").alias("_host"), F.col("inside").alias(name))
            met = F.floor(F.col("_t") / width) == F.col("_cell")
            if host:
                met = met & (F.col(host) == F.col("_host"))
            rows = rows.join(near(right), met, "left").drop("_cell", "_host")
            rows = rows.withColumn(name, F.get(F.filter(name, covers), F.lit(0))["w"])
            found.append(name)
    won = F.greatest(*found) if len(found) > 1 else F.col(found[0])
    normal = F.lit("normal")
    labelled = rows.withColumn("_w", won)
    return labelled.withColumns(
        {
            "label": F.when(F.col("_w").isNotNull(), "anomaly").otherwise(normal),
            "attack_type": F.coalesce(F.col("_w.attack_type"), normal),
        }
    ).drop("_w", "_t", *found)


def all_normal(df: DataFrame) -> DataFrame:
    """Labels when there is no attack log."""
    return df.withColumns({"label": F.lit("normal"), "attack_type": F.lit("normal")})


def only_normal(df: DataFrame) -> DataFrame:
    return df.filter(F.col("label") == "normal")


def only_anomalies(df: DataFrame) -> DataFrame:
    return df.filter(F.col("label") == "anomaly")


def feature_label_join(features: DataFrame, labels: DataFrame, key: str = "conn_id") -> DataFrame:
    """Features and labels meet on the row id, never by position."""
    return features.join(labels, key)
