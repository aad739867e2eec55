"""Sinks: labelled tables, connection logs, features, reports, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmarrow.functions.columns import seconds_between
from flowmarrow.schemas import CONN_COLUMNS_IP_PROTO, CONN_LOG_TYPES, renamed


def write_labelled(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Labelled rows, one folder per label, so that readers of one label skip the others."""
    writer = df.write.mode("overwrite").partitionBy("label")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def conn_log_header(columns: list[str]) -> list[str]:
    """The header lines of a connection log."""
    types = [CONN_LOG_TYPES.get(c, "string") for c in columns]
    return [
        "#separator \\x09",
        "#set_separator\t,",
        "#empty_field\t(empty)",
        "#unset_field\t-",
        "#path\tconn",
        "\t".join(["#fields", *columns]),
        "\t".join(["#types", *types]),
    ]


def write_conn_log(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Tab-separated part files with ``-`` for unset; every file carries the header and ``#close``.

    Each task writes its own complete log, so nothing is funnelled through one writer: header
    rows, data rows and the closing row are lines of one text column sorted inside the partition.
    """
    wanted = columns or [c for c in CONN_COLUMNS_IP_PROTO if renamed(c) in df.columns]
    cells = []
    for c in wanted:
        value = F.col(renamed(c))
        if CONN_LOG_TYPES.get(c) == "time" and dict(df.dtypes)[c].startswith("timestamp"):
            whole = F.unix_micros(value.cast("timestamp")).cast("decimal(20,0)")
            value = (whole / 1_000_000).cast("decimal(20,6)")
        elif dict(df.dtypes)[renamed(c)].startswith("array"):
            value = F.array_join(value, ",")
        elif dict(df.dtypes)[renamed(c)] == "boolean":
            value = F.when(value, "T").otherwise(F.when(~value, "F"))
        cells.append(F.coalesce(value.cast("string"), F.lit("-")))
    lines = df.select(F.concat_ws("\t", *cells).alias("value"))
    head = "\n".join(conn_log_header(wanted))
    framed = lines.mapInPandas(lambda batches: _framed(batches, head), "value string")
    framed.write.mode("overwrite").text(path)


def _framed(batches, head: str):
    import pandas as pd

    yield pd.DataFrame({"value": [head]})
    yield from batches
    yield pd.DataFrame({"value": ["#close"]})


def write_features(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_json_report(df: DataFrame, path: str, compression: str = "none") -> None:
    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    lines.write.mode("overwrite").option("compression", compression).text(path)


def write_metrics_csv(df: DataFrame, path: str) -> None:
    """A metric table; missing values are written as ``nan``."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "nan").csv(path)


def write_anomalies(df: DataFrame, path: str, score: str = "score") -> None:
    """Rows flagged as anomalies, highest score first (range-partitioned sort, many files)."""
    rows = df.filter("prediction = 1").orderBy(F.desc(score))
    rows.write.mode("overwrite").option("header", True).csv(path)


def attack_log_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("duration_seconds", seconds_between("start_time", "end_time"))


def write_attack_log(df: DataFrame, path: str) -> None:
    attack_log_rows(df).write.mode("overwrite").option("header", True).csv(path)


def write_drift_report(history: DataFrame, baseline: DataFrame, path: str) -> None:
    """Baseline statistics, every check and the summary per method, as JSON lines."""
    from flowmarrow.operators.drift import history_summary

    tagged = lambda kind, rows: rows.select(
        F.lit(kind).alias("kind"), F.to_json(F.struct(*rows.columns)).alias("record")
    )
    parts = tagged("baseline", baseline).unionByName(tagged("check", history))
    parts.unionByName(tagged("summary", history_summary(history))).write.mode("overwrite").json(path)


def write_alert_report(explained: DataFrame, path: str, by_priority: DataFrame | None = None) -> None:
    """Summary record plus the alerts by priority, as gzipped JSON lines: their texts repeat from alert to alert.

    ``by_priority`` are the same alerts in order (``explain`` with ``urgent_first``); else the whole records are sorted here.
    """
    from flowmarrow.operators.explain import alert_summary

    write_json_report(alert_summary(explained), f"{path}/summary")
    rows = explained.orderBy(F.desc("priority_score")) if by_priority is None else by_priority
    write_json_report(rows.select("explanation.*"), f"{path}/alerts", "gzip")
