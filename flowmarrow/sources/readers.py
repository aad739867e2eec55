"""Sources: connection logs, flow-dataset CSVs, attack logs, metric tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowmarrow.functions.columns import clipped_finite, lenient_double, numeric_or_zero, timestamp_of
from flowmarrow.operators import labeling as lb
from flowmarrow.operators.ordered import with_ordinal
from flowmarrow.schemas import (
    CONN_COLUMNS,
    CONN_COLUMNS_IP_PROTO,
    CONN_LOG_TYPES,
    LOG_TYPE_TO_SPARK,
    renamed,
)


def _typed(column: str) -> Column:
    """A raw text cell as its type; ``-`` and unusable text become null."""
    text = F.col(f"`{column}`")
    cell = F.when(text.isin("-", "(empty)"), None).otherwise(text)
    kind = CONN_LOG_TYPES.get(column, "string")
    if kind == "time":
        return timestamp_of(cell)
    if kind == "bool":
        return F.when(cell.isin("T", "true", "True"), True).when(cell.isin("F", "false", "False"), False)
    if kind == "set[string]":
        return F.split(cell, ",")
    if kind in ("port", "count"):
        return lenient_double(cell).try_cast(LOG_TYPE_TO_SPARK[kind])
    return cell.try_cast(LOG_TYPE_TO_SPARK[kind])


def read_conn_log(
    spark: SparkSession,
    path: str | list[str],
    columns: list[str] = CONN_COLUMNS,
    skip_malformed: bool = False,
    with_folder: bool = False,
) -> DataFrame:
    """Tab-separated connection logs; ``#`` lines are skipped, every cell is read as text.

    ``path`` may be a glob such as ``.../logs_*/conn.log``. ``with_folder`` adds the name of the
    folder each row came from.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = (
        spark.read.schema(schema)
        .option("sep", "\t")
        .option("comment", "#")
        .option("quote", "")
        .option("mode", "DROPMALFORMED" if skip_malformed else "PERMISSIVE")
        .csv(path)
    )
    cells = [_typed(c).alias(renamed(c)) for c in columns]
    if with_folder:
        # conn.log may be one file or a folder of part files
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/conn\.log(/|$)", 1)
        cells.append(folder.alias("folder"))
    return raw.select(*cells)


def read_conn_log_with_header(spark: SparkSession, path: str) -> DataFrame:
    """Logs whose columns are named by their own ``#fields`` lines; files with different columns are refused."""
    heads = spark.read.text(path).filter(F.col("value").startswith("#fields")).distinct().limit(2).collect()
    if not heads:
        raise ValueError(f"no #fields line in {path}")
    if len(heads) > 1:
        raise ValueError(f"the logs in {path} have different columns; read them one by one")
    return read_conn_log(spark, path, heads[0]["value"].split("\t")[1:])


def read_labelled_folders(spark: SparkSession, base: str) -> DataFrame:
    """Every ``logs_*/conn.log`` below ``base`` as one labelled table."""
    rows = read_conn_log(
        spark, f"{base}/logs_*/conn.log", CONN_COLUMNS_IP_PROTO, skip_malformed=True, with_folder=True
    )
    return lb.label_by_folder(rows)


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A headed CSV as text columns with trimmed names; an input without rows is refused."""
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    if not df.columns or df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df.toDF(*[c.strip() for c in df.columns])


def read_unsw(spark: SparkSession, path: str, row_id: str | None = None) -> DataFrame:
    """Flow-dataset CSV in the connection layout with labels."""
    return lb.unsw_to_connections(read_csv(spark, path), row_id)


def read_cicids(spark: SparkSession, path: str) -> DataFrame:
    """Feature columns as finite doubles plus ``y`` (0 for BENIGN); headers are trimmed."""
    df = read_csv(spark, path)
    label = lb.resolve_column(df, lb.LABEL_CANDIDATES)
    if label is None:
        raise ValueError("no label column found")
    target = lb.binary_target(df, label, negative="BENIGN")
    names = [c for c in df.columns if c != label]
    return target.select(*[clipped_finite(F.col(f"`{c}`")).alias(c) for c in names], "y")


def read_attack_log(spark: SparkSession, path: str) -> DataFrame:
    """Attack intervals with their order in the file as ``interval_idx``."""
    df = spark.read.option("header", True).csv(path)
    absent = {"attack_type", "start_time", "end_time"} - set(df.columns)
    if absent:
        raise ValueError(f"attack log without {sorted(absent)}")
    place = F.struct("_metadata.file_path", "_metadata.file_block_start")
    cells = [
        F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
        for c in ("attack_type", "source_ip", "target_ip", "command", "description")
    ]
    rows = df.select(
        *cells,
        timestamp_of("start_time").alias("start_time"),
        timestamp_of("end_time").alias("end_time"),
        place.alias("_file"),
        F.monotonically_increasing_id().alias("_line"),
    )
    return with_ordinal(rows, ["_file", "_line"], "interval_idx").drop("_file", "_line")


def load_connections(
    spark: SparkSession,
    source: str,
    path: str,
    row_id: str | None = None,
) -> DataFrame:
    """One entry point for the kinds of connection sources: ``unsw`` or ``conn_log``."""
    if source == "unsw":
        return read_unsw(spark, path, row_id)
    if source == "conn_log":
        return read_conn_log(spark, path)
    raise ValueError(f"unknown source {source!r}")


def drop_invalid_times(df: DataFrame, ts: str = "ts", dropped: Observation | None = None) -> DataFrame:
    """Rows with a usable time; ``dropped`` observes ``rows`` and ``dropped`` while the query runs."""
    if dropped is not None:
        bad = F.count_if(F.col(ts).isNull()).alias("dropped")
        df = df.observe(dropped, F.count(F.lit(1)).alias("rows"), bad)
    return df.filter(F.col(ts).isNotNull())


def read_metric_csv(spark: SparkSession, path: str) -> DataFrame:
    """A metric table with typed cells: numbers as doubles, ``nan`` as null, the rest as text."""
    return typed_cells(read_csv(spark, path))


def typed_cells(df: DataFrame, text: Iterable[str] = ("model", "method", "metric")) -> DataFrame:
    keep = {c for c in df.columns if c.lower() in set(text)}
    return df.select(
        *[F.col(c) if c in keep else lenient_double(c).alias(c) for c in df.columns]
    )


def metrics_from_json(df: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """``{"model": {"f1": ..}, ..}`` text to one row per model."""
    inner = ", ".join(f"{f}: double" for f in fields)
    parsed = F.from_json(F.col(column), f"map<string, struct<{inner}>>")
    rows = df.select(F.explode(parsed).alias("model", "m"))
    return rows.select("model", *[F.col(f"m.{f}").alias(f) for f in fields])


def rows_from_lists(spark: SparkSession, rows: list[list], width: int) -> DataFrame:
    """Inline feature rows; empty, ragged or non-numeric input is refused."""
    if not rows:
        raise ValueError("no rows given")
    if any(len(r) != width for r in rows):
        raise ValueError(f"every row needs {width} values")
    try:
        cells = [[float(x) for x in r] for r in rows]
    except (TypeError, ValueError) as e:
        raise ValueError("rows must be numeric") from e
    return spark.createDataFrame([(i, r) for i, r in enumerate(cells)], "row_id long, features array<double>")


def read_labelled_matrix(
    spark: SparkSession, features: str, labels: str, key: str = "conn_id", label: str = "label"
) -> DataFrame:
    """A feature matrix and the labels of its rows, two headed CSVs that meet on ``key``: features as doubles, ``y`` 0/1.

    Rows that only one of the two has are left out, whatever their position. A repeated key is refused.
    """
    x, found = read_csv(spark, features), read_csv(spark, labels)
    for name, side in ((features, x), (labels, found)):
        if key not in side.columns or not side.groupBy(key).count().filter("count > 1").isEmpty():
            raise ValueError(f"{name} needs a column {key} without repeated values")
    cells = [numeric_or_zero(c).alias(c) for c in x.columns if c != key]
    y = lb.binary_target(found.select(key, label), label).select(key, "y")
    return lb.feature_label_join(x.select(key, *cells), y, key)


def feature_names(spark: SparkSession, path: str, fmt: str = "parquet") -> list[str]:
    """Column names of a saved feature table; only the schema is read."""
    reader = spark.read.format(fmt)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path).columns
