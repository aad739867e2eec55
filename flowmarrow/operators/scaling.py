"""Scaling and splitting of feature rows."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmarrow.functions.columns import numeric_or_zero
from flowmarrow.operators.ordered import with_ordinal


def fit_scaler(df: DataFrame, columns: list[str], with_mean: bool = True) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, one pass; a constant column gets deviation 1, null and NaN are 0.

    Both have twelve digits, so that the order in which Spark adds up the rows does not show.
    """
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.avg(numeric_or_zero(c)).alias(f"m{i}"), F.stddev_pop(numeric_or_zero(c)).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {
        c: (short(row[f"m{i}"] or 0.0) if with_mean else 0.0, short(row[f"s{i}"] or 1.0))
        for i, c in enumerate(columns)
    }


def short(x: float) -> float:
    return float(f"{x:.12g}")


def scale(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.items()})


def scaled_array(scaler: dict[str, tuple[float, float]]) -> Column:
    cells = [(numeric_or_zero(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.items()]
    return F.array(*cells)


def fit_vector_scaler(df: DataFrame, vector: str) -> tuple[list[float], list[float]]:
    """Mean and population deviation per position of an array column, one pass."""
    want = Summarizer.metrics("mean", "variance", "count")
    s = df.select(want.summary(array_to_vector(vector)).alias("s")).select("s.*").first()
    shrink = (s["count"] - 1) / s["count"] if s["count"] > 1 else 0.0
    return [float(m) for m in s["mean"]], [math.sqrt(v * shrink) or 1.0 for v in s["variance"]]


def scale_vector(df: DataFrame, vector: str, scaler: tuple[list[float], list[float]], with_mean: bool = True) -> DataFrame:
    mean, std = (F.array(*[F.lit(v) for v in part]) for part in scaler)
    centred = F.zip_with(vector, mean, lambda x, m: x - m) if with_mean else F.col(vector)
    return df.withColumn(vector, F.zip_with(centred, std, lambda x, s: x / s))


def class_ordinal(df: DataFrame, y: str, row_id: str, seed: int | None = None) -> DataFrame:
    """Adds ``pos`` (0-based position inside the class) and ``class_size``.

    Positions come from one global sort by class, so a class with most of the rows is spread
    over all tasks. With a seed the order inside a class is a hash, else it is the row id.
    """
    keys = [y, row_id] if seed is None else [y, F.xxhash64(F.col(row_id), F.lit(seed)), row_id]
    rows = with_ordinal(df, keys, "_ord")
    classes = rows.groupBy(y).agg(F.min("_ord").alias("_first"), F.count("*").alias("class_size"))
    return (
        rows.join(F.broadcast(classes), y)
        .withColumn("pos", F.col("_ord") - F.col("_first"))
        .drop("_ord", "_first")
    )


def stratified_split(
    df: DataFrame, y: str, row_id: str, train: float = 0.8, seed: int | None = 42
) -> DataFrame:
    """``split`` = train for the first 80 % of each class, test for the rest."""
    rows = class_ordinal(df, y, row_id, seed)
    inside = F.col("pos") < F.floor(F.col("class_size") * train + 0.5)
    return rows.withColumn("split", F.when(inside, "train").otherwise("test")).drop("pos", "class_size")


def stratified_folds(
    df: DataFrame, y: str, row_id: str, k: int = 5, seed: int | None = 42
) -> DataFrame:
    """``fold`` 0..k-1, dealt out evenly inside each class."""
    rows = class_ordinal(df, y, row_id, seed)
    return rows.withColumn("fold", F.pmod("pos", F.lit(k)).cast("int")).drop("pos", "class_size")


def hash_split(df: DataFrame, row_id: str, train: float = 0.8, seed: int = 42) -> DataFrame:
    """A split by hash of the id: no shuffle, shares hold on average."""
    draw = F.pmod(F.xxhash64(F.col(row_id), F.lit(seed)), F.lit(1_000_000)) / 1e6
    return df.withColumn("split", F.when(draw < train, "train").otherwise("test"))
