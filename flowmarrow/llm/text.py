"""Column helpers shared by the text operators."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of ASCII white space, which separate words.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL_CHECKS: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name; ``sql`` is the matching check, if there is one."""

    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL_CHECKS[fn.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole(text: Column) -> Column:
    """The text; null reads as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def split_words(text: Column, separators: str = BLANKS) -> Column:
    """The parts of a text between runs of separators; no empty ones, none for null."""
    return F.array_remove(F.split(whole(text), separators), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    t = whole(text)
    # lower() also maps other letters, so it serves only texts without any
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower()))


def with_row(docs: DataFrame, **columns: Column) -> DataFrame:
    """The rows as one struct ``row`` next to own columns, so that no name can clash."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def rows_only(df: DataFrame) -> DataFrame:
    return df.select("row.*")
