"""Registry of the named queries and of their SQL checks."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL_CHECKS: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name; ``sql`` is the matching check, if there is one."""

    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # the tables hold zone-less timestamps, read as UTC
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL_CHECKS[fn.__name__] = sql
        return run

    return add
