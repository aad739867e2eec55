"""Session defaults and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: The state store that streams with keyed state need; the default of Spark keeps one column family only.
STORE, ROCKSDB = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)


def session(app: str = "flowmarrow", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # a busy flow is merged before the shuffle, as in any other aggregation
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        STORE: ROCKSDB,
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def keyed_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, whatever the session is set to."""
    was = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, was)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine; on a cluster the
    setting is required, since executors have to reach the folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
            named = tempfile.mkdtemp(prefix="flowmarrow-")
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, grouped by application for later removal."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/flowmarrow-{app}/{label}-{uuid.uuid4().hex}"


def frozen(df: DataFrame, label: str) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there.

    The lineage ends here, lost executors cannot change the rows, and the planner knows the size
    of the result.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Repartition a plain scan that has fewer partitions than the cluster has cores.

    For work that is heavy per row; a large table has enough partitions and stays as it is. Only
    for inputs without shuffles, since asking for the partitions would run those.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


#: Rows of a task that come again in every pass of a fit.
TASK_ROWS = 250_000


@contextmanager
def kept_for_fit(df: DataFrame) -> Iterator[DataFrame]:
    """Rows kept for the many passes of a fit, on partitions of about ``TASK_ROWS`` rows at most.

    What a learner keeps of a partition on its side is read by one task, and it grows with the rows.
    """
    kept = df.persist()
    try:
        wanted = -(-kept.count() // TASK_ROWS)
        if kept.rdd.getNumPartitions() >= wanted:
            yield kept
            return
        wide = kept.repartition(wanted).persist()
        try:
            wide.count()
            kept.unpersist()
            yield wide
        finally:
            wide.unpersist()
    finally:
        kept.unpersist()


def cached_spread(df: DataFrame) -> DataFrame:
    """Rows kept for several passes, on at least as many partitions as there are cores.

    The caller unpersists the result.
    """
    kept = df.persist()
    kept.count()
    wide = spread(kept)
    if wide is kept:
        return kept
    wide = wide.persist()
    wide.count()
    kept.unpersist()
    return wide
