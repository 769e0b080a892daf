"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of garbage-collected DataFrames are deleted
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8,
              app: str = "kohort", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench.  On a cluster, the session is
    supplied by the platform and only :func:`checkpoint_dir` is used."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting wins; only when it is unset (local tests) a fresh
    scratch folder is created and registered; other masters must name one.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="kohort-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df):
    """Write ``df`` once as a reliable checkpoint in the shared folder and
    return the reloaded DataFrame.

    Used where a small aggregate feeds several branches (totals, ranges,
    joins back): the input is scanned once and the lineage is cut, so a lost
    executor re-reads the checkpoint instead of the base table."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def scratch():
    """Gives ``keep(df)``, which computes ``df`` once and keeps it on the
    executors' disks until the block ends.

    For small aggregates that only the block reads: a checkpoint makes two
    files for each partition, however few rows there are, and the local file
    system starts a process for each file's permissions.  The lineage stays,
    so a lost executor costs its partitions.  What outlives the block, or is
    carried from turn to turn, is for :func:`materialize`."""
    held = []

    def keep(df):
        held.append(df.persist(StorageLevel.DISK_ONLY))
        df.count()
        return df
    try:
        yield keep
    finally:
        for df in reversed(held):
            df.unpersist()
