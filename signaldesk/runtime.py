"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Keys and numbers take many times their shuffled size in memory, so tasks stay small.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Zone-less parquet times are read as UTC instants, so time filters need no cast and reach the scan.
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    # Lists of up to this many rows a group are cut in the map tasks, before the exchange.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings every job relies on (timestamps are UTC instants)."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names it.  Only a local session without one gets a
    temporary folder; on a cluster executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


BROADCAST_ROWS = 200_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Count, but never past ``rows`` + 1."""
    return df.limit(rows + 1).count() <= rows


def probe(big: DataFrame, table: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a large side to a look-up table.

    The table is broadcast only when counted to be small; else both sides are
    sorted and merged, where adaptive execution splits skewed keys.  Either
    way the large side is never the one broadcast.
    """
    if is_small(table, rows):
        return big.join(F.broadcast(table), on, how)
    return big.hint("merge").join(table, on, how)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is written inside leaves no shuffle files: they go as soon as a write ends, not when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a result that several later branches read, and read it back.

    The written table cuts the lineage: branches scan its columns instead of
    repeating the work, and a lost executor costs one scan.
    """
    path = scratch_dir(df.sparkSession, label)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bucketed(df: DataFrame, key: str, label: str, buckets: int) -> DataFrame:
    """As ``staged``, in ``buckets`` buckets of ``key``: joins on the key read the table as it lies, without an exchange."""
    path = scratch_dir(df.sparkSession, label)
    name = f"bucketed_{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
