"""What the operators of this subpackage share: table access, staging and Arrow batch settings."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows and bytes that one Arrow batch may hold: whichever is reached first ends it, so long texts come in small batches.
BATCH_ROWS = 1_000
BATCH_BYTES = 8 << 20

#: Word separators of the word contracts: space and the ASCII controls 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch of texts can hold in a Python worker.

    The bound in bytes is the same for every operator, so it holds for plans that run after another operator was built.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = f"/tmp/spark-{os.getpid()}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


#: For rows of some MB each: the writer looks after every row whether its buffer is full, not after every hundredth.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def staged(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage is cut, a lost executor costs one scan."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Write a table by buckets of ``key``, sorted in each: joins on the key read it as it lies, without an exchange."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more (what was made of them is written itself)."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if path.toUri().getPath().startswith(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark)).toUri().getPath()):
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], name: str) -> str:
    """A column name that no column of the input has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keep_where(docs: DataFrame, verdict: Column) -> DataFrame:
    """Rows whose verdict holds; null counts as no."""
    return docs.where(F.coalesce(verdict, F.lit(False)))
