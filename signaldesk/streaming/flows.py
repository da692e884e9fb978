"""Structured Streaming versions of the polling jobs.

Every sink is idempotent per micro-batch: a batch writes to a folder named by
its id with overwrite, so a batch that is run again after a failure replaces
its own output and nothing else.  No row is dropped for being late: keys are
checked against all stored ones, not against a watermark.  Stored keys lie in
hash buckets, and a batch reads and rewrites only the buckets of its own keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from signaldesk.operators import sync
from signaldesk.operators.usage import MEASURES, priced
from signaldesk.functions.dates import local_date


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Files under ``path`` (a folder or one file) as a stream with the schema of the existing data."""
    schema = spark.read.parquet(path).schema
    # A file source wants a folder or a pattern; this pattern matches just ``path``.
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there, then stop."""
    (stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def _batch_path(path: str, batch: int) -> str:
    return f"{path}/batch={batch}"


def held_batch(rows: DataFrame, path: str) -> DataFrame:
    """A batch as it came, written once: its columns are not made again for each reader."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class Buckets:
    """State by key in hash buckets: ``data/version=<batch>/bucket=<n>``, and a manifest with each bucket's last version.

    Batch n starts from the last manifest before n, so running it again gives the same state.  A manifest has at most
    ``buckets`` rows.
    """

    def __init__(self, path: str, keys: list[str], buckets: int = 256):
        self.path, self.keys, self.buckets = path, keys, buckets

    def placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def touched(self, placed: DataFrame) -> list[int]:
        return [r["bucket"] for r in placed.select("bucket").distinct().collect()]

    def manifest(self, spark: SparkSession, before: int) -> dict[int, int]:
        every = spark.read.schema("bucket int, version int, batch int").option("basePath", f"{self.path}/manifest").parquet(f"{self.path}/manifest")
        every = every.filter(F.col("batch") < before)
        return {r["bucket"]: r["version"] for r in every.filter(F.col("batch") == every.agg(F.max("batch")).scalar()).collect()}

    def read(self, spark: SparkSession, schema: str, before: int, only: list[int] | None = None) -> DataFrame:
        """The state that batch ``before`` starts from, of some buckets."""
        held = self.manifest(spark, before)
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in held.items() if only is None or b in set(only)]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def write(self, placed: DataFrame, batch: int) -> None:
        """New versions of the buckets that ``placed`` holds whole."""
        spark = placed.sparkSession
        held = {} if batch < 0 else self.manifest(spark, batch)
        placed.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/data/version={batch}")
        there = spark.read.schema(placed.schema).option("basePath", f"{self.path}/data").parquet(f"{self.path}/data/version={batch}")
        rows = [*(held | {b: batch for b in self.touched(there)}).items()]
        spark.createDataFrame(rows, "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch}")

    def seed(self, initial: DataFrame) -> None:
        """The state before the first batch."""
        self.write(self.placed(initial), -1)


def append_new(path: str, key: str, order: str, stored: DataFrame, buckets: int = 256) -> Callable[[DataFrame, int], None]:
    """Sink: the first row of each key that is neither in ``stored`` nor in an earlier batch; see ``appended``."""
    state = Buckets(f"{path}/keys", [key], buckets)
    state.seed(stored.select(key).distinct())
    schema = f"{key} {dict(stored.dtypes)[key]}"

    def handle(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows = held_batch(rows, f"{path}/incoming/batch={batch}")
        known = state.read(spark, schema, batch, state.touched(state.placed(rows)))
        out = f"{path}/rows/batch={batch}"
        sync.new_by_either(rows, known, (key,), order).write.mode("overwrite").parquet(out)
        state.write(state.placed(known.unionByName(spark.read.schema(rows.schema).parquet(out).select(key))), batch)

    return handle


def appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")


def upsert_snapshot(path: str, keys: list[str], compared: list[str], initial: DataFrame,
                    keep_old_when_null: tuple[str, ...] = (), buckets: int = 256) -> Callable[[DataFrame, int], None]:
    """Sink: rows by key, updated in the buckets that a batch touches; see ``snapshot`` and ``actions``."""
    cols = [*keys, *compared]
    state = Buckets(f"{path}/state", keys, buckets)
    state.seed(initial.select(*cols))
    schema = ", ".join(f"{c} {dict(initial.dtypes)[c]}" for c in cols)

    def handle(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows = held_batch(rows, f"{path}/incoming/batch={batch}")
        old = state.read(spark, schema, batch, state.touched(state.placed(rows)))
        out = f"{path}/merged/batch={batch}"
        sync.upsert_actions(rows, old, keys, compared, keep_old_when_null).write.mode("overwrite").parquet(out)
        merged = spark.read.schema(f"{schema}, action string").parquet(out)
        merged.filter("action <> 'keep'").select(*keys, "action").write.mode("overwrite").parquet(f"{path}/actions/batch={batch}")
        state.write(state.placed(merged.select(*cols)), batch)

    return handle


def snapshot(spark: SparkSession, path: str, keys: list[str], schema: str) -> DataFrame:
    """All rows as the last batch left them."""
    return Buckets(f"{path}/state", keys).read(spark, schema, 1 << 30)


def actions(spark: SparkSession, path: str) -> DataFrame:
    """What each batch did to each of its keys: keys, action, batch."""
    return spark.read.option("basePath", f"{path}/actions").parquet(f"{path}/actions")


def overwrite_latest(path: str) -> Callable[[DataFrame, int], None]:
    """Sink for complete-mode totals: each batch holds the whole (small) result."""
    def handle(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(_batch_path(path, batch))

    return handle


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    every = spark.read.option("basePath", path).parquet(path)
    return every.filter(F.col("batch") == every.agg(F.max("batch")).scalar()).drop("batch")


def usage_totals(calls: DataFrame) -> DataFrame:
    """Running totals per local day and kind.  State grows with days and kinds only."""
    rows = priced(calls).withColumn("usage_date", local_date("used_at"))
    return rows.groupBy("usage_date", "kind").agg(*[F.sum(m).alias(m) for m in MEASURES])


def window_counts(stories: DataFrame, weekly: bool = False) -> DataFrame:
    """Tumbling counts: UTC days, or weeks that start on Monday."""
    window = F.window("published_at", "7 days", "7 days", "4 days") if weekly else F.window("published_at", "1 day")
    return stories.groupBy(window.alias("w"), "source_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_official").alias("official")).select(
        F.date_format("w.start", "yyyy-MM-dd").alias("window_start"), "source_name", "n", "official")
