"""Structured Streaming runs over the event and order files, read as streams."""

from pyspark.sql import functions as F

from signaldesk.catalog import query, sqltext as S
from signaldesk.catalog.q_aggregates import USAGE_SQL
from signaldesk.runtime import scratch_dir
from signaldesk.sources import views as V
from signaldesk.streaming import flows as ST


def _deliveries(spark, df, key: str, label: str, batches: int = 4) -> tuple[str, int]:
    """The table as files, with every third row delivered a second time in another file, and the files of one batch.

    Each part of the table is its own file, so files and the tasks of a batch grow with the table.
    """
    path = scratch_dir(spark, label)
    (df if df.rdd.getNumPartitions() >= batches else df.repartition(batches, key)).write.parquet(path)
    df.filter(F.col(key) % 3 == 0).write.mode("append").parquet(path)
    return path, -(-len(spark.read.parquet(path).inputFiles()) // batches)


@query("stm_1_incremental_ingest", S.sql("""
    SELECT news_id, event_type, dedupe_group_id, source_type FROM news WHERE news_id % 7 <> 0""", "news"))
def _(spark, sf):
    # Four batches of files; some stories come twice, and every seventh is stored already.
    events = V.table(spark, sf, "events")
    path, (files, each) = scratch_dir(spark, "ingest"), _deliveries(spark, events, "event_id", "feed")
    rows = V.news_from(ST.file_stream(spark, files, each)).select("news_id", "published_at", "event_type", "dedupe_group_id", "source_type")
    stored = events.filter("event_id % 7 = 0").select(F.col("event_id").alias("news_id"))
    ST.run_available(rows, ST.append_new(path, "news_id", "published_at", stored, buckets=16), scratch_dir(spark, "ingest-state"))
    return ST.appended(spark, path).select("news_id", "event_type", "dedupe_group_id", "source_type")


@query("stm_2_incremental_upsert", S.sql("""
    , o AS (SELECT event_id, composite_score + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS composite_score FROM calendar WHERE title <> 'Public workshop on labeling')
    SELECT n.event_id, n.composite_score, CASE WHEN o.event_id IS NULL THEN 'insert' WHEN n.composite_score <> o.composite_score THEN 'update' ELSE 'unchanged' END AS action
    FROM calendar n LEFT JOIN o ON o.event_id = n.event_id""", "calendar"))
def _(spark, sf):
    path, (files, each) = scratch_dir(spark, "snapshot"), _deliveries(spark, V.table(spark, sf, "orders"), "o_orderkey", "orders")
    stored = V.calendar(spark, sf).filter("title <> 'Public workshop on labeling'").select(
        "event_id", "title", (F.col("composite_score") + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)).alias("composite_score"))
    incoming = V.calendar_from(ST.file_stream(spark, files, each)).select("event_id", "title", "composite_score")
    ST.run_available(incoming, ST.upsert_snapshot(path, ["event_id"], ["title", "composite_score"], stored, buckets=16), scratch_dir(spark, "snapshot-state"))
    schema = ", ".join(f"{c} {t}" for c, t in stored.dtypes)
    # A row that came twice was unchanged the second time: the first action counts.
    first = ST.actions(spark, path).groupBy("event_id").agg(F.min_by("action", "batch").alias("action"))
    return ST.snapshot(spark, path, ["event_id"], schema).join(first, "event_id").select("event_id", "composite_score", "action")


@query("stm_3_usage_totals", S.sql(USAGE_SQL + """
    SELECT CAST(usage_date AS VARCHAR) AS usage_date, kind, sum(calls)::BIGINT AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens,
      sum(micro_usd)::BIGINT AS micro_usd FROM pm GROUP BY 1, 2""", "usage_log"))
def _(spark, sf):
    path = scratch_dir(spark, "usage")
    totals = ST.usage_totals(V.usage_from(ST.file_stream(spark, f"{sf}/events.parquet")))
    ST.run_available(totals, ST.overwrite_latest(path), scratch_dir(spark, "usage-state"), "complete")
    return ST.latest_version(spark, path).select(F.col("usage_date").cast("string").alias("usage_date"), "kind", "calls",
                                                 "prompt_tokens", "micro_usd")


@query("stm_4_window_counts", S.sql("""
    SELECT 'day' AS unit, strftime(published_at, '%Y-%m-%d') AS window_start, source_name, count(*) AS n, count(*) FILTER (is_official) AS official FROM news0 GROUP BY ALL
    UNION ALL SELECT 'week', strftime(date_trunc('week', published_at), '%Y-%m-%d'), source_name, count(*), count(*) FILTER (is_official) FROM news0 GROUP BY ALL""",
                                    "news0"))
def _(spark, sf):
    parts = []
    for unit, weekly in (("day", False), ("week", True)):
        path = scratch_dir(spark, f"windows-{unit}")
        counts = ST.window_counts(V.news_from(ST.file_stream(spark, f"{sf}/events.parquet")), weekly)
        ST.run_available(counts, ST.overwrite_latest(path), scratch_dir(spark, f"windows-{unit}-state"), "complete")
        parts.append(ST.latest_version(spark, path).withColumn("unit", F.lit(unit)))
    return parts[0].unionByName(parts[1])
