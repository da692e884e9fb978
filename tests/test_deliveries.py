"""Streams are fed by files that grow in number with the table, in a fixed number of batches."""

from signaldesk.catalog.q_streams import _deliveries


def test_files_grow_with_the_table(spark):
    path, each = _deliveries(spark, spark.range(0, 999, 1, 12), "id", "grown")
    files = spark.read.parquet(path).inputFiles()
    assert len(files) >= 24 and each == -(-len(files) // 4)
    rows = spark.read.parquet(path)
    assert rows.count() == 999 + 333 and rows.distinct().count() == 999
