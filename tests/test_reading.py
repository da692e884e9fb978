"""Queues and snapshots read the texts of the rows they need, and join what they need of them."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from signaldesk.plans import enrichment as ENR


def test_a_queue_asks_for_the_texts_of_its_rows(spark):
    bodies = spark.createDataFrame([(1, "merger"), (2, "none"), (3, "merger")], "item_id long, body string")
    rows = spark.createDataFrame([(1,), (2,)], "item_id long")
    asked = lambda r: bodies.join(r.select("item_id"), "item_id", "left_semi")
    got = ENR.read(rows, asked, lambda m: m + F.lit(1.0))
    assert got.columns == ["item_id", "priority"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ENR.read(rows, bodies, lambda m: m + F.lit(1.0)).collect()))


def test_the_snapshot_meets_latest_filings_before_their_texts(spark):
    plan = E.queries()["ds_13_company_snapshot"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi, (filing_id" in plan
