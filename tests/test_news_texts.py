"""News ingest: a page's text meets its story once and takes part in no later exchange."""

from pyspark.sql import functions as F

from signaldesk.plans import news as PN
from signaldesk.sources import views as V

ENTRY = ("entry_id long, title string, link string, summary string, published string, source_name string, source_weight double, feed_tags array<string>, "
         "source_type string, is_official boolean, seed_company_id long")


def test_scores_need_the_text_once(spark):
    companies = spark.createDataFrame([(1, "Acme", "ACM", 5, True), (2, "Bolt", "BLT", 9, True)], "company_id long, name string, ticker string, market_cap long, is_active boolean")
    entries = spark.createDataFrame([(1, "Merger news", "https://a.example/1", None, None, "click", 0.9, ["x"], "official_company_pr", True, 2),
                                     (2, "Notes", "https://a.example/2", "FDA approves", None, "click", 0.9, ["x"], None, False, None)], ENTRY)
    pages = spark.createDataFrame([("https://a.example/1?q", "<article>Acme wins phase 3 topline</article>", 1)], "url string, html string, fetched_at long")
    stored = spark.createDataFrame([], "canonical_url string, article_hash string")
    out = PN.ingest(entries, stored, companies, V.AS_OF_NEWS, pages=pages)
    rows = {r["news_id"]: r for r in out.collect()}
    assert rows[1]["body"] == "Acme wins phase 3 topline" and rows[2]["body"] == "FDA approves"
    assert rows[1]["company_tag_ids"] == [2, 1] and rows[1]["mentioned"] == ["Bolt", "Acme"] and rows[2]["company_tag_ids"] == []
    narrow = out.select("news_id", "event_type", "composite_score", "importance_score", F.size("company_tag_ids"), "dedupe_group_id", "priority_reason")
    assert "body#" not in narrow._jdf.queryExecution().executedPlan().toString()


def test_reason_goes_by_the_published_market_score(spark):
    """Among many companies some lie between 74.995 and 75: their score is published as 75.0, and the reason follows it."""
    companies = spark.range(30001).select(F.col("id").alias("company_id"), F.col("id").alias("market_cap") + 1, F.lit(True).alias("is_active")).toDF(
        "company_id", "market_cap", "is_active")
    news = spark.createDataFrame([(1, [22499]), (2, [22498])], "news_id long, company_tag_ids array<long>").select(
        "*", F.lit("t").alias("title"), F.lit("").alias("body"), F.lit(0.0).alias("summary_importance"), F.lit("pending").alias("status"),
        F.lit(0.5).alias("source_weight"), F.lit(None).cast("string").alias("event_type"), F.lit(False).alias("is_official"),
        F.array(F.lit("x")).alias("mentioned"), F.lit(V.AS_OF_NEWS).cast("timestamp").alias("published_at"))
    rows = {r["news_id"]: r for r in PN.score(news, companies, V.AS_OF_NEWS).collect()}
    assert rows[1]["market_cap_score"] == 75.0 and rows[1]["priority_reason"] == "very recent, relevant to large-cap company"
    assert rows[2]["market_cap_score"] == 74.99 and rows[2]["priority_reason"] == "very recent"
