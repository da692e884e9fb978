"""The landing view: fresh and important items, highlights, calendar, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from signaldesk.operators import filters as O, ranking as RK
from signaldesk.plans import briefing as B, news as N
from signaldesk.plans.filings import list_filings


def dashboard(filings, news, trials, calendar, companies, watchlists, members, as_of_filings, as_of_news) -> DataFrame:
    """(section, pos, item) rows of every part of the view."""
    def section(df: DataFrame, name: str, item: Column, *order) -> DataFrame:
        pos = F.row_number().over(Window.orderBy(*order)) if order else F.col("pos")
        return df.select(F.lit(name).alias("section"), pos.cast("int").alias("pos"), item.cast("string").alias("item"))

    fid, nid = F.col("filing_id"), F.col("news_id")
    fresh = RK.freshness_order("filed_at", "filing_id")
    best = RK.importance_order("filed_at", "filing_id")
    latest_f = list_filings(filings, companies, as_of_filings, "freshness", 5, recent_days=1)
    top_f = list_filings(filings, companies, as_of_filings, "importance", 5, recent_days=90)
    latest_n = N.list_news(news, as_of_news, "freshness", 5, recent_days=1)
    top_n = N.list_news(news, as_of_news, "importance", 5, recent_days=14)
    soon = O.calendar_range(calendar, as_of_filings, 14, 180)
    soon_order = [F.col("starts_at").asc(), F.col("composite_score").desc(), F.col("event_id").desc()]
    recent_t = RK.page(trials, B.trial_order(), 5)
    # Highlights show the timeline's top three of every list.
    brief = B.watchlist_briefing(members.join(watchlists.select("watchlist_id"), "watchlist_id", "left_semi"), filings, news, trials,
                                 calendar, companies, as_of_filings, as_of_news, limit=3)
    shown = brief.filter((F.col("section") == "timeline") & (F.col("pos") <= 3)).select(
        F.concat(F.lit("highlights-"), F.col("watchlist_id").cast("string")).alias("section"), F.col("pos").cast("int").alias("pos"), "item")
    counts = B.table_counts({"companies": companies, "filings": filings, "news_items": news, "regulatory_events": calendar,
                             "clinical_trials": trials}).select(
        F.concat(F.lit("count-"), "table_name").alias("section"), F.lit(1).alias("pos"), F.col("n").cast("string").alias("item"))
    queue = B.queue_counts(filings, news, members, as_of_filings, as_of_news).select(
        F.concat(F.lit("queue-"), "queue").alias("section"), F.lit(1).alias("pos"),
        F.concat_ws("/", *[F.col(c).cast("string") for c in ("pending", "full_ai", "short_ai")]).alias("item"))
    return reduce(DataFrame.unionByName, [
        section(latest_f, "latest_filings", fid, *fresh), section(top_f, "important_filings", fid, *best),
        section(latest_n, "latest_news", nid), section(top_n, "important_news", nid),
        section(RK.page(soon, soon_order, 6), "calendar", F.col("event_id"), *soon_order),
        section(recent_t, "recent_trials", F.col("nct_id"), *B.trial_order()), shown, counts, queue])
