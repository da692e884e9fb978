"""Which pending items get enriched next: the best of the whole queue, then budgeted admission."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from signaldesk import constants as K
from signaldesk.functions import classify as C, dates as D, scores as M
from signaldesk.operators import admission, filters as O, ranking as RK, tagging as G
from signaldesk.runtime import staged


def order(first: str = "priority") -> list[Column]:
    """By priority; ties by the metadata priority, then the newest, then the highest id."""
    return [F.col(c).desc() for c in (first, "cheap", "ts", "item_id")]


def reading_list(rows: DataFrame, texts: DataFrame, classes: list[str], k: int, score: Callable[[Column], Column]) -> DataFrame:
    """Rows whose text may put them among the ``k`` best of their class.

    ``score`` maps a material score to the priority and rises with it, so a row's priority lies between that of no and of
    full material.  The rows with the best upper bounds are scored first; a row whose bound does not reach the k-th best
    priority found (or the k-th best lower bound) is never read.
    """
    bounded = staged(rows.withColumns({"low": score(F.lit(0.0)), "high": score(F.lit(100.0))}), "bounds")
    first = read(RK.top_n(bounded, classes, order("high"), k), texts, score)
    sure = RK.top_n(bounded, classes, order("low"), k).select(*classes, F.col("low").alias("priority"))
    kth = [part.groupBy(*classes).agg(F.count("*").alias("n"), F.min("priority").alias("kth")).where(F.col("n") >= k) for part in (first.select(*classes, "priority"), sure)]
    reach = kth[0].unionByName(kth[1]).groupBy(*classes).agg(F.max("kth").alias("kth"))
    open_ = bounded.join(reach, classes, "left").where(F.col("kth").isNull() | (F.col("high") >= F.col("kth")))
    return staged(open_.drop("low", "high", "kth"), "open")


def read(rows: DataFrame, texts: DataFrame, score: Callable[[Column], Column]) -> DataFrame:
    """Rows with their priority by the whole text; texts: item_id, body, or a function that reads the bodies of given rows.

    A body becomes its keyword score where it is read; only that is joined to the rows.
    """
    found = texts(rows) if callable(texts) else texts
    material = found.select("item_id", M.material_score("body").alias("_material"))
    return rows.join(material, "item_id").withColumn("priority", score(F.col("_material"))).drop("_material")


def best_rows(rows: DataFrame, texts: DataFrame, classes: list[str], k: int, score: Callable[[Column], Column]) -> DataFrame:
    """The ``k`` best rows of every class over the whole queue, as if every text had been read."""
    return RK.top_n(read(reading_list(rows, texts, classes, k, score), texts, score), classes, order(), k)


def filing_queue(filings: DataFrame, companies: DataFrame, members: DataFrame, as_of) -> DataFrame:
    """The pending filings with what their priority needs but for the text."""
    queue = O.pending_queue(filings, "filed_at", as_of, K.FILING_BACKLOG_DAYS, "ingest_origin").select(
        F.lit("filing").alias("queue"), F.col("filing_id").alias("item_id"), "company_id", F.col("filed_at").alias("ts"),
        "normalized_form_type", "event_type", "title", "item_numbers")
    rows = O.flag_members(queue.join(RK.market_percentiles(companies), "company_id", "left"), members).withColumns({
        "market": F.coalesce("pct", F.lit(0.0)), "recency": D.recency_score("ts", as_of)})
    cheap = M.filing_cheap_priority("normalized_form_type", "title", F.lit(None).cast("string"), "event_type", "item_numbers", "market", "recency", "watched")
    return rows.select("queue", "item_id", "ts", "normalized_form_type", "market", "recency", "watched", cheap.alias("cheap"),
                       C.filing_override_eligible("normalized_form_type", "event_type", "watched").alias("eligible"),
                       C.filing_tier("normalized_form_type", "event_type", "watched").alias("tier"), F.lit(0).cast("bigint").alias("micro"))


def filing_score(material: Column) -> Column:
    return M.filing_queue_priority_of("normalized_form_type", material, "market", "recency", "watched")


def news_queue(news: DataFrame, companies: DataFrame, members: DataFrame, as_of) -> DataFrame:
    queue = O.pending_queue(news, "published_at", as_of, K.NEWS_BACKLOG_DAYS).select(
        F.lit("news").alias("queue"), F.col("news_id").alias("item_id"), F.col("published_at").alias("ts"), "source_weight", "excerpt", "event_type",
        "is_official", "company_tag_ids")
    rows = G.best_tag_score(queue, "item_id", "company_tag_ids", RK.market_percentiles(companies), out="market")
    rows = G.flag_watched(rows, members, "item_id").withColumn("recency", D.recency_score("ts", as_of))
    return rows.select("queue", "item_id", "ts", "source_weight", "market", "recency", "watched",
                       M.news_queue_priority("source_weight", "excerpt", "market", "recency", "watched").alias("cheap"),
                       C.news_override_eligible("is_official", "event_type", "watched").alias("eligible"),
                       C.news_tier("is_official", "event_type", "watched").alias("tier"), F.lit(0).cast("bigint").alias("micro"))


def news_score(material: Column) -> Column:
    return M.news_queue_priority_of("source_weight", material, "market", "recency") + F.when(F.col("watched"), 20.0).otherwise(0.0)


def filing_texts(texts: DataFrame) -> DataFrame:
    return texts.select(F.col("filing_id").alias("item_id"), F.col("raw_text").alias("body"))


def news_texts(news: DataFrame) -> DataFrame:
    body = F.coalesce("content_text", "excerpt") if "content_text" in news.columns else F.col("excerpt")
    return news.select(F.col("news_id").alias("item_id"), body.alias("body"))


def candidates(rows: DataFrame, texts: DataFrame, score: Callable[[Column], Column], k: int) -> DataFrame:
    """The ``k`` best items of a queue with their rank."""
    best = best_rows(rows, texts, ["queue"], k, score)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("queue").orderBy(*order())))


def selection(rows: DataFrame, texts: DataFrame, score: Callable[[Column], Column], kind: str, limit: int) -> DataFrame:
    """Items admitted under the day's fixed limits for the kind; every pending item is weighed."""
    d = K.DAILY_LIMITS
    bound = admission.class_bound(d[kind], d["override"], limit)
    best = best_rows(rows, texts, admission.CLASS, bound, score)
    return admission.admit(best, order(), d[kind], d["override"], d[f"{kind}_full_ai"], d[f"{kind}_short_ai"], limit)
