"""News jobs: ingest, retag and rerank, deduplicated lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from signaldesk.functions import classify as C, dates as D, scores as M, text as T
from signaldesk.operators import filters as O, ranking as RK, sync, tagging as G
from signaldesk.sources import pages as P
from signaldesk.runtime import probe, staged


def score(news: DataFrame, companies: DataFrame, as_of) -> DataFrame:
    """Market, importance and composite scores, freshness and reason for every story.

    Expects body (text) or its keyword score (words), summary_importance for complete rows, tags and event type.
    """
    pct = RK.market_percentiles(companies)
    rows = G.best_tag_score(news, "news_id", "company_tag_ids", pct, out="market").withColumn(
        "recency", D.recency_score("published_at", as_of))
    done = M.news_complete("summary_importance", "source_weight", "market", "recency", F.size("mentioned") > 0)
    words = "words" if "words" in rows.columns else M.news_words("title", "body")
    wait = M.news_pending(words, "source_weight", "market", "recency")
    is_done = F.col("status") == "complete"
    rows = rows.drop(*done).select("*", *[F.when(is_done, done[n]).otherwise(wait[n]).alias(n) for n in done])
    return rows.withColumns({
        "freshness_bucket": D.freshness_bucket("published_at", as_of),
        "priority_reason": C.news_reason("event_type", "is_official", "source_weight", "company_tag_ids", "market_cap_score",
                                         "importance_score", "recency"),
    })


def classify(news: DataFrame) -> DataFrame:
    """Event type and duplicate group from title, body, topics and tags."""
    typed = news.withColumn("event_type", C.news_event_type("title", "body", "topic_tags"))
    return typed.withColumn("dedupe_group_id", C.news_dedupe_id("company_tag_ids", "event_type", "title", "published_at"))


def latest_articles(pages: DataFrame) -> DataFrame:
    """(canonical_url, page_text, page_time) of the last version of each page; pages: url, html, fetched_at.

    The markup becomes text and time where it is read; only they are compared and joined.
    """
    read = pages.select(T.canonical_url("url").alias("canonical_url"), "fetched_at", F.nullif(P.article_text("url", "html"), F.lit("")).alias("page_text"),
                        P.published_time("html").alias("page_time"))
    order = [F.col("fetched_at").desc_nulls_last(), F.col("page_time").desc_nulls_last(), F.col("page_text").desc_nulls_last()]
    return RK.top_n(read, ["canonical_url"], order, 1).drop("fetched_at")


def ingest(entries: DataFrame, stored: DataFrame, companies: DataFrame, as_of, aliases: DataFrame | None = None,
           pages: DataFrame | None = None) -> DataFrame:
    """Feed entries to new, tagged, classified, scored stories.

    ``entries``: entry_id, title, link, summary, published (and ``updated``, where a feed has it), and the feed's
    source_name, source_weight, feed_tags, source_type, is_official, seed_company_id.  ``stored``: canonical_url,
    article_hash.  ``pages``: fetched pages (url, html, fetched_at); a page's text and time go before the feed's own.
    The feed's own company leads the tags and the mentions.
    """
    rows = entries.withColumns({
        "title": T.inline_text("title"), "canonical_url": T.canonical_url("link"),
        "excerpt": F.nullif(T.inline_text("summary"), F.lit("")),
    }).filter(~C.is_promotional("title"))
    rows = rows.withColumn("article_hash", T.content_hash("canonical_url", "title"))
    fresh = staged(sync.new_by_either(rows, stored, ("canonical_url", "article_hash"), "entry_id"), "news-fresh")
    if pages is None:
        fresh = fresh.withColumns({"page_text": F.lit(None).cast("string"), "page_time": F.lit(None).cast("timestamp")})
    else:
        fresh = fresh.join(latest_articles(pages), "canonical_url", "left")
    stated = [D.parse_published(c) for c in ("published", "updated") if c in entries.columns]
    fresh = fresh.withColumns({
        "news_id": F.col("entry_id"),
        "body": F.coalesce("page_text", "excerpt", "title"),
        "published_at": F.coalesce("page_time", *stated, D.at(as_of)),
        "status": F.lit("pending"), "summary_importance": F.lit(0.0),
    })
    # What a text decides is found where it meets its story; the text is written once and takes part in no later join.
    fresh = fresh.withColumn("topic_tags", C.merged_topics("feed_tags", C.news_topics("title", "body"))).withColumns({
        "event_type": C.news_event_type("title", "body", "topic_tags"), "words": M.news_words("title", "body")})
    fresh = staged(fresh.drop("page_text"), "news-read")
    known = companies.filter("is_active")
    aliases = G.alias_dictionary(known) if aliases is None else aliases
    tags = staged(G.tag_entities(fresh.select("news_id", F.concat_ws("\n", "title", "body").alias("_t")), "news_id", "_t", aliases), "news-tags")
    seeds = companies.select(F.col("company_id").alias("seed_company_id"), F.col("name").alias("seed_name")).join(
        fresh.select("seed_company_id").distinct(), "seed_company_id", "left_semi")
    fresh = probe(G.with_found_tags(fresh, "news_id", tags), seeds, "seed_company_id", "left").withColumns({
        "company_tag_ids": G.seed_first("seed_company_id", "company_tag_ids"), "mentioned": G.seed_first("seed_name", "mentioned"),
        # The feed's own class wins; else it follows the source and address.
        "is_official": F.when(F.col("source_type").isNotNull(), F.col("is_official")).otherwise(
            C.news_source_type("source_name", "canonical_url") == "regulator"),
    }).withColumn("source_type", F.coalesce("source_type", C.news_source_type("source_name", "canonical_url")))
    grouped = fresh.withColumn("dedupe_group_id", C.news_dedupe_id("company_tag_ids", "event_type", "title", "published_at"))
    return score(grouped, companies, as_of).drop("words")


def retag(news: DataFrame, companies: DataFrame, as_of, recent_days: int | None = None, focus=None,
          limit: int | None = None) -> DataFrame:
    """Tag stored stories again, reclassify and rescore; ``changed`` marks new tags.

    A feed-given official source stays official.  ``focus`` (company ids) keeps
    stories whose old or new tags meet it; ``limit`` takes the newest of those.
    """
    rows = news if recent_days is None else O.recent(news, "published_at", as_of, recent_days)
    old = rows.withColumnRenamed("company_tag_ids", "old_tags")
    texts = old.select("news_id", F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))).alias("_t"))
    tags = G.tag_entities(texts, "news_id", "_t", G.alias_dictionary(companies.filter("is_active")))
    new = old.join(tags, "news_id", "left").withColumns({
        "company_tag_ids": F.coalesce("company_tag_ids", F.array().cast("array<bigint>")),
        "mentioned": F.coalesce("mentioned", F.array().cast("array<string>"))})
    if focus is not None:
        new = O.focus_scope(new, "old_tags", "company_tag_ids", focus)
    if limit is not None:
        new = new.orderBy(F.col("published_at").desc(), F.col("news_id").desc()).limit(limit)
    new = new.withColumn("changed", ~F.col("old_tags").eqNullSafe(F.col("company_tag_ids")))
    regulator = C.news_source_type("source_name", "canonical_url") == "regulator"
    official_pr = F.col("source_type") == "official_company_pr"
    new = new.withColumns({
        "is_official": F.when(official_pr, F.col("is_official")).otherwise(regulator),
        "source_type": F.when(official_pr, F.col("source_type")).otherwise(C.news_source_type("source_name", "canonical_url"))})
    return score(staged(classify(new), "news-retagged"), companies, as_of)


def list_news(news: DataFrame, as_of, sort: str = "importance", limit: int = 50, offset: int = 0, source: str | None = None,
              text: str | None = None, recent_days: int | None = None, members: DataFrame | None = None) -> DataFrame:
    """Ranked page of representative stories: ids are ranked on narrow columns, wide rows fetched after."""
    rows = O.facets(news, source_name=source)
    if text:
        rows = O.search(rows, text, *[c for c in ("title", "content_text", "excerpt") if c in rows.columns])
    if recent_days is not None:
        rows = O.recent(rows, "published_at", as_of, recent_days)
    if members is not None:
        rows = O.overlapping(rows, "company_tag_ids", members, "news_id")
    narrow = rows.select("news_id", "dedupe_group_id", "is_official", "composite_score", "published_at", "event_type")
    chosen = RK.representatives(narrow).withColumn("relevance", M.personal_relevance(
        "composite_score", D.recency_score("published_at", as_of), "is_official", F.lit(members is not None), "event_type"))
    order = {
        "importance": RK.importance_order("published_at", "news_id"),
        "freshness": RK.freshness_order("published_at", "news_id"),
        "personal": RK.personal_order("published_at", "news_id"),
    }[sort]
    best = RK.page(chosen, order, limit, offset)
    from pyspark.sql import Window

    ids = best.select("news_id", "relevance", (F.row_number().over(Window.orderBy(*order)) + offset).alias("pos"))
    return RK.refetch(news, ids, "news_id")
