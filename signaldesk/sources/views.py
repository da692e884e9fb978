"""Domain tables derived from the given parquet tables.

Every view keeps its whole input: rows are mapped or joined, never sampled.
Long text stays in its own table, keyed by id, so that ranking never reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from signaldesk.functions import classify as C
from signaldesk.functions import text as T
from signaldesk.functions.scores import calendar_composite, calendar_importance, cents

AS_OF_FILINGS = "2000-06-01 00:00:00"
AS_OF_NEWS = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(key: Column, *values) -> Column:
    """Value number ``key mod len(values)``."""
    out = F.when(key % len(values) == 0, F.lit(values[0]))
    for i, value in enumerate(values[1:], 1):
        out = out.when(key % len(values) == i, F.lit(value))
    return out


def look_up(key: Column, mapping: dict) -> Column:
    items = list(mapping.items())
    out = F.when(key == items[0][0], F.lit(items[0][1]))
    for k, v in items[1:]:
        out = out.when(key == k, F.lit(v))
    return out


SIC_BY_SEGMENT = {"BUILDING": "2834", "MACHINERY": "2836", "AUTOMOBILE": "3841", "FURNITURE": "7372",
                  "HOUSEHOLD": "8731"}
FILING_FORMS = ("10-K", "10-Q", "10-Q/A", "20-F", "40-F", "8-K", "6-K", "S-1")
FILING_TITLES = (
    "Quarterly results and earnings guidance", "FDA approval received for lead program", "Phase 3 topline data",
    "Manufacturing restructuring plan", "Commercial launch partnership", "Acquisition and merger agreement",
    "Warning letter and layoff notice", "Annual report", "Change in chief executive leadership",
    "Financing and offering of shares", None,
)
FILING_ITEMS = ("2.02, 9.01", "5.02", "1.01 and 9.01", "7.01", None)
FILING_STATUS = {"F": "complete", "O": "pending", "P": "failed"}
NEWS_WEIGHT = {"click": 0.95, "error": 0.9, "purchase": 0.92, "view": 0.85, "signup": 0.98}
NEWS_TITLES = (
    "FDA approves new therapy", "Quarterly earnings and guidance raised", "Topline phase 3 data released",
    "Licensing agreement announced", "Merger talks confirmed", "CEO appointed to board", "New plant opens",
    "Weekly roundup of notes", "Sponsored webinar invitation",
)
NEWS_EXCERPTS = (None, "Trial study update.", "Financing plan and supply notes")
NEWS_STATUS = ("complete", "pending", "failed", "stale")
USAGE_KIND = {"click": "filing", "error": "news", "purchase": "override", "signup": "diff", "view": "digest"}
USAGE_MODELS = ("gpt-5.4-mini-2026", "gpt-5.4", "other-model")
TRIAL_PHASES = ("Phase 3", "Phase 2/Phase 3", "Phase 2", "Phase 1/Phase 2", "Phase 1", "Early Phase 1", "Phase 4",
                "Not Applicable", None)
TRIAL_STATUS = {"ECONOMY": "Recruiting", "STANDARD": "Completed", "PROMO": "Active, not recruiting",
                "SMALL": "Terminated", "MEDIUM": "Not yet recruiting", "LARGE": "Withdrawn"}
COMMITTEES = {"1-URGENT": "Oncologic Drugs", "2-HIGH": "Vaccines", "3-MEDIUM": "Cardiovascular",
              "4-NOT SPECIFIED": "Gastrointestinal Drugs"}


def companies(spark, sf) -> DataFrame:
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    key = F.col("c_custkey")
    return customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("company_id"),
        F.lpad(key.cast("string"), 10, "0").alias("cik"),
        F.concat(F.lit("T"), key.cast("string")).alias("ticker"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("exchange"),
        look_up(F.col("c_mktsegment"), SIC_BY_SEGMENT).alias("sic"),
        F.when(F.col("c_acctbal") > 0, F.round(F.col("c_acctbal") * 1e6).cast("bigint")).alias("market_cap"),
        (F.col("c_nationkey") != 7).alias("is_active"),
    )


def filings(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    base = o.select(
        key.alias("filing_id"),
        F.col("o_custkey").alias("company_id"),
        F.concat(F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("-00-"),
                 F.lpad(key.cast("string"), 12, "0")).alias("accession_number"),
        pick(key, *FILING_FORMS).alias("form_type"),
        F.col("o_orderdate").cast("timestamp").alias("filed_at"),
        look_up(F.col("o_orderstatus"), FILING_STATUS).alias("status"),
        (key % 4).cast("int").alias("attempts"),
        cents(F.col("o_totalprice") % 100).alias("importance_score"),
        cents(F.col("o_totalprice") % 89).alias("impact_score"),
        cents(F.col("o_totalprice") % 97).alias("composite_score"),
        (key % 5).cast("int").alias("risk_n"),
        (key % 3).cast("int").alias("opp_n"),
        pick(key, *FILING_TITLES).alias("title"),
        pick(key, *FILING_ITEMS).alias("items"),
        pick(key, "sec_poll", "historical_backfill").alias("ingest_origin"),
    )
    with_forms = base.withColumns({
        "normalized_form_type": T.normalize_form("form_type"),
        "item_numbers": T.item_numbers("items"),
        "summary": F.when((F.col("status") == "complete") & F.col("title").isNotNull(),
                          F.concat(F.lit("Summary of "), F.col("title"))),
    })
    return with_forms.withColumn(
        "event_type", C.filing_event_type("normalized_form_type", "item_numbers", "title", F.lit(None).cast("string")))


def documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def filing_heads(spark, sf) -> DataFrame:
    """Filings with the number of the document that holds their text."""
    return filings(spark, sf).withColumn("doc_id", F.col("filing_id") % documents(spark, sf).agg(F.max("doc_id") + 1).scalar())


def filing_text(spark, sf, *columns: str, ids: DataFrame | None = None, read: Callable[[str], Column] | None = None) -> DataFrame:
    """Raw text per filing: its title line and the document its number maps to.

    Many filings share a document.  ``columns`` of the filing come along, and ``ids`` (filing_id) cuts the narrow side, so
    that no text of a filing takes part in a second join: only the documents themselves are exchanged, once.  With ``read`` each
    document is read once and what that makes of it stands for its text, so that work on texts grows with the documents.
    """
    docs = documents(spark, sf)
    if read is not None:
        docs = docs.select("doc_id", read("text").alias("text"))
    columns = list(dict.fromkeys(columns or ("company_id", "normalized_form_type", "filed_at")))
    f = filing_heads(spark, sf).select("filing_id", "doc_id", "title", *[c for c in columns if c != "title"])
    if ids is not None:
        f = f.join(ids.select("filing_id").distinct(), "filing_id", "left_semi")
    # The narrow side is spread on the join key with a fixed task count: a large
    # text side then joins without a second shuffle, and a small one is
    # broadcast to as many tasks as the session allows.
    f = f.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return f.join(docs, "doc_id").select(
        "filing_id", *columns,
        F.concat_ws("\n", F.col("title"), F.col("text")).alias("raw_text"))


def news(spark, sf) -> DataFrame:
    return news_from(table(spark, sf, "events"))


def news_from(e: DataFrame) -> DataFrame:
    """Stories from event rows (a table or a stream)."""
    key, user = F.col("event_id"), F.col("user_id")
    base = e.select(
        key.alias("news_id"),
        F.col("ts").cast("timestamp").alias("published_at"),
        F.col("event_type").alias("source_name"),
        look_up(F.col("event_type"), NEWS_WEIGHT).alias("source_weight"),
        F.when(key % 6 == 0, F.array().cast("array<bigint>"))
        .otherwise(F.array_distinct(F.array(user, (user * 7 + 3) % 150))).alias("company_tag_ids"),
        (F.col("event_type") == "signup").alias("is_official"),
        F.col("value").alias("composite_score"),
        pick(key, *NEWS_TITLES).alias("title"),
        pick(key, *NEWS_EXCERPTS).alias("excerpt"),
        F.concat(F.lit("https://news.example.com/"), F.col("event_type"), F.lit("/"), key.cast("string"))
        .alias("canonical_url"),
        pick(key, *NEWS_STATUS).alias("status"),
        (key % 5).cast("int").alias("attempts"),
    )
    tagged = base.withColumn("topic_tags", C.news_topics("title", "excerpt")).withColumn(
        "event_type", C.news_event_type("title", "excerpt", "topic_tags"))
    return tagged.withColumns({
        "source_type": C.news_source_type("source_name", "canonical_url"),
        "summary": F.when(F.col("status") == "complete", F.concat(F.lit("Summary of "), F.col("title"))),
        "dedupe_group_id": C.news_dedupe_id("company_tag_ids", "event_type", "title", "published_at"),
    })


def trials(spark, sf) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        key.alias("trial_id"),
        F.concat(F.lit("NCT"), F.lpad(key.cast("string"), 8, "0")).alias("nct_id"),
        (key % 150).alias("company_id"),
        F.concat(F.col("p_name"), F.lit(" study "), key.cast("string")).alias("title"),
        pick(F.col("p_size"), *TRIAL_PHASES).alias("phase"),
        look_up(F.col("p_type"), TRIAL_STATUS).alias("status"),
        F.date_add(F.lit("1998-01-01").cast("date"), (key % 1000).cast("int")).alias("start_date"),
        F.date_add(F.lit("2000-01-01").cast("date"), (key * 7 % 700).cast("int")).alias("primary_completion_date"),
        F.when(key % 13 != 0, F.date_add(F.lit("1999-01-01").cast("date"), (key * 3 % 510).cast("int")))
        .alias("last_update_date"),
        (F.col("p_size") * 10).alias("enrollment"),
        F.lit("Interventional").alias("study_type"),
    )


def studies(spark, sf) -> DataFrame:
    return trials(spark, sf).select(
        "nct_id", F.col("title").alias("brief_title"), "phase", F.col("status").alias("overall_status"),
        "start_date", "primary_completion_date", F.col("last_update_date").alias("last_update_posted_date"),
        "enrollment", "study_type")


def sponsors(spark, sf) -> DataFrame:
    # Hardly a pair repeats: they are dealt first, so that no task holds those of its whole split.
    pairs = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").repartition("l_partkey", "l_suppkey").distinct()
    s = table(spark, sf, "supplier").select("s_suppkey", _sponsor_name().alias("name"))
    return pairs.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_suppkey").alias("id"),
        F.concat(F.lit("NCT"), F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("nct_id"),
        "name",
        F.when((F.col("l_partkey") + F.col("l_suppkey")) % 3 == 0, "lead").otherwise("collaborator")
        .alias("lead_or_collaborator"),
    )


def _digits() -> Column:
    return F.regexp_extract(F.col("s_name"), r"#(\d+)$", 1)


def _sponsor_name() -> Column:
    key = F.col("s_suppkey")
    return F.concat(F.lit("Supplier "), _digits(), pick(key, " Inc", " Research", ""))


def conditions(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        F.concat(F.lit("NCT"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("nct_id"),
        F.explode(F.array("p_brand", "p_type")).alias("name"))


def interventions(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        F.concat(F.lit("NCT"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("nct_id"),
        F.explode(F.split("p_name", " ")).alias("name"))


def sponsor_companies(spark, sf) -> DataFrame:
    """Issuers whose names and aliases are spelled unlike the registry's sponsors."""
    key, digits = F.col("s_suppkey"), _digits()
    name = (
        F.when(key % 5 == 0, F.upper(_sponsor_name()))
        .when(key % 5 == 1, F.concat(F.lit("Supplier-"), digits, F.lit(" (Inc)")))
        .when(key % 5 == 2, F.concat(F.lit("Supplier "), digits, F.lit(" Ltd")))
        .when(key % 5 == 3, F.concat(F.lit("Supplier "), digits))
        .otherwise(F.concat(digits, F.lit(" Research")))
    )
    return table(spark, sf, "supplier").select(
        key.alias("company_id"), F.concat(F.lit("S"), key.cast("string")).alias("ticker"), name.alias("name"),
        F.array(F.concat(F.lit("S"), key.cast("string")), F.lit("Gen"), F.concat(digits, F.lit(" Research")))
        .alias("aliases"),
        F.when(key % 7 == 0, F.array(F.concat(F.lit("Supplier "), digits, F.lit(" Research"))))
        .otherwise(F.array().cast("array<string>")).alias("trial_aliases"),
    )


def calendar(spark, sf) -> DataFrame:
    return calendar_from(table(spark, sf, "orders"))


def calendar_from(o: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    committee = look_up(F.col("o_orderpriority"), COMMITTEES)
    base = o.select(
        key.alias("event_id"),
        F.col("o_orderdate").cast("timestamp").alias("starts_at"),
        F.coalesce(
            F.concat(F.lit("Meeting of the "), committee, F.lit(" Advisory Committee Meeting Announcement")),
            F.lit("Public workshop on labeling")).alias("title"),
        F.array("o_custkey").alias("company_tag_ids"),
        F.concat(F.lit("https://calendar.example.org/event/"), key.cast("string")).alias("canonical_url"),
        pick(key, None, "Agenda notes", "Agenda notes", "Agenda notes").alias("summary_text"),
    ).withColumn("committee_name", T.committee_name("title"))
    scored = base.withColumn("importance_score", calendar_importance(
        "title", "committee_name", "starts_at", F.lit(0.0), AS_OF_FILINGS))
    return scored.withColumn("composite_score", calendar_composite(
        "starts_at", F.lit(0.0), "importance_score", AS_OF_FILINGS))


def watchlists(spark, sf) -> DataFrame:
    return table(spark, sf, "region").select(F.col("r_regionkey").alias("watchlist_id"), F.col("r_name").alias("name"))


def watchlist_members(spark, sf) -> DataFrame:
    """One row per (watchlist, company): the long form scales, an array would not."""
    c = table(spark, sf, "customer").filter(F.col("c_mktsegment") == "MACHINERY")
    n = table(spark, sf, "nation")
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("watchlist_id"), F.col("c_custkey").alias("company_id"))


def usage_log(spark, sf) -> DataFrame:
    return usage_from(table(spark, sf, "events"))


def usage_from(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    units = F.floor(F.col("value") * 100).cast("bigint")
    return e.select(
        F.col("event_id").alias("call_id"),
        F.col("ts").cast("timestamp").alias("used_at"),
        look_up(F.col("event_type"), USAGE_KIND).alias("kind"),
        pick(k, *USAGE_MODELS).alias("model"),
        F.when(F.col("event_id") % 10 == 0, 0).otherwise(1).cast("bigint").alias("calls"),
        units.alias("prompt_tokens"),
        F.floor(units * 0.3).cast("bigint").alias("completion_tokens"),
        F.floor(units * 0.05).cast("bigint").alias("reasoning_tokens"),
        F.floor(units * 0.2).cast("bigint").alias("cached_input_tokens"),
    )


def alias_source(spark, sf) -> DataFrame:
    """Benchmark items as companies; the alias is the first three words of the passage."""
    b = table(spark, sf, "benchmark")
    words = F.slice(F.split(T.entity_text("text"), " "), 1, 3)
    return b.select(F.col("item_id").alias("company_id"), F.array_join(words, " ").alias("name"))


def pages(spark, sf) -> DataFrame:
    return table(spark, sf, "pages")
