"""Regulator calendar sync: rows, tags, scores, upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from signaldesk.functions import classify as C, dates as D, scores as M
from signaldesk.operators import ranking as RK, sync, tagging as G
from signaldesk.runtime import staged
from signaldesk.sources.payloads import calendar_rows

COMPARED = ["title", "starts_at", "ends_at", "committee_name", "summary_text", "company_tag_ids", "priority_reason",
            "importance_score", "market_cap_score", "composite_score"]


def enrich(rows: DataFrame, companies: DataFrame, as_of, details: DataFrame | None = None) -> DataFrame:
    """Tag and score calendar rows; ``details`` (canonical_url, detail_title, detail_text) overrides when present."""
    # The cells are parsed once and the texts tagged once; later branches read what was written.
    rows = staged(rows, "calendar-rows")
    if details is not None:
        rows = rows.join(details, "canonical_url", "left").withColumns({
            "title": F.coalesce(F.nullif(F.col("detail_title"), F.lit("")), "title"),
            "summary_text": F.coalesce(F.nullif(F.col("detail_text"), F.lit("")), "context_text")})
    else:
        rows = rows.withColumn("summary_text", F.col("context_text"))
    text = F.concat_ws("\n", F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("summary_text"), F.lit("")),
                       F.nullif(F.col("context_text"), F.lit("")))
    active = companies.filter("is_active")
    tags = G.tag_entities(rows.select("canonical_url", text.alias("_text")), "canonical_url", "_text", G.alias_dictionary(active))
    tagged = G.with_found_tags(rows, "canonical_url", staged(tags, "calendar-tags"))
    scored = G.best_tag_score(tagged, "canonical_url", "company_tag_ids", RK.market_percentiles(companies),
                              out="market_cap_score")
    scored = scored.withColumn("importance_score", M.calendar_importance(
        "title", "committee_name", "starts_at", "market_cap_score", as_of))
    return scored.withColumns({
        "composite_score": M.calendar_composite("starts_at", "market_cap_score", "importance_score", as_of),
        "priority_reason": C.calendar_reason("starts_at", "company_tag_ids", "market_cap_score", as_of),
        "freshness_bucket": D.freshness_bucket("starts_at", as_of, True)})


def sync_calendar(raw: DataFrame, base_url: str, ordinal: str, stored: DataFrame, companies: DataFrame, as_of) -> DataFrame:
    events = enrich(calendar_rows(raw, base_url, ordinal), companies, as_of)
    return sync.upsert_actions(events, stored, ["canonical_url"], COMPARED, ("summary_text",))
