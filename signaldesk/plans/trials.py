"""Trial jobs: archive pages and the sync from a relational registry mirror."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from signaldesk.operators import filters as O, ranking as RK, sponsors as P, sync
from signaldesk.plans.briefing import trial_order
from signaldesk.runtime import staged

COMPARED = ["title", "phase", "status", "conditions", "interventions", "sponsor", "start_date", "primary_completion_date",
            "last_update_date", "enrollment", "study_type"]


def archive(trials: DataFrame, companies: DataFrame, limit: int = 50, offset: int = 0, company_id=None, phase=None,
            status=None, text: str | None = None) -> DataFrame:
    """One page of trials, newest update first, with company name and ticker where known."""
    rows = O.facets(trials, company_id=company_id, phase=phase, status=status)
    if text:
        rows = O.search(rows, text, "title")
    paged = RK.page(rows, trial_order(), limit, offset)
    return paged.join(companies.select("company_id", F.col("name").alias("company_name"), "ticker"), "company_id", "left")


def matched_trials(studies: DataFrame, sponsors: DataFrame, conditions: DataFrame, interventions: DataFrame,
                   companies: DataFrame, as_of, recent_days: int = 365) -> DataFrame:
    """Current studies with their best matching company alias, shaped as stored trials."""
    scoped = P.current_studies(studies, as_of, recent_days)
    # Read by the matching, the lead sponsor and the list of names.
    in_scope = staged(sponsors.join(scoped.select("nct_id").hint("shuffle_hash"), "nct_id", "left_semi"), "scope-sponsors")
    best = P.best_matches(scoped, in_scope, P.sponsor_aliases(companies))
    rows = P.study_rows(scoped, in_scope, conditions, interventions)
    meta = F.create_map(F.lit("source_provider"), F.lit("relational_mirror"), F.lit("matched_alias"), F.col("matched_alias"),
                        F.lit("matched_sponsor_name"), F.col("matched_sponsor"), F.lit("match_score"), F.col("score").cast("string"))
    return rows.join(best, "nct_id").select(
        "company_id", "nct_id", F.coalesce(F.nullif(F.col("brief_title"), F.lit("")), F.lit("Untitled")).alias("title"), "phase",
        F.coalesce("overall_status", F.lit("Unknown")).alias("status"), "conditions", "interventions",
        F.col("lead_sponsor").alias("sponsor"), "start_date", "primary_completion_date",
        F.col("last_update_posted_date").alias("last_update_date"), "enrollment", "study_type", meta.alias("metadata"))


def sync_trials(incoming: DataFrame, stored: DataFrame, succeeded: DataFrame) -> DataFrame:
    return sync.snapshot_actions(incoming, stored, "company_id", "nct_id", COMPARED, succeeded, "metadata")
