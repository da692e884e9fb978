"""Aggregates: counts, usage, budgets, presets."""

from pyspark.sql import functions as F

from signaldesk import constants as K
from signaldesk.catalog import query, sqltext as S
from signaldesk.functions import classify as C, dates as D
from signaldesk.operators import filters as O, ranking as RK, tagging as G, usage as U
from signaldesk.plans import briefing as B
from signaldesk.sources import views as V

AF, AN = V.AS_OF_FILINGS, V.AS_OF_NEWS


@query("agg_1_table_counts", S.sql("""
    SELECT 'companies' AS table_name, count(*) AS n FROM companies UNION ALL SELECT 'filings', count(*) FROM filings0
    UNION ALL SELECT 'news_items', count(*) FROM news0 UNION ALL SELECT 'regulatory_events', count(*) FROM calendar0
    UNION ALL SELECT 'clinical_trials', count(*) FROM trials""", "companies", "filings0", "news0", "calendar0", "trials"))
def _(spark, sf):
    return B.table_counts({
        "companies": V.companies(spark, sf), "filings": V.filings(spark, sf), "news_items": V.news(spark, sf),
        "regulatory_events": V.calendar(spark, sf), "clinical_trials": V.trials(spark, sf)})


QUEUE_SQL = f"""
    , w AS (SELECT DISTINCT company_id FROM watchlist_members),
      hit AS (SELECT DISTINCT news_id FROM (SELECT news_id, unnest(company_tag_ids) AS c FROM news0) WHERE c IN (SELECT company_id FROM w)),
      qf AS (SELECT CASE WHEN normalized_form_type IN {S.listed(K.FILING_FULL_TIER_FORMS)} OR company_id IN (SELECT company_id FROM w)
          OR coalesce(event_type IN {S.listed(K.FILING_FULL_TIER_EVENTS)}, false) THEN 'full' ELSE 'short' END AS tier FROM filings
        WHERE status IN ('pending', 'failed', 'stale') AND attempts < 3 AND filed_at >= {S.AF} - INTERVAL 21 DAY AND ingest_origin = 'sec_poll'),
      qn AS (SELECT CASE WHEN is_official OR coalesce(event_type IN {S.listed(K.NEWS_FULL_TIER_EVENTS)}, false) OR news_id IN (SELECT news_id FROM hit)
          THEN 'full' ELSE 'short' END AS tier FROM news WHERE status IN ('pending', 'failed', 'stale') AND attempts < 3 AND published_at >= {S.AN} - INTERVAL 5 DAY)
    """


@query("agg_2_queue_counts", S.sql(QUEUE_SQL + """
    SELECT 'filings' AS queue, count(*) AS pending, count(*) FILTER (tier = 'full') AS full_ai, count(*) FILTER (tier = 'short') AS short_ai FROM qf
    UNION ALL SELECT 'news', count(*), count(*) FILTER (tier = 'full'), count(*) FILTER (tier = 'short') FROM qn""",
                                "filings", "news", "watchlist_members"))
def _(spark, sf):
    return B.queue_counts(V.filings(spark, sf), V.news(spark, sf), V.watchlist_members(spark, sf), AF, AN)


def _cost(model_col="model"):
    fam = "CASE WHEN {m} = 'gpt-5.4' OR ({m} LIKE 'gpt-5.4-%' AND {m} NOT LIKE 'gpt-5.4-mini%' AND {m} NOT LIKE 'gpt-5.4-nano%') THEN {a} WHEN {m} LIKE 'gpt-5.4-mini%' THEN {b} END"
    p = lambda a, b: "(" + fam.format(m=model_col, a=f"{a}::DOUBLE", b=f"{b}::DOUBLE") + ")"
    return (f"coalesce({S.rounded(f'greatest(prompt_tokens - cached_input_tokens, 0) * {p(2.5, 0.75)} / 1e6 + cached_input_tokens * {p(0.25, 0.075)} / 1e6 + completion_tokens * {p(15.0, 4.5)} / 1e6', 6)}, 0.0::DOUBLE)")


USAGE_SQL = f"""
    , pc AS (SELECT *, {_cost()} AS cost_usd FROM usage_log),
      pm AS (SELECT *, CAST(round(cost_usd * 1e6) AS BIGINT) AS micro_usd, CAST((used_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS usage_date FROM pc),
      nz AS (SELECT * FROM pm WHERE NOT (calls = 0 AND prompt_tokens = 0 AND completion_tokens = 0 AND reasoning_tokens = 0 AND cached_input_tokens = 0 AND micro_usd = 0)),
      dy AS (SELECT usage_date, kind, sum(calls)::BIGINT AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens,
        sum(reasoning_tokens)::BIGINT AS reasoning_tokens, sum(cached_input_tokens)::BIGINT AS cached_input_tokens, sum(micro_usd)::BIGINT AS micro_usd
        FROM nz GROUP BY 1, 2)
    """


def _calls(spark, sf):
    return U.priced(V.usage_log(spark, sf))


@query("mth_13_token_cost", S.sql(f"SELECT call_id, {_cost()} AS cost_usd FROM usage_log", "usage_log"))
def _(spark, sf):
    return _calls(spark, sf).select("call_id", "cost_usd")


@query("mth_13_token_cost_first", S.sql(f"""
    SELECT call_id, {_cost("CASE WHEN model LIKE 'gpt-5.4-%' THEN 'gpt-5.4' ELSE model END")} AS cost_usd FROM usage_log""", "usage_log"))
def _(spark, sf):
    return U.priced(V.usage_log(spark, sf), mode="first").select("call_id", "cost_usd")


@query("agg_3_daily_usage", S.sql(USAGE_SQL + " SELECT * REPLACE (CAST(usage_date AS VARCHAR) AS usage_date) FROM dy", "usage_log"))
def _(spark, sf):
    return U.daily_usage(_calls(spark, sf)).withColumn("usage_date", F.col("usage_date").cast("string"))


@query("agg_4_model_breakdown", S.sql(USAGE_SQL + """
    SELECT CAST(usage_date AS VARCHAR) AS usage_date, kind, string_agg(model || '=' || n || '/' || m, ',' ORDER BY model) AS models FROM
      (SELECT usage_date, kind, model, sum(calls)::BIGINT AS n, sum(micro_usd)::BIGINT AS m FROM nz GROUP BY ALL) GROUP BY 1, 2""", "usage_log"))
def _(spark, sf):
    b = U.model_breakdown(_calls(spark, sf))
    text = F.array_join(F.transform(F.map_entries("models"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"]["calls"].cast("string"), F.lit("/"), e["value"]["micro_usd"].cast("string"))), ",")
    return b.select(F.col("usage_date").cast("string").alias("usage_date"), "kind", text.alias("models"))


@query("agg_5_spend_by_model", S.sql(USAGE_SQL + """
    SELECT model, sum(calls)::BIGINT AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(micro_usd)::BIGINT AS micro_usd FROM nz
    WHERE usage_date >= DATE '2024-01-24' GROUP BY 1""", "usage_log"))
def _(spark, sf):
    b = U.model_breakdown(_calls(spark, sf))
    return U.spend_by_model(b, AN, 7).select("model", "calls", "prompt_tokens", "micro_usd")


_LIMITS = "lim(kind, day_limit, limit_micro) AS (VALUES " + ", ".join(
    f"({S.q(k)}, {K.DAILY_LIMITS[k]}::BIGINT, {round(K.BUDGET_SHARES[k] * 1e6)}::BIGINT)" for k in K.BUDGET_KINDS) + ")"


@query("agg_6_budget_snapshot", S.sql(USAGE_SQL + f"""
    , {_LIMITS}, b AS (SELECT l.*, coalesce(d.calls, 0) AS used, coalesce(d.micro_usd, 0) AS um FROM lim l LEFT JOIN dy d ON l.kind = d.kind
        AND usage_date = DATE '2024-01-30')
    SELECT kind, used, day_limit, greatest(day_limit - used, 0) AS remaining, {S.rounded('um / 1e6', 4)} AS used_usd,
      {S.rounded('limit_micro / 1e6', 4)} AS limit_usd, {S.rounded('greatest(limit_micro - um, 0) / 1e6', 4)} AS remaining_usd FROM b""", "usage_log"))
def _(spark, sf):
    return U.budget_snapshot(U.daily_usage(_calls(spark, sf)), U.limits_table(spark), AN)


@query("agg_7_budget_overview", S.sql(USAGE_SQL + f"""
    , {_LIMITS}, t AS (SELECT (SELECT sum(limit_micro) FROM lim) AS lm, (SELECT sum(micro_usd) FROM dy WHERE usage_date = DATE '2024-01-30') AS um,
        (SELECT sum(micro_usd) FROM dy WHERE usage_date >= DATE '2024-01-24') AS wk)
    SELECT {S.rounded('um / 1e6', 4)} AS total_used_usd, {S.rounded('lm / 1e6', 4)} AS total_limit_usd,
      {S.rounded('greatest(lm - um, 0) / 1e6', 4)} AS total_remaining_usd, {S.rounded('wk / 7.0 / 1e6', 4)} AS seven_day_average_usd FROM t""", "usage_log"))
def _(spark, sf):
    return U.budget_overview(U.daily_usage(_calls(spark, sf)), U.limits_table(spark), AN)


@query("agg_8_usage_stats", S.sql(USAGE_SQL + f"""
    SELECT CAST(usage_date AS VARCHAR) AS usage_date, kind, sum(calls)::BIGINT AS calls, sum(prompt_tokens + completion_tokens)::BIGINT AS total_tokens,
      {S.rounded('sum(micro_usd) / 1e6', 4)} AS cost_usd, CASE WHEN kind IS NULL THEN {S.rounded('sum(micro_usd) / 7.0 / 1e6', 4)} END AS rolling_average_usd
    FROM dy WHERE usage_date >= DATE '2024-01-24' GROUP BY GROUPING SETS ((usage_date, kind), ())""", "usage_log"))
def _(spark, sf):
    return U.usage_stats(U.daily_usage(_calls(spark, sf)), AN, 7).withColumn("usage_date", F.col("usage_date").cast("string"))


@query("agg_9_story_count", S.sql("""
    SELECT company_id, count(DISTINCT story) AS stories FROM (SELECT unnest(company_tag_ids) AS company_id, coalesce(dedupe_group_id, 'news:' || news_id) AS story
      FROM news) GROUP BY 1""", "news"))
def _(spark, sf):
    return B.story_counts(V.news(spark, sf))


@query("agg_11_trial_phases", S.sql(f"""
    , r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY last_update_date DESC NULLS LAST, trial_id DESC) AS rn FROM trials)
    SELECT company_id, coalesce(phase, 'Unknown') AS phase, count(*) AS n, arg_min(nct_id, rn) AS latest_trial, string_agg(nct_id, ',' ORDER BY rn) AS trials,
      CAST({S.look_up('any_value(phase)', {p: i for i, p in enumerate(K.PHASE_ORDER)}, '99')} AS INT) AS phase_rank FROM r GROUP BY 1, 2""", "trials"))
def _(spark, sf):
    return B.trial_phases(V.trials(spark, sf)).select(
        "company_id", "phase", "n", "latest_trial", F.array_join("trials", ",").alias("trials"), "phase_rank")


@query("agg_12_member_universe", S.sql("""
    SELECT DISTINCT unnest(company_tag_ids) AS company_id FROM news0""", "news0"))
def _(spark, sf):
    return G.member_universe(V.news(spark, sf), "company_tag_ids")


@query("agg_13_preset_watchlists", S.sql("""
    , r AS (SELECT *, row_number() OVER (ORDER BY coalesce(market_cap, 0) DESC, company_id) AS o FROM companies WHERE is_active)
    SELECT 'large-cap-pharma' AS preset_key, (SELECT string_agg(CAST(company_id AS VARCHAR), ',' ORDER BY o) FROM (SELECT * FROM r WHERE sic IN ('2834', '2836')
        ORDER BY o LIMIT 15)) AS ids
    UNION ALL SELECT 'smid-cap-biotech', (SELECT string_agg(CAST(company_id AS VARCHAR), ',' ORDER BY o) FROM (SELECT * FROM r WHERE sic = '2836' AND coalesce(market_cap, 0)
        < 10000000000 ORDER BY o LIMIT 20)) UNION ALL SELECT 'my-tracked-names', ''""", "companies"))
def _(spark, sf):
    p = B.preset_watchlists(V.companies(spark, sf))
    return p.select("preset_key", F.array_join(F.transform("company_ids", lambda i: i.cast("string")), ",").alias("ids"))


@query("agg_14_digest_gap", S.sql("""
    , w AS (SELECT *, row_number() OVER (PARTITION BY CAST(published_at AS DATE) ORDER BY composite_score DESC, published_at DESC, news_id DESC) AS rn FROM news)
    SELECT CAST(CAST(published_at AS DATE) AS VARCHAR) AS day, least(greatest(8 - count(*) FILTER (status = 'complete' OR nullif(summary, '') IS NOT NULL), 0),
      count(*) FILTER (NOT (status = 'complete' OR nullif(summary, '') IS NOT NULL))) AS gap FROM w GROUP BY 1""", "news"))
def _(spark, sf):
    n = V.news(spark, sf).withColumn("day", F.col("published_at").cast("date").cast("string"))
    return B.digest_gap(n, ["day"], "published_at", "news_id", 8)
