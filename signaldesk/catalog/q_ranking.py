"""Windows, sorts, pages and set operations."""

from pyspark.sql import functions as F

from signaldesk import constants as K
from signaldesk.catalog import query, sqltext as S
from signaldesk.functions import classify as C, dates as D, scores as M
from signaldesk.operators import admission, filters as O, ranking as RK, tagging as G
from signaldesk.plans import briefing as B
from signaldesk.sources import views as V

AF, AN = V.AS_OF_FILINGS, V.AS_OF_NEWS

REP_SQL = """
    , rep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(dedupe_group_id, 'news:' || news_id)
        ORDER BY is_official DESC, composite_score DESC, published_at DESC, news_id DESC) AS rn FROM news) WHERE rn = 1)
    """
_REL_N = S.personal("composite_score", S.recency("published_at", S.AN), "is_official", "false", "event_type")
_REL_F = S.personal("composite_score", S.recency("filed_at", S.AF), "true", "false", "event_type")


def _pos(df, *order):
    """Position within an already small page, to compare order."""
    from pyspark.sql import Window

    return df.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


@query("win_1_representative", S.sql(REP_SQL + " SELECT news_id, dedupe_group_id FROM rep", "news"))
def _(spark, sf):
    return RK.representatives(V.news(spark, sf)).select("news_id", "dedupe_group_id")


@query("win_2_market_percentile", S.sql("SELECT company_id, round(pct, 6) AS pct FROM percentile", "percentile"))
def _(spark, sf):
    return RK.market_percentiles(V.companies(spark, sf)).select("company_id", F.round("pct", 6).alias("pct"))


@query("win_3_company_trend", S.sql(f"""
    , r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY filed_at DESC, filing_id DESC) AS rn FROM filings WHERE status = 'complete'),
      d AS (SELECT *, composite_score - lag(composite_score) OVER w AS dc, risk_n - lag(risk_n) OVER w AS dr, opp_n - lag(opp_n) OVER w AS dp
        FROM r WHERE rn <= 4 WINDOW w AS (PARTITION BY company_id ORDER BY rn DESC)),
      a AS (SELECT company_id, count(*) AS n, avg(dc) AS ac, avg(dr) AS ar, avg(dp) AS ap FROM d GROUP BY 1)
    SELECT company_id, n AS filings_analyzed, CASE WHEN n < 2 THEN 'insufficient_data' WHEN ac > 5 THEN 'improving' WHEN ac < -5 THEN 'deteriorating'
        ELSE 'stable' END AS direction, coalesce({S.cents('ac')}, 0.0) AS trend_score,
      CASE WHEN ar > 0.5 THEN 'increasing' WHEN ar < -0.5 THEN 'decreasing' ELSE 'stable' END AS risk_trend,
      CASE WHEN ap > 0.5 THEN 'increasing' WHEN ap < -0.5 THEN 'decreasing' ELSE 'stable' END AS opportunity_trend FROM a""", "filings"))
def _(spark, sf):
    return RK.company_trend(V.filings(spark, sf))


@query("win_4_repeat_lines", """
    WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(replace(text, chr(10), '. '), '. ') AS a
        FROM documents)), d AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM l)
    SELECT doc_id, count(*) AS n, count(*) FILTER (before IS DISTINCT FROM line) AS kept FROM d GROUP BY 1""")
def _(spark, sf):
    from signaldesk.functions import text as T

    d = V.documents(spark, sf).select("doc_id", F.split(F.replace("text", F.lit("\n"), F.lit(". ")), r"\. ").alias("lines"))
    return d.select("doc_id", F.size("lines").cast("bigint").alias("n"), F.size(T.drop_repeats(F.col("lines"))).cast("bigint").alias("kept"))


@query("win_5_latest_item", S.sql("""
    SELECT company_id, filing_id FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY filed_at DESC, composite_score DESC, filing_id DESC)
      AS rn FROM filings) WHERE rn = 1""", "filings"))
def _(spark, sf):
    return RK.latest_per_company(V.filings(spark, sf), "filed_at", "filing_id").select("company_id", "filing_id")


_FRANK = S.look_up("normalized_form_type", {f: i for i, f in enumerate(K.FORM_LIST_ORDER)}, "99")


@query("win_6_form_runs", S.sql(f"""
    , p AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY {_FRANK}, filed_at DESC, composite_score DESC, filing_id DESC) AS pos FROM filings),
      c AS (SELECT *, CASE WHEN lag(normalized_form_type) OVER (PARTITION BY company_id ORDER BY pos) = normalized_form_type THEN 0 ELSE 1 END AS ch
        FROM p), r AS (SELECT *, sum(ch) OVER (PARTITION BY company_id ORDER BY pos) AS run FROM c)
    SELECT company_id, run::BIGINT AS run, normalized_form_type, count(*) AS n, CAST(min(pos) AS INT) AS first_pos FROM r GROUP BY ALL""", "filings"))
def _(spark, sf):
    return RK.form_runs(V.filings(spark, sf))


_ADMIT = f"""
    , w AS (SELECT DISTINCT company_id FROM watchlist_members),
      hit AS (SELECT DISTINCT news_id FROM (SELECT news_id, unnest(company_tag_ids) AS c FROM news0) WHERE c IN (SELECT company_id FROM w)),
      q AS (SELECT strftime(published_at, '%Y-%m-%d') AS queue, n.news_id AS item_id, is_official OR coalesce(event_type IN {S.listed(K.NEWS_OVERRIDE_EVENTS)}, false)
          OR h.news_id IS NOT NULL AS eligible, is_official OR coalesce(event_type IN {S.listed(K.NEWS_FULL_TIER_EVENTS)}, false) OR h.news_id IS NOT NULL AS full_tier,
          row_number() OVER (PARTITION BY strftime(published_at, '%Y-%m-%d') ORDER BY composite_score DESC, published_at DESC, n.news_id DESC) AS rk
        FROM news n LEFT JOIN hit h ON n.news_id = h.news_id WHERE status IN ('pending', 'failed', 'stale') AND attempts < 3),
      walk AS (SELECT queue, 0::BIGINT AS rk, NULL::BIGINT AS item_id, 12 AS p, 8 AS o, 8 AS fu, 30 AS sh, 0 AS took, NULL::VARCHAR AS budget_kind, NULL::VARCHAR AS tier
          FROM (SELECT DISTINCT queue FROM q)
        UNION ALL
        SELECT s.queue, s.rk, s.item_id, s.p - CASE WHEN s.bk = 'primary' AND s.ok THEN 1 ELSE 0 END, s.o - CASE WHEN s.bk = 'override' AND s.ok THEN 1 ELSE 0 END,
          s.fu - CASE WHEN s.tr = 'full_ai' AND s.ok THEN 1 ELSE 0 END, s.sh - CASE WHEN s.tr = 'short_ai' AND s.ok THEN 1 ELSE 0 END,
          s.took + CASE WHEN s.ok THEN 1 ELSE 0 END, CASE WHEN s.ok THEN s.bk END, CASE WHEN s.ok THEN s.tr END
        FROM (SELECT x.*, x.bk IS NOT NULL AND x.tr IS NOT NULL AND x.took < 25 AS ok FROM (
          SELECT q.queue, q.rk, q.item_id, k.p, k.o, k.fu, k.sh, k.took, CASE WHEN k.p > 0 THEN 'primary' WHEN q.eligible AND k.o > 0 THEN 'override' END AS bk,
            CASE WHEN q.full_tier AND k.fu > 0 THEN 'full_ai' WHEN k.sh > 0 THEN 'short_ai' END AS tr
          FROM walk k JOIN q ON q.queue = k.queue AND q.rk = k.rk + 1) x) s)
    """


@query("win_7_budgeted_admission", "WITH RECURSIVE " + S.sql(_ADMIT + """
    SELECT queue, item_id, CAST(took AS INT) AS rank, budget_kind, tier FROM walk WHERE tier IS NOT NULL""", "news", "watchlist_members")[5:])
def _(spark, sf):
    n = G.flag_watched(V.news(spark, sf).filter(F.col("status").isin(*K.QUEUE_STATUSES) & (F.col("attempts") < 3)),
                       V.watchlist_members(spark, sf), "news_id")
    n = n.withColumn("queue", F.date_format("published_at", "yyyy-MM-dd"))
    cand = n.select("queue", F.col("news_id").alias("item_id"), "composite_score", "published_at",
                       C.news_override_eligible("is_official", "event_type", "watched").alias("eligible"),
                       C.news_tier("is_official", "event_type", "watched").alias("tier"), F.lit(0).cast("bigint").alias("micro"))
    return admission.admit(cand, RK.importance_order("published_at", "item_id"), primary=12, override=8, full=8, short=30, limit=25)


@query("win_8_group_page", S.sql("""
    SELECT company_id, filing_id, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY composite_score DESC, filed_at DESC,
      filing_id DESC) AS rn FROM filings) WHERE rn BETWEEN 4 AND 6""", "filings"))
def _(spark, sf):
    t = RK.top_n(V.filings(spark, sf), ["company_id"], RK.importance_order("filed_at", "filing_id"), 6, rank="rank")
    return t.filter("rank > 3").select("company_id", "filing_id", "rank")


# ---- sorts and pages ------------------------------------------------------------
@query("srt_1_importance", S.sql("""
    SELECT filing_id, CAST(row_number() OVER (ORDER BY composite_score DESC, filed_at DESC, filing_id DESC) AS INT) AS pos FROM filings0 QUALIFY pos <= 100""", "filings0"))
def _(spark, sf):
    o = RK.importance_order("filed_at", "filing_id")
    return _pos(RK.page(V.filings(spark, sf).select("filing_id", "filed_at", "composite_score"), o, 100), *o).select("filing_id", "pos")


@query("srt_2_freshness", S.sql("""
    SELECT news_id, CAST(row_number() OVER (ORDER BY published_at DESC, composite_score DESC, news_id DESC) AS INT) AS pos FROM news0 QUALIFY pos <= 100""", "news0"))
def _(spark, sf):
    o = RK.freshness_order("published_at", "news_id")
    return _pos(RK.page(V.news(spark, sf).select("news_id", "published_at", "composite_score"), o, 100), *o).select("news_id", "pos")


@query("srt_3_personal", S.sql(f"""
    SELECT news_id, {_REL_N} AS relevance FROM news ORDER BY relevance DESC, published_at DESC, news_id DESC LIMIT 100""", "news"))
def _(spark, sf):
    n = V.news(spark, sf).withColumn("relevance", M.personal_relevance(
        "composite_score", D.recency_score("published_at", AN), "is_official", F.lit(False), "event_type"))
    return RK.page(n.select("news_id", "published_at", "relevance"), RK.personal_order("published_at", "news_id"), 100).select(
        "news_id", "relevance")


@query("srt_4_form_priority", S.sql(f"""
    SELECT company_id, filing_id, CAST(pos AS INT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY {_FRANK}, filed_at DESC,
      composite_score DESC, filing_id DESC) AS pos FROM filings) WHERE pos <= 20""", "filings"))
def _(spark, sf):
    return RK.top_n(V.filings(spark, sf), ["company_id"], RK.company_list_order(), 20, rank="pos").select("company_id", "filing_id", "pos")


@query("srt_5_page_with_total", S.sql("""
    SELECT filing_id, (SELECT count(*) FROM filings0) AS total FROM filings0 ORDER BY composite_score DESC, filed_at DESC, filing_id DESC LIMIT 50 OFFSET 100""",
                                      "filings0"))
def _(spark, sf):
    f = V.filings(spark, sf).select("filing_id", "filed_at", "composite_score")
    return RK.page_with_total(f, RK.importance_order("filed_at", "filing_id"), 50, 100).select("filing_id", "total")


@query("srt_7_nulls_last", S.sql("""
    SELECT trial_id, CAST(row_number() OVER (ORDER BY last_update_date DESC NULLS LAST, trial_id DESC) AS INT) AS pos FROM trials QUALIFY pos <= 200""", "trials"))
def _(spark, sf):
    t = V.trials(spark, sf).select("trial_id", "last_update_date")
    return _pos(RK.page(t, B.trial_order(), 200), *B.trial_order()).select("trial_id", "pos")


CATALYST_SQL = f"""
    , cf AS (SELECT 'catalyst-filing-' || filing_id AS id, 'filing' AS item_type, company_id, filed_at AS occurred_at, event_type, true AS official, composite_score,
        coalesce(title, form_type) AS title, false AS up FROM filings WHERE filed_at >= {S.AF} - INTERVAL 90 DAY AND (normalized_form_type IN ('8-K', '6-K') OR {S.high_signal('event_type')})),
      cn AS (SELECT 'catalyst-news-' || news_id, 'news', unnest(company_tag_ids), published_at, event_type, is_official, composite_score, title, false FROM news
        WHERE published_at >= {S.AN} - INTERVAL 90 DAY AND (is_official OR {S.high_signal('event_type')})),
      cc AS (SELECT 'catalyst-regulatory-' || event_id, 'regulatory', company_tag_ids[1], starts_at, 'fda-advisory-committee', true, composite_score, title, false
        FROM calendar WHERE starts_at >= {S.AF} - INTERVAL 90 DAY AND starts_at < TIMESTAMP '2000-11-29'),
      ct AS (SELECT 'catalyst-trial-' || CASE WHEN up THEN 'upcoming-' ELSE 'recent-' END || trial_id, 'trial', t.company_id,
          CAST(CASE WHEN up THEN primary_completion_date ELSE last_update_date END AS TIMESTAMP), CASE WHEN up THEN 'upcoming-trial-readout' ELSE 'clinical-trial' END,
          true, CAST(CASE WHEN up THEN 70.0 ELSE 55.0 END + {S.look_up("coalesce(phase, '')", K.PHASE_BONUS, '8.0')} AS DOUBLE),
          c.name || CASE WHEN up THEN ': primary completion expected for ' ELSE ': trial registry update for ' END || title, up
        FROM (SELECT *, primary_completion_date BETWEEN DATE '2000-06-01' AND DATE '2000-11-28' AS up FROM trials) t JOIN companies c ON c.company_id = t.company_id
        WHERE up OR last_update_date >= DATE '2000-03-03'),
      cu AS (SELECT * FROM cf UNION ALL SELECT * FROM cn UNION ALL SELECT * FROM cc UNION ALL SELECT * FROM ct),
      ck AS (SELECT *, CASE WHEN item_type = 'news' THEN {S.AN} ELSE {S.AF} END AS clock FROM cu WHERE company_id IN (SELECT company_id FROM companies)),
      cs AS (SELECT *, up AND occurred_at >= clock AS fut, {S.personal('composite_score', S.recency('occurred_at', 'clock'), 'official', 'false', 'event_type')} AS rel FROM ck),
      co AS (SELECT *, CASE WHEN fut THEN 0 ELSE 1 END AS k0, CASE WHEN fut THEN date_diff('microsecond', clock, occurred_at) / 3.6e9 ELSE -rel END AS k1,
        CASE WHEN fut THEN -composite_score ELSE -epoch(occurred_at) END AS k2 FROM cs)
    """
CATALYST_VIEWS = ("filings", "news", "calendar", "trials", "companies")


def catalyst_rows(spark, sf):
    return B.catalyst_rows(V.filings(spark, sf), V.news(spark, sf), V.trials(spark, sf), V.calendar(spark, sf),
                           V.companies(spark, sf), AF, AN)


@query("srt_8_catalyst_order", S.sql(CATALYST_SQL + """
    SELECT id, company_id, CAST(row_number() OVER (ORDER BY k0, k1, k2, id, company_id) AS INT) AS pos FROM co QUALIFY pos <= 300""", *CATALYST_VIEWS))
def _(spark, sf):
    o = B.catalyst_order() + [F.col("company_id").asc()]
    return _pos(RK.page(B.with_catalyst_keys(catalyst_rows(spark, sf)), o, 300), *o).select("id", "company_id", "pos")


@query("srt_9_calendar_order", S.sql(f"""
    , c AS (SELECT *, starts_at >= {S.AF} AS fut FROM calendar WHERE starts_at >= {S.AF} - INTERVAL 90 DAY AND starts_at <= {S.AF} + INTERVAL 180 DAY)
    SELECT event_id, 'scoped' AS mode, CAST(row_number() OVER (ORDER BY CASE WHEN fut THEN 0 ELSE 1 END, CASE WHEN fut THEN epoch(starts_at) ELSE -epoch(starts_at) END,
      composite_score DESC, event_id DESC) AS INT) AS pos FROM c QUALIFY pos <= 200
    UNION ALL (SELECT event_id, 'all', CAST(row_number() OVER (ORDER BY starts_at, composite_score DESC, event_id DESC) AS INT) AS pos FROM c QUALIFY pos <= 200)""",
                                    "calendar"))
def _(spark, sf):
    c = O.calendar_range(V.calendar(spark, sf), AF, 90, 180)
    o1 = B.calendar_order(AF)
    o2 = [F.col("starts_at").asc(), F.col("composite_score").desc(), F.col("event_id").desc()]
    a = _pos(RK.page(c, o1, 200), *o1).select("event_id", F.lit("scoped").alias("mode"), "pos")
    return a.unionByName(_pos(RK.page(c, o2, 200), *o2).select("event_id", F.lit("all").alias("mode"), "pos"))


@query("srt_10_company_order", S.sql("""
    SELECT company_id, CAST(row_number() OVER (ORDER BY coalesce(market_cap, 0) DESC, name, coalesce(ticker, cik)) AS INT) AS pos FROM companies WHERE is_active
    QUALIFY pos <= 300""", "companies"))
def _(spark, sf):
    c = V.companies(spark, sf).filter("is_active")
    o = [F.coalesce("market_cap", F.lit(0)).desc(), F.col("name").asc(), F.coalesce("ticker", "cik").asc()]
    return _pos(RK.page(c, o, 300), *o).select("company_id", "pos")


@query("srt_11_page_local", S.sql(f"""
    SELECT filing_id, CAST(row_number() OVER (ORDER BY {_REL_F} DESC, filed_at DESC, filing_id DESC) AS INT) AS pos FROM
      (SELECT * FROM filings ORDER BY filed_at DESC, composite_score DESC, filing_id DESC LIMIT 60 OFFSET 30)""", "filings"))
def _(spark, sf):
    from signaldesk.plans import filings as PF

    p = PF.list_filings(V.filings(spark, sf), V.companies(spark, sf), AF, "page_local", 60, 30)
    return _pos(p, *RK.personal_order("filed_at", "filing_id")).select("filing_id", "pos")


@query("srt_12_model_spend", S.sql("""
    SELECT model, sum(prompt_tokens)::BIGINT AS prompt_tokens, CAST(row_number() OVER (ORDER BY sum(prompt_tokens) DESC, model) AS INT) AS pos FROM usage_log GROUP BY 1""",
                                  "usage_log"))
def _(spark, sf):
    m = V.usage_log(spark, sf).groupBy("model").agg(F.sum("prompt_tokens").alias("prompt_tokens"))
    o = [F.col("prompt_tokens").desc(), F.col("model").asc()]
    return _pos(m.orderBy(*o), *o)


# ---- set operations ---------------------------------------------------------------
TIMELINE_SQL = REP_SQL[:0] + f"""
    , tf AS (SELECT 'filing-' || filing_id AS id, company_id, filed_at AS occurred_at, coalesce(title, form_type) AS title, composite_score FROM (SELECT *, row_number() OVER
        (PARTITION BY company_id ORDER BY {_FRANK}, filed_at DESC, composite_score DESC, filing_id DESC) AS rn FROM filings)),
      np AS (SELECT *, unnest(company_tag_ids) AS cid FROM news),
      nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cid, coalesce(dedupe_group_id, 'news:' || news_id) ORDER BY is_official DESC, composite_score DESC,
        published_at DESC, news_id DESC) AS rr FROM np) WHERE rr = 1),
      tn AS (SELECT 'news-' || news_id, cid, published_at, title, composite_score FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY composite_score DESC,
        published_at DESC, news_id DESC) AS rn FROM nr)),
      tt AS (SELECT 'trial-' || trial_id, company_id, CAST(coalesce(last_update_date, primary_completion_date, start_date) AS TIMESTAMP), title, 0.0 FROM (SELECT *,
        row_number() OVER (PARTITION BY company_id ORDER BY last_update_date DESC NULLS LAST, trial_id DESC) AS rn FROM trials)),
      tc AS (SELECT 'regulatory-' || event_id, company_tag_ids[1], starts_at, title, composite_score FROM (SELECT *, row_number() OVER (PARTITION BY company_tag_ids[1]
        ORDER BY CASE WHEN starts_at >= {S.AF} THEN 0 ELSE 1 END, CASE WHEN starts_at >= {S.AF} THEN epoch(starts_at) ELSE -epoch(starts_at) END, composite_score DESC,
        event_id DESC) AS rn FROM calendar WHERE starts_at >= {S.AF} - INTERVAL 90 DAY AND starts_at <= {S.AF} + INTERVAL 180 DAY)),
      tu AS (SELECT * FROM tf UNION ALL SELECT * FROM tn UNION ALL SELECT * FROM tt UNION ALL SELECT * FROM tc),
      tl AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY occurred_at DESC, composite_score DESC, id DESC) AS pos FROM tu)
    """


@query("set_1_timeline", S.sql(TIMELINE_SQL + """
    SELECT company_id, id, title, strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at, CAST(pos AS INT) AS pos FROM tl WHERE pos <= 30""",
                               "filings", "news", "trials", "calendar"))
def _(spark, sf):
    t = B.company_timeline(V.filings(spark, sf), V.news(spark, sf), V.trials(spark, sf), V.calendar(spark, sf), AF, AN, 30)
    return t.select("company_id", "id", "title", F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss").alias("occurred_at"), "pos")


@query("set_2_catalysts", S.sql(CATALYST_SQL + """
    , one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, id ORDER BY composite_score DESC) AS rr FROM co) WHERE rr = 1)
    SELECT company_id, id, title, CAST(pos AS INT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY k0, k1, k2, id) AS pos FROM one) WHERE pos <= 6""",
                                *CATALYST_VIEWS))
def _(spark, sf):
    return B.ranked_catalysts(catalyst_rows(spark, sf)).select("company_id", "id", "title", "pos")


@query("set_3_ordered_distinct", S.sql("""
    SELECT news_id, array_to_string(CASE WHEN len(company_tag_ids) = 0 THEN [9] WHEN list_contains(company_tag_ids, 9) THEN company_tag_ids
      ELSE list_concat(company_tag_ids, [9]) END, ',') AS ids FROM news0""", "news0"))
def _(spark, sf):
    nine = F.array(F.lit(9).cast("bigint"))
    ids = F.array_distinct(F.concat("company_tag_ids", nine, "company_tag_ids"))
    return V.news(spark, sf).select("news_id", F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("ids"))


@query("set_4_matched_ids", S.sql("""
    SELECT news_id, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS matched FROM (SELECT news_id, unnest(company_tag_ids) AS c FROM news0)
    WHERE c IN (SELECT company_id FROM watchlist_members) GROUP BY 1""", "news0", "watchlist_members"))
def _(spark, sf):
    pairs = V.news(spark, sf).select("news_id", F.explode(F.array_distinct("company_tag_ids")).alias("company_id"))
    hits = pairs.join(V.watchlist_members(spark, sf).select("company_id").distinct(), "company_id", "left_semi")
    return hits.groupBy("news_id").agg(F.array_sort(F.collect_list("company_id")).alias("m")).select(
        "news_id", F.array_join(F.transform("m", lambda i: i.cast("string")), ",").alias("matched"))


@query("set_5_first_wins", S.sql("""
    SELECT url, news_id FROM (SELECT source_name || '/' || (news_id % 700) AS url, news_id, row_number() OVER (PARTITION BY source_name || '/' || (news_id % 700)
      ORDER BY published_at, news_id) AS rn FROM news0) WHERE rn = 1""", "news0"))
def _(spark, sf):
    n = V.news(spark, sf).withColumn("url", F.concat("source_name", F.lit("/"), (F.col("news_id") % 700).cast("string")))
    return RK.top_n(n, ["url"], [F.col("published_at").asc(), F.col("news_id").asc()], 1).select("url", "news_id")


@query("set_6_membership_merge", S.sql("""
    SELECT news_id, array_to_string(list_sort(list_distinct(list_concat(company_tag_ids, [news_id % 150, 5]))), ',') AS ids FROM news0""", "news0"))
def _(spark, sf):
    new = F.array(F.col("news_id") % 150, F.lit(5).cast("bigint"))
    ids = F.array_sort(F.array_union("company_tag_ids", new))
    return V.news(spark, sf).select("news_id", F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("ids"))
