"""Composite datasets: whole flows over whole tables."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from signaldesk import constants as K
from signaldesk.catalog import query, sqltext as S
from signaldesk.catalog.q_aggregates import QUEUE_SQL
from signaldesk.catalog.q_functions import _BASIC, _NUMS, tsfmt
from signaldesk.catalog.q_joins import _GRP, _quotes
from signaldesk.catalog.q_ranking import CATALYST_SQL, CATALYST_VIEWS, TIMELINE_SQL, _FRANK, _pos, catalyst_rows
from signaldesk.catalog.q_tagging import BEST_SQL
from signaldesk.catalog.q_text import _TAGLESS
from signaldesk.functions import classify as C, text as T
from signaldesk.operators import ranking as RK, sync
from signaldesk.plans import (
    briefing as B, calendar as CAL, dashboard as DASH, enrichment as ENR, filings as PF, news as PN, registry as REG, trials as PT,
)
from signaldesk.runtime import staged
from signaldesk.sources import views as V

AF, AN = V.AS_OF_FILINGS, V.AS_OF_NEWS


# ---- flagship -------------------------------------------------------------------
@query("flagship_pending_filings", S.sql(f"""
    , x AS (SELECT f.*, c.name, {S.form_base('f.normalized_form_type', 55.0)} AS base, {S.material('t.raw_text')} AS mat, {S.recency('f.filed_at', S.AF)} AS rec,
        coalesce(p.pct, 0.0) AS cap FROM filings f JOIN filing_text t ON t.filing_id = f.filing_id JOIN companies c ON f.company_id = c.company_id AND c.is_active
        LEFT JOIN percentile p ON f.company_id = p.company_id WHERE status = 'pending'),
      y AS (SELECT *, {S.cents('0.35 * base + 0.30 * mat + 0.35 * rec')} AS imp FROM x),
      z AS (SELECT *, {S.cents('0.35 * cap + 0.40 * imp + 0.25 * rec')} AS comp FROM y)
    SELECT filing_id, company_id, name, form_type, strftime(filed_at, '%Y-%m-%d') AS filed_on, {S.cents('cap')} AS market_cap_score,
      {S.cents('0.60 * base + 0.40 * mat')} AS importance_score, imp AS impact_score, comp AS composite_score, {S.bucket('filed_at', S.AF)} AS freshness_bucket,
      {S.filing_reason('event_type', 'normalized_form_type', S.cents('cap'), 'imp', 'rec')} AS priority_reason
    FROM z ORDER BY comp DESC, filed_at DESC, filing_id DESC LIMIT 50""", "filings", "filing_text", "companies", "percentile"))
def _(spark, sf):
    return PF.rank_pending(V.filings(spark, sf), V.filing_text(spark, sf), V.companies(spark, sf), AF, 50)


# ---- DS-1 -----------------------------------------------------------------------
@query("ds_1_universe_sync", S.sql(f"""
    , n AS (SELECT cik, name, ticker, exchange, sic FROM companies WHERE sic IN {S.listed(K.COVERED_SIC)}),
      o AS (SELECT cik, CASE WHEN exchange = 'NATION_5' THEN 'Old ' || name ELSE name END AS name FROM companies WHERE sic IN ('2834', '8731'))
    SELECT coalesce(n.cik, o.cik) AS cik, coalesce(n.name, o.name) AS name, CASE WHEN n.cik IS NULL THEN 'keep' WHEN o.cik IS NULL THEN 'insert'
      WHEN n.name <> o.name THEN 'update' ELSE 'unchanged' END AS action FROM n FULL OUTER JOIN o ON n.cik = o.cik""", "companies"))
def _(spark, sf):
    c = V.companies(spark, sf)
    stored = c.filter("sic in ('2834', '8731')").select(
        "cik", F.when(F.col("exchange") == "NATION_5", F.concat(F.lit("Old "), "name")).otherwise(F.col("name")).alias("name"),
        "ticker", "exchange", "sic", F.lit("sic-allowlist").alias("universe_reason"), F.lit(True).alias("is_active"))
    issuers = c.select(F.col("company_id").alias("cik"), "ticker", "name", "exchange", "sic")
    return REG.sync_universe(issuers, stored).select("cik", "name", "action")


# ---- DS-2 -----------------------------------------------------------------------
def _raw_filings(spark, sf):
    f = V.filings(spark, sf)
    raw = V.filing_text(spark, sf, "company_id", "accession_number", "form_type", "filed_at", "title", "items", read=C.filing_digest).select(
        "company_id", "accession_number", F.col("form_type").alias("form"), F.date_format("filed_at", "yyyyMMddHHmmss").alias("acceptance"),
        F.concat(F.lit("doc"), F.col("filing_id").cast("string"), F.lit(".htm")).alias("document"), "title", "items", "raw_text")
    return raw, f.filter("status = 'complete'")


_GATE_WORDS = "lower(concat_ws(' ', nullif(f.title, ''), nullif(f.items, ''), t.raw_text))"
_8K_WORDS = "lower(concat_ws(' ', nullif(f.title, ''), t.raw_text))"


@query("ds_2_filing_ingest", S.sql(f"""
    , r AS (SELECT f.*, t.raw_text, {S.filing_event('f.normalized_form_type', 'f.item_numbers', 'f.title', 't.raw_text')} AS ev FROM filings f JOIN filing_text t
        ON t.filing_id = f.filing_id WHERE f.status <> 'complete' AND f.form_type <> 'S-1' AND CASE f.normalized_form_type WHEN '6-K' THEN {S.has_any(_GATE_WORDS, K.PERIODIC_6K_WORDS)}
        WHEN '8-K' THEN list_has_any(f.item_numbers, [{", ".join(S.q(i) for i in K.MATERIAL_ITEMS)}]) OR {S.has_any(_8K_WORDS, K.MATERIAL_8K_WORDS)} ELSE true END),
      h AS (SELECT company_id, accession_number, normalized_form_type, filed_at FROM filings WHERE status = 'complete' UNION ALL
        SELECT company_id, accession_number, normalized_form_type, filed_at FROM r),
      g AS (SELECT *, {_GRP} AS grp FROM h),
      b AS (SELECT company_id, grp, filed_at, max(accession_number) AS best FROM g WHERE normalized_form_type <> 'S-1' GROUP BY ALL),
      p AS (SELECT g.accession_number, b.best AS prior_accession FROM g ASOF LEFT JOIN b ON g.company_id = b.company_id AND g.grp = b.grp AND g.filed_at > b.filed_at),
      x AS (SELECT r.*, p.prior_accession, {S.form_base('normalized_form_type', 55.0)} AS base, {S.material('raw_text')} AS mat, {S.recency('filed_at', S.AF)} AS rec,
        coalesce(pc.pct, 0.0) AS cap FROM r JOIN p ON p.accession_number = r.accession_number LEFT JOIN percentile pc ON pc.company_id = r.company_id),
      y AS (SELECT *, {S.cents('0.35 * base + 0.30 * mat + 0.35 * rec')} AS imp FROM x)
    SELECT y.accession_number, coalesce(title, c.name || ' ' || form_type) AS shown_title, ev AS event_type, prior_accession, imp AS impact_score,
      {S.cents('0.35 * cap + 0.40 * imp + 0.25 * rec')} AS composite_score, CASE WHEN c.market_cap IS NOT NULL THEN 'high' ELSE 'degraded' END AS confidence,
      'filing:' || y.accession_number AS dedupe_group_id, {S.filing_reason('ev', 'normalized_form_type', S.cents('cap'), 'imp', 'rec')} AS priority_reason
    FROM y JOIN companies c ON c.company_id = y.company_id""", "filings", "filing_text", "percentile", "companies"))
def _(spark, sf):
    raw, stored = _raw_filings(spark, sf)
    return PF.ingest(raw, stored, V.companies(spark, sf), AF).select(
        "accession_number", "shown_title", "event_type", "prior_accession", "impact_score", "composite_score", "confidence",
        "dedupe_group_id", "priority_reason")


# ---- DS-3 -----------------------------------------------------------------------
def _entries(spark, sf):
    """Feed entries whose titles name two issuers, one by name and one by ticker."""
    e = V.news(spark, sf)
    who = F.get("company_tag_ids", F.lit(0))
    other = F.element_at("company_tag_ids", -1)
    named = F.when(F.size("company_tag_ids") > 0, F.concat(
        F.lit(" &amp; <b>Customer#"), F.lpad(who.cast("string"), 9, "0"), F.lit("</b> with T"), other.cast("string"))).otherwise("")
    return e.select(
        F.col("news_id").alias("entry_id"), F.concat("title", named).alias("title"),
        F.concat("canonical_url", F.lit("?utm_source=feed#x")).alias("link"), F.col("excerpt").alias("summary"),
        F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("published"),
        "source_name", "source_weight", F.array(F.lit("biotech")).alias("feed_tags"),
        F.when(F.col("is_official"), "official_company_pr").alias("source_type"), "is_official",
        F.when(F.col("is_official"), F.lit(7).cast("bigint")).alias("seed_company_id"))


_ENTRY_SQL = f"""
    , e AS (SELECT news_id, title || CASE WHEN len(company_tag_ids) > 0 THEN ' & Customer#' || lpad(CAST(company_tag_ids[1] AS VARCHAR), 9, '0') || ' with T' ||
          company_tag_ids[-1] ELSE '' END AS title, excerpt, date_trunc('second', published_at) AS published_at, source_weight, is_official, company_tag_ids[1] AS a,
          company_tag_ids[-1] AS b, composite_score, status, source_name FROM news0),
      act AS (SELECT company_id FROM companies WHERE is_active),
      tg AS (SELECT e.*, coalesce(excerpt, title) AS body, list_filter([CASE WHEN a IN (SELECT company_id FROM act) THEN a END,
          CASE WHEN b <> a AND b IN (SELECT company_id FROM act) THEN b END], lambda x: x IS NOT NULL) AS found FROM e)
    """
_NEWS_SCORED = f"""
    , cap AS (SELECT news_id, max(pct) AS cap FROM (SELECT news_id, unnest(tags) AS company_id FROM tt) t JOIN percentile p ON t.company_id = p.company_id GROUP BY 1),
      sc AS (SELECT tt.*, coalesce(c.cap, 0.0) AS cap, {S.recency('published_at', S.AN)} AS rec, {S.news_event('title', 'body', 'topics')} AS ev
        FROM tt LEFT JOIN cap c ON c.news_id = tt.news_id),
      s1 AS (SELECT *, {S.cents(f"0.55 * {S.material(chr(39) * 2 + " || title || ' ' || coalesce(body, '')")} + 0.45 * (source_weight * 100.0)")} AS imp FROM sc),
      s2 AS (SELECT *, {S.cents('0.30 * imp + 0.25 * (source_weight * 100.0) + 0.20 * cap + 0.25 * rec')} AS comp FROM s1)
    """


def _fetched(spark, sf):
    """Pages behind every fifth story, each in an older version without its time as well."""
    p = V.pages(spark, sf)
    n = V.news(spark, sf).filter("news_id % 5 = 0").select("news_id", "canonical_url").withColumn(
        "page_id", F.col("news_id") % p.agg(F.max("page_id") + 1).scalar())
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("news_id") % 300).cast("int"))
    meta = F.concat(F.lit('<body><meta name="pubdate" content="'), day.cast("string"), F.lit('T10:30:00Z">'))
    both = n.join(p.select("page_id", "html"), "page_id")
    new = both.select(F.concat("canonical_url", F.lit("?x=1")).alias("url"), F.replace("html", F.lit("<body>"), meta).alias("html"), F.lit(2).alias("fetched_at"))
    return new.unionByName(both.select(F.col("canonical_url").alias("url"), F.lit("<body><article>old</article></body>").alias("html"), F.lit(1).alias("fetched_at")))


_FETCHED_SQL = f"""
    , pg AS (SELECT page_id, nullif(trim(regexp_replace({_BASIC.format(_TAGLESS)}, '\\s+', ' ', 'g')), '') AS page_body FROM pages),
      tp AS (SELECT tg.* REPLACE (CASE WHEN news_id % 5 = 0 THEN coalesce(page_body, body) ELSE body END AS body,
          CASE WHEN news_id % 5 = 0 AND page_id IS NOT NULL THEN CAST(DATE '2024-01-01' + CAST(news_id % 300 AS INT) AS TIMESTAMP) + INTERVAL 630 MINUTE ELSE published_at END AS published_at)
        FROM tg LEFT JOIN pg ON page_id = news_id % (SELECT max(page_id) + 1 FROM pages)),
      sd AS (SELECT name AS seed FROM companies WHERE company_id = 7)
"""


@query("ds_3_news_ingest", S.sql(_ENTRY_SQL + _FETCHED_SQL + f"""
    , tt AS (SELECT *, CASE WHEN is_official THEN list_concat([seed], list_filter(said, lambda x: x <> seed)) ELSE said END AS mentioned FROM (
      SELECT *, list_filter([CASE WHEN a IN (SELECT company_id FROM act) THEN 'Customer#' || lpad(CAST(a AS VARCHAR), 9, '0') END,
          CASE WHEN b IN (SELECT company_id FROM act) THEN 'T' || b END], lambda x: x IS NOT NULL) AS said, (SELECT seed FROM sd) AS seed, CASE WHEN is_official THEN list_concat([7], list_filter(found, lambda x: x <> 7)) ELSE found END AS tags,
        list_sort(list_distinct(list_concat(['biotech'], {S.topics('title', 'body')}))) AS topics FROM tp
        WHERE NOT regexp_matches(lower(title), 'webinar|whitepaper|sponsored|advertisement') AND source_name <> 'view'))
    """ + _NEWS_SCORED + f"""
    SELECT news_id, array_to_string(tags, ',') AS tags, array_to_string(topics, ',') AS topics, ev AS event_type, comp AS composite_score, imp AS importance_score,
      array_to_string(mentioned, '|') AS mentioned, {S.news_reason('ev', 'is_official', 'source_weight', 'tags', S.cents('cap'), 'imp', 'rec')} AS priority_reason,
      {S.news_group('tags', 'ev', 'title', 'published_at')} AS dedupe_group_id FROM s2""", "news0", "companies", "percentile"))
def _(spark, sf):
    e = _entries(spark, sf)
    stored = e.filter("source_name = 'view'").select(
        T.canonical_url("link").alias("canonical_url"), T.content_hash("link", "title").alias("article_hash"))
    n = PN.ingest(e, stored, V.companies(spark, sf), AN, pages=_fetched(spark, sf))
    return n.select("news_id", F.array_join(F.transform("company_tag_ids", lambda i: i.cast("string")), ",").alias("tags"),
                    F.array_join("topic_tags", ",").alias("topics"), "event_type", "composite_score", "importance_score",
                    F.array_join("mentioned", "|").alias("mentioned"), "priority_reason", "dedupe_group_id")


# ---- DS-4, DS-5, DS-6 ------------------------------------------------------------
def _rerank_sql(pct):
    return f"""
    , k AS (SELECT filing_id, lag(filing_id) OVER (PARTITION BY company_id, {_GRP} ORDER BY filed_at, filing_id) AS prior_id FROM filings),
      ft AS (SELECT filing_id, {S.material('raw_text')} AS mat, CASE WHEN len({_NUMS}) > 0 THEN list_sum({_NUMS}) / len({_NUMS}) END AS mean FROM filing_text)
    {S.SHARED_WORDS.format(links="SELECT k.* FROM k JOIN filings f ON f.filing_id = k.filing_id AND f.status = 'complete'")},
      x AS (SELECT f.filing_id, f.company_id, f.status, f.normalized_form_type, f.event_type, f.filed_at, k.prior_id, c.market_cap IS NOT NULL AS has_cap, coalesce(p.pct, 0.0) AS cap,
          {S.form_base('normalized_form_type', 55.0)} AS base, {S.recency('filed_at', S.AF)} AS rec, a.mat, f.importance_score AS llm,
          CASE WHEN a.mean IS NULL THEN 10.0::DOUBLE WHEN b.mean IS NULL THEN 55.0 WHEN b.mean = 0 THEN 60.0 ELSE
            {S.cents('least(abs(a.mean - b.mean) / greatest(abs(b.mean), 1.0) * 100.0, 100.0)')} END AS quant,
          CASE WHEN b.filing_id IS NULL THEN 65.0::DOUBLE WHEN f.status = 'complete' THEN
            {S.cents('(1.0 - coalesce(sh.n, 0)::DOUBLE / (wa.n + wb.n - coalesce(sh.n, 0))) * 100.0')} END AS nov
        FROM filings f JOIN {pct[0]} c ON c.company_id = f.company_id AND c.is_active LEFT JOIN {pct[1]} p ON p.company_id = f.company_id JOIN k ON k.filing_id = f.filing_id
          JOIN ft a ON a.filing_id = f.filing_id LEFT JOIN ft b ON b.filing_id = k.prior_id LEFT JOIN shared sh ON sh.filing_id = f.filing_id
          LEFT JOIN word_counts wa ON wa.filing_id = f.filing_id LEFT JOIN word_counts wb ON wb.filing_id = k.prior_id),
      y AS (SELECT *, CASE WHEN status = 'complete' THEN {S.cents('0.25 * nov + 0.20 * quant + 0.15 * mat + 0.15 * llm + 0.25 * rec')}
          ELSE {S.cents('0.35 * base + 0.30 * mat + 0.35 * rec')} END AS imp FROM x),
      rr AS (SELECT *, CASE WHEN status = 'complete' THEN {S.cents('0.20 * cap + 0.50 * imp + 0.30 * rec')} ELSE {S.cents('0.35 * cap + 0.40 * imp + 0.25 * rec')} END AS comp FROM y)
    """


@query("ds_4_filing_rerank", S.sql(_rerank_sql(("companies", "percentile")) + f"""
    SELECT filing_id, prior_id, imp AS impact_score, comp AS composite_score, CASE WHEN has_cap THEN 'high' ELSE 'degraded' END AS confidence,
      {S.filing_reason('event_type', 'normalized_form_type', S.cents('cap'), 'imp', 'rec')} AS priority_reason FROM rr""",
                                   "filings", "filing_text", "companies", "percentile"))
def _(spark, sf):
    r = PF.rerank(V.filing_heads(spark, sf), V.documents(spark, sf), V.companies(spark, sf), AF)
    return r.select("filing_id", "prior_id", "impact_score", "composite_score", "confidence", "priority_reason")


def _stored_news(spark, sf):
    """Stored stories: the ingested titles, with the tags they were stored with."""
    who, other = F.get("company_tag_ids", F.lit(0)), F.element_at("company_tag_ids", -1)
    named = F.when(F.size("company_tag_ids") > 0, F.concat(F.lit(" & Customer#"), F.lpad(who.cast("string"), 9, "0"), F.lit(" with T"),
                                                           other.cast("string"))).otherwise("")
    return V.news(spark, sf).withColumns({
        "title": F.concat("title", named), "body": F.col("excerpt"), "summary_importance": F.col("composite_score") / 5,
        "mentioned": F.array().cast("array<string>")}).drop("mentioned", "event_type", "dedupe_group_id", "composite_score")


_RETAG_SQL = _ENTRY_SQL.replace("coalesce(excerpt, title) AS body", "excerpt AS body").replace("date_trunc('second', published_at)", "published_at") + f"""
    , tt AS (SELECT *, found AS tags, {S.topics('substr(title, 1, 0)', 'body')} AS t0 FROM tg),
      tp AS (SELECT news_id, topic_tags AS topics, company_tag_ids AS old FROM news1)
    """


def _news_rerank_sql(pct):
    return _RETAG_SQL.replace("tt AS (", "t1 AS (").rstrip() + f"""
    , tt AS (SELECT t1.*, tp.topics, tp.old FROM t1 JOIN tp ON tp.news_id = t1.news_id)
    """ + _NEWS_SCORED.replace("JOIN percentile p", f"JOIN {pct} p") + f"""
    , s3 AS (SELECT *, CASE WHEN status <> 'complete' THEN comp WHEN len(tags) > 0 THEN
        {S.cents('0.35 * (composite_score / 5) + 0.15 * (source_weight * 100.0) + 0.15 * cap + 0.35 * rec')} ELSE
        {S.cents('0.50 * (composite_score / 5) + 0.20 * (source_weight * 100.0) + 0.30 * rec')} END AS final FROM s2)
    """


@query("ds_5_news_retag", S.sql(_news_rerank_sql("percentile") + f"""
    SELECT news_id, array_to_string(tags, ',') AS tags, old IS DISTINCT FROM tags AS changed, ev AS event_type, final AS composite_score,
      {S.news_group('tags', 'ev', 'title', 'published_at')} AS dedupe_group_id FROM s3""", "news1", "news0", "companies", "percentile"))
def _(spark, sf):
    r = PN.retag(_stored_news(spark, sf), V.companies(spark, sf), AN)
    return r.select("news_id", F.array_join(F.transform("company_tag_ids", lambda i: i.cast("string")), ",").alias("tags"), "changed",
                    "event_type", "composite_score", "dedupe_group_id")


_NEWCAPS = """
    , qc AS (SELECT company_id, is_active, CASE WHEN c.sic <> '2834' THEN company_id * 1000 ELSE c.market_cap END AS market_cap FROM companies c),
      qp AS (SELECT company_id, CAST(i AS DOUBLE) / (n - 1) * 100.0::DOUBLE AS pct FROM (SELECT company_id, row_number() OVER (ORDER BY market_cap, company_id) - 1 AS i,
        count(*) OVER () AS n FROM qc WHERE is_active AND market_cap <> 0))
    """


@query("ds_6_caps_then_rerank", S.sql(_NEWCAPS + _rerank_sql(("qc", "qp")).replace("y AS", "ry AS").replace("FROM y)", "FROM ry)") + _news_rerank_sql("qp") + """
    SELECT 'filing' AS kind, filing_id AS id, comp AS composite_score FROM rr UNION ALL SELECT 'news', news_id, final FROM s3""",
                                      "filings", "filing_text", "companies", "news1", "news0", "percentile"))
def _(spark, sf):
    c = REG.refreshed_companies(V.companies(spark, sf), _quotes(spark, sf))
    f = PF.rerank(V.filing_heads(spark, sf), V.documents(spark, sf), c, AF)
    # The filings' exchanges go before those of the stories are made.
    f = staged(f.select(F.lit("filing").alias("kind"), F.col("filing_id").alias("id"), "composite_score"), "reranked")
    n = PN.retag(_stored_news(spark, sf), c, AN)
    return f.unionByName(
        n.select(F.lit("news").alias("kind"), F.col("news_id").alias("id"), "composite_score"))


# ---- DS-7, DS-8, DS-9 --------------------------------------------------------------
_RELW_F = S.personal("composite_score", S.recency("filed_at", S.AF), "true", "false", "event_type")


@query("ds_7_filing_lists", S.sql(f"""
    , r AS (SELECT f.*, {_RELW_F} AS rel FROM filings f JOIN companies c ON c.company_id = f.company_id WHERE filed_at >= {S.AF} - INTERVAL 365 DAY),
      m AS (SELECT DISTINCT company_id FROM watchlist_members WHERE watchlist_id = 1)
    SELECT 'importance' AS mode, filing_id, CAST(row_number() OVER (ORDER BY composite_score DESC, filed_at DESC, filing_id DESC) AS INT) AS pos FROM r QUALIFY pos <= 50
    UNION ALL (SELECT 'freshness', filing_id, CAST(row_number() OVER (ORDER BY filed_at DESC, composite_score DESC, filing_id DESC) AS INT) AS pos FROM r QUALIFY pos <= 50)
    UNION ALL (SELECT 'personal', filing_id, CAST(row_number() OVER (ORDER BY rel DESC, filed_at DESC, filing_id DESC) AS INT) AS pos FROM r QUALIFY pos <= 50)
    UNION ALL (SELECT 'watchlist', filing_id, CAST(row_number() OVER (ORDER BY rel DESC, filed_at DESC, filing_id DESC) AS INT) AS pos FROM r WHERE company_id IN (SELECT company_id FROM m) QUALIFY pos <= 50)
    UNION ALL (SELECT 'company', filing_id, CAST(row_number() OVER (ORDER BY {_FRANK}, filed_at DESC, composite_score DESC, filing_id DESC) AS INT) AS pos FROM r WHERE company_id = 11 QUALIFY pos <= 50)""",
                                  "filings", "companies", "watchlist_members"))
def _(spark, sf):
    f, c = V.filings(spark, sf), V.companies(spark, sf)
    members = V.watchlist_members(spark, sf).filter("watchlist_id = 1")
    modes = {
        "importance": (dict(sort="importance"), RK.importance_order("filed_at", "filing_id")),
        "freshness": (dict(sort="freshness"), RK.freshness_order("filed_at", "filing_id")),
        "personal": (dict(sort="personal"), RK.personal_order("filed_at", "filing_id")),
        "watchlist": (dict(sort="personal", members=members), RK.personal_order("filed_at", "filing_id")),
        "company": (dict(company_id=11), RK.company_list_order()),
    }
    parts = [_pos(PF.list_filings(f, c, AF, limit=50, recent_days=365, **kw), *o).select(F.lit(m).alias("mode"), "filing_id", "pos")
             for m, (kw, o) in modes.items()]
    return reduce(DataFrame.unionByName, parts)


_RELW_N = S.personal("composite_score", S.recency("published_at", S.AN), "is_official", "{}", "event_type")
_REP = """row_number() OVER (PARTITION BY coalesce(dedupe_group_id, 'news:' || news_id) ORDER BY is_official DESC, composite_score DESC, published_at DESC, news_id DESC)"""


@query("ds_8_news_lists", S.sql(f"""
    , f AS (SELECT * FROM news WHERE published_at >= {S.AN} - INTERVAL 14 DAY),
      rep AS (SELECT * FROM (SELECT *, {_REP} AS rr, {_RELW_N.format('false')} AS rel FROM f) WHERE rr = 1),
      hit AS (SELECT DISTINCT news_id FROM (SELECT news_id, unnest(company_tag_ids) AS c FROM f) WHERE c IN (SELECT company_id FROM watchlist_members WHERE watchlist_id = 2)),
      wrep AS (SELECT * FROM (SELECT *, {_REP} AS rr, {_RELW_N.format('true')} AS rel FROM f WHERE news_id IN (SELECT news_id FROM hit)) WHERE rr = 1)
    SELECT 'importance' AS mode, news_id, title, CAST(row_number() OVER (ORDER BY composite_score DESC, published_at DESC, news_id DESC) AS INT) AS pos FROM rep QUALIFY pos BETWEEN 21 AND 60
    UNION ALL (SELECT 'freshness', news_id, title, CAST(row_number() OVER (ORDER BY published_at DESC, composite_score DESC, news_id DESC) AS INT) AS pos FROM rep QUALIFY pos <= 40)
    UNION ALL (SELECT 'personal', news_id, title, CAST(row_number() OVER (ORDER BY rel DESC, published_at DESC, news_id DESC) AS INT) AS pos FROM rep QUALIFY pos <= 40)
    UNION ALL (SELECT 'watchlist', news_id, title, CAST(row_number() OVER (ORDER BY rel DESC, published_at DESC, news_id DESC) AS INT) AS pos FROM wrep QUALIFY pos <= 40)""",
                                "news", "watchlist_members"))
def _(spark, sf):
    n = V.news(spark, sf)
    members = V.watchlist_members(spark, sf).filter("watchlist_id = 2")
    modes = {"importance": dict(sort="importance", offset=20), "freshness": dict(sort="freshness"), "personal": dict(sort="personal"),
             "watchlist": dict(sort="personal", members=members)}
    parts = [PN.list_news(n, AN, limit=40, recent_days=14, **kw).select(F.lit(m).alias("mode"), "news_id", "title", "pos")
             for m, kw in modes.items()]
    return reduce(DataFrame.unionByName, parts)


@query("ds_9_trial_archive", S.sql("""
    , a AS (SELECT * FROM trials WHERE status = 'Recruiting' AND title ILIKE '%ring%' ORDER BY last_update_date DESC NULLS LAST, trial_id DESC LIMIT 50 OFFSET 10)
    SELECT a.nct_id, c.name AS company_name, c.ticker FROM a LEFT JOIN companies c ON c.company_id = a.company_id""", "trials", "companies"))
def _(spark, sf):
    return PT.archive(V.trials(spark, sf), V.companies(spark, sf), 50, 10, status="Recruiting", text="ring").select(
        "nct_id", "company_name", "ticker")


# ---- DS-10, DS-11 -------------------------------------------------------------------
@query("ds_10_trial_sync", S.sql(BEST_SQL.replace("FROM sponsors s JOIN pr", "FROM (SELECT * FROM sponsors WHERE nct_id IN (SELECT nct_id FROM scope)) s JOIN pr").replace(
    ", raw AS (", f""", scope AS (SELECT * FROM studies WHERE lower(coalesce(overall_status, '')) IN {S.listed(K.CURRENT_STATUSES)} OR last_update_posted_date >= DATE '1999-12-04'
        OR primary_completion_date >= DATE '1999-12-04'), raw AS (""", 1) + """
    , old AS (SELECT DISTINCT l_suppkey AS company_id, 'NCT' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS nct_id FROM lineitem WHERE l_returnflag = 'A'),
      okc AS (SELECT s_suppkey AS company_id FROM supplier WHERE s_nationkey <> 4),
      n AS (SELECT * FROM best WHERE company_id IN (SELECT company_id FROM okc))
    SELECT coalesce(n.company_id, o.company_id) AS company_id, coalesce(n.nct_id, o.nct_id) AS nct_id, n.matched_alias, CASE WHEN coalesce(n.company_id, o.company_id) NOT IN
      (SELECT company_id FROM okc) THEN 'keep' WHEN n.nct_id IS NULL THEN 'delete' WHEN o.nct_id IS NULL THEN 'insert' ELSE 'update' END AS action
    FROM n FULL OUTER JOIN old o ON o.company_id = n.company_id AND o.nct_id = n.nct_id""", "studies", "sponsor_companies", "sponsors"))
def _(spark, sf):
    incoming = PT.matched_trials(V.studies(spark, sf), V.sponsors(spark, sf), V.conditions(spark, sf), V.interventions(spark, sf),
                                 V.sponsor_companies(spark, sf), AF, 180)
    empty = F.array().cast("array<string>")
    stored = V.table(spark, sf, "lineitem").filter("l_returnflag = 'A'").select(
        F.col("l_suppkey").alias("company_id"), F.concat(F.lit("NCT"), F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("nct_id")).distinct()
    nothing = {c: F.lit(None).cast(incoming.schema[c].dataType) for c in PT.COMPARED}
    stored = stored.withColumns({**nothing, "conditions": empty, "interventions": empty,
                                 "metadata": F.create_map().cast("map<string,string>")})
    ok = V.table(spark, sf, "supplier").filter("s_nationkey <> 4").select(F.col("s_suppkey").alias("company_id"))
    out = PT.sync_trials(incoming, stored, ok)
    return out.select("company_id", "nct_id", F.col("metadata")["matched_alias"].alias("matched_alias"), "action")


@query("ds_11_calendar_sync", S.sql(f"""
    , r AS (SELECT o_orderkey, o_custkey, 'Meeting of the ' || substr(o_orderpriority, 3) || ' Advisory Committee Meeting Announcement' AS title, o_orderpriority,
        'https://calendar.example.org/events/' || o_orderkey AS canonical_url, o_orderdate AS starts_at FROM orders WHERE o_orderstatus <> 'P'),
      t AS (SELECT r.*, substr(o_orderpriority, 3) || ' Advisory Committee' AS committee_name, title || ' Center Office of T' || o_custkey AS summary_text,
        CASE WHEN c.company_id IS NOT NULL THEN [o_custkey] ELSE CAST([] AS BIGINT[]) END AS tags, coalesce(p.pct, 0.0) AS cap
        FROM r LEFT JOIN (SELECT * FROM companies WHERE is_active) c ON c.company_id = r.o_custkey LEFT JOIN percentile p ON p.company_id = r.o_custkey),
      s AS (SELECT *, {S.cal_importance('title', 'committee_name', 'starts_at', 'cap', S.AF)} AS importance_score FROM t),
      n AS (SELECT *, {S.cal_composite('starts_at', 'cap', 'importance_score', S.AF)} AS composite_score FROM s),
      o AS (SELECT 'https://calendar.example.org/events/' || o_orderkey AS canonical_url FROM orders WHERE o_orderstatus <> 'F')
    SELECT coalesce(n.canonical_url, o.canonical_url) AS canonical_url, importance_score, composite_score, committee_name, CASE WHEN n.canonical_url IS NULL THEN 'keep'
      WHEN o.canonical_url IS NULL THEN 'insert' ELSE 'update' END AS action FROM n FULL OUTER JOIN o ON n.canonical_url = o.canonical_url""",
                                    "companies", "percentile"))
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    name = F.concat(F.lit("Meeting of the "), F.substring("o_orderpriority", 3, 100), F.lit(" Advisory Committee Meeting Announcement"))
    cell = F.concat(F.lit('<a href="/events/'), F.col("o_orderkey").cast("string"), F.lit('">'), name, F.lit("</a>"))
    start = F.when(F.col("o_orderstatus") == "P", "to be announced").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    raw = o.select("o_orderkey", cell.alias("title"), start.alias("field_start_date"), F.lit(None).cast("string").alias("field_end_date"),
                   F.lit("Center").alias("field_center"),
                   F.concat(F.lit("Office of T"), F.col("o_custkey").cast("string")).alias("field_contributing_office"))
    stored = o.filter("o_orderstatus <> 'F'").select(
        F.concat(F.lit("https://calendar.example.org/events/"), F.col("o_orderkey").cast("string")).alias("canonical_url"))
    types = {"title": "string", "starts_at": "timestamp", "ends_at": "timestamp", "committee_name": "string", "summary_text": "string",
             "company_tag_ids": "array<bigint>", "priority_reason": "string", "importance_score": "double", "market_cap_score": "double",
             "composite_score": "double"}
    stored = stored.select("canonical_url", *[F.lit(None).cast(t).alias(c) for c, t in types.items()])
    out = CAL.sync_calendar(raw, "https://calendar.example.org/", "o_orderkey", stored, V.companies(spark, sf), AF)
    return out.select("canonical_url", "importance_score", "composite_score", "committee_name", "action")


# ---- DS-12 .. DS-15 -----------------------------------------------------------------
@query("ds_12_timelines_and_catalysts", S.sql(TIMELINE_SQL + CATALYST_SQL + """
    , one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, id ORDER BY composite_score DESC) AS rr FROM co) WHERE rr = 1)
    SELECT 'timeline' AS part, company_id, id, CAST(pos AS INT) AS pos FROM tl WHERE pos <= 25
    UNION ALL SELECT 'catalyst', company_id, id, CAST(pos AS INT) FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY k0, k1, k2, id) AS pos FROM one)
      WHERE pos <= 6""", *CATALYST_VIEWS))
def _(spark, sf):
    t = B.company_timeline(V.filings(spark, sf), V.news(spark, sf), V.trials(spark, sf), V.calendar(spark, sf), AF, AN, 25)
    c = B.ranked_catalysts(catalyst_rows(spark, sf))
    return t.select(F.lit("timeline").alias("part"), "company_id", "id", "pos").unionByName(
        c.select(F.lit("catalyst").alias("part"), "company_id", "id", "pos"))


_SIC_TEXT = S.look_up("c.sic", K.COVERED_SIC)


@query("ds_13_company_snapshot", S.sql(TIMELINE_SQL + CATALYST_SQL + f"""
    , one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, id ORDER BY composite_score DESC) AS rr FROM co) WHERE rr = 1),
      ca AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY k0, k1, k2, id) AS pos FROM one),
      cl AS (SELECT company_id, string_agg(CASE item_type WHEN 'trial' THEN CASE WHEN up THEN title || ' on ' || strftime(occurred_at, '%b %-d, %Y') ELSE 'Clinical trial signal: ' || title END
          WHEN 'filing' THEN title || ' (' || strftime(occurred_at, '%b %-d, %Y') || ')' WHEN 'regulatory' THEN 'FDA catalyst: ' || title || ' (' || strftime(occurred_at, '%b %-d, %Y') || ')'
          ELSE title END, '|' ORDER BY pos) AS lines FROM ca WHERE pos <= 4 GROUP BY 1),
      fc AS (SELECT company_id, count(*) AS n FROM filings GROUP BY 1),
      lf AS (SELECT company_id, filing_id FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY filed_at DESC, composite_score DESC, filing_id DESC) AS r2 FROM filings) WHERE r2 = 1),
      ln AS (SELECT cid, news_id FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY published_at DESC, composite_score DESC, news_id DESC) AS r2 FROM nr) WHERE r2 = 1),
      lt AS (SELECT company_id, nct_id FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY last_update_date DESC NULLS LAST, trial_id DESC) AS rn FROM trials) WHERE rn = 1),
      st AS (SELECT company_id, count(DISTINCT story) AS n FROM (SELECT unnest(company_tag_ids) AS company_id, coalesce(dedupe_group_id, 'news:' || news_id) AS story FROM news) GROUP BY 1)
    SELECT c.company_id, coalesce(fc.n, 0) AS filings_count, coalesce(st.n, 0) AS stories, lf.filing_id AS latest_filing, ln.news_id AS latest_news, lt.nct_id AS latest_trial,
      coalesce(nullif(trim(x.raw_text, ' '), ''), {_SIC_TEXT}, 'Covered public life sciences issuer.') AS business_summary, coalesce(cl.lines, '') AS lines
    FROM companies c LEFT JOIN fc ON fc.company_id = c.company_id LEFT JOIN st ON st.company_id = c.company_id LEFT JOIN lf ON lf.company_id = c.company_id
      LEFT JOIN filing_text x ON x.filing_id = lf.filing_id LEFT JOIN ln ON ln.cid = c.company_id LEFT JOIN lt ON lt.company_id = c.company_id
      LEFT JOIN cl ON cl.company_id = c.company_id WHERE c.is_active""", *CATALYST_VIEWS, "filing_text"))
def _(spark, sf):
    s = B.company_snapshot(V.companies(spark, sf), V.filings(spark, sf), V.news(spark, sf), V.trials(spark, sf), V.calendar(spark, sf),
                           lambda ids: V.filing_text(spark, sf, "company_id", ids=ids), AF, AN)
    return s.select("company_id", "filings_count", "stories", "latest_filing", "latest_news", "latest_trial", "business_summary",
                    F.coalesce(F.array_join("catalyst_lines", "|"), F.lit("")).alias("lines"))


def _brief_sql(limit: int, members: str = "watchlist_members") -> str:
    rel_n = _RELW_N.format("true")
    rel_f = S.personal("composite_score", S.recency("filed_at", S.AF), "true", "true", "event_type")
    cal_key = f"CASE WHEN starts_at >= {S.AF} THEN 0 ELSE 1 END, CASE WHEN starts_at >= {S.AF} THEN epoch(starts_at) ELSE -epoch(starts_at) END, composite_score DESC, event_id DESC"
    return f"""
    , bm AS (SELECT * FROM {members}),
      bf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY rel DESC, filed_at DESC, filing_id DESC) AS pos FROM (SELECT f.*, m.watchlist_id AS w, {rel_f} AS rel
        FROM filings f JOIN bm m ON m.company_id = f.company_id WHERE filed_at >= {S.AF} - INTERVAL 120 DAY))),
      bx AS (SELECT DISTINCT news_id, watchlist_id AS w FROM (SELECT news_id, unnest(company_tag_ids) AS c FROM news WHERE published_at >= {S.AN} - INTERVAL 30 DAY) n JOIN bm ON bm.company_id = n.c),
      br AS (SELECT * FROM (SELECT n.*, w, row_number() OVER (PARTITION BY w, coalesce(dedupe_group_id, 'news:' || n.news_id) ORDER BY is_official DESC, composite_score DESC, published_at DESC,
        n.news_id DESC) AS rr FROM news n JOIN bx ON bx.news_id = n.news_id) WHERE rr = 1),
      bn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY rel DESC, published_at DESC, news_id DESC) AS pos FROM (SELECT *, {rel_n} AS rel FROM br))),
      bt AS (SELECT * FROM (SELECT t.*, m.watchlist_id AS w, row_number() OVER (PARTITION BY m.watchlist_id ORDER BY last_update_date DESC NULLS LAST, trial_id DESC) AS pos FROM trials t JOIN bm m
        ON m.company_id = t.company_id)),
      bc AS (SELECT * FROM (SELECT c.*, m.watchlist_id AS w, row_number() OVER (PARTITION BY m.watchlist_id ORDER BY {cal_key}) AS pos FROM calendar c JOIN bm m ON m.company_id = c.company_tag_ids[1]
        WHERE starts_at >= {S.AF} - INTERVAL 90 DAY AND starts_at <= {S.AF} + INTERVAL 180 DAY)),
      bu AS (SELECT w, 'filing-' || filing_id AS id, filed_at AS tm, composite_score AS sc FROM bf UNION ALL SELECT w, 'news-' || news_id, published_at, composite_score FROM bn
        UNION ALL SELECT w, 'trial-' || trial_id, CAST(coalesce(last_update_date, primary_completion_date, start_date) AS TIMESTAMP), 0.0 FROM bt
        UNION ALL SELECT w, 'regulatory-' || event_id, starts_at, composite_score FROM bc),
      bl AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY tm DESC, sc DESC, id DESC) AS pos FROM bu)
    """


@query("ds_14_watchlist_briefing", S.sql(_brief_sql(20) + CATALYST_SQL + """
    , wc AS (SELECT co.*, m.watchlist_id AS w FROM co JOIN bm m ON m.company_id = co.company_id),
      w1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w, id ORDER BY composite_score DESC, company_id) AS rr FROM wc) WHERE rr = 1),
      w2 AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY k0, k1, k2, id) AS pos FROM w1)
    SELECT w AS watchlist_id, 'filings' AS section, CAST(pos AS INT) AS pos, CAST(filing_id AS VARCHAR) AS item FROM bf WHERE pos <= 20
    UNION ALL SELECT w, 'news', CAST(pos AS INT), CAST(news_id AS VARCHAR) FROM bn WHERE pos <= 20
    UNION ALL SELECT w, 'trials', CAST(pos AS INT), nct_id FROM bt WHERE pos <= 20 UNION ALL SELECT w, 'timeline', CAST(pos AS INT), id FROM bl WHERE pos <= 20
    UNION ALL SELECT w, 'catalysts', CAST(pos AS INT), id FROM w2 WHERE pos <= 10""", *CATALYST_VIEWS, "watchlist_members"))
def _(spark, sf):
    return B.watchlist_briefing(V.watchlist_members(spark, sf), V.filings(spark, sf), V.news(spark, sf), V.trials(spark, sf),
                                V.calendar(spark, sf), V.companies(spark, sf), AF, AN)


@query("ds_15_dashboard", S.sql(_brief_sql(3, "watchlist_members WHERE watchlist_id IN (SELECT watchlist_id FROM watchlists)") + QUEUE_SQL + f"""
    , fl AS (SELECT f.* FROM filings f JOIN companies c ON c.company_id = f.company_id),
      nl AS (SELECT * FROM (SELECT *, {_REP} AS rr FROM news WHERE published_at >= {S.AN} - INTERVAL 1 DAY) WHERE rr = 1),
      ni AS (SELECT * FROM (SELECT *, {_REP} AS rr FROM news WHERE published_at >= {S.AN} - INTERVAL 14 DAY) WHERE rr = 1)
    SELECT * FROM (SELECT 'latest_filings' AS section, CAST(row_number() OVER (ORDER BY filed_at DESC, composite_score DESC, filing_id DESC) AS INT) AS pos, CAST(filing_id AS VARCHAR) AS item FROM fl
        WHERE filed_at >= {S.AF} - INTERVAL 1 DAY) WHERE pos <= 5
    UNION ALL SELECT * FROM (SELECT 'important_filings', CAST(row_number() OVER (ORDER BY composite_score DESC, filed_at DESC, filing_id DESC) AS INT) AS pos, CAST(filing_id AS VARCHAR) FROM fl
        WHERE filed_at >= {S.AF} - INTERVAL 90 DAY) WHERE pos <= 5
    UNION ALL SELECT * FROM (SELECT 'latest_news', CAST(row_number() OVER (ORDER BY published_at DESC, composite_score DESC, news_id DESC) AS INT) AS pos, CAST(news_id AS VARCHAR) FROM nl) WHERE pos <= 5
    UNION ALL SELECT * FROM (SELECT 'important_news', CAST(row_number() OVER (ORDER BY composite_score DESC, published_at DESC, news_id DESC) AS INT) AS pos, CAST(news_id AS VARCHAR) FROM ni) WHERE pos <= 5
    UNION ALL SELECT * FROM (SELECT 'calendar', CAST(row_number() OVER (ORDER BY starts_at, composite_score DESC, event_id DESC) AS INT) AS pos, CAST(event_id AS VARCHAR) FROM calendar
        WHERE starts_at >= {S.AF} - INTERVAL 14 DAY AND starts_at <= {S.AF} + INTERVAL 180 DAY) WHERE pos <= 6
    UNION ALL SELECT * FROM (SELECT 'recent_trials', CAST(row_number() OVER (ORDER BY last_update_date DESC NULLS LAST, trial_id DESC) AS INT) AS pos, nct_id FROM trials) WHERE pos <= 5
    UNION ALL SELECT 'highlights-' || w, CAST(pos AS INT), id FROM bl WHERE pos <= 3
    UNION ALL SELECT 'count-companies', 1, CAST(count(*) AS VARCHAR) FROM companies UNION ALL SELECT 'count-filings', 1, CAST(count(*) AS VARCHAR) FROM filings
    UNION ALL SELECT 'count-news_items', 1, CAST(count(*) AS VARCHAR) FROM news UNION ALL SELECT 'count-regulatory_events', 1, CAST(count(*) AS VARCHAR) FROM calendar
    UNION ALL SELECT 'count-clinical_trials', 1, CAST(count(*) AS VARCHAR) FROM trials
    UNION ALL SELECT 'queue-filings', 1, count(*) || '/' || count(*) FILTER (tier = 'full') || '/' || count(*) FILTER (tier = 'short') FROM qf
    UNION ALL SELECT 'queue-news', 1, count(*) || '/' || count(*) FILTER (tier = 'full') || '/' || count(*) FILTER (tier = 'short') FROM qn""",
                                *CATALYST_VIEWS, "watchlists", "watchlist_members"))
def _(spark, sf):
    return DASH.dashboard(V.filings(spark, sf), V.news(spark, sf), V.trials(spark, sf), V.calendar(spark, sf), V.companies(spark, sf),
                          V.watchlists(spark, sf), V.watchlist_members(spark, sf), AF, AN)


# ---- DS-16, DS-17 ----------------------------------------------------------------------
def _digest_sql(unit: str, limit: int, kind: str) -> str:
    local = f"CAST(date_trunc('{unit}', ({{}} AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS DATE)"
    return f"""
    , df{kind} AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY c) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY composite_score DESC, filed_at DESC, filing_id DESC) AS c
        FROM (SELECT *, {local.format('filed_at')} AS d FROM filings)) WHERE (status = 'complete' OR nullif(summary, '') IS NOT NULL)),
      dn{kind} AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY c) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY composite_score DESC, published_at DESC, news_id DESC) AS c
        FROM (SELECT *, {local.format('published_at')} AS d FROM news)) WHERE (status = 'complete' OR nullif(summary, '') IS NOT NULL)),
      gf{kind} AS (SELECT d, count(*) AS n, string_agg(CAST(filing_id AS VARCHAR), ',' ORDER BY pos) AS ids FROM df{kind} WHERE pos <= {limit} GROUP BY 1),
      gn{kind} AS (SELECT d, count(*) AS n, string_agg(CAST(news_id AS VARCHAR), ',' ORDER BY pos) AS ids, min_by(title, pos) AS top FROM dn{kind} WHERE pos <= {limit} GROUP BY 1),
      dg{kind} AS (SELECT '{kind}' AS digest_type, CAST(coalesce(f.d, n.d) AS VARCHAR) AS window_start, coalesce(f.ids, '') AS filings, coalesce(n.ids, '') AS news, concat_ws(' ',
        CASE WHEN f.n > 0 THEN f.n || ' notable filings were captured in this window.' END, CASE WHEN n.n > 0 THEN n.n || ' important news items were tracked, led by ' || n.top || '.' END) AS narrative
        FROM gf{kind} f FULL OUTER JOIN gn{kind} n ON f.d = n.d)
    """


@query("ds_16_digests", S.sql(_digest_sql("day", 8, "daily") + _digest_sql("week", 10, "weekly") + """
    SELECT * FROM dgdaily WHERE window_start NOT IN ('2024-01-10', '2024-01-11') UNION ALL SELECT * FROM dgweekly""", "filings", "news"))
def _(spark, sf):
    f, n = V.filings(spark, sf), V.news(spark, sf)
    # Two stored digests: their windows are reused, not built again.
    dates = V.table(spark, sf, "events").select(F.col("ts").cast("date").alias("window_start")).filter(
        F.col("window_start").between("2024-01-10", "2024-01-11")).distinct().withColumn("digest_type", F.lit("daily"))
    both = B.digests(f, n, "daily", dates).unionByName(B.digests(f, n, "weekly"))
    ids = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
    return both.select("digest_type", F.col("window_start").cast("string").alias("window_start"), ids("filing_ids").alias("filings"),
                       ids("news_ids").alias("news"), "narrative")


_STAGED = f"""
    , w AS (SELECT DISTINCT company_id FROM watchlist_members),
      f1 AS (SELECT * FROM filings WHERE status IN ('pending', 'failed', 'stale') AND attempts < 3 AND filed_at >= {S.AF} - INTERVAL 21 DAY AND ingest_origin = 'sec_poll'),
      f2 AS (SELECT f1.*, coalesce(p.pct, 0.0) AS cap, {S.recency('filed_at', S.AF)} AS rec, f1.company_id IN (SELECT company_id FROM w) AS watched FROM f1 LEFT JOIN percentile p ON p.company_id = f1.company_id),
      f3 AS (SELECT *, {S.cents(f"0.30 * {S.form_base('normalized_form_type', 50.0)} + 0.30 * {S.material("concat_ws(' ', title, event_type, nullif(array_to_string(item_numbers, ' '), ''))")} + 0.20 * cap + 0.20 * rec + CASE WHEN watched THEN 20.0 ELSE 0.0 END")} AS cheap FROM f2),
      f4 AS (SELECT * FROM f3),
      f5 AS (SELECT f4.*, {S.cents(f"0.30 * {S.form_base('f4.normalized_form_type', 50.0)} + 0.30 * {S.material('t.raw_text')} + 0.20 * cap + 0.20 * rec")} + CASE WHEN watched THEN 20.0 ELSE 0.0 END AS priority
        FROM f4 JOIN filing_text t ON t.filing_id = f4.filing_id),
      qf AS (SELECT 'filing' AS queue, filing_id AS item_id, priority, row_number() OVER (ORDER BY priority DESC, cheap DESC, filed_at DESC, filing_id DESC) AS rk, watched OR normalized_form_type = '8-K' OR
          coalesce(event_type IN {S.listed(K.FILING_OVERRIDE_EVENTS)}, false) AS eligible, normalized_form_type IN {S.listed(K.FILING_FULL_TIER_FORMS)} OR watched OR
          coalesce(event_type IN {S.listed(K.FILING_FULL_TIER_EVENTS)}, false) AS full_tier FROM f5),
      hit AS (SELECT DISTINCT news_id FROM (SELECT news_id, unnest(company_tag_ids) AS c FROM news) WHERE c IN (SELECT company_id FROM w)),
      ncap AS (SELECT news_id, max(pct) AS cap FROM (SELECT news_id, unnest(company_tag_ids) AS company_id FROM news) t JOIN percentile p ON t.company_id = p.company_id GROUP BY 1),
      n1 AS (SELECT * FROM news WHERE status IN ('pending', 'failed', 'stale') AND attempts < 3 AND published_at >= {S.AN} - INTERVAL 5 DAY),
      n2 AS (SELECT n1.*, coalesce(c.cap, 0.0) AS cap, {S.recency('published_at', S.AN)} AS rec, h.news_id IS NOT NULL AS watched FROM n1 LEFT JOIN ncap c ON c.news_id = n1.news_id
        LEFT JOIN hit h ON h.news_id = n1.news_id),
      n3 AS (SELECT *, {S.cents(f"0.25 * source_weight * 100.0 + 0.30 * {S.material('excerpt')} + 0.15 * cap + 0.30 * rec")} AS base FROM n2),
      n4 AS (SELECT * FROM n3),
      qn AS (SELECT 'news' AS queue, news_id AS item_id, base + CASE WHEN watched THEN 20.0 ELSE 0.0 END AS priority, row_number() OVER (ORDER BY base + CASE WHEN watched THEN 20.0 ELSE 0.0 END DESC, published_at DESC, news_id DESC) AS rk,
          is_official OR coalesce(event_type IN {S.listed(K.NEWS_OVERRIDE_EVENTS)}, false) OR watched AS eligible,
          is_official OR coalesce(event_type IN {S.listed(K.NEWS_FULL_TIER_EVENTS)}, false) OR watched AS full_tier FROM n4),
      qa AS (SELECT * FROM qf UNION ALL SELECT * FROM qn)
    """
_STAGED_VIEWS = ("filings", "filing_text", "news", "percentile", "watchlist_members")


def _queues(spark, sf):
    c, m, n = V.companies(spark, sf), V.watchlist_members(spark, sf), V.news(spark, sf)
    bodies = lambda rows: ENR.filing_texts(V.filing_text(spark, sf, ids=rows.select(F.col("item_id").alias("filing_id"))))
    return ((ENR.filing_queue(V.filings(spark, sf), c, m, AF), bodies, ENR.filing_score),
            (ENR.news_queue(n, c, m, AN), ENR.news_texts(n), ENR.news_score))


@query("srt_6_staged_candidates", S.sql(_STAGED + """
    SELECT queue, item_id, CAST(rk AS INT) AS rank, round(priority, 2) AS priority, eligible, CASE WHEN full_tier THEN 'full_ai' ELSE 'short_ai' END AS tier FROM qa
    WHERE rk <= CASE WHEN queue = 'filing' THEN 50 ELSE 80 END""", *_STAGED_VIEWS))
def _(spark, sf):
    f, n = (ENR.candidates(*q, k).select("queue", "item_id", "rank", "priority", "eligible", "tier") for q, k in zip(_queues(spark, sf), (50, 80)))
    return f.unionByName(n).select("queue", "item_id", "rank", F.round("priority", 2).alias("priority"), "eligible", "tier")


@query("ds_17_enrichment_queue", "WITH RECURSIVE " + S.sql(_STAGED + """
    , lim(queue, p, fu, sh, mx) AS (VALUES ('filing', 16, 4, 12, 3), ('news', 38, 8, 30, 8)),
      walk AS (SELECT queue, 0::BIGINT AS rk, NULL::BIGINT AS item_id, p, 8 AS o, fu, sh, 0 AS took, mx, NULL::VARCHAR AS budget_kind, NULL::VARCHAR AS tier FROM lim
        UNION ALL SELECT s.queue, s.rk, s.item_id, s.p - CASE WHEN s.bk = 'primary' AND s.ok THEN 1 ELSE 0 END, s.o - CASE WHEN s.bk = 'override' AND s.ok THEN 1 ELSE 0 END,
          s.fu - CASE WHEN s.tr = 'full_ai' AND s.ok THEN 1 ELSE 0 END, s.sh - CASE WHEN s.tr = 'short_ai' AND s.ok THEN 1 ELSE 0 END, s.took + CASE WHEN s.ok THEN 1 ELSE 0 END, s.mx,
          CASE WHEN s.ok THEN s.bk END, CASE WHEN s.ok THEN s.tr END
        FROM (SELECT x.*, x.bk IS NOT NULL AND x.tr IS NOT NULL AND x.took < x.mx AS ok FROM (SELECT q.queue, q.rk, q.item_id, k.p, k.o, k.fu, k.sh, k.took, k.mx,
            CASE WHEN k.p > 0 THEN 'primary' WHEN q.eligible AND k.o > 0 THEN 'override' END AS bk, CASE WHEN q.full_tier AND k.fu > 0 THEN 'full_ai' WHEN k.sh > 0 THEN 'short_ai' END AS tr
          FROM walk k JOIN qa q ON q.queue = k.queue AND q.rk = k.rk + 1 WHERE k.took < k.mx) x) s)
    SELECT queue, item_id, CAST(took AS INT) AS rank, budget_kind, tier FROM walk WHERE tier IS NOT NULL""", *_STAGED_VIEWS)[5:])
def _(spark, sf):
    f, n = _queues(spark, sf)
    return ENR.selection(*f, "filing", 3).unionByName(ENR.selection(*n, "news", 8))
