"""Row filters over whole tables."""

from pyspark.sql import functions as F

from signaldesk import constants as K
from signaldesk.catalog import query, sqltext as S
from signaldesk.functions import classify as C, dates as D, text as T
from signaldesk.operators import filters as O
from signaldesk.sources import views as V

AF, AN = V.AS_OF_FILINGS, V.AS_OF_NEWS


@query("flt_1_target_forms", S.sql(
    f"SELECT filing_id, form_type FROM filings WHERE upper(form_type) IN {S.listed(K.TARGET_FORMS)}", "filings"))
def _(spark, sf):
    return V.filings(spark, sf).filter(C.is_target_form("form_type")).select("filing_id", "form_type")


@query("flt_2_coverage", S.sql(f"""
    , allow AS (SELECT 'T' || c_custkey AS code FROM customer WHERE c_acctbal > 9000),
      deny AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS code FROM customer WHERE c_acctbal < -500)
    SELECT cik, ticker, CASE WHEN ticker IN (SELECT code FROM allow) OR cik IN (SELECT code FROM allow)
           THEN 'manual-allowlist' ELSE 'sic-allowlist' END AS universe_reason
    FROM companies WHERE NOT (ticker IN (SELECT code FROM deny) OR cik IN (SELECT code FROM deny))
      AND (ticker IN (SELECT code FROM allow) OR cik IN (SELECT code FROM allow) OR sic IN {S.listed(K.COVERED_SIC)})
    """, "companies"))
def _(spark, sf):
    c = V.table(spark, sf, "customer")
    allow = c.filter("c_acctbal > 9000").select(F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("code"))
    deny = c.filter("c_acctbal < -500").select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("code"))
    return O.covered_companies(V.companies(spark, sf), allow, deny).select("cik", "ticker", "universe_reason")


@query("flt_3_periodic_6k", S.sql(f"""
    SELECT t.filing_id, {S.has_any("lower(concat_ws(' ', nullif(f.title, ''), nullif(f.items, ''), t.raw_text))", K.PERIODIC_6K_WORDS)}
        AS periodic FROM filing_text t JOIN filings f ON t.filing_id = f.filing_id""", "filing_text"))
def _(spark, sf):
    return V.filing_text(spark, sf, "title", "items").select(
        "filing_id", C.is_periodic_6k("title", "items", "raw_text").alias("periodic"))


@query("flt_4_material_8k", S.sql(f"""
    SELECT t.filing_id, list_has_any(f.item_numbers, [{", ".join(S.q(i) for i in K.MATERIAL_ITEMS)}]) OR
        {S.has_any("lower(concat_ws(' ', nullif(f.title, ''), t.raw_text))", K.MATERIAL_8K_WORDS)} AS material
    FROM filing_text t JOIN filings f ON t.filing_id = f.filing_id""", "filing_text"))
def _(spark, sf):
    return V.filing_text(spark, sf, "title", "item_numbers").select(
        "filing_id", C.is_material_8k("item_numbers", "title", "raw_text").alias("material"))


@query("flt_5_ingest_gate", S.sql(f"""
    SELECT f.filing_id, f.normalized_form_type FROM filing_text t JOIN filings f ON t.filing_id = f.filing_id
    WHERE upper(f.form_type) IN {S.listed(K.TARGET_FORMS)} AND nullif(f.accession_number, '') IS NOT NULL AND
      CASE f.normalized_form_type
        WHEN '6-K' THEN {S.has_any("lower(concat_ws(' ', nullif(f.title, ''), nullif(f.items, ''), t.raw_text))", K.PERIODIC_6K_WORDS)}
        WHEN '8-K' THEN list_has_any(f.item_numbers, [{", ".join(S.q(i) for i in K.MATERIAL_ITEMS)}]) OR
          {S.has_any("lower(concat_ws(' ', nullif(f.title, ''), t.raw_text))", K.MATERIAL_8K_WORDS)}
        ELSE true END""", "filing_text"))
def _(spark, sf):
    t = V.filing_text(spark, sf, "form_type", "accession_number", "title", "items", "normalized_form_type")
    return t.filter(
        C.passes_ingest_gate("form_type", "accession_number", "items", "title", "raw_text")).select(
        "filing_id", "normalized_form_type")


@query("flt_6_promo_titles", S.sql(
    "SELECT news_id, title FROM news0 WHERE NOT regexp_matches(lower(title), 'webinar|whitepaper|sponsored|advertisement')",
    "news0"))
def _(spark, sf):
    return V.news(spark, sf).filter(~C.is_promotional("title")).select("news_id", "title")


@query("flt_7_recency", S.sql(
    f"SELECT filing_id FROM filings WHERE filed_at >= {S.AF} - INTERVAL 120 DAY", "filings"))
def _(spark, sf):
    return O.recent(V.filings(spark, sf), "filed_at", AF, 120).select("filing_id")


@query("flt_8_half_open_window", S.sql("""
    SELECT news_id FROM news0 WHERE published_at >= TIMESTAMP '2024-01-08' AND published_at < TIMESTAMP '2024-01-15'""",
                                       "news0"))
def _(spark, sf):
    return O.in_window(V.news(spark, sf), "published_at", "2024-01-08 00:00:00", "2024-01-15 00:00:00").select("news_id")


@query("flt_9_search", S.sql("""
    SELECT 'filing' AS kind, filing_id AS id FROM filings f JOIN companies c ON f.company_id = c.company_id
    WHERE title ILIKE '%merger%' OR c.name ILIKE '%merger%' OR c.ticker ILIKE '%merger%'
    UNION ALL SELECT 'news', news_id FROM news WHERE title ILIKE '%FINANCING%' OR excerpt ILIKE '%FINANCING%'
    UNION ALL SELECT 'trial', trial_id FROM trials WHERE title ILIKE '%ring%'
    UNION ALL SELECT 'company', company_id FROM companies WHERE name ILIKE '%00_1%' OR ticker ILIKE '%00_1%'""",
                             "filings", "companies", "news", "trials"))
def _(spark, sf):
    c = V.companies(spark, sf)
    f = V.filings(spark, sf).select("filing_id", "company_id", "title").join(
        c.select("company_id", "name", "ticker"), "company_id")
    parts = [
        O.search(f, "merger", "title", "name", "ticker").select(F.lit("filing").alias("kind"), F.col("filing_id").alias("id")),
        O.search(V.news(spark, sf), "FINANCING", "title", "excerpt").select(F.lit("news").alias("kind"), F.col("news_id").alias("id")),
        O.search(V.trials(spark, sf), "ring", "title").select(F.lit("trial").alias("kind"), F.col("trial_id").alias("id")),
        O.search(c, "00_1", "name", "ticker").select(F.lit("company").alias("kind"), F.col("company_id").alias("id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("flt_10_facets", S.sql("""
    SELECT trial_id AS id, 'trial' AS kind FROM trials WHERE phase = 'Phase 3' AND status = 'Recruiting'
    UNION ALL SELECT filing_id, 'filing' FROM filings WHERE normalized_form_type = '10-Q'
    UNION ALL SELECT news_id, 'news' FROM news WHERE source_name = 'signup'""", "trials", "filings", "news"))
def _(spark, sf):
    t = O.facets(V.trials(spark, sf), phase="Phase 3", status="Recruiting", company_id=None)
    f = O.facets(V.filings(spark, sf), normalized_form_type="10-Q")
    n = O.facets(V.news(spark, sf), source_name="signup")
    return (t.select(F.col("trial_id").alias("id"), F.lit("trial").alias("kind"))
            .unionByName(f.select(F.col("filing_id").alias("id"), F.lit("filing").alias("kind")))
            .unionByName(n.select(F.col("news_id").alias("id"), F.lit("news").alias("kind"))))


@query("flt_11_pending_queue", S.sql(f"""
    SELECT 'filing' AS kind, filing_id AS id FROM filings WHERE status IN ('pending', 'failed', 'stale') AND attempts < 3
      AND filed_at >= {S.AF} - INTERVAL 21 DAY AND ingest_origin = 'sec_poll'
    UNION ALL SELECT 'news', news_id FROM news0 WHERE status IN ('pending', 'failed', 'stale') AND attempts < 3
      AND published_at >= {S.AN} - INTERVAL 5 DAY""", "filings", "news0"))
def _(spark, sf):
    f = O.pending_queue(V.filings(spark, sf), "filed_at", AF, K.FILING_BACKLOG_DAYS, "ingest_origin")
    n = O.pending_queue(V.news(spark, sf), "published_at", AN, K.NEWS_BACKLOG_DAYS)
    return f.select(F.lit("filing").alias("kind"), F.col("filing_id").alias("id")).unionByName(
        n.select(F.lit("news").alias("kind"), F.col("news_id").alias("id")))


@query("flt_12_tag_overlap", S.sql("""
    SELECT DISTINCT n.news_id FROM (SELECT news_id, unnest(company_tag_ids) AS company_id FROM news0) n
    JOIN watchlist_members m ON n.company_id = m.company_id""", "news0", "watchlist_members"))
def _(spark, sf):
    return O.overlapping(V.news(spark, sf).select("news_id", "company_tag_ids"), "company_tag_ids",
                         V.watchlist_members(spark, sf), "news_id").select("news_id")


@query("flt_13_has_summary", S.sql(
    "SELECT filing_id FROM filings WHERE status = 'complete' OR nullif(summary, '') IS NOT NULL", "filings"))
def _(spark, sf):
    return V.filings(spark, sf).filter(C.has_summary("status", "summary")).select("filing_id")


@query("flt_14_catalyst_rules", S.sql(f"""
    SELECT 'filing' AS kind, filing_id AS id FROM filings WHERE normalized_form_type IN ('8-K', '6-K') OR {S.high_signal('event_type')}
    UNION ALL SELECT 'news', news_id FROM news WHERE is_official OR {S.high_signal('event_type')}
    UNION ALL SELECT 'trial-' || CASE WHEN primary_completion_date BETWEEN DATE '2000-06-01' AND DATE '2000-11-28' THEN 'upcoming'
        ELSE 'recent' END, trial_id FROM trials
      WHERE primary_completion_date BETWEEN DATE '2000-06-01' AND DATE '2000-11-28' OR last_update_date >= DATE '2000-03-03'
    UNION ALL SELECT 'calendar', event_id FROM calendar WHERE starts_at >= {S.AF} - INTERVAL 90 DAY AND starts_at < TIMESTAMP '2000-11-29'
    """, "filings", "news", "trials", "calendar"))
def _(spark, sf):
    t = V.trials(spark, sf).withColumn("k", C.trial_catalyst_kind("primary_completion_date", "last_update_date", AF))
    parts = [
        V.filings(spark, sf).filter(C.filing_catalyst("normalized_form_type", "event_type"))
        .select(F.lit("filing").alias("kind"), F.col("filing_id").alias("id")),
        V.news(spark, sf).filter(C.news_catalyst("is_official", "event_type"))
        .select(F.lit("news").alias("kind"), F.col("news_id").alias("id")),
        t.filter("k is not null").select(F.concat(F.lit("trial-"), "k").alias("kind"), F.col("trial_id").alias("id")),
        V.calendar(spark, sf).filter(C.calendar_catalyst("starts_at", AF))
        .select(F.lit("calendar").alias("kind"), F.col("event_id").alias("id")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("flt_15_override_rules", S.sql(f"""
    , hits AS (SELECT DISTINCT news_id FROM (SELECT news_id, unnest(company_tag_ids) AS c FROM news) WHERE c IN
        (SELECT company_id FROM watchlist_members))
    SELECT 'filing' AS kind, filing_id AS id FROM filings WHERE company_id IN (SELECT company_id FROM watchlist_members)
      OR normalized_form_type = '8-K' OR coalesce(event_type IN {S.listed(K.FILING_OVERRIDE_EVENTS)}, false)
    UNION ALL SELECT 'news', news_id FROM news WHERE is_official OR coalesce(event_type IN {S.listed(K.NEWS_OVERRIDE_EVENTS)}, false)
      OR news_id IN (SELECT news_id FROM hits)""", "filings", "news", "watchlist_members"))
def _(spark, sf):
    from signaldesk.operators.tagging import flag_watched

    members = V.watchlist_members(spark, sf)
    f = O.flag_members(V.filings(spark, sf), members).filter(
        C.filing_override_eligible("normalized_form_type", "event_type", "watched"))
    n = flag_watched(V.news(spark, sf), members, "news_id").filter(
        C.news_override_eligible("is_official", "event_type", "watched"))
    return f.select(F.lit("filing").alias("kind"), F.col("filing_id").alias("id")).unionByName(
        n.select(F.lit("news").alias("kind"), F.col("news_id").alias("id")))


_TOKENS = "list_filter(regexp_split_to_array(line, '\\s+'), lambda t: length(t) > 0)"
_NS = f"len(list_filter({_TOKENS}, lambda t: regexp_matches(t, '(?i)^[a-z][\\w.-]*:[\\w.-]+$')))"
_MARK = f"len(list_filter({_TOKENS}, lambda t: regexp_matches(t, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{8,10}})$')))"


@query("flt_16_noise_lines", f"""
    WITH lines AS (SELECT page_id AS id, unnest(string_split(html, '>')) AS line FROM pages
      UNION ALL SELECT event_id, props FROM events UNION ALL SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) FROM orders
      UNION ALL SELECT c_custkey, 'us-gaap:Customer' || c_custkey || ' dei:Key 2024-01-31' FROM customer)
    SELECT id, count(*) AS n, CAST(sum(CASE WHEN regexp_matches(line, '(?i)^(https?://\\S+\\s*)+$') OR regexp_matches(line, '^\\d{{1,4}}$')
      OR lower(line) IN {S.listed(K.METADATA_TOKENS)} OR ({_NS} >= 1 AND len({_TOKENS}) = 1)
      OR ({_NS} >= 2 AND ({_NS} + {_MARK}) >= len({_TOKENS}) * 0.6)
      OR regexp_matches(lower(line), '^(https?://fasb\\.org/|https?://xbrl\\.)') THEN 1 ELSE 0 END) AS BIGINT) AS noise
    FROM lines GROUP BY id""")
def _(spark, sf):
    p = V.pages(spark, sf).select(F.col("page_id").alias("id"), F.explode(F.split("html", ">")).alias("line"))
    e = V.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("props").alias("line"))
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("line"))
    c = V.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("us-gaap:Customer"), F.col("c_custkey").cast("string"), F.lit(" dei:Key 2024-01-31")).alias("line"))
    lines = p.unionByName(e).unionByName(o).unionByName(c)
    return lines.groupBy("id").agg(F.count(F.lit(1)).alias("n"),
                                   F.count_if(T.is_noise_line(F.col("line"))).alias("noise"))


@query("flt_17_backfill_cut", S.sql("""
    SELECT filing_id, company_id FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY filed_at DESC, filing_id DESC) AS rn
      FROM filings WHERE CAST(filed_at AS DATE) >= DATE '1998-06-01') WHERE rn <= 4""", "filings"))
def _(spark, sf):
    return O.backfill_cut(V.filings(spark, sf), "company_id", "filed_at", as_of=AF, years_back=2, per_key=4).select(
        "filing_id", "company_id")


@query("flt_18_calendar_range", S.sql(f"""
    SELECT event_id FROM calendar0 WHERE starts_at >= {S.AF} - INTERVAL 90 DAY AND starts_at <= {S.AF} + INTERVAL 180 DAY
      AND company_tag_ids[1] IN (SELECT company_id FROM watchlist_members)""", "calendar0", "watchlist_members"))
def _(spark, sf):
    c = O.calendar_range(V.calendar(spark, sf), AF, 90, 180)
    return O.overlapping(c, "company_tag_ids", V.watchlist_members(spark, sf), "event_id").select("event_id")


@query("flt_19_focus_scope", S.sql("""
    SELECT news_id FROM news0 WHERE list_has_any(company_tag_ids, [1, 5, 9]) OR (news_id % 150) IN (1, 5, 9)""", "news0"))
def _(spark, sf):
    n = V.news(spark, sf).withColumn("new_tags", F.array(F.col("news_id") % 150))
    return O.focus_scope(n, "company_tag_ids", "new_tags", [1, 5, 9]).select("news_id")
