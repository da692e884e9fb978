"""Joins, links and synchronisation over whole tables."""

from pyspark.sql import functions as F

from signaldesk.catalog import query, sqltext as S
from signaldesk.operators import linking as L, ranking as RK, sync, tagging as G
from signaldesk.sources import views as V

AF, AN = V.AS_OF_FILINGS, V.AS_OF_NEWS


@query("jn_1_filing_company", S.sql("""
    SELECT f.filing_id, c.name, c.ticker FROM filings0 f JOIN companies c ON f.company_id = c.company_id""", "filings0", "companies"))
def _(spark, sf):
    return V.filings(spark, sf).join(V.companies(spark, sf), "company_id").select("filing_id", "name", "ticker")


_LINKS = """
    , links AS (SELECT l_orderkey AS filing_id, l_partkey % (SELECT max(event_id) + 1 FROM events) AS news_id, max(l_discount) AS confidence
        FROM lineitem GROUP BY 1, 2)
    """


def _links(spark, sf):
    n = V.table(spark, sf, "events").agg(F.max("event_id") + 1).scalar()
    li = V.table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("filing_id"), (F.col("l_partkey") % n).alias("news_id"), "l_discount").groupBy(
        "filing_id", "news_id").agg(F.max("l_discount").alias("confidence"))


@query("jn_2_related_news", S.sql(_LINKS + """
    SELECT r.filing_id, r.news_id, n.title FROM (SELECT *, row_number() OVER (PARTITION BY filing_id ORDER BY confidence DESC, news_id DESC)
      AS rn FROM links) r JOIN news0 n ON r.news_id = n.news_id WHERE rn <= 5""", "news0"))
def _(spark, sf):
    return L.related_news(_links(spark, sf), V.news(spark, sf).select("news_id", "title")).select("filing_id", "news_id", "title")


@query("jn_3_trial_company", S.sql("""
    SELECT t.trial_id, c.name AS company_name, c.ticker FROM trials t LEFT JOIN companies c ON t.company_id = c.company_id AND c.is_active""",
                                   "trials", "companies"))
def _(spark, sf):
    c = V.companies(spark, sf).filter("is_active").select("company_id", F.col("name").alias("company_name"), "ticker")
    return V.trials(spark, sf).join(c, "company_id", "left").select("trial_id", "company_name", "ticker")


def _stored_split(spark, sf):
    f = V.filings(spark, sf)
    return f, f.filter("status = 'complete'")


@query("jn_4_anti_join", S.sql("SELECT filing_id FROM filings0 WHERE status <> 'complete'", "filings0"))
def _(spark, sf):
    incoming, stored = _stored_split(spark, sf)
    return sync.new_by_key(incoming, stored, "accession_number").select("filing_id")


@query("jn_5_either_key", "WITH RECURSIVE " + S.sql("""
    , x AS (SELECT news_id, 'https://s.example/' || (news_id % 997) AS url, sha256(title || (news_id % 211)) AS hash, source_name, composite_score AS score FROM news0),
      kept AS (SELECT * FROM x WHERE url NOT IN (SELECT url FROM x WHERE source_name = 'view' AND score > 100)
        AND hash NOT IN (SELECT hash FROM x WHERE source_name = 'view' AND score > 100)),
      n AS (SELECT news_id, row_number() OVER (ORDER BY news_id) AS i, dense_rank() OVER (ORDER BY url) - 1 AS u, dense_rank() OVER (ORDER BY hash) - 1 AS h FROM kept),
      blank AS (SELECT repeat('0', CAST(greatest(max(u), max(h)) + 1 AS INT))::BIT AS z FROM n),
      walk AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS news_id, z AS urls, z AS hashes, false AS ok FROM blank
        UNION ALL SELECT s.i, s.news_id, CASE WHEN s.free THEN set_bit(s.urls, s.u, 1) ELSE s.urls END, CASE WHEN s.free THEN set_bit(s.hashes, s.h, 1) ELSE s.hashes END, s.free
        FROM (SELECT n.i, n.news_id, k.urls, k.hashes, CAST(n.u AS INT) AS u, CAST(n.h AS INT) AS h,
            get_bit(k.urls, CAST(n.u AS INT)) = 0 AND get_bit(k.hashes, CAST(n.h AS INT)) = 0 AS free FROM walk k JOIN n ON n.i = k.i + 1) s)
    SELECT news_id FROM walk WHERE ok""", "news0")[5:])
def _(spark, sf):
    n = V.news(spark, sf).select(
        "news_id", "source_name", "composite_score", F.concat(F.lit("https://s.example/"), (F.col("news_id") % 997).cast("string")).alias("url"),
        F.sha2(F.concat("title", (F.col("news_id") % 211).cast("string")), 256).alias("hash"))
    stored = n.filter("source_name = 'view' and composite_score > 100")
    return sync.new_by_either(n, stored, ("url", "hash"), "news_id").select("news_id")


_GRP = "CASE WHEN normalized_form_type IN ('10-K', '20-F', '40-F') THEN 'annual' ELSE 'interim' END"


@query("jn_6_prior_asof", S.sql(f"""
    , g AS (SELECT filing_id, company_id, filed_at, normalized_form_type, {_GRP} AS grp FROM filings),
      c AS (SELECT company_id, grp, filed_at, max(filing_id) AS best FROM g WHERE normalized_form_type <> 'S-1' GROUP BY ALL)
    SELECT g.filing_id, c.best AS prior_id FROM g ASOF LEFT JOIN c ON g.company_id = c.company_id AND g.grp = c.grp AND g.filed_at > c.filed_at""",
                                "filings"))
def _(spark, sf):
    return L.prior_strict(V.filings(spark, sf)).select("filing_id", "prior_id")


@query("jn_7_prior_sequential", S.sql(f"""
    SELECT filing_id, lag(filing_id) OVER (PARTITION BY company_id, {_GRP} ORDER BY filed_at, filing_id) AS prior_id FROM filings""", "filings"))
def _(spark, sf):
    return L.prior_sequential(V.filings(spark, sf)).select("filing_id", "prior_id")


@query("jn_10_seed_prepend", S.sql("""
    SELECT news_id, array_to_string(CASE WHEN is_official THEN list_concat([7], list_filter(company_tag_ids, lambda x: x <> 7))
      ELSE company_tag_ids END, ',') AS tags FROM news0""", "news0"))
def _(spark, sf):
    seed = F.when(F.col("is_official"), F.lit(7).cast("bigint"))
    return V.news(spark, sf).select("news_id", F.array_join(
        F.transform(G.seed_first(seed, "company_tag_ids"), lambda i: i.cast("string")), ",").alias("tags"))


@query("jn_17_tag_names", S.sql("""
    , x AS (SELECT news_id, unnest(company_tag_ids) AS company_id, generate_subscripts(company_tag_ids, 1) AS pos FROM news0),
      n AS (SELECT x.news_id, string_agg(c.name, '|' ORDER BY pos) AS names FROM x JOIN companies c ON x.company_id = c.company_id AND c.is_active GROUP BY 1)
    SELECT news0.news_id, coalesce(names, '') AS names FROM news0 LEFT JOIN n ON n.news_id = news0.news_id""", "news0", "companies"))
def _(spark, sf):
    n = V.news(spark, sf).select("news_id", "company_tag_ids")
    return G.tag_names(n, "news_id", "company_tag_ids", V.companies(spark, sf).filter("is_active")).select(
        "news_id", F.array_join("company_names", "|").alias("names"))


@query("jn_18_best_tag_score", S.sql("""
    , b AS (SELECT news_id, max(pct) AS m FROM (SELECT news_id, unnest(company_tag_ids) AS company_id FROM news0) x
        JOIN percentile p ON x.company_id = p.company_id GROUP BY 1)
    SELECT news0.news_id, round(coalesce(m, 0.0), 6) AS market FROM news0 LEFT JOIN b ON b.news_id = news0.news_id""", "news0", "percentile"))
def _(spark, sf):
    n = V.news(spark, sf).select("news_id", "company_tag_ids")
    pct = RK.market_percentiles(V.companies(spark, sf))
    return G.best_tag_score(n, "news_id", "company_tag_ids", pct).select("news_id", F.round("market", 6).alias("market"))


_QUOTES = """
    , q AS (SELECT 't' || c_custkey AS symbol, CAST(c_custkey * 1000 AS BIGINT) AS market_cap, 'batch' AS source FROM customer WHERE c_mktsegment <> 'BUILDING')
    """


def _quotes(spark, sf):
    return V.table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(
        F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("symbol"),
        (F.col("c_custkey") * 1000).alias("market_cap"), F.lit("batch").alias("source"))


@query("jn_19_market_cap_refresh", S.sql(_QUOTES + """
    SELECT c.company_id, coalesce(q.market_cap, c.market_cap) AS market_cap, q.source AS market_cap_source, q.market_cap IS NOT NULL AS refreshed
    FROM companies c LEFT JOIN q ON upper(q.symbol) = upper(c.ticker)""", "companies"))
def _(spark, sf):
    return sync.market_cap_refresh(V.companies(spark, sf), _quotes(spark, sf)).select(
        "company_id", "market_cap", "market_cap_source", "refreshed")


@query("jn_19_refresh_counts", S.sql(_QUOTES + """
    SELECT count(*) AS companies, count(q.symbol) AS refreshed, count(*) - count(q.symbol) AS failed FROM companies c
    LEFT JOIN q ON upper(q.symbol) = upper(c.ticker) WHERE c.exchange <> 'NATION_3'""", "companies"))
def _(spark, sf):
    c = V.companies(spark, sf).withColumn("ticker", F.when(F.col("exchange") != "NATION_3", F.col("ticker")))
    return sync.refresh_counts(sync.market_cap_refresh(c, _quotes(spark, sf)))


@query("jn_20_quote_fallback", S.sql(_QUOTES + """
    , s AS (SELECT 'T' || c_custkey AS symbol, CAST(c_custkey AS BIGINT) AS market_cap FROM customer WHERE c_nationkey <> 2)
    SELECT upper(c.ticker) AS symbol, coalesce(q.market_cap, s.market_cap) AS market_cap, CASE WHEN q.symbol IS NOT NULL THEN 'batch' ELSE 'single' END AS source
    FROM companies c LEFT JOIN q ON upper(q.symbol) = c.ticker LEFT JOIN s ON s.symbol = c.ticker
    WHERE q.symbol IS NOT NULL OR s.symbol IS NOT NULL""", "companies"))
def _(spark, sf):
    single = V.table(spark, sf, "customer").filter("c_nationkey <> 2").select(
        F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("symbol"), F.col("c_custkey").alias("market_cap"))
    return sync.quote_fallback(V.companies(spark, sf), _quotes(spark, sf), single)


@query("jn_21_ranked_refetch", S.sql("""
    SELECT filing_id, title, CAST(row_number() OVER (ORDER BY composite_score DESC, filed_at DESC, filing_id DESC) - 1 AS INT) AS rank FROM filings0
    QUALIFY rank < 100""", "filings0"))
def _(spark, sf):
    f = V.filings(spark, sf)
    ids = RK.ranked_ids(f.select("filing_id", "composite_score", "filed_at"), "filing_id",
                        RK.importance_order("filed_at", "filing_id"), 100)
    return RK.refetch(f.select("filing_id", "title"), ids, "filing_id").select("filing_id", "title", "rank")


@query("jn_22_filing_detail", S.sql(_LINKS + f"""
    , g AS (SELECT filing_id, company_id, filed_at, normalized_form_type, {_GRP} AS grp FROM filings),
      c AS (SELECT company_id, grp, filed_at, max(filing_id) AS best FROM g WHERE normalized_form_type <> 'S-1' GROUP BY ALL),
      p AS (SELECT g.filing_id, c.best AS prior_id FROM g ASOF LEFT JOIN c ON g.company_id = c.company_id AND g.grp = c.grp AND g.filed_at > c.filed_at),
      r AS (SELECT x.filing_id, string_agg(n.title, '|' ORDER BY rn) AS related FROM (SELECT *, row_number() OVER (PARTITION BY filing_id
        ORDER BY confidence DESC, news_id DESC) AS rn FROM links) x JOIN news0 n ON x.news_id = n.news_id WHERE rn <= 5 GROUP BY 1)
    SELECT f.filing_id, co.name, p.prior_id, coalesce(r.related, '') AS related FROM filings f JOIN companies co ON co.company_id = f.company_id
      LEFT JOIN p ON p.filing_id = f.filing_id LEFT JOIN r ON r.filing_id = f.filing_id""", "filings", "companies", "news0"))
def _(spark, sf):
    d = L.filing_detail(V.filings(spark, sf), V.companies(spark, sf), _links(spark, sf), V.news(spark, sf))
    return d.select("filing_id", "name", "prior_id", F.array_join("related", "|").alias("related"))


def _calendar_versions(spark, sf):
    new = V.calendar(spark, sf).select("event_id", "title", "summary_text", "composite_score", "starts_at")
    old = new.filter("title <> 'Public workshop on labeling'").withColumns({
        "composite_score": F.col("composite_score") + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0),
        "summary_text": F.coalesce("summary_text", F.when(F.col("event_id") % 8 == 0, "Kept notes"))})
    return new.filter(F.col("starts_at") >= F.lit("1996-01-01").cast("timestamp")), old


@query("jn_23_upsert_actions", S.sql("""
    , n AS (SELECT * FROM calendar WHERE starts_at >= TIMESTAMP '1996-01-01'),
      o AS (SELECT event_id, title, coalesce(summary_text, CASE WHEN event_id % 8 = 0 THEN 'Kept notes' END) AS summary_text,
        composite_score + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS composite_score FROM calendar WHERE title <> 'Public workshop on labeling')
    SELECT coalesce(n.event_id, o.event_id) AS event_id, coalesce(n.title, o.title) AS title, coalesce(n.summary_text, o.summary_text) AS summary_text,
      coalesce(n.composite_score, o.composite_score) AS composite_score,
      CASE WHEN n.event_id IS NULL THEN 'keep' WHEN o.event_id IS NULL THEN 'insert' WHEN n.composite_score <> o.composite_score THEN 'update'
        ELSE 'unchanged' END AS action
    FROM n FULL OUTER JOIN o ON n.event_id = o.event_id""", "calendar"))
def _(spark, sf):
    new, old = _calendar_versions(spark, sf)
    return sync.upsert_actions(new, old, ["event_id"], ["title", "summary_text", "composite_score"], ("summary_text",))


_TRIAL_SYNC = """
    , ok AS (SELECT c_custkey AS company_id FROM customer WHERE c_nationkey <> 3),
      inc AS (SELECT company_id, nct_id, title, status FROM trials WHERE status <> 'Withdrawn'),
      old AS (SELECT company_id, nct_id, title, CASE WHEN trial_id % 6 = 0 THEN 'Suspended' ELSE status END AS status FROM trials WHERE phase IS NOT NULL),
      n AS (SELECT * FROM inc WHERE company_id IN (SELECT company_id FROM ok)),
      act AS (SELECT coalesce(n.company_id, o.company_id) AS company_id, coalesce(n.nct_id, o.nct_id) AS nct_id, coalesce(n.status, o.status) AS status,
        CASE WHEN coalesce(n.company_id, o.company_id) NOT IN (SELECT company_id FROM ok) THEN 'keep' WHEN n.nct_id IS NULL THEN 'delete'
          WHEN o.nct_id IS NULL THEN 'insert' WHEN n.status <> o.status THEN 'update' ELSE 'unchanged' END AS action
        FROM n FULL OUTER JOIN old o ON n.company_id = o.company_id AND n.nct_id = o.nct_id)
    """


def _trial_sync(spark, sf):
    t = V.trials(spark, sf)
    meta = F.create_map(F.lit("source"), F.lit("mirror"))
    inc = t.filter("status <> 'Withdrawn'").select("company_id", "nct_id", "title", "status", meta.alias("meta"))
    old = t.filter("phase is not null").select(
        "company_id", "nct_id", "title", F.when(F.col("trial_id") % 6 == 0, "Suspended").otherwise(F.col("status")).alias("status"),
        meta.alias("meta"))
    ok = V.table(spark, sf, "customer").filter("c_nationkey <> 3").select(F.col("c_custkey").alias("company_id"))
    return sync.snapshot_actions(inc, old, "company_id", "nct_id", ["title", "status"], ok, "meta")


@query("jn_24_snapshot_sync", S.sql(_TRIAL_SYNC + " SELECT company_id, nct_id, status, action FROM act", "trials"))
def _(spark, sf):
    return _trial_sync(spark, sf).select("company_id", "nct_id", "status", "action")


@query("agg_10_sync_counters", S.sql(_TRIAL_SYNC + """
    SELECT company_id, count(*) AS scanned, count(*) FILTER (action = 'insert') AS insert_n, count(*) FILTER (action = 'update') AS update_n,
      count(*) FILTER (action = 'delete') AS delete_n, count(*) FILTER (action = 'unchanged') AS unchanged_n FROM act GROUP BY 1""", "trials"))
def _(spark, sf):
    return sync.action_counts(_trial_sync(spark, sf), "company_id")


@query("set_7_new_keys", S.sql("SELECT accession_number FROM filings0 WHERE status <> 'complete'", "filings0"))
def _(spark, sf):
    incoming, stored = _stored_split(spark, sf)
    return sync.new_by_key(incoming.select("accession_number"), stored, "accession_number")
