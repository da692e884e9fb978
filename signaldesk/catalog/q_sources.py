"""Sources and sinks."""

from pyspark.sql import functions as F, types as Y

from signaldesk import constants as K
from signaldesk.catalog import query, sqltext as S
from signaldesk.catalog.q_functions import _BASIC, sql_strip
from signaldesk.operators import sync
from signaldesk.runtime import scratch_dir
from signaldesk.sources import feeds, pages as P, payloads as J, sinks, views as V

AF = V.AS_OF_FILINGS


def _columnar(spark, sf):
    """One columnar block per order row: parallel arrays of two entries, and none for half of the priorities."""
    o = V.table(spark, sf, "orders")
    empty = F.col("o_orderpriority") == "5-LOW"
    pair = lambda a, b: F.when(empty, F.slice(F.array(a, b), 1, 0)).otherwise(F.array(a, b))
    return o.select("o_orderkey", pair("o_orderkey", "o_custkey").alias("number"), pair("o_orderstatus", "o_orderpriority").alias("label"))


@query("src_1_columnar_rows", """
    SELECT o_orderkey, o_orderkey AS number, o_orderstatus AS label FROM orders WHERE o_orderpriority <> '5-LOW'
    UNION ALL SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'""")
def _(spark, sf):
    return J.rows_from_columns(_columnar(spark, sf), "o_orderkey", ["number", "label"])


@query("src_2_header_matrix", """
    SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority FROM orders
    UNION ALL SELECT c_custkey, c_mktsegment, c_name FROM customer""")
def _(spark, sf):
    o = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.array(F.lit("status"), F.lit("priority")).alias("fields"),
        F.array(F.array("o_orderstatus", "o_orderpriority")).alias("data"))
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.to_json(F.create_map(
        F.lit("0"), F.struct(F.col("c_mktsegment").alias("status"), F.col("c_name").alias("priority")))).alias("j"))
    return J.rows_from_matrix(o, "id", "fields", "data", ["status", "priority"]).unionByName(
        J.rows_from_keyed(c, "id", "j", "status:string,priority:string"))


@query("src_3_full_history", """
    SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders
    WHERE o_orderstatus <> 'F' OR o_orderpriority <> '5-LOW'""")
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    recent = o.filter("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey", "o_totalprice")
    older = o.filter("o_orderstatus = 'F'").select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("name"))
    return J.full_history(recent, older)


@query("src_4_quote_payloads", """
    SELECT 'T' || c_custkey AS symbol, CAST(trunc(c_acctbal * 1000) AS BIGINT) AS market_cap FROM customer WHERE c_nationkey % 5 <> 4
      AND NOT (c_nationkey % 5 = 3 AND c_mktsegment = 'BUILDING')""")
def _(spark, sf):
    k = F.col("c_nationkey") % 5
    cap = F.col("c_acctbal") * 1000
    sym = F.concat(F.lit("t"), F.col("c_custkey").cast("string"))
    js = lambda *c: F.to_json(F.struct(*c))
    payload = (
        F.when(k == 0, F.concat(F.lit("["), js(sym.alias("symbol"), cap.alias("marketCap")), F.lit("]")))
        .when(k == 1, F.concat(F.lit('{"data":['), js(sym.alias("ticker"), cap.cast("string").alias("market_cap")), F.lit("]}")))
        .when(k == 2, js(sym.alias("symbol"), cap.alias("marketCapitalization")))
        .when(k == 3, F.concat(F.lit("["), js(sym.alias("symbol"), F.when(F.col("c_mktsegment") == "BUILDING", F.lit("n/a"))
              .otherwise(cap.cast("string")).alias("market_capitalization")), F.lit("]")))
        .otherwise(js(sym.alias("symbol"), F.lit(0).alias("marketCap"))))
    return J.quote_rows(V.table(spark, sf, "customer").select(payload.alias("payload")), "payload")


@query("src_5_study_json", S.sql("""
    , n AS (SELECT nct_id, string_agg(name, '|' ORDER BY pos) AS inter FROM (SELECT 'NCT' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS nct_id,
        unnest(string_split(p_name, ' ')) AS name, generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part) GROUP BY 1)
    SELECT t.nct_id, CASE WHEN t.phase IS NULL THEN 'Untitled' ELSE title END AS title, phase,
      CASE WHEN status = 'Completed' THEN 'Unknown' ELSE status END AS status, n.inter AS interventions,
      CASE WHEN phase IS NULL THEN '' ELSE 'C1|C2' END AS conditions, 'Sponsor ' || company_id AS sponsor,
      CAST(start_date AS VARCHAR) AS start_date, strftime(primary_completion_date, '%Y-%m') || '-01' AS primary_completion_date,
      CAST(last_update_date AS VARCHAR) AS last_update_date, enrollment FROM trials t JOIN n ON n.nct_id = t.nct_id""", "trials"))
def _(spark, sf):
    t = V.trials(spark, sf)
    names = V.table(spark, sf, "part").select(
        F.concat(F.lit("NCT"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("nct_id"),
        F.transform(F.concat(F.split("p_name", " "), F.array(F.lit(""))), lambda n: F.struct(n.alias("name"))).alias("inter"))
    d = lambda c, fmt: F.struct(F.date_format(c, fmt).alias("date"))
    doc = F.to_json(F.struct(F.struct(
        F.struct("nct_id", F.when(F.col("phase").isNotNull(), F.col("title")).alias("briefTitle"))
        .cast("struct<nctId:string,briefTitle:string>").alias("identificationModule"),
        F.struct(F.when(F.col("status") != "Completed", F.col("status")).alias("overallStatus"),
                 d("start_date", "yyyy-MM-dd").alias("startDateStruct"),
                 d("primary_completion_date", "MMMM yyyy").alias("primaryCompletionDateStruct"),
                 d("last_update_date", "MMMM d, yyyy").alias("lastUpdatePostDateStruct")).alias("statusModule"),
        F.struct(F.when(F.col("phase").isNotNull(), F.array("phase")).alias("phases"), F.lit("Interventional").alias("studyType"),
                 F.struct(F.col("enrollment").alias("count")).alias("enrollmentInfo")).alias("designModule"),
        F.struct(F.struct(F.concat(F.lit("Sponsor "), F.col("company_id").cast("string")).alias("name"))
                 .alias("leadSponsor")).alias("sponsorCollaboratorsModule"),
        F.struct(F.when(F.col("phase").isNotNull(), F.array(F.lit("C1"), F.lit("C2"))).alias("conditions"))
        .alias("conditionsModule"),
        F.struct(F.col("inter").alias("interventions")).alias("armsInterventionsModule")).alias("protocolSection")))
    rows = J.study_rows_from_json(t.join(names, "nct_id").select("trial_id", doc.alias("doc")), "trial_id", "doc")
    return rows.select(
        "nct_id", "title", "phase", "status", F.array_join("interventions", "|").alias("interventions"),
        F.array_join("conditions", "|").alias("conditions"), "sponsor",
        *[F.col(c).cast("string").alias(c) for c in ("start_date", "primary_completion_date", "last_update_date")],
        "enrollment")


@query("src_6_calendar_rows", """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders
      WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW')
    SELECT o_orderkey, 'Meeting of the ' || substr(o_orderpriority, 3) || ' Advisory Committee Meeting Announcement' AS title,
      'https://calendar.example.org/events/' || o_custkey AS canonical_url, strftime(o_orderdate + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS starts_at,
      CASE WHEN upper(substr(o_orderpriority, 3)) = substr(o_orderpriority, 3) THEN substr(o_orderpriority, 3) || ' Advisory Committee' END AS committee_name,
      'Meeting of the ' || substr(o_orderpriority, 3) || ' Advisory Committee Meeting Announcement Center & Co Office' AS context_text
    FROM r WHERE rn = 1""")
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    name = F.concat(F.lit("Meeting of the "), F.substring("o_orderpriority", 3, 100),
                    F.lit(" Advisory Committee Meeting Announcement"))
    cell = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("no link")).otherwise(F.concat(
        F.lit('<span><a class="x" href="events/'), F.col("o_custkey").cast("string"), F.lit('"> '), name, F.lit(" </a></span>")))
    start = F.when(F.col("o_orderstatus") == "P", "to be announced").otherwise(
        F.concat(F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit(" 09:00 AM")))
    raw = o.select("o_orderkey", cell.alias("title"), start.alias("field_start_date"), start.alias("field_end_date"),
                   F.lit("<p>Center &amp; Co</p>").alias("field_center"), F.lit("Office").alias("field_contributing_office"))
    rows = J.calendar_rows(raw, "https://calendar.example.org/", "o_orderkey")
    return rows.select("o_orderkey", "title", "canonical_url", F.date_format("starts_at", "yyyy-MM-dd HH:mm:ss").alias("starts_at"),
                       "committee_name", "context_text")


@query("src_7_page_links", f"""
    WITH c AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root,
        regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g') AS h FROM pages),
      a AS (SELECT page_id, root, unnest(regexp_extract_all(h, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)) AS href,
        unnest(regexp_extract_all(h, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2)) AS inner_html,
        generate_subscripts(regexp_extract_all(h, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1), 1) AS p FROM c),
      t AS (SELECT page_id, p, regexp_replace(root || href, '[?#].*$', '') AS link, {sql_strip(_BASIC.format('inner_html'))} AS title FROM a
        WHERE starts_with(href, '/')),
      f AS (SELECT *, row_number() OVER (PARTITION BY page_id, link ORDER BY p) AS first FROM t WHERE length(title) >= 4)
    SELECT page_id, CAST(pos AS INT) AS pos, title, link FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY p) AS pos FROM f WHERE first = 1)""")
def _(spark, sf):
    return P.link_entries(V.pages(spark, sf), "page_id", "url", "html", min_title=4).select("page_id", "pos", "title", "link")


_IR = """
    , c AS (SELECT * FROM companies),
      src AS (SELECT company_id, name, sic, 0 AS pos, 'html_page' AS kind, 'https://ir.example.com/' || company_id || '/news' AS url FROM c WHERE sic = '2834'
        UNION ALL SELECT company_id, name, sic, 0, 'rss', 'https://ir.example.com/' || company_id || '/rss' FROM c WHERE sic <> '2834' AND sic <> '7372'
        UNION ALL SELECT company_id, name, sic, 1, 'html_page', 'https://ir.example.com/shared/' || (company_id % 40) FROM c WHERE sic = '2836')
    """


def _ir_companies(spark, sf):
    url = lambda tail: F.concat(F.lit("https://ir.example.com/"), F.col("company_id").cast("string"), F.lit(tail))
    own = F.array(F.struct(F.lit("html_page").alias("kind"), url("/news").alias("url")),
                  F.struct(F.lit("rss").alias("kind"), F.lit("").alias("url")))
    return V.companies(spark, sf).withColumns({
        "ir_sources": F.when(F.col("sic") == "2834", own),
        "ir_feed_url": F.when(F.col("sic") != "7372", url("/rss")),
        "ir_news_page_url": F.when(F.col("sic") == "2836", F.concat(
            F.lit("https://ir.example.com/shared/"), (F.col("company_id") % 40).cast("string"))),
    })


@query("src_8_feed_registry", S.sql(_IR + f"""
    , top AS (SELECT company_id FROM c WHERE is_active ORDER BY coalesce(market_cap, 0) DESC, company_id LIMIT 50),
      pri AS (SELECT company_id FROM top UNION SELECT c.company_id FROM c JOIN watchlist_members m ON c.company_id = m.company_id WHERE is_active),
      u AS (SELECT CAST(NULL AS BIGINT) AS seed_company_id, i AS o, 0 AS sub, name, feed_url, w AS source_weight, tags FROM (VALUES
          {", ".join(f"({i}, {S.q(n)}, {S.q(u)}, {w}::DOUBLE, {S.q(','.join(t))})" for i, (n, u, w, t) in enumerate(K.STATIC_FEEDS))})
          AS s(i, name, feed_url, w, tags)
        UNION ALL SELECT company_id, 8 + company_id, pos, name || ' Investor Relations', url, 0.98,
          CASE sic WHEN '2834' THEN 'company-pr,pharma' WHEN '2836' THEN 'company-pr,biotech' ELSE 'company-pr' END
          FROM src WHERE company_id IN (SELECT company_id FROM pri))
    SELECT seed_company_id, name, feed_url, source_weight, tags FROM
      (SELECT *, row_number() OVER (PARTITION BY feed_url ORDER BY o, sub) AS rn FROM u) WHERE rn = 1""", "companies", "watchlist_members"))
def _(spark, sf):
    c = _ir_companies(spark, sf)
    src = feeds.company_sources(c, feeds.builtin_sources(spark))
    return feeds.registry(spark, c, src, V.watchlist_members(spark, sf)).select(
        "seed_company_id", "name", "feed_url", "source_weight", F.array_join("topic_tags", ",").alias("tags"))


@query("src_9_source_precedence", S.sql(_IR + " SELECT company_id, pos, kind, url FROM src", "companies"))
def _(spark, sf):
    return feeds.company_sources(_ir_companies(spark, sf), feeds.builtin_sources(spark)).select(
        "company_id", "pos", "kind", "url")


@query("src_10_narrow_scan", """
    SELECT doc_id, lang, source, n_chars FROM documents""")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")


@query("src_11_trial_tables", S.sql("""
    SELECT 'study' AS part, nct_id, brief_title AS value, overall_status AS note FROM studies
    UNION ALL SELECT 'sponsor', nct_id, name, lead_or_collaborator FROM sponsors
    UNION ALL SELECT 'condition', nct_id, name, NULL FROM conditions UNION ALL SELECT 'intervention', nct_id, name, NULL FROM interventions""",
                                    "studies", "sponsors", "conditions", "interventions"))
def _(spark, sf):
    def part(rows, name: str, value: str, note):
        return rows.select(F.lit(name).alias("part"), "nct_id", F.col(value).alias("value"), note.cast("string").alias("note"))

    none = F.lit(None)
    return part(V.studies(spark, sf), "study", "brief_title", F.col("overall_status")).unionByName(
        part(V.sponsors(spark, sf), "sponsor", "name", F.col("lead_or_collaborator"))).unionByName(
        part(V.conditions(spark, sf), "condition", "name", none)).unionByName(part(V.interventions(spark, sf), "intervention", "name", none))


@query("snk_1_idempotent_append", """
    SELECT o_orderkey, o_totalprice FROM orders""")
def _(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = scratch_dir(spark, "append")
    empty = o.limit(0)
    first = sinks.append_new(o.filter("o_orderstatus = 'F'"), empty, path, "o_orderkey")
    # The second delivery repeats the first and adds the rest; only the rest is written.
    return sinks.append_new(o, first, path, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("snk_2_text_artifacts", S.sql("""
    SELECT lpad(CAST(t.company_id AS VARCHAR), 10, '0') || '/' || f.accession_number AS artifact_key, length(t.raw_text) AS n_chars
    FROM filing_text t JOIN filings0 f ON f.filing_id = t.filing_id""", "filing_text", "filings0"))
def _(spark, sf):
    t = V.filing_text(spark, sf, "company_id", "accession_number").select(
        F.lpad(F.col("company_id").cast("string"), 10, "0").alias("cik"), "accession_number", "raw_text")
    path = scratch_dir(spark, "artifacts")
    sinks.write_texts(t, path)
    return spark.read.parquet(path).select("artifact_key", F.length("raw_text").cast("bigint").alias("n_chars"))


@query("snk_3_schema_alignment", """
    SELECT CAST(c_custkey AS VARCHAR) AS cik, c_name AS name, CAST(c_custkey AS BIGINT) AS market_cap, true AS is_active,
      CAST(NULL AS VARCHAR) AS universe_reason FROM customer""")
def _(spark, sf):
    c = V.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("cik"), F.col("c_name").alias("name"), F.col("c_custkey").cast("int").alias("market_cap"))
    target = Y.StructType([
        Y.StructField("cik", Y.StringType()), Y.StructField("name", Y.StringType()), Y.StructField("market_cap", Y.LongType()),
        Y.StructField("is_active", Y.BooleanType()), Y.StructField("universe_reason", Y.StringType())])
    return sinks.align(c, target, {"is_active": True})
