"""Scalar functions applied to whole tables: strings, dates, scores, JSON."""

from pyspark.sql import functions as F

from signaldesk import constants as K
from signaldesk.catalog import query, sqltext as S
from signaldesk.functions import classify as C, dates as D, scores as M, summaries as R, text as T
from signaldesk.operators import sync, texts as X
from signaldesk.operators.filters import flag_members
from signaldesk.operators.ranking import market_percentiles
from signaldesk.operators.tagging import best_tag_score, flag_watched
from signaldesk.sources import views as V

AF, AN = V.AS_OF_FILINGS, V.AS_OF_NEWS


def tsfmt(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# ---- strings ------------------------------------------------------------------
@query("str_1_normalize_form", S.sql(
    f"SELECT filing_id, {S.norm_form(chr(39) + '  ' + chr(39) + ' || lower(form_type) || ' + chr(39) + ' ' + chr(39))} AS form FROM filings0",
    "filings0"))
def _(spark, sf):
    return V.filings(spark, sf).select(
        "filing_id", T.normalize_form(F.concat(F.lit("  "), F.lower("form_type"), F.lit(" "))).alias("form"))


@query("str_2_comparable_group", S.sql("""
    SELECT filing_id, CASE WHEN normalized_form_type IN ('10-K', '20-F', '40-F') THEN 'annual' ELSE 'interim' END AS grp
    FROM filings1""", "filings1"))
def _(spark, sf):
    return V.filings(spark, sf).select("filing_id", T.comparable_group("form_type").alias("grp"))


@query("str_3_pad_key", """
    SELECT c_custkey, lpad(CAST(CASE WHEN c_nationkey = 3 THEN 0 ELSE c_custkey END AS VARCHAR), 10, '0') AS cik FROM customer""")
def _(spark, sf):
    c = V.table(spark, sf, "customer")
    return c.select("c_custkey", T.pad_key(F.when(F.col("c_nationkey") != 3, F.col("c_custkey"))).alias("cik"))


@query("str_4_reason_label", f"""
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN {S.q(K.REASON_LABELS['sic-allowlist'])}
      WHEN '2-HIGH' THEN {S.q(K.REASON_LABELS['manual-allowlist'])} WHEN '3-MEDIUM' THEN '3 Medium' WHEN '5-LOW' THEN '5 Low'
      ELSE '4 Not Specified' END AS label FROM orders""")
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    code = F.when(F.col("o_orderpriority") == "1-URGENT", "sic-allowlist").when(
        F.col("o_orderpriority") == "2-HIGH", "manual-allowlist").otherwise(
        F.replace(F.lower("o_orderpriority"), F.lit(" "), F.lit("-")))
    return o.select("o_orderkey", T.reason_label(code).alias("label"))


@query("str_5_canonical_url", "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS canonical_url FROM pages")
def _(spark, sf):
    return V.pages(spark, sf).select("page_id", T.canonical_url("url").alias("canonical_url"))


_BASIC = ("replace(replace(replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), "
          "'&quot;', '\"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')")


def sql_strip(x):
    return (f"trim(regexp_replace(regexp_replace(regexp_replace({x}, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g'), "
            f"'(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))")


@query("str_6_inline_text", f"""
    WITH t AS (SELECT page_id, coalesce({_BASIC.format('html')}, '') || ' R&D — é’ &unknown; ' || chr(119808 + CAST(page_id % 26 AS INT)) AS raw FROM pages)
    SELECT page_id, CASE WHEN contains(raw, '<') OR contains(raw, '>') THEN {sql_strip('raw')}
      ELSE trim(regexp_replace(raw, '\\s+', ' ', 'g')) END AS text FROM t""")
def _(spark, sf):
    # Entities of all kinds behind each page's markup.
    html = F.concat(F.coalesce("html", F.lit("")), F.lit(" R&#38;D &#x2014; &eacute;&#8217; &unknown; &#"), (F.col("page_id") % 26 + 119808).cast("string"), F.lit(";"))
    return V.pages(spark, sf).select("page_id", T.inline_text(html).alias("text"))


@query("str_7_entity_text", f"SELECT doc_id, {S.entity('text')} AS norm FROM documents")
def _(spark, sf):
    return V.documents(spark, sf).select("doc_id", T.entity_text("text").alias("norm"))


@query("str_8_sponsor_text", f"""
    SELECT doc_id, trim(regexp_replace(replace(regexp_replace(lower(strip_accents(text)), '[^\\x00-\\x7F]', '', 'g'), '&', ' and '),
      '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents""")
def _(spark, sf):
    return V.documents(spark, sf).select("doc_id", T.sponsor_text("text").alias("norm"))


@query("str_8_sponsor_text_full", f"""
    SELECT doc_id, trim(regexp_replace(replace(regexp_replace(lower(strip_accents('Nguyen Hoa Dat ab 7 fi ffl ij ' || text)), '[^\\x00-\\x7F]', '', 'g'), '&', ' and '),
      '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents""")
def _(spark, sf):
    # Vietnamese, full-width, ligature and double letters before each text.
    return V.documents(spark, sf).select("doc_id", T.sponsor_text_full(F.concat(F.lit("Nguyễn Hoà Ðat ａｂ ７ ﬁ ﬄ ĳ ".replace("Ð", "D")), "text")).alias("norm"))


_SUF = "|".join(K.LEGAL_SUFFIXES)


@query("str_9_core_compact", S.sql(f"""
    , n AS (SELECT id, nct_id, {S.entity("name || ' Holdings, Inc.'")} AS norm FROM sponsors)
    SELECT id, nct_id, replace(norm, ' ', '') AS compact, replace(regexp_replace(norm, '( ({_SUF}))+$', ''), ' ', '') AS core FROM n""",
                                   "sponsors"))
def _(spark, sf):
    s = V.sponsors(spark, sf).withColumn("name", F.concat("name", F.lit(" Holdings, Inc.")))
    return s.select("id", "nct_id", T.compact_name("name").alias("compact"), T.core_compact_name("name").alias("core"))


@query("str_10_content_hash", S.sql(
    "SELECT news_id, sha256(canonical_url || '|' || title) AS article_hash FROM news0", "news0"))
def _(spark, sf):
    return V.news(spark, sf).select("news_id", T.content_hash("canonical_url", "title").alias("article_hash"))


@query("str_11_source_type", """
    SELECT event_id, CASE WHEN event_type = 'view' OR contains(url, 'fda.gov') THEN 'regulator' ELSE 'trade_press' END AS source_type
    FROM (SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN 'https://www.fda.gov/x/' ELSE 'https://a.example/' END || event_id AS url
          FROM events)""")
def _(spark, sf):
    e = V.table(spark, sf, "events")
    name = F.when(F.col("event_type") == "view", "FDA Press Releases").otherwise(F.col("event_type"))
    url = F.concat(F.when(F.col("event_id") % 7 == 0, "https://www.fda.gov/x/").otherwise("https://a.example/"),
                   F.col("event_id").cast("string"))
    return e.select("event_id", C.news_source_type(name, url).alias("source_type"))


@query("str_12_news_event_type", S.sql("SELECT news_id, event_type FROM news", "news"))
def _(spark, sf):
    return V.news(spark, sf).select("news_id", "event_type")


@query("str_13_news_topics", S.sql("""
    SELECT news_id, array_to_string(list_sort(list_distinct(list_concat(['biotech', 'regulatory'], topic_tags))), ',') AS topics FROM news1""",
                                   "news1"))
def _(spark, sf):
    feed = F.array(F.lit("biotech"), F.lit("regulatory"))
    return V.news(spark, sf).select(
        "news_id", F.array_join(C.merged_topics(feed, C.news_topics("title", "excerpt")), ",").alias("topics"))


@query("str_14_filing_event_type", S.sql(f"""
    SELECT t.filing_id, {S.filing_event('f.normalized_form_type', 'f.item_numbers', 'f.title', 't.raw_text')} AS event_type
    FROM filing_text t JOIN filings1 f ON t.filing_id = f.filing_id""", "filing_text", "filings1"))
def _(spark, sf):
    return V.filing_text(spark, sf, "normalized_form_type", "item_numbers", "title").select("filing_id", C.filing_event_type(
        "normalized_form_type", "item_numbers", "title", "raw_text").alias("event_type"))


@query("str_15_item_numbers", S.sql(
    f"SELECT filing_id, array_to_string({S.items_of('items')}, ',') AS item_list FROM filings0", "filings0"))
def _(spark, sf):
    return V.filings(spark, sf).select("filing_id", F.array_join(T.item_numbers("items"), ",").alias("item_list"))


@query("str_16_news_group", S.sql("SELECT news_id, dedupe_group_id FROM news", "news"))
def _(spark, sf):
    return V.news(spark, sf).select("news_id", "dedupe_group_id")


@query("str_17_filing_group", S.sql("""
    SELECT filing_id, CASE WHEN status <> 'failed' THEN 'filing:' || accession_number ELSE company_id || ':' ||
      coalesce(event_type, 'filing') || ':' || strftime(filed_at, '%Y-%m-%d') || ':unknown' END AS dedupe_group_id FROM filings""",
                                    "filings"))
def _(spark, sf):
    f = V.filings(spark, sf)
    acc = F.when(F.col("status") != "failed", F.col("accession_number"))
    return f.select("filing_id", C.filing_dedupe_id("company_id", acc, "event_type", "filed_at").alias("dedupe_group_id"))


@query("str_18_filing_urls", S.sql("""
    , b AS (SELECT filing_id, accession_number, CASE WHEN filing_id % 3 > 0 THEN 'doc' || filing_id || '.htm' END AS doc,
      'https://www.sec.gov/Archives/edgar/data/' || company_id || '/' || replace(accession_number, '-', '') AS base FROM filings0)
    SELECT filing_id, base || '/' || accession_number || '-index.htm' AS filing_url,
      coalesce(base || '/' || doc, base || '/' || accession_number || '-index.htm') AS original_document_url,
      base || '/' || accession_number || '.txt' AS submission_text_url FROM b""", "filings0"))
def _(spark, sf):
    f = V.filings(spark, sf)
    doc = F.when(F.col("filing_id") % 3 > 0, F.concat(F.lit("doc"), F.col("filing_id").cast("string"), F.lit(".htm")))
    urls = T.filing_urls(F.lpad(F.col("company_id").cast("string"), 10, "0"), "accession_number", doc)
    return f.select("filing_id", *[c.alias(n) for n, c in urls.items()])


@query("str_19_committee", S.sql("SELECT event_id, committee_name FROM calendar1", "calendar1"))
def _(spark, sf):
    return V.calendar(spark, sf).select("event_id", "committee_name")


_MDY = ("(?i)\\b((?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|"
        "Nov(?:ember)?|Dec(?:ember)?)\\s+\\d{1,2},\\s+\\d{4})\\b")


@query("str_20_date_text", f"""
    SELECT o_orderkey, nullif(regexp_extract('Posted on ' || strftime(o_orderdate, '%B %d, %Y') || ' by ' || o_orderpriority, '{_MDY}', 1), '')
      AS found FROM orders""")
def _(spark, sf):
    text = F.concat(F.lit("Posted on "), F.date_format("o_orderdate", "MMMM dd, yyyy"), F.lit(" by "), "o_orderpriority")
    return V.table(spark, sf, "orders").select("o_orderkey", T.date_text(text).alias("found"))


@query("str_24_clean_text", r"""
    WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line FROM (
        SELECT doc_id, list_transform(string_split(translate(replace(text, chr(13), chr(10)), chr(160) || chr(8209) || chr(8211) || chr(8212), ' ---'),
          chr(10)), lambda x: regexp_replace(regexp_replace(replace(x, chr(8203), ''), '^\s+|\s+$', '', 'g'), '[ \t]+', ' ', 'g')) AS a FROM documents)),
      k AS (SELECT * FROM l WHERE line <> '' AND NOT (regexp_matches(line, '(?i)^(https?://\S+\s*)+$') OR regexp_matches(line, '^\d{1,4}$')
        OR lower(line) IN META OR (NS >= 1 AND len(TOK) = 1) OR (NS >= 2 AND (NS + MARK) >= len(TOK) * 0.6)
        OR regexp_matches(lower(line), '^(https?://fasb\.org/|https?://xbrl\.)'))),
      d AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM k)
    SELECT doc_id, coalesce(string_agg(CASE WHEN before IS DISTINCT FROM line THEN line END, chr(10) ORDER BY pos), '') AS clean
    FROM documents LEFT JOIN d USING (doc_id) GROUP BY doc_id
    """.replace("META", S.listed(K.METADATA_TOKENS))
       .replace("NS", r"len(list_filter(TOK, lambda t: regexp_matches(t, '(?i)^[a-z][\w.-]*:[\w.-]+$')))")
       .replace("MARK", r"len(list_filter(TOK, lambda t: regexp_matches(t, '^(\d{4}-\d{2}-\d{2}|\d{8,10})$')))")
       .replace("TOK", r"list_filter(regexp_split_to_array(line, '\s+'), lambda t: length(t) > 0)"))
def _(spark, sf):
    return V.documents(spark, sf).select("doc_id", T.clean_extracted("text").alias("clean"))


_SECT = ("business", "risk_factors", "md&a", "liquidity")


@query("str_26_summary_source", S.sql("""
    , s AS (SELECT filing_id, raw_text, [coalesce(CASE k WHEN 'risk_factors' THEN normalized_form_type WHEN 'business' THEN raw_text WHEN 'md&a' THEN CASE WHEN filing_id % 2 = 0 THEN raw_text || ' again' END
          WHEN 'legal_proceedings' THEN 'of ' || raw_text END, '') FOR k IN ORDERED] AS bodies, filing_id % 3 = 0 AS none FROM filing_text),
      b AS (SELECT *, list_filter(list_transform(list_zip(ORDERED, bodies), lambda x: CASE WHEN x[2] <> '' THEN '[' || x[1] || ']' || chr(10) || x[2] END), lambda x: x IS NOT NULL) AS blocks FROM s)
    SELECT filing_id, sha256(CASE WHEN none THEN raw_text ELSE array_to_string(blocks, chr(10) || chr(10)) END) AS full_hash,
      sha256(CASE WHEN none THEN raw_text ELSE array_to_string(blocks[1:3], chr(10) || chr(10)) END) AS short_hash FROM b""".replace("ORDERED", S.listed(K.SECTION_ORDER).replace("(", "[").replace(")", "]")), "filing_text"))
def _(spark, sf):
    t = V.filing_text(spark, sf)
    sections = F.when(F.col("filing_id") % 3 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(
        F.lit("md&a"), F.when(F.col("filing_id") % 2 == 0, F.concat("raw_text", F.lit(" again"))), F.lit("legal_proceedings"), F.concat(F.lit("of "), "raw_text"),
        F.lit("business"), F.col("raw_text"), F.lit("risk_factors"), F.col("normalized_form_type")))
    t = t.withColumn("sections", sections)
    return t.select("filing_id", F.sha2(R.summary_source("sections", "raw_text"), 256).alias("full_hash"),
                    F.sha2(R.summary_source("sections", "raw_text", "short_ai"), 256).alias("short_hash"))


@query("str_27_staleness", S.sql("""
    SELECT t.filing_id, CASE WHEN f.summary IS NULL THEN 'pending' WHEN t.filing_id % 4 = 1 OR t.filing_id % 7 = 0 THEN 'stale'
      ELSE f.status END AS status FROM filing_text t JOIN filings f ON f.filing_id = t.filing_id""", "filing_text"))
def _(spark, sf):
    t = V.filing_text(spark, sf, "summary", "status")
    old_hash = F.when(F.col("filing_id") % 4 == 1, F.lit("other")).otherwise(F.sha2("raw_text", 256))
    version = F.when(F.col("filing_id") % 7 == 0, "v1").otherwise("v2")
    return t.select("filing_id", R.summary_status("summary", old_hash, version, "raw_text", "v2", "status").alias("status"))


def _flags(label, words):
    return ("array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(low, {S.q(w)}) THEN {S.q(label + ': ' + w)} END" for w in words)
            + "], lambda x: x IS NOT NULL), '; ')")


@query("str_28_rule_summary", S.sql(f"""
    , s AS (SELECT filing_id, title, trim(regexp_replace(raw_text, '\\s+', ' ', 'g')) AS sq FROM
        (SELECT t.filing_id, f.title, t.raw_text FROM filing_text t JOIN filings f ON f.filing_id = t.filing_id)),
      p AS (SELECT *, lower(sq) AS low, list_filter(list_transform(string_split(regexp_replace(sq, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
        lambda x: trim(x)), lambda x: x <> '') AS sent FROM s)
    SELECT filing_id, coalesce(nullif(array_to_string(sent[1:2], ' '), ''), title) AS summary,
      CASE WHEN len(sent) > 0 THEN array_to_string(sent[1:3], ' | ') ELSE coalesce(title, '') END AS takeaways,
      {_flags(*K.SUMMARY_FLAG_WORDS['risk_flags'])} AS risk_flags, {_flags(*K.SUMMARY_FLAG_WORDS['opportunity_flags'])} AS opportunity_flags,
      {_flags(*K.SUMMARY_FLAG_WORDS['material_changes'])} AS material_changes,
      CAST(least(30.0 + 10.0 * ({" + ".join(f"CASE WHEN contains(low, {S.q(w)}) THEN 1 ELSE 0 END" for w in K.SUMMARY_IMPORTANCE_WORDS)}), 100.0)
        AS DOUBLE) AS importance_score FROM p""", "filing_text"))
def _(spark, sf):
    t = V.filing_text(spark, sf, "title")
    r = R.with_rule_summary(t, "title", "raw_text")
    joined = [F.array_join(n, "; ").alias(n) for n in ("risk_flags", "opportunity_flags", "material_changes")]
    return r.select("filing_id", "summary", F.array_join("key_takeaways", " | ").alias("takeaways"), *joined,
                    "importance_score")


@query("str_29_list_summary", S.sql(r"""
    , l AS (SELECT filing_id, list_filter(list_transform(string_split(raw_text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM filing_text),
      w AS (SELECT filing_id, lines, list_transform(lines, lambda x: list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '')) AS words FROM l),
      h AS (SELECT filing_id, lines, list_transform(list_zip(lines, words), lambda z: len(z[2]) <= 8 AND len(z[2]) > 0 AND NOT (ends_with(z[1], '.') AND len(z[2]) > 4)
          AND len(list_filter(z[2], lambda y: regexp_matches(y, '^\p{Lu}'))) >= greatest(1, len(z[2]) // 2)) AS heading FROM w),
      b AS (SELECT filing_id, coalesce(list_filter(list_zip(lines, heading), lambda z: NOT z[2])[1][1], lines[1]) AS snippet FROM h)
    SELECT f.filing_id, CASE WHEN title IS NOT NULL AND normalized_form_type = '8-K' THEN title
      WHEN title IS NOT NULL AND event_type IS NOT NULL AND normalized_form_type = '6-K' THEN
        upper(substr(replace(event_type, '-', ' '), 1, 1)) || substr(replace(event_type, '-', ' '), 2) || ': ' || title
      WHEN len(item_numbers) > 0 AND normalized_form_type = '8-K' THEN 'Current event filing covering item ' ||
        array_to_string(item_numbers[1:3], ', ') || '.'
      WHEN status = 'complete' THEN coalesce(b.snippet, title, '') ELSE coalesce(title, '') END AS line FROM filings f JOIN b ON b.filing_id = f.filing_id""".replace("\\\\", "\\"), "filings", "filing_text"))
def _(spark, sf):
    # Complete filings show the first line of prose of their text; no title, so that many rows reach it.
    f = V.filing_text(spark, sf, "normalized_form_type", "title", "event_type", "item_numbers", "status")
    f = f.withColumn("sections", F.when(F.col("status") == "complete", F.create_map(F.lit("business"), F.col("raw_text"))))
    return f.select("filing_id", R.list_summary("normalized_form_type", "title", "event_type", "item_numbers", "sections",
                                                F.lit(None).cast("string")).alias("line"))


@query("str_30_digest_line", """
    SELECT day, CASE WHEN f = 0 AND n = 0 THEN 'No qualifying filings or news were captured in this digest window.' ELSE concat_ws(' ',
        CASE WHEN f > 0 THEN f || ' notable filings were captured in this window.' END,
        CASE WHEN n > 0 THEN n || ' important news items were tracked, led by ' || top || '.' END) END AS narrative
    FROM (SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) FILTER (event_type = 'purchase' AND value > 200) AS f,
      count(*) FILTER (event_type = 'signup' AND value > 250) AS n,
      arg_max(event_type || ' ' || event_id, {'v': value, 'i': event_id}) FILTER (event_type = 'signup' AND value > 250) AS top
      FROM events GROUP BY 1)""")
def _(spark, sf):
    e = V.table(spark, sf, "events")
    is_news = (F.col("event_type") == "signup") & (F.col("value") > 250)
    label = F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"))
    g = e.groupBy(F.col("ts").cast("date").cast("string").alias("day")).agg(
        F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 200)).alias("f"),
        F.count_if(is_news).alias("n"),
        F.max_by(label, F.when(is_news, F.struct("value", "event_id"))).alias("top"))
    return g.select("day", R.digest_line("f", "n", "top").alias("narrative"))


@query("str_31_reasons", S.sql(f"""
    SELECT 'filing' AS kind, filing_id AS id, {S.filing_reason('event_type', 'normalized_form_type', 'composite_score', 'impact_score',
      S.recency('filed_at', S.AF))} AS reason FROM filings
    UNION ALL SELECT 'news', news_id, {S.news_reason('event_type', 'is_official', 'source_weight', 'company_tag_ids', 'composite_score',
      'composite_score / 2', S.recency('published_at', S.AN))} FROM news
    UNION ALL SELECT 'calendar', event_id, {S.reasons("'official FDA calendar'",
      f"CASE WHEN ({S.days_until('starts_at', S.AF)}) BETWEEN 0 AND 30 THEN 'upcoming committee date' WHEN ({S.days_until('starts_at', S.AF)}) < 0 THEN 'recent committee activity' END",
      "CASE WHEN len(company_tag_ids) > 0 THEN 'linked to tracked company' END",
      "CASE WHEN event_id % 100 >= 75 THEN 'large-cap sponsor relevance' END")} FROM calendar0""", "filings", "news", "calendar0"))
def _(spark, sf):
    f = V.filings(spark, sf).select(F.lit("filing").alias("kind"), F.col("filing_id").alias("id"), C.filing_reason(
        "event_type", "normalized_form_type", "composite_score", "impact_score", D.recency_score("filed_at", AF)).alias("reason"))
    n = V.news(spark, sf).select(F.lit("news").alias("kind"), F.col("news_id").alias("id"), C.news_reason(
        "event_type", "is_official", "source_weight", "company_tag_ids", "composite_score", F.col("composite_score") / 2,
        D.recency_score("published_at", AN)).alias("reason"))
    c = V.calendar(spark, sf).select(F.lit("calendar").alias("kind"), F.col("event_id").alias("id"), C.calendar_reason(
        "starts_at", "company_tag_ids", F.col("event_id") % 100, AF).alias("reason"))
    return f.unionByName(n).unionByName(c)


@query("str_32_score_explanation", S.sql(f"""
    SELECT f.filing_id, {S.cents(S.form_base('f.normalized_form_type', 55.0))} AS form_weight, {S.material('t.raw_text')} AS material_events,
      {S.cents(S.recency('f.filed_at', S.AF))} AS recency, {S.cents('coalesce(p.pct, 0.0)')} AS market_cap, CASE WHEN c.market_cap IS NOT NULL THEN 'high' ELSE 'degraded' END AS confidence,
      CAST(1 AS BIGINT) AS notes
    FROM filings f JOIN filing_text t ON t.filing_id = f.filing_id JOIN companies c ON f.company_id = c.company_id LEFT JOIN percentile p ON p.company_id = f.company_id""",
                                     "filings", "filing_text", "companies", "percentile"))
def _(spark, sf):
    from signaldesk.plans.filings import pending_explanation

    companies = V.companies(spark, sf)
    f = V.filings(spark, sf).join(companies.select("company_id", "market_cap"), "company_id").join(_text_features(spark, sf), "filing_id").join(
        market_percentiles(companies), "company_id", "left")
    e = pending_explanation("normalized_form_type", F.col("mat"), D.recency_score("filed_at", AF), F.coalesce("pct", F.lit(0.0)),
                            F.col("market_cap").isNotNull())
    return f.select("filing_id", e.alias("e")).select(
        "filing_id", *[F.element_at("e.components", k).alias(k) for k in ("form_weight", "material_events", "recency", "market_cap")],
        "e.confidence", F.size("e.rationale").cast("bigint").alias("notes"))


@query("str_33_catalyst_line", S.sql("""
    SELECT filing_id AS id, coalesce(title, '-') || ' (' || strftime(filed_at, '%b %-d, %Y') || ')' AS line FROM filings
    UNION ALL SELECT event_id, 'FDA catalyst: ' || title || ' (' || strftime(starts_at, '%b %-d, %Y') || ')' FROM calendar0
    UNION ALL SELECT news_id, title FROM news0
    UNION ALL SELECT trial_id, CASE WHEN trial_id % 2 = 0 THEN title || ' on ' || strftime(primary_completion_date, '%b %-d, %Y')
      ELSE 'Clinical trial signal: ' || title END FROM trials""", "filings", "calendar0", "news0", "trials"))
def _(spark, sf):
    none = F.array().cast("array<string>")
    f = V.filings(spark, sf).select(F.col("filing_id").alias("id"), R.catalyst_line(
        F.lit("filing"), F.coalesce("title", F.lit("-")), none, "filed_at").alias("line"))
    c = V.calendar(spark, sf).select(F.col("event_id").alias("id"), R.catalyst_line(
        F.lit("regulatory"), "title", none, "starts_at").alias("line"))
    n = V.news(spark, sf).select(F.col("news_id").alias("id"), R.catalyst_line(
        F.lit("news"), "title", none, "published_at").alias("line"))
    t = V.trials(spark, sf)
    t = t.select(F.col("trial_id").alias("id"), R.catalyst_line(
        F.lit("trial"), "title", F.when(F.col("trial_id") % 2 == 0, F.array(F.lit("upcoming"))).otherwise(none),
        "primary_completion_date").alias("line"))
    return f.unionByName(c).unionByName(n).unionByName(t)


# ---- dates ---------------------------------------------------------------------
@query("dt_1_lenient_dates", """
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
      WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m') || '-01' END AS parsed FROM orders""")
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    k = F.col("o_orderkey") % 5
    d = F.col("o_orderdate")
    raw = (F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy-MM"))
           .when(k == 2, F.date_format(d, "MMMM d, yyyy")).when(k == 3, F.date_format(d, "MMMM yyyy")).otherwise("soon"))
    return o.select("o_orderkey", D.parse_lenient_date(raw).cast("string").alias("parsed"))


@query("dt_2_acceptance", """
    SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed FROM events""")
def _(spark, sf):
    e = V.table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyyMMddHHmmss")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return e.select("event_id", tsfmt(D.parse_acceptance(raw)).alias("parsed"))


@query("dt_3_published", """
    SELECT event_id, CASE event_id % 4 WHEN 1 THEN strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S')
      ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM events""")
def _(spark, sf):
    e = V.table(spark, sf, "events")
    k = F.col("event_id") % 4
    rfc = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss")
    published = F.when(k == 0, F.concat(rfc, F.lit(" GMT"))).when(k == 1, F.concat(rfc, F.lit(" -0500"))).when(
        k == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return e.select("event_id", tsfmt(D.parse_published(published, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))).alias("parsed"))


@query("dt_4_digest_window", """
    WITH l AS (SELECT o_orderkey, (o_orderdate::TIMESTAMPTZ + INTERVAL 10 HOUR) AT TIME ZONE 'America/New_York' AS loc FROM
        (SELECT o_orderkey, o_orderdate AT TIME ZONE 'UTC' AS o_orderdate FROM orders))
    SELECT o_orderkey,
      strftime(((date_trunc('day', loc) - INTERVAL 1 DAY) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS day_start,
      strftime((date_trunc('day', loc)::TIMESTAMP AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS day_end,
      strftime(((date_trunc('week', loc) - INTERVAL 7 DAY) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS week_start,
      strftime((date_trunc('week', loc)::TIMESTAMP AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS week_end
    FROM l""")
def _(spark, sf):
    at = F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL '10' HOUR")
    d0, d1 = D.digest_window(at, "daily")
    w0, w1 = D.digest_window(at, "weekly")
    return V.table(spark, sf, "orders").select(
        "o_orderkey", tsfmt(d0).alias("day_start"), tsfmt(d1).alias("day_end"), tsfmt(w0).alias("week_start"),
        tsfmt(w1).alias("week_end"))


@query("dt_5_recency", S.sql(f"""
    SELECT news_id AS id, {S.rounded(S.recency('published_at', S.AN), 4)} AS score FROM news0
    UNION ALL SELECT filing_id, {S.rounded(S.recency('filed_at', S.AF), 4)} FROM filings0""", "news0", "filings0"))
def _(spark, sf):
    n = V.news(spark, sf).select(F.col("news_id").alias("id"), M.rounded(D.recency_score("published_at", AN), 4).alias("score"))
    f = V.filings(spark, sf).select(F.col("filing_id").alias("id"), M.rounded(D.recency_score("filed_at", AF), 4).alias("score"))
    return n.unionByName(f)


@query("dt_6_freshness", S.sql(f"""
    SELECT news_id AS id, {S.bucket('published_at', S.AN)} AS bucket FROM news0
    UNION ALL SELECT event_id, CASE WHEN starts_at >= {S.AF} THEN 'upcoming' ELSE {S.bucket('starts_at', S.AF)} END FROM calendar0""",
                               "news0", "calendar0"))
def _(spark, sf):
    n = V.news(spark, sf).select(F.col("news_id").alias("id"), D.freshness_bucket("published_at", AN).alias("bucket"))
    c = V.calendar(spark, sf).select(F.col("event_id").alias("id"), D.freshness_bucket("starts_at", AF, True).alias("bucket"))
    return n.unionByName(c)


@query("dt_7_timeline_date", S.sql("""
    SELECT trial_id, strftime(CAST(coalesce(last_update_date, primary_completion_date, start_date) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')
      AS occurred_at FROM trials""", "trials"))
def _(spark, sf):
    return V.trials(spark, sf).select("trial_id", tsfmt(D.timeline_instant(
        "last_update_date", "primary_completion_date", "start_date")).alias("occurred_at"))


@query("dt_8_display_date", "SELECT o_orderkey, strftime(o_orderdate, '%b %-d, %Y') AS shown FROM orders")
def _(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", D.display_date("o_orderdate").alias("shown"))


# ---- scores ----------------------------------------------------------------------
@query("mth_1_material", S.sql(f"SELECT filing_id, {S.material('raw_text')} AS material FROM filing_text", "filing_text"))
def _(spark, sf):
    return V.filing_text(spark, sf).select("filing_id", M.material_score("raw_text").alias("material"))


_NUMS = r"list_transform(regexp_extract_all(raw_text, '\$?\b\d+(?:\.\d+)?%?\b'), lambda s: CAST(replace(replace(s, '$', ''), '%', '') AS DOUBLE))"
_NUMTEXT = S.sql(f"""
    , x AS (SELECT f.filing_id, f.company_id, f.filed_at, coalesce(f.title, '') || ' total $' || (f.filing_id % 97) || ' up ' || (f.filing_id % 13) || '% ' || f.raw_text AS raw_text
        FROM (SELECT t.*, g.title FROM filing_text t JOIN filings0 g ON g.filing_id = t.filing_id) f),
      m AS (SELECT filing_id, company_id, filed_at, CASE WHEN len({_NUMS}) > 0 THEN list_sum({_NUMS}) / len({_NUMS}) END AS mean FROM x)
    """, "filing_text", "filings0")


def _numbers(spark, sf):
    t = V.filing_text(spark, sf, "company_id", "filed_at", "title")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" total $"), (F.col("filing_id") % 97).cast("string"), F.lit(" up "),
                    (F.col("filing_id") % 13).cast("string"), F.lit("% "), "raw_text")
    return t.select("filing_id", "company_id", "filed_at", M.number_list(text).alias("nums")).select(
        "filing_id", "company_id", "filed_at", M.mean_of("nums").alias("mean"))


@query("agg_15_number_mean", _NUMTEXT + " SELECT filing_id, CAST(CAST(mean AS FLOAT) AS DOUBLE) AS mean FROM m")
def _(spark, sf):
    return _numbers(spark, sf).select("filing_id", F.col("mean").cast("float").cast("double").alias("mean"))


@query("mth_2_quantitative_delta", _NUMTEXT + f"""
    , p AS (SELECT *, lag(mean) OVER (PARTITION BY company_id ORDER BY filed_at, filing_id) AS prior FROM m)
    SELECT filing_id, CASE WHEN mean IS NULL THEN 10.0::DOUBLE WHEN prior IS NULL THEN 55.0 WHEN prior = 0 THEN 60.0
      ELSE {S.cents('least(abs(mean - prior) / greatest(abs(prior), 1.0) * 100.0, 100.0)')} END AS delta FROM p""")
def _(spark, sf):
    from signaldesk.operators.linking import running_max_before

    m = _numbers(spark, sf).withColumn("at", F.struct("filed_at", "filing_id", "mean"))
    p = running_max_before(m, ["company_id"], ["filed_at", "filing_id"], "at", "prior", "filed_at")
    return p.select("filing_id", M.quantitative_delta("mean", "prior.mean").alias("delta"))


def _text_pairs(spark, sf):
    """Filings with the texts of their own and of the filing numbered before."""
    t = V.filing_heads(spark, sf).withColumn("head", F.col("title"))
    p = t.select((F.col("filing_id") + 1).alias("filing_id"), F.col("doc_id").alias("prior_doc_id"), F.col("head").alias("prior_head"))
    return t.join(p, "filing_id", "left")


@query("mth_3_novelty_words", S.sql(S.SHARED_WORDS.format(links="SELECT filing_id, filing_id - 1 AS prior_id FROM filing_text") + f"""
    SELECT t.filing_id, CASE WHEN p.filing_id IS NULL THEN 65.0::DOUBLE ELSE {S.cents('(1.0 - coalesce(s.n, 0)::DOUBLE / (a.n + b.n - coalesce(s.n, 0))) * 100.0')} END AS novelty
    FROM filing_text t LEFT JOIN filing_text p ON p.filing_id = t.filing_id - 1 LEFT JOIN word_counts a ON a.filing_id = t.filing_id
      LEFT JOIN word_counts b ON b.filing_id = p.filing_id LEFT JOIN shared s ON s.filing_id = t.filing_id""", "filing_text"))
def _(spark, sf):
    rows = _text_pairs(spark, sf).select("filing_id", *X.PAIR)
    return X.with_pairs(rows, X.pair_novelty(rows, V.documents(spark, sf)), "inner").select("filing_id", "novelty")


def _text_features(spark, sf):
    return V.filing_text(spark, sf).select("filing_id", M.material_score("raw_text").alias("mat"))


def _scored(fn):
    return [c.alias(n) for n, c in fn.items()]


@query("mth_4_filing_complete", S.sql(S.SHARED_WORDS.format(links="SELECT filing_id, filing_id - 1 AS prior_id FROM filing_text") + f"""
    , m AS (SELECT filing_id, {S.material('raw_text')} AS mat, CASE WHEN len({_NUMS}) > 0 THEN list_sum({_NUMS}) / len({_NUMS}) END AS mean FROM filing_text),
      x AS (SELECT f.filing_id, importance_score AS llm, m.mat, {S.recency('filed_at', S.AF)} AS rec, coalesce(p.pct, 0.0) AS cap,
          CASE WHEN q.filing_id IS NULL THEN 65.0::DOUBLE ELSE {S.cents('(1.0 - coalesce(s.n, 0)::DOUBLE / (a.n + b.n - coalesce(s.n, 0))) * 100.0')} END AS nov,
          CASE WHEN m.mean IS NULL THEN 10.0::DOUBLE WHEN q.mean IS NULL THEN 55.0 WHEN q.mean = 0 THEN 60.0
            ELSE {S.cents('least(abs(m.mean - q.mean) / greatest(abs(q.mean), 1.0) * 100.0, 100.0)')} END AS quant
        FROM filings f JOIN m ON m.filing_id = f.filing_id LEFT JOIN m q ON q.filing_id = f.filing_id - 1 LEFT JOIN word_counts a ON a.filing_id = f.filing_id
          LEFT JOIN word_counts b ON b.filing_id = q.filing_id LEFT JOIN shared s ON s.filing_id = f.filing_id LEFT JOIN percentile p ON f.company_id = p.company_id),
      y AS (SELECT *, {S.cents('0.25 * nov + 0.20 * quant + 0.15 * mat + 0.15 * llm + 0.25 * rec')} AS impact_score FROM x)
    SELECT filing_id, {S.cents('cap')} AS market_cap_score, {S.cents('llm')} AS importance_score, impact_score,
      {S.cents('0.20 * cap + 0.50 * impact_score + 0.30 * rec')} AS composite_score FROM y""", "filings", "filing_text", "percentile"))
def _(spark, sf):
    pct = market_percentiles(V.companies(spark, sf))
    rows = _text_pairs(spark, sf).select("filing_id", "company_id", "filed_at", "importance_score", *X.PAIR)
    f = X.with_pairs(rows, X.scored_pairs(rows, V.documents(spark, sf)), "inner").join(pct, "company_id", "left").withColumns({
        "rec": D.recency_score("filed_at", AF), "cap": F.coalesce("pct", F.lit(0.0)),
        "quant": M.quantitative_delta("mean", "prior_mean")})
    return f.select("filing_id", *_scored(M.filing_complete("novelty", "quant", "material", "importance_score", "rec", "cap")))


@query("mth_5_filing_pending", S.sql(f"""
    , x AS (SELECT f.filing_id, {S.form_base('f.normalized_form_type', 55.0)} AS base, {S.material('raw_text')} AS mat,
        {S.recency('f.filed_at', S.AF)} AS rec, coalesce(p.pct, 0.0) AS cap FROM filings f JOIN filing_text t ON t.filing_id = f.filing_id LEFT JOIN percentile p ON f.company_id = p.company_id),
      y AS (SELECT *, {S.cents('0.35 * base + 0.30 * mat + 0.35 * rec')} AS impact_score FROM x)
    SELECT filing_id, {S.cents('cap')} AS market_cap_score, {S.cents('0.60 * base + 0.40 * mat')} AS importance_score, impact_score,
      {S.cents('0.35 * cap + 0.40 * impact_score + 0.25 * rec')} AS composite_score FROM y""", "filings", "filing_text", "percentile"))
def _(spark, sf):
    pct = market_percentiles(V.companies(spark, sf))
    f = V.filings(spark, sf).join(pct, "company_id", "left").join(_text_features(spark, sf), "filing_id").withColumns({
        "rec": D.recency_score("filed_at", AF), "cap": F.coalesce("pct", F.lit(0.0))})
    return f.select("filing_id", *_scored(M.filing_pending("normalized_form_type", "mat", "rec", "cap")))


_NEWSCAP = """
    , tagcap AS (SELECT news_id, max(pct) AS cap FROM (SELECT news_id, unnest(company_tag_ids) AS company_id FROM news0) t
        JOIN percentile p ON t.company_id = p.company_id GROUP BY 1),
      x AS (SELECT n.*, coalesce(c.cap, 0.0) AS cap, {rec} AS rec FROM news n LEFT JOIN tagcap c ON n.news_id = c.news_id)
    """.format(rec=S.recency("published_at", S.AN))


def _news_cap(spark, sf):
    pct = market_percentiles(V.companies(spark, sf))
    return best_tag_score(V.news(spark, sf), "news_id", "company_tag_ids", pct, out="cap").withColumn(
        "rec", D.recency_score("published_at", AN))


@query("mth_6_news_complete", S.sql(_NEWSCAP + f"""
    SELECT news_id, {S.cents('importance')} AS importance_score, {S.cents('cap')} AS market_cap_score,
      {S.cents('CASE WHEN tagged THEN 0.35 * importance + 0.15 * (source_weight * 100.0) + 0.15 * cap + 0.35 * rec ELSE 0.50 * importance + 0.20 * (source_weight * 100.0) + 0.30 * rec END')}
        AS composite_score, CASE WHEN tagged THEN 'high' ELSE 'medium' END AS confidence
    FROM (SELECT *, composite_score / 5 AS importance, len(company_tag_ids) > 0 AS tagged FROM x)""", "news", "percentile"))
def _(spark, sf):
    n = _news_cap(spark, sf)
    return n.select("news_id", *_scored(M.news_complete(
        F.col("composite_score") / 5, "source_weight", "cap", "rec", F.size("company_tag_ids") > 0)))


@query("mth_7_news_pending", S.sql(_NEWSCAP + f"""
    , y AS (SELECT *, {S.cents(f"0.55 * {S.material(chr(39) * 2 + ' || title || ' + chr(39) + ' ' + chr(39) + ' || coalesce(excerpt, ' + chr(39) * 2 + ')')} + 0.45 * (source_weight * 100.0)")} AS imp FROM x)
    SELECT news_id, imp AS importance_score, {S.cents('cap')} AS market_cap_score,
      {S.cents('0.30 * imp + 0.25 * (source_weight * 100.0) + 0.20 * cap + 0.25 * rec')} AS composite_score, 'medium' AS confidence
    FROM y""", "news", "percentile"))
def _(spark, sf):
    return _news_cap(spark, sf).select("news_id", *_scored(M.news_pending(M.news_words("title", "excerpt"), "source_weight", "cap", "rec")))


@query("mth_8_queue_priority", S.sql(_NEWSCAP + f"""
    , w AS (SELECT DISTINCT company_id FROM watchlist_members),
      hit AS (SELECT DISTINCT news_id FROM (SELECT news_id, unnest(company_tag_ids) AS c FROM news0) WHERE c IN (SELECT company_id FROM w)),
      f AS (SELECT g.*, t.raw_text, coalesce(p.pct, 0.0) AS cap, {S.recency('g.filed_at', S.AF)} AS rec, g.company_id IN (SELECT company_id FROM w) AS watched
        FROM filings g JOIN filing_text t ON t.filing_id = g.filing_id LEFT JOIN percentile p ON g.company_id = p.company_id)
    SELECT 'filing' AS kind, filing_id AS id, {S.cents(f"0.30 * {S.form_base('normalized_form_type', 50.0)} + 0.30 * {S.material('raw_text')} + 0.20 * cap + 0.20 * rec")}
        + CASE WHEN watched THEN 20.0 ELSE 0.0 END AS full_priority,
      {S.cents(f"0.30 * {S.form_base('normalized_form_type', 50.0)} + 0.30 * {S.material("concat_ws(' ', title, event_type, nullif(array_to_string(item_numbers, ' '), ''))")} + 0.20 * cap + 0.20 * rec + CASE WHEN watched THEN 20.0 ELSE 0.0 END")}
        AS cheap_priority FROM f
    UNION ALL SELECT 'news', x.news_id, {S.cents(f"0.25 * source_weight * 100.0 + 0.30 * {S.material('excerpt')} + 0.15 * cap + 0.30 * rec")}
        + CASE WHEN h.news_id IS NOT NULL THEN 20.0 ELSE 0.0 END,
      {S.cents(S.cents(f"0.25 * source_weight * 100.0 + 0.30 * {S.material('excerpt')} + 0.15 * cap + 0.30 * rec") + " + CASE WHEN h.news_id IS NOT NULL THEN 20.0 ELSE 0.0 END")}
      FROM x LEFT JOIN hit h ON x.news_id = h.news_id""", "news", "percentile", "filings", "filing_text", "watchlist_members"))
def _(spark, sf):
    members = V.watchlist_members(spark, sf)
    pct = market_percentiles(V.companies(spark, sf))
    f = flag_members(V.filings(spark, sf).join(pct, "company_id", "left"), members).join(_text_features(spark, sf), "filing_id").withColumns({
        "cap": F.coalesce("pct", F.lit(0.0)), "rec": D.recency_score("filed_at", AF)})
    f = f.select(F.lit("filing").alias("kind"), F.col("filing_id").alias("id"),
                 M.filing_queue_priority_of("normalized_form_type", "mat", "cap", "rec", "watched").alias("full_priority"),
                 M.filing_cheap_priority("normalized_form_type", "title", F.lit(None).cast("string"), "event_type",
                                         "item_numbers", "cap", "rec", "watched").alias("cheap_priority"))
    n = flag_watched(_news_cap(spark, sf), members, "news_id")
    n = n.select(F.lit("news").alias("kind"), F.col("news_id").alias("id"),
                 (M.news_queue_priority("source_weight", "excerpt", "cap", "rec")
                  + F.when(F.col("watched"), 20.0).otherwise(0.0)).alias("full_priority"),
                 M.news_queue_priority("source_weight", "excerpt", "cap", "rec", "watched").alias("cheap_priority"))
    return f.unionByName(n)


@query("mth_9_personal", S.sql(f"""
    SELECT news_id, {S.personal('composite_score', S.recency('published_at', S.AN), 'is_official', 'len(company_tag_ids) > 0', 'event_type')}
      AS relevance FROM news""", "news"))
def _(spark, sf):
    return V.news(spark, sf).select("news_id", M.personal_relevance(
        "composite_score", D.recency_score("published_at", AN), "is_official", F.size("company_tag_ids") > 0,
        "event_type").alias("relevance"))


@query("mth_10_calendar_importance", S.sql("SELECT event_id, importance_score FROM calendar2", "calendar2"))
def _(spark, sf):
    return V.calendar(spark, sf).select("event_id", "importance_score")


@query("mth_11_calendar_composite", S.sql("SELECT event_id, composite_score FROM calendar", "calendar"))
def _(spark, sf):
    return V.calendar(spark, sf).select("event_id", "composite_score")


@query("mth_12_trial_priority", S.sql(f"""
    SELECT trial_id, CAST(CASE WHEN primary_completion_date >= DATE '2000-06-01' THEN 70.0 ELSE 55.0 END
      + {S.look_up("coalesce(phase, '')", K.PHASE_BONUS, '8.0')} AS DOUBLE) AS priority FROM trials""", "trials"))
def _(spark, sf):
    up = F.col("primary_completion_date") >= F.lit("2000-06-01").cast("date")
    return V.trials(spark, sf).select("trial_id", M.trial_priority("phase", up).alias("priority"))


@query("mth_14_tiers", S.sql(f"""
    , w AS (SELECT DISTINCT company_id FROM watchlist_members),
      hit AS (SELECT DISTINCT news_id FROM (SELECT news_id, unnest(company_tag_ids) AS c FROM news0) WHERE c IN (SELECT company_id FROM w))
    SELECT 'filing' AS kind, filing_id AS id, CASE WHEN normalized_form_type IN {S.listed(K.FILING_FULL_TIER_FORMS)} OR company_id IN
      (SELECT company_id FROM w) OR coalesce(event_type IN {S.listed(K.FILING_FULL_TIER_EVENTS)}, false) THEN 'full_ai' ELSE 'short_ai' END AS tier FROM filings
    UNION ALL SELECT 'news', news_id, CASE WHEN is_official OR coalesce(event_type IN {S.listed(K.NEWS_FULL_TIER_EVENTS)}, false) OR news_id IN
      (SELECT news_id FROM hit) THEN 'full_ai' ELSE 'short_ai' END FROM news""", "filings", "news", "watchlist_members"))
def _(spark, sf):
    members = V.watchlist_members(spark, sf)
    f = flag_members(V.filings(spark, sf), members).select(
        F.lit("filing").alias("kind"), F.col("filing_id").alias("id"),
        C.filing_tier("normalized_form_type", "event_type", "watched").alias("tier"))
    n = flag_watched(V.news(spark, sf), members, "news_id").select(
        F.lit("news").alias("kind"), F.col("news_id").alias("id"), C.news_tier("is_official", "event_type", "watched").alias("tier"))
    return f.unionByName(n)


# ---- JSON -------------------------------------------------------------------------
@query("jsn_1_field_pulls", """
    SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 100 END AS DOUBLE) AS importance,
      CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 2 END AS flags, o_orderpriority AS origin FROM orders""")
def _(spark, sf):
    from signaldesk.sources.payloads import flags_of, importance_of, origin_of

    k = F.col("o_orderkey")
    full = F.to_json(F.struct((k % 100).cast("double").alias("importance_score"),
                              F.array(F.lit("a"), F.lit("b")).alias("risk_flags")))
    doc = F.when(k % 3 == 0, F.lit('{"summary": "x"}')).otherwise(full)
    meta = F.to_json(F.struct(F.col("o_orderpriority").alias("ingest_origin")))
    return V.table(spark, sf, "orders").select(
        "o_orderkey", importance_of(doc).alias("importance"), F.size(flags_of(doc, "risk_flags")).alias("flags"),
        origin_of(meta).alias("origin"))


@query("jsn_2_metadata_merge", """
    SELECT o_orderkey, 'a=' || (o_orderkey % 2) || ',b=' || CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'old' END ||
      CASE WHEN o_orderkey % 3 = 0 THEN ',c=' || o_orderstatus ELSE '' END AS merged FROM orders""")
def _(spark, sf):
    k = F.col("o_orderkey")
    old = F.create_map(F.lit("a"), (k % 2).cast("string"), F.lit("b"), F.lit("old"))
    new = F.when(k % 3 == 0, F.create_map(F.lit("b"), F.col("o_orderpriority"), F.lit("c"), F.col("o_orderstatus")))
    entries = sync.sorted_entries(sync.merge_maps(old, new))
    return V.table(spark, sf, "orders").select("o_orderkey", F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("merged"))
