"""SQL building blocks for the oracles (DuckDB dialect)."""

from __future__ import annotations

from signaldesk import constants as K
from signaldesk.sources import views as V

AF = f"TIMESTAMP '{V.AS_OF_FILINGS}'"
AN = f"TIMESTAMP '{V.AS_OF_NEWS}'"


def q(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def listed(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def pick(key: str, *values) -> str:
    n = len(values)
    return "CASE " + " ".join(f"WHEN ({key}) % {n} = {i} THEN {q(v)}" for i, v in enumerate(values)) + " END"


def look_up(key: str, mapping: dict, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {key} = {q(k)} THEN {q(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


def rounded(x: str, places: int) -> str:
    s = 10 ** places
    return f"(floor(round(CAST({x} AS DOUBLE) * {s}, 4) + 0.5) / {s})"


def cents(x: str) -> str:
    return rounded(x, 2)


def age(ts: str, as_of: str) -> str:
    return f"greatest(date_diff('microsecond', {ts}, {as_of}) / 3.6e9, 0.0)"


def recency(ts: str, as_of: str) -> str:
    a = age(ts, as_of)
    return (f"(CASE WHEN {ts} IS NULL THEN NULL WHEN {a} <= 24 THEN 100.0 WHEN {a} <= 72 THEN 80.0 "
            f"WHEN {a} <= 168 THEN 60.0 ELSE greatest(10.0, 60.0 - log2({a}) * 5.0) END)")


def bucket(ts: str, as_of: str) -> str:
    a = age(ts, as_of)
    return (f"(CASE WHEN {a} <= 24 THEN 'last_24h' WHEN {a} <= 168 THEN 'last_7d' WHEN {a} <= 720 THEN 'last_30d' "
            f"WHEN {a} <= 2160 THEN 'last_90d' ELSE 'stale' END)")


def has_any(lowered: str, words) -> str:
    return "(" + " OR ".join(f"contains({lowered}, {q(w)})" for w in words) + ")"


#: Distinct words of each filing (its title's and its document's, as numbers), how many, and how many it shares with the one it is linked to.
SHARED_WORDS = """
    , doc_words AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(regexp_replace(lower(text), '^\\s+', ''), '\\s+'))) AS word
        FROM documents WHERE text IS NOT NULL),
      title_words AS (SELECT title, unnest(list_distinct(regexp_split_to_array(lower(title), '\\s+'))) AS word FROM (SELECT DISTINCT title FROM filings)),
      numbers AS (SELECT word, row_number() OVER () AS no FROM (SELECT word FROM doc_words UNION SELECT word FROM title_words)),
      doc_numbers AS (SELECT doc_id, no FROM doc_words JOIN numbers USING (word)),
      title_numbers AS (SELECT title, no FROM title_words JOIN numbers USING (word)),
      words AS (SELECT filing_id, no FROM filings JOIN doc_numbers ON doc_id = filing_id % (SELECT max(doc_id) + 1 FROM documents)
        UNION SELECT filing_id, no FROM filing_text JOIN filings USING (filing_id) JOIN title_numbers USING (title)),
      word_counts AS (SELECT filing_id, count(*) AS n FROM words GROUP BY 1),
      shared AS (SELECT k.filing_id, count(*) AS n FROM ({links}) k JOIN words a ON a.filing_id = k.filing_id
        JOIN words b ON b.filing_id = k.prior_id AND b.no = a.no GROUP BY 1)
    """


def material(text: str) -> str:
    low = f"lower(coalesce({text}, ''))"
    total = " + ".join(f"CASE WHEN contains({low}, {q(w)}) THEN {x} ELSE 0.0 END" for w, x in K.MATERIAL_WEIGHTS.items())
    return cents(f"least(({total}) * 30.0, 100.0)")


def form_base(form: str, default: float) -> str:
    return look_up(form, K.FORM_BASE_SCORE, str(default))


def norm_form(form: str) -> str:
    return f"regexp_replace(trim(upper({form})), '/A$', '')"


def entity(text: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9]+', ' ', 'g'))"


def items_of(text: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(coalesce({text}, ''), '\\b\\d\\.\\d{{2}}\\b')))"


def high_signal(event: str) -> str:
    return f"coalesce({event} IN {listed(K.HIGH_SIGNAL_EVENTS)}, false)"


def topics(title: str, text: str) -> str:
    low = f"lower(coalesce({title}, '') || ' ' || coalesce({text}, ''))"
    parts = ", ".join(f"CASE WHEN {has_any(low, ws)} THEN {q(t)} END" for t, ws in K.TOPIC_WORDS.items())
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


def news_event(title: str, text: str, tags: str) -> str:
    low = f"lower(coalesce({title}, '') || ' ' || coalesce({text}, ''))"
    parts = [f"WHEN {has_any(low, ws)} THEN {q(e)}" for e, ws in K.NEWS_EVENT_WORDS.items()]
    parts += [f"WHEN list_contains({tags}, {q(t)}) THEN {q(e)}" for t, e in K.TOPIC_EVENT_FALLBACK.items()]
    return "CASE " + " ".join(parts) + " END"


def news_group(tags: str, event: str, title: str, ts: str) -> str:
    who = f"coalesce(nullif(array_to_string(list_sort({tags})[1:3], '-'), ''), 'sector')"
    words = f"array_to_string(string_split({entity(title)}, ' ')[1:3], '-')"
    return (f"({who} || ':' || coalesce(nullif({event}, ''), nullif({words}, ''), 'general') || ':' || "
            f"strftime({ts}, '%Y-%m-%d'))")


def filing_event(form: str, items: str, title: str, text: str = "NULL") -> str:
    low = f"lower(concat_ws(' ', nullif({title}, ''), nullif({text}, '')))"
    mapped = f"list_filter(list_transform({items}, lambda i: {look_up('i', K.ITEM_TOPICS)}), lambda t: t IS NOT NULL)[1]"
    return (f"CASE WHEN {form} IN {listed(K.ANNUAL_FORMS)} THEN 'annual-report' WHEN {form} = '10-Q' THEN 'quarterly-report' "
            f"WHEN {form} = '6-K' AND {has_any(low, ('earnings', 'results'))} THEN 'earnings' "
            f"WHEN {form} = '6-K' AND {has_any(low, ('approval', 'fda'))} THEN 'regulatory' "
            f"WHEN {form} = '6-K' AND {has_any(low, ('partnership', 'collaboration'))} THEN 'material-agreement' "
            f"WHEN {form} = '6-K' THEN 'foreign-issuer-update' "
            f"WHEN {form} = '8-K' THEN coalesce({mapped}, 'current-event') END")


def committee(title: str) -> str:
    named = (f"regexp_replace(regexp_extract(trim({title}), '(?i)meeting of the ([^.]+?)(?: meeting announcement| "
             f"advisory committee|$)', 1), '^[ \\-,:]+|[ \\-,:]+$', '', 'g')")
    loose = f"trim(regexp_extract(trim({title}), '([A-Za-z][A-Za-z\\s&-]+Advisory Committee)', 1))"
    return (f"CASE WHEN regexp_matches({named}, '(?i)advisory committee') THEN {named} WHEN {named} <> '' THEN "
            f"{named} || ' Advisory Committee' WHEN {loose} <> '' THEN {loose} END")


def days_until(ts: str, as_of: str) -> str:
    return f"date_diff('day', CAST({ts} AS DATE), CAST({as_of} AS DATE)) * -1"


def cal_importance(title: str, comm: str, ts: str, market: str, as_of: str) -> str:
    d = f"({days_until(ts, as_of)})"
    timing = (f"CASE WHEN {d} BETWEEN 0 AND 30 THEN 100.0 - least({d} * 2.0, 50.0) WHEN {d} BETWEEN -14 AND -1 THEN 78.0 "
              f"WHEN {d} > 30 THEN greatest(35.0, 85.0 - least(({d} - 30) * 0.6, 45.0)) ELSE 28.0 END")
    return cents(f"least(0.60 * ({timing}) + 0.20 * {market} + CASE WHEN contains(lower({comm}), 'oncologic') THEN 16.0 "
                 f"ELSE 8.0 END + CASE WHEN contains(lower({title}), 'advisory committee') THEN 12.0 ELSE 6.0 END, 100.0)")


def cal_composite(ts: str, market: str, importance: str, as_of: str) -> str:
    d = f"({days_until(ts, as_of)})"
    urgency = (f"CASE WHEN {d} BETWEEN 0 AND 14 THEN 100.0 WHEN {d} BETWEEN 15 AND 45 THEN 82.0 WHEN {d} > 45 THEN 62.0 "
               f"WHEN {d} BETWEEN -7 AND -1 THEN 74.0 ELSE 40.0 END")
    return cents(f"0.55 * ({urgency}) + 0.25 * {market} + 0.20 * {importance}")


def personal(comp: str, rec: str, official: str, watched: str, event: str) -> str:
    return cents(f"0.45 * {comp} + 0.35 * {rec} + CASE WHEN {official} THEN 10.0 ELSE 0.0 END + CASE WHEN {watched} "
                 f"THEN 15.0 ELSE 0.0 END + CASE WHEN {high_signal(event)} THEN 8.0 ELSE 0.0 END")


def reasons(*conditions: str, default: str | None = None) -> str:
    joined = f"array_to_string(list_filter([{', '.join(conditions)}], lambda x: x IS NOT NULL)[1:3], ', ')"
    return joined if default is None else f"coalesce(nullif({joined}, ''), {q(default)})"


def filing_reason(event: str, form: str, market: str, impact: str, rec: str) -> str:
    return reasons(
        f"CASE WHEN {high_signal(event)} THEN replace({event}, '-', ' ') || ' event' WHEN {form} IN {listed(K.ANNUAL_FORMS)} "
        f"THEN 'annual disclosure' WHEN {form} = '10-Q' THEN 'quarterly disclosure' WHEN {form} = '8-K' THEN "
        f"'current event filing' END",
        f"CASE WHEN {rec} >= 80 THEN 'very recent' END",
        f"CASE WHEN {impact} >= 75 THEN 'high change signal' WHEN {impact} >= 55 THEN 'meaningful update' END",
        f"CASE WHEN {market} >= 75 THEN 'large-cap issuer' END",
        default="ranked on recency, form type, and company relevance")


def news_reason(event, official, weight, tags, market, importance, rec) -> str:
    return reasons(
        f"CASE WHEN {high_signal(event)} THEN replace({event}, '-', ' ') || ' coverage' END",
        f"CASE WHEN {official} THEN 'official source' WHEN coalesce({weight}, 0.0) >= 0.9 THEN 'high-trust trade press' END",
        f"CASE WHEN {rec} >= 80 THEN 'very recent' END",
        f"CASE WHEN {importance} >= 75 THEN 'high importance' END",
        f"CASE WHEN {market} >= 75 AND len({tags}) > 0 THEN 'relevant to large-cap company' END",
        default="ranked on recency, source quality, and company relevance")


# ---- views -------------------------------------------------------------------
_K = "o_orderkey"
_SPONSOR = f"'Supplier ' || split_part(s_name, '#', 2) || {pick('s_suppkey', ' Inc', ' Research', '')}"
_NCT = "'NCT' || lpad(CAST({} AS VARCHAR), 8, '0')"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "companies": ((), f"""
        SELECT c_custkey AS company_id, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, 'T' || c_custkey AS ticker,
               c_name AS name, n_name AS exchange, {look_up('c_mktsegment', V.SIC_BY_SEGMENT)} AS sic,
               CASE WHEN c_acctbal > 0 THEN CAST(round(c_acctbal * CAST(1e6 AS DOUBLE)) AS BIGINT) END AS market_cap,
               c_nationkey <> 7 AS is_active
        FROM customer JOIN nation ON c_nationkey = n_nationkey"""),
    "filings0": ((), f"""
        SELECT {_K} AS filing_id, o_custkey AS company_id,
               lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '-00-' || lpad(CAST({_K} AS VARCHAR), 12, '0') AS accession_number,
               {pick(_K, *V.FILING_FORMS)} AS form_type, o_orderdate AS filed_at,
               {look_up('o_orderstatus', V.FILING_STATUS)} AS status, CAST({_K} % 4 AS INT) AS attempts,
               {cents('o_totalprice % 100')} AS importance_score, {cents('o_totalprice % 89')} AS impact_score,
               {cents('o_totalprice % 97')} AS composite_score, CAST({_K} % 5 AS INT) AS risk_n, CAST({_K} % 3 AS INT) AS opp_n,
               {pick(_K, *V.FILING_TITLES)} AS title, {pick(_K, *V.FILING_ITEMS)} AS items,
               {pick(_K, 'sec_poll', 'historical_backfill')} AS ingest_origin
        FROM orders"""),
    "filings1": (("filings0",), f"""
        SELECT *, {norm_form('form_type')} AS normalized_form_type, {items_of('items')} AS item_numbers,
               CASE WHEN status = 'complete' AND title IS NOT NULL THEN 'Summary of ' || title END AS summary
        FROM filings0"""),
    "filings": (("filings1",), f"""
        SELECT *, {filing_event('normalized_form_type', 'item_numbers', 'title')} AS event_type FROM filings1"""),
    "filing_text": (("filings",), """
        SELECT filing_id, company_id, normalized_form_type, filed_at, concat_ws(chr(10), title, text) AS raw_text
        FROM filings JOIN documents ON doc_id = filing_id % (SELECT max(doc_id) + 1 FROM documents)"""),
    "news0": ((), f"""
        SELECT event_id AS news_id, ts AS published_at, event_type AS source_name,
               CAST({look_up('event_type', V.NEWS_WEIGHT)} AS DOUBLE) AS source_weight,
               CASE WHEN event_id % 6 = 0 THEN CAST([] AS BIGINT[]) WHEN user_id = (user_id * 7 + 3) % 150 THEN [user_id]
                    ELSE [user_id, (user_id * 7 + 3) % 150] END AS company_tag_ids,
               event_type = 'signup' AS is_official, value AS composite_score, {pick('event_id', *V.NEWS_TITLES)} AS title,
               {pick('event_id', *V.NEWS_EXCERPTS)} AS excerpt,
               'https://news.example.com/' || event_type || '/' || event_id AS canonical_url,
               {pick('event_id', *V.NEWS_STATUS)} AS status, CAST(event_id % 5 AS INT) AS attempts
        FROM events"""),
    "news1": (("news0",), f"SELECT *, {topics('title', 'excerpt')} AS topic_tags FROM news0"),
    "news2": (("news1",), f"""
        SELECT *, {news_event('title', 'excerpt', 'topic_tags')} AS event_type, 'trade_press' AS source_type,
               CASE WHEN status = 'complete' THEN 'Summary of ' || title END AS summary FROM news1"""),
    "news": (("news2",), f"""
        SELECT *, {news_group('company_tag_ids', 'event_type', 'title', 'published_at')} AS dedupe_group_id FROM news2"""),
    "trials": ((), f"""
        SELECT p_partkey AS trial_id, {_NCT.format('p_partkey')} AS nct_id, p_partkey % 150 AS company_id,
               p_name || ' study ' || p_partkey AS title, {pick('p_size', *V.TRIAL_PHASES)} AS phase,
               {look_up('p_type', V.TRIAL_STATUS)} AS status,
               DATE '1998-01-01' + CAST(p_partkey % 1000 AS INT) AS start_date,
               DATE '2000-01-01' + CAST(p_partkey * 7 % 700 AS INT) AS primary_completion_date,
               CASE WHEN p_partkey % 13 <> 0 THEN DATE '1999-01-01' + CAST(p_partkey * 3 % 510 AS INT) END AS last_update_date,
               p_size * 10 AS enrollment, 'Interventional' AS study_type
        FROM part"""),
    "studies": (("trials",), """
        SELECT nct_id, title AS brief_title, phase, status AS overall_status, start_date, primary_completion_date,
               last_update_date AS last_update_posted_date, enrollment, study_type FROM trials"""),
    "sponsors": ((), f"""
        SELECT l_suppkey AS id, {_NCT.format('l_partkey')} AS nct_id, {_SPONSOR} AS name,
               CASE WHEN (l_partkey + l_suppkey) % 3 = 0 THEN 'lead' ELSE 'collaborator' END AS lead_or_collaborator
        FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey"""),
    "conditions": ((), f"SELECT {_NCT.format('p_partkey')} AS nct_id, unnest([p_brand, p_type]) AS name FROM part"),
    "interventions": ((), f"SELECT {_NCT.format('p_partkey')} AS nct_id, unnest(string_split(p_name, ' ')) AS name FROM part"),
    "sponsor_companies": ((), f"""
        SELECT s_suppkey AS company_id, 'S' || s_suppkey AS ticker,
               CASE s_suppkey % 5 WHEN 0 THEN upper({_SPONSOR}) WHEN 1 THEN 'Supplier-' || split_part(s_name, '#', 2) || ' (Inc)'
                    WHEN 2 THEN 'Supplier ' || split_part(s_name, '#', 2) || ' Ltd'
                    WHEN 3 THEN 'Supplier ' || split_part(s_name, '#', 2)
                    ELSE split_part(s_name, '#', 2) || ' Research' END AS name,
               ['S' || s_suppkey, 'Gen', split_part(s_name, '#', 2) || ' Research'] AS aliases,
               CASE WHEN s_suppkey % 7 = 0 THEN ['Supplier ' || split_part(s_name, '#', 2) || ' Research']
                    ELSE CAST([] AS VARCHAR[]) END AS trial_aliases
        FROM supplier"""),
    "calendar0": ((), f"""
        SELECT {_K} AS event_id, o_orderdate AS starts_at,
               coalesce('Meeting of the ' || {look_up('o_orderpriority', V.COMMITTEES)} ||
                        ' Advisory Committee Meeting Announcement', 'Public workshop on labeling') AS title,
               [o_custkey] AS company_tag_ids, 'https://calendar.example.org/event/' || {_K} AS canonical_url,
               {pick(_K, None, 'Agenda notes', 'Agenda notes', 'Agenda notes')} AS summary_text
        FROM orders"""),
    "calendar1": (("calendar0",), f"SELECT *, {committee('title')} AS committee_name FROM calendar0"),
    "calendar2": (("calendar1",), f"""
        SELECT *, {cal_importance('title', 'committee_name', 'starts_at', '0.0', AF)} AS importance_score FROM calendar1"""),
    "calendar": (("calendar2",), f"""
        SELECT *, {cal_composite('starts_at', '0.0', 'importance_score', AF)} AS composite_score FROM calendar2"""),
    "watchlists": ((), "SELECT r_regionkey AS watchlist_id, r_name AS name FROM region"),
    "watchlist_members": ((), """
        SELECT n_regionkey AS watchlist_id, c_custkey AS company_id FROM customer JOIN nation ON c_nationkey = n_nationkey
        WHERE c_mktsegment = 'MACHINERY'"""),
    "usage0": ((), f"""
        SELECT event_id AS call_id, ts AS used_at, {look_up('event_type', V.USAGE_KIND)} AS kind,
               {pick("CAST(regexp_extract(props, '[0-9]+') AS INT)", *V.USAGE_MODELS)} AS model,
               CAST(CASE WHEN event_id % 10 = 0 THEN 0 ELSE 1 END AS BIGINT) AS calls,
               CAST(floor(value * 100) AS BIGINT) AS prompt_tokens
        FROM events"""),
    "usage_log": (("usage0",), """
        SELECT *, CAST(floor(prompt_tokens * CAST(0.3 AS DOUBLE)) AS BIGINT) AS completion_tokens,
               CAST(floor(prompt_tokens * CAST(0.05 AS DOUBLE)) AS BIGINT) AS reasoning_tokens,
               CAST(floor(prompt_tokens * CAST(0.2 AS DOUBLE)) AS BIGINT) AS cached_input_tokens FROM usage0"""),
    "alias_source": ((), f"""
        SELECT item_id AS company_id, array_to_string(string_split({entity('text')}, ' ')[1:3], ' ') AS name FROM benchmark"""),
    "percentile": (("companies",), """
        SELECT company_id, CASE WHEN n = 1 THEN 100.0::DOUBLE ELSE CAST(i AS DOUBLE) / (n - 1) * 100.0::DOUBLE END AS pct FROM (
            SELECT company_id, row_number() OVER (ORDER BY market_cap, company_id) - 1 AS i, count(*) OVER () AS n
            FROM companies WHERE is_active AND market_cap <> 0)"""),
}


def sql(body: str, *names: str) -> str:
    """Prefix ``body`` with the views it needs, in dependency order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in VIEWS[name][0]:
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    head = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered)
    stripped = body.strip()
    if stripped.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {stripped[14:]}"
    if stripped.startswith(","):
        return f"WITH {head}{stripped}"
    if stripped.upper().startswith("WITH"):
        return f"WITH {head}, {stripped[4:]}"
    return f"WITH {head} {stripped}"
