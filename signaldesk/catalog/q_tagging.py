"""Company tagging and sponsor matching."""

from pyspark.sql import functions as F

from signaldesk import constants as K
from signaldesk.catalog import query, sqltext as S
from signaldesk.operators import sponsors as P, tagging as G
from signaldesk.sources import views as V

AF = V.AS_OF_FILINGS


@query("jn_8_alias_dictionary", S.sql(f"""
    , x AS (SELECT company_id, unnest([name, ticker, lower(name), name || ' Holdings']) AS mention, unnest([1, 2, 3, 4]) AS pos FROM companies),
      n AS (SELECT *, {S.entity('mention')} AS alias FROM x)
    SELECT company_id, alias, min_by(mention, pos) AS mention, length(alias) < 3 AS short FROM n WHERE alias <> '' GROUP BY company_id, alias
    """, "companies"))
def _(spark, sf):
    c = V.companies(spark, sf).withColumn("extra", F.array(F.lower("name"), F.concat("name", F.lit(" Holdings"))))
    return G.alias_dictionary(c, "extra").select("company_id", "alias", "mention", "short")


def _aliases(spark, sf):
    """First three, first five and first words of each benchmark passage."""
    from signaldesk.functions import text as T

    b = V.table(spark, sf, "benchmark")
    words = F.split(T.entity_text("text"), " ")
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    c = b.select(F.col("item_id").alias("company_id"), part(1, 3).alias("name"), F.array(part(1, 5), part(4, 2)).alias("extra"))
    return G.alias_dictionary(c, "extra")


_TAG = S.sql(f"""
    , w AS (SELECT item_id AS company_id, string_split({S.entity('text')}, ' ') AS ws FROM benchmark),
      a AS (SELECT DISTINCT company_id, alias FROM (SELECT company_id, array_to_string(ws[1:3], ' ') AS alias FROM w
        UNION ALL SELECT company_id, array_to_string(ws[1:5], ' ') FROM w UNION ALL SELECT company_id, array_to_string(ws[4:5], ' ') FROM w) WHERE alias <> ''),
      d AS (SELECT doc_id, ' ' || {S.entity('text')} || ' ' AS padded FROM documents),
      hit AS (SELECT doc_id, company_id, alias, row_number() OVER (PARTITION BY doc_id ORDER BY length(alias) DESC, alias, company_id) AS o
        FROM d JOIN a ON contains(padded, ' ' || alias || ' ')),
      firsts AS (SELECT doc_id, company_id, min(o) AS o FROM hit GROUP BY 1, 2),
      kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS rn FROM firsts),
      names AS (SELECT h.doc_id, h.alias, min(h.o) AS o FROM hit h JOIN kept k ON h.doc_id = k.doc_id AND h.company_id = k.company_id GROUP BY 1, 2)
    """, "watchlists")


@query("jn_9_entity_tags", _TAG + """
    SELECT d.doc_id, coalesce(i.ids, '') AS tags, coalesce(m.names, '') AS mentioned FROM d
      LEFT JOIN (SELECT doc_id, string_agg(CAST(company_id AS VARCHAR), ',' ORDER BY o) AS ids FROM kept GROUP BY 1) i ON d.doc_id = i.doc_id
      LEFT JOIN (SELECT doc_id, string_agg(alias, '|' ORDER BY o) AS names FROM names GROUP BY 1) m ON d.doc_id = m.doc_id""")
def _(spark, sf):
    docs = V.documents(spark, sf)
    tagged = G.tag_entities(docs, "doc_id", "text", _aliases(spark, sf))
    empty_ids, empty = F.array().cast("array<string>"), F.lit("")
    return docs.select("doc_id").join(tagged, "doc_id", "left").select(
        "doc_id", F.coalesce(F.array_join(F.coalesce(F.transform("company_tag_ids", lambda i: i.cast("string")), empty_ids), ","), empty).alias("tags"),
        F.coalesce(F.array_join("mentioned", "|"), empty).alias("mentioned"))


_SUF = "|".join(K.LEGAL_SUFFIXES)


def _core(x):
    return (f"replace(CASE WHEN regexp_matches(regexp_replace({x}, '( ({_SUF}))+$', ''), '^({_SUF})$') THEN {x} "
            f"ELSE regexp_replace({x}, '( ({_SUF}))+$', '') END, ' ', '')")


_ALIAS = f"""
    , raw AS (SELECT company_id, ticker, unnest(list_concat(trial_aliases, [name], aliases)) AS original,
        unnest(list_concat(list_transform(trial_aliases, lambda x: 0), [1], list_transform(aliases, lambda x: 2))) AS source,
        generate_subscripts(list_concat(trial_aliases, [name], aliases), 1) - 1 AS alias_pos FROM sponsor_companies),
      shaped AS (SELECT *, {S.entity('original')} AS norm FROM raw),
      ok AS (SELECT *, replace(norm, ' ', '') AS compact FROM shaped WHERE norm <> '' AND NOT (source = 2 AND
        ((length(replace(norm, ' ', '')) < 6 AND NOT contains(norm, ' ')) OR upper(original) = upper(ticker)))),
      al AS (SELECT company_id, alias_pos, original, lower(original) AS raw_lower, norm, compact, {_core('norm')} AS core,
        CASE WHEN contains(norm, ' ') OR length(norm) >= 10 THEN norm END AS loose
        FROM (SELECT *, row_number() OVER (PARTITION BY company_id, compact ORDER BY alias_pos) AS rn FROM ok) WHERE rn = 1)
    """


@query("jn_11_sponsor_aliases", S.sql(_ALIAS + """
    SELECT company_id, CAST(alias_pos AS INT) AS alias_pos, original, raw_lower, norm, compact, core, loose FROM al""", "sponsor_companies"))
def _(spark, sf):
    return P.sponsor_aliases(V.sponsor_companies(spark, sf))


_PAIRS = _ALIAS + """
    , nm AS (SELECT DISTINCT name FROM sponsors),
      pr AS (SELECT DISTINCT name, company_id FROM nm JOIN al ON trim(lower(name)) = raw_lower
          OR regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') = compact OR lower(name) LIKE '%' || loose || '%')
    """


@query("jn_12_sponsor_exists", S.sql(_PAIRS + """
    SELECT DISTINCT s.nct_id, pr.company_id FROM sponsors s JOIN pr ON s.name = pr.name""", "sponsor_companies", "sponsors"))
def _(spark, sf):
    aliases = P.sponsor_aliases(V.sponsor_companies(spark, sf))
    return P.company_studies(V.studies(spark, sf), V.sponsors(spark, sf), aliases).select("nct_id", "company_id")


@query("jn_13_lead_sponsor", S.sql("""
    SELECT nct_id, coalesce(min_by(name, id) FILTER (lower(lead_or_collaborator) = 'lead'), min_by(name, id)) AS lead_sponsor
    FROM sponsors GROUP BY 1""", "sponsors"))
def _(spark, sf):
    return P.lead_sponsor(V.sponsors(spark, sf))


_ROWS = """
    , ld AS (SELECT nct_id, coalesce(min_by(name, id) FILTER (lower(lead_or_collaborator) = 'lead'), min_by(name, id)) AS lead_sponsor FROM sponsors GROUP BY 1),
      sn AS (SELECT nct_id, string_agg(DISTINCT name, '|' ORDER BY name) AS x FROM sponsors GROUP BY 1),
      cn AS (SELECT nct_id, string_agg(DISTINCT name, '|' ORDER BY name) AS x FROM conditions GROUP BY 1),
      iv AS (SELECT nct_id, string_agg(DISTINCT name, '|' ORDER BY name) AS x FROM interventions GROUP BY 1)
    """


@query("jn_14_study_arrays", S.sql(_ROWS + """
    SELECT s.nct_id, lead_sponsor, coalesce(sn.x, '') AS sponsor_names, coalesce(cn.x, '') AS conditions, coalesce(iv.x, '') AS interventions
    FROM studies s LEFT JOIN ld ON s.nct_id = ld.nct_id LEFT JOIN sn ON s.nct_id = sn.nct_id LEFT JOIN cn ON s.nct_id = cn.nct_id
      LEFT JOIN iv ON s.nct_id = iv.nct_id""", "studies", "sponsors", "conditions", "interventions"))
def _(spark, sf):
    rows = P.study_rows(V.studies(spark, sf), V.sponsors(spark, sf), V.conditions(spark, sf), V.interventions(spark, sf))
    return rows.select("nct_id", "lead_sponsor", *[
        F.array_join(c, "|").alias(c) for c in ("sponsor_names", "conditions", "interventions")])


@query("jn_15_study_scope", S.sql(f"""
    SELECT nct_id FROM studies WHERE lower(coalesce(overall_status, '')) IN {S.listed(K.CURRENT_STATUSES)}
      OR last_update_posted_date >= DATE '1999-12-04' OR primary_completion_date >= DATE '1999-12-04'""", "studies"))
def _(spark, sf):
    return P.current_studies(V.studies(spark, sf), AF, 180).select("nct_id")


BEST_SQL = _PAIRS + f"""
    , wanted AS (SELECT DISTINCT s.nct_id, pr.company_id FROM sponsors s JOIN pr ON s.name = pr.name),
      cand AS (SELECT w.company_id, w.nct_id, s.name, a.alias_pos, a.original,
          CASE WHEN lower(trim(s.name)) = a.raw_lower THEN 320 WHEN replace({S.entity('s.name')}, ' ', '') = a.compact THEN 300
            WHEN {_core(S.entity('s.name'))} = a.core THEN 240
            WHEN starts_with({S.entity('s.name')} || ' ', a.norm || ' ') THEN 180
            WHEN contains(a.norm, ' ') AND len(list_filter(string_split(a.norm, ' '), lambda t: NOT list_contains(string_split({S.entity('s.name')}, ' '), t))) = 0
              THEN 150 ELSE 0 END AS score
        FROM wanted w JOIN (SELECT DISTINCT nct_id, name FROM sponsors) s ON s.nct_id = w.nct_id JOIN al a ON a.company_id = w.company_id),
      best AS (SELECT company_id, nct_id, name AS matched_sponsor, original AS matched_alias, score FROM (SELECT *, row_number() OVER
          (PARTITION BY company_id, nct_id ORDER BY score DESC, name, alias_pos) AS rn FROM cand WHERE score > 0) WHERE rn = 1)
    """


@query("jn_16_best_match", S.sql(BEST_SQL + " SELECT * FROM best", "sponsor_companies", "sponsors"))
def _(spark, sf):
    aliases = P.sponsor_aliases(V.sponsor_companies(spark, sf))
    return P.best_matches(V.studies(spark, sf), V.sponsors(spark, sf), aliases)
