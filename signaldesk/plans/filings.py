"""Filing jobs: ingest, rerank, ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from signaldesk.functions import classify as C, dates as D, scores as M, summaries as R, text as T
from signaldesk.functions.dates import col
from signaldesk.operators import filters as O, linking, ranking as RK, sync, texts as X
from signaldesk import constants as K
from signaldesk.runtime import staged

PENDING_NOTES = ("Pending summary rank uses market cap, filing form weight, material keywords, and recency.",)
COMPLETE_NOTES = (
    "Composite = 0.20 market cap percentile + 0.50 impact score + 0.30 recency",
    "Impact = 0.25 novelty + 0.20 quantitative delta + 0.15 material events + 0.15 LLM materiality + 0.25 recency",
)


def _explanation(components: dict[str, Column], notes, confidence: Column) -> Column:
    pairs = [v for name, value in components.items() for v in (F.lit(name), value)]
    return F.struct(F.create_map(*pairs).alias("components"), F.array(*[F.lit(n) for n in notes]).alias("rationale"),
                    confidence.alias("confidence"))


def confidence_of(has_cap) -> Column:
    return F.when(col(has_cap), "high").otherwise("degraded")


def pending_explanation(norm_form, material, recency, market, has_cap) -> Column:
    return _explanation({
        "market_cap": M.cents(market),
        "form_weight": M.cents(M.form_base(norm_form, K.FORM_BASE_PENDING_DEFAULT)),
        "material_events": M.cents(material),
        "recency": M.cents(recency),
    }, PENDING_NOTES, confidence_of(has_cap))


def complete_explanation(novelty, quant, material, llm, recency, market, has_cap) -> Column:
    return _explanation({
        "market_cap": M.cents(market), "novelty": col(novelty), "quantitative_delta": col(quant),
        "material_events": col(material), "llm_materiality": M.cents(llm), "recency": M.cents(recency),
    }, COMPLETE_NOTES, confidence_of(has_cap))


def with_market(df: DataFrame, companies: DataFrame) -> DataFrame:
    """Add name, market percentile and whether a market value is known."""
    pct = RK.market_percentiles(companies)
    c = companies.select("company_id", "name", F.col("market_cap").isNotNull().alias("has_cap"))
    return df.join(c, "company_id").join(pct, "company_id", "left").withColumn(
        "market", F.coalesce("pct", F.lit(0.0))).drop("pct")


def rank_pending(filings: DataFrame, texts: DataFrame, companies: DataFrame, as_of, limit: int = 50) -> DataFrame:
    """Best pending filings of active companies, scored on their whole texts (filing_id, raw_text)."""
    active = companies.filter("is_active")
    # Each text becomes its score where it is read.
    material = texts.select("filing_id", M.material_score("raw_text").alias("material"))
    rows = with_market(filings.filter(F.col("status") == "pending"), active).join(material, "filing_id", "left").withColumns({
        "recency": D.recency_score("filed_at", as_of), "material": F.coalesce("material", F.lit(0.0))})
    scored = rows.withColumns(M.filing_pending("normalized_form_type", "material", "recency", "market"))
    best = RK.page(scored, RK.importance_order("filed_at", "filing_id"), limit)
    return best.select(
        "filing_id", "company_id", "name", "form_type", F.date_format("filed_at", "yyyy-MM-dd").alias("filed_on"),
        "market_cap_score", "importance_score", "impact_score", "composite_score",
        D.freshness_bucket("filed_at", as_of).alias("freshness_bucket"),
        C.filing_reason("event_type", "normalized_form_type", "market_cap_score", "impact_score", "recency")
        .alias("priority_reason"))


def ingest(raw: DataFrame, stored: DataFrame, companies: DataFrame, as_of, origin: str = K.POLL_ORIGIN,
           years_back: int | None = None, per_company: int | None = None) -> DataFrame:
    """Raw filing rows (with text) to new, classified, scored filings.

    Gate, event type and keyword score are made where a text is read; the text itself takes part in no join.  Where filings
    share documents, ``raw_text`` may hold the document's ``filing_digest`` in place of its text.
    ``raw``: company_id, accession_number, form, acceptance, document, title, items, raw_text.
    ``stored``: existing filings (company_id, filing_id, accession_number, normalized_form_type, filed_at).
    New rows get the accession number as id in the prior link.
    """
    wanted = raw.filter(C.is_target_form("form") & F.nullif(F.col("accession_number"), F.lit("")).isNotNull()
                        & C.passes_ingest_gate("form", "accession_number", "items", "title", "raw_text"))
    read = wanted.withColumns({
        "normalized_form_type": T.normalize_form("form"), "item_numbers": T.item_numbers("items"), "material": M.material_score("raw_text"),
    }).withColumn("event_type", C.filing_event_type("normalized_form_type", "item_numbers", "title", "raw_text")).drop("raw_text")
    fresh = sync.new_by_key(read, stored, "accession_number")
    # Read by the history and by the scores: no text is looked through again.
    one = staged(RK.top_n(fresh, ["accession_number"], [F.col("acceptance").asc()], 1), "new-filings")
    rows = one.withColumns({
        "form_type": F.upper("form"), "filed_at": D.parse_acceptance("acceptance"),
    }).withColumns({
        "is_amendment": F.col("form_type").endswith("/A"),
        "ingest_origin": F.lit(origin), "status": F.lit("pending"),
        "freshness_bucket": D.freshness_bucket("filed_at", as_of),
        "recency": D.recency_score("filed_at", as_of),
    })
    if years_back or per_company:
        rows = O.backfill_cut(rows.withColumn("filing_id", F.col("accession_number")), "company_id", "filed_at", as_of,
                              years_back, per_key=per_company).drop("filing_id")
    rows = with_market(rows, companies).withColumn("shown_title", F.coalesce(
        F.nullif(F.col("title"), F.lit("")), F.concat_ws(" ", "name", "form_type")))
    # Of the stored history only that of the batch's companies is linked.
    known = stored.join(rows.select("company_id").distinct(), "company_id", "left_semi")
    history = known.select("company_id", "accession_number", "normalized_form_type", "filed_at").unionByName(
        rows.select("company_id", "accession_number", "normalized_form_type", "filed_at"))
    prior = linking.prior_strict(history.withColumnRenamed("accession_number", "filing_id")).select(
        F.col("filing_id").alias("accession_number"), F.col("prior_id").alias("prior_accession"))
    urls = T.filing_urls("company_id", "accession_number", "document")
    scored = rows.join(prior, "accession_number", "left").withColumns(
        M.filing_pending("normalized_form_type", "material", "recency", "market"))
    return scored.withColumns({
        **urls,
        "dedupe_group_id": C.filing_dedupe_id("company_id", "accession_number", "event_type", "filed_at"),
        "confidence": confidence_of("has_cap"),
        "priority_reason": C.filing_reason("event_type", "normalized_form_type", "market_cap_score", "impact_score", "recency"),
    })


def rerank(filings: DataFrame, texts: DataFrame, companies: DataFrame, as_of, company_ids: DataFrame | None = None) -> DataFrame:
    """Rescore filings of active companies against their previous filing.

    ``texts``: (filing_id, raw_text); or, where filings share documents, (doc_id, text), with a doc_id for each filing,
    whose text is then its title and the document.  Each distinct text is read once, for its features, and each distinct
    pair compared once.
    """
    scope = companies.filter("is_active")
    if company_ids is not None:
        scope = scope.join(company_ids, "company_id", "left_semi")
    if "doc_id" in texts.columns:
        filings, bodies = filings.withColumn("head", F.col("title")), texts.select("doc_id", "text")
    else:
        filings = filings.withColumns({"doc_id": F.col("filing_id"), "head": F.lit(None).cast("string")})
        bodies = texts.select(F.col("filing_id").alias("doc_id"), F.col("raw_text").alias("text"))
    narrow = filings.select("filing_id", "company_id", "status", "normalized_form_type", "event_type", "filed_at", "importance_score", "doc_id", "head")
    linked = linking.prior_sequential(narrow, "doc_id", "head")
    # Percentiles are over all active companies, whatever the scope.
    pct = RK.market_percentiles(companies)
    rows = linked.join(scope.select("company_id", F.col("market_cap").isNotNull().alias("has_cap")), "company_id").join(
        pct, "company_id", "left").withColumn("market", F.coalesce("pct", F.lit(0.0))).drop("pct")
    # Read by the pairs and by the scores: histories are linked once, and their exchanges go before texts are compared.
    rows = staged(rows.drop("grp"), "linked")
    is_done = F.col("status") == "complete"
    # Novelty counts in complete filings only.
    rows = X.with_pairs(rows, X.scored_pairs(rows, bodies, is_done)).withColumns({
        "recency": D.recency_score("filed_at", as_of), "material": F.coalesce("material", F.lit(0.0)),
        "quant": M.quantitative_delta("mean", "prior_mean"), "novelty": F.coalesce("novelty", F.lit(0.0))})
    done = M.filing_complete("novelty", "quant", "material", F.coalesce("importance_score", F.lit(0.0)), "recency", "market")
    wait = M.filing_pending("normalized_form_type", "material", "recency", "market")
    scored = rows.select("*", *[F.when(is_done, done[n]).otherwise(wait[n]).alias(f"new_{n}") for n in done])
    return scored.select(
        "filing_id", "company_id", "prior_id", *[F.col(f"new_{n}").alias(n) for n in done],
        confidence_of("has_cap").alias("confidence"), D.freshness_bucket("filed_at", as_of).alias("freshness_bucket"),
        C.filing_reason("event_type", "normalized_form_type", "new_market_cap_score", "new_impact_score", "recency")
        .alias("priority_reason"))


def list_filings(filings: DataFrame, companies: DataFrame, as_of, sort: str = "importance", limit: int = 50,
                 offset: int = 0, company_id: int | None = None, form: str | None = None, text: str | None = None,
                 recent_days: int | None = None, members: DataFrame | None = None) -> DataFrame:
    """Ranked page of filings on narrow columns.

    With a company the order is by form priority; otherwise importance,
    freshness, personal (global) or page_local (the fresh page, reordered).
    """
    rows = filings.join(companies.select("company_id", "name", "ticker"), "company_id")
    rows = O.facets(rows, company_id=company_id, normalized_form_type=form)
    if members is not None:
        rows = rows.join(members.select("company_id").distinct(), "company_id", "left_semi")
    if text:
        rows = O.search(rows, text, "title", "name", "ticker")
    if recent_days is not None:
        rows = O.recent(rows, "filed_at", as_of, recent_days)
    rows = rows.withColumn("relevance", M.personal_relevance(
        "composite_score", D.recency_score("filed_at", as_of), F.lit(True), F.lit(members is not None), "event_type"))
    fresh, personal = RK.freshness_order("filed_at", "filing_id"), RK.personal_order("filed_at", "filing_id")
    if company_id is not None:
        return RK.page(rows, RK.company_list_order(), limit, offset)
    if sort == "page_local":
        return RK.page_local_personal(rows, fresh, personal, limit, offset)
    order = {"importance": RK.importance_order("filed_at", "filing_id"), "freshness": fresh, "personal": personal}[sort]
    return RK.page(rows, order, limit, offset)


def list_line(sections=None) -> Column:
    return F.coalesce(F.nullif(F.col("summary"), F.lit("")), R.list_summary(
        "normalized_form_type", "title", "event_type", "item_numbers", sections, "title"))
