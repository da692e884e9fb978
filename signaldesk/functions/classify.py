"""Keyword classification and eligibility predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from signaldesk import constants as K
from signaldesk.functions import text as T
from signaldesk.functions.dates import at, col


def contains_any(lowered: Column, words) -> Column:
    """Plain substring tests, as the lists also match inside words."""
    return reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])


def lowered_join(*parts) -> Column:
    cleaned = [F.nullif(col(p), F.lit("")) for p in parts]
    return F.lower(F.concat_ws(" ", *cleaned))


# ---- filings ---------------------------------------------------------------
FOREIGN_EVENT_WORDS = {"earnings": ("earnings", "results"), "regulatory": ("approval", "fda"), "material-agreement": ("partnership", "collaboration")}
#: Every word or phrase that the gate, the event type and the keyword score look for in a text.
FILING_WORDS = tuple(sorted({*K.PERIODIC_6K_WORDS, *K.MATERIAL_8K_WORDS, *K.MATERIAL_WEIGHTS, *(w for words in FOREIGN_EVENT_WORDS.values() for w in words)}))
HEAD_CHARS = 32   # longer than any of them


def filing_digest(text) -> Column:
    """A short text that holds a word of ``FILING_WORDS`` just when ``text`` does, whatever is written before either.

    The words that the whole text holds, line by line, after its first characters: a phrase that begins before the text ends
    within these.  No word has a line break, so lines make up none.  Null and empty texts stay as they are.
    """
    lowered = F.lower(col(text))
    return F.when(col(text).isNotNull(), F.concat_ws("\n", F.left(col(text), F.lit(HEAD_CHARS)), *[F.when(lowered.contains(w), w) for w in FILING_WORDS]))


def is_target_form(form) -> Column:
    return F.upper(col(form)).isin(*K.TARGET_FORMS)


def is_periodic_6k(title, items, text) -> Column:
    return contains_any(lowered_join(title, items, text), K.PERIODIC_6K_WORDS)


def is_material_8k(item_array, title, text) -> Column:
    listed = F.arrays_overlap(F.coalesce(col(item_array), F.array().cast("array<string>")),
                              F.array(*[F.lit(i) for i in K.MATERIAL_ITEMS]))
    return listed | contains_any(lowered_join(title, text), K.MATERIAL_8K_WORDS)


def passes_ingest_gate(form, accession, items, title, text) -> Column:
    norm = T.normalize_form(form)
    return (
        is_target_form(form)
        & F.nullif(col(accession), F.lit("")).isNotNull()
        & F.when(norm == "6-K", is_periodic_6k(title, items, text))
        .when(norm == "8-K", is_material_8k(T.item_numbers(items), title, text))
        .otherwise(True)
    )


def filing_event_type(norm_form, item_array, title, text) -> Column:
    topics = F.create_map(*[F.lit(v) for pair in K.ITEM_TOPICS.items() for v in pair])
    first_topic = F.get(F.filter(F.transform(col(item_array), lambda i: topics[i]), lambda t: t.isNotNull()), F.lit(0))
    words = lowered_join(title, text)
    return (
        F.when(col(norm_form).isin(*K.ANNUAL_FORMS), "annual-report")
        .when(col(norm_form) == "10-Q", "quarterly-report")
        .when((col(norm_form) == "6-K") & contains_any(words, FOREIGN_EVENT_WORDS["earnings"]), "earnings")
        .when((col(norm_form) == "6-K") & contains_any(words, FOREIGN_EVENT_WORDS["regulatory"]), "regulatory")
        .when((col(norm_form) == "6-K") & contains_any(words, FOREIGN_EVENT_WORDS["material-agreement"]), "material-agreement")
        .when(col(norm_form) == "6-K", "foreign-issuer-update")
        .when(col(norm_form) == "8-K", F.coalesce(first_topic, F.lit("current-event")))
    )


def filing_dedupe_id(company_id, accession, event_type, filed_at) -> Column:
    accession = F.nullif(col(accession), F.lit(""))
    fallback = F.concat_ws(
        ":", col(company_id).cast("string"), F.coalesce(F.nullif(col(event_type), F.lit("")), F.lit("filing")),
        F.coalesce(F.date_format(col(filed_at), "yyyy-MM-dd"), F.lit("unknown")), F.lit("unknown"))
    return F.coalesce(F.concat(F.lit("filing:"), accession), fallback)


# ---- news ---------------------------------------------------------------------
def is_promotional(title) -> Column:
    return F.lower(col(title)).rlike("|".join(K.PROMO_WORDS))


def news_source_type(source_name, url) -> Column:
    regulator = col(source_name).isin(*K.REGULATOR_SOURCES) | col(url).contains(K.REGULATOR_HOST)
    return F.when(regulator, "regulator").otherwise("trade_press")


def news_topics(title, text) -> Column:
    lowered = F.lower(F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.coalesce(col(text), F.lit(""))))
    return F.array_compact(F.array(*[
        F.when(contains_any(lowered, words), F.lit(topic)) for topic, words in K.TOPIC_WORDS.items()]))


def merged_topics(feed_tags, topics) -> Column:
    return F.array_sort(F.array_distinct(F.concat(col(feed_tags), col(topics))))


def news_event_type(title, text, topics) -> Column:
    lowered = F.lower(F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.coalesce(col(text), F.lit(""))))
    branches = [(contains_any(lowered, words), event) for event, words in K.NEWS_EVENT_WORDS.items()]
    branches += [(F.array_contains(col(topics), t), event) for t, event in K.TOPIC_EVENT_FALLBACK.items()]
    chain = F.when(*branches[0][:1], branches[0][1])
    for test, event in branches[1:]:
        chain = chain.when(test, event)
    return chain


def news_dedupe_id(tag_ids, event_type, title, published_at) -> Column:
    ids = F.slice(F.array_sort(F.coalesce(col(tag_ids), F.array().cast("array<bigint>"))), 1, 3)
    who = F.coalesce(F.nullif(F.array_join(F.transform(ids, lambda i: i.cast("string")), "-"), F.lit("")),
                     F.lit("sector"))
    words = F.array_join(F.slice(F.split(T.entity_text(title), " "), 1, 3), "-")
    what = F.coalesce(F.nullif(col(event_type), F.lit("")), F.nullif(words, F.lit("")), F.lit("general"))
    return F.concat_ws(":", who, what, F.date_format(col(published_at), "yyyy-MM-dd"))


# ---- queues -----------------------------------------------------------------------
def in_queue(status, attempts, ts, as_of, backlog_days: int) -> Column:
    from signaldesk.functions.dates import days_before

    return (
        col(status).isin(*K.QUEUE_STATUSES)
        & (col(attempts) < K.MAX_ATTEMPTS)
        & (col(ts) >= days_before(as_of, backlog_days))
    )


def filing_tier(norm_form, event_type, watched, automated: bool = True) -> Column:
    if not automated:
        return F.lit("full_ai")
    full = (
        col(norm_form).isin(*K.FILING_FULL_TIER_FORMS)
        | F.coalesce(col(watched), F.lit(False))
        | F.coalesce(col(event_type).isin(*K.FILING_FULL_TIER_EVENTS), F.lit(False))
    )
    return F.when(full, "full_ai").otherwise("short_ai")


def news_tier(is_official, event_type, watched, automated: bool = True) -> Column:
    if not automated:
        return F.lit("full_ai")
    full = (
        F.coalesce(col(is_official), F.lit(False))
        | F.coalesce(col(event_type).isin(*K.NEWS_FULL_TIER_EVENTS), F.lit(False))
        | F.coalesce(col(watched), F.lit(False))
    )
    return F.when(full, "full_ai").otherwise("short_ai")


def filing_override_eligible(norm_form, event_type, watched) -> Column:
    return (
        F.coalesce(col(watched), F.lit(False))
        | (col(norm_form) == "8-K")
        | F.coalesce(col(event_type).isin(*K.FILING_OVERRIDE_EVENTS), F.lit(False))
    )


def news_override_eligible(is_official, event_type, watched) -> Column:
    return (
        F.coalesce(col(is_official), F.lit(False))
        | F.coalesce(col(event_type).isin(*K.NEWS_OVERRIDE_EVENTS), F.lit(False))
        | F.coalesce(col(watched), F.lit(False))
    )


def has_summary(status, summary) -> Column:
    return F.coalesce(col(status) == "complete", F.lit(False)) | F.nullif(col(summary), F.lit("")).isNotNull()


def high_signal(event_type) -> Column:
    return F.coalesce(col(event_type).isin(*K.HIGH_SIGNAL_EVENTS), F.lit(False))


def filing_catalyst(norm_form, event_type) -> Column:
    return col(norm_form).isin("8-K", "6-K") | high_signal(event_type)


def news_catalyst(is_official, event_type) -> Column:
    return F.coalesce(col(is_official), F.lit(False)) | high_signal(event_type)


def trial_catalyst_kind(completion, updated, as_of, recent_days=K.CATALYST_RECENT_DAYS,
                        ahead_days=K.CATALYST_LOOKAHEAD_DAYS) -> Column:
    """``upcoming``, ``recent`` or null."""
    today = at(as_of).cast("date")
    return (
        F.when(col(completion).between(today, F.date_add(today, ahead_days)), "upcoming")
        .when(col(updated) >= F.date_sub(today, recent_days), "recent")
    )


def calendar_catalyst(starts_at, as_of, recent_days=K.CATALYST_RECENT_DAYS,
                      ahead_days=K.CATALYST_LOOKAHEAD_DAYS) -> Column:
    from signaldesk.functions.dates import days_before

    today = at(as_of).cast("date")
    return (col(starts_at) >= days_before(as_of, recent_days)) & (
        col(starts_at) < F.date_add(today, ahead_days + 1).cast("timestamp"))


def tidy_reasons(*conditions, default: str | None = None, keep: int = 3) -> Column:
    """Join the first few reasons whose condition holds."""
    joined = F.array_join(F.slice(F.array_compact(F.array(*conditions)), 1, keep), ", ")
    return joined if default is None else F.coalesce(F.nullif(joined, F.lit("")), F.lit(default))


def filing_reason(event_type, norm_form, market, impact, recency) -> Column:
    lead = (
        F.when(high_signal(event_type), F.concat(F.replace(col(event_type), F.lit("-"), F.lit(" ")), F.lit(" event")))
        .when(col(norm_form).isin(*K.ANNUAL_FORMS), "annual disclosure")
        .when(col(norm_form) == "10-Q", "quarterly disclosure")
        .when(col(norm_form) == "8-K", "current event filing")
    )
    return tidy_reasons(
        lead,
        F.when(col(recency) >= 80, "very recent"),
        F.when(col(impact) >= 75, "high change signal").when(col(impact) >= 55, "meaningful update"),
        F.when(col(market) >= 75, "large-cap issuer"),
        default="ranked on recency, form type, and company relevance",
    )


def news_reason(event_type, is_official, source_weight, tag_ids, market, importance, recency) -> Column:
    return tidy_reasons(
        F.when(high_signal(event_type), F.concat(F.replace(col(event_type), F.lit("-"), F.lit(" ")), F.lit(" coverage"))),
        F.when(F.coalesce(col(is_official), F.lit(False)), "official source")
        .when(F.coalesce(col(source_weight), F.lit(0.0)) >= 0.9, "high-trust trade press"),
        F.when(col(recency) >= 80, "very recent"),
        F.when(col(importance) >= 75, "high importance"),
        F.when((col(market) >= 75) & (F.size(F.coalesce(col(tag_ids), F.array().cast("array<bigint>"))) > 0),
               "relevant to large-cap company"),
        default="ranked on recency, source quality, and company relevance",
    )


def calendar_reason(starts_at, tag_ids, market, as_of) -> Column:
    days = F.datediff(col(starts_at).cast("date"), at(as_of).cast("date"))
    return tidy_reasons(
        F.lit("official FDA calendar"),
        F.when(days.between(0, 30), "upcoming committee date").when(days < 0, "recent committee activity"),
        F.when(F.size(F.coalesce(col(tag_ids), F.array().cast("array<bigint>"))) > 0, "linked to tracked company"),
        F.when(col(market) >= 75, "large-cap sponsor relevance"),
    )
