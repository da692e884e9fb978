"""Score expressions.  Every published score is rounded to two places by ``cents``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from signaldesk import constants as K
from signaldesk.functions.classify import high_signal
from signaldesk.functions.dates import at, col


def rounded(value, places: int) -> Column:
    """Half-up at ``places``, after settling float noise four places further."""
    scale = 10 ** places
    return F.floor(F.round(col(value) * float(scale), 4) + 0.5) / scale


def cents(value) -> Column:
    return rounded(value, 2)


def material_score(text) -> Column:
    lowered = F.lower(F.coalesce(col(text), F.lit("")))
    total = sum((F.when(lowered.contains(w), weight).otherwise(0.0) for w, weight in K.MATERIAL_WEIGHTS.items()),
                F.lit(0.0))
    return cents(F.least(total * 30.0, F.lit(100.0)))


def material_hits(text) -> Column:
    """Which of the keywords a text holds."""
    lowered = F.lower(F.coalesce(col(text), F.lit("")))
    return F.array(*[lowered.contains(w) for w in K.MATERIAL_WEIGHTS])


def material_of(*hits) -> Column:
    """``material_score`` of a text made of lines whose ``material_hits`` are given (no keyword spans a line break)."""
    held = [reduce(lambda a, b: a | b, [F.get(col(h), F.lit(i)) for h in hits]) for i in range(len(K.MATERIAL_WEIGHTS))]
    total = sum((F.when(any_, weight).otherwise(0.0) for any_, weight in zip(held, K.MATERIAL_WEIGHTS.values())), F.lit(0.0))
    return cents(F.least(total * 30.0, F.lit(100.0)))


def form_base(norm_form, default: float) -> Column:
    table = F.create_map(*[F.lit(v) for pair in K.FORM_BASE_SCORE.items() for v in pair])
    return F.coalesce(table[col(norm_form)], F.lit(default))


def number_list(text) -> Column:
    """All numbers of a text as doubles (``$`` and ``%`` signs dropped)."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"\$?\b\d+(?:\.\d+)?%?\b"), F.lit(0))
    return F.transform(found, lambda s: F.translate(s, "$%", "").cast("double"))


def mean_of(numbers) -> Column:
    total = F.aggregate(col(numbers), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(col(numbers)) > 0, total / F.size(col(numbers)))


def quantitative_delta(mean_now, mean_prior) -> Column:
    """Both sides are number means, null when a text has no numbers."""
    change = F.abs(col(mean_now) - col(mean_prior)) / F.greatest(F.abs(col(mean_prior)), F.lit(1.0))
    return (
        F.when(col(mean_now).isNull(), 10.0)
        .when(col(mean_prior).isNull(), 55.0)
        .when(col(mean_prior) == 0, 60.0)
        .otherwise(cents(F.least(change * 100.0, F.lit(100.0))))
    )


def word_set(text) -> Column:
    """The distinct words of a whole text as sorted 64-bit hashes; null without text."""
    words = F.transform(F.split(F.lower(col(text)), r"\s+"), lambda w: F.xxhash64(w))
    return F.when(F.nullif(col(text), F.lit("")).isNotNull(), F.array_sort(F.array_distinct(words)))


def _hashes(words: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def body_words(text) -> Column:
    """The distinct words of a text that follows a line break, as sorted hashes; null without text."""
    found = F.split(F.lower(F.concat(F.lit("\n"), col(text))), r"\s+")
    return _hashes(F.slice(found, 2, F.size(found)))


def joined_words(head, words, lead) -> Column:
    """``word_set`` of the head (may be null), a line break and a body, of which ``body_words`` and the first character are given."""
    found = F.split(F.lower(F.concat(col(head), F.lit("\n"))), r"\s+")
    first = F.transform(F.slice(found, 1, F.size(found) - 1), lambda w: F.xxhash64(w))
    none = F.array().cast("array<bigint>")
    return F.when(F.concat_ws("\n", col(head), col(lead)) != "", F.array_union(F.coalesce(first, none), F.coalesce(col(words), none)))


NO_PRIOR = 65.0    # novelty of a text without a prior one


def novelty(now, prior) -> Column:
    """Text dissimilarity 0..100 by ``word_set`` of both: one minus the Jaccard overlap; no text 0, no prior text 65."""
    shared = F.size(F.array_intersect(col(now), col(prior)))
    ratio = shared / (F.size(col(now)) + F.size(col(prior)) - shared)
    return F.when(col(now).isNull(), 0.0).when(col(prior).isNull(), NO_PRIOR).otherwise(cents((1.0 - ratio) * 100.0))


def filing_complete(novelty_c, quant, material, llm, recency, market) -> dict[str, Column]:
    impact = cents(0.25 * col(novelty_c) + 0.20 * col(quant) + 0.15 * col(material) + 0.15 * col(llm)
                   + 0.25 * col(recency))
    return {
        "market_cap_score": cents(market),
        "importance_score": cents(llm),
        "impact_score": impact,
        "composite_score": cents(0.20 * col(market) + 0.50 * impact + 0.30 * col(recency)),
    }


def filing_pending(norm_form, material, recency, market) -> dict[str, Column]:
    base = form_base(norm_form, K.FORM_BASE_PENDING_DEFAULT)
    impact = cents(0.35 * base + 0.30 * col(material) + 0.35 * col(recency))
    return {
        "market_cap_score": cents(market),
        "importance_score": cents(0.60 * base + 0.40 * col(material)),
        "impact_score": impact,
        "composite_score": cents(0.35 * col(market) + 0.40 * impact + 0.25 * col(recency)),
    }


def news_complete(importance, source_weight, market, recency, has_mentions) -> dict[str, Column]:
    source = col(source_weight) * 100.0
    tagged = 0.35 * col(importance) + 0.15 * source + 0.15 * col(market) + 0.35 * col(recency)
    untagged = 0.50 * col(importance) + 0.20 * source + 0.30 * col(recency)
    return {
        "importance_score": cents(importance),
        "market_cap_score": cents(market),
        "composite_score": cents(F.when(col(has_mentions), tagged).otherwise(untagged)),
        "confidence": F.when(col(has_mentions), "high").otherwise("medium"),
    }


def news_words(title, body) -> Column:
    """Keyword score of a story."""
    return material_score(F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.coalesce(col(body), F.lit(""))))


def news_pending(words, source_weight, market, recency) -> dict[str, Column]:
    source = col(source_weight) * 100.0
    importance = cents(0.55 * col(words) + 0.45 * source)
    return {
        "importance_score": importance,
        "market_cap_score": cents(market),
        "composite_score": cents(0.30 * importance + 0.25 * source + 0.20 * col(market) + 0.25 * col(recency)),
        "confidence": F.lit("medium"),
    }


def filing_queue_priority(norm_form, text, market, recency, watched=None) -> Column:
    """Full-text priority; the watchlist bonus is added after rounding."""
    return filing_queue_priority_of(norm_form, material_score(text), market, recency, watched)


def filing_queue_priority_of(norm_form, material, market, recency, watched=None) -> Column:
    base = form_base(norm_form, K.FORM_BASE_QUEUE_DEFAULT)
    score = cents(0.30 * base + 0.30 * col(material) + 0.20 * col(market) + 0.20 * col(recency))
    return score if watched is None else score + F.when(col(watched), 20.0).otherwise(0.0)


def filing_cheap_priority(norm_form, title, description, event_type, item_array, market, recency, watched) -> Column:
    """Metadata-only priority for the first sieve."""
    words = F.concat_ws(" ", *[F.nullif(col(c), F.lit("")) for c in (title, description, event_type)],
                        F.nullif(F.array_join(col(item_array), " "), F.lit("")))
    base = form_base(norm_form, K.FORM_BASE_QUEUE_DEFAULT)
    return cents(0.30 * base + 0.30 * material_score(words) + 0.20 * col(market) + 0.20 * col(recency)
                 + F.when(col(watched), 20.0).otherwise(0.0))


def news_queue_priority(source_weight, body, market, recency, watched=None) -> Column:
    return news_queue_priority_of(source_weight, material_score(body), market, recency, watched)


def news_queue_priority_of(source_weight, material, market, recency, watched=None) -> Column:
    weight = F.when(F.coalesce(col(source_weight), F.lit(0.0)) == 0, 0.5).otherwise(col(source_weight))
    score = cents(0.25 * weight * 100.0 + 0.30 * col(material) + 0.15 * col(market)
                  + 0.30 * col(recency))
    return score if watched is None else cents(score + F.when(col(watched), 20.0).otherwise(0.0))


def personal_relevance(composite, recency, is_official, watched, event_type) -> Column:
    return cents(
        0.45 * col(composite) + 0.35 * col(recency)
        + F.when(col(is_official), 10.0).otherwise(0.0)
        + F.when(col(watched), 15.0).otherwise(0.0)
        + F.when(high_signal(event_type), 8.0).otherwise(0.0))


def _days_until(starts_at, as_of) -> Column:
    return F.datediff(col(starts_at).cast("date"), at(as_of).cast("date"))


def calendar_importance(title, committee, starts_at, market, as_of) -> Column:
    days = _days_until(starts_at, as_of)
    timing = (
        F.when(days.between(0, 30), 100.0 - F.least(days * 2.0, F.lit(50.0)))
        .when(days.between(-14, -1), 78.0)
        .when(days > 30, F.greatest(F.lit(35.0), 85.0 - F.least((days - 30) * 0.6, F.lit(45.0))))
        .otherwise(28.0)
    )
    committee_bonus = F.when(F.lower(col(committee)).contains("oncologic"), 16.0).otherwise(8.0)
    title_bonus = F.when(F.lower(col(title)).contains("advisory committee"), 12.0).otherwise(6.0)
    return cents(F.least(0.60 * timing + 0.20 * col(market) + committee_bonus + title_bonus, F.lit(100.0)))


def calendar_composite(starts_at, market, importance, as_of) -> Column:
    days = _days_until(starts_at, as_of)
    urgency = (
        F.when(days.between(0, 14), 100.0).when(days.between(15, 45), 82.0).when(days > 45, 62.0)
        .when(days.between(-7, -1), 74.0).otherwise(40.0)
    )
    return cents(0.55 * urgency + 0.25 * col(market) + 0.20 * col(importance))


def trial_priority(phase, upcoming) -> Column:
    bonus = F.create_map(*[F.lit(v) for pair in K.PHASE_BONUS.items() for v in pair])
    return F.when(col(upcoming), 70.0).otherwise(55.0) + F.coalesce(bonus[F.coalesce(col(phase), F.lit(""))], F.lit(8.0))
