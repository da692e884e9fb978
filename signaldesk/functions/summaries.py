"""Rule-based summaries and short descriptive lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from signaldesk import constants as K
from signaldesk.functions import text as T
from signaldesk.functions.dates import col, display_date


def sentences(flat) -> Column:
    """Sentences of a text whose white space is already single."""
    parts = F.split(col(flat), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def flag_hits(lowered: Column, label: str, words) -> Column:
    return F.array_compact(F.array(*[F.when(lowered.contains(w), F.lit(f"{label}: {w}")) for w in words]))


def with_rule_summary(df: DataFrame, title: str, text: str) -> DataFrame:
    """Add a keyword-rule summary: text, takeaways, three flag lists and importance.

    The squeezed text, its lower case and its sentences are columns of their
    own, so each is computed once per row.
    """
    staged = df.withColumn("_flat", T.squeeze(F.coalesce(col(text), F.lit("")))).withColumns({
        "_low": F.lower("_flat"), "_sent": sentences("_flat")})
    hits = sum((F.when(F.col("_low").contains(w), 1).otherwise(0) for w in K.SUMMARY_IMPORTANCE_WORDS), F.lit(0))
    out = staged.withColumns({
        "summary": F.coalesce(
            F.nullif(F.array_join(F.slice("_sent", 1, 2), " "), F.lit("")), col(title)),
        "key_takeaways": F.when(F.size("_sent") > 0, F.slice("_sent", 1, 3)).otherwise(F.array(col(title))),
        "importance_score": F.least(30.0 + 10.0 * hits, F.lit(100.0)),
        **{name: flag_hits(F.col("_low"), label, words) for name, (label, words) in K.SUMMARY_FLAG_WORDS.items()},
    })
    return out.drop("_flat", "_low", "_sent")


def summary_source(sections, raw_text, tier: str = "full_ai") -> Column:
    """Text handed to a summariser: titled sections (the first three for the short tier), else the raw text; all whole."""
    count = 3 if tier == "short_ai" else len(K.SECTION_ORDER)
    ordered = F.filter(
        F.array(*[F.struct(F.lit(name).alias("name"), col(sections)[name].alias("body")) for name in K.SECTION_ORDER]),
        lambda s: s["body"].isNotNull())
    blocks = F.transform(F.slice(ordered, 1, count),
                         lambda s: F.concat(F.lit("["), s["name"], F.lit("]\n"), s["body"]))
    return F.when(F.size(ordered) > 0, F.array_join(blocks, "\n\n")).otherwise(
        F.coalesce(col(raw_text), F.lit("")))


def summary_status(old_summary, old_hash, old_version, source_text, version: str, old_status) -> Column:
    """No summary: pending.  Source text or prompt version changed: stale.  Else unchanged."""
    changed = ~F.sha2(col(source_text), 256).eqNullSafe(col(old_hash)) | ~col(old_version).eqNullSafe(F.lit(version))
    return F.when(col(old_summary).isNull(), "pending").when(changed, "stale").otherwise(col(old_status))


def looks_like_heading(line: Column) -> Column:
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    n = F.size(words)
    return (n > 0) & (n <= 18) & ~(line.endswith(".") & (n > 4)) & (capital >= F.greatest(F.lit(1), F.floor(n / 2)))


SNIPPET_SECTIONS = ("md&a", "business", "risk_factors", "legal_proceedings", "financial_statements")


def section_snippet(sections) -> Column:
    body = F.coalesce(*[F.nullif(col(sections)[name], F.lit("")) for name in SNIPPET_SECTIONS])
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    prose = F.filter(lines, lambda x: ~((F.size(F.split(x, r"\s+")) <= 8) & looks_like_heading(x)))
    return F.coalesce(F.get(prose, F.lit(0)), F.get(lines, F.lit(0)))


def list_summary(norm_form, title, event_type, item_array, sections, description) -> Column:
    """What a list shows when no summary exists yet."""
    has_title = F.nullif(col(title), F.lit("")).isNotNull()
    event = F.replace(col(event_type), F.lit("-"), F.lit(" "))
    event = F.concat(F.upper(F.substring(event, 1, 1)), F.lower(F.substr(event, F.lit(2))))
    items = F.array_join(F.slice(col(item_array), 1, 3), ", ")
    fallback = F.coalesce(F.nullif(col(description), F.lit("")), F.nullif(col(title), F.lit("")), F.lit(""))
    ladder = (
        F.when(has_title & (col(norm_form) == "8-K"), col(title))
        .when(has_title & col(event_type).isNotNull() & col(norm_form).isin("8-K", "6-K"),
              F.concat(event, F.lit(": "), col(title)))
        .when((F.size(F.coalesce(col(item_array), F.array().cast("array<string>"))) > 0) & (col(norm_form) == "8-K"),
              F.concat(F.lit("Current event filing covering item "), items, F.lit(".")))
    )
    return F.coalesce(ladder, section_snippet(sections), fallback) if sections is not None else F.coalesce(
        ladder, fallback)


def digest_line(n_filings, n_news, top_title) -> Column:
    filings = F.when(col(n_filings) > 0, F.concat(
        col(n_filings).cast("string"), F.lit(" notable filings were captured in this window.")))
    news = F.when(col(n_news) > 0, F.concat(
        col(n_news).cast("string"), F.lit(" important news items were tracked, led by "),
        F.coalesce(col(top_title), F.lit("")), F.lit(".")))
    return F.coalesce(
        F.nullif(F.concat_ws(" ", filings, news), F.lit("")),
        F.lit("No qualifying filings or news were captured in this digest window."))


def catalyst_line(item_type, title, tags, occurred_at) -> Column:
    when_text = display_date(occurred_at)
    upcoming = F.array_contains(col(tags), "upcoming")
    return (
        F.when((col(item_type) == "trial") & upcoming, F.concat(col(title), F.lit(" on "), when_text))
        .when(col(item_type) == "trial", F.concat(F.lit("Clinical trial signal: "), col(title)))
        .when(col(item_type) == "filing", F.concat(col(title), F.lit(" ("), when_text, F.lit(")")))
        .when(col(item_type) == "regulatory",
              F.concat(F.lit("FDA catalyst: "), col(title), F.lit(" ("), when_text, F.lit(")")))
        .otherwise(col(title))
    )
