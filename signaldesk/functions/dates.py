"""Date and time expressions.  ``as_of`` is always explicit."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from signaldesk.constants import LOCAL_ZONE


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def at(as_of) -> Column:
    """An instant from an ISO string, or a column passed through."""
    return F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of


def days_before(as_of, days: int) -> Column:
    return at(as_of) - F.make_dt_interval(F.lit(days))


def age_hours(ts, as_of) -> Column:
    micros = F.unix_micros(at(as_of)) - F.unix_micros(col(ts))
    return F.greatest(micros / F.lit(3.6e9), F.lit(0.0))


def recency_score(ts, as_of) -> Column:
    """100/80/60 up to 1/3/7 days, then a log decay with floor 10; future = 100."""
    age = age_hours(ts, as_of)
    return (
        F.when(col(ts).isNull(), F.lit(None).cast("double"))
        .when(age <= 24, 100.0)
        .when(age <= 72, 80.0)
        .when(age <= 168, 60.0)
        .otherwise(F.greatest(F.lit(10.0), 60.0 - F.log2(age) * 5.0))
    )


def freshness_bucket(ts, as_of, future_as_upcoming: bool = False) -> Column:
    age = age_hours(ts, as_of)
    bucket = (
        F.when(age <= 24, "last_24h")
        .when(age <= 168, "last_7d")
        .when(age <= 720, "last_30d")
        .when(age <= 2160, "last_90d")
        .otherwise("stale")
    )
    if future_as_upcoming:
        bucket = F.when(col(ts) >= at(as_of), "upcoming").otherwise(bucket)
    return bucket


def parse_lenient_date(text) -> Column:
    """``2024-05-06``, ``2024-05``, ``May 6, 2024`` or ``May 2024`` to a date; else null."""
    raw = col(text)
    patterns = (
        (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        (r"^\d{4}-\d{1,2}$", "yyyy-M"),
        (r"^[A-Za-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"),
        (r"^[A-Za-z]+ \d{4}$", "MMMM yyyy"),
    )
    tries = [F.when(raw.rlike(rx), F.try_to_timestamp(raw, F.lit(fmt))) for rx, fmt in patterns]
    return F.coalesce(*tries).cast("date")


def parse_acceptance(text) -> Column:
    """Acceptance stamps: 14 digits (more are ignored) or ISO text."""
    raw = col(text)
    return F.when(
        raw.rlike(r"^\d{14,}$"), F.try_to_timestamp(F.substring(raw, 1, 14), F.lit("yyyyMMddHHmmss"))
    ).otherwise(raw.try_cast("timestamp"))


def parse_published(published, updated=None) -> Column:
    """Feed times: RFC-822 (day name optional) or ISO; UTC when no zone is given."""
    raw = F.nullif(F.trim(col(published)), F.lit(""))
    if updated is not None:
        raw = F.coalesce(raw, F.nullif(F.trim(col(updated)), F.lit("")))
    bare = F.regexp_replace(raw, r"^[A-Za-z]{3,9},\s*", "")
    tries = [
        F.when(bare.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} "),
               F.coalesce(
                   F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")),
                   F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")))),
        F.when(bare.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}$"),
               F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss"))),
        raw.try_cast("timestamp"),
    ]
    return F.coalesce(*tries)


def parse_calendar(text) -> Column:
    """Calendar cells: ``MM/dd/yyyy [hh:mm AM [zone]]`` or ISO text."""
    raw = F.trim(col(text))
    tries = [
        F.when(raw.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(raw, F.lit("M/d/yyyy"))),
        F.when(raw.rlike(r"(?i)^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} [AP]M$"),
               F.try_to_timestamp(F.upper(raw), F.lit("M/d/yyyy h:mm a"))),
        F.when(raw.rlike(r"(?i)^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} [AP]M [A-Z]{2,4}$"),
               F.try_to_timestamp(F.upper(raw), F.lit("M/d/yyyy h:mm a z"))),
        raw.try_cast("timestamp"),
    ]
    return F.coalesce(*tries)


def parse_month_day_year(text) -> Column:
    """``March 4, 2024`` or ``Mar 4, 2024`` as midnight UTC."""
    raw = F.initcap(F.regexp_replace(col(text), r"\s+", " "))
    short = F.regexp_replace(raw, r"^([A-Z][a-z]{2})[a-z]*", "$1")
    return F.when(short.rlike(r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$"), F.try_to_timestamp(short, F.lit("MMM d, yyyy")))


def digest_window(as_of, kind: str, zone: str = LOCAL_ZONE) -> tuple[Column, Column]:
    """[start, end) of the previous local day, or previous Monday-to-Monday week."""
    local = F.from_utc_timestamp(at(as_of), zone)
    unit, back = ("week", 7) if kind == "weekly" else ("day", 1)
    end = F.date_trunc(unit, local)
    start = end - F.make_dt_interval(F.lit(back))
    return F.to_utc_timestamp(start, zone), F.to_utc_timestamp(end, zone)


def local_date(ts, zone: str = LOCAL_ZONE) -> Column:
    return F.from_utc_timestamp(col(ts), zone).cast("date")


def timeline_instant(*dates) -> Column:
    """First known date, as midnight UTC."""
    return F.coalesce(*[col(d) for d in dates]).cast("timestamp")


def display_date(ts) -> Column:
    return F.date_format(col(ts), "MMM d, yyyy")
